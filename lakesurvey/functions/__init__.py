from lakesurvey.functions.missing import *  # noqa: F401,F403
from lakesurvey.functions.dates import *  # noqa: F401,F403
from lakesurvey.functions.exact import exact_mean, exact_mean_strict, exact_sum0  # noqa: F401
from lakesurvey.functions.stages import *  # noqa: F401,F403
