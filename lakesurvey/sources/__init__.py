from lakesurvey.sources.sheets import archive_raw, read_dimension, scan_datasheets, union_files  # noqa: F401
from lakesurvey.sources.tables import (  # noqa: F401
    append_bucketed, append_table, read_table, sql_star_query, write_csv,
)
