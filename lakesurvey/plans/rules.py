"""Fixed values of the exports: site lists and per-sample corrections.

Every plan takes these as arguments; the constants below are the values of the standing exports.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

# Long-term western sites, all core sites with two gap fillers, forecast sites.
WESTERN_SITES = ("27-918", "37-890", "36-873", "29-905", "16-970", "14-972", "8-994", "3-996")
CORE_SITES = (
    *WESTERN_SITES,
    "1279_20m", "1280_15m", "1281_5m", "1281_10m", "1318_20m", "1319_15m", "1320_10m", "1310_5m",
    "1320_5m", "1310_10m",
)
FORECAST_SITES = ("1279_20m", "1281_10m", "27-918", "37-890")

# Groups of the basin-wide matrix and their column names.
MATRIX_GROUPS = (
    "Calanoida_Nauplii", "Calanoida_YO", "Cladocera_YO", "Cyclopoida_Nauplii", "Cyclopoida_YO",
    "Leptodora kindti_YO", "Rotifers_YO", "Veneroida_Veliger",
)
MATRIX_NAMES = {
    "Calanoida_YO": "Calanoida", "Cladocera_YO": "Cladocera", "Cyclopoida_YO": "Cyclopoida",
    "Leptodora kindti_YO": "Leptodora", "Rotifers_YO": "Rotifers", "Veneroida_Veliger": "Veligers",
    "Surface_temp": "TempC",
}
LOWEST_TEMPERATURE = 0.5
# Cell-size classes of one phytoplankton genus that a total must not count twice.
DOUBLE_COUNTED_PHYTO = ("Microcystis_sm_celled_by_cell", "Microcystis_lg_celled_by_col")
# Calanoid species compared between counters, and the longest credible length (mm).
COMPARED_CALANOIDS = (
    "Leptodiaptomus minutus", "Skistodiaptomus oregonensis", "Leptodiaptomus ashlandi", "Leptodiaptomus sicilis",
)
LONGEST_MM = 7
REPORT_OFFSETS = {2018: 0.0, 2019: 0.1, 2020: 0.2}


@dataclass(frozen=True)
class Corrections:
    """Known errors in stored readings, by sample id."""

    meters: Sequence[tuple[str, str, float]] = ()
    volumes: Sequence[tuple[str, str, float]] = ()
    stored_volume: Sequence[str] = ()
    drop_biomass: Sequence[str] = ()


# Corrections taken from the counters' sheets.
KNOWN_CORRECTIONS = Corrections(
    meters=(
        ("20090713-1281_10m", "Meter_1", 0),
        ("20090713-1281_10m", "Meter_2", 401),
        ("20090713-1279_20m", "Meter_1", 0),
        ("20090713-1279_20m", "Meter_2", 661),
    ),
    volumes=(
        ("20090713-1279_20m", "Subsampled_vol_mL", 8),
        ("20090713-1281_10m", "Subsampled_vol_mL", 8),
        ("20090713-1279_20m", "Diluted_vol_mL", 3300),
        ("20090713-1281_10m", "Diluted_vol_mL", 3300),
    ),
    stored_volume=("20070829-1281_10m", "20090713-1279_20m", "20090713-1281_10m"),
    drop_biomass=("20070829-1281_10m", "20090713-1279_20m", "20090713-1281_10m"),
)
