"""Explicit schemas. Nothing in this package infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    simple = {"S": T.StringType(), "D": T.DoubleType(), "I": T.IntegerType(), "T": T.DateType(), "B": T.BooleanType()}
    fields = (item.split(":") for item in spec.split())
    return T.StructType([T.StructField(name, simple[kind]) for name, kind in fields])


LENGTH_CELLS = [f"L{i}" for i in range(1, 21)]

# A sheet holds two tables side by side: header pairs on the left, the taxon matrix on the right.
SHEET = _struct(
    "Information:S Value:S Sample_ID:S Genus_sp_lifestage:S Number_counted:S "
    + " ".join(f"{c}:S" for c in LENGTH_CELLS)
)

# Header keys and the type each takes once spread (S text, T date written yyyyMMdd, D number).
HEADER = _struct(
    "Sample_ID:S Sample_date:T Sample_time:S Sample_site:S Water_body:S Project:S Latitude:D "
    "Longitude:D Depth_m:D Surface_temp:D Bottom_temp:D Ave_temp:D Surface_DO:D Bottom_DO:D "
    "Net_diameter_m:D Meter_1:D Meter_2:D Revolutions:D Secchi_depth_m:D Date_counted:T "
    "Counter_name:S Microscope_number:S mm_per_ocular_unit:D Subsampled_vol_mL:D "
    "Diluted_vol_mL:D Comments:S"
)

CUTOFFS = _struct("Length_cutoff:D Genus_sp_lifestage:S")

TAXA_NAMES = _struct(
    "row_name:S Genus_sp_lifestage:S Genus_sp_95toPresent:S biop_152_codes:I biop_152_names:S "
    "biop_152_names_95pres:S"
)

SAMPLE_INFO = _struct(
    "Sample_ID:S Sample_date:T Sample_site:S Water_body:S Project:S Depth_m:D Surface_temp:D "
    "Meter_1:D Meter_2:D Counter_name:S Date_counted:T Microscope_number:S mm_per_ocular_unit:D "
    "Subsampled_vol_mL:D Diluted_vol_mL:D"
)

# What a sheet's header contributes to the inventory; the volume and spare meter readings that
# exports also read are filled by hand later, so they are null for freshly entered samples.
SAMPLE_INVENTORY = _struct(
    "Sample_ID:S Sample_date:T Sample_time:S Sample_site:S Latitude:D Longitude:D Project:S "
    "Net_diameter_m:D Meter_1:D Meter_2:D Revolutions:D Secchi_depth_m:D Depth_m:D "
    "Surface_temp:D Bottom_temp:D Ave_temp:D Surface_DO:D Bottom_DO:D Comments:S"
)

COUNTS = _struct("Sample_ID:S Genus_sp_lifestage:S Life_stage:S Number_counted:D")
LENGTHS = _struct("Sample_ID:S Genus_sp_lifestage:S Life_stage:S Measured_number:S Length_mm:D")
EGG_COUNTS = _struct("Sample_ID:S Genus_sp_lifestage:S Measured_number:S Number_eggs:D")
FINAL = _struct(
    "Sample_ID:S Genus_sp_lifestage:S Life_stage:S Number_counted:D Zoop_density:D Zoop_biomass:D "
    "Zoop_P_exc:D Zoop_N_exc:D Zoop_FR1:D Zoop_prod:D Zoop_len_avg:D"
)

TAXA_GROUPS = _struct(
    "Genus_sp_lifestage:S Life_stage:S Genus_sp_95toPresent:S Order1:S Family:S Genus:S Phylum:S "
    "Has_eggs:S FTG_Groups_1:S biop_152_codes:I biop_152_names:S Biom_a:D Biom_b:D Biom_dens:D "
    "FR1_a:D FR1_b:D Pr_alpha:D Pr_beta:D Pr_rho:D"
)

PHYTO_FINAL = _struct("ID:I Sample_ID:S Genus_type:S Phyto_density:D Phyto_biomass:D")
PHYTO_SAMPLE_INFO = _struct("Sample_ID:S Sample_date:T Sample_site:S Water_body:S Project:S")
PHYTO_TAXA_GROUPS = _struct(
    "Genus_type:S Taxa_name:S Kingdom:S Phylum:S Class:S Order1:S Family:S Genus:S Type:S "
    "Edible:B Conversion_um_per_cell:D Volumetric_equation:S"
)
SAMPLING_SITES = _struct("Sample_site:S Latitude:D Longitude:D")
PIGMENTS = _struct("Sample_ID:S Sample_date:T Sample_site:S Chl_a_ugL_L:D")
