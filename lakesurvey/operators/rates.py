"""Biomass, excretion, filtration and production."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import mean_skip, mean_strict, ratio
from lakesurvey.operators.joins import MISSING, join_within, left_join

# Allometric coefficients (scale, exponent) of daily phosphorus and nitrogen
# excretion over individual mass, and the straight line for veliger filtration over length.
P_EXCRETION = (0.022387, 0.54)
N_EXCRETION = (0.041686938, 0.67)
VELIGER_FILTRATION = (-0.0602, 0.714)
VELIGER_TAXON = "Dreissena_veligers"

TAXON_STAGE = ("Genus_sp_lifestage", "Life_stage")
COEFFICIENTS = ("Biom_a", "Biom_b", "Biom_dens", "FR1_a", "FR1_b", "Pr_alpha", "Pr_beta", "Pr_rho")


def _power(scale, base, exponent):
    return scale * F.pow(base, exponent)


def coefficients(taxa: DataFrame) -> DataFrame:
    """One coefficient row per taxon and stage; rows repeated word for word count once."""
    return taxa.select(*TAXON_STAGE, *COEFFICIENTS).distinct()


def individual_rates(lengths: DataFrame, taxa: DataFrame, *, veliger_taxon: str = VELIGER_TAXON, null_keys: bool = True) -> DataFrame:
    """Mass and daily rates of each measured individual.

    ``null_keys`` is as for :func:`left_join`; without it, means of these rows need no further shuffle where taxa are too many to be broadcast.
    """
    length = F.col("Length_mm")
    rows = left_join(lengths, coefficients(taxa), TAXON_STAGE, null_keys=null_keys)
    rows = rows.withColumn("Ind_biomass", _power(F.col("Biom_a"), length, F.col("Biom_b")))
    intercept, slope = VELIGER_FILTRATION
    is_veliger = F.col("Genus_sp_lifestage") == veliger_taxon
    return rows.withColumns({
        "PE": _power(F.lit(P_EXCRETION[0]), F.col("Ind_biomass"), F.lit(P_EXCRETION[1])),
        "NE": _power(F.lit(N_EXCRETION[0]), F.col("Ind_biomass"), F.lit(N_EXCRETION[1])),
        "FR1": F.when(is_veliger, F.lit(intercept) + F.lit(slope) * length).otherwise(
            _power(F.col("FR1_a"), length, F.col("FR1_b"))
        ),
    }).drop(*COEFFICIENTS)


def stage_means(individuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Means per sheet, taxon and stage: mass and length over the values present, rates strict."""
    return individuals.groupBy(*keys, *TAXON_STAGE).agg(
        mean_skip("Ind_biomass").alias("mean_mass"),
        *[mean_strict(c).alias(f"mean_{c}") for c in ("PE", "NE", "FR1")],
        mean_skip("Length_mm").alias("mean_length"),
    )


def volumetric_rates(
    counts: DataFrame, means: DataFrame, taxa: DataFrame, keys: Sequence[str], *, temperature: str = "Surface_temp", null_keys: bool = True,
) -> DataFrame:
    """Biomass and rates per litre from densities and individual means.

    A taxon with a stated mass per individual uses it, one without uses the measured mean, and one
    without either has biomass 0; all rates are 0 where biomass is. Eggs carry no density. ``null_keys`` lets missing taxa
    and stages match; without it, they are taken to have the names of :func:`name_missing`.
    """
    density, mass = F.col("Zoop_density"), F.col("Zoop_biomass")
    stage = F.col("Life_stage") if null_keys else F.nullif(F.col("Life_stage"), F.lit(MISSING))
    # The coefficients come first: where taxa are too many to be broadcast, the means lie by taxon as well.
    rows = left_join(counts, coefficients(taxa), TAXON_STAGE, null_keys=null_keys)
    rows = join_within(rows, means, keys[0], [*keys[1:], *TAXON_STAGE], null_keys=null_keys or keys[1:])
    measured = F.coalesce(F.col("mean_mass"), F.lit(0.0)) * density
    stated = F.when(F.col("Biom_dens").isNotNull(), density * F.col("Biom_dens")).otherwise(measured)
    rows = rows.withColumn("Zoop_biomass", F.coalesce(stated, F.lit(0.0)))

    def unless_empty(c):
        return F.when(mass == 0, F.lit(0.0)).otherwise(c)

    produced = _power(F.col("Pr_alpha"), mass, F.col("Pr_beta")) * F.pow(F.col("Pr_rho"), F.col(temperature))
    rates = {
        "Zoop_P_exc": F.col("mean_PE") * density,
        "Zoop_N_exc": F.col("mean_NE") * density,
        "Zoop_FR1": F.col("mean_FR1") * density,
        "Zoop_prod": produced,
    }
    rows = rows.withColumns({name: unless_empty(c) for name, c in rates.items()})
    return rows.withColumns({
        "Zoop_density": F.when(stage != "Egg", density), "Zoop_len_avg": F.col("mean_length"),
    }).drop("mean_mass", "mean_PE", "mean_NE", "mean_FR1", "mean_length", *COEFFICIENTS)


def mean_individual_mass(df: DataFrame, *, biomass: str = "Zoop_biomass", density: str = "Zoop_density", into: str = "ZoopMeanBiomass") -> DataFrame:
    """Biomass per individual, rows without a positive value removed."""
    return df.withColumn(into, ratio(biomass, density)).filter(F.col(into) > 0)
