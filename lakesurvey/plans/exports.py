"""Zooplankton exports built on one corrected, re-grouped core."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import null_below
from lakesurvey.operators.aggregates import mean_se, monthly_rollup, sum_zero_empty
from lakesurvey.operators.cleaning import (
    apply_overrides, choose_column_by_key, date_range, keep_members, null_by_key, recode_values, regex_exclude,
    select_rename, within_years,
)
from lakesurvey.operators.datasheet import count_to_density, sampled_volume_litres
from lakesurvey.operators.harmonize import (
    CRUSTACEAN_ORDERS, ENVIRONMENT, GROUP_TYPOS, IMMATURE_RULES, TAXON_TYPOS, UNTRUSTED_TAXA, basin_of_site,
    crustacean_total, env_monthly, major_group_totals, order_subset_total, reassign_immatures, rename_taxa,
    season_mean, stable_labels, with_collapsed_stage, year_offset,
)
from lakesurvey.operators.joins import enrich_taxa, inner_join, left_join
from lakesurvey.operators.quality import qa_volume_agreement
from lakesurvey.operators.reshape import pivot_groups
from lakesurvey.operators.windows import grouped_mutate
from lakesurvey.plans.rules import (
    KNOWN_CORRECTIONS, LOWEST_TEMPERATURE, MATRIX_GROUPS, MATRIX_NAMES, REPORT_OFFSETS, Corrections,
)
from lakesurvey.sources import sql_star_query

TAXON = "Genus_sp_lifestage"
MEASURES = ("Number_counted", "Zoop_density", "Zoop_biomass")
LENGTH = "Zoop_len_avg"
SAMPLE = ("Sample_ID", "Sample_date", "Sample_site")


def checked_volumes(
    inventory: DataFrame, sites: Sequence[str], *, after: date | None = None, corrections: Corrections = KNOWN_CORRECTIONS,
) -> DataFrame:
    """Volume per sample from corrected meter readings, its agreement with the stored one, and the
    volume to use."""
    rows = inventory.select(*SAMPLE, "Meter_1", "Meter_2", "Meter_B1", "Meter_B2", "Vol_sampled_L")
    rows = keep_members(date_range(rows, "Sample_date", after=after), "Sample_site", sites)
    if corrections.meters:
        rows = apply_overrides(rows, "Sample_ID", corrections.meters)
    rows = qa_volume_agreement(sampled_volume_litres(rows))
    return choose_column_by_key(
        rows, "Sample_ID", corrections.stored_volume, listed="Vol_sampled_L", other="Vol_sampled_L2", into="Vol_sampled_L2"
    )


def corrected_samples(
    sample_info: DataFrame, inventory: DataFrame, *, sites: Sequence[str], volume_sites: Sequence[str] | None = None,
    after: date | None = None, corrections: Corrections = KNOWN_CORRECTIONS, bucketed: bool = False,
) -> DataFrame:
    """Samples of chosen sites with corrected subsamples and both volumes."""
    samples = sample_info.select(*SAMPLE, "Project", "Subsampled_vol_mL", "Diluted_vol_mL")
    samples = keep_members(date_range(samples, "Sample_date", after=after), "Sample_site", sites)
    if corrections.volumes:
        samples = apply_overrides(samples, "Sample_ID", corrections.volumes)
    volumes = checked_volumes(inventory, volume_sites or sites, after=after, corrections=corrections)
    volumes = volumes.select("Sample_ID", "Vol_sampled_L", "Vol_sampled_L2", "V1toV2ratio", "V1equalsV2")
    return left_join(samples, volumes, "Sample_ID", null_keys=False, split_hot=not bucketed)


def corrected_counts(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, sites: Sequence[str],
    volume_sites: Sequence[str] | None = None, after: date | None = None,
    corrections: Corrections = KNOWN_CORRECTIONS, measures: Sequence[str] = (*MEASURES, LENGTH), allow_fanout: bool = False, bucketed: bool = False,
) -> DataFrame:
    """Final counts with sample and order, two recomputed densities and their difference from the
    stored one.

    Sample rows and volumes are joined to each other first, so the facts are shuffled by sample id
    once; the sample id is a key, never null. ``volume_sites`` restricts whose volumes are looked
    up (others get no density); by default these are the export's sites. ``bucketed`` says that facts, samples and inventory are
    stored in buckets of the sample id: then they are joined as they lie, and no hot sample is split.
    """
    samples = corrected_samples(
        sample_info, inventory, sites=sites, volume_sites=volume_sites, after=after, corrections=corrections, bucketed=bucketed
    )
    # The export keeps only samples that pass the date and site filters: an inner join says the same.
    facts = within_years(final, after=after)
    rows = inner_join(facts.select("Sample_ID", TAXON, "Life_stage", *measures), samples, "Sample_ID", split_hot=not bucketed)
    rows = enrich_taxa(rows, taxa, ["Order1"], allow_fanout=allow_fanout)
    rows = count_to_density(rows, volume="Vol_sampled_L", into="density_stored_volume")
    rows = count_to_density(rows, volume="Vol_sampled_L2", into="density_computed_volume")
    return rows.withColumn("density_diff", F.col("density_computed_volume") - F.col("Zoop_density"))


def comparable_taxa(
    rows: DataFrame, *, sums: Sequence[str] = MEASURES, means: Sequence[str] = (), exclude: Sequence[str] = UNTRUSTED_TAXA,
    immatures: Sequence[tuple[str, str, str]] = IMMATURE_RULES,
) -> DataFrame:
    """Sums per sample, taxon and collapsed stage, young copepods pooled, untrusted taxa dropped.

    Untrusted taxa are dropped before the sums: the group key holds the taxon, so the result is the
    same and less is shuffled.
    """
    rows = with_collapsed_stage(reassign_immatures(rows, immatures))
    rows = regex_exclude(recode_values(rows, TAXON, TAXON_TYPOS), TAXON, *exclude)
    return sum_zero_empty(rows, [*SAMPLE, TAXON, "Life_stage2"], sums, means)


def with_new_density(rows: DataFrame, corrections: Corrections = KNOWN_CORRECTIONS) -> DataFrame:
    """Recomputed density in place of the stored one; biomass of samples beyond repair blanked."""
    rows = rows.withColumn("Zoop_density", F.col("density_computed_volume"))
    return null_by_key(rows, "Sample_ID", corrections.drop_biomass, "Zoop_biomass")


def biop_groups(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Sums per sample and group label."""
    labelled = enrich_taxa(rows, taxa, ["biop_152_codes", "biop_152_names"])
    labelled = recode_values(labelled, "biop_152_names", GROUP_TYPOS)
    return sum_zero_empty(labelled, [*SAMPLE, "biop_152_names", "biop_152_codes"], MEASURES, [LENGTH])


def one_year(df: DataFrame, year: int) -> DataFrame:
    return within_years(df, first=date(year, 1, 1), before=date(year, 12, 31))


def _star_with_density(final, sample_info, taxa, inventory, *, year, project, sites, volumes_after) -> DataFrame:
    rows = sql_star_query(one_year(final, year), sample_info, taxa, year=year, project=project)
    rows = keep_members(rows, "Sample_site", sites)
    volumes = checked_volumes(inventory, sites, after=volumes_after, corrections=Corrections())
    rows = left_join(rows, volumes.select("Sample_ID", "Vol_sampled_L2"), "Sample_ID", null_keys=False)
    return count_to_density(rows, volume="Vol_sampled_L2")


def ftg_annual(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, year: int, project: str,
    sites: Sequence[str], volumes_after: date | None = None,
) -> DataFrame:
    """One year of the forecast sites: sums per sample and group label."""
    rows = _star_with_density(
        final, sample_info, taxa, inventory, year=year, project=project, sites=sites, volumes_after=volumes_after
    )
    return biop_groups(comparable_taxa(rows, means=[LENGTH]), taxa)


def ftg_long(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, sites: Sequence[str],
    after: date | None = date(2001, 1, 1), corrections: Corrections = KNOWN_CORRECTIONS, bucketed: bool = False,
) -> DataFrame:
    """All years of the forecast sites: sums per sample and group label, with the label that is
    stable over time."""
    rows = with_new_density(
        corrected_counts(final, sample_info, taxa, inventory, sites=sites, after=after, corrections=corrections, bucketed=bucketed), corrections
    )
    # The stable label is a function of the group label, so it is derived and not looked up again.
    return stable_labels(biop_groups(comparable_taxa(rows, means=[LENGTH]), taxa))


def site_year_taxa(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, year: int, project: str, site: str,
    volumes_after: date | None = None,
) -> DataFrame:
    """One site and year: density and biomass per sample, long-term taxon name and stage, no eggs."""
    rows = _star_with_density(
        final, sample_info, taxa, inventory, year=year, project=project, sites=[site], volumes_after=volumes_after
    ).filter(F.col("Life_stage") != "Egg")
    named = enrich_taxa(comparable_taxa(rows, sums=MEASURES[1:]), taxa, ["Genus_sp_95toPresent"])
    return sum_zero_empty(named, [*SAMPLE, "Genus_sp_95toPresent", "Life_stage2"], MEASURES[1:])


def ftg_window_variant(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, year: int, project: str,
    immatures: Sequence[tuple[str, str, str]] = IMMATURE_RULES,
) -> DataFrame:
    """Sample by taxon totals kept on every row, then distinct."""
    rows = sql_star_query(
        one_year(final, year), sample_info, taxa, year=year, project=project,
        taxa_columns=("Order1", "FTG_Groups_1", "biop_152_codes", "biop_152_names"),
    ).fillna(0.0, ["Zoop_density"])
    rows = reassign_immatures(rows, immatures)
    rows = rows.drop("Life_stage", "Project", "Order1", "Subsampled_vol_mL", "Diluted_vol_mL")
    sums = {m: F.coalesce(F.sum(m), F.lit(0.0)) for m in MEASURES}
    return grouped_mutate(rows, ["Sample_ID", TAXON], {**sums, LENGTH: F.avg(LENGTH)})


def basin_wide_matrix(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, sites: Sequence[str],
    first: date = date(1995, 1, 1), before: date = date(2020, 1, 1), groups: Sequence[str] = MATRIX_GROUPS,
    names: Mapping[str, str] = MATRIX_NAMES,
) -> DataFrame:
    """Sample by major group biomass in wide form, with surface temperature."""
    samples = sample_info.select(*SAMPLE, "Surface_temp")
    samples = keep_members(date_range(samples, "Sample_date", first=first, before=before), "Sample_site", sites)
    facts = within_years(final, first=first, before=before)
    rows = inner_join(facts.select("Sample_ID", TAXON, "Life_stage", "Zoop_biomass"), samples, "Sample_ID")
    # Eggs are dropped before the sums, which have the stage in their key. Surface temperature
    # rides along as a function of the sample, which saves a join back to the samples.
    rows = rows.filter(F.col("Life_stage") != "Egg")
    rows = with_collapsed_stage(reassign_immatures(enrich_taxa(rows, taxa, ["Order1"]))).drop("Order1")
    keys = [*SAMPLE, "Surface_temp"]
    fine = sum_zero_empty(rows, [*keys, TAXON, "Life_stage2"], ["Zoop_biomass"])
    fine = enrich_taxa(fine, taxa, ["Genus_sp_95toPresent", "Order1"])
    totals = major_group_totals(fine, keys, "Zoop_biomass", into="group")
    wide = pivot_groups(totals, keys, "group", "Zoop_biomass", groups)
    wide = select_rename(wide, *SAMPLE, *groups, "Surface_temp", rename=names)
    temperature = names.get("Surface_temp", "Surface_temp")
    return wide.withColumn(temperature, null_below(temperature, LOWEST_TEMPERATURE))


def sample_taxa(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, sites: Sequence[str],
    volume_sites: Sequence[str] | None = None, corrections: Corrections = KNOWN_CORRECTIONS, bucketed: bool = False,
) -> DataFrame:
    """Sums per sample, long-term taxon name, order and stage, without eggs."""
    rows = corrected_counts(
        final, sample_info, taxa, inventory, sites=sites, volume_sites=volume_sites, corrections=corrections, measures=MEASURES, bucketed=bucketed
    )
    rows = with_new_density(rows, corrections).filter(F.col("Life_stage") != "Egg")
    return named_taxa(comparable_taxa(rows), taxa)


def named_taxa(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Sums per sample, long-term taxon name, order and stage from sums per sample, taxon and stage."""
    named = enrich_taxa(rows, taxa, ["Genus_sp_95toPresent", "Order1"])
    return sum_zero_empty(named, [*SAMPLE, "Life_stage2", "Genus_sp_95toPresent", "Order1"], MEASURES)


def with_environment(monthly: DataFrame, inventory: DataFrame) -> DataFrame:
    """Month by site biology with month by site environment."""
    env = env_monthly(inventory.select("Sample_date", "Sample_site", *ENVIRONMENT))
    return left_join(monthly, env, ["Y", "M", "Sample_site"])


def monthly_taxa(samples: DataFrame, inventory: DataFrame, *, agg: str) -> DataFrame:
    """Month by site by taxon and stage, with environment; ``agg`` is ``mean`` or ``sum``."""
    keys = ["Life_stage2", "Sample_site", "Order1", "Genus_sp_95toPresent"]
    return with_environment(monthly_rollup(samples, "Sample_date", keys, MEASURES, agg=agg), inventory)


def index_zoop(final, sample_info, taxa, inventory, *, sites, volume_sites=None, corrections=KNOWN_CORRECTIONS, bucketed=False) -> DataFrame:
    """Monthly means by site, taxon and stage with monthly environment."""
    rows = sample_taxa(
        final, sample_info, taxa, inventory, sites=sites, volume_sites=volume_sites, corrections=corrections, bucketed=bucketed
    )
    return monthly_taxa(rows, inventory, agg="mean")


def monthly_request(final, sample_info, taxa, inventory, *, sites, volume_sites=None, corrections=KNOWN_CORRECTIONS) -> DataFrame:
    """As :func:`index_zoop` with monthly sums."""
    rows = sample_taxa(
        final, sample_info, taxa, inventory, sites=sites, volume_sites=volume_sites, corrections=corrections
    )
    return monthly_taxa(rows, inventory, agg="sum")


def annual_report(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, inventory: DataFrame, *, sites: Sequence[str],
    western: Sequence[str], volume_sites: Sequence[str] | None = None, corrections: Corrections = KNOWN_CORRECTIONS,
    offsets: Mapping[int, float] = REPORT_OFFSETS, orders: Sequence[str] = CRUSTACEAN_ORDERS,
) -> DataFrame:
    """Crustacean biomass by year, month and basin: mean and one standard error either side."""
    # Years, stages and orders are keys of the monthly means: filter before them. The span of years
    # is stated as dates, which the sample scan can use.
    span = {"first": date(min(offsets), 1, 1), "before": date(max(offsets) + 1, 1, 1)}
    sample_info = date_range(sample_info, "Sample_date", **span)
    final = within_years(final, **span)
    rows = sample_taxa(
        final, sample_info, taxa, inventory, sites=sites, volume_sites=volume_sites, corrections=corrections
    )
    return crustacean_report(rows, western=western, offsets=offsets, orders=orders)


def crustacean_report(rows: DataFrame, *, western: Sequence[str], offsets: Mapping[int, float], orders: Sequence[str] = CRUSTACEAN_ORDERS) -> DataFrame:
    """The report from sums per sample, long-term taxon name, order and stage."""
    rows = keep_members(keep_members(rows, "Life_stage2", ["YO", "Nauplii"]), "Order1", orders)
    rows = rows.filter(F.year("Sample_date").isin(list(offsets)))
    keys = ["Life_stage2", "Sample_site", "Order1", "Genus_sp_95toPresent"]
    monthly = monthly_rollup(rows, "Sample_date", keys, ["Zoop_biomass"], agg="mean")
    by_order = sum_zero_empty(monthly, ["Y", "M", "Sample_site", "Order1"], ["Zoop_biomass"])
    totals = basin_of_site(crustacean_total(by_order, ["Y", "M", "Sample_site"], orders=orders), western)
    report = mean_se(totals, ["Y", "M", "Basin"], "TotCopCladBM").withColumnRenamed("Y", "Year")
    return year_offset(report, offsets)


def season_report(report: DataFrame, months: Sequence[str] = ("07", "08")) -> DataFrame:
    """Mean of the summer months per year and basin."""
    return season_mean(report, ["Year", "Basin"], months, "TotCopCladBM")


def mesozoop_density(samples: DataFrame, *, sites: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Crustacean density per sample and day of year at chosen sites."""
    return order_subset_total(keep_members(samples, "Sample_site", sites), list(SAMPLE), exclude=exclude)


def label_dimension(taxa: DataFrame) -> DataFrame:
    """Taxon to group labels, with wrong long-term names repaired and the stable label added."""
    rows = taxa.select(TAXON, "Genus_sp_95toPresent", "biop_152_codes", "biop_152_names").distinct()
    return stable_labels(rename_taxa(rows))
