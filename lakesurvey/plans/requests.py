"""Data requests and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.operators.aggregates import count_min_max, resolve_dups_by_mean
from lakesurvey.operators.cleaning import (
    date_range, equals_all, keep_members, null_if_implausible, recode_values, threshold_filter, within_years,
)
from lakesurvey.operators.harmonize import counter_period_class, size_groups
from lakesurvey.operators.joins import enrich_taxa, inner_join, left_join, star_join
from lakesurvey.operators.rates import mean_individual_mass
from lakesurvey.operators.reshape import key_difference
from lakesurvey.operators.windows import duplicate_rows
from lakesurvey.plans.rules import COMPARED_CALANOIDS, DOUBLE_COUNTED_PHYTO, LONGEST_MM
from lakesurvey.sources import union_files

TAXON = "Genus_sp_lifestage"
FINAL_KEY = ("Sample_ID", TAXON, "Life_stage")
MEASURES = ("Number_counted", "Zoop_density", "Zoop_biomass")
SAMPLE = ("Sample_ID", "Sample_date", "Sample_site")
PHYTO_TAXON = ("Taxa_name", "Kingdom", "Phylum", "Class", "Order1", "Family", "Genus", "Type", "Edible")


def phyto_star(final: DataFrame, samples: DataFrame, taxa: DataFrame, sites: DataFrame, *, project: str) -> DataFrame:
    """Phytoplankton results of one project with sample, taxon and site columns."""
    samples = equals_all(samples.select(*SAMPLE, "Water_body", "Project"), equal={"Project": project})
    rows = inner_join(final.select("Sample_ID", "Genus_type", "Phyto_density", "Phyto_biomass"), samples, "Sample_ID")
    return star_join(rows, [
        (taxa.select("Genus_type", *PHYTO_TAXON).distinct(), "Genus_type"),
        (sites.select("Sample_site", "Latitude", "Longitude"), "Sample_site"),
    ])


def index_phyto(final, samples, taxa, site_table, *, project: str, sites: Sequence[str], exclude: Sequence[str] = DOUBLE_COUNTED_PHYTO) -> DataFrame:
    """Sample by taxon phytoplankton at the core sites, double-counted classes left out."""
    rows = phyto_star(final, keep_members(samples, "Sample_site", sites), taxa, site_table, project=project)
    return equals_all(rows, differ={"Genus_type": exclude})


def index_chla(pigments: DataFrame, *, sites: Sequence[str]) -> DataFrame:
    """Chlorophyll per sample at the core sites."""
    return keep_members(pigments.select(*SAMPLE, "Chl_a_ugL_L"), "Sample_site", sites)


def _request_rows(
    final: DataFrame, sample_info: DataFrame, *, exclude_projects: Sequence[str], after: date | None, before: date | None,
    project_typos: Mapping[str, str],
) -> DataFrame:
    samples = date_range(sample_info.select(*SAMPLE, "Project"), "Sample_date", after=after, before=before)
    samples = equals_all(samples, differ={"Project": exclude_projects})
    facts = within_years(final, after=after, before=before)
    rows = inner_join(facts.select(*FINAL_KEY, *MEASURES), samples, "Sample_ID")
    return recode_values(rows, "Project", project_typos)


def foia_zoop(
    final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, exclude_projects: Sequence[str],
    after: date | None = date(2001, 1, 1), before: date | None = date(2018, 1, 1), project_typos: Mapping[str, str] = {},
) -> DataFrame:
    """Released zooplankton: repeated keys averaged, long-term taxon name attached."""
    rows = _request_rows(
        final, sample_info, exclude_projects=exclude_projects, after=after, before=before, project_typos=project_typos
    )
    once = resolve_dups_by_mean(rows, [*SAMPLE, TAXON, "Life_stage"], MEASURES)
    return enrich_taxa(once, taxa, ["Genus_sp_95toPresent"])


def foia_phyto(
    final: DataFrame, samples: DataFrame, taxa: DataFrame, *, after: date | None = date(2001, 1, 1),
    before: date | None = date(2018, 1, 1),
) -> DataFrame:
    """Released phytoplankton."""
    dated = date_range(samples.select(*SAMPLE, "Project"), "Sample_date", after=after, before=before)
    facts = within_years(final, after=after, before=before)
    rows = inner_join(facts.select("Sample_ID", "Genus_type", "Phyto_density", "Phyto_biomass"), dated, "Sample_ID")
    return enrich_taxa(rows, taxa, ["Taxa_name", "Phylum", "Genus"], on="Genus_type")


def foia_env(
    inventory: DataFrame, *, projects: Sequence[str], after: date | None = date(2001, 1, 1),
    before: date | None = date(2018, 1, 1), project_typos: Mapping[str, str] = {},
) -> DataFrame:
    """Released temperature and oxygen; a temperature of exactly zero stands for no reading."""
    rows = inventory.select(
        *SAMPLE, "Latitude", "Longitude", "Project", "Surface_temp", "Bottom_temp", "Surface_DO", "Bottom_DO"
    )
    rows = keep_members(date_range(rows, "Sample_date", after=after, before=before), "Project", projects)
    rows = recode_values(rows, "Project", project_typos)
    return null_if_implausible(rows, equal={"Surface_temp": 0.0, "Bottom_temp": 0.0})


def foia_summary(frames: Sequence[DataFrame], *, first_year: int, last_year: int, drop: Sequence[str], year: str = "Year") -> DataFrame:
    """Seasonal summaries of both basins stacked, within a span of years."""
    return union_files([f.filter(F.col(year).between(first_year, last_year)) for f in frames], drop)


def reservoir_sites(inventory: DataFrame, *, project: str) -> DataFrame:
    """Inventory rows of one project."""
    columns = [*SAMPLE, "Project", "Latitude", "Longitude", "Secchi_depth_m", "Depth_m", "Ave_temp"]
    return equals_all(inventory.select(*columns), equal={"Project": project})


def phyto_taxa_table(taxa: DataFrame) -> DataFrame:
    return taxa.select("Genus_type", *PHYTO_TAXON, "Conversion_um_per_cell", "Volumetric_equation")


def zoop_taxa_table(taxa: DataFrame) -> DataFrame:
    """Long-term name and order once per taxon; the taxon is dropped after de-duplication, so a
    pair shows up as often as it has taxa."""
    return taxa.select(TAXON, "Genus_sp_95toPresent", "Order1").distinct().drop(TAXON)


SITE_KEYS = ("Sample_site", "Latitude", "Longitude")


def site_counts(rows: DataFrame) -> DataFrame:
    """Samples, first and last date per site and position."""
    once = rows.select(*SAMPLE, "Latitude", "Longitude").distinct()
    return count_min_max(once, SITE_KEYS, "Sample_date")


def phyto_site_counts(final, samples, site_table, *, project: str) -> DataFrame:
    """Site counts of samples with phytoplankton results.

    Results only decide which samples count, so they enter as distinct sample ids (combined before
    the shuffle) in a semi join; taxon columns do not reach the output and are not joined.
    """
    chosen = equals_all(samples.select(*SAMPLE, "Project"), equal={"Project": project})
    chosen = chosen.join(final.select("Sample_ID").distinct(), "Sample_ID", "left_semi")
    return site_counts(left_join(chosen, site_table.select("Sample_site", "Latitude", "Longitude"), "Sample_site"))


def zoop_site_counts(inventory, sample_info, *, project: str) -> DataFrame:
    """Site counts of inventoried samples of one project."""
    samples = equals_all(sample_info.select(*SAMPLE, "Project"), equal={"Project": project})
    return site_counts(inner_join(inventory.select("Sample_ID", "Latitude", "Longitude"), samples, "Sample_ID"))


def length_explore(
    lengths: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, named: Sequence[str], lead: str,
    counter_typos: Mapping[str, str] = {}, split: date = date(2016, 1, 1), order: str = "Calanoida",
    longest: float = LONGEST_MM, species: Sequence[str] = COMPARED_CALANOIDS,
) -> DataFrame:
    """Distinct lengths of chosen species, classed by counter and period."""
    once = lengths.select("Sample_ID", TAXON, "Life_stage", "Measured_number", "Length_mm")
    once = threshold_filter(once, "Length_mm", below=longest).distinct()
    rows = left_join(once, sample_info.select(*SAMPLE, "Project", "Counter_name"), "Sample_ID", null_keys=False)
    rows = enrich_taxa(rows, taxa, ["Genus_sp_95toPresent", "Has_eggs", "Order1"], on=[TAXON, "Life_stage"])
    rows = keep_members(equals_all(rows, equal={"Order1": order}), "Genus_sp_95toPresent", species)
    return counter_period_class(recode_values(rows, "Counter_name", counter_typos), named, lead, split)


def individual_masses(final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, project: str) -> DataFrame:
    """Mean individual mass of every non-egg, non-nauplius result of one project."""
    samples = equals_all(sample_info.select(*SAMPLE, "Project"), equal={"Project": project})
    rows = final.select(*FINAL_KEY, "Zoop_density", "Zoop_biomass")
    rows = mean_individual_mass(equals_all(rows, differ={"Life_stage": ["Egg", "Nauplii"]}))
    rows = inner_join(rows.drop("Zoop_density", "Zoop_biomass"), samples, "Sample_ID")
    return enrich_taxa(rows, taxa, ["Genus", "Family", "Order1"])


def mean_masses(final: DataFrame, sample_info: DataFrame, taxa: DataFrame, *, project: str) -> DataFrame:
    """Mean individual mass of total, major and minor groups."""
    return size_groups(individual_masses(final, sample_info, taxa, project=project))


def dup_audit(
    final: DataFrame, sample_info: DataFrame, *, exclude_projects: Sequence[str], after: date | None = date(2001, 1, 1),
    before: date | None = None, project_typos: Mapping[str, str] = {},
) -> tuple[DataFrame, DataFrame]:
    """Repeated rows of the final key, and the table with repeats averaged."""
    rows = _request_rows(
        final, sample_info, exclude_projects=exclude_projects, after=after, before=before, project_typos=project_typos
    )
    repeats = duplicate_rows(rows, FINAL_KEY, [*MEASURES])
    return repeats, resolve_dups_by_mean(rows, FINAL_KEY, MEASURES)


def label_differences(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Labels of one frame that the other lacks, each once."""
    return key_difference(left.select(column).distinct(), right, column)
