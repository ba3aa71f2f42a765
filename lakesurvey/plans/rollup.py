"""One stored roll-up of the counts, from which the standing exports come.

The exports differ in sites, years, volumes and corrections, and all of these belong to samples. What they share, the sums per sample,
pooled taxon and collapsed stage, is computed once and stored; a density is its count times a factor of the sample, so corrected volumes are applied to
the stored sums. An export reads the level, not the facts. Stored in buckets of the sample id, it meets its samples without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.operators.cleaning import date_range, equals_all, keep_members, null_by_key, recode_values, regex_exclude, within_years
from lakesurvey.operators.datasheet import count_to_density
from lakesurvey.operators.harmonize import (
    CRUSTACEAN_ORDERS, IMMATURE_RULES, TAXON_TYPOS, UNTRUSTED_TAXA, reassign_immatures, stable_labels, with_collapsed_stage,
)
from lakesurvey.operators.joins import enrich_taxa, inner_join, left_join
from lakesurvey.operators.rollup import mean, partial_sums, total
from lakesurvey.plans.exports import (
    LENGTH, MEASURES, SAMPLE, TAXON, biop_groups, checked_volumes, corrected_samples, crustacean_report, monthly_taxa, named_taxa, one_year,
)
from lakesurvey.plans.rules import KNOWN_CORRECTIONS, REPORT_OFFSETS, Corrections
from lakesurvey.sources import append_bucketed

LEVEL_KEYS = ("Sample_ID", TAXON, "Life_stage2")


def sample_level(
    final: DataFrame, taxa: DataFrame, *, exclude: Sequence[str] = UNTRUSTED_TAXA, immatures: Sequence[tuple[str, str, str]] = IMMATURE_RULES, buckets: int | None = None,
) -> DataFrame:
    """Partial sums per sample, pooled taxon and collapsed stage, without untrusted taxa; by year where the facts have it.

    With ``buckets`` the rows are sent to the buckets of their samples first, where their sums are then written as they lie.
    """
    keys = [*LEVEL_KEYS, *[c for c in ("year",) if c in final.columns]]
    rows = enrich_taxa(final.select("Sample_ID", TAXON, "Life_stage", *MEASURES, LENGTH, *keys[3:]), taxa, ["Order1"])
    rows = with_collapsed_stage(reassign_immatures(rows, immatures))
    rows = regex_exclude(recode_values(rows, TAXON, TAXON_TYPOS), TAXON, *exclude)
    return partial_sums(rows.repartition(buckets, "Sample_ID") if buckets else rows, keys, [*MEASURES, LENGTH])


def store_level(final: DataFrame, taxa: DataFrame, table: str, *, years: Sequence[int] | None = None, buckets: int = 1024, path: str | None = None) -> None:
    """Write the level to a catalog table, by year and in buckets of the sample id.

    With ``years``, those that new sheets touched, only these partitions are read from the facts and replaced.
    """
    if years is not None:
        final = final.filter(F.col("year").isin(list(years)))
    append_bucketed(sample_level(final, taxa, buckets=buckets), table, buckets=buckets, path=path, partition="year", replace=True)


@dataclass(frozen=True)
class Level:
    """The stored level with the dimensions that exports need."""

    level: DataFrame
    sample_info: DataFrame
    taxa: DataFrame
    inventory: DataFrame
    bucketed: bool = True

    def _with_samples(self, samples: DataFrame, level: DataFrame) -> DataFrame:
        """Sums per sample, taxon and stage of the given samples, with the density that their volume gives."""
        rows = inner_join(level, samples, "Sample_ID", split_hot=not self.bucketed)
        rows = rows.select(
            *SAMPLE, TAXON, "Life_stage2", total("Number_counted").alias("Number_counted"), total("Zoop_biomass").alias("Zoop_biomass"), mean(LENGTH).alias(LENGTH),
            "Subsampled_vol_mL", "Diluted_vol_mL", "Vol_sampled_L2",
        )
        rows = count_to_density(rows, volume="Vol_sampled_L2").fillna(0.0, ["Zoop_density"])
        return rows.select(*SAMPLE, TAXON, "Life_stage2", *MEASURES, LENGTH)

    def corrected(self, *, sites: Sequence[str], volume_sites: Sequence[str] | None = None, after: date | None = None, corrections: Corrections = KNOWN_CORRECTIONS) -> DataFrame:
        samples = corrected_samples(
            self.sample_info, self.inventory, sites=sites, volume_sites=volume_sites, after=after, corrections=corrections, bucketed=self.bucketed
        )
        rows = self._with_samples(samples, within_years(self.level, after=after))
        return null_by_key(rows, "Sample_ID", corrections.drop_biomass, "Zoop_biomass").fillna(0.0, ["Zoop_biomass"])

    def ftg_long(self, *, sites: Sequence[str], after: date | None = date(2001, 1, 1), corrections: Corrections = KNOWN_CORRECTIONS) -> DataFrame:
        return stable_labels(biop_groups(self.corrected(sites=sites, after=after, corrections=corrections), self.taxa))

    def ftg_annual(self, *, year: int, project: str, sites: Sequence[str], volumes_after: date | None = None) -> DataFrame:
        samples = self.sample_info.select(*SAMPLE, "Project", "Subsampled_vol_mL", "Diluted_vol_mL")
        samples = date_range(samples, "Sample_date", first=date(year, 1, 1), before=date(year + 1, 1, 1))
        samples = keep_members(equals_all(samples, equal={"Project": project}), "Sample_site", sites)
        volumes = checked_volumes(self.inventory, sites, after=volumes_after, corrections=Corrections()).select("Sample_ID", "Vol_sampled_L2")
        samples = left_join(samples, volumes, "Sample_ID", null_keys=False, split_hot=not self.bucketed)
        return biop_groups(self._with_samples(samples, one_year(self.level, year)), self.taxa)

    def sample_taxa(self, *, sites: Sequence[str], volume_sites: Sequence[str] | None = None, corrections: Corrections = KNOWN_CORRECTIONS) -> DataFrame:
        rows = self.corrected(sites=sites, volume_sites=volume_sites, corrections=corrections)
        return named_taxa(rows.filter(F.col("Life_stage2") != "Egg"), self.taxa)

    def index_zoop(self, **which) -> DataFrame:
        return monthly_taxa(self.sample_taxa(**which), self.inventory, agg="mean")

    def monthly_request(self, **which) -> DataFrame:
        return monthly_taxa(self.sample_taxa(**which), self.inventory, agg="sum")

    def annual_report(
        self, *, western: Sequence[str], offsets: Mapping[int, float] = REPORT_OFFSETS, orders: Sequence[str] = CRUSTACEAN_ORDERS, **which,
    ) -> DataFrame:
        span = {"first": date(min(offsets), 1, 1), "before": date(max(offsets) + 1, 1, 1)}
        narrow = Level(within_years(self.level, **span), date_range(self.sample_info, "Sample_date", **span), self.taxa, self.inventory, self.bucketed)
        return crustacean_report(narrow.sample_taxa(**which), western=western, offsets=offsets, orders=orders)
