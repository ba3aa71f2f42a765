"""Groups and labels that stay comparable across years, and report-ready summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.functions import collapse_stage, if_else, is_member, matches, paste
from lakesurvey.operators.aggregates import mean_of, monthly_rollup, sum_zero_empty, two_level_mean
from lakesurvey.operators.cleaning import derive_date_parts, drop_members, keep_members, reassign, recode_values
from lakesurvey.operators.reshape import pivot_groups, stack_frames

TAXON = "Genus_sp_lifestage"

# Orders whose young are pooled, with the pooled label; the label of one of them
# differs in an older export, hence a parameter.
IMMATURE_RULES = (
    ("Calanoida", "Younger", "Calanoida_immature"),
    ("Cyclopoida", "Younger", "Cyclopidae_immature"),
)
# Taxa whose data are not trusted, and spelling repairs.
UNTRUSTED_TAXA = ("B_longimanus", "C_pengoi")
TAXON_TYPOS = {"Ploesoma_sp": "Ploesoma_sp."}
GROUP_TYPOS = {"Cop  eggs": "Cop eggs"}
# Group labels that cannot be told apart over the whole series.
STABLE_LABELS = {
    "Diaptomidae.immature": "othercala",
    "Temoridae.immature": "othercala",
    "Eub.Coreg": "Bosminidae",
    "Bo.Longer": "Bosminidae",
}
# Taxa listed under a wrong long-term name, and that name.
RENAMED_TAXA = {
    "E_phaleratus_eggs": "Ectocyclops",
    "E_phaleratus_w_eggs": "Ectocyclops",
    "E_phaleratus_wo_eggs": "Ectocyclops",
}
# Order groups of the basin-wide matrix, predators shown by name, groups left out.
ROTIFER_ORDERS = ("Collothecaceae", "Ploima", "Flosculariaceae", "Rotifera spp.")
ODD_COPEPODS = ("Poecilostomatoida", "Harpacticoida", "Arguloida")
PREDATORS = {
    "Bythotrephes longimanus": "Bythotrephes longimanus",
    "Cercopagis pengoi": "Cercopagis pengoi",
    "Leptodora kindti": "Leptodora kindti",
    "Leptodora kindti immature": "Leptodora kindti",
}
LEFT_OUT_GROUPS = ("CopepodOther_Nauplii", "CopepodOther_YO", "Cercopagis pengoi_YO", "Bythotrephes longimanus_YO")
# The three orders of crustacean totals, and labels of their immatures.
CRUSTACEAN_ORDERS = ("Calanoida", "Cladocera", "Cyclopoida")
IMMATURE_LABELS = ("Calanoida spp. nauplii", "Cyclopoida spp. nauplii", "Calanoida spp.", "Cyclopoida spp.")
# Size groups by taxon-name pattern, genus and order; first match wins.
SIZE_BY_NAME = {
    "Ceriodaphnia": "Ceriodaphnia",
    "Chydorids": "Chydorids",
    "B_longirostris": "Bosmina",
    "B_coregoni": "Eubosmina",
}
SIZE_GENERA = ("Daphnia", "Diaphanosoma", "Leptodora")
SIZE_ROTIFER_ORDERS = ("Ploima", "Rotifera spp.")
ENVIRONMENT = ("Latitude", "Longitude", "Secchi_depth_m", "Surface_temp", "Bottom_temp", "Surface_DO", "Bottom_DO")


def reassign_immatures(df: DataFrame, rules: Sequence[tuple[str, str, str]] = IMMATURE_RULES) -> DataFrame:
    """Pool the young of an order under one taxon name.

    A young individual of unknown order gets an unknown taxon; one that is not young keeps its own.
    """
    conds = [((F.col("Order1") == order) & (F.col("Life_stage") == stage), name) for order, stage, name in rules]
    return reassign(df, TAXON, conds)


def with_collapsed_stage(df: DataFrame, *, into: str = "Life_stage2") -> DataFrame:
    return df.withColumn(into, collapse_stage("Life_stage"))


def stable_labels(df: DataFrame, column: str = "biop_152_names", *, into: str = "biop_152_names95toPres", changes: Mapping[str, str] = STABLE_LABELS) -> DataFrame:
    """Add a group label that means the same thing in every year."""
    return recode_values(df, column, changes, into=into)


def rename_taxa(df: DataFrame, column: str = "Genus_sp_95toPresent", *, changes: Mapping[str, str] = RENAMED_TAXA) -> DataFrame:
    """Give listed taxa their long-term name, leave all other names alone."""
    out = F.col(column)
    for taxon, name in changes.items():
        out = F.when(F.col(TAXON) == taxon, name).otherwise(out)
    return df.withColumn(column, out)


def major_group(df: DataFrame, *, into: str = "MajorTaxaGroup") -> DataFrame:
    """Rotifers and odd copepods pooled, big predators by name, other orders as they are."""
    order = (
        F.when(is_member("Order1", ROTIFER_ORDERS), "Rotifers")
        .when(is_member("Order1", ODD_COPEPODS), "CopepodOther")
        .otherwise(F.col("Order1"))
    )
    name = F.col("Genus_sp_95toPresent")
    for species, label in PREDATORS.items():
        order = if_else(name == species, label, order)
    return df.withColumn(into, order)


def major_group_totals(df: DataFrame, keys: Sequence[str], measure: str = "Zoop_biomass", *, exclude: Sequence[str] = LEFT_OUT_GROUPS, into: str = "MajorTaxaGroup3") -> DataFrame:
    """Sums per sample and group-with-stage, untrusted groups dropped."""
    grouped = major_group(df, into="__group")
    summed = sum_zero_empty(grouped, [*keys, "__group", "Life_stage2"], [measure])
    labelled = summed.withColumn(into, paste("__group", "Life_stage2")).drop("__group", "Life_stage2")
    return drop_members(labelled, into, exclude)


def size_group_major(df: DataFrame, *, into: str = "Group") -> DataFrame:
    pooled = if_else(F.col("Order1").isin(*SIZE_ROTIFER_ORDERS), "Rotifer", F.col("Order1"))
    return df.withColumn(into, F.when(matches(TAXON, "B_longimanus"), "Bythotrephes").otherwise(pooled))


def size_group_minor(df: DataFrame, *, into: str = "Group") -> DataFrame:
    """First of: name pattern, Daphnia or Diaphanosoma, rotifer order, Leptodora, remaining rotifers.

    Once the chain meets an unknown genus or order it stays unknown.
    """
    genus, order = F.col("Genus"), F.col("Order1")
    daphnia, diaphanosoma, leptodora = SIZE_GENERA
    first_order, second_order = SIZE_ROTIFER_ORDERS
    out = if_else(order == second_order, "Rotifer", "OTHER")
    out = if_else(genus == leptodora, leptodora, out)
    out = if_else(order == first_order, "Rotifer", out)
    out = if_else(genus == diaphanosoma, diaphanosoma, out)
    out = if_else(genus == daphnia, daphnia, out)
    for pattern, label in reversed(SIZE_BY_NAME.items()):
        out = F.when(matches(TAXON, pattern), label).otherwise(out)
    return df.withColumn(into, out)


def size_groups(masses: DataFrame, *, measure: str = "ZoopMeanBiomass", sample: str = "Sample_ID") -> DataFrame:
    """Mean individual mass, averaged per sample and then over samples: total, major, minor groups."""
    total = two_level_mean(masses, [sample], [], measure).withColumns({
        "Group": F.lit("Total Zooplankton"), "GroupCat": F.lit("TotZP")})
    major = two_level_mean(size_group_major(masses), [sample], ["Group"], measure)
    major = major.filter(F.col("Group") != "Poecilostomatoida").withColumn("GroupCat", F.lit("MajorGroup"))
    minor = two_level_mean(size_group_minor(masses), [sample], ["Group"], measure)
    minor = minor.filter(F.col("Group") != "OTHER").withColumn("GroupCat", F.lit("MinorGroup"))
    return stack_frames(total, major, minor).select("Group", measure, "GroupCat")


def basin_of_site(df: DataFrame, western: Sequence[str], *, site: str = "Sample_site", into: str = "Basin", names: tuple[str, str] = ("Western basin", "Central basin")) -> DataFrame:
    """Display name of the basin; a site that is not listed, or unknown, counts as central."""
    return df.withColumn(into, F.when(is_member(site, western), names[0]).otherwise(names[1]))


def year_offset(df: DataFrame, offsets: Mapping[int, float], *, year: str = "Year", month: str = "M", into: str = "Mn") -> DataFrame:
    """Month number plus a small shift per year, for side-by-side series; other years get null."""
    shift = F.lit(None).cast("double")
    for y, step in offsets.items():
        shift = F.when(F.col(year) == y, F.lit(float(step))).otherwise(shift)
    return df.withColumn(into, F.col(month).cast("double") + shift)


def counter_period_class(df: DataFrame, named: Sequence[str], lead: str, split: date, *, counter: str = "Counter_name", day: str = "Sample_date") -> DataFrame:
    """Counter by name or ``other``; lead counter or not; before or after a date."""
    who = if_else(F.col(counter).isin(list(named)), F.col(counter), "other")
    df = df.withColumn("Counter_name2", who)
    return df.withColumns({
        "Counter_name3": if_else(F.col("Counter_name2") == lead, lead, "Other Counter"),
        "Period": if_else(F.col(day) > F.lit(split), f"After{split.year}", f"Before{split.year}"),
    })


def order_subset_total(
    df: DataFrame, keys: Sequence[str], *, orders: Sequence[str] = CRUSTACEAN_ORDERS, exclude: Sequence[str] = (),
    measure: str = "Zoop_density", day: str = "Sample_date",
) -> DataFrame:
    """Sum over chosen orders per sample, with year and day of year; some labels may be left out."""
    kept = keep_members(df, "Order1", orders)
    if exclude:
        kept = drop_members(kept, "Genus_sp_95toPresent", exclude)
    return derive_date_parts(sum_zero_empty(kept, keys, [measure]), day, {"DOY": "day_of_year", "Y": "year"})


def crustacean_total(df: DataFrame, keys: Sequence[str], *, measure: str = "Zoop_biomass", orders: Sequence[str] = CRUSTACEAN_ORDERS, into: str = "TotCopCladBM") -> DataFrame:
    """One column per order and their sum, which is null when an order is absent."""
    wide = pivot_groups(keep_members(df, "Order1", orders), keys, "Order1", measure, orders)
    total = F.col(orders[0])
    for o in orders[1:]:
        total = total + F.col(o)
    return wide.withColumn(into, total)


def season_mean(df: DataFrame, keys: Sequence[str], months: Sequence[str], measure: str, *, month: str = "M") -> DataFrame:
    """Mean over the listed months."""
    return mean_of(keep_members(df, month, months), keys, [measure])


def env_monthly(inventory: DataFrame, columns: Sequence[str] = ENVIRONMENT) -> DataFrame:
    """Month by site means of the environment readings."""
    return monthly_rollup(inventory, "Sample_date", ["Sample_site"], columns, agg="mean")
