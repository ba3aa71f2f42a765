"""Life stages, volumes, densities, rates, reconciliation and harmonized groups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.basic import SITES_8
from catalog.registry import lit_list, query, snap, snap_sql as S, snapped
from lakesurvey.operators import datasheet as ds
from lakesurvey.operators import harmonize as hz
from lakesurvey.operators import quality as qa
from lakesurvey.operators import rates
from lakesurvey.operators.aggregates import group_count
from lakesurvey.operators.cleaning import derive_date_parts
from lakesurvey.operators.joins import enrich_taxa, left_join, name_missing, unname_missing
from lakesurvey.schemas import HEADER
from lakesurvey.session import stored_bytes

TAXON = "Genus_sp_lifestage"
# Bytes of stored line items to a task of rows sent to their sample: some 250,000 rows.
SAMPLE_BYTES = 1 << 22

# --- SQL fragments of the datasheet path, written against the sheets and cutoffs views -----------

STAGE0 = f"""CASE WHEN contains({TAXON}, '_eggs') AND NOT contains({TAXON}, '_w') THEN 'Egg' WHEN contains({TAXON}, 'nauplii') THEN 'Nauplii'
  WHEN contains({TAXON}, 'veliger') THEN 'Veliger' ELSE 'Other' END"""
BY_NAME = f"regexp_matches({TAXON}, 'immature|unclass')"

HEADERS = "headers AS (SELECT source_file, " + ", ".join(
    f"MAX(CASE WHEN Information = '{f.name}' THEN "
    + {"string": "Value", "date": "CAST(TRY_STRPTIME(Value, '%Y%m%d') AS DATE)", "double": "TRY_CAST(Value AS DOUBLE)"}[f.dataType.typeName()]
    + f" END) AS {f.name}" for f in HEADER
) + " FROM sheets GROUP BY source_file)"

LENGTHS = f"""
cells AS (UNPIVOT (SELECT source_file, Sample_ID, {TAXON}, COLUMNS('^L[0-9]+$') FROM sheets) ON COLUMNS('^L[0-9]+$') INTO NAME Measured_number VALUE Length_text),
scaled AS (SELECT c.source_file, c.Sample_ID, c.{TAXON}, Measured_number, CAST(Length_text AS DOUBLE) AS Length_OU,
  CAST(Length_text AS DOUBLE) * h.mm_per_ocular_unit AS Length_mm, k.Length_cutoff
  FROM cells c JOIN headers h ON c.source_file = h.source_file LEFT JOIN cutoffs k ON c.{TAXON} = k.{TAXON}),
staged AS (SELECT *, {STAGE0} AS stage0 FROM scaled),
all_lengths AS (SELECT source_file, Sample_ID, {TAXON}, Measured_number, Length_OU, Length_mm, stage0, Length_cutoff,
  CASE WHEN {BY_NAME} THEN 'Younger' WHEN Length_cutoff IS NULL THEN CASE WHEN stage0 = 'Other' THEN 'Older' ELSE stage0 END
    WHEN Length_mm < Length_cutoff THEN 'Younger' ELSE 'Older' END AS Life_stage FROM staged)"""

SHARES = f"""
shares AS (SELECT source_file, {TAXON}, CASE WHEN {BY_NAME} THEN 0.0::DOUBLE ELSE SUM(CASE WHEN Length_mm >= COALESCE(Length_cutoff, 0) THEN 1 ELSE 0 END)::DOUBLE / COUNT(*) END AS Prop_O
  FROM all_lengths WHERE stage0 = 'Other' GROUP BY 1, 2)"""

COUNTS = f"""
raw_counts AS (SELECT s.source_file, s.Sample_ID, s.{TAXON}, COALESCE(CAST(Number_counted AS DOUBLE), 0) AS n, Prop_O,
  s.{TAXON} IN (SELECT {TAXON} FROM cutoffs) AS listed FROM sheets s LEFT JOIN shares p ON s.source_file = p.source_file AND s.{TAXON} = p.{TAXON}),
split AS (SELECT *, {STAGE0} AS stage0, CASE WHEN {BY_NAME} THEN 0 ELSE COALESCE(round_even(n * Prop_O, 0), 0) END AS older,
  CASE WHEN {BY_NAME} THEN n ELSE COALESCE(round_even(n * (1 - Prop_O), 0), 0) END AS younger,
  listed OR {BY_NAME} AS to_young, listed OR contains({TAXON}, 'adult') AS to_old FROM raw_counts),
expanded AS (
  SELECT source_file, Sample_ID, {TAXON}, 'Younger' AS Life_stage, younger AS Number_counted FROM split WHERE to_young
  UNION SELECT source_file, Sample_ID, {TAXON}, 'Older', older FROM split WHERE to_old
  UNION SELECT source_file, Sample_ID, {TAXON}, CASE WHEN stage0 = 'Other' THEN 'Older' ELSE stage0 END, n FROM split WHERE NOT to_young AND NOT to_old),
counts AS (SELECT e.*, round_even(Number_counted * Diluted_vol_mL / NULLIF(Subsampled_vol_mL * (PI() * POWER(Net_diameter_m, 2) / 4 * ((Meter_2 - Meter_1) * 26873 / 999999) * 1000), 0), 10) AS Zoop_density
  FROM expanded e JOIN headers h ON e.source_file = h.source_file)"""

PATH = f"WITH {HEADERS}, {LENGTHS}, {SHARES}, {COUNTS}"


def _headers(t):
    return ds.sheet_headers(t.sheets)


@query("d1_initial_life_stage", f"SELECT {TAXON}, {STAGE0} AS Life_stage, COUNT(*) AS n FROM sheets GROUP BY 1, 2")
def _(t):
    return group_count(ds.initial_life_stage(t.sheets.select(TAXON)), TAXON, "Life_stage")


@query("d2_length_to_mm", f"WITH {HEADERS}, {LENGTHS} SELECT source_file, {TAXON}, COUNT(*) AS n, {S('SUM(Length_mm)', 'total_mm')}, {S('MAX(Length_mm)', 'max_mm')} FROM all_lengths GROUP BY 1, 2")
def _(t):
    rows = ds.sheet_lengths(t.sheets, _headers(t), t.in_use("cutoffs"))
    return snapped(rows.groupBy("source_file", TAXON).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Length_mm").alias("total_mm"), F.max("Length_mm").alias("max_mm")))


@query("d3_stage_by_length", f"WITH {HEADERS}, {LENGTHS} SELECT source_file, Life_stage, COUNT(*) AS n, {S('SUM(Length_mm)', 'total_mm')} FROM all_lengths GROUP BY 1, 2")
def _(t):
    rows = ds.sheet_lengths(t.sheets, _headers(t), t.in_use("cutoffs"))
    return snapped(rows.groupBy("source_file", "Life_stage").agg(F.count(F.lit(1)).alias("n"), F.sum("Length_mm").alias("total_mm")))


@query("d4_stage_proportions", f"""
WITH {HEADERS}, {LENGTHS}, {SHARES}
SELECT s.source_file, s.{TAXON}, {S('Prop_O')}, {S('1 - Prop_O', 'Prop_Y')} FROM (SELECT DISTINCT source_file, {TAXON} FROM sheets WHERE {STAGE0} = 'Other') s
LEFT JOIN shares p ON s.source_file = p.source_file AND s.{TAXON} = p.{TAXON}
""")
def _(t):
    return snapped(ds.stage_proportions(t.sheets, _headers(t), t.in_use("cutoffs")))


@query("d5_allocate_counts", f"""
{PATH} SELECT source_file, {TAXON}, n AS Number_counted, older AS older_count, younger AS younger_count FROM split WHERE stage0 = 'Other'
""")
def _(t):
    shares = ds.stage_proportions(t.sheets, _headers(t), t.in_use("cutoffs"))
    rows = ds.allocate_counts(ds.sheet_counts(t.sheets), shares).filter("Life_stage = 'Other'")
    return rows.select("source_file", TAXON, "Number_counted", "older_count", "younger_count")


@query("d6_expand_stage_rows", f"{PATH} SELECT source_file, {TAXON}, Life_stage, Number_counted FROM expanded")
def _(t):
    shares = ds.stage_proportions(t.sheets, _headers(t), t.in_use("cutoffs"))
    rows = ds.expand_stage_rows(ds.allocate_counts(ds.sheet_counts(t.sheets), shares), t.in_use("cutoffs"))
    return rows.select("source_file", TAXON, "Life_stage", "Number_counted")


@query("d7_sampled_volume", f"""
SELECT Sample_ID, {S('PI() * POWER(Net_diameter_m, 2) / 4 * ((Meter_2 - Meter_1) * 26873 / 999999)', 'Vol_sampled_m3')}, {S('(Meter_2 - Meter_1) * 5.2765', 'Vol_sampled_L2')} FROM inventory
""")
def _(t):
    rows = ds.sampled_volume_litres(ds.sampled_volume(t.inventory))
    return rows.select("Sample_ID", snap("Vol_sampled_m3"), snap("Vol_sampled_L2"))


@query("d8_count_to_density", f"""
SELECT f.Sample_ID, f.{TAXON}, {S('Number_counted * Diluted_vol_mL / NULLIF(Subsampled_vol_mL * ((Meter_2 - Meter_1) * 5.2765), 0)', 'density')}
FROM zoop_final f LEFT JOIN sample_info s ON f.Sample_ID = s.Sample_ID
""")
def _(t):
    samples = ds.sampled_volume_litres(t.sample_info).select("Sample_ID", "Diluted_vol_mL", "Subsampled_vol_mL", "Vol_sampled_L2")
    rows = left_join(t.zoop_final.select("Sample_ID", TAXON, "Number_counted"), samples, "Sample_ID", null_keys=False)
    return snapped(ds.count_to_density(rows, volume="Vol_sampled_L2", into="density").select("Sample_ID", TAXON, "density"))


@query("d9_split_eggs", f"""
WITH {HEADERS}, {LENGTHS}
SELECT source_file, COUNT(*) FILTER (Life_stage <> 'Egg') AS n_lengths, COUNT(*) FILTER (Life_stage = 'Egg') AS n_egg_rows,
  {S("COALESCE(SUM(Length_OU) FILTER (Life_stage = 'Egg'), 0)", 'eggs')} FROM all_lengths GROUP BY 1
""")
def _(t):
    lengths, eggs = ds.split_eggs(ds.sheet_lengths(t.sheets, _headers(t), t.in_use("cutoffs")), by_name=True)
    both = lengths.select("source_file", F.lit(1).alias("l"), F.lit(0).alias("e"), F.lit(0.0).alias("eggs")).unionByName(
        eggs.select("source_file", F.lit(0).alias("l"), F.lit(1).alias("e"), F.col("Number_eggs").alias("eggs")))
    return snapped(both.groupBy("source_file").agg(F.sum("l").alias("n_lengths"), F.sum("e").alias("n_egg_rows"), F.sum("eggs").alias("eggs")))


INDIVIDUALS = f"""
individuals AS (SELECT l.Sample_ID, l.{TAXON}, l.Life_stage, Length_mm, Biom_a * POWER(Length_mm, Biom_b) AS Ind_biomass,
  0.022387 * POWER(Biom_a * POWER(Length_mm, Biom_b), 0.54) AS PE, 0.041686938 * POWER(Biom_a * POWER(Length_mm, Biom_b), 0.67) AS NE,
  CASE WHEN l.{TAXON} = 'T21_veligers' THEN -0.0602 + 0.714 * Length_mm ELSE FR1_a * POWER(Length_mm, FR1_b) END AS FR1
  FROM zoop_lengths l LEFT JOIN taxa_groups g ON l.{TAXON} = g.{TAXON} AND l.Life_stage = g.Life_stage)"""
MEANS = f"""
means AS (SELECT Sample_ID, {TAXON}, Life_stage, AVG(Ind_biomass) AS mean_mass, """ + ", ".join(
    f"CASE WHEN COUNT({c}) = COUNT(*) THEN AVG({c}) END AS mean_{c}" for c in ("PE", "NE", "FR1")
) + f", AVG(Length_mm) AS mean_length FROM individuals GROUP BY 1, 2, 3)"
VELIGER = "T21_veligers"


@query("d10_individual_rates", f"WITH {INDIVIDUALS} SELECT Sample_ID, {TAXON}, Life_stage, {S('Length_mm')}, {S('Ind_biomass')}, {S('PE')}, {S('NE')}, {S('FR1')} FROM individuals")
def _(t):
    rows = rates.individual_rates(t.zoop_lengths, t.taxa_groups, veliger_taxon=VELIGER)
    return snapped(rows.drop("Measured_number"))


def _by_sample(t, rows):
    """Rows of the line items sent to their sample, to a task for each few MB of them; taxa and stages have a name where they are missing.

    A sample's taxon has a few lengths, mostly one: grouping them before they are sent would fill the memory of the tasks that read them and save
    nothing. A task groups and sorts its share in memory, so their number grows with the rows; with fewer than the session's
    partitions, joins would send the rows once more.
    """
    rows, stored = name_missing(rows, rates.TAXON_STAGE), stored_bytes(t.spark, t.path("lineitem"))
    if stored <= SAMPLE_BYTES * t.spark.sparkContext.defaultParallelism:
        return rows.repartition("Sample_ID")
    return rows.repartition(max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // SAMPLE_BYTES)), "Sample_ID")


def _stage_means(t):
    lengths = _by_sample(t, t.zoop_lengths.select("Sample_ID", *rates.TAXON_STAGE, "Length_mm"))
    return rates.stage_means(rates.individual_rates(lengths, _named_taxa(t), veliger_taxon=VELIGER, null_keys=False), ["Sample_ID"])


def _named_taxa(t):
    return name_missing(t.taxa_groups, rates.TAXON_STAGE)


@query("d11_stage_means", f"WITH {INDIVIDUALS}, {MEANS} SELECT Sample_ID, {TAXON}, Life_stage, " + ", ".join(
    S(c) for c in ("mean_mass", "mean_PE", "mean_NE", "mean_FR1", "mean_length")) + " FROM means")
def _(t):
    return snapped(unname_missing(_stage_means(t), rates.TAXON_STAGE))


VOLUMETRIC = f"""
WITH {INDIVIDUALS}, {MEANS},
b AS (SELECT f.Sample_ID, f.{TAXON}, f.Life_stage, f.Zoop_density AS d, m.*, g.Pr_alpha, g.Pr_beta, g.Pr_rho, s.Surface_temp,
  COALESCE(CASE WHEN g.Biom_dens IS NOT NULL THEN f.Zoop_density * g.Biom_dens ELSE COALESCE(m.mean_mass, 0) * f.Zoop_density END, 0) AS mass
  FROM zoop_final f LEFT JOIN sample_info s ON f.Sample_ID = s.Sample_ID
  LEFT JOIN (SELECT Sample_ID AS ms, {TAXON} AS mt, Life_stage AS ml, mean_mass, mean_PE, mean_NE, mean_FR1, mean_length FROM means) m ON f.Sample_ID = m.ms AND f.{TAXON} = m.mt AND f.Life_stage = m.ml
  LEFT JOIN taxa_groups g ON f.{TAXON} = g.{TAXON} AND f.Life_stage = g.Life_stage)
SELECT Sample_ID, {TAXON}, Life_stage, {S("CASE WHEN Life_stage <> 'Egg' THEN d END", 'Zoop_density')}, {S('mass', 'Zoop_biomass')},
  {S('CASE WHEN mass = 0 THEN 0 ELSE mean_PE * d END', 'Zoop_P_exc')}, {S('CASE WHEN mass = 0 THEN 0 ELSE mean_NE * d END', 'Zoop_N_exc')},
  {S('CASE WHEN mass = 0 THEN 0 ELSE mean_FR1 * d END', 'Zoop_FR1')},
  {S('CASE WHEN mass = 0 THEN 0 ELSE Pr_alpha * POWER(mass, Pr_beta) * POWER(Pr_rho, Surface_temp) END', 'Zoop_prod')}, {S('mean_length', 'Zoop_len_avg')} FROM b
"""


@query("d12_volumetric_rates", VOLUMETRIC)
def _(t):
    counts = _by_sample(t, t.zoop_final.select("Sample_ID", *rates.TAXON_STAGE, "Zoop_density"))
    counts = left_join(counts, t.sample_info.select("Sample_ID", "Surface_temp"), "Sample_ID", null_keys=False)
    rows = rates.volumetric_rates(counts, _stage_means(t), _named_taxa(t), ["Sample_ID"], null_keys=False)
    columns = ["Zoop_density", "Zoop_biomass", "Zoop_P_exc", "Zoop_N_exc", "Zoop_FR1", "Zoop_prod", "Zoop_len_avg"]
    return snapped(unname_missing(rows, rates.TAXON_STAGE).select("Sample_ID", TAXON, "Life_stage", *columns))


# --- reconciliation ------------------------------------------------------------------------------

CELL_COUNT = " + ".join(f"(L{j} IS NOT NULL)::INT" for j in range(1, 21))
MEASURED = f"""
measured AS (SELECT s.source_file, s.{TAXON}, CAST({CELL_COUNT} AS INT) AS sheet_measured, COALESCE(n, 0) AS entered_measured FROM sheets s
  LEFT JOIN (SELECT source_file, {TAXON}, COUNT(*) AS n FROM all_lengths WHERE Length_mm > 0.15 GROUP BY 1, 2) l ON s.source_file = l.source_file AND s.{TAXON} = l.{TAXON})"""


def _measured(t):
    # The shortest measurements are held back, so that the check has something to find.
    lengths = ds.sheet_lengths(t.sheets, _headers(t), t.in_use("cutoffs")).filter("Length_mm > 0.15")
    return qa.qa_measured_counts(t.sheets, lengths)


@query("d13_qa_measured_counts", f"""
WITH {HEADERS}, {LENGTHS}, {MEASURED} SELECT source_file, {TAXON}, sheet_measured, entered_measured, sheet_measured - entered_measured AS difference FROM measured
""")
def _(t):
    return _measured(t)


SPECIES = f"""
species AS (SELECT r.source_file, sheet_taxa, COALESCE(final_taxa, 0) AS final_taxa FROM
  (SELECT source_file, COUNT(DISTINCT CASE WHEN Number_counted IS NOT NULL THEN {TAXON} END) AS sheet_taxa FROM sheets GROUP BY 1) r
  LEFT JOIN (SELECT source_file, COUNT(DISTINCT CASE WHEN Number_counted <> 0 THEN {TAXON} END) AS final_taxa FROM expanded GROUP BY 1) f ON r.source_file = f.source_file)"""


def _species(t):
    return qa.qa_species_counts(t.sheets, ds.staged_counts(t.sheets, _headers(t), t.in_use("cutoffs")))


@query("d14_qa_species_counts", f"{PATH}, {SPECIES} SELECT *, sheet_taxa - final_taxa AS difference FROM species")
def _(t):
    return _species(t)


@query("d15_qa_status", f"""
{PATH}, {MEASURED}, {SPECIES}, j AS (SELECT m.source_file, m.d = 0 AS mo, s.sheet_taxa = s.final_taxa AS so
  FROM (SELECT source_file, SUM(sheet_measured - entered_measured) AS d FROM measured GROUP BY 1) m JOIN species s ON m.source_file = s.source_file)
SELECT source_file, mo AND so AS ok, CASE WHEN mo AND so THEN 'Number measured OK. Species counts OK.' WHEN mo THEN 'Species counts NOT OK'
  WHEN so THEN 'Number measured NOT OK' ELSE 'Number measured NOT OK. Species counts NOT OK.' END AS status FROM j
""")
def _(t):
    return qa.qa_status(_measured(t), _species(t))


@query("d6_stage_residuals", f"""
{PATH}, e AS (SELECT source_file, {TAXON}, SUM(n) AS entered FROM raw_counts GROUP BY 1, 2), x AS (SELECT source_file, {TAXON}, SUM(Number_counted) AS staged FROM expanded GROUP BY 1, 2)
SELECT e.source_file, e.{TAXON}, entered, staged, entered - staged AS residual FROM e JOIN x ON e.source_file = x.source_file AND e.{TAXON} = x.{TAXON} WHERE entered <> staged
""")
def _(t):
    return ds.stage_residuals(ds.sheet_counts(t.sheets), ds.staged_counts(t.sheets, _headers(t), t.in_use("cutoffs")))


# Sheets with header faults: an unreadable date, and a temperature entered under another name.
_FAULTY = """
f AS (SELECT source_file, CASE WHEN Information = 'Surface_temp' AND Sample_ID LIKE '%3' THEN 'Depth_m' ELSE Information END AS Information,
  CASE WHEN Information = 'Sample_date' AND Sample_ID LIKE '%7' THEN 'unknown' ELSE Value END AS Value FROM sheets)"""


@query("d15_header_faults", f"""
WITH {_FAULTY},
g AS (SELECT source_file, COUNT(CASE WHEN Information IN ({", ".join(f"'{f.name}'" for f in HEADER)}) THEN 1 END) AS pairs,
  MAX(CASE WHEN Information = 'Sample_date' THEN TRY_STRPTIME(Value, '%Y%m%d') END) AS day,
  CASE WHEN MIN(CASE WHEN Information = 'Depth_m' THEN Value END) < MAX(CASE WHEN Information = 'Depth_m' THEN Value END) THEN 'several values for Depth_m' END AS twice
  FROM f GROUP BY 1)
SELECT source_file, NULLIF(CONCAT_WS('; ', CASE WHEN pairs = 0 THEN 'no header rows' END, twice, CASE WHEN pairs > 0 AND day IS NULL THEN 'no readable Sample_date' END), '') AS faults FROM g
""")
def _(t):
    name = F.when((F.col("Information") == "Surface_temp") & F.col("Sample_ID").like("%3"), "Depth_m").otherwise(F.col("Information"))
    value = F.when((F.col("Information") == "Sample_date") & F.col("Sample_ID").like("%7"), "unknown").otherwise(F.col("Value"))
    return qa.header_faults(t.sheets.select("source_file", name.alias("Information"), value.alias("Value")))


@query("d16_qa_volume_agreement", f"""
SELECT Sample_ID, {S('r', 'V1toV2ratio')}, CASE WHEN r <= 0.99 OR r >= 1.01 THEN 'dif' WHEN r IS NOT NULL THEN 'same' END AS V1equalsV2
FROM (SELECT Sample_ID, (Meter_2 - Meter_1) * 5.2765 / NULLIF(Vol_sampled_L, 0) AS r FROM inventory)
""")
def _(t):
    rows = qa.qa_volume_agreement(ds.sampled_volume_litres(t.inventory))
    return snapped(rows.select("Sample_ID", "V1toV2ratio", "V1equalsV2"))


DISCREPANT = """
SELECT f.Sample_ID, f.Genus_sp_lifestage, Number_counted * Diluted_vol_mL / NULLIF(Subsampled_vol_mL * ((Meter_2 - Meter_1) * 5.2765), 0) - Zoop_density AS diff
FROM zoop_final f LEFT JOIN sample_info s ON f.Sample_ID = s.Sample_ID
"""


def _discrepant(t):
    samples = ds.sampled_volume_litres(t.sample_info).select("Sample_ID", "Diluted_vol_mL", "Subsampled_vol_mL", "Vol_sampled_L2")
    rows = left_join(t.zoop_final.select("Sample_ID", TAXON, "Number_counted", "Zoop_density"), samples, "Sample_ID", null_keys=False)
    return qa.qa_density_discrepancy(ds.count_to_density(rows, volume="Vol_sampled_L2", into="again"), recomputed="again")


@query("d17_qa_density_discrepancy", f"SELECT Sample_ID, {TAXON}, {S('diff', 'density_diff')} FROM ({DISCREPANT}) WHERE ABS(diff) > 0.1")
def _(t):
    return snapped(_discrepant(t).select("Sample_ID", TAXON, "density_diff"))


@query("d17_discrepant_samples", f"SELECT Sample_ID, CASE WHEN diff > 0 THEN 'above' ELSE 'below' END AS direction, COUNT(*) AS n FROM ({DISCREPANT}) WHERE ABS(diff) > 0.1 GROUP BY 1, 2")
def _(t):
    return qa.discrepant_samples(_discrepant(t))


# --- harmonized groups ---------------------------------------------------------------------------

WITH_TAXA = f"""
f AS (SELECT z.*, x.Order1, x.Genus_sp_95toPresent, x.Genus, x.biop_152_names FROM zoop_final z LEFT JOIN
  (SELECT DISTINCT {TAXON}, Order1, Genus_sp_95toPresent, Genus, biop_152_names FROM taxa_groups) x ON z.{TAXON} = x.{TAXON})"""
POOLED = f"""CASE WHEN Life_stage = 'Younger' AND Order1 IS NULL THEN NULL WHEN Life_stage = 'Younger' AND Order1 = 'Calanoida' THEN 'Calanoida_immature'
  WHEN Life_stage = 'Younger' AND Order1 = 'Cyclopoida' THEN 'Cyclopidae_immature' ELSE {TAXON} END"""


def _with_taxa(t):
    return enrich_taxa(t.zoop_final, t.taxa_groups, ["Order1", "Genus_sp_95toPresent", "Genus", "biop_152_names"])


@query("d18_reassign_immatures", f"WITH {WITH_TAXA} SELECT Sample_ID, Life_stage, Order1, {POOLED} AS {TAXON} FROM f")
def _(t):
    return hz.reassign_immatures(_with_taxa(t)).select("Sample_ID", "Life_stage", "Order1", TAXON)


@query("d19_collapse_life_stage", "SELECT Life_stage, CASE WHEN Life_stage IN ('Older', 'Younger') THEN 'YO' ELSE Life_stage END AS Life_stage2, COUNT(*) AS n FROM zoop_final GROUP BY 1, 2")
def _(t):
    return group_count(hz.with_collapsed_stage(t.zoop_final), "Life_stage", "Life_stage2")


MAJOR = """CASE WHEN Genus_sp_95toPresent IS NULL THEN NULL WHEN Genus_sp_95toPresent IN ('Bythotrephes longimanus', 'Cercopagis pengoi', 'Leptodora kindti') THEN Genus_sp_95toPresent
  WHEN Genus_sp_95toPresent = 'Leptodora kindti immature' THEN 'Leptodora kindti'
  WHEN Order1 IN ('Collothecaceae', 'Ploima', 'Flosculariaceae', 'Rotifera spp.') THEN 'Rotifers' WHEN Order1 IN ('Poecilostomatoida', 'Harpacticoida', 'Arguloida') THEN 'CopepodOther' ELSE Order1 END"""
STAGE2 = "CASE WHEN Life_stage IN ('Older', 'Younger') THEN 'YO' ELSE Life_stage END"


@query("d20_major_group", f"""
WITH {WITH_TAXA}, g AS (SELECT Sample_ID, COALESCE({MAJOR}, 'NA') || '_' || {STAGE2} AS grp, Zoop_biomass FROM f)
SELECT Sample_ID, grp AS MajorTaxaGroup3, {S('COALESCE(SUM(Zoop_biomass), 0)', 'Zoop_biomass')} FROM g
WHERE grp NOT IN ('CopepodOther_Nauplii', 'CopepodOther_YO', 'Cercopagis pengoi_YO', 'Bythotrephes longimanus_YO') GROUP BY 1, 2
""")
def _(t):
    return snapped(hz.major_group_totals(hz.with_collapsed_stage(_with_taxa(t)), ["Sample_ID"]))


MASSES = f"masses AS (SELECT Sample_ID, {TAXON}, Order1, Genus, Zoop_biomass / NULLIF(Zoop_density, 0) AS m FROM f WHERE Zoop_biomass / NULLIF(Zoop_density, 0) > 0)"
SIZE_MAJOR = f"CASE WHEN contains({TAXON}, 'B_longimanus') THEN 'Bythotrephes' WHEN Order1 IN ('Ploima', 'Rotifera spp.') THEN 'Rotifer' ELSE Order1 END"
SIZE_MINOR = f"""CASE WHEN contains({TAXON}, 'Ceriodaphnia') THEN 'Ceriodaphnia' WHEN contains({TAXON}, 'Chydorids') THEN 'Chydorids' WHEN contains({TAXON}, 'B_longirostris') THEN 'Bosmina'
  WHEN contains({TAXON}, 'B_coregoni') THEN 'Eubosmina' WHEN Genus IS NULL THEN NULL WHEN Genus IN ('Daphnia', 'Diaphanosoma') THEN Genus WHEN Order1 IS NULL THEN NULL
  WHEN Order1 = 'Ploima' THEN 'Rotifer' WHEN Genus = 'Leptodora' THEN 'Leptodora' WHEN Order1 = 'Rotifera spp.' THEN 'Rotifer' ELSE 'OTHER' END"""
SIZE_TABLE = f"""
SELECT 'Total Zooplankton' AS "Group", {S('AVG(m)', 'ZoopMeanBiomass')}, 'TotZP' AS GroupCat FROM (SELECT Sample_ID, AVG(m) AS m FROM masses GROUP BY 1)
UNION ALL SELECT g, {S('AVG(m)', 'ZoopMeanBiomass')}, 'MajorGroup' FROM (SELECT Sample_ID, {SIZE_MAJOR} AS g, AVG(m) AS m FROM masses GROUP BY 1, 2) WHERE g <> 'Poecilostomatoida' GROUP BY g
UNION ALL SELECT g, {S('AVG(m)', 'ZoopMeanBiomass')}, 'MinorGroup' FROM (SELECT Sample_ID, {SIZE_MINOR} AS g, AVG(m) AS m FROM masses GROUP BY 1, 2) WHERE g <> 'OTHER' GROUP BY g
"""


@query("d21_size_groups", f"WITH {WITH_TAXA}, {MASSES} {SIZE_TABLE}")
def _(t):
    return snapped(hz.size_groups(rates.mean_individual_mass(_with_taxa(t))))


@query("d22_mean_individual_mass", f"WITH {WITH_TAXA}, {MASSES} SELECT Sample_ID, {TAXON}, {S('m', 'ZoopMeanBiomass')} FROM masses")
def _(t):
    return snapped(rates.mean_individual_mass(t.zoop_final).select("Sample_ID", TAXON, "ZoopMeanBiomass"))


@query("d23_stable_labels", f"""
SELECT DISTINCT {TAXON}, biop_152_names, CASE WHEN biop_152_names IN ('Diaptomidae.immature', 'Temoridae.immature') THEN 'othercala'
  WHEN biop_152_names IN ('Eub.Coreg', 'Bo.Longer') THEN 'Bosminidae' ELSE biop_152_names END AS biop_152_names95toPres,
  CASE WHEN {TAXON} IN ('T10_eggs', 'T16_wo_eggs') THEN 'Ectocyclops' ELSE Genus_sp_95toPresent END AS Genus_sp_95toPresent FROM taxa_groups
""")
def _(t):
    rows = hz.rename_taxa(hz.stable_labels(t.taxa_groups), changes={"T10_eggs": "Ectocyclops", "T16_wo_eggs": "Ectocyclops"})
    return rows.select(TAXON, "biop_152_names", "biop_152_names95toPres", "Genus_sp_95toPresent").distinct()


@query("d24_basin_of_site", f"SELECT Sample_ID, CASE WHEN Sample_site IN {lit_list(SITES_8)} THEN 'Western basin' ELSE 'Central basin' END AS Basin FROM sample_info")
def _(t):
    return hz.basin_of_site(t.sample_info, SITES_8).select("Sample_ID", "Basin")


@query("d25_year_offset", f"""
SELECT Sample_ID, {S('CASE year(Sample_date) WHEN 1998 THEN month(Sample_date) WHEN 1999 THEN month(Sample_date) + 0.1 WHEN 2000 THEN month(Sample_date) + 0.2 END', 'Mn')} FROM sample_info
""")
def _(t):
    rows = derive_date_parts(t.sample_info, "Sample_date", {"Year": "year", "M": "month_text"})
    return snapped(hz.year_offset(rows, {1998: 0.0, 1999: 0.1, 2000: 0.2}).select("Sample_ID", "Mn"))


COUNTER_CLASS = """CASE WHEN Counter_name IS NULL THEN NULL WHEN Counter_name IN ('AA', 'BB', 'CC') THEN Counter_name ELSE 'other' END AS Counter_name2,
  CASE WHEN Counter_name IS NULL THEN NULL WHEN Counter_name = 'AA' THEN 'AA' ELSE 'Other Counter' END AS Counter_name3,
  CASE WHEN Sample_date > DATE '1998-01-01' THEN 'After1998' ELSE 'Before1998' END AS Period"""


@query("d26_counter_period_class", f"SELECT Sample_ID, {COUNTER_CLASS} FROM sample_info")
def _(t):
    rows = hz.counter_period_class(t.sample_info, ["AA", "BB", "CC"], "AA", date(1998, 1, 1))
    return rows.select("Sample_ID", "Counter_name2", "Counter_name3", "Period")


@query("d27_order_subset_total", f"""
WITH {WITH_TAXA} SELECT f.Sample_ID, s.Sample_date, {S('COALESCE(SUM(Zoop_density), 0)', 'Zoop_density')}, CAST(dayofyear(s.Sample_date) AS INT) AS DOY, CAST(year(s.Sample_date) AS INT) AS Y
FROM f JOIN sample_info s ON f.Sample_ID = s.Sample_ID WHERE Order1 IN ('Calanoida', 'Cyclopoida', 'Cladocera')
  AND NOT COALESCE(Genus_sp_95toPresent IN ('Calanoida spp. nauplii', 'Cyclopoida spp. nauplii', 'Calanoida spp.', 'Cyclopoida spp.'), FALSE) GROUP BY 1, 2
""")
def _(t):
    rows = _with_taxa(t).join(t.sample_info.select("Sample_ID", "Sample_date"), "Sample_ID")
    return snapped(hz.order_subset_total(rows, ["Sample_ID", "Sample_date"], exclude=hz.IMMATURE_LABELS))


@query("d28_crustacean_total", f"""
WITH {WITH_TAXA}, w AS (SELECT Sample_ID, SUM(CASE WHEN Order1 = 'Calanoida' THEN Zoop_biomass END) AS a, SUM(CASE WHEN Order1 = 'Cladocera' THEN Zoop_biomass END) AS b,
  SUM(CASE WHEN Order1 = 'Cyclopoida' THEN Zoop_biomass END) AS c FROM f WHERE Order1 IN ('Calanoida', 'Cladocera', 'Cyclopoida') GROUP BY 1)
SELECT Sample_ID, {S('a', 'Calanoida')}, {S('b', 'Cladocera')}, {S('c', 'Cyclopoida')}, {S('a + b + c', 'TotCopCladBM')} FROM w
""")
def _(t):
    return snapped(hz.crustacean_total(_with_taxa(t), ["Sample_ID"]))


@query("d29_season_mean", f"""
SELECT CAST(year(Sample_date) AS INT) AS Y, Sample_site, {S('AVG(Surface_temp)', 'Surface_temp')} FROM sample_info WHERE month(Sample_date) IN (7, 8) GROUP BY 1, 2
""")
def _(t):
    rows = derive_date_parts(t.sample_info, "Sample_date", {"Y": "year", "M": "month_text"})
    return snapped(hz.season_mean(rows, ["Y", "Sample_site"], ["07", "08"], "Surface_temp"))


ENV_SQL = "SELECT CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, Sample_site, " + ", ".join(
    f"AVG({c}) AS {c}" for c in hz.ENVIRONMENT) + " FROM inventory GROUP BY 1, 2, 3"


@query("d30_env_monthly", f"SELECT Y, M, Sample_site, {', '.join(S(c) for c in hz.ENVIRONMENT)} FROM ({ENV_SQL})")
def _(t):
    return snapped(hz.env_monthly(t.inventory))
