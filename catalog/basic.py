"""Sources, cleaning, reshaping, joins, aggregates and windows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.registry import lit_list, query, snap, snap_sql as S, snapped
from lakesurvey import schemas
from lakesurvey.functions import blank_to_null, half_even, if_else, matches, mean_skip, parse_date, paste, ratio, round_nearest, to_number
from lakesurvey.operators import aggregates as agg
from lakesurvey.operators import cleaning as clean
from lakesurvey.operators import joins, reshape, windows
from lakesurvey.plans.requests import zoop_taxa_table
from lakesurvey.session import shared_folder
from lakesurvey.sources import (
    append_table, archive_raw, read_dimension, read_table, scan_datasheets, sql_star_query, union_files, write_csv,
)

SITES_4 = ("S1", "S3", "S5", "S7")
SITES_8 = tuple(f"S{i}" for i in range(8))
SITES_18 = tuple(f"S{i}" for i in range(18))

SHEET_TOTALS = """
SELECT Sample_ID, COUNT(*) AS n_rows, COUNT(Information) AS n_pairs, COUNT(Value) AS n_values,
  COUNT(Number_counted) AS n_counted, SUM(CAST(Number_counted AS DOUBLE)) AS counted,
  SUM(CAST(L1 AS DOUBLE)) AS sum_l1, COUNT(L20) AS n_l20
FROM sheets GROUP BY Sample_ID
"""


def _sheet_totals(rows):
    return rows.groupBy("Sample_ID").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Information").alias("n_pairs"), F.count("Value").alias("n_values"),
        F.count("Number_counted").alias("n_counted"), F.sum(to_number("Number_counted")).alias("counted"),
        F.sum(to_number("L1")).alias("sum_l1"), F.count("L20").alias("n_l20"),
    )


# --- sources and sinks ---------------------------------------------------------------------------


@query("s1_scan_datasheets", SHEET_TOTALS)
def _(t):
    path = shared_folder(t.spark, "sheets")
    write_csv(t.sheets.drop("source_file"), path, compressed=True)
    return _sheet_totals(scan_datasheets(t.spark, path, "*.csv.gz"))


# Sheets of three kinds in one folder: as they should be, taxon and count swapped, and without L20 behind a column of another name.
_KIND = "CAST(Sample_ID AS BIGINT) % 3"


@query("s1_scan_by_header", f"""
SELECT Sample_ID, COUNT(*) AS n_rows, COUNT(Information) AS n_pairs, MIN(Genus_sp_lifestage) AS first_taxon, SUM(CAST(Number_counted AS DOUBLE)) AS counted,
  SUM(CAST(L1 AS DOUBLE)) AS sum_l1, COUNT(CASE WHEN {_KIND} <> 2 THEN L20 END) AS n_l20, MAX(CASE WHEN {_KIND} = 2 THEN 'L20' END) AS missing_columns,
  MAX(CASE WHEN {_KIND} = 2 THEN 'Checked by, on' END) AS unknown_columns
FROM sheets GROUP BY Sample_ID
""")
def _(t):
    path = shared_folder(t.spark, "sheets-by-header")
    swapped = ["Information", "Value", "Number_counted", "Sample_ID", "Genus_sp_lifestage", *schemas.LENGTH_CELLS]
    for kind, columns in enumerate((schemas.SHEET.names, swapped, ["Checked by, on", *swapped[:-1]])):
        rows = t.sheets.filter(f"{_KIND} = {kind}").withColumn("Checked by, on", F.lit('"AA", later'))
        write_csv(rows.select(*columns), f"{path}/kind={kind}", compressed=True)
    rows = scan_datasheets(t.spark, path, "*.csv.gz", column_report=True)
    return rows.groupBy("Sample_ID").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("Information").alias("n_pairs"), F.min("Genus_sp_lifestage").alias("first_taxon"),
        F.sum(to_number("Number_counted")).alias("counted"), F.sum(to_number("L1")).alias("sum_l1"), F.count("L20").alias("n_l20"),
        F.max("missing_columns").alias("missing_columns"), F.max("unknown_columns").alias("unknown_columns"),
    )


@query("s2_read_dimension", f"SELECT Genus_sp_lifestage, {S('Length_cutoff')} FROM cutoffs")
def _(t):
    path = shared_folder(t.spark, "cutoffs")
    write_csv(t.cutoffs, path)
    return read_dimension(t.spark, path, schemas.CUTOFFS).select("Genus_sp_lifestage", snap("Length_cutoff"))


@query("s3_read_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    return read_table(t.spark, t.path("orders"), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("s4_sql_star_query", f"""
SELECT f.Sample_ID, s.Sample_date, s.Sample_site, f.Genus_sp_lifestage, f.Life_stage, {S('f.Number_counted', 'Number_counted')},
  {S('f.Zoop_density', 'Zoop_density')}, {S('f.Zoop_biomass', 'Zoop_biomass')}, {S('f.Zoop_len_avg', 'Zoop_len_avg')},
  x.Order1, s.Project, {S('s.Subsampled_vol_mL', 'Subsampled_vol_mL')}, {S('s.Diluted_vol_mL', 'Diluted_vol_mL')}
FROM zoop_final f LEFT JOIN sample_info s ON f.Sample_ID = s.Sample_ID
LEFT JOIN (SELECT DISTINCT Genus_sp_lifestage, Order1 FROM taxa_groups) x ON f.Genus_sp_lifestage = x.Genus_sp_lifestage
WHERE CAST(s.Sample_date AS STRING) LIKE '%1998%' AND s.Project = 'CORE'
""")
def _(t):
    return snapped(sql_star_query(t.zoop_final, t.sample_info, t.taxa_groups, year=1998, project="CORE"))


@query("s5_union_files", f"""
SELECT Sample_ID, CAST(year(Sample_date) AS INT) AS Year, Water_body, {S('Surface_temp')}, {S('CASE WHEN Water_body = $$WB$$ THEN Depth_m END', 'Depth_m')}
FROM sample_info
""")
def _(t):
    base = t.sample_info.select("Sample_ID", F.year("Sample_date").alias("Year"), "Water_body", "Surface_temp", "Depth_m", F.lit(1).alias("X"))
    files = []
    for basin, drop in (("WB", []), ("CB", ["Depth_m"])):
        path = shared_folder(t.spark, f"season-{basin}")
        part = base.filter(F.col("Water_body") == basin).drop(*drop)
        write_csv(part, path)
        files.append(read_dimension(t.spark, path, part.schema))
    return snapped(union_files(files, ["X"]))


@query("s6_write_csv", """
SELECT Sample_ID, COALESCE(Sample_site, 'NA') AS Sample_site, COALESCE(Sample_time, 'NA') AS Sample_time, CAST(Sample_date AS STRING) AS Sample_date
FROM inventory
""")
def _(t):
    path = shared_folder(t.spark, "export")
    columns = ["Sample_ID", "Sample_site", "Sample_time", "Sample_date"]
    write_csv(t.inventory.select(*columns), path)
    return t.spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).csv(path)


@query("s7_append_tables", f"""
SELECT CAST(year(s.Sample_date) AS INT) AS year, f.Life_stage, 2 * COUNT(*) AS n, {S('2 * SUM(f.Number_counted)', 'counted')}
FROM zoop_final f JOIN sample_info s ON f.Sample_ID = s.Sample_ID GROUP BY ALL
""")
def _(t):
    path = shared_folder(t.spark, "counts")
    years = t.sample_info.select("Sample_ID", F.year("Sample_date").alias("year"))
    rows = t.zoop_final.select(*schemas.COUNTS.names).join(years, "Sample_ID")
    for _ in range(2):  # a sheet entered twice is appended twice
        append_table(rows, path, partition="year")
    stored = read_table(t.spark, path)
    return stored.groupBy("year", "Life_stage").agg(F.count(F.lit(1)).alias("n"), snap(F.sum("Number_counted"), "counted"))


@query("s8_archive_raw", SHEET_TOTALS)
def _(t):
    path = shared_folder(t.spark, "raw")
    archive_raw(t.sheets, path)
    return _sheet_totals(read_table(t.spark, path))


@query("s9_distinct_export", """
SELECT Genus_sp_95toPresent, Order1 FROM (SELECT DISTINCT Genus_sp_lifestage, Genus_sp_95toPresent, Order1 FROM taxa_groups)
""")
def _(t):
    return zoop_taxa_table(t.taxa_groups)


# --- projection, filters, repair -----------------------------------------------------------------


@query("p1_select_rename", f"SELECT Sample_ID, Sample_date AS day, Sample_site, Project, {S('Surface_temp', 'TempC')} FROM sample_info")
def _(t):
    kept = clean.select_rename(
        t.sample_info, ("Sample_ID", "Surface_temp"), drop=["Water_body", "Depth_m"],
        rename={"Sample_date": "day", "Surface_temp": "TempC"},
    )
    return snapped(kept)


@query("p2_site_filter", f"SELECT Sample_ID, Sample_site FROM sample_info WHERE Sample_site IN {lit_list(SITES_8)}")
def _(t):
    return clean.keep_members(t.sample_info, "Sample_site", SITES_8).select("Sample_ID", "Sample_site")


@query("p3_not_in_keep_null", f"SELECT Sample_ID, Sample_site FROM sample_info WHERE NOT COALESCE(Sample_site IN {lit_list(SITES_18)}, FALSE)")
def _(t):
    return clean.drop_members(t.sample_info, "Sample_site", SITES_18).select("Sample_ID", "Sample_site")


@query("p4_date_range", """
SELECT Sample_ID, Sample_date FROM inventory
WHERE Sample_date > DATE '1997-06-30' AND Sample_date < DATE '2000-01-01' AND Sample_date >= DATE '1998-01-01' AND Sample_date <= DATE '1999-12-31'
""")
def _(t):
    rows = clean.date_range(
        t.inventory, "Sample_date", after=date(1997, 6, 30), before=date(2000, 1, 1), first=date(1998, 1, 1), last=date(1999, 12, 31)
    )
    return rows.select("Sample_ID", "Sample_date")


@query("p5_project_filter", "SELECT Sample_ID, Project, Water_body FROM sample_info WHERE Water_body = 'WB' AND Project <> 'Reservoir' AND Project <> 'CORE'")
def _(t):
    rows = clean.equals_all(t.sample_info, equal={"Water_body": "WB"}, differ={"Project": ["Reservoir", "CORE"]})
    return rows.select("Sample_ID", "Project", "Water_body")


@query("p6_regex_exclude", """
SELECT Genus_sp_95toPresent, COUNT(*) AS n FROM taxa_groups
WHERE Genus_sp_95toPresent IS NULL OR NOT (contains(Genus_sp_95toPresent, 'pengoi') OR regexp_matches(Genus_sp_95toPresent, '^red|bolt$')) GROUP BY 1
""")
def _(t):
    return agg.group_count(clean.regex_exclude(t.taxa_groups, "Genus_sp_95toPresent", "pengoi", "^red|bolt$"), "Genus_sp_95toPresent")


@query("p7_drop_null_rows", "SELECT Sample_ID, Sample_site, Project FROM sample_info WHERE Sample_site IS NOT NULL AND Project IS NOT NULL")
def _(t):
    return clean.drop_null_rows(t.sample_info, "Sample_site", "Project").select("Sample_ID", "Sample_site", "Project")


@query("p8_threshold_filter", f"SELECT Sample_ID, {S('Zoop_density')} FROM zoop_final WHERE Zoop_density > 10 AND ABS(Zoop_density - Number_counted) < 1.5")
def _(t):
    rows = clean.threshold_filter(t.zoop_final, "Zoop_density", above=10)
    rows = clean.threshold_filter(rows, F.abs(F.col("Zoop_density") - F.col("Number_counted")), below=1.5)
    return rows.select("Sample_ID", snap("Zoop_density"))


@query("p9_null_if_implausible", f"""
SELECT Sample_ID, {S('CASE WHEN Surface_temp < 0.5 THEN NULL ELSE Surface_temp END', 'Surface_temp')}, {S('NULLIF(Bottom_temp, 0)', 'Bottom_temp')} FROM inventory
""")
def _(t):
    rows = clean.null_if_implausible(t.inventory, below={"Surface_temp": 0.5}, equal={"Bottom_temp": 0.0})
    return rows.select("Sample_ID", snap("Surface_temp"), snap("Bottom_temp"))


@query("p10_null_by_key", f"""
SELECT Sample_site, COUNT(*) AS n, COUNT(CASE WHEN Sample_site IN ('S1', 'S2') THEN NULL ELSE Surface_temp END) AS n_temp FROM sample_info GROUP BY 1
""")
def _(t):
    rows = clean.null_by_key(t.sample_info, "Sample_site", ["S1", "S2"], "Surface_temp")
    return rows.groupBy("Sample_site").agg(F.count(F.lit(1)).alias("n"), F.count("Surface_temp").alias("n_temp"))


@query("p11_recode_values", """
SELECT Sample_ID, CASE Project WHEN 'AUX 75' THEN 'AUX75' ELSE Project END AS Project,
  CASE Counter_name WHEN 'AA ' THEN 'AA' WHEN 'DD' THEN 'D. D.' ELSE Counter_name END AS Counter_name FROM sample_info
""")
def _(t):
    rows = clean.recode_values(t.sample_info, "Project", {"AUX 75": "AUX75"})
    return clean.recode_values(rows, "Counter_name", {"AA ": "AA", "DD": "D. D."}).select("Sample_ID", "Project", "Counter_name")


METER_FIXES = (("10", "Meter_1", 0), ("10", "Meter_2", 401), ("11", "Meter_2", 661), ("64", "Meter_1", None))


@query("p12_apply_overrides", f"""
SELECT Sample_ID, {S("CASE WHEN Sample_ID = '10' THEN 0 WHEN Sample_ID = '64' THEN NULL ELSE Meter_1 END", 'Meter_1')},
  {S("CASE WHEN Sample_ID = '10' THEN 401 WHEN Sample_ID = '11' THEN 661 ELSE Meter_2 END", 'Meter_2')} FROM inventory
""")
def _(t):
    rows = clean.apply_overrides(t.inventory, "Sample_ID", METER_FIXES)
    return rows.select("Sample_ID", snap("Meter_1"), snap("Meter_2"))


@query("p13_choose_column_by_key", f"SELECT Sample_ID, {S('CASE WHEN Sample_site IN ($$S3$$, $$S9$$) THEN Meter_B1 ELSE Meter_B2 END', 'meter')} FROM inventory")
def _(t):
    rows = clean.choose_column_by_key(t.inventory, "Sample_site", ["S3", "S9"], listed="Meter_B1", other="Meter_B2", into="meter")
    return rows.select("Sample_ID", snap("meter"))


@query("p14_cast_columns", """
SELECT source_file, TRY_CAST(Value AS DOUBLE) AS as_number, TRY_CAST(Number_counted AS INT) AS as_count
FROM sheets WHERE Information IN ('Bottom_temp', 'Surface_temp')
""")
def _(t):
    rows = t.sheets.filter(F.col("Information").isin("Bottom_temp", "Surface_temp"))
    rows = rows.select("source_file", F.col("Value").alias("as_number"), F.col("Number_counted").alias("as_count"))
    return clean.cast_columns(rows, {"as_number": "double", "as_count": "int"})


@query("p15_fill_null", f"SELECT Sample_ID, {S('COALESCE(Zoop_density, 0)', 'Zoop_density')}, {S('COALESCE(Zoop_biomass, 0)', 'Zoop_biomass')} FROM zoop_final")
def _(t):
    return snapped(clean.fill_null(t.zoop_final, 0.0, "Zoop_density", "Zoop_biomass").select("Sample_ID", "Zoop_density", "Zoop_biomass"))


@query("p16_composite_key", """
SELECT COALESCE(Sample_site, 'NA') || '_' || COALESCE(Project, 'NA') || '_' || COALESCE(Counter_name, 'NA') AS key, COUNT(*) AS n FROM sample_info GROUP BY 1
""")
def _(t):
    return agg.group_count(t.sample_info.withColumn("key", paste("Sample_site", "Project", "Counter_name")), "key")


@query("p17_derive_date_parts", """
SELECT Sample_ID, CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, CAST(month(Sample_date) AS INT) AS Mn, CAST(dayofyear(Sample_date) AS INT) AS DOY FROM sample_info
""")
def _(t):
    rows = clean.derive_date_parts(t.sample_info, "Sample_date", {"Y": "year", "M": "month_text", "Mn": "month", "DOY": "day_of_year"})
    return rows.select("Sample_ID", "Y", "M", "Mn", "DOY")


@query("p18_parse_dates", """
SELECT source_file, CAST(TRY_STRPTIME(Value, '%Y%m%d') AS DATE) AS day FROM sheets WHERE Information IN ('Sample_date', 'Sample_site')
""")
def _(t):
    rows = t.sheets.filter(F.col("Information").isin("Sample_date", "Sample_site"))
    return rows.select("source_file", parse_date("Value").alias("day"))


# --- reshape and set operations ------------------------------------------------------------------

_HEADER_SQL = ", ".join(
    f"MAX(CASE WHEN Information = '{f.name}' THEN "
    + {"string": "Value", "date": "CAST(TRY_STRPTIME(Value, '%Y%m%d') AS DATE)", "double": "TRY_CAST(Value AS DOUBLE)"}[f.dataType.typeName()]
    + f" END) AS {f.name}"
    for f in schemas.HEADER
)


@query("r1_header_spread", f"SELECT source_file, {_HEADER_SQL} FROM sheets GROUP BY source_file")
def _(t):
    return reshape.header_spread(t.sheets, "source_file")


@query("r2_unpivot_measurements", """
SELECT source_file, Genus_sp_lifestage, COUNT(*) AS n, SUM(CAST(Length_OU AS DOUBLE)) AS total, MAX(Measured_number) AS last_cell
FROM (UNPIVOT (SELECT source_file, Genus_sp_lifestage, COLUMNS('^L[0-9]+$') FROM sheets) ON COLUMNS('^L[0-9]+$') INTO NAME Measured_number VALUE Length_OU)
GROUP BY ALL
""")
def _(t):
    rows = t.sheets.select("source_file", "Genus_sp_lifestage", *schemas.LENGTH_CELLS)
    long = reshape.unpivot_measurements(rows, ["source_file", "Genus_sp_lifestage"], schemas.LENGTH_CELLS, name="Measured_number", value="Length_OU")
    return long.groupBy("source_file", "Genus_sp_lifestage").agg(
        F.count(F.lit(1)).alias("n"), F.sum(to_number("Length_OU")).alias("total"), F.max("Measured_number").alias("last_cell"))


PIVOT = ("Older", "Younger", "Egg", "Nauplii")


@query("r3_pivot_groups", "SELECT Sample_ID, " + ", ".join(S(f"SUM(CASE WHEN Life_stage = '{g}' THEN Zoop_biomass END)", g) for g in PIVOT) + " FROM zoop_final GROUP BY Sample_ID")
def _(t):
    return snapped(reshape.pivot_groups(t.zoop_final, ["Sample_ID"], "Life_stage", "Zoop_biomass", PIVOT))


@query("r3_pivot_open", f"""
SELECT Sample_ID, Life_stage, {S('SUM(Zoop_biomass)', 'Zoop_biomass')} FROM zoop_final GROUP BY 1, 2
""")
def _(t):
    # Melted again, so that the result needs no list of groups either.
    cells = reshape.pivot_open(t.zoop_final, ["Sample_ID"], "Life_stage", "Zoop_biomass")
    return snapped(cells.select("Sample_ID", F.explode("cells").alias("Life_stage", "Zoop_biomass")))


@query("r3_pivot_open_wide", "SELECT Order1, " + ", ".join(S(f"SUM(CASE WHEN Life_stage = '{g}' THEN Zoop_biomass END)", g) for g in sorted({*PIVOT, "Older", "Younger", "Egg", "Nauplii", "Veliger"})) + """
FROM zoop_final f LEFT JOIN (SELECT DISTINCT Genus_sp_lifestage AS k, Order1 FROM taxa_groups) x ON Genus_sp_lifestage = k GROUP BY 1
""")
def _(t):
    # A few orders hold all rows. The columns are those that the data have.
    rows = joins.enrich_taxa(t.zoop_final, t.taxa_groups, ["Order1"])
    cells = reshape.pivot_open(rows, ["Order1"], "Life_stage", "Zoop_biomass", hot_ids=True)
    return snapped(reshape.widened(cells, reshape.group_names(cells)))


@query("r4_melt_groups", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT Sample_ID, '{c}' AS reading, {S(c, 'value')} FROM inventory" for c in ("Surface_temp", "Bottom_temp", "Surface_DO")) + ")")
def _(t):
    cells = ["Surface_temp", "Bottom_temp", "Surface_DO"]
    rows = t.inventory.select("Sample_ID", *cells)
    return snapped(reshape.unpivot_measurements(rows, ["Sample_ID"], cells, name="reading", value="value", keep_null=True))


@query("r5_stack_frames", f"""
SELECT Sample_ID, Sample_site, {S('CAST(NULL AS DOUBLE)', 'Chl_a_ugL_L')} FROM phyto_samples
UNION ALL SELECT Sample_ID, NULL AS Sample_site, {S('Chl_a_ugL_L')} FROM pigments
""")
def _(t):
    return snapped(reshape.stack_frames(t.phyto_samples.select("Sample_ID", "Sample_site"), t.pigments.select("Sample_ID", "Chl_a_ugL_L")))


@query("r6_distinct_rows", f"SELECT DISTINCT Sample_ID, Genus_sp_lifestage, Life_stage, Measured_number FROM zoop_lengths")
def _(t):
    return reshape.distinct_rows(t.zoop_lengths, "Sample_ID", "Genus_sp_lifestage", "Life_stage", "Measured_number")


@query("r7_key_difference", "SELECT Sample_ID, Sample_site FROM sample_info s WHERE NOT EXISTS (SELECT 1 FROM zoop_final f WHERE f.Sample_ID = s.Sample_ID)")
def _(t):
    return reshape.key_difference(t.sample_info.select("Sample_ID", "Sample_site"), t.zoop_final, "Sample_ID")


@query("r8_partition_by_membership", """
SELECT part, COUNT(*) AS n, COUNT(DISTINCT Genus_sp_lifestage) AS n_taxa FROM (
  SELECT 'young' AS part, Genus_sp_lifestage FROM zoop_final WHERE regexp_matches(Genus_sp_lifestage, 'immature|unclass')
  UNION ALL SELECT 'old' AS part, Genus_sp_lifestage FROM zoop_final WHERE contains(Genus_sp_lifestage, 'adult')
  UNION ALL SELECT 'neither' AS part, Genus_sp_lifestage FROM zoop_final WHERE NOT regexp_matches(Genus_sp_lifestage, 'immature|unclass|adult')
) GROUP BY part
""")
def _(t):
    parts = reshape.partition_by_membership(
        t.zoop_final.select("Genus_sp_lifestage"), matches("Genus_sp_lifestage", "immature", "unclass"), matches("Genus_sp_lifestage", "adult"))
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("young", "old", "neither"))]
    return reshape.stack_frames(*named).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("Genus_sp_lifestage").alias("n_taxa"))


# --- joins ---------------------------------------------------------------------------------------


@query("j1_left_join_key", f"""
SELECT s.Sample_ID, s.Sample_site, {S('x.Latitude', 'Latitude')} FROM sample_info s
LEFT JOIN (SELECT CASE WHEN Sample_site = 'S4' THEN NULL ELSE Sample_site END AS k, Latitude FROM sites) x ON s.Sample_site IS NOT DISTINCT FROM x.k
""")
def _(t):
    dim = t.sites.select(F.when(F.col("Sample_site") != "S4", F.col("Sample_site")).alias("Sample_site"), "Latitude")
    return snapped(joins.left_join(t.sample_info.select("Sample_ID", "Sample_site"), dim, "Sample_site"))


@query("j2_enrich_taxa", """
SELECT f.Sample_ID, f.Genus_sp_lifestage, x.Order1 FROM zoop_final f
LEFT JOIN (SELECT DISTINCT Genus_sp_lifestage, Order1 FROM taxa_groups) x ON f.Genus_sp_lifestage = x.Genus_sp_lifestage
""")
def _(t):
    return joins.enrich_taxa(t.zoop_final.select("Sample_ID", "Genus_sp_lifestage"), t.taxa_groups, ["Order1"])


@query("j2_enrich_taxa_fanout", """
SELECT x.Order1, COUNT(*) AS n FROM zoop_final f LEFT JOIN taxa_groups x ON f.Genus_sp_lifestage = x.Genus_sp_lifestage GROUP BY 1
""")
def _(t):
    rows = joins.enrich_taxa(t.zoop_final.select("Genus_sp_lifestage"), t.taxa_groups, ["Order1"], allow_fanout=True)
    return agg.group_count(rows, "Order1")


@query("j2_repeated_keys", "SELECT Genus_sp_lifestage, COUNT(*) AS n FROM taxa_groups GROUP BY 1 HAVING COUNT(*) > 1")
def _(t):
    return joins.repeated_keys(t.taxa_groups, "Genus_sp_lifestage")


@query("j2_conflicting_taxa", "SELECT Genus_sp_lifestage, COUNT(*) AS n FROM (SELECT DISTINCT Genus_sp_lifestage, Life_stage FROM taxa_groups) GROUP BY 1 HAVING COUNT(*) > 1")
def _(t):
    return joins.conflicting_keys(t.taxa_groups, "Genus_sp_lifestage", ["Life_stage"])


@query("j3_left_join_multi", f"""
SELECT f.Sample_ID, f.Life_stage, {S('x.Biom_a', 'Biom_a')}, {S('x.Biom_dens', 'Biom_dens')} FROM zoop_final f
LEFT JOIN taxa_groups x ON f.Genus_sp_lifestage = x.Genus_sp_lifestage AND f.Life_stage = x.Life_stage
""")
def _(t):
    dim = t.taxa_groups.select("Genus_sp_lifestage", "Life_stage", "Biom_a", "Biom_dens")
    rows = joins.left_join(t.zoop_final.select("Sample_ID", "Genus_sp_lifestage", "Life_stage"), dim, ["Genus_sp_lifestage", "Life_stage"])
    return snapped(rows.drop("Genus_sp_lifestage"))


@query("j4_star_join", f"""
SELECT p.Genus_type, s.Sample_site, x.Phylum, {S('g.Latitude', 'Latitude')}, {S('p.Phyto_biomass', 'Phyto_biomass')} FROM phyto_final p
LEFT JOIN phyto_samples s ON p.Sample_ID = s.Sample_ID LEFT JOIN phyto_taxa x ON p.Genus_type = x.Genus_type
LEFT JOIN sites g ON s.Sample_site IS NOT DISTINCT FROM g.Sample_site
""")
def _(t):
    rows = joins.star_join(t.phyto_final, [
        (t.phyto_samples.select("Sample_ID", "Sample_site"), "Sample_ID"), (t.phyto_taxa.select("Genus_type", "Phylum"), "Genus_type"),
        (t.sites.select("Sample_site", "Latitude"), "Sample_site"),
    ])
    return snapped(rows.select("Genus_type", "Sample_site", "Phylum", "Latitude", "Phyto_biomass"))


@query("j5_join_collision", """
SELECT s.Sample_ID, s.Sample_site, s.Sample_date, i.Sample_time, i.Project AS Project_right FROM (SELECT Sample_ID, Sample_site, Sample_date, 'x' AS Project FROM sample_info) s
LEFT JOIN inventory i ON s.Sample_ID = i.Sample_ID
""")
def _(t):
    left = t.sample_info.select("Sample_ID", "Sample_site", "Sample_date", F.lit("x").alias("Project"))
    once = joins.left_join(left.drop("Project"), t.inventory.select("Sample_ID", "Sample_site", "Sample_date", "Sample_time"), "Sample_ID")
    both = joins.left_join(left.select("Sample_ID", "Project"), t.inventory.select("Sample_ID", "Project"), "Sample_ID", collisions="right")
    return joins.left_join(once, both.drop("Project"), "Sample_ID")


@query("j6_attach_sample_scalars", f"""
SELECT f.Sample_ID, f.Genus_sp_lifestage, {S('s.Surface_temp', 'Surface_temp')}, {S('s.Diluted_vol_mL', 'Diluted_vol_mL')}
FROM zoop_final f LEFT JOIN sample_info s ON f.Sample_ID = s.Sample_ID
""")
def _(t):
    rows = t.zoop_final.select("Sample_ID", "Genus_sp_lifestage")
    return snapped(joins.attach_scalars(rows, t.sample_info, ["Surface_temp", "Diluted_vol_mL"], on="Sample_ID"))


@query("j7_attach_cutoffs", f"""
SELECT l.Sample_ID, l.Genus_sp_lifestage, {S('c.Length_cutoff', 'Length_cutoff')} FROM zoop_lengths l LEFT JOIN cutoffs c ON l.Genus_sp_lifestage = c.Genus_sp_lifestage
""")
def _(t):
    return snapped(joins.attach_cutoffs(t.zoop_lengths.select("Sample_ID", "Genus_sp_lifestage"), t.cutoffs))


@query("j8_attach_self_summary", f"""
SELECT Sample_ID, Genus_sp_lifestage, {S('AVG(Length_mm) OVER (PARTITION BY Sample_ID)', 'mean_length')}, COUNT(*) OVER (PARTITION BY Sample_ID) AS n FROM zoop_lengths
""")
def _(t):
    rows = t.zoop_lengths.select("Sample_ID", "Genus_sp_lifestage", "Length_mm")
    return snapped(joins.attach_summary(rows, ["Sample_ID"], {"mean_length": mean_skip("Length_mm"), "n": F.count(F.lit(1))}).drop("Length_mm"))


@query("j9_map_relabel", f"""
SELECT a.p_brand, a.p_type, a.n, m.label FROM (SELECT p_brand, p_type, COUNT(*) AS n FROM part GROUP BY 1, 2) a
LEFT JOIN (SELECT DISTINCT p_type, lower(p_type) AS label FROM part WHERE p_type <> 'PROMO') m ON a.p_type = m.p_type
""")
def _(t):
    part = t.raw("part")
    labels = part.filter("p_type <> 'PROMO'").select("p_type", F.lower("p_type").alias("label")).distinct()
    return joins.left_join(agg.group_count(part, "p_brand", "p_type"), labels, "p_type")


@query("j10_sample_env_join", f"""
SELECT b.Y, b.M, b.Sample_site, b.n, {S('e.temp', 'temp')} FROM
 (SELECT CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, Sample_site, COUNT(*) AS n FROM sample_info GROUP BY ALL) b
 LEFT JOIN (SELECT CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, Sample_site, AVG(Surface_temp) AS temp FROM inventory WHERE year(Sample_date) > 1995 GROUP BY ALL) e
 ON b.Y = e.Y AND b.M = e.M AND b.Sample_site IS NOT DISTINCT FROM e.Sample_site
""")
def _(t):
    parts = {"Y": "year", "M": "month_text"}
    bio = agg.group_count(clean.derive_date_parts(t.sample_info, "Sample_date", parts), "Y", "M", "Sample_site")
    env = clean.date_range(t.inventory, "Sample_date", first=date(1996, 1, 1)).withColumnRenamed("Surface_temp", "temp")
    env = agg.monthly_rollup(env, "Sample_date", ["Sample_site"], ["temp"])
    return snapped(joins.left_join(bio, env, ["Y", "M", "Sample_site"]))


# --- aggregates ----------------------------------------------------------------------------------


@query("a1_sum_zero_empty", f"""
SELECT Genus_sp_lifestage, Life_stage, {S('COALESCE(SUM(Number_counted), 0)', 'Number_counted')}, {S('COALESCE(SUM(Zoop_density), 0)', 'Zoop_density')},
  {S('AVG(Zoop_len_avg)', 'Zoop_len_avg')} FROM zoop_final GROUP BY 1, 2
""")
def _(t):
    return snapped(agg.sum_zero_empty(t.zoop_final, ["Genus_sp_lifestage", "Life_stage"], ["Number_counted", "Zoop_density"], ["Zoop_len_avg"]))


@query("a2_mean_skip_null", f"SELECT Sample_ID, {S('AVG(Zoop_biomass)', 'Zoop_biomass')} FROM zoop_final GROUP BY 1")
def _(t):
    return snapped(agg.mean_of(t.zoop_final, ["Sample_ID"], ["Zoop_biomass"]))


@query("a3_strict_mean", f"SELECT Sample_ID, {S('CASE WHEN COUNT(Zoop_biomass) = COUNT(*) THEN AVG(Zoop_biomass) END', 'Zoop_biomass')} FROM zoop_final GROUP BY 1")
def _(t):
    return snapped(agg.mean_of(t.zoop_final, ["Sample_ID"], ["Zoop_biomass"], strict=True))


def _exact(c: str) -> str:
    """An exact sum in SQL: whole multiples of 2**-60, which hold every bit of the values summed here, rounded once."""
    return f"(CAST(CAST(SUM(CAST({c} * 1152921504606846976 AS HUGEINT)) AS VARCHAR) AS DOUBLE) / 1152921504606846976)"


# Compared to the last bit, without a grid.
@query("a1_exact_sums", f"""
SELECT Genus_sp_lifestage, Life_stage, COALESCE({_exact('Number_counted')}, 0) AS Number_counted, COALESCE({_exact('Zoop_density')}, 0) AS Zoop_density,
  {_exact('Zoop_len_avg')} / COUNT(Zoop_len_avg) AS Zoop_len_avg FROM zoop_final GROUP BY 1, 2
""")
def _(t):
    return agg.sum_zero_empty(t.zoop_final, ["Genus_sp_lifestage", "Life_stage"], ["Number_counted", "Zoop_density"], ["Zoop_len_avg"], exact=True)


@query("a2_exact_mean", f"SELECT Life_stage, {_exact('Zoop_biomass')} / COUNT(Zoop_biomass) AS Zoop_biomass FROM zoop_final GROUP BY 1")
def _(t):
    return agg.mean_of(t.zoop_final, ["Life_stage"], ["Zoop_biomass"], exact=True)


@query("a3_exact_strict_mean", f"SELECT Sample_ID, CASE WHEN COUNT(Zoop_biomass) = COUNT(*) THEN {_exact('Zoop_biomass')} / COUNT(*) END AS Zoop_biomass FROM zoop_final GROUP BY 1")
def _(t):
    return agg.mean_of(t.zoop_final, ["Sample_ID"], ["Zoop_biomass"], strict=True, exact=True)


ENV = ("Secchi_depth_m", "Surface_temp", "Bottom_temp", "Surface_DO", "Bottom_DO")


@query("a4_across_agg", "SELECT Sample_site, " + ", ".join(S(f"MAX({c})", c) for c in ENV) + " FROM inventory GROUP BY 1")
def _(t):
    return snapped(agg.across_agg(t.inventory, ["Sample_site"], F.max, ENV))


@query("a5_count_min_max", """
SELECT Sample_site, COUNT(*) AS n, MIN(Sample_date) AS FirstDate, MAX(Sample_date) AS LastDate FROM (SELECT DISTINCT Sample_site, Sample_date FROM sample_info) GROUP BY 1
""")
def _(t):
    return agg.count_min_max(t.sample_info.select("Sample_site", "Sample_date").distinct(), ["Sample_site"], "Sample_date")


@query("a6_conditional_ratio", f"""
SELECT Genus_sp_lifestage, {S('share', 'Prop_O')}, {S('1 - share', 'Prop_Y')} FROM (
  SELECT Genus_sp_lifestage, COUNT(CASE WHEN Length_mm >= 5 THEN 1 END) / NULLIF(CAST(COUNT(Length_mm) AS DOUBLE), 0) AS share FROM zoop_lengths GROUP BY 1)
""")
def _(t):
    return snapped(agg.conditional_ratio(t.zoop_lengths, ["Genus_sp_lifestage"], F.col("Length_mm") >= 5, "Length_mm", names=("Prop_O", "Prop_Y")))


@query("a7_mean_se", f"""
SELECT Sample_site, Project, {S('m', 'Surface_temp')}, {S('m - se', 'Surface_temp_minSE')}, {S('m + se', 'Surface_temp_maxSE')} FROM (
  SELECT Sample_site, Project, AVG(Surface_temp) AS m, STDDEV_SAMP(Surface_temp) / SQRT(COUNT(Surface_temp)) AS se FROM sample_info GROUP BY 1, 2)
""")
def _(t):
    return snapped(agg.mean_se(t.sample_info, ["Sample_site", "Project"], "Surface_temp"))


@query("a8_two_level_mean", f"SELECT Life_stage, {S('AVG(m)', 'Zoop_biomass')} FROM (SELECT Sample_ID, Life_stage, AVG(Zoop_biomass) AS m FROM zoop_final GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return snapped(agg.two_level_mean(t.zoop_final, ["Sample_ID"], ["Life_stage"], "Zoop_biomass"))


def _monthly_sql(fn):
    return f"""
SELECT CAST(year(s.Sample_date) AS INT) AS Y, strftime(s.Sample_date, '%m') AS M, s.Sample_site, f.Life_stage, {S(fn('f.Number_counted'), 'Number_counted')}, {S(fn('f.Zoop_biomass'), 'Zoop_biomass')}
FROM zoop_final f JOIN sample_info s ON f.Sample_ID = s.Sample_ID GROUP BY ALL
"""


def _monthly(t, how):
    rows = t.zoop_final.select("Sample_ID", "Life_stage", "Number_counted", "Zoop_biomass").join(t.sample_info.select("Sample_ID", "Sample_date", "Sample_site"), "Sample_ID")
    return snapped(agg.monthly_rollup(rows, "Sample_date", ["Sample_site", "Life_stage"], ["Number_counted", "Zoop_biomass"], agg=how))


@query("a9_monthly_rollup_mean", _monthly_sql(lambda c: f"AVG({c})"))
def _(t):
    return _monthly(t, "mean")


@query("a9_monthly_rollup_sum", _monthly_sql(lambda c: f"COALESCE(SUM({c}), 0)"))
def _(t):
    return _monthly(t, "sum")


@query("a10_regroup_chain", f"""
SELECT Sample_ID, Order1, {S('SUM(n)', 'Number_counted')}, {S('AVG(m)', 'Zoop_len_avg')} FROM (
  SELECT Sample_ID, Genus_sp_lifestage, COALESCE(SUM(Number_counted), 0) AS n, AVG(Zoop_len_avg) AS m FROM zoop_final GROUP BY 1, 2) a
LEFT JOIN (SELECT DISTINCT Genus_sp_lifestage AS k, Order1 FROM taxa_groups) b ON a.Genus_sp_lifestage = b.k GROUP BY 1, 2
""")
def _(t):
    return snapped(agg.regroup_chain(
        t.zoop_final, ["Sample_ID", "Genus_sp_lifestage"], t.taxa_groups, ["Order1"], ["Sample_ID", "Order1"], ["Number_counted"], ["Zoop_len_avg"]))


@query("a11_count_distinct", "SELECT Life_stage, COUNT(DISTINCT Sample_ID) AS n_Sample_ID, COUNT(DISTINCT Genus_sp_lifestage) AS n_Genus_sp_lifestage FROM zoop_final GROUP BY 1")
def _(t):
    return agg.count_distinct(t.zoop_final, ["Life_stage"], ["Sample_ID", "Genus_sp_lifestage"])


@query("a12_row_nonnull_count", "SELECT Genus_sp_lifestage, cells, COUNT(*) AS n FROM (SELECT Genus_sp_lifestage, CAST(" + " + ".join(
    f"(L{j} IS NOT NULL)::INT" for j in range(1, 21)) + " AS INT) AS cells FROM sheets) GROUP BY 1, 2")
def _(t):
    return agg.group_count(agg.row_nonnull_count(t.sheets, schemas.LENGTH_CELLS, "cells"), "Genus_sp_lifestage", "cells")


@query("a13_group_count", "SELECT Genus_sp_lifestage, COUNT(*) AS n FROM zoop_lengths GROUP BY 1")
def _(t):
    return agg.group_count(t.zoop_lengths, "Genus_sp_lifestage")


@query("a14_grand_mean", f"SELECT {S('AVG(Zoop_density)', 'Zoop_density')}, {S('AVG(Zoop_biomass)', 'Zoop_biomass')} FROM zoop_final")
def _(t):
    return snapped(agg.grand_mean(t.zoop_final, "Zoop_density", "Zoop_biomass"))


PROFILED = ("Number_counted", "Zoop_density", "Zoop_biomass", "Zoop_len_avg")


@query("a15_profile_numeric", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS n_missing, {S(f'MIN({c})', 'min')}, {S(f'AVG({c})', 'mean')}, {S(f'MAX({c})', 'max')},
    {S(f'quantile_cont({c}, 0.25)', 'q25')}, {S(f'quantile_cont({c}, 0.5)', 'q50')}, {S(f'quantile_cont({c}, 0.75)', 'q75')} FROM zoop_final"""
    for c in PROFILED))
def _(t):
    return snapped(agg.profile_numeric(t.zoop_final, PROFILED))


@query("a15_profile_small_sketch", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS n_missing, {S(f'MIN({c})', 'min')}, {S(f'AVG({c})', 'mean')}, {S(f'MAX({c})', 'max')},
    {S(f'quantile_cont({c}, 0.25)', 'q25')}, {S(f'quantile_cont({c}, 0.5)', 'q50')}, {S(f'quantile_cont({c}, 0.75)', 'q75')} FROM zoop_final"""
    for c in PROFILED))
def _(t):
    return snapped(agg.profile_numeric(t.zoop_final, PROFILED, accuracy=500))


_DAY = "(Sample_date::DATE - DATE '1970-01-01')"


@query("a15_profile_dates", f"""
SELECT 'Sample_date' AS "column", COUNT(*) - COUNT(Sample_date) AS n_missing, {", ".join(
    f"(DATE '1970-01-01' + CAST(FLOOR({e}) AS INTEGER))::DATE AS {n}" for e, n in (
        (f"MIN({_DAY})", '"min"'), (f"AVG({_DAY})", "mean"), (f"MAX({_DAY})", '"max"'),
        (f"quantile_cont({_DAY}, 0.25)", "q25"), (f"quantile_cont({_DAY}, 0.5)", "q50"), (f"quantile_cont({_DAY}, 0.75)", "q75")))}
FROM sample_info
""")
def _(t):
    return agg.profile_dates(t.sample_info, ["Sample_date"])


@query("a15_profile_levels", """
WITH c AS (SELECT 'Genus_sp_lifestage' AS "column", Genus_sp_lifestage AS level, COUNT(*) AS n FROM zoop_final GROUP BY 2
  UNION ALL SELECT 'Life_stage' AS "column", Life_stage AS level, COUNT(*) AS n FROM zoop_final GROUP BY 2),
k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS r FROM c),
m AS (SELECT "column" AS c, MAX(r) AS levels FROM k GROUP BY 1),
s AS (SELECT k.*, CASE WHEN levels > 100 THEN 99 ELSE 100 END AS shown FROM k JOIN m ON m.c = k."column")
SELECT "column", level, n, FALSE AS rest FROM s WHERE r <= shown
UNION ALL SELECT "column", '(Other)' AS level, CAST(SUM(n) AS BIGINT) AS n, TRUE AS rest FROM s WHERE r > shown GROUP BY 1
""")
def _(t):
    return agg.profile_levels(t.zoop_final, ["Genus_sp_lifestage", "Life_stage"], top=100)


@query("a16_resolve_dups_by_mean", f"""
SELECT Sample_ID, Genus_sp_lifestage, Life_stage, {S('AVG(Number_counted)', 'Number_counted')}, {S('CASE WHEN COUNT(Zoop_density) = COUNT(*) THEN AVG(Zoop_density) END', 'Zoop_density')}
FROM zoop_final GROUP BY 1, 2, 3
""")
def _(t):
    return snapped(agg.resolve_dups_by_mean(t.zoop_final, ["Sample_ID", "Genus_sp_lifestage", "Life_stage"], ["Number_counted", "Zoop_density"]))


@query("a17_histogram", f"""
WITH s AS (SELECT MIN(Zoop_biomass) AS lo, MAX(Zoop_biomass) AS hi, CAST(CEIL(LOG2(COUNT(Zoop_biomass))) AS INT) + 1 AS k FROM zoop_final),
b AS (SELECT LEAST(CAST(FLOOR((Zoop_biomass - lo) / ((hi - lo) / k)) AS INT) + 1, k) AS bin, lo, (hi - lo) / k AS w FROM zoop_final, s WHERE Zoop_biomass IS NOT NULL)
SELECT bin, {S('lo + (bin - 1) * w', 'low')}, {S('lo + bin * w', 'high')}, COUNT(*) AS n FROM b GROUP BY bin, lo, w
""")
def _(t):
    return snapped(agg.histogram(t.zoop_final, "Zoop_biomass"))


def _round_histogram_sql(c: str, table: str) -> str:
    return f"""
WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {table} WHERE {c} IS NOT NULL),
s AS (SELECT MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / CEIL(LOG2(COUNT(*)) + 1) AS cell FROM v),
p AS (SELECT *, POWER(10, FLOOR(LOG10(cell))) AS base FROM s),
d AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 ELSE 1 END AS two FROM p),
e AS (SELECT *, CASE WHEN 5 * base - cell < 2.75 * (cell - two * base) THEN 5 ELSE two END AS five FROM d),
f AS (SELECT *, base * CASE WHEN 10 * base - cell < 1.5 * (cell - five * base) THEN 10 ELSE five END AS step FROM e),
b AS (SELECT step, CAST(FLOOR(lo / step + 1e-10) AS BIGINT) AS a, CAST(CEIL(hi / step - 1e-10) AS BIGINT) AS z FROM f),
k AS (SELECT CAST(i - a AS INT) AS bin, (i - 1) * step AS low, i * step AS high, i = a + 1 AS first FROM b, unnest(range(a + 1, z + 1)) r(i))
SELECT bin, {S('low')}, {S('high')}, (SELECT COUNT(*) FROM v, f WHERE x <= high + 1e-7 * step AND (first OR x > low + 1e-7 * step)) AS n FROM k
"""


# Whole numbers lie on the breaks; lengths are skewed, so some bins are empty.
@query("a17_round_histogram", _round_histogram_sql("Number_counted", "zoop_final"))
def _(t):
    return snapped(agg.round_histogram(t.zoop_final, "Number_counted"))


@query("a17_round_histogram_gaps", _round_histogram_sql("CASE WHEN Length_mm < 3 OR Length_mm > 8 THEN Length_mm * Length_mm / 100 END", "zoop_lengths"))
def _(t):
    c = F.col("Length_mm")
    return snapped(agg.round_histogram(t.zoop_lengths.select(F.when((c < 3) | (c > 8), c * c / 100).alias("x")), "x"))


# --- windows, sort, limit ------------------------------------------------------------------------


@query("w1_grouped_mutate", f"""
SELECT DISTINCT Sample_ID, Genus_sp_lifestage, {S('SUM(COALESCE(Number_counted, 0)) OVER w', 'Number_counted')}, {S('AVG(Zoop_len_avg) OVER w', 'Zoop_len_avg')}
FROM zoop_final WINDOW w AS (PARTITION BY Sample_ID, Genus_sp_lifestage)
""")
def _(t):
    rows = t.zoop_final.select("Sample_ID", "Genus_sp_lifestage", "Number_counted", "Zoop_len_avg")
    return snapped(windows.grouped_mutate(
        rows, ["Sample_ID", "Genus_sp_lifestage"], {"Number_counted": F.coalesce(F.sum("Number_counted"), F.lit(0.0)), "Zoop_len_avg": F.avg("Zoop_len_avg")}))


DUP_ORDER = ("Number_counted", "Zoop_biomass", "Zoop_density")


@query("w2_flag_duplicates", f"""
SELECT Sample_ID, Genus_sp_lifestage, {', '.join(S(c) for c in DUP_ORDER)},
  ROW_NUMBER() OVER (PARTITION BY Sample_ID, Genus_sp_lifestage ORDER BY Number_counted NULLS FIRST, Zoop_biomass NULLS FIRST, Zoop_density NULLS FIRST) > 1 AS dups FROM zoop_final
""")
def _(t):
    rows = t.zoop_final.select("Sample_ID", "Genus_sp_lifestage", *DUP_ORDER)
    return snapped(windows.flag_duplicates(rows, ["Sample_ID", "Genus_sp_lifestage"], DUP_ORDER))


@query("w2_flag_duplicates_hot_key", f"""
SELECT Life_stage, COUNT(*) AS n, COUNT(CASE WHEN dups THEN 1 END) AS repeats, {S('MAX(CASE WHEN NOT dups THEN Number_counted * 1000000 + Zoop_prod END)', 'kept')} FROM (
  SELECT Life_stage, Number_counted, Zoop_prod, ROW_NUMBER() OVER (PARTITION BY Life_stage ORDER BY Number_counted, Zoop_prod) > 1 AS dups FROM zoop_final) GROUP BY 1
""")
def _(t):
    rows = windows.flag_duplicates(t.zoop_final.select("Life_stage", "Number_counted", "Zoop_prod"), ["Life_stage"], ["Number_counted", "Zoop_prod"])
    kept = F.max(F.when(~F.col("dups"), F.col("Number_counted") * 1000000 + F.col("Zoop_prod")))
    return snapped(rows.groupBy("Life_stage").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("dups"), 1)).alias("repeats"), kept.alias("kept")))


@query("w2_flag_repeats", f"""
SELECT Sample_ID, Genus_sp_lifestage, {', '.join(S(c) for c in DUP_ORDER)},
  ROW_NUMBER() OVER (PARTITION BY Sample_ID, Genus_sp_lifestage ORDER BY Number_counted NULLS FIRST, Zoop_biomass NULLS FIRST, Zoop_density NULLS FIRST) > 1 AS dups FROM zoop_final
""")
def _(t):
    rows = t.zoop_final.select("Sample_ID", "Genus_sp_lifestage", *DUP_ORDER)
    return snapped(windows.flag_repeats(rows, ["Sample_ID", "Genus_sp_lifestage"], DUP_ORDER))


@query("w2_flag_repeats_hot_key", f"""
SELECT Life_stage, COUNT(*) AS n, COUNT(CASE WHEN dups THEN 1 END) AS repeats, {S('MAX(CASE WHEN NOT dups THEN Number_counted * 1000000 + Zoop_prod END)', 'kept')} FROM (
  SELECT Life_stage, Number_counted, Zoop_prod, ROW_NUMBER() OVER (PARTITION BY Life_stage ORDER BY Number_counted, Zoop_prod) > 1 AS dups FROM zoop_final) GROUP BY 1
""")
def _(t):
    rows = windows.flag_repeats(t.zoop_final.select("Life_stage", "Number_counted", "Zoop_prod"), ["Life_stage"], ["Number_counted", "Zoop_prod"])
    kept = F.max(F.when(~F.col("dups"), F.col("Number_counted") * 1000000 + F.col("Zoop_prod")))
    return snapped(rows.groupBy("Life_stage").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("dups"), 1)).alias("repeats"), kept.alias("kept")))


_LATE = "CAST(Sample_ID AS BIGINT) % 5 = 0"


@query("w2_flag_new_batch", f"""
WITH b AS (SELECT Genus_sp_lifestage, Life_stage, Number_counted, Zoop_prod FROM zoop_final WHERE {_LATE}),
k AS (SELECT DISTINCT Genus_sp_lifestage AS g, Life_stage AS s FROM zoop_final WHERE NOT ({_LATE}) AND Number_counted > 40)
SELECT Genus_sp_lifestage, Life_stage, Number_counted, {S('Zoop_prod')},
  g IS NOT NULL OR ROW_NUMBER() OVER (PARTITION BY Genus_sp_lifestage, Life_stage ORDER BY Number_counted, Zoop_prod) > 1 AS dups
FROM b LEFT JOIN k ON Genus_sp_lifestage = g AND Life_stage = s
""")
def _(t):
    keys = ["Genus_sp_lifestage", "Life_stage"]
    rows = t.zoop_final.select(*keys, "Number_counted", "Zoop_prod", F.expr(_LATE).alias("late"))
    batch, seen = rows.filter("late").drop("late"), rows.filter("NOT late AND Number_counted > 40")
    return snapped(windows.flag_repeats(batch, keys, ["Number_counted", "Zoop_prod"], seen=seen))


@query("w3_sorted_levels", "SELECT DISTINCT Genus_sp_lifestage FROM zoop_final ORDER BY 1")
def _(t):
    return windows.sorted_levels(t.zoop_final, "Genus_sp_lifestage")


@query("w4_head_rows", f"SELECT Sample_ID, Genus_sp_lifestage, {S('Zoop_prod')} FROM zoop_final ORDER BY Zoop_prod DESC, Sample_ID, Genus_sp_lifestage LIMIT 3")
def _(t):
    rows = windows.head_rows(t.zoop_final, 3, F.col("Zoop_prod").desc(), "Sample_ID", "Genus_sp_lifestage")
    return snapped(rows.select("Sample_ID", "Genus_sp_lifestage", "Zoop_prod"))


# --- scalar functions ----------------------------------------------------------------------------


@query("f1_power", f"SELECT l_orderkey, {S('0.5 * POWER(l_quantity, 1.2)', 'y')} FROM lineitem")
def _(t):
    return t.raw("lineitem").select("l_orderkey", snap(F.lit(0.5) * F.pow("l_quantity", F.lit(1.2)), "y"))


@query("f2_half_even_rounding", "SELECT l_orderkey, round_even(l_quantity / 2, 0) AS half, round_even(l_quantity * 12.5, 0) AS eighth FROM lineitem")
def _(t):
    q = F.col("l_quantity")
    return t.raw("lineitem").select("l_orderkey", half_even(q / 2).alias("half"), half_even(q * 12.5).alias("eighth"))


_TENTHS = "CAST(o_orderkey % 1000000 AS DOUBLE) / 20000000000 + CAST(o_custkey % 7 AS DOUBLE) * CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1000 ELSE -150000000000000 END"


# Halves at the tenth digit, small and large, and values that have no tenth digit; compared to the last bit.
@query("f2_round_nearest", f"""
WITH v AS (SELECT o_orderkey, {_TENTHS} AS x FROM orders),
c AS (SELECT *, ABS(x) AS s, FLOOR(ABS(x) * 10000000000) AS lo, FLOOR(ABS(x) * 10000000000) / 10000000000 AS dn, CEIL(ABS(x) * 10000000000) / 10000000000 AS up FROM v)
SELECT o_orderkey, CASE WHEN s >= 131072 THEN x ELSE SIGN(x) * CASE WHEN s - dn < up - s OR (s - dn = up - s AND lo % 2 = 0) THEN dn ELSE up END END AS x FROM c
""")
def _(t):
    return t.raw("orders").selectExpr("o_orderkey", f"{_TENTHS} AS x").select("o_orderkey", (round_nearest("x", 10) + F.lit(0.0)).alias("x"))


@query("f3_pi_log1p", f"SELECT o_orderkey, {S('LN(o_totalprice + 1)', 'logged')}, {S('PI() * POWER(o_custkey, 2) / 4', 'area')} FROM orders")
def _(t):
    return t.raw("orders").select("o_orderkey", snap(F.log1p("o_totalprice"), "logged"), snap(F.pi() * F.pow("o_custkey", F.lit(2)) / 4, "area"))


@query("f4_regex_test", "SELECT p_partkey, COALESCE(regexp_matches(NULLIF(p_name, 'red bolt'), '^(red|blue) .*t$'), FALSE) AS hit FROM part")
def _(t):
    return t.raw("part").select("p_partkey", matches(F.nullif("p_name", F.lit("red bolt")), "^(red|blue) .*t$").alias("hit"))


@query("f5_nested_conditional", """
SELECT Genus_sp_lifestage, Life_stage, CASE WHEN Order1 IS NULL THEN NULL WHEN Order1 = 'Calanoida' THEN 'cala' ELSE CASE WHEN Genus IS NULL THEN NULL WHEN Genus = 'Daphnia' THEN 'daph' ELSE 'rest' END END AS g FROM taxa_groups
""")
def _(t):
    g = if_else(F.col("Order1") == "Calanoida", "cala", if_else(F.col("Genus") == "Daphnia", "daph", "rest"))
    return t.taxa_groups.select("Genus_sp_lifestage", "Life_stage", g.alias("g"))


@query("f6_null_and_nan_tests", """
SELECT Sample_ID, Surface_temp IS NULL AS missing, COALESCE(Surface_temp / NULLIF(Surface_temp, 0), -1) = -1 AS undefined FROM sample_info
""")
def _(t):
    missing = F.col("Surface_temp").isNull()
    undefined = ratio("Surface_temp", "Surface_temp").isNull()
    return t.sample_info.select("Sample_ID", missing.alias("missing"), undefined.alias("undefined"))


@query("f7_ratio_and_tolerance", f"""
SELECT Sample_ID, {S('r', 'ratio')}, CASE WHEN r IS NULL THEN NULL WHEN r <= 0.99 OR r >= 1.01 THEN 'dif' ELSE 'same' END AS flag
FROM (SELECT Sample_ID, (Meter_2 - Meter_1) * 5.2765 / NULLIF(Vol_sampled_L, 0) AS r FROM inventory)
""")
def _(t):
    r = ratio((F.col("Meter_2") - F.col("Meter_1")) * 5.2765, "Vol_sampled_L")
    rows = t.inventory.select("Sample_ID", r.alias("ratio"))
    return snapped(rows.withColumn("flag", if_else((F.col("ratio") <= 0.99) | (F.col("ratio") >= 1.01), "dif", "same")))


@query("f8_conversions", """
SELECT source_file, Information, TRY_CAST(Value AS DOUBLE) AS number, CAST(TRY_STRPTIME(CASE WHEN length(Value) = 8 THEN Value END, '%Y%m%d') AS DATE) AS day, NULLIF(Value, 'junk') AS text
FROM sheets WHERE Information IN ('Bottom_temp', 'Depth_m', 'Sample_date')
""")
def _(t):
    rows = t.sheets.filter(F.col("Information").isin("Bottom_temp", "Depth_m", "Sample_date"))
    return rows.select(
        "source_file", "Information", to_number("Value").alias("number"), parse_date("Value", "yyyyMMdd").alias("day"),
        blank_to_null("Value", ["junk"]).alias("text"))
