"""Whole exports, requests and audits."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from catalog.basic import PROFILED, SITES_4, SITES_8, SITES_18
from catalog.domain import (
    ENV_SQL, MAJOR, PATH, POOLED, SIZE_TABLE, SPECIES, STAGE2, TAXON, VELIGER, WITH_TAXA,
)
from catalog.registry import ORACLES, lit_list, query, snap_sql as S, snapped
from lakesurvey.operators.aggregates import histogram
from lakesurvey.operators.harmonize import IMMATURE_LABELS
from lakesurvey.operators.rollup import bit_counts, distinct_bits, integer_codes, mean, merged_bits, merged_sums, standard_error, total
from lakesurvey.operators.windows import duplicate_rows
from lakesurvey.plans import exports as ex
from lakesurvey.plans import ingest as ing
from lakesurvey.plans import profiles as pf
from lakesurvey.plans import requests as rq
from lakesurvey.plans import rollup as ru
from lakesurvey.plans.rules import Corrections
from lakesurvey.session import shared_folder, stored_bytes
from lakesurvey.sources import append_bucketed, read_table, write_csv

# Corrections of the checks: several samples each, so that every scale has some at the chosen sites.
FIXED = tuple(str(i) for i in range(100, 160))
RESTORED = tuple(str(i) for i in range(130, 190))
FIXES = Corrections(
    meters=tuple((i, c, v) for i in FIXED for c, v in (("Meter_1", 0), ("Meter_2", 401))),
    volumes=tuple((i, c, v) for i in FIXED for c, v in (("Subsampled_vol_mL", 8), ("Diluted_vol_mL", 3300))),
    stored_volume=RESTORED,
    drop_biomass=RESTORED,
)
NUMBERS = ("Number_counted", "Zoop_density", "Zoop_biomass")


def sums(columns=NUMBERS, prefix=""):
    return ", ".join(f"COALESCE(SUM({prefix}{c}), 0) AS {c}" for c in columns)


def snaps(*columns):
    return ", ".join(S(c) for c in columns)


# --- ingest --------------------------------------------------------------------------------------


@query("q01_ingest_sheets_counts", f"""
{PATH} SELECT Sample_ID, {TAXON}, Life_stage, Number_counted, {S('Zoop_density')} FROM counts
""")
def _(t):
    rows = ing.ingest_sheets(t.sheets, t.in_use("cutoffs")).counts
    return snapped(rows.select("Sample_ID", TAXON, "Life_stage", "Number_counted", "Zoop_density"))


@query("q01_ingest_sheets_status", f"""
{PATH}, {SPECIES}, m AS (SELECT source_file, SUM({' + '.join(f"(L{j} IS NOT NULL)::INT" for j in range(1, 21))}) AS cells FROM sheets GROUP BY 1),
l AS (SELECT source_file, COUNT(*) AS n FROM all_lengths GROUP BY 1)
SELECT m.source_file, cells = COALESCE(n, 0) AND sheet_taxa = final_taxa AS ok,
  CASE WHEN cells = COALESCE(n, 0) AND sheet_taxa = final_taxa THEN 'Number measured OK. Species counts OK.' WHEN cells = COALESCE(n, 0) THEN 'Species counts NOT OK'
    WHEN sheet_taxa = final_taxa THEN 'Number measured NOT OK' ELSE 'Number measured NOT OK. Species counts NOT OK.' END AS status
FROM m LEFT JOIN l ON m.source_file = l.source_file LEFT JOIN species s ON m.source_file = s.source_file
""")
def _(t):
    return ing.ingest_sheets(t.sheets, t.in_use("cutoffs")).status


# Each stored table as (tab, year, Sample_ID, two names, two numbers).
STORED = {
    "zoop_sample_info": ("Sample_site", "Project", "Depth_m", "Subsampled_vol_mL"),
    "sample_inventory": ("Sample_site", "Project", "Net_diameter_m", "Meter_2"),
    "zoop_counts": (TAXON, "Life_stage", "Number_counted", "0.0"),
    "zoop_final": (TAXON, "Life_stage", "Number_counted", "Zoop_density"),
    "zoop_lengths": (TAXON, "Measured_number", "Length_mm", "0.0"),
    "zoop_egg_counts": (TAXON, "Measured_number", "Number_eggs", "0.0"),
}
_ENTERED = {
    "zoop_sample_info": "headers h JOIN y USING (source_file)", "sample_inventory": "headers h JOIN y USING (source_file)",
    "zoop_counts": "counts JOIN y USING (source_file)",
    "zoop_final": "(SELECT * REPLACE (CASE WHEN Life_stage <> 'Egg' THEN Zoop_density END AS Zoop_density) FROM counts) JOIN y USING (source_file)",
    "zoop_lengths": "all_lengths JOIN y USING (source_file) WHERE Life_stage <> 'Egg'",
    "zoop_egg_counts": "(SELECT *, Length_OU AS Number_eggs FROM all_lengths) JOIN y USING (source_file) WHERE Life_stage = 'Egg'",
}


@query("q01_load_folder", f"""
{PATH}, {SPECIES}, ok AS (SELECT source_file FROM species WHERE sheet_taxa = final_taxa),
y AS (SELECT h.source_file, CAST(year(Sample_date) AS INT) AS year FROM headers h JOIN ok ON h.source_file = ok.source_file)
SELECT tab, year, Sample_ID, COUNT(*) AS n, MIN(one) AS one, MAX(two) AS two, {S('SUM(a)', 'a')}, {S('SUM(b)', 'b')}, {S('MAX(a)', 'most')} FROM (
""" + " UNION ALL ".join(
    f"SELECT '{name}' AS tab, year, Sample_ID, {one} AS one, {two} AS two, {a} AS a, {b} AS b FROM {_ENTERED[name]}"
    for name, (one, two, a, b) in STORED.items()) + ") GROUP BY 1, 2, 3")
def _(t):
    # Entered the whole way: text files are scanned, archived, staged, checked, appended to six tables and read back.
    files, warehouse = (shared_folder(t.spark, name) for name in ("sheet-files", "warehouse"))
    write_csv(t.sheets.drop("source_file"), files, compressed=True)
    ing.load_folder(t.spark, files, t.cutoffs, t.taxa_groups, warehouse, key="Sample_ID", pattern="*.csv.gz")
    stored = [
        read_table(t.spark, f"{warehouse}/{name}").selectExpr(f"'{name}' AS tab", "year", "Sample_ID", f"{one} AS one", f"{two} AS two", f"{a} AS a", f"CAST({b} AS DOUBLE) AS b")
        for name, (one, two, a, b) in STORED.items()
    ]
    out = stored[0]
    for s in stored[1:]:
        out = out.unionByName(s)
    return snapped(out.groupBy("tab", "year", "Sample_ID").agg(
        F.count(F.lit(1)).alias("n"), F.min("one").alias("one"), F.max("two").alias("two"), F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("a").alias("most")))


@query("q01_new_sheets", """
SELECT 'again-' || Sample_ID AS source_file FROM (SELECT DISTINCT Sample_ID FROM sheets) WHERE CAST(Sample_ID AS BIGINT) % 3 <> 0
""")
def _(t):
    # A third was entered before under other names, and each file lies in the folder twice.
    entered = ing.sheet_digests(t.sheets.filter("CAST(Sample_ID AS BIGINT) % 3 = 0"))
    again = [t.sheets.withColumn("source_file", F.concat(F.lit(prefix), "Sample_ID")) for prefix in ("again-", "copy-")]
    return ing.new_sheets(ing.sheet_digests(again[0].unionByName(again[1])), entered).select("source_file")


SHEET_FINAL = f"""
{PATH},
ind AS (SELECT l.source_file, l.Sample_ID, l.{TAXON}, l.Life_stage, Length_mm, Biom_a * POWER(Length_mm, Biom_b) AS mass,
  CASE WHEN l.{TAXON} = '{VELIGER}' THEN -0.0602 + 0.714 * Length_mm ELSE FR1_a * POWER(Length_mm, FR1_b) END AS fr
  FROM all_lengths l LEFT JOIN taxa_groups g ON l.{TAXON} = g.{TAXON} AND l.Life_stage = g.Life_stage WHERE l.Life_stage <> 'Egg'),
mean AS (SELECT source_file, Sample_ID, {TAXON}, Life_stage, AVG(mass) AS mass, CASE WHEN COUNT(mass) = COUNT(*) THEN AVG(0.022387 * POWER(mass, 0.54)) END AS pe,
  CASE WHEN COUNT(mass) = COUNT(*) THEN AVG(0.041686938 * POWER(mass, 0.67)) END AS ne, CASE WHEN COUNT(fr) = COUNT(*) THEN AVG(fr) END AS fr, AVG(Length_mm) AS len FROM ind GROUP BY 1, 2, 3, 4),
b AS (SELECT c.*, m.pe, m.ne, m.fr, m.len, g.Pr_alpha, g.Pr_beta, g.Pr_rho, h.Surface_temp,
  COALESCE(CASE WHEN g.Biom_dens IS NOT NULL THEN Zoop_density * g.Biom_dens ELSE COALESCE(m.mass, 0) * Zoop_density END, 0) AS w
  FROM counts c JOIN headers h ON c.source_file = h.source_file LEFT JOIN mean m ON c.source_file = m.source_file AND c.{TAXON} = m.{TAXON} AND c.Life_stage = m.Life_stage
  LEFT JOIN taxa_groups g ON c.{TAXON} = g.{TAXON} AND c.Life_stage = g.Life_stage)
SELECT Sample_ID, {TAXON}, Life_stage, Number_counted, {S("CASE WHEN Life_stage <> 'Egg' THEN Zoop_density END", 'Zoop_density')}, {S('w', 'Zoop_biomass')},
  {S('CASE WHEN w = 0 THEN 0 ELSE pe * Zoop_density END', 'Zoop_P_exc')}, {S('CASE WHEN w = 0 THEN 0 ELSE ne * Zoop_density END', 'Zoop_N_exc')},
  {S('CASE WHEN w = 0 THEN 0 ELSE fr * Zoop_density END', 'Zoop_FR1')}, {S('CASE WHEN w = 0 THEN 0 ELSE Pr_alpha * POWER(w, Pr_beta) * POWER(Pr_rho, Surface_temp) END', 'Zoop_prod')},
  {S('len', 'Zoop_len_avg')} FROM b
"""


@query("q02_zoop_final", SHEET_FINAL)
def _(t):
    done = ing.ingest_sheets(t.sheets, t.in_use("cutoffs"))
    return snapped(ing.zoop_final(done, t.in_use("taxa_groups"), veliger_taxon=VELIGER).drop("source_file"))


# --- exports -------------------------------------------------------------------------------------


def core_sql(sites, volume_sites=None, after=None, fixes=True):
    """CTEs named by stage: corrected samples, volumes, counts with densities, pooled sums."""
    low = f"AND Sample_date > DATE '{after}'" if after else ""
    fixed, restored = (lit_list(FIXED), lit_list(RESTORED)) if fixes else ("('none')", "('none')")
    return f"""
smp AS (SELECT Sample_ID, Sample_date, Sample_site, Project, CASE WHEN Sample_ID IN {fixed} THEN 8 ELSE Subsampled_vol_mL END AS sub,
  CASE WHEN Sample_ID IN {fixed} THEN 3300 ELSE Diluted_vol_mL END AS dil FROM sample_info WHERE Sample_site IN {lit_list(sites)} {low}),
vol AS (SELECT Sample_ID, Vol_sampled_L AS v1, CASE WHEN Sample_ID IN {restored} THEN Vol_sampled_L WHEN Sample_ID IN {fixed} THEN 401 * 5.2765 ELSE (Meter_2 - Meter_1) * 5.2765 END AS v2
  FROM inventory WHERE Sample_site IN {lit_list(volume_sites or sites)} {low}),
fixed AS (SELECT z.Sample_ID, Sample_date, Sample_site, z.{TAXON}, Life_stage, Number_counted, Zoop_density AS stored_density, Number_counted * dil / NULLIF(sub * v2, 0) AS Zoop_density,
  Number_counted * dil / NULLIF(sub * v1, 0) AS density1, CASE WHEN z.Sample_ID IN {restored} THEN NULL ELSE Zoop_biomass END AS Zoop_biomass, Zoop_len_avg, Order1
  FROM zoop_final z JOIN smp ON z.Sample_ID = smp.Sample_ID LEFT JOIN vol ON z.Sample_ID = vol.Sample_ID
  LEFT JOIN (SELECT DISTINCT {TAXON}, Order1 FROM taxa_groups) x ON z.{TAXON} = x.{TAXON})"""


RELABEL = "CASE WHEN p = 'Ploesoma_sp' THEN 'Ploesoma_sp.' ELSE p END"


def pooled_sql(source="fixed"):
    return f"""
pooled AS (SELECT Sample_ID, Sample_date, Sample_site, {RELABEL} AS {TAXON}, {STAGE2} AS Life_stage2, {sums()}, AVG(Zoop_len_avg) AS Zoop_len_avg
  FROM (SELECT *, {POOLED} AS p FROM {source}) WHERE p IS NULL OR NOT regexp_matches(p, 'B_longimanus|C_pengoi') GROUP BY 1, 2, 3, 4, 5)"""


LABELS = f"labels AS (SELECT DISTINCT {TAXON} AS k, biop_152_codes, CASE WHEN biop_152_names = 'Cop  eggs' THEN 'Cop eggs' ELSE biop_152_names END AS biop_152_names, Genus_sp_95toPresent, Order1 FROM taxa_groups)"
GROUPED = f"""
grouped AS (SELECT Sample_ID, Sample_date, Sample_site, biop_152_names, biop_152_codes, {sums()}, AVG(Zoop_len_avg) AS Zoop_len_avg
  FROM pooled LEFT JOIN labels ON pooled.{TAXON} IS NOT DISTINCT FROM labels.k GROUP BY 1, 2, 3, 4, 5)"""
GROUP_COLUMNS = f"Sample_ID, Sample_date, Sample_site, biop_152_names, biop_152_codes, {snaps(*NUMBERS, 'Zoop_len_avg')}"


def star_sql(sites, year, project, after):
    return f"""
vol AS (SELECT Sample_ID, (Meter_2 - Meter_1) * 5.2765 AS v2 FROM inventory WHERE Sample_site IN {lit_list(sites)} AND Sample_date > DATE '{after}'),
fixed AS (SELECT z.Sample_ID, s.Sample_date, s.Sample_site, z.{TAXON}, z.Life_stage, Number_counted, Number_counted * Diluted_vol_mL / NULLIF(Subsampled_vol_mL * v2, 0) AS Zoop_density,
  Zoop_biomass, Zoop_len_avg, Order1 FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID LEFT JOIN vol ON z.Sample_ID = vol.Sample_ID
  LEFT JOIN (SELECT DISTINCT {TAXON}, Order1 FROM taxa_groups) x ON z.{TAXON} = x.{TAXON}
  WHERE CAST(s.Sample_date AS STRING) LIKE '%{year}%' AND Project = '{project}' AND s.Sample_site IN {lit_list(sites)})"""


AFTER = date(1997, 6, 30)


@query("q03_ftg_annual", f"WITH {star_sql(SITES_4, 1998, 'CORE', AFTER)}, {pooled_sql()}, {LABELS}, {GROUPED} SELECT {GROUP_COLUMNS} FROM grouped")
def _(t):
    return snapped(ex.ftg_annual(
        t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, year=1998, project="CORE", sites=SITES_4, volumes_after=AFTER))


@query("q04_ftg_long", f"""
WITH {core_sql(SITES_4, after=AFTER)}, {pooled_sql()}, {LABELS}, {GROUPED} SELECT {GROUP_COLUMNS},
  CASE WHEN biop_152_names IN ('Diaptomidae.immature', 'Temoridae.immature') THEN 'othercala' WHEN biop_152_names IN ('Eub.Coreg', 'Bo.Longer') THEN 'Bosminidae' ELSE biop_152_names END AS biop_152_names95toPres FROM grouped
""")
def _(t):
    return snapped(ex.ftg_long(
        t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_4, after=AFTER, corrections=FIXES))


@query("q04_corrected_counts", f"""
WITH {core_sql(SITES_4, after=AFTER)} SELECT Sample_ID, {TAXON}, Order1, {S('Zoop_density', 'density_computed_volume')}, {S('density1', 'density_stored_volume')}, {S('Zoop_density - stored_density', 'density_diff')} FROM fixed
""")
def _(t):
    rows = ex.corrected_counts(t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_4, after=AFTER, corrections=FIXES)
    return snapped(rows.select("Sample_ID", TAXON, "Order1", "density_computed_volume", "density_stored_volume", "density_diff"))


@query("q04_label_dimension", f"""
SELECT DISTINCT {TAXON}, Genus_sp_95toPresent, biop_152_codes, biop_152_names, CASE WHEN biop_152_names IN ('Diaptomidae.immature', 'Temoridae.immature') THEN 'othercala'
  WHEN biop_152_names IN ('Eub.Coreg', 'Bo.Longer') THEN 'Bosminidae' ELSE biop_152_names END AS biop_152_names95toPres FROM taxa_groups
""")
def _(t):
    return ex.label_dimension(t.taxa_groups)


@query("q05_site_year_taxa", f"""
WITH {star_sql(('S3',), 1998, 'CORE', AFTER)}, {pooled_sql()}, {LABELS},
o AS (SELECT Sample_ID, Sample_date, Sample_site, Genus_sp_95toPresent, Life_stage2, {sums(NUMBERS[1:])} FROM pooled LEFT JOIN labels ON pooled.{TAXON} IS NOT DISTINCT FROM labels.k WHERE Life_stage2 <> 'Egg' GROUP BY 1, 2, 3, 4, 5)
SELECT Sample_ID, Sample_date, Sample_site, Genus_sp_95toPresent, Life_stage2, {snaps(*NUMBERS[1:])} FROM o
""")
def _(t):
    return snapped(ex.site_year_taxa(
        t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, year=1998, project="CORE", site="S3", volumes_after=AFTER))


MATRIX = ("Calanoida_Nauplii", "Calanoida_YO", "Cladocera_YO", "Cyclopoida_Nauplii", "Cyclopoida_YO", "Leptodora kindti_YO", "Rotifers_YO", "Veneroida_Veliger")
MATRIX_AS = ("Calanoida_Nauplii", "Calanoida", "Cladocera", "Cyclopoida_Nauplii", "Cyclopoida", "Leptodora", "Rotifers", "Veligers")


@query("q06_basin_wide_matrix", f"""
WITH a AS (SELECT z.Sample_ID, Sample_date, Sample_site, Surface_temp, z.{TAXON}, Life_stage, Zoop_biomass, Order1 FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID
  LEFT JOIN (SELECT DISTINCT {TAXON}, Order1 FROM taxa_groups) x ON z.{TAXON} = x.{TAXON} WHERE year(Sample_date) >= 1996 AND year(Sample_date) < 2000 AND Sample_site IN {lit_list(SITES_8)}),
b AS (SELECT Sample_ID, Sample_date, Sample_site, Surface_temp, {POOLED} AS p, {STAGE2} AS st, COALESCE(SUM(Zoop_biomass), 0) AS w FROM a WHERE Life_stage <> 'Egg' GROUP BY 1, 2, 3, 4, 5, 6),
l AS (SELECT DISTINCT {TAXON}, Genus_sp_95toPresent, Order1 FROM taxa_groups),
c AS (SELECT b.*, COALESCE({MAJOR}, 'NA') || '_' || st AS g FROM b LEFT JOIN l ON b.p = l.{TAXON})
SELECT Sample_ID, Sample_date, Sample_site, {', '.join(S(f"SUM(CASE WHEN g = '{g}' THEN w END)", n) for g, n in zip(MATRIX, MATRIX_AS))},
  {S('CASE WHEN Surface_temp < 0.5 THEN NULL ELSE Surface_temp END', 'TempC')}
FROM c WHERE g NOT IN ('CopepodOther_Nauplii', 'CopepodOther_YO', 'Cercopagis pengoi_YO', 'Bythotrephes longimanus_YO') GROUP BY Sample_ID, Sample_date, Sample_site, Surface_temp
""")
def _(t):
    return snapped(ex.basin_wide_matrix(
        t.zoop_final, t.sample_info, t.taxa_groups, sites=SITES_8, first=date(1996, 1, 1), before=date(2000, 1, 1)))


NAMED = f"""
named AS (SELECT Sample_ID, Sample_date, Sample_site, Life_stage2, Genus_sp_95toPresent, Order1, {sums()} FROM pooled LEFT JOIN labels ON pooled.{TAXON} IS NOT DISTINCT FROM labels.k
  WHERE Life_stage2 <> 'Egg' GROUP BY 1, 2, 3, 4, 5, 6)"""
ENV = ("Latitude", "Longitude", "Secchi_depth_m", "Surface_temp", "Bottom_temp", "Surface_DO", "Bottom_DO")


def index_sql(fn, volume_sites):
    return f"""
WITH {core_sql(SITES_18, volume_sites)}, {pooled_sql()}, {LABELS}, {NAMED}, env AS ({ENV_SQL}),
mon AS (SELECT CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, Life_stage2, Sample_site, Order1, Genus_sp_95toPresent, {', '.join(f'{fn(c)} AS {c}' for c in NUMBERS)} FROM named GROUP BY 1, 2, 3, 4, 5, 6)
SELECT mon.Y, mon.M, Life_stage2, mon.Sample_site, Order1, Genus_sp_95toPresent, {snaps(*NUMBERS)}, {snaps(*ENV)}
FROM mon LEFT JOIN env ON mon.Y = env.Y AND mon.M = env.M AND mon.Sample_site IS NOT DISTINCT FROM env.Sample_site
"""


@query("q07_index_zoop", index_sql(lambda c: f"AVG({c})", None))
def _(t):
    return snapped(ex.index_zoop(t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_18, corrections=FIXES))


@query("q17_monthly_request", index_sql(lambda c: f"COALESCE(SUM({c}), 0)", SITES_8))
def _(t):
    # Volumes of the western sites only: densities elsewhere are missing and sum to 0.
    return snapped(ex.monthly_request(
        t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_18, volume_sites=SITES_8, corrections=FIXES))


REPORT = f"""
WITH {core_sql(SITES_18)}, {pooled_sql()}, {LABELS}, {NAMED},
mon AS (SELECT CAST(year(Sample_date) AS INT) AS Y, strftime(Sample_date, '%m') AS M, Life_stage2, Sample_site, Order1, Genus_sp_95toPresent, AVG(Zoop_biomass) AS w FROM named
  WHERE Life_stage2 IN ('YO', 'Nauplii') AND Order1 IN ('Calanoida', 'Cyclopoida', 'Cladocera') GROUP BY 1, 2, 3, 4, 5, 6),
tot AS (SELECT Y, M, Sample_site, SUM(CASE WHEN Order1 = 'Calanoida' THEN w END) + SUM(CASE WHEN Order1 = 'Cladocera' THEN w END) + SUM(CASE WHEN Order1 = 'Cyclopoida' THEN w END) AS w FROM mon GROUP BY 1, 2, 3),
bas AS (SELECT Y, M, CASE WHEN Sample_site IN {lit_list(SITES_8)} THEN 'Western basin' ELSE 'Central basin' END AS Basin, AVG(w) AS avg_w, STDDEV_SAMP(w) / SQRT(COUNT(w)) AS se
  FROM tot WHERE Y IN (1998, 1999, 2000) GROUP BY 1, 2, 3)
"""
OFFSETS = {1998: 0.0, 1999: 0.1, 2000: 0.2}


def _report(t):
    return ex.annual_report(
        t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_18, western=SITES_8, corrections=FIXES, offsets=OFFSETS)


@query("q13_annual_report", f"""
{REPORT} SELECT Y AS Year, M, Basin, {S('avg_w', 'TotCopCladBM')}, {S('avg_w - se', 'TotCopCladBM_minSE')}, {S('avg_w + se', 'TotCopCladBM_maxSE')},
  {S('CAST(M AS INT) + (Y - 1998) * 0.1', 'Mn')} FROM bas
""")
def _(t):
    return snapped(_report(t))


@query("q13_season_report", f"{REPORT} SELECT Y AS Year, Basin, {S('AVG(avg_w)', 'TotCopCladBM')} FROM bas WHERE M IN ('07', '08') GROUP BY 1, 2")
def _(t):
    return snapped(ex.season_report(_report(t)))


# --- the same exports from bucketed tables, and from one stored roll-up --------------------------

BUCKETS = 16
# Bytes of stored facts to a bucket: some hundred thousand rows, which are sorted in a task's memory as they are written.
BUCKET_BYTES = 1 << 22
_STORED: dict[tuple[str, str], tuple] = {}


def _buckets(t):
    """How many buckets: more for more facts, as a bucket is a task's."""
    return max(BUCKETS, -(-stored_bytes(t.spark, t.path("lineitem")) // BUCKET_BYTES))


def _stored_tables(t):
    """Facts with their year, samples and inventory, stored once per session and table folder in buckets of the sample id."""
    place = (t.spark.sparkContext.applicationId, t.folder)
    if place not in _STORED:
        # Facts are sent to their buckets at once, and meet their years there.
        n = _buckets(t)
        facts = t.zoop_final.repartition(n, "Sample_ID")
        years = t.sample_info.select("Sample_ID", F.year("Sample_date").alias("year"))
        tables = []
        for name, rows in (("final", facts.join(years, "Sample_ID")), ("samples", t.sample_info), ("inventory", t.inventory)):
            path = shared_folder(t.spark, f"buckets-{name}")
            tables.append("t" + path.rsplit("-", 1)[1])
            append_bucketed(rows, tables[-1], buckets=n, path=path, partition="year" if name == "final" else None)
        _STORED[place] = tuple(tables)
    return tuple(t.spark.table(name) for name in _STORED[place][:3])


def _stored_buckets(t):
    """The stored tables and the roll-up level made of them, stored once as well."""
    tables, place = _stored_tables(t), (t.spark.sparkContext.applicationId, t.folder)
    if len(_STORED[place]) == 3:
        path = shared_folder(t.spark, "buckets-level")
        name = "t" + path.rsplit("-", 1)[1]
        ru.store_level(tables[0], t.taxa_groups, name, buckets=_buckets(t), path=path)
        _STORED[place] += (name,)
    return *tables, t.spark.table(_STORED[place][3])


def _level(t):
    _, samples, inventory, level = _stored_buckets(t)
    return ru.Level(level, samples, t.taxa_groups, inventory)


@query("q04_ftg_long_bucketed", ORACLES["q04_ftg_long"], raw=True)
def _(t):
    final, samples, inventory = _stored_tables(t)
    return snapped(ex.ftg_long(final, samples, t.taxa_groups, inventory, sites=SITES_4, after=AFTER, corrections=FIXES, bucketed=True))


@query("q07_index_zoop_bucketed", ORACLES["q07_index_zoop"], raw=True)
def _(t):
    final, samples, inventory = _stored_tables(t)
    return snapped(ex.index_zoop(final, samples, t.taxa_groups, inventory, sites=SITES_18, corrections=FIXES, bucketed=True))


@query("q03_ftg_annual_from_level", ORACLES["q03_ftg_annual"], raw=True)
def _(t):
    return snapped(_level(t).ftg_annual(year=1998, project="CORE", sites=SITES_4, volumes_after=AFTER))


@query("q04_ftg_long_from_level", ORACLES["q04_ftg_long"], raw=True)
def _(t):
    return snapped(_level(t).ftg_long(sites=SITES_4, after=AFTER, corrections=FIXES))


@query("q07_index_zoop_from_level", ORACLES["q07_index_zoop"], raw=True)
def _(t):
    return snapped(_level(t).index_zoop(sites=SITES_18, corrections=FIXES))


@query("q13_annual_report_from_level", ORACLES["q13_annual_report"], raw=True)
def _(t):
    return snapped(_level(t).annual_report(sites=SITES_18, western=SITES_8, corrections=FIXES, offsets=OFFSETS))


@query("q17_monthly_request_from_level", ORACLES["q17_monthly_request"], raw=True)
def _(t):
    return snapped(_level(t).monthly_request(sites=SITES_18, volume_sites=SITES_8, corrections=FIXES))


@query("a10_merged_levels", f"""
SELECT Life_stage2, n AS rows, {S('total', 'Zoop_biomass')}, {S('mean', 'mean')}, {S('se', 'se')} FROM (
  SELECT {STAGE2} AS Life_stage2, COUNT(*) AS n, COALESCE(SUM(Zoop_biomass), 0) AS total, AVG(Zoop_biomass) AS mean, STDDEV_SAMP(Zoop_biomass) / SQRT(COUNT(Zoop_biomass)) AS se
  FROM (SELECT *, {POOLED} AS p FROM (SELECT z.*, Order1 FROM zoop_final z LEFT JOIN (SELECT DISTINCT {TAXON}, Order1 FROM taxa_groups) x ON z.{TAXON} = x.{TAXON}))
  WHERE p IS NULL OR NOT regexp_matches(p, 'B_longimanus|C_pengoi') GROUP BY 1)
""")
def _(t):
    # From sample to taxon and stage, and from there to the stage, without the facts.
    by_taxon = merged_sums(_stored_buckets(t)[3], [TAXON, "Life_stage2"])
    by_stage = merged_sums(by_taxon, ["Life_stage2"])
    return snapped(by_stage.select("Life_stage2", "rows", total("Zoop_biomass").alias("Zoop_biomass"), mean("Zoop_biomass").alias("mean"), standard_error("Zoop_biomass").alias("se")))


@query("a11_merged_distinct", """
WITH f AS (SELECT z.Sample_ID, CAST(year(Sample_date) AS INT) AS year, Genus_sp_lifestage AS x FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID)
SELECT 'sample' AS level, Sample_ID AS name, COUNT(DISTINCT x) AS n FROM f GROUP BY 2 UNION ALL SELECT 'year' AS level, CAST(year AS STRING) AS name, COUNT(DISTINCT x) AS n FROM f GROUP BY 2
UNION ALL SELECT 'all' AS level, '' AS name, COUNT(DISTINCT x) AS n FROM f
""")
def _(t):
    # Three levels from one aggregation of the facts.
    codes = integer_codes(t.taxa_groups, TAXON)
    facts = _stored_tables(t)[0].select("Sample_ID", "year", TAXON)
    samples = distinct_bits(facts.join(codes, TAXON), ["Sample_ID", "year"])
    years = merged_bits(samples, ["year"])
    parts = [
        bit_counts(samples, ["Sample_ID"]).selectExpr("'sample' AS level", "Sample_ID AS name", "n"),
        bit_counts(years, ["year"]).selectExpr("'year' AS level", "CAST(year AS STRING) AS name", "n"),
        bit_counts(merged_bits(years, []), []).selectExpr("'all' AS level", "'' AS name", "n"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_SKETCHES: dict[tuple[str, str], str] = {}


def _sketches(t):
    """Facts with their year, and the folder of their sketches, written once per session and table folder."""
    final, place = _stored_tables(t)[0], (t.spark.sparkContext.applicationId, t.folder)
    if place not in _SKETCHES:
        folder = shared_folder(t.spark, "sketches")
        pf.store_sketches(final, folder, PROFILED, ["Genus_sp_lifestage", "Life_stage"])
        _SKETCHES[place] = folder
    return final, _SKETCHES[place]


@query("a15_profile_from_sketches", ORACLES["a15_profile_numeric"], raw=True)
def _(t):
    final, folder = _sketches(t)
    return snapped(pf.stored_profile(final, folder, PROFILED))


@query("a15_profile_years_from_sketches", "WITH f AS (SELECT z.* FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID WHERE year(Sample_date) IN (1996, 1998)) " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS n_missing, {S(f'MIN({c})', 'min')}, {S(f'AVG({c})', 'mean')}, {S(f'MAX({c})', 'max')},
    {S(f'quantile_cont({c}, 0.25)', 'q25')}, {S(f'quantile_cont({c}, 0.5)', 'q50')}, {S(f'quantile_cont({c}, 0.75)', 'q75')} FROM f"""
    for c in PROFILED))
def _(t):
    final, folder = _sketches(t)
    return snapped(pf.stored_profile(final, folder, PROFILED, years=[1996, 1998]))


@query("a15_levels_from_sketches", ORACLES["a15_profile_levels"], raw=True)
def _(t):
    return pf.stored_levels(t.spark, _sketches(t)[1], ["Genus_sp_lifestage", "Life_stage"], top=100)


def meso_sql(where):
    return f"""
WITH {core_sql(SITES_18)}, {pooled_sql()}, {LABELS}, {NAMED}
SELECT Sample_ID, Sample_date, Sample_site, {S('COALESCE(SUM(Zoop_density), 0)', 'Zoop_density')}, CAST(dayofyear(Sample_date) AS INT) AS DOY, CAST(year(Sample_date) AS INT) AS Y
FROM named WHERE Order1 IN ('Calanoida', 'Cyclopoida', 'Cladocera') AND {where} GROUP BY Sample_ID, Sample_date, Sample_site
"""


def _meso(t, sites, exclude=()):
    rows = ex.sample_taxa(t.zoop_final, t.sample_info, t.taxa_groups, t.inventory, sites=SITES_18, corrections=FIXES)
    return ex.mesozoop_density(rows, sites=sites, exclude=exclude)


@query("q15_mesozoop_density", meso_sql("Sample_site IN ('S1', 'S2')"))
def _(t):
    return snapped(_meso(t, ["S1", "S2"]))


@query("q15_mesozoop_no_immatures", f"SELECT * FROM ({meso_sql('Sample_site = $$S1$$ AND NOT COALESCE(Genus_sp_95toPresent IN ' + lit_list(IMMATURE_LABELS) + ', FALSE)')}) WHERE DOY > 150 AND DOY < 200")
def _(t):
    return snapped(_meso(t, ["S1"], IMMATURE_LABELS).filter("DOY > 150 AND DOY < 200"))


@query("q15_mesozoop_histogram", f"""
WITH {core_sql(SITES_18)}, {pooled_sql()}, {LABELS}, {NAMED},
d AS (SELECT Sample_ID, COALESCE(SUM(Zoop_density), 0) AS x FROM named WHERE Order1 IN ('Calanoida', 'Cyclopoida', 'Cladocera') AND Sample_site IN ('S1', 'S2') GROUP BY 1),
s AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM d)
SELECT LEAST(CAST(FLOOR((x - lo) / ((hi - lo) / 8)) AS INT) + 1, 8) AS bin, COUNT(*) AS n FROM d, s GROUP BY 1
""")
def _(t):
    return histogram(_meso(t, ["S1", "S2"]), "Zoop_density", 8).select("bin", "n")


@query("q21_ftg_window_variant", f"""
WITH r AS (SELECT z.Sample_ID, s.Sample_date, s.Sample_site, z.{TAXON}, Life_stage, Number_counted, COALESCE(Zoop_density, 0) AS Zoop_density, Zoop_biomass, Zoop_len_avg, Order1, FTG_Groups_1, biop_152_codes, biop_152_names
  FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID LEFT JOIN (SELECT DISTINCT {TAXON}, Order1, FTG_Groups_1, biop_152_codes, biop_152_names FROM taxa_groups) x ON z.{TAXON} = x.{TAXON}
  WHERE year(s.Sample_date) = 1998 AND Project = 'CORE'),
g AS (SELECT *, {POOLED.replace('Cyclopidae', 'Cyclopoida')} AS p FROM r)
SELECT DISTINCT Sample_ID, Sample_date, Sample_site, p AS {TAXON}, FTG_Groups_1, biop_152_codes, biop_152_names,
  {', '.join(S(f'COALESCE(SUM({c}) OVER w, 0)', c) for c in NUMBERS)}, {S('AVG(Zoop_len_avg) OVER w', 'Zoop_len_avg')}
FROM g WINDOW w AS (PARTITION BY Sample_ID, p)
""")
def _(t):
    rules = (("Calanoida", "Younger", "Calanoida_immature"), ("Cyclopoida", "Younger", "Cyclopoida_immature"))
    return snapped(ex.ftg_window_variant(t.zoop_final, t.sample_info, t.taxa_groups, year=1998, project="CORE", immatures=rules))


# --- requests ------------------------------------------------------------------------------------


@query("q08_index_phyto", f"""
SELECT p.Sample_ID, p.Genus_type, {S('Phyto_density')}, {S('Phyto_biomass')}, Sample_date, s.Sample_site, Water_body, Project, Taxa_name, Kingdom, Phylum, Class, Order1, Family, Genus, Type, Edible,
  {S('Latitude')}, {S('Longitude')} FROM phyto_final p JOIN phyto_samples s ON p.Sample_ID = s.Sample_ID LEFT JOIN phyto_taxa x ON p.Genus_type = x.Genus_type
  LEFT JOIN sites g ON s.Sample_site = g.Sample_site WHERE Project = 'CORE' AND s.Sample_site IN {lit_list(SITES_18)} AND p.Genus_type NOT IN ('P10', 'P11')
""")
def _(t):
    return snapped(rq.index_phyto(t.phyto_final, t.phyto_samples, t.phyto_taxa, t.sites, project="CORE", sites=SITES_18, exclude=["P10", "P11"]))


@query("q09_index_chla", f"SELECT Sample_ID, Sample_date, Sample_site, {S('Chl_a_ugL_L')} FROM pigments WHERE Sample_site IN {lit_list(SITES_18)}")
def _(t):
    return snapped(rq.index_chla(t.pigments, sites=SITES_18))


@query("q09_chla_repeats", f"""
SELECT Sample_ID, Sample_date, Sample_site, {S('Chl_a_ugL_L')} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY Sample_ID ORDER BY Sample_date, Chl_a_ugL_L) AS r FROM pigments WHERE Sample_site IN {lit_list(SITES_18)}) WHERE r > 1
""")
def _(t):
    return snapped(duplicate_rows(rq.index_chla(t.pigments, sites=SITES_18), ["Sample_ID"], ["Sample_date", "Chl_a_ugL_L"]))


FIRST, LAST = date(1996, 1, 1), date(2000, 1, 1)
REQUEST = f"""
req AS (SELECT z.Sample_ID, Sample_date, Sample_site, z.{TAXON}, Life_stage, Number_counted, Zoop_density, Zoop_biomass, CASE WHEN Project = 'AUX 75' THEN 'AUX75' ELSE Project END AS Project
  FROM zoop_final z JOIN sample_info s ON z.Sample_ID = s.Sample_ID WHERE Project <> 'Reservoir' AND Project <> 'Guard' AND Sample_date > DATE '{FIRST}' AND Sample_date < DATE '{LAST}')"""
STRICT = ", ".join(f"CASE WHEN COUNT({c}) = COUNT(*) THEN AVG({c}) END AS {c}" for c in NUMBERS)


@query("q10_foia_zoop", f"""
WITH {REQUEST}, a AS (SELECT Sample_ID, Sample_date, Sample_site, {TAXON}, Life_stage, {STRICT} FROM req GROUP BY 1, 2, 3, 4, 5)
SELECT Sample_ID, Sample_date, Sample_site, a.{TAXON}, Life_stage, {snaps(*NUMBERS)}, Genus_sp_95toPresent
FROM a LEFT JOIN (SELECT DISTINCT {TAXON}, Genus_sp_95toPresent FROM taxa_groups) x ON a.{TAXON} = x.{TAXON}
""")
def _(t):
    return snapped(rq.foia_zoop(
        t.zoop_final, t.sample_info, t.taxa_groups, exclude_projects=["Reservoir", "Guard"], after=FIRST, before=LAST, project_typos={"AUX 75": "AUX75"}))


@query("q10_foia_phyto", f"""
SELECT p.Sample_ID, p.Genus_type, {S('Phyto_density')}, {S('Phyto_biomass')}, Sample_date, Sample_site, Project, Taxa_name, Phylum, Genus FROM phyto_final p
JOIN phyto_samples s ON p.Sample_ID = s.Sample_ID LEFT JOIN phyto_taxa x ON p.Genus_type = x.Genus_type WHERE Sample_date > DATE '{FIRST}' AND Sample_date < DATE '{LAST}'
""")
def _(t):
    return snapped(rq.foia_phyto(t.phyto_final, t.phyto_samples, t.phyto_taxa, after=FIRST, before=LAST))


@query("q10_foia_env", f"""
SELECT Sample_ID, Sample_date, Sample_site, {S('Latitude')}, {S('Longitude')}, CASE WHEN Project = 'AUX 75' THEN 'AUX75' ELSE Project END AS Project,
  {S('NULLIF(Surface_temp, 0)', 'Surface_temp')}, {S('NULLIF(Bottom_temp, 0)', 'Bottom_temp')}, {S('Surface_DO')}, {S('Bottom_DO')}
FROM inventory WHERE Project IN ('AUX 75', 'AUX75', 'CORE') AND Sample_date > DATE '{FIRST}' AND Sample_date < DATE '{LAST}'
""")
def _(t):
    return snapped(rq.foia_env(t.inventory, projects=["AUX 75", "AUX75", "CORE"], after=FIRST, before=LAST, project_typos={"AUX 75": "AUX75"}))


@query("q11_foia_summary", f"""
SELECT CAST(year(Sample_date) AS INT) AS Year, CASE WHEN Water_body = 'WB' THEN 'W' ELSE 'C' END AS Basin, CASE WHEN month(Sample_date) <= 5 THEN 'spring' WHEN month(Sample_date) <= 7 THEN 'early' ELSE 'late' END AS Season,
  Sample_ID, {S('Surface_temp')} FROM sample_info WHERE year(Sample_date) BETWEEN 1997 AND 1999
""")
def _(t):
    base = t.sample_info.select(
        F.year("Sample_date").alias("Year"), "Sample_ID", "Surface_temp", "Water_body", F.month("Sample_date").alias("m"), F.lit(0).alias("X"))
    season = F.when(F.col("m") <= 5, "spring").when(F.col("m") <= 7, "early").otherwise("late")
    frames = [
        base.filter((F.col("Water_body") == basin) & (season == s)).withColumns({"Basin": F.lit(basin[0]), "Season": F.lit(s)}).drop("Water_body", "m")
        for basin in ("WB", "CB") for s in ("spring", "early", "late")
    ]
    return snapped(rq.foia_summary(frames, first_year=1997, last_year=1999, drop=["X"]))


@query("q12_reservoir_sites", f"SELECT Sample_ID, Sample_date, Sample_site, Project, {snaps('Latitude', 'Longitude', 'Secchi_depth_m', 'Depth_m', 'Ave_temp')} FROM inventory WHERE Project = 'Reservoir'")
def _(t):
    return snapped(rq.reservoir_sites(t.inventory, project="Reservoir"))


@query("q14_taxa_tables_phyto", f"SELECT Genus_type, Taxa_name, Kingdom, Phylum, Class, Order1, Family, Genus, Type, Edible, {S('Conversion_um_per_cell')}, Volumetric_equation FROM phyto_taxa")
def _(t):
    return snapped(rq.phyto_taxa_table(t.phyto_taxa))


@query("q14_taxa_tables_zoop", f"SELECT Genus_sp_95toPresent, Order1 FROM (SELECT DISTINCT {TAXON}, Genus_sp_95toPresent, Order1 FROM taxa_groups)")
def _(t):
    path = shared_folder(t.spark, "taxa-table")
    write_csv(rq.zoop_taxa_table(t.taxa_groups), path)
    return t.spark.read.schema("Genus_sp_95toPresent string, Order1 string").option("header", True).option("nullValue", "NA").csv(path)


@query("q16_site_counts_phyto", f"""
SELECT d.Sample_site, {S('Latitude')}, {S('Longitude')}, COUNT(*) AS n, MIN(Sample_date) AS FirstDate, MAX(Sample_date) AS LastDate FROM (
  SELECT DISTINCT p.Sample_ID, Sample_date, s.Sample_site, Latitude, Longitude FROM phyto_final p JOIN phyto_samples s ON p.Sample_ID = s.Sample_ID
  LEFT JOIN sites g ON s.Sample_site = g.Sample_site WHERE Project = 'CORE') d GROUP BY d.Sample_site, Latitude, Longitude
""")
def _(t):
    return snapped(rq.phyto_site_counts(t.phyto_final, t.phyto_samples, t.sites, project="CORE"))


def zoop_sites_sql(project):
    return f"""
SELECT Sample_site, {S('Latitude')}, {S('Longitude')}, COUNT(*) AS n, MIN(Sample_date) AS FirstDate, MAX(Sample_date) AS LastDate FROM (
  SELECT DISTINCT i.Sample_ID, s.Sample_date, s.Sample_site, Latitude, Longitude FROM inventory i JOIN sample_info s ON i.Sample_ID = s.Sample_ID WHERE s.Project = '{project}') GROUP BY Sample_site, Latitude, Longitude
"""


@query("q16_site_counts_reservoir", zoop_sites_sql("Reservoir"))
def _(t):
    return snapped(rq.zoop_site_counts(t.inventory, t.sample_info, project="Reservoir"))


@query("q16_site_counts_lake", zoop_sites_sql("CORE"))
def _(t):
    return snapped(rq.zoop_site_counts(t.inventory, t.sample_info, project="CORE"))


SPECIES_SEEN = ("Leptodiaptomus minutus", "red bolt", "blue gear", "old anvil", "hot ring", "small gizmo")


@query("q18_length_explore", f"""
WITH d AS (SELECT DISTINCT Sample_ID, {TAXON}, Life_stage, Measured_number, Length_mm FROM zoop_lengths WHERE Length_mm < 7),
c AS (SELECT Sample_ID, Sample_date, Sample_site, Project, CASE WHEN Counter_name = 'AA ' THEN 'AA' ELSE Counter_name END AS Counter_name FROM sample_info)
SELECT d.Sample_ID, d.{TAXON}, d.Life_stage, Measured_number, {S('Length_mm')}, Sample_date, Sample_site, Project, Counter_name, Genus_sp_95toPresent, Has_eggs, Order1,
  CASE WHEN Counter_name IS NULL THEN NULL WHEN Counter_name IN ('AA', 'BB', 'CC') THEN Counter_name ELSE 'other' END AS Counter_name2,
  CASE WHEN Counter_name IS NULL THEN NULL WHEN Counter_name = 'AA' THEN 'AA' ELSE 'Other Counter' END AS Counter_name3,
  CASE WHEN Sample_date > DATE '1998-01-01' THEN 'After1998' WHEN Sample_date IS NOT NULL THEN 'Before1998' END AS Period
FROM d LEFT JOIN c ON d.Sample_ID = c.Sample_ID LEFT JOIN taxa_groups g ON d.{TAXON} = g.{TAXON} AND d.Life_stage = g.Life_stage
WHERE Order1 = 'Calanoida' AND Genus_sp_95toPresent IN {lit_list(SPECIES_SEEN)}
""")
def _(t):
    return snapped(rq.length_explore(
        t.zoop_lengths, t.sample_info, t.taxa_groups, named=["AA", "BB", "CC"], lead="AA", counter_typos={"AA ": "AA"}, split=date(1998, 1, 1), species=SPECIES_SEEN))


@query("q19_mean_masses", f"""
WITH {WITH_TAXA}, masses AS (SELECT f.Sample_ID, {TAXON}, Order1, Genus, Zoop_biomass / NULLIF(Zoop_density, 0) AS m FROM f JOIN sample_info s ON f.Sample_ID = s.Sample_ID
  WHERE Project = 'CORE' AND Life_stage <> 'Egg' AND Life_stage <> 'Nauplii' AND Zoop_biomass / NULLIF(Zoop_density, 0) > 0) {SIZE_TABLE}
""")
def _(t):
    return snapped(rq.mean_masses(t.zoop_final, t.sample_info, t.taxa_groups, project="CORE"))


def _audit(t):
    return rq.dup_audit(t.zoop_final, t.sample_info, exclude_projects=["Reservoir", "Guard"], after=FIRST, before=LAST, project_typos={"AUX 75": "AUX75"})


@query("q20_dup_audit_repeats", f"""
WITH {REQUEST} SELECT Sample_ID, Sample_date, Sample_site, {TAXON}, Life_stage, Project, {snaps(*NUMBERS)} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY Sample_ID, {TAXON}, Life_stage ORDER BY Number_counted NULLS FIRST, Zoop_density NULLS FIRST, Zoop_biomass NULLS FIRST) AS r FROM req) WHERE r > 1
""")
def _(t):
    return snapped(_audit(t)[0])


@query("q20_dup_audit_resolved", f"WITH {REQUEST}, a AS (SELECT Sample_ID, {TAXON}, Life_stage, {STRICT} FROM req GROUP BY 1, 2, 3) SELECT Sample_ID, {TAXON}, Life_stage, {snaps(*NUMBERS)} FROM a")
def _(t):
    return snapped(_audit(t)[1])


@query("q20_label_differences", f"SELECT DISTINCT {TAXON} FROM zoop_final z WHERE NOT EXISTS (SELECT 1 FROM cutoffs c WHERE c.{TAXON} = z.{TAXON})")
def _(t):
    return rq.label_differences(t.zoop_final, t.cutoffs, TAXON)
