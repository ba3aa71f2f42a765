"""Bucketed tables from load to export, and the stored roll-up."""

import os
import re
import uuid

import pytest
from pyspark.sql import functions as F

from catalog import exports as queries
from catalog.exports import AFTER, FIXES, SITES_4, SITES_18
from catalog.views import Tables
from lakesurvey.operators.rollup import bit_counts, distinct_bits, integer_codes, mean, measures_of, merged_bits, merged_sums, partial_sums, standard_error, total
from lakesurvey.plans import exports as ex
from lakesurvey.plans import ingest, rollup
from lakesurvey.sources import append_bucketed
from tests.test_sheets import GOOD, HEADER, cutoffs, sheet_lines, taxa_groups, write_sheet  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
NO_BROADCAST = {k: "-1" for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}


@pytest.fixture
def merging(spark):
    """Joins as of tables too large to broadcast."""
    before = {k: spark.conf.get(k, None) for k in NO_BROADCAST}
    for k, v in NO_BROADCAST.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def above_scan(df, table):
    """The operators over the scan of a table up to its first sum, lowest first."""
    lines = [(re.search(r"[A-Za-z(]", line[:400]).start(), line) for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if re.search("[A-Za-z]", line)]
    at = next(i for i, (_, line) in enumerate(lines) if "FileScan" in line and table in line)
    depth, out = lines[at][0], []
    for d, line in reversed(lines[:at]):
        if d < depth:
            depth = d
            out.append(line[d:])
            if "HashAggregate" in line or "SortAggregate" in line:
                return out
    raise AssertionError("no sum")


@given
def test_bucketed_facts_reach_their_first_sum_without_an_exchange(merging):
    t = Tables(merging, FOLDER)
    final, samples, inventory, level = queries._stored_buckets(t)
    taxa = F.broadcast(t.taxa_groups)
    stored = rollup.Level(level, samples, taxa, inventory)
    name = {df: queries._STORED[merging.sparkContext.applicationId, FOLDER][k] for k, df in ((0, "final"), (3, "level"))}
    plans = [
        (ex.ftg_long(final, samples, taxa, inventory, sites=SITES_4, after=AFTER, corrections=FIXES, bucketed=True), name["final"]),
        (ex.index_zoop(final, samples, taxa, inventory, sites=SITES_18, corrections=FIXES, bucketed=True), name["final"]),
        (stored.ftg_long(sites=SITES_4, after=AFTER, corrections=FIXES), name["level"]),
        (stored.index_zoop(sites=SITES_18, corrections=FIXES), name["level"]),
    ]
    for df, table in plans:
        path = above_scan(df, table)
        assert any("Join" in line for line in path) and not any("Exchange" in line for line in path), path
    assert above_scan(stored.ftg_annual(year=1998, project="CORE", sites=SITES_4), name["level"])
    # Facts that don't lie in buckets are moved, which shows that the test would see it.
    plain = ex.ftg_long(t.zoop_final, t.sample_info, taxa, t.inventory, sites=SITES_4, after=AFTER, corrections=FIXES)
    assert any("Exchange" in line for line in above_scan(plain, "lineitem"))


@given
def test_exports_of_the_level_read_no_facts_and_only_their_years(spark):
    t = Tables(spark, FOLDER)
    stored = queries._level(t)
    names = queries._STORED[spark.sparkContext.applicationId, FOLDER]
    plan = stored.annual_report(sites=SITES_18, western=SITES_4, offsets={1998: 0.0})._jdf.queryExecution().executedPlan().toString()
    assert names[0] not in plan and "lineitem" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and names[3] in line]
    assert scans and all("year" in s.split("PartitionFilters: ")[1].split("]")[0] for s in scans)


def test_parts_merge_to_what_the_rows_give(spark, rows):
    data = [("a", "x", 1.0), ("a", "x", None), ("a", "y", 4.0), ("b", "x", None), ("b", "y", -2.5), ("b", "y", 2.5), (None, "x", 7.0)]
    df = spark.createDataFrame(data, "k string, s string, v double")
    fine = partial_sums(df, ["k", "s"], ["v"])
    assert measures_of(fine) == ["v"]
    got = merged_sums(merged_sums(fine, ["k", "s"]), ["k"]).select("k", "rows", total("v").alias("t"), mean("v").alias("m"), F.round(standard_error("v"), 9).alias("e"))
    assert rows(got) == rows(spark.createDataFrame([("a", 3, 5.0, 2.5, 1.5), ("b", 3, 0.0, 0.0, 2.5), (None, 1, 7.0, 7.0, None)], got.schema))
    assert merged_sums(fine.limit(0), ["k"]).count() == 0


def test_distinct_counts_merge(spark, rows):
    """Codes on both sides of a word's edge, repeats across groups, and a missing code."""
    data = [(k % 7, k % 3, k * 31 % 200) for k in range(900)] + [(0, 0, 63), (0, 0, 64), (6, 2, None), (9, 9, None)]
    coded = spark.createDataFrame(data, "sample int, year int, code int")
    fine = distinct_bits(coded, ["sample", "year"])
    for keys in (["sample", "year"], ["year"], []):
        want = coded.dropna().groupBy(*keys).agg(F.countDistinct("code").alias("n"))
        assert rows(bit_counts(merged_bits(fine, keys), keys)) == rows(want)
    plan = merged_bits(fine, ["year"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "ObjectHash" not in plan and "SortAggregate" not in plan
    names = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "x string")
    assert rows(integer_codes(names, "x")) == [("a", 0), ("b", 1)]


def test_refreshing_a_year_rewrites_that_year_alone(spark, tmp_path):
    table, path = f"level_{uuid.uuid4().hex}", str(tmp_path / "level")
    columns = "Sample_ID string, Genus_sp_lifestage string, Life_stage string, Number_counted double, Zoop_density double, Zoop_biomass double, Zoop_len_avg double, year int"
    taxa = taxa_groups(spark)

    def facts(*extra):
        base = [("a", "Keratella", "Older", 2.0, 1.0, 3.0, 0.5, 2019), ("a", "Keratella", "Younger", 1.0, 1.0, None, None, 2019), ("b", "Keratella", "Older", 5.0, 2.0, 1.0, 0.25, 2020)]
        return spark.createDataFrame([*base, *extra], columns)

    def files():
        return {(str(p.relative_to(path)), p.stat().st_mtime_ns) for p in (tmp_path / "level").rglob("*.parquet")}

    try:
        rollup.store_level(facts(), taxa, table, buckets=4, path=path)
        before = files()
        more = facts(("c", "Keratella", "Older", 9.0, 1.0, 1.0, 1.0, 2020))
        rollup.store_level(more, taxa, table, years=[2020], buckets=4, path=path)
        kept = {f for f in before if f[0].startswith("year=2019")}
        assert kept and kept <= files() and not ({f for f in before if f[0].startswith("year=2020")} & files())
        want = rollup.sample_level(more, taxa)
        order = ["Sample_ID", "Life_stage2"]
        spark.catalog.refreshTable(table)
        assert spark.table(table).select(*want.columns).orderBy(*order).collect() == want.orderBy(*order).collect()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_loaded_tables_lie_in_buckets_and_a_repeated_batch_replaces_itself(spark, tmp_path, cutoffs):  # noqa: F811
    database = f"survey_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{tmp_path / 'db'}'")
    (tmp_path / "in").mkdir()
    for name, day in {"a": "20200604", "b": "20210604"}.items():
        write_sheet(tmp_path / "in" / f"{name}.csv", sheet_lines({**HEADER, "Sample_ID": name, "Sample_date": day}, GOOD))
    try:
        for _ in range(2):
            ingest.load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), str(tmp_path / "w"), batch="june", database=database, buckets=4)
        # Another batch leaves this one as it is.
        write_sheet(tmp_path / "in" / "a.csv", sheet_lines({**HEADER, "Sample_ID": "c"}, GOOD))
        ingest.load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), str(tmp_path / "w"), batch="july", database=database, buckets=4)
        assert sorted(r.Sample_ID for r in spark.table(f"{database}.zoop_sample_info").collect()) == ["a", "b", "b", "c"]
        final, info = (spark.table(f"{database}.{n}").filter("batch = 'june'") for n in ("zoop_final", "zoop_sample_info"))
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
        assert info.count() == 2 and final.select("Sample_ID").distinct().count() == 2
        shown = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE FORMATTED {database}.zoop_final").collect()}
        assert shown["Num Buckets"] == "4" and "Sample_ID" in shown["Bucket Columns"]
        assert {p.name for p in (tmp_path / "w" / "zoop_final" / "batch=june").iterdir() if p.is_dir()} == {"year=2020", "year=2021"}
        counted = final.groupBy("Sample_ID").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"DROP DATABASE {database} CASCADE")


def test_plain_buckets_append(spark, tmp_path):
    table = f"plain_{uuid.uuid4().hex}"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "Sample_ID string, v int")
    try:
        for _ in range(2):
            append_bucketed(df, table, buckets=2, path=str(tmp_path / "plain"))
        assert spark.table(table).count() == 4
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
