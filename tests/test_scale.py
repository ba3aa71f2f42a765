"""Behaviour that only shows at scale: hot keys, partition pruning, co-located joins, plan shapes."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from lakesurvey.operators import joins, windows
from lakesurvey.operators.aggregates import profile_levels
from lakesurvey.plans import exports as ex
from lakesurvey.plans import requests as rq
from lakesurvey.sources import append_bucketed, append_table

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def shrunk(spark):
    """Thresholds scaled down with the data, so that run-time splitting can be seen locally."""
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=200_000):
    """A third of the rows under one key."""
    ids = spark.range(0, n, 1, 8)
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string")))
    return ids.select(key.alias("k"), (F.col("id") % 97).cast("double").alias("v"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))


def executed(df):
    """Run a frame to the end and return its rows and its final plan."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("null_keys", [True, False])
def test_hot_key_is_split_in_joins(shrunk, null_keys):
    facts = hot(shrunk)
    dim = facts.select("k").distinct().withColumn("label", F.upper("k"))
    # The aggregate right after the join would like whole keys per task; the split is still made.
    out = joins.left_join(facts, dim, "k", null_keys=null_keys).groupBy("k").agg(F.count("pad").alias("n"), F.max("label").alias("label"))
    rows, plan = executed(out)
    assert "skew=true" in plan
    assert {r.k: r.n for r in rows}["hot"] == 66_667 and sum(r.n for r in rows) == 200_000
    assert all(r.label == r.k.upper() for r in rows)


def test_hot_sample_and_hot_taxon_are_split_in_an_export(shrunk):
    ids = shrunk.range(0, 120_000, 1, 8)
    sample = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 3000).cast("string")))
    taxon = F.when(F.col("id") % 3 == 1, "T_hot").otherwise(F.concat(F.lit("T"), (F.col("id") % 3000).cast("string")))
    final = ids.select(
        sample.alias("Sample_ID"), taxon.alias("Genus_sp_lifestage"), F.lit("Older").alias("Life_stage"), F.lit(1.0).alias("Number_counted"),
        F.lit(1.0).alias("Zoop_density"), F.rand(1).alias("Zoop_biomass"), F.rand(2).alias("Zoop_len_avg"))
    info = final.select("Sample_ID").distinct().select(
        "Sample_ID", F.lit(dt.date(2005, 5, 5)).alias("Sample_date"), F.lit("x").alias("Sample_site"), F.lit("CORE").alias("Project"),
        F.lit(1.0).alias("Subsampled_vol_mL"), F.lit(1.0).alias("Diluted_vol_mL"))
    inventory = info.select(
        "Sample_ID", "Sample_date", "Sample_site", F.lit(0.0).alias("Meter_1"), F.lit(1.0).alias("Meter_2"), F.lit(0.0).alias("Meter_B1"),
        F.lit(0.0).alias("Meter_B2"), F.lit(5.2765).alias("Vol_sampled_L"))
    taxa = final.select("Genus_sp_lifestage").distinct().withColumns({"Life_stage": F.lit("Older"), "Order1": F.lit("Cladocera")})
    out = ex.corrected_counts(final, info, taxa, inventory, sites=["x"])
    rows, plan = executed(out.select("Sample_ID", "Genus_sp_lifestage", "Order1", "density_computed_volume"))
    assert plan.split("Initial Plan")[0].count("skew=true") >= 2
    assert len(rows) == 120_000 and {r.Order1 for r in rows} == {"Cladocera"}
    assert {round(r.density_computed_volume, 9) for r in rows} == {round(1 / 5.2765, 9)}


def test_hot_group_summary_is_split(shrunk):
    out = joins.attach_summary(hot(shrunk), ["k"], {"m": F.avg("v"), "n": F.count(F.lit(1))})
    rows, plan = executed(out.select("k", "m", "n"))
    assert "Window" not in plan and "skew=true" in plan
    assert len(rows) == 200_000 and {r.n for r in rows if r.k == "hot"} == {66_667}


def test_no_task_of_a_duplicate_flag_holds_a_hot_key(spark):
    """The largest window group is a share of one input task, not the group."""
    df = windows.flag_duplicates(hot(spark), ["k"], ["v", "pad"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    parts = [p.split("), ")[0] for p in plan.split("hashpartitioning(")[1:]]
    assert len(parts) == 2 and "__salt" in parts[0] + parts[1] and all(p.count("#") >= 2 for p in parts), parts
    assert df.filter("not dups").count() == df.select("k").distinct().count()


def test_a_duplicate_flag_splits_a_key_that_lies_in_one_task(spark):
    """Input already dealt out by the key: the parts of the hot group still go to many tasks."""
    df = hot(spark).repartition(8, "k")
    keyed = df.select("k", F.pmod(F.xxhash64(F.spark_partition_id(), *[c for c in df.columns if c != "k"]), F.lit(256)).alias("salt"))
    sizes = [r["count"] for r in keyed.filter("k = 'hot'").groupBy("salt").count().collect()]
    assert max(sizes) < 0.02 * sum(sizes)
    flagged = windows.flag_duplicates(df, ["k"], ["v", "pad"])
    assert flagged.filter("not dups").count() == df.select("k").distinct().count()


def test_level_ranks_are_limited_before_the_shuffle(spark):
    plan = profile_levels(hot(spark), ["k"], top=10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.fixture
def stored(spark, tmp_path):
    samples = [(f"s{y}{i}", dt.date(y, 6, i + 1), "27-918", "CORE", 5.0, 500.0) for y in range(1996, 2006) for i in range(3)]
    info = spark.createDataFrame(samples, "Sample_ID string, Sample_date date, Sample_site string, Project string, Subsampled_vol_mL double, Diluted_vol_mL double")
    inventory = info.select("Sample_ID", "Sample_date", "Sample_site", F.lit(0.0).alias("Meter_1"), F.lit(100.0).alias("Meter_2"),
                            F.lit(0.0).alias("Meter_B1"), F.lit(0.0).alias("Meter_B2"), F.lit(527.65).alias("Vol_sampled_L"))
    final = info.select("Sample_ID", F.lit("A").alias("Genus_sp_lifestage"), F.lit("Older").alias("Life_stage"), F.lit(10.0).alias("Number_counted"),
                        F.lit(1.0).alias("Zoop_density"), F.lit(2.0).alias("Zoop_biomass"), F.lit(0.5).alias("Zoop_len_avg"), F.year("Sample_date").alias("year"))
    taxa = spark.createDataFrame([("A", "Older", "Cladocera", "Aa", 1, "g")],
                                 "Genus_sp_lifestage string, Life_stage string, Order1 string, Genus_sp_95toPresent string, biop_152_codes int, biop_152_names string")
    append_table(final, str(tmp_path / "final"), partition="year")
    return spark.read.parquet(str(tmp_path / "final")), info, inventory, taxa


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [p for p in re.findall(r"PartitionFilters: \[([^\]]*)\]", plan) if p]


def test_exports_skip_years_of_the_stored_facts(stored):
    final, info, inventory, taxa = stored
    long = ex.ftg_long(final, info, taxa, inventory, sites=["27-918"])
    assert any("year" in p and "2001" in p for p in partition_filters(long))
    assert long.count() == 15  # samples after 1 January 2001
    unpartitioned = ex.ftg_long(final.drop("year"), info, taxa, inventory, sites=["27-918"])
    assert sorted(map(tuple, long.collect())) == sorted(map(tuple, unpartitioned.collect()))
    one = ex.ftg_annual(final, info, taxa, inventory, year=2003, project="CORE", sites=["27-918"], volumes_after=dt.date(2002, 1, 1))
    assert any("2003" in p for p in partition_filters(one)) and one.count() == 3
    request = rq.foia_zoop(final, info, taxa, exclude_projects=["X"], before=dt.date(2004, 1, 1))
    assert any("2001" in p and "2004" in p for p in partition_filters(request)) and request.count() == 9


def test_bucketed_tables_join_and_group_without_a_shuffle(spark, stored, tmp_path):
    final, info, _, _ = stored
    for name, df in (("facts_b", final), ("samples_b", info)):
        append_bucketed(df, name, buckets=4, path=str(tmp_path / name))
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, "-1")
        joined = joins.left_join(spark.table("facts_b"), spark.table("samples_b"), "Sample_ID", null_keys=False, split_hot=False)
        out = joined.groupBy("Sample_ID", "Sample_site").agg(F.sum("Number_counted").alias("n"))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == 30
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        for name in ("facts_b", "samples_b"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
