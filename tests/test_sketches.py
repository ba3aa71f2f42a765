"""Sketches that merge, and profiles from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesurvey.operators.aggregates import profile_levels, profile_numeric
from lakesurvey.operators.sketches import level_sketch, levels_of_sketch, merged_number_sketch, number_sketch, profile_of_sketch, quantiles_of_sketch, value_bucket
from lakesurvey.plans import profiles
from lakesurvey.sources import append_table

INF, NAN = float("inf"), float("nan")


def test_buckets_keep_the_order_of_all_doubles(spark):
    values = [-INF, -1.7e308, -2.5, -2.4999, -1.0, -1e-300, -5e-324, 0.0, 5e-324, 1e-300, 0.1, 1.0, 1.0000001, 1024.0, 1.7e308, INF, NAN]
    got = {r.i: r.b for r in spark.createDataFrame(list(enumerate([*values, -0.0, None])), "i int, x double").select("i", value_bucket(F.col("x")).alias("b")).collect()}
    placed = [got[i] for i in range(len(values))]
    assert placed == sorted(placed) and placed[0] < placed[1] and placed[-2] < placed[-1] and placed[-3] < placed[-2]
    assert placed[6] < 0 == placed[7] < placed[8] and got[len(values)] == 0 and got[len(values) + 1] is None


def table(spark, n=4000):
    """Values close together, repeated, signed, missing, and a column without any; a third of the rows in one bucket."""
    rng = np.random.default_rng(4)
    near = np.where(rng.random(n) < 0.4, 1000 + rng.random(n) * 0.01, rng.normal(0, 50, n))
    rows = [(int(1996 + i % 3), float(a), float(i % 7) if i % 5 else None, None, "ab"[i % 2] if i % 11 else None) for i, a in enumerate(near)]
    return spark.createDataFrame(rows, "year int, near double, repeated double, none double, s string").repartition(7)


PROBS = (0.0, 0.25, 0.61, 1.0)


@pytest.mark.parametrize("resolution, n", [(1, 4000), (256, 4000), (256, 3)])
def test_quantiles_equal_those_of_all_values(spark, resolution, n):
    df, columns = table(spark, n).cache(), ["near", "repeated", "none"]
    sketch = merged_number_sketch(number_sketch(df, ["year"], columns, resolution=resolution))
    got = {r["column"]: list(r)[1:] for r in quantiles_of_sketch(sketch, df, columns, PROBS, resolution=resolution).collect()}
    values = df.toPandas()
    want = {c: [float(np.quantile(values[c].dropna(), p)) for p in PROBS] for c in columns[:2]}
    assert set(got) == set(want) and all(got[c] == pytest.approx(want[c], rel=1e-12) for c in want)


def test_profile_equals_that_of_the_rows(spark):
    df = table(spark)
    columns = ["near", "repeated", "none"]
    got, want = ({r["column"]: r for r in frame.collect()} for frame in (profile_of_sketch(number_sketch(df, ["year"], columns), df, columns), profile_numeric(df, columns)))
    assert set(got) == set(want) == set(columns)
    for c in columns:
        for name in ("n_missing", "min", "q25", "q50", "q75", "max"):
            assert got[c][name] == want[c][name], (c, name)
        assert got[c]["mean"] == (want[c]["mean"] and pytest.approx(want[c]["mean"], rel=1e-12))
    empty = df.limit(0)
    assert profile_of_sketch(number_sketch(empty, ["year"], columns), empty, columns).count() == 0


def test_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(x,) for x in (INF, -INF, NAN, 2.0, 3.0)], "x double")
    got = profile_of_sketch(number_sketch(df, [], ["x"]), df, ["x"]).first()
    assert (got["min"], got.q25, got.q50, got.q75) == (-INF, 2.0, 3.0, INF) and np.isnan(got["max"]) and np.isnan(got["mean"])


def test_levels_merge(spark, rows):
    df = table(spark).withColumn("year", F.when(F.col("year") == 1996, None).otherwise(F.col("year")))
    for top in (2, 3, 10):
        got = levels_of_sketch(level_sketch(df, ["year"], ["s", "repeated"]), top=top)
        assert rows(got) == rows(profile_levels(df, ["s", "repeated"], top=top), *got.columns)


def test_stored_profile_reads_the_rows_once_and_only_its_years(spark, tmp_path, rows):
    df, facts, folder = table(spark), str(tmp_path / "facts"), str(tmp_path / "sketches")
    append_table(df, facts, partition="year")
    final = spark.read.parquet(facts)
    profiles.store_sketches(final, folder, ["near", "repeated"], ["s"])
    got = profiles.stored_profile(final, folder, ["near", "repeated"], years=[1997, 1998])
    found = {tuple(r[c] for c in ("column", "q25", "q50", "q75")) for r in got.collect()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/facts" in line]
    assert len(scans) == 1 and "year" in scans[0].split("PartitionFilters: ")[1].split("]")[0]
    values = df.filter("year > 1996").toPandas()
    for c, *quartiles in found:
        assert quartiles == pytest.approx([float(np.quantile(values[c].dropna(), p)) for p in (0.25, 0.5, 0.75)], rel=1e-12)
    assert len(found) == 2
    plan = profiles.stored_levels(spark, folder, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "/facts" not in plan


def test_a_batch_refreshes_its_years_alone(spark, tmp_path):
    df, folder = table(spark), str(tmp_path / "sketches")
    profiles.store_sketches(df, folder, ["near"], ["s"])

    def files():
        return {(str(p.relative_to(folder)), p.stat().st_mtime_ns) for p in (tmp_path / "sketches").rglob("*.parquet")}

    before = files()
    more = df.unionByName(spark.createDataFrame([(1998, 1e6, 1.0, None, "z")], df.schema))
    profiles.store_sketches(more, folder, ["near"], ["s"], years=[1998])
    kept = {f for f in before if "year=1998" not in f[0]}
    assert kept and kept <= files() and not (before - kept) & files()
    assert profiles.stored_profile(more, folder, ["near"]).first()["max"] == 1e6
    assert profiles.stored_levels(spark, folder, ["s"], years=[1998]).filter("level = 'z'").first().n == 1
