"""Work on sheets is compiled and lies by sheet: no sort, no interpreted function over cells, no table looked at twice in full."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from catalog import QUERIES
from lakesurvey import schemas
from lakesurvey.functions import to_number
from lakesurvey.operators import datasheet as ds
from lakesurvey.operators.reshape import unpivot_measurements
from lakesurvey.sources import scan_datasheets, write_csv

HEADERS = StructType([StructField("source_file", StringType()), StructField("mm_per_ocular_unit", DoubleType())])
TAXA = [("T1_w_eggs", ["10", "40", "junk"]), ("T2_eggs", ["3", None, "12d"]), ("T3_eggs_immature", ["7"]), ("T4_nauplii", ["NaN", "2"]), (None, ["5"]), ("T6", []), ("T7", ["no"])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """Tables of a few orders and parts, and no broadcast of what isn't tiny."""
    orders = spark.range(40).selectExpr(
        "id AS o_orderkey", "id % 7 AS o_custkey", "IF(id % 2 = 0, 'F', 'O') AS o_orderstatus", "CAST(id AS DOUBLE) AS o_totalprice",
        "CAST(DATE'1998-01-01' + CAST(id AS INT) AS TIMESTAMP_NTZ) AS o_orderdate", "'5-LOW' AS o_orderpriority")
    parts = spark.range(200).selectExpr(
        "id AS p_partkey", "'part' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "CAST(id % 50 AS INT) AS p_size", "1.0D AS p_retailprice")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    yield str(tmp_path)
    for k, v in kept.items():
        spark.conf.set(k, v)


def sheets(spark):
    cells = lambda values: [*values, *[None] * (20 - len(values))]
    rows = [(None, None, "a", taxon, "4", *cells(values), sheet) for sheet in ("one", "two") for taxon, values in TAXA]
    return spark.createDataFrame(rows, StructType([*schemas.SHEET.fields, StructField("source_file", StringType())]))


def headers(spark):
    return spark.createDataFrame([("one", 0.5), ("two", None)], HEADERS)


def cutoffs(spark):
    return spark.createDataFrame([(10.0, "T1_w_eggs")], "Length_cutoff double, Genus_sp_lifestage string")


@pytest.mark.parametrize("name", ["d2_length_to_mm", "d3_stage_by_length", "d9_split_eggs", "q02_zoop_final", "d13_qa_measured_counts", "d15_qa_status", "q01_ingest_sheets_status"])
def test_lengths_are_neither_sorted_nor_interpreted(spark, folder, name):
    df = QUERIES[name](spark, folder)
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        spark.conf.set(k, "-1")
    plan = plan_of(df.select("*"))
    assert "ShuffledHashJoin [source_file" in plan and "SortMergeJoin [source_file" not in plan and "lambda" not in plan
    assert df.count()


def test_cells_give_the_same_rows_for_every_way_to_drop_them(spark, rows):
    df = spark.createDataFrame([(1, "5", None, "x"), (2, None, None, None), (3, "", "1e3", " 7 ")], "id int, L1 string, L2 string, L3 string")
    take = lambda **how: rows(unpivot_measurements(df, ["id"], ["L1", "L2", "L3"], name="n", value="v", **how))
    assert take(parse=to_number) == [(1, "L1", 5.0), (3, "L2", 1000.0), (3, "L3", 7.0)]
    assert take() == [(1, "L1", "5"), (1, "L3", "x"), (3, "L1", ""), (3, "L2", "1e3"), (3, "L3", " 7 ")]
    assert len(take(keep_null=True, parse=to_number)) == len(take(keep_null=True)) == 9


def test_numbers_with_letters_are_told_from_others(spark):
    texts = {"5": 5.0, "-.5": -0.5, "1e5": 1e5, "1E-2": 0.01, "12d": None, "12F": None, "3f ": None, "0x1p3": None, "NaN": None, "nan": None, "Infinity": None, "-inf": None,
             "1e999": None, "9" * 400: None, "٣": None, "": None, "+": None, "1 2": None, " 7\t": 7.0, "é": None, None: None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_number("t").alias("v")).collect()
    assert {r.t: r.v for r in got} == texts


def test_eggs_by_name_are_the_same_eggs(spark, rows):
    lengths = ds.sheet_lengths(sheets(spark), headers(spark), cutoffs(spark))
    eggs, named = ds.split_eggs(lengths)[1], ds.split_eggs(lengths, by_name=True)[1]
    assert rows(named) == rows(eggs) and {r.Genus_sp_lifestage for r in named.collect()} == {"T2_eggs"}
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "'_eggs'" in plan.split("Generate")[-1] or "_eggs)" in plan.split("Generate")[-1]


def test_shares_count_measured_cells(spark, rows):
    """Cells that are no numbers, and sheets without a scale, are not measured; a taxon without measured cells has null shares."""
    every = ds.stage_proportions(sheets(spark), headers(spark), cutoffs(spark))
    some = ds.stage_proportions(sheets(spark), headers(spark), cutoffs(spark), measured_only=True)
    got = {(r.source_file, r.Genus_sp_lifestage): (r.Prop_O, r.Prop_Y) for r in every.collect()}
    assert got == {("one", "T1_w_eggs"): (0.5, 0.5), ("one", None): (1.0, 0.0), **{("one", t): (None, None) for t in ("T6", "T7")},
                   **{("two", t): (None, None) for t in ("T1_w_eggs", None, "T6", "T7")}}
    measured = {k: v for k, v in got.items() if v[0] is not None}
    assert {(r.source_file, r.Genus_sp_lifestage): (r.Prop_O, r.Prop_Y) for r in some.collect() if r.Prop_O is not None} == measured


@pytest.mark.parametrize("whole_bytes", [1 << 20, 1])
def test_compressed_files_hold_the_same_sheets(spark, rows, tmp_path, whole_bytes):
    """Read whole or by lines; plain and packed files are told apart by their names."""
    frame = sheets(spark).drop("source_file").withColumn("Value", F.lit('a "quoted", cell')).withColumn("Sample_ID", F.col("Genus_sp_lifestage"))
    for name, compressed in (("plain", False), ("packed", True)):
        write_csv(frame.coalesce(1), f"{tmp_path}/{name}", compressed=compressed)
    packed = scan_datasheets(spark, f"{tmp_path}/packed", "*.csv.gz", whole_bytes=whole_bytes, column_report=True).drop("source_file")
    plain = scan_datasheets(spark, f"{tmp_path}/plain", whole_bytes=whole_bytes, column_report=True).drop("source_file")
    assert rows(packed) == rows(plain) and packed.count() == frame.count()
    assert rows(packed.select(*frame.columns)) == rows(frame.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in frame.columns}))


def test_a_packed_byte_counts_for_several(spark, tmp_path):
    write_csv(sheets(spark).drop("source_file").coalesce(1), f"{tmp_path}/packed", compressed=True)
    size = next(p.stat().st_size for p in tmp_path.glob("packed/*.csv.gz"))
    scan = scan_datasheets(spark, f"{tmp_path}/packed", "*.csv.gz", whole_bytes=4 * size)
    assert "Union" in plan_of(scan) and scan.count() == 2 * len(TAXA)


def test_derived_sheet_files_are_packed(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr("catalog.basic.shared_folder", lambda spark, label: written.append(f"{folder}/{label}-{len(written)}") or written[-1])
    for name in ("s1_scan_datasheets", "s1_scan_by_header"):
        assert QUERIES[name](spark, folder).count()
    files = [p.name for path in written if "sheet" in path for p in Path(path).rglob("part-*")]
    assert files and all(f.endswith(".csv.gz") for f in files)
