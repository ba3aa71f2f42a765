"""Large files, layouts by sheet, and buckets that grow with the facts."""

import random

import catalog.exports as exports
from catalog.domain import _measured
from catalog.registry import QUERIES
from catalog.views import Tables
from lakesurvey import schemas
from lakesurvey.operators.joins import attach_cutoffs, in_use, join_within, left_join
from lakesurvey.operators.reshape import unpivot_measurements
from lakesurvey.sources import scan_datasheets

FOLDER = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_read_by_lines_give_what_whole_files_give(spark, tmp_path, rows):
    draw = random.Random(3)
    header = ",".join(["Seen", *schemas.SHEET.names[::-1]])
    cells = ["", "7", "NA", 'a"b', '"x, y"', '"say ""so"""', '"two\nlines"', '"three\r\n""\nlines"', '""']
    for n, (end, odd) in enumerate([("\n", False), ("\r\n", True), ("\r", True), ("\n", True), ("\n", True)]):
        lines = [",".join(draw.choice(cells if odd else cells[:6]) for _ in range(27)) for _ in range(60)]
        if n == 4:
            lines[50] = 'open,"never closed, 1'
            lines[51:] = ["1,2,3"] * 9
        text = ("﻿\n" if n == 3 else "﻿" if n == 1 else "") + end.join([header, *lines[:30], "", *lines[30:]])
        (tmp_path / f"{n}.csv").write_bytes(text.encode())
    (tmp_path / "header.csv").write_text(header + "\n")
    expected = rows(scan_datasheets(spark, str(tmp_path), column_report=True))
    assert len(expected) > 250
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        assert rows(scan_datasheets(spark, str(tmp_path), column_report=True, whole_bytes=10)) == expected
        by_lines = plan_of(scan_datasheets(spark, str(tmp_path), whole_bytes=10))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "Scan text" in by_lines


def test_wide_rows_of_sheets_are_not_shuffled(spark):
    t = Tables(spark, FOLDER)
    for name in ("d2_length_to_mm", "d4_stage_proportions", "d5_allocate_counts", "d6_expand_stage_rows", "r2_unpivot_measurements", "f8_conversions"):
        for line in plan_of(QUERIES[name](spark, FOLDER)).splitlines():
            # By the taxon alone go the cutoffs.
            assert "Exchange hashpartitioning" not in line or "REPARTITION_BY_NUM" in line or "hashpartitioning(Genus" in line, (name, line)
    assert "Exchange hashpartitioning(source_file" in plan_of(_measured(t))


def test_more_facts_have_more_buckets(spark, monkeypatch):
    t = Tables(spark, FOLDER)
    few = exports._buckets(t)
    monkeypatch.setattr(exports, "BUCKET_BYTES", 1000)
    assert few == exports.BUCKETS < exports._buckets(t)


def test_missing_keys_within_a_layout_match(spark, rows):
    a = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate([("x", "p"), ("x", None), (None, "p"), (None, None), ("y", "p"), ("x", "p")])], "k string, t string, a int")
    b = spark.createDataFrame([("x", "p", 1), ("x", None, 2), (None, "p", 3), (None, None, 4), ("x", "p", 5)], "k string, t string, b int")
    assert rows(join_within(a, b, "k", ["t"])) == rows(left_join(a, b, ["k", "t"]))


def test_a_dimension_in_use_gives_what_the_whole_one_gives(spark, rows):
    a = spark.createDataFrame([("p",), ("q",), (None,), ("q",)], "Genus_sp_lifestage string")
    b = spark.createDataFrame([("q", 1.0), ("q", 2.0), (None, 3.0), ("z", 4.0)], "Genus_sp_lifestage string, Length_cutoff double")
    assert rows(in_use(b, a)) == rows(b.filter("Length_cutoff < 4"))
    assert rows(attach_cutoffs(a, in_use(b, a))) == rows(attach_cutoffs(a, b))


def test_cells_are_parsed_before_empty_ones_are_dropped(spark, rows):
    df = spark.createDataFrame([("s", "1", None, "x")], "id string, a string, b string, c string")
    got = unpivot_measurements(df, ["id"], ["a", "b", "c"], name="n", value="v", parse=lambda c: c.try_cast("double"))
    assert rows(got) == [("s", "a", 1.0)]
