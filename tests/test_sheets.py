"""Hand-entered sheets from files to tables, with the odd things such files contain."""

import csv

import pytest
from pyspark.sql import functions as F

from lakesurvey import schemas
from lakesurvey.operators.datasheet import sheet_headers, stage_residuals, sheet_counts
from lakesurvey.plans import ingest
from lakesurvey.plans.ingest import ingest_sheets, load_folder, zoop_final
from lakesurvey.sources import read_dimension, scan_datasheets, write_csv

HEADER = {
    "Sample_ID": "20200604-16-970", "Sample_date": "20200604", "Sample_time": "", "Sample_site": "16-970", "Water_body": "Lake",
    "Project": "CORE", "Latitude": "", "Longitude": "NA", "Depth_m": "8.5", "Surface_temp": "20", "Bottom_temp": "junk", "Ave_temp": "19",
    "Surface_DO": "8", "Bottom_DO": "7", "Net_diameter_m": "0.5", "Meter_1": "1000", "Meter_2": "1345", "Revolutions": "345",
    "Secchi_depth_m": "1.5", "Date_counted": "20201102", "Counter_name": "AA", "Microscope_number": "2", "mm_per_ocular_unit": "0.0185",
    "Subsampled_vol_mL": "6", "Diluted_vol_mL": "1800", "Comments": "",
}
# taxon, number counted, measurements
TAXA = [
    ("D_thomasi_wo_eggs", "45", [40] * 19 + [10]),
    ("L_minutus_wo_eggs", "5", [36, 36, 60, 60]),  # 36 units are just under the cutoff of 0.666 mm
    ("S_oregonensis_w_eggs", "8", []),  # counted, never measured
    ("Calanoida_immature", "7", [12, 14]),
    ("Cyclopoida_nauplii", "9", [5, 6]),
    ("Dreissena_veligers", "11", [4, 5]),
    ("B_longirostris_eggs", "20", [3, 2]),
    ("B_longirostris_w_eggs", "2", [15]),
    ("Harpacticoida_adult", "3", [30]),
    ("Keratella", "", []),
]
GOOD = [t for t in TAXA if t[0] != "S_oregonensis_w_eggs"]
CUTOFFS = [("0.555", "D_thomasi_wo_eggs"), ("0.666", "L_minutus_wo_eggs"), ("0.6", "S_oregonensis_w_eggs")]


def sheet_lines(header, taxa, sample=None):
    lines = [["Information", "Value", "Sample_ID", "Genus_sp_lifestage", "Number_counted", *schemas.LENGTH_CELLS]]
    pairs = list(header.items())
    for i in range(max(len(pairs), len(taxa))):
        info = list(pairs[i]) if i < len(pairs) else ["", ""]
        if i < len(taxa):
            name, n, cells = taxa[i]
        else:
            name, n, cells = f"Filler_{i}", "", []
        cells = [str(c) for c in cells] + [""] * (20 - len(cells))
        lines.append([*info, sample or header["Sample_ID"], name, n, *cells])
    return lines


def write_sheet(path, lines, newline="\n"):
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=newline).writerows(lines)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "WB").mkdir()
    (tmp_path / "CB").mkdir()
    write_sheet(tmp_path / "WB" / "20200604_16-970.csv", sheet_lines(HEADER, TAXA))
    # Bare carriage returns, and an id that repeats that of another file.
    write_sheet(tmp_path / "WB" / "20200714_36-873.csv", sheet_lines({**HEADER, "Sample_site": "36-873", "Sample_date": "20210714"}, TAXA), newline="\r")
    # A stray 26th column.
    wide = [row + ["stray" if i == 3 else ""] for i, row in enumerate(sheet_lines({**HEADER, "Sample_ID": "s3", "Sample_site": "x"}, TAXA))]
    write_sheet(tmp_path / "CB" / "20200812_1281_5m.csv", wide)
    (tmp_path / "CB" / "notes.txt").write_text("not a sheet")
    return str(tmp_path)


@pytest.fixture
def cutoffs(spark, tmp_path):
    path = tmp_path / "cutoffs.dat"
    path.write_text("Length_cutoff,Genus_sp_lifestage\r\n" + "".join(f"{c},{t}\r\n" for c, t in CUTOFFS))
    return read_dimension(spark, str(path), schemas.CUTOFFS)


def taxa_groups(spark):
    names = [t[0] for t in TAXA]
    data = [
        (n, s, None, None, None, None, None, None, None, None, None, 2.0, 1.5, 0.3 if n == "Harpacticoida_adult" else None, 1.0, None if n == "B_longirostris_w_eggs" else 1.2, 0.1, 0.9, 1.05)
        for n in names for s in ("Older", "Younger", "Nauplii", "Veliger", "Egg")
    ]
    return spark.createDataFrame(data + data[:3], schemas.TAXA_GROUPS)  # a few rows repeated


def test_scan(spark, folder):
    raw = scan_datasheets(spark, folder)
    assert raw.columns == [*schemas.SHEET.names, "source_file"]
    assert {r.n for r in raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("n")).collect()} == {26}
    assert raw.select("source_file").distinct().count() == 3
    assert raw.filter("Value = ''  or Value = 'NA'").count() == 0


def test_columns_are_taken_by_the_header_of_their_own_file(spark, tmp_path, cutoffs, rows):
    """Swapped, missing, unknown, repeated and padded columns; each sheet gives what it would give in the usual order."""
    (tmp_path / "in").mkdir()
    usual = sheet_lines({**HEADER, "Sample_ID": "s", "Comments": 'a "b", c'}, GOOD)

    def picked(names):
        places = [usual[0].index(n) if n in usual[0] else None for n in names]
        return [names] + [["?" if p is None else row[p] for p in places] for row in usual[1:]]

    swapped = [*usual[0][:3], "Number_counted", "Genus_sp_lifestage", *usual[0][5:]]
    sheets = {
        "usual": usual, "swapped": picked(swapped), "extra": picked(["Seen, by", *reversed(usual[0])]),
        "short": picked([n for n in usual[0] if n not in ("L20", "Value")]), "twice": picked([*usual[0], "Number_counted"]),
    }
    for name, lines in sheets.items():
        write_sheet(tmp_path / "in" / f"{name}.csv", lines, newline="\r\n" if name == "extra" else "\n")
    text = (tmp_path / "in" / "swapped.csv").read_bytes()
    (tmp_path / "in" / "swapped.csv").write_bytes(b"\xef\xbb\xbf" + text.replace(b"Information,Value", b" Information ,Value", 1) + b"\n\n")
    (tmp_path / "in" / "empty.csv").write_text("")
    raw = scan_datasheets(spark, str(tmp_path / "in"), column_report=True)
    own = {n: rows(raw.filter(F.col("source_file").endswith(f"/{n}.csv")), *schemas.SHEET.names) for n in sheets}
    assert len(own["usual"]) == 26 and own["swapped"] == own["extra"] == own["twice"] == own["usual"]
    assert own["short"] == sorted([(r[0], None, *r[2:24], None) for r in own["usual"]], key=lambda t: tuple((v is None, str(v)) for v in t))
    report = {r.source_file.rsplit("/", 1)[1][:-4]: (r.missing_columns, r.unknown_columns) for r in raw.select("source_file", "missing_columns", "unknown_columns").distinct().collect()}
    assert report == {"usual": (None, None), "swapped": (None, None), "extra": (None, "Seen, by"), "short": ("Value, L20", None), "twice": (None, None)}
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan text") == 1 and "Exchange" not in plan
    status = {r.source_file.rsplit("/", 1)[1][:-4]: r for r in load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), str(tmp_path / "w")).collect()}
    assert {n: r.ok for n, r in status.items()} == {"usual": True, "swapped": True, "extra": True, "short": False, "twice": True}
    assert "no column Value, L20" in status["short"].status and status["extra"].status.endswith("Unknown columns: Seen, by.")


@pytest.mark.parametrize("line", ['a,"b', 'a"b,c', '"a""",b', '"x"y,z', ',,', '"a,\nb",c', ' , "q",'])
def test_odd_cells_stay_in_their_own_row(spark, tmp_path, line):
    (tmp_path / "odd.csv").write_text("Information,Value\n" + line + "\nlast,row\n")
    got = [(r.Information, r.Value) for r in scan_datasheets(spark, str(tmp_path)).collect()]
    want = {'a,"b': ("a", '"b'), 'a"b,c': ('a"b', "c"), '"a""",b': ('a"', "b"), '"x"y,z': ("xy", "z"), ",,": (None, None), '"a,\nb",c': ("a,\nb", "c"), ' , "q",': (" ", ' "q"')}
    assert got == [want[line], ("last", "row")]


def test_headers(spark, folder):
    h = {r.source_file.rsplit("/", 1)[1]: r for r in sheet_headers(scan_datasheets(spark, folder)).collect()}
    r = h["20200604_16-970.csv"]
    assert (r.Sample_ID, str(r.Sample_date), r.Sample_time, r.Latitude, r.Depth_m, r.Bottom_temp, r.mm_per_ocular_unit) == (
        "20200604-16-970", "2020-06-04", None, None, 8.5, None, 0.0185)
    assert str(h["20200714_36-873.csv"].Sample_date) == "2021-07-14"


def test_ingest(spark, folder, cutoffs, rows):
    done = ingest_sheets(scan_datasheets(spark, folder), cutoffs)
    one = F.col("source_file").endswith("20200604_16-970.csv")
    got = {(r.Genus_sp_lifestage, r.Life_stage): r for r in done.counts.filter(one).collect()}
    count = {k: v.Number_counted for k, v in got.items() if not k[0].startswith("Filler")}
    assert count == {
        ("D_thomasi_wo_eggs", "Younger"): 2.0, ("D_thomasi_wo_eggs", "Older"): 43.0,
        ("L_minutus_wo_eggs", "Younger"): 2.0, ("L_minutus_wo_eggs", "Older"): 2.0,  # 2.5 and 2.5, both to even
        ("S_oregonensis_w_eggs", "Younger"): 0.0, ("S_oregonensis_w_eggs", "Older"): 0.0,
        ("Calanoida_immature", "Younger"): 7.0, ("Cyclopoida_nauplii", "Nauplii"): 9.0, ("Dreissena_veligers", "Veliger"): 11.0,
        ("B_longirostris_eggs", "Egg"): 20.0, ("B_longirostris_w_eggs", "Older"): 2.0,
        ("Harpacticoida_adult", "Older"): 3.0, ("Keratella", "Older"): 0.0,
    }
    # 345 turns through the standard net are 1.8204 m3: the two volume formulas agree.
    litres = 3.141592653589793 * 0.5**2 / 4 * (345 * 26873 / 999999) * 1000
    assert litres == pytest.approx(345 * 5.2765, rel=1e-4)
    assert got["D_thomasi_wo_eggs", "Older"].Zoop_density == pytest.approx(43 * 1800 / (6 * litres), abs=1e-10)
    stages = dict(done.measured.filter(one).groupBy("Life_stage").count().collect())
    assert stages == {"Older": 19 + 2 + 1 + 1, "Younger": 1 + 2 + 2, "Nauplii": 2, "Veliger": 2, "Egg": 2}
    assert done.eggs.filter(one).agg(F.sum("Number_eggs")).first()[0] == 5.0
    # The unmeasured taxon loses its count in both stages; the check reports the sheet.
    assert {r.status for r in done.status.collect()} == {"Species counts NOT OK"}
    lost = {(r.Genus_sp_lifestage, r.residual) for r in stage_residuals(sheet_counts(scan_datasheets(spark, folder)).filter(one), done.counts).collect()}
    assert lost == {("S_oregonensis_w_eggs", 8.0), ("L_minutus_wo_eggs", 1.0)}


def test_zoop_final(spark, folder, cutoffs):
    done = ingest_sheets(scan_datasheets(spark, folder), cutoffs)
    got = {(r.Genus_sp_lifestage, r.Life_stage): r for r in zoop_final(done, taxa_groups(spark)).filter(F.col("source_file").endswith("20200604_16-970.csv")).collect()}
    assert len(got) == done.counts.filter(F.col("source_file").endswith("20200604_16-970.csv")).count()
    thomasi, adult = got["D_thomasi_wo_eggs", "Older"], got["Harpacticoida_adult", "Older"]
    mass = 2.0 * (40 * 0.0185) ** 1.5
    assert thomasi.Zoop_biomass == pytest.approx(thomasi.Zoop_density * mass)
    assert thomasi.Zoop_P_exc == pytest.approx(0.022387 * mass**0.54 * thomasi.Zoop_density)
    assert thomasi.Zoop_N_exc == pytest.approx(0.041686938 * mass**0.67 * thomasi.Zoop_density)
    assert thomasi.Zoop_prod == pytest.approx(0.1 * thomasi.Zoop_biomass**0.9 * 1.05**20)
    assert thomasi.Zoop_len_avg == pytest.approx(40 * 0.0185)
    assert adult.Zoop_biomass == pytest.approx(adult.Zoop_density * 0.3)  # a stated mass wins over the measured one
    veliger = got["Dreissena_veligers", "Veliger"]
    assert veliger.Zoop_FR1 == pytest.approx((-0.0602 + 0.714 * 4.5 * 0.0185) * veliger.Zoop_density)
    assert got["B_longirostris_w_eggs", "Older"].Zoop_FR1 is None  # filtration mean is strict
    egg = got["B_longirostris_eggs", "Egg"]
    assert (egg.Zoop_density, egg.Zoop_biomass, egg.Zoop_prod) == (None, 0.0, 0.0)
    empty = got["S_oregonensis_w_eggs", "Older"]
    assert (empty.Zoop_biomass, empty.Zoop_P_exc, empty.Zoop_prod) == (0.0, 0.0, 0.0)


def test_load_folder(spark, folder, cutoffs, tmp_path):
    write_sheet(tmp_path / "CB" / "good.csv", sheet_lines({**HEADER, "Sample_ID": "good"}, [t for t in TAXA if t[0] != "S_oregonensis_w_eggs"]))
    warehouse = str(tmp_path / "warehouse")
    status = load_folder(spark, folder, cutoffs, taxa_groups(spark), warehouse)
    assert sorted(r.ok for r in status.collect()) == [False, False, False, True]
    stored = {n: spark.read.parquet(f"{warehouse}/{n}") for n in
              ("zoop_sample_info", "sample_inventory", "zoop_counts", "zoop_lengths", "zoop_egg_counts", "zoop_final")}
    assert {n: df.select("Sample_ID").distinct().collect()[0][0] for n, df in stored.items()} == dict.fromkeys(stored, "good")
    assert stored["zoop_final"].columns == [*schemas.FINAL.names, "batch", "year"]
    assert stored["zoop_sample_info"].first().year == 2020
    assert spark.read.parquet(f"{warehouse}/raw_entered").count() == 4 * 26


def test_quoted_cells(spark, tmp_path, rows):
    """Commas, doubled quotes and line breaks inside quoted cells, read from a sheet and written to an export."""
    odd = 'torn "net", redo\nnext day'
    write_sheet(tmp_path / "q.csv", sheet_lines({**HEADER, "Comments": odd}, TAXA))
    raw = scan_datasheets(spark, str(tmp_path), "q.csv")
    assert raw.count() == 26 and raw.filter("Information = 'Comments'").first().Value == odd
    assert raw.filter("Genus_sp_lifestage = 'D_thomasi_wo_eggs'").count() == 1
    df = spark.createDataFrame([(1, odd), (2, 'a,b'), (3, '"'), (4, "back\\slash"), (5, None), (6, "")], "k int, t string")
    write_csv(df, str(tmp_path / "out"))
    assert rows(read_dimension(spark, str(tmp_path / "out"), df.schema)) == rows(df.replace("", None, subset=["t"]))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    assert '"torn ""net"", redo' in text


def test_a_failed_load_is_repeated_without_doubling_rows(spark, tmp_path, cutoffs, monkeypatch):
    (tmp_path / "in").mkdir()
    write_sheet(tmp_path / "in" / "a.csv", sheet_lines({**HEADER, "Sample_ID": "a"}, GOOD))
    warehouse = str(tmp_path / "warehouse")
    names = ("zoop_sample_info", "sample_inventory", "zoop_counts", "zoop_lengths", "zoop_egg_counts", "zoop_final", "sheet_status")
    real, calls = ingest.append_table, []

    def failing(*args, **kwargs):
        calls.append(args[1])
        if len(calls) > 3:
            raise OSError("the disk went away")
        real(*args, **kwargs)

    monkeypatch.setattr(ingest, "append_table", failing)
    with pytest.raises(OSError):
        load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), warehouse, batch="june")
    monkeypatch.setattr(ingest, "append_table", real)
    load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), warehouse, batch="june")
    once = {n: spark.read.parquet(f"{warehouse}/{n}").count() for n in names}
    assert once["zoop_sample_info"] == once["sample_inventory"] == once["sheet_status"] == 1
    assert not list((tmp_path / "warehouse" / "stage").glob("*"))
    # A second entry of the same sheet is an entry of its own.
    load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), warehouse)
    assert {n: spark.read.parquet(f"{warehouse}/{n}").count() for n in names} == {n: 2 * k for n, k in once.items()}


TABLES = ("zoop_sample_info", "sample_inventory", "zoop_counts", "zoop_lengths", "zoop_egg_counts", "zoop_final", "sheet_status", "sheet_manifest", "raw_entered")


def test_entering_a_folder_twice_changes_nothing(spark, tmp_path, cutoffs, monkeypatch):
    source, warehouse, taxa = tmp_path / "in", str(tmp_path / "warehouse"), taxa_groups(spark)
    source.mkdir()
    for name, change in {"a": {}, "b": {"Sample_date": "20210714"}, "bad": {"Sample_date": "?"}}.items():
        write_sheet(source / f"{name}.csv", sheet_lines({**HEADER, "Sample_ID": name, **change}, GOOD))
    write_sheet(source / "copy_of_a.csv", sheet_lines({**HEADER, "Sample_ID": "a"}, GOOD))

    def enter():
        done = ingest.enter_new_sheets(spark, str(source), cutoffs, taxa, warehouse)
        return {r.source_file.rsplit("/", 1)[1][:-4]: r for r in done.collect()}

    def stored():
        return {n: sorted(map(str, spark.read.parquet(f"{warehouse}/{n}").collect())) for n in TABLES}

    # The first attempt fails between the tables; the second replaces what it wrote.
    real, calls = ingest.append_table, []

    def failing(*args, **kwargs):
        calls.append(args[1])
        if len(calls) > 3:
            raise OSError("the disk went away")
        real(*args, **kwargs)

    monkeypatch.setattr(ingest, "append_table", failing)
    with pytest.raises(OSError):
        enter()
    monkeypatch.setattr(ingest, "append_table", real)
    first = enter()
    assert {n: (r.ok, r.batch is not None) for n, r in first.items()} == {"a": (True, True), "b": (True, True), "bad": (False, True), "copy_of_a": (False, False)}
    once = stored()
    assert len(once["zoop_sample_info"]) == len(once["sheet_manifest"]) == 2 and len(once["raw_entered"]) == 3 * 26
    good = {n: v for n, v in once.items() if n not in ("sheet_status", "raw_entered")}
    assert ingest.touched_years(spark, warehouse, first["a"].batch) == [2020, 2021]
    # Once more, and under other names: only the sheet that failed is looked at again, and no table changes.
    (source / "a.csv").rename(source / "renamed.csv")
    assert {n: (r.ok, r.status == "Entered before.") for n, r in enter().items()} == {"renamed": (False, True), "copy_of_a": (False, True), "b": (False, True), "bad": (False, False)}
    assert {n: v for n, v in stored().items() if n in good} == good
    # One new sheet: files of one year.
    write_sheet(source / "new.csv", sheet_lines({**HEADER, "Sample_ID": "new", "Sample_date": "20210801"}, GOOD))
    batch = enter()["new"].batch
    assert ingest.touched_years(spark, warehouse, batch) == [2021]
    assert [p.name for p in (tmp_path / "warehouse" / "zoop_counts" / f"batch={batch}").iterdir() if p.is_dir()] == ["year=2021"]
    assert sorted(r.Sample_ID for r in spark.read.parquet(f"{warehouse}/zoop_sample_info").collect()) == ["a", "b", "new"]
    # A corrected sheet is a new one.
    write_sheet(source / "b.csv", sheet_lines({**HEADER, "Sample_ID": "b", "Sample_date": "20210715"}, GOOD))
    assert enter()["b"].ok and not list((tmp_path / "warehouse" / "stage").glob("*"))


def test_digests_tell_cells_and_places(spark, tmp_path):
    lines = sheet_lines({**HEADER, "Sample_ID": "a"}, GOOD)
    names = lines[0]
    moved = [[*row[:5], "", *row[5:-1]] if row[3] == "B_longirostris_w_eggs" else row for row in lines]
    turned = [[row[k] for k in [4, *range(4), *range(5, 25)]] for row in [names, *reversed(lines[1:])]]
    for name, own in {"a": lines, "moved": moved, "turned": turned, "longer": [*lines, lines[-1]]}.items():
        write_sheet(tmp_path / f"{name}.csv", own)
    got = {r.source_file.rsplit("/", 1)[1][:-4]: r.digest for r in ingest.sheet_digests(scan_datasheets(spark, str(tmp_path))).collect()}
    assert got["a"] == got["turned"] and len(set(got.values())) == 3


def test_header_faults_are_named_and_keep_a_sheet_out(spark, tmp_path, cutoffs):
    (tmp_path / "in").mkdir()
    headers = {"good": {}, "nodate": {"Sample_date": "June"}, "none": None}
    for name, change in headers.items():
        lines = sheet_lines({**HEADER, "Sample_ID": name, **(change or {})}, GOOD)
        if change is None:
            lines = [lines[0], *[["", "", *row[2:]] for row in lines[1:]]]
        write_sheet(tmp_path / "in" / f"{name}.csv", lines)
    twice = sheet_lines({**HEADER, "Sample_ID": "twice"}, GOOD)
    twice.append(["Depth_m", "10", "twice", "Filler_x", "", *[""] * 20])
    write_sheet(tmp_path / "in" / "twice.csv", twice)
    warehouse = str(tmp_path / "warehouse")
    status = {r.source_file.rsplit("/", 1)[1]: r for r in load_folder(spark, str(tmp_path / "in"), cutoffs, taxa_groups(spark), warehouse).collect()}
    assert {k: r.ok for k, r in status.items()} == {"good.csv": True, "nodate.csv": False, "none.csv": False, "twice.csv": False}
    assert "no readable Sample_date" in status["nodate.csv"].status and "no header rows" in status["none.csv"].status
    assert "several values for Depth_m" in status["twice.csv"].status
    assert [r.Sample_ID for r in spark.read.parquet(f"{warehouse}/zoop_sample_info").collect()] == ["good"]


def test_a_junk_length_is_measured_nowhere(spark, tmp_path, cutoffs):
    """Shares and lengths read a cell alike: NaN and 12f are no measurements."""
    write_sheet(tmp_path / "j.csv", sheet_lines({**HEADER, "Sample_ID": "j"}, [("D_thomasi_wo_eggs", "10", ["NaN", "12f", "40", "10"])]))
    sheets = scan_datasheets(spark, str(tmp_path), "j.csv")
    done = ingest_sheets(sheets, cutoffs)
    assert done.measured.count() == 2
    counts = {r.Life_stage: r.Number_counted for r in done.counts.filter("Genus_sp_lifestage = 'D_thomasi_wo_eggs'").collect()}
    assert counts == {"Older": 5.0, "Younger": 5.0}


def test_density_is_linear_in_the_count(spark, tmp_path, cutoffs):
    for factor in (1, 3):
        taxa = [("D_thomasi_wo_eggs", str(20 * factor), [40, 10])]
        write_sheet(tmp_path / f"f{factor}.csv", sheet_lines({**HEADER, "Sample_ID": f"f{factor}"}, taxa))
    counts = ingest_sheets(scan_datasheets(spark, str(tmp_path), "f*.csv"), cutoffs).counts.filter("Genus_sp_lifestage = 'D_thomasi_wo_eggs'")
    d = {(r.Sample_ID, r.Life_stage): r.Zoop_density for r in counts.collect()}
    for stage in ("Older", "Younger"):
        assert d["f3", stage] == pytest.approx(3 * d["f1", stage])


def test_a_missing_taxon_is_its_own_group(spark, cutoffs):
    """Rows without a taxon are split by their own measurements and come out without a taxon."""
    cells = {c: None for c in schemas.LENGTH_CELLS}
    rows = [
        {"source_file": "f", "Information": k, "Value": v or None, "Sample_ID": "s", "Genus_sp_lifestage": None, "Number_counted": None, **cells}
        for k, v in HEADER.items()
    ]
    rows[0] |= {"Number_counted": "6", "L1": "20", "L2": "30"}
    schema = ", ".join(f"{c} string" for c in [*schemas.SHEET.names, "source_file"])
    sheets = spark.createDataFrame([[r[c] for c in [*schemas.SHEET.names, "source_file"]] for r in rows], schema)
    counts = ingest_sheets(sheets, cutoffs).counts
    assert {(r.Genus_sp_lifestage, r.Life_stage, r.Number_counted) for r in counts.collect()} == {(None, "Older", 6.0), (None, "Older", 0.0)}
