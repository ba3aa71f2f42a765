"""Scans of hand-entered CSV files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakesurvey.functions import blank_to_null
from lakesurvey.schemas import SHEET

NULL_TOKENS = ("", "NA")
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}


# A cell: quoted (a quote inside is doubled, line breaks may stand in it), or whatever stands up to the next comma or line end.
_CELL = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|[^,\r\n]*+)'
_RECORD = rf"{_CELL}(?:,{_CELL})*+"


def _cells(record: Column) -> Column:
    """The cells of a record as written; only a record with a quote needs the pattern."""
    found = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",({_CELL})"), F.lit(1))
    return F.when(record.contains('"'), found).otherwise(F.split(record, ",", -1))


def _unquoted(cell: Column) -> Column:
    inner = F.replace(F.regexp_replace(cell, r'(?s)^"(.*)"([^"]*)$', "$1$2"), F.lit('""'), F.lit('"'))
    return F.when(cell.startswith('"'), inner).otherwise(cell)


# The same for a line that may end inside a quoted cell, begun outside or inside one.
_CLOSED = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,\r\n]*+|(?!")[^,\r\n]*+)'
_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_OPENS = rf'^(?:{_CLOSED}[,\r])*+"{_INSIDE}\z'
_STAYS = rf'^{_INSIDE}(?:"[^,\r\n]*+(?:[,\r]{_CLOSED})*+[,\r]"{_INSIDE})?\z'

#: Files beyond so many bytes are read by lines, over as many tasks as they have splits, and not whole.
WHOLE_BYTES = 1 << 20
#: How many bytes of text a byte of a compressed file counts for.
PACKED = 16


def _records(text: Column) -> Column:
    """The records of a text that begins and ends outside quotes; empty ones are none."""
    found = F.filter(F.regexp_extract_all(text, F.lit(_RECORD), F.lit(0)), lambda r: r != "")
    return F.when(text.rlike('[\r\n"]'), found).when(text != "", F.array(text))


def _unbroken(lines: DataFrame) -> DataFrame:
    """Lines of files with line breaks in quoted cells, those of a record joined.

    Whether a line begins inside quotes follows from the last line that ends the same way wherever it began, and from the lines since then that end the
    other way than they began. The lines of such a file pass through one task in order, a few numbers being kept of them.
    """
    order = Window.partitionBy("source_file").orderBy("place")
    turns = F.col("opens") & ~F.col("stays")
    marked = lines.withColumn("turned", F.sum(turns.cast("int")).over(order))
    sure = F.when(F.col("opens") == F.col("stays"), F.struct("turned", "opens"))
    marked = marked.withColumn("sure", F.last(sure, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    since = F.col("turned") - turns.cast("int") - F.coalesce(F.col("sure.turned"), F.lit(0))
    inside = F.coalesce(F.col("sure.opens"), F.lit(False)) != (since % 2 == 1)
    numbered = marked.withColumn("record", F.sum((~inside).cast("long")).over(order))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"])
    return numbered.groupBy("source_file", "record").agg(F.array_join(texts, "\n").alias("line"), F.min("place").alias("place")).select("source_file", "place", "line")


def _named(sheets: DataFrame, column_report: bool) -> tuple[DataFrame, list[str]]:
    """Places of the expected columns, and the report on them, from the header record of each file."""
    names = F.transform(_cells(F.col("header")), lambda c: F.trim(_unquoted(c)))
    sheets = sheets.withColumn("names", names)
    expected = F.array(*map(F.lit, SHEET.names))
    report = {
        "missing_columns": F.nullif(F.array_join(F.array_except(expected, "names"), ", "), F.lit("")),
        "unknown_columns": F.nullif(F.array_join(F.filter(F.array_except("names", expected), lambda n: n != ""), ", "), F.lit("")),
    } if column_report else {}
    places = F.array(*[F.array_position("names", F.lit(n)).cast("int") for n in SHEET.names])
    return sheets.withColumns({**report, "places": places}).drop("names", "header"), list(report)


def _by_lines(text: DataFrame, column_report: bool) -> DataFrame:
    """Records of large files, each with what the header of its file says."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("place")
    lines = text.select(F.col("_metadata.file_path").alias("source_file"), place, F.col("value").alias("line"))
    quoted = F.col("line").contains('"')
    lines = lines.withColumns({"opens": quoted & F.col("line").rlike(_OPENS), "stays": ~quoted | F.col("line").rlike(_STAYS)})
    broken = F.broadcast(lines.filter("opens").select("source_file").distinct())
    joined = _unbroken(lines.join(broken, "source_file", "left_semi"))
    lines = lines.join(broken, "source_file", "left_anti").select("source_file", "place", "line").unionByName(joined)
    lines = lines.filter(F.translate("line", "\r\n\ufeff", "") != "")
    heads = lines.groupBy("source_file").agg(F.min("place").alias("first"), F.min_by("line", "place").alias("line"))
    heads = heads.select("source_file", "first", _records(F.regexp_replace("line", "^\ufeff", ""))[0].alias("header"))
    found = lines.join(F.broadcast(_named(heads, column_report)[0]), "source_file")
    after = F.slice(_records(F.regexp_replace("line", "^\ufeff", "")), F.lit(2), F.length("line") + 1)
    records = F.when(F.col("place") == F.col("first"), after).otherwise(_records(F.col("line")))
    return found.withColumn("record", F.explode(records))


def scan_datasheets(
    spark: SparkSession, path: str | Sequence[str], pattern: str = "*.csv", *, column_report: bool = False, whole_bytes: int = WHOLE_BYTES,
) -> DataFrame:
    """All count sheets under one or more folders as text, plus the file each row came from.

    Cells are taken by the name in their own file's header, so sheets may order their columns differently, leave some out (null here)
    or have others, which are left aside. A sheet is one small file: each is read whole, once, as one row; its records and the places of
    its columns come out of that row, so no sheet is read or moved a second time to learn its header. Bare carriage returns end lines
    like other line ends; a quote inside a quoted cell is doubled, and such a cell may hold a line break. Of a repeated name the first column counts.

    Files beyond ``whole_bytes`` are read by lines, in splits, and meet the header of their file; there is one such file for so many bytes of input at
    most, so their headers are broadcast. Where quoted cells hold line breaks, the lines of a record are joined first.

    With a ``pattern`` for them, such as ``*.csv.gz``, compressed files are read too; a byte of them counts for sixteen, and one of them isn't split.

    ``column_report`` adds ``missing_columns`` and ``unknown_columns``, the names concerned on every row of a sheet, or null.
    """
    paths = path if isinstance(path, str) else list(path)
    read = lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    text_bytes = lambda path, size: F.col(size) * F.when(F.col(path).endswith(".gz"), PACKED).otherwise(1)
    size, file = text_bytes("_metadata.file_path", "_metadata.file_size"), F.col("_metadata.file_path").alias("source_file")
    whole = read().text(paths, wholetext=True).filter(size <= whole_bytes).select(F.regexp_replace("value", "^\ufeff", "").alias("text"), file)
    records = F.filter(F.regexp_extract_all("text", F.lit(_RECORD), F.lit(0)), lambda r: r != "")
    small = whole.select("source_file", records.alias("records")).filter(F.size("records") > 1)
    small, report = _named(small.withColumn("header", F.col("records")[0]), column_report)
    kept = ["source_file", *report, "places"]
    rows = small.select(*kept, F.explode(F.slice("records", F.lit(2), F.size("records"))).alias("record"))

    if not read().format("binaryFile").load(paths).filter(text_bytes("path", "length") > whole_bytes).select("length").isEmpty():
        rows = rows.unionByName(_by_lines(read().text(paths, lineSep="\n").filter(size > whole_bytes), column_report).select(*kept, "record"))

    rows = rows.select("source_file", *report, "places", _cells(F.col("record")).alias("cells"))
    cells = [blank_to_null(_unquoted(F.try_element_at("cells", F.nullif(F.col("places")[k], F.lit(0)))), NULL_TOKENS).alias(n) for k, n in enumerate(SHEET.names)]
    return rows.select(*cells, "source_file", *report)


def read_dimension(spark: SparkSession, path: str | Sequence[str], schema: StructType) -> DataFrame:
    """A small keyed CSV with a stated schema. The join planner sees its file size, so it is
    broadcast when it fits the threshold and shuffled when it does not."""
    paths = path if isinstance(path, str) else list(path)
    rows = spark.read.schema(schema).option("header", True).options(**QUOTING).option("nullValue", "NA").csv(paths)
    return rows


def union_files(frames: Sequence[DataFrame], drop: Sequence[str] = ()) -> DataFrame:
    """Stack frames by column name, keeping every row, then drop unwanted columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).drop(*drop)


def archive_raw(sheets: DataFrame, path: str) -> None:
    """Append entered sheets, cell for cell, to a compressed columnar archive.

    Later stages read the archive instead of parsing the text again.
    """
    sheets.write.mode("append").parquet(path)
