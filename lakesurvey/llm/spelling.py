"""Spelling variants: words one edit apart, found by permuterm rotations.

A word with a terminator behind it, ``w$``, is turned about: a rotation that begins behind position i reads ``b$ax`` for the word ``axb``. All
words that differ from it in the character x alone, or lack it, have a rotation that begins with ``b$a``: the prefix that skips the edited
character. So every rotation is written twice, whole and without its last character, and all are sorted. Words met at a prefix
without their last character are replacements of each other, and the one word met there whole lacks a character of the others.

A prefix tells word ends and the edited place, so it is met by one word whole and by at most one word for each letter: no more than the 91
letters that words are made of, however often they occur. Groups of adjacent equal prefixes are therefore scanned in bounded batches. Two words that differ
by a replacement share one prefix; of the prefixes that an insertion into a run of equal letters gives, the one at the run's end counts.
The scan gives each word the number of its near words there and the best of them; no pair of words is written.

Defined results: null and empty texts have no words; a row without doc_id takes part without the thinning of its words; repeated rows count
again; ties of frequency go to the smallest word in code-point order; an empty table gives no rows; other columns don't matter. A text of any length is taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.common import small_batches, stored

LEAST_LETTERS, LEAST_COUNT, THINNING, MUCH_COMMONER = 7, 2, 31, 10
#: Letters of words; the terminator is none of them.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
END = "$"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

FOUND = "word string, near long, form_n long, form string"


def word_counts(docs: DataFrame) -> DataFrame:
    """Words of all texts and how often they occur: runs of letters, some of which lose a letter by a rule on doc_id and run.

    Runs that are too short to give a word are left out by the pattern; they are counted before the shuffle.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST_LETTERS},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    cut = F.expr("concat(substring(run, 1, int(h % length(run))), substring(run, int(h % length(run)) + 2))")
    words = hashed.select(F.when(F.col("h") % THINNING == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def rotations(words: DataFrame) -> DataFrame:
    """``key, letter, n``: every rotation of each word, whole (no letter) and without its last letter."""
    turned = words.select("n", F.concat("word", F.lit(END)).alias("w"), F.explode(F.expr("sequence(0, length(word))")).alias("i"))
    turned = turned.select("n", "i", F.expr("concat(substring(w, i + 1), substring(w, 1, i - 1))").alias("key"), F.expr("if(i = 0, '', substring(w, i, 1))").alias("letter"))
    both = F.explode(F.when(F.col("i") == 0, F.array(F.lit(True))).otherwise(F.array(F.lit(True), F.lit(False)))).alias("whole")
    turned = turned.select("n", "key", "letter", both)
    return turned.select(F.when(F.col("whole"), F.concat("key", "letter")).otherwise(F.col("key")).alias("key"), F.when(F.col("whole"), F.lit("")).otherwise(F.col("letter")).alias("letter"), "n")


def unturned(key: pa.Array, letter: pa.Array) -> np.ndarray:
    """Words from their rotations."""
    return pc.replace_substring_regex(pc.binary_join_element_wise(key, letter, ""), r"^([^$]*)\$(.*)$", r"\2\1").to_numpy(zero_copy_only=False)


def group_rows(key: pa.Array, letter: pa.Array, n: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """What the words of these groups (numbered from 0, each of two rows at least) are to each other."""
    words = unturned(key, letter)
    size = pc.binary_length(letter).to_numpy()
    full = size == 0
    # An insertion into a run of equal letters is met at each of them: it counts at the last.
    counted = ~full & ~pc.equal(letter, pc.utf8_slice_codeunits(key, 0, 1)).to_numpy(zero_copy_only=False)
    groups = int(group[-1]) + 1
    others, inserts = np.bincount(group[~full], minlength=groups), np.bincount(group[counted], minlength=groups)
    shorter = np.full(groups, -1)
    shorter[group[full]] = np.flatnonzero(full)
    # The two commonest replacements of each group; equal ones in the order of their words.
    place = np.empty(len(words), np.int64)
    place[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((place, -n, full, group))
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    first = np.where(others > 0, order[begin], -1)
    second = np.where(others > 1, order[np.minimum(begin + 1, len(order) - 1)], -1)
    row = np.arange(len(words))
    best = np.where(first[group] == row, second[group], first[group])
    other = np.where(full, -1, shorter[group])
    # Of the best replacement and the word without the letter, the commoner; -1 stands for none.
    more = (other >= 0) & ((best < 0) | (n[other] > n[best]) | ((n[other] == n[best]) & (place[other] < place[best])))
    best = np.where(more, other, best)
    near = np.where(full, inserts[group], others[group] - 1 + (counted & (shorter[group] >= 0)))
    good = (best >= 0) & (n[best] >= MUCH_COMMONER * n)
    some = (near > 0) | good
    return pa.RecordBatch.from_arrays(
        [pa.array(words[some], pa.string()), pa.array(near[some]), pa.array(n[best][some], mask=~good[some]), pa.array(words[best][some], pa.string(), mask=~good[some])],
        names=["word", "near", "form_n", "form"],
    )


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rotations in order: rows of the groups of equal keys that hold several words.

    The last group of a batch waits for the next one; it is bounded by the number of letters.
    """
    held: pa.Table | None = None
    for batch in _with_end(batches):
        rows = pa.Table.from_batches([batch]) if batch is not None else None
        if held is not None and held.num_rows:
            rows = held if rows is None else pa.concat_tables([held, rows])
        if rows is None or not rows.num_rows:
            continue
        key = rows.column(0).combine_chunks()
        new = np.r_[True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)]
        begin = np.flatnonzero(new)
        stop = len(key) if batch is None else int(begin[-1])
        held = rows[stop:]
        sizes = np.diff(np.r_[begin, len(key)])
        keep = np.repeat(sizes > 1, sizes)
        keep[stop:] = False
        if keep.any():
            at = pa.array(np.flatnonzero(keep))
            group = np.cumsum(new[keep]) - 1
            yield group_rows(key.take(at), rows.column(1).combine_chunks().take(at), rows.column(2).to_numpy()[keep], group)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: the end of the chain of forms of each word that has one.

    A form is ten times as common as its word, so chains are short; each step doubles the part of them that is followed.
    """
    links = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.join(links.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        further = stored(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        links = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """Each word with its count, its near words, the much commoner one among them, and the root of its chain of forms."""
    small_batches(docs.sparkSession, 50_000)
    words = stored(word_counts(docs.select("doc_id", "text")), "words")
    turned = rotations(words).repartition("key").sortWithinPartitions("key")
    found = turned.mapInArrow(scanned, FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    found = stored(found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")), "near")
    found = found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    ends = roots(found.where("form is not null"))
    out = words.join(found, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
