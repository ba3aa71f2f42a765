"""Quality classifier: a generalised additive model with pairwise interactions.

A document has about two dozen measures of its whole text. Each measure is cut into bins; the model is one lookup table per measure and
one per chosen pair of measures, learned by cyclic boosting: round after round, every measure in turn gets a shallow
tree fitted to what the others leave unexplained, and the tree's values are added to its table. Pairs follow, on the
residuals of the single measures. Scoring is a look-up of bins and an addition.

Fitting uses at most ``fit_rows`` labelled documents, chosen by hashed doc_id; only their measures reach the driver. Scoring covers
every document.

Defined results: null and empty texts have all-zero measures and get a score like any other; rows with equal doc_id are scored each
on their own; without labels of both kinds the score is the share of label 1 (0.5 without any label); other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import row_slices, run_keys, text_bytes
from lakesurvey.llm.common import gather_runs, small_batches, starts_of, sums_of
from lakesurvey.llm.training import fold, labelled, sigmoid

MARKS = "|#%&$*"
MEASURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "letters", "capitals", "digits", "marks", "blanks", "line_words", "line_repeats",
    "distinct_words", "commonest_word", "same_as_before", "distinct_pairs", "one_letter", "short_words", "ends_in_mark", "stops", "commas",
    "odd_bytes", *[f"mark_{k}" for k in range(len(MARKS))], "byte_entropy", "capital_words",
)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of :data:`MEASURES` for each text."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    kinds = np.zeros(256, np.uint8)
    kinds[[*range(97, 123), *range(128, 256)]] = 1
    kinds[65:91] = 2
    kinds[48:58] = 3
    kinds[[32, *range(9, 14)]] = 4
    kind = kinds[data]
    white = kind == 4

    def count(mask: np.ndarray) -> np.ndarray:
        return sums_of(mask, size)

    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.r_[True, white[:-1]], np.r_[white[1:], True]
    before, after = before[: len(data)], after[-len(data) :] if len(data) else after[:0]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    length = ends - starts
    keys = run_keys(data, starts, ends)
    row = np.repeat(np.arange(rows), words)
    inside = np.r_[False, row[1:] == row[:-1]][: len(row)]
    previous = np.r_[np.zeros(1, np.uint64), keys[:-1]][: len(keys)]
    pair = keys * np.uint64(0x9E3779B97F4A7C15) + previous

    def distinct(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values of each run, and the occurrences of the commonest."""
        out, top = np.zeros(len(runs)), np.zeros(len(runs))
        for k, (a, n) in enumerate(zip(starts_of(runs).tolist(), runs.tolist())):
            if n:
                own = np.sort(values[a : a + n])
                edges = np.flatnonzero(own[1:] != own[:-1])
                gaps = np.diff(np.r_[-1, edges, n - 1])
                out[k], top[k] = len(gaps), gaps.max()
        return out, top

    distinct_words, top = distinct(keys, words)
    pairs, _ = distinct(pair[inside], np.maximum(words - 1, 0))
    newline = data == 10
    line_at = np.flatnonzero(newline)
    lines = count(newline) + 1
    line_first = np.arange(rows) + np.searchsorted(line_at, offsets[:-1])
    is_first = np.zeros(rows + len(line_at), bool)
    is_first[line_first] = True
    line_start, line_end = np.empty(len(is_first), np.int64), np.empty(len(is_first), np.int64)
    line_start[is_first], line_start[~is_first] = offsets[:-1], line_at + 1
    is_last = np.r_[is_first[1:], np.ones(min(rows, 1), bool)]
    line_end[is_last], line_end[~is_last] = offsets[1:], line_at
    distinct_lines, _ = distinct(run_keys(data, line_start, line_end), lines)
    last = data[ends - 1] if len(ends) else data[:0]
    capital = (kind[starts] == 2) if len(starts) else np.zeros(0, bool)
    longest = np.zeros(rows)
    some = words > 0
    if some.any():
        longest[some] = np.maximum.reduceat(length, first[:-1][some])
    histogram = np.bincount(np.repeat(np.arange(rows), size) * 256 + data, minlength=rows * 256).reshape(rows, 256) / np.maximum(size, 1)[:, None]
    entropy = -(histogram * np.log2(np.where(histogram > 0, histogram, 1))).sum(axis=1)
    marks = (kind == 0) & (data > 32)
    out = [
        np.log1p(size), np.log1p(words), _share(sums_of(length, words), words), longest, _share(count((kind == 1) | (kind == 2)), size),
        _share(count(kind == 2), size), _share(count(kind == 3), size), _share(count(marks), size), _share(count(white), size), _share(words, lines),
        1 - distinct_lines / lines, _share(distinct_words, words), _share(top, words), _share(sums_of(inside & (keys == previous), words), words),
        _share(pairs, np.maximum(words - 1, 0)), _share(sums_of(length == 1, words), words), _share(sums_of(length <= 3, words), words),
        _share(sums_of(np.isin(last, np.frombuffer(MARKS.encode(), np.uint8)), words), words), _share(count(data == 46), words), _share(count(data == 44), words),
        _share(count((data < 32) & ~white), size), *[_share(count(data == ord(c)), size) for c in MARKS], entropy, _share(sums_of(capital, words), words),
    ]
    return np.stack(out, axis=1) if rows else np.zeros((0, len(MEASURES)))


@dataclass
class Additive:
    """Bin edges and lookup tables of a fitted model; values are log odds."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        bins = self.bins(x)
        for table, b in zip(self.tables, bins):
            out += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            out += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.log_odds(x))


def tree_values(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float, least: float) -> np.ndarray:
    """Values of a tree over ordered bins with gradient sums g and curvature sums h: best splits first."""
    cuts = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]

    def gain(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        gl, hl = cg[a + 1 : b] - cg[a], ch[a + 1 : b] - ch[a]
        gt, ht = cg[b] - cg[a], ch[b] - ch[a]
        value = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
        value = np.where((hl >= least) & (ht - hl >= least), value, 0)
        at = int(value.argmax())
        return float(value[at]), a + 1 + at

    while len(cuts) < leaves:
        best, cut, k = max((*gain(a, b), k) for k, (a, b) in enumerate(cuts))
        if best <= 0:
            break
        a, b = cuts[k]
        cuts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse: int = 12, rounds: int = 150, pair_rounds: int = 60, pairs: int = 12, rate: float = 0.1, leaves: int = 4, ridge: float = 1.0) -> Additive:
    """Cyclic boosting of single measures, then of the pairs that explain most of the rest."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Additive(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    for k in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1]))
        model.edges.append(cuts)
        model.tables.append(np.zeros(len(cuts) + 1))
        model.coarse.append(np.arange(len(cuts) + 1) * coarse // (len(cuts) + 1))
    binned = model.bins(x)
    f = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for k, b in enumerate(binned):
            p = sigmoid(f)
            n = len(model.tables[k])
            step = rate * tree_values(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), leaves, ridge, 1.0)
            model.tables[k] += step
            f += step[b]
    small = [c[b] for c, b in zip(model.coarse, binned)]
    # Pairs by what one quadrant cut of each explains of the residuals.
    p = sigmoid(f)
    ranked = []
    for i in range(len(small)):
        for j in range(i):
            cell = small[i] * coarse + small[j]
            g, h = (np.bincount(cell, v, coarse * coarse) for v in (y - p, p * (1 - p)))
            ranked.append((float((g**2 / (h + 5)).sum()), j, i))
    model.pairs = [(j, i) for _, j, i in sorted(ranked, reverse=True)[:pairs]]
    model.pair_tables = [np.zeros((coarse, coarse)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for k, (i, j) in enumerate(model.pairs):
            p = sigmoid(f)
            cell = small[i] * coarse + small[j]
            g, h = (np.bincount(cell, v, coarse * coarse).reshape(coarse, coarse) for v in (y - p, p * (1 - p)))
            # A tree of two levels: the best cut of one measure, then each side by the other.
            rows_cut = tree_values(g.sum(1), h.sum(1), 2, ridge, 1.0)
            edge = int(np.argmax(rows_cut[1:] != rows_cut[:-1])) + 1 if (rows_cut[1:] != rows_cut[:-1]).any() else coarse
            step = np.zeros((coarse, coarse))
            step[:edge] = tree_values(g[:edge].sum(0), h[:edge].sum(0), 2, ridge, 1.0)
            step[edge:] = tree_values(g[edge:].sum(0), h[edge:].sum(0), 2, ridge, 1.0) if edge < coarse else 0
            model.pair_tables[k] += rate * step
            f += rate * step[small[i], small[j]]
    return model


def measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: text and label to measures and label."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in row_slices(data, offsets):
            x = measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(a, b - a)], names=["x", "label"])


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> Additive:
    small_batches(docs.sparkSession)
    rows = labelled(docs, labels, "quality", fit_rows).select("text", "label").mapInArrow(measure_rows, "x array<double>, label int").toArrow()
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(MEASURES))
    y = np.array(rows["label"].to_pylist(), float)
    order = np.lexsort((y, *x.T))  # the order in which rows arrive doesn't matter
    return fit(x[order], y[order])


def score_rows(model: Additive, threshold: float):
    """For mapInArrow: doc_id, text to doc_id, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(data, offsets):
                score = model.score(measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([docs.slice(a, b - a), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_model(docs, labels, fit_rows)
    scored = docs.select("doc_id", "text").mapInArrow(score_rows(model, threshold), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def accepted_rows(model: Additive, threshold: float):
    """For mapInArrow over whole rows: those whose text, in column ``text``, scores at least ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
            score = [model.score(measures(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in row_slices(data, offsets)]
            yield batch.filter(pa.array(np.concatenate([*score, np.zeros(0)]) >= threshold))

    return run
