"""Toxicity by maximum-scoring segments.

A token is a word or the beginning of one (``achlich*``), since languages that join words rarely repeat whole ones. Each token's
log odds between toxic and other documents, under a Dirichlet prior that is in part proportional to the token's overall share, and
their standard error give a lexicon of the tokens that point to toxic ones; a word has the weight of its most specific token there. Any other word
costs a constant, set so that a word of an ordinary document costs on average. A token counts again only when ``REPEAT`` times its weight
has been paid since it last counted, so that a repeated word is no evidence by its repetition, and a later passage has all its words. One linear scan over a document's words finds all of
its maximal scoring segments: no part of one scores more than the whole, and none can be extended. The score S of
the best segment in n unrelated words follows an extreme-value law, with about K * n * exp(-lambda * S) segments expected by chance;
lambda solves its defining equation on the words of other documents, K is fitted to their best segments. A segment is significant when
that expectation is below ``expected``. A document's score is a logistic function of its best segment and the sum of all significant
ones, in these calibrated units.

The least odds of a lexicon token are chosen by cross-validation: of ``ODDS``, those with fewest errors on documents that the lexicon
was not made of.

Fitting uses at most ``fit_rows`` labelled documents, chosen by hashed doc_id; their word counts are made in Spark and at most
``lexicon`` words reach the driver. Scoring covers every word of every document.

Defined results: a text without words has no segment and gets the score of such documents; rows with equal doc_id are scored each on
their own; without labels of both kinds every score is the share of label 1 (0.5 without any label); other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import ChunkTable, row_slices, text_bytes
from lakesurvey.llm.common import grown, small_batches, stored
from lakesurvey.llm.language import lowered
from lakesurvey.llm.training import fold, labelled, logistic_fit, sigmoid

#: A word: a run of letters, lower-cased; what stands between words doesn't count.
WORD = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings that count as tokens, most specific first.
BEGINNINGS = (7, 6, 5, 4, 3)
#: Cost of the words after which a token counts again, as a multiple of its weight.
REPEAT = 2.0
#: Log odds that are tried as the least ones of a token, and parts of the learning rows for that.
ODDS = (1.0, 1.5, 2.0, 2.5, 3.0)
FOLDS = 3
SEGMENTS = "doc_id long, begin int, end int, raw double, calibrated double, passage string"


def tokens_of(word: str) -> list[str]:
    """The word and its beginnings, most specific first."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    cost: float = 1.0
    rate: float = 1.0  # lambda
    log_k: float = float(np.log(0.1))
    expected: float = 0.05
    logistic: tuple[float, float, float] = (0.0, 0.0, 0.0)
    constant: float | None = None
    odds: float | None = None  # the chosen least log odds

    def calibrated(self, raw: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Minus the log of how many such segments chance would give."""
        return self.rate * raw - self.log_k - np.log(np.maximum(words, 1))


def maximal_segments(places: np.ndarray, values: np.ndarray, cost: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first place, last place, score), for words of ``values`` at ``places`` and cost elsewhere.

    The list holds candidates with the cumulated score before and at their end. A new one joins with the nearest earlier
    candidate that began lower, if the new one ends higher; each word is pushed and popped at most once.
    """
    found: list[list[float]] = []  # first, last, cumulated before, cumulated at end
    # For each candidate, the nearest earlier one that began lower.
    earlier: list[int] = []
    total, last = 0.0, -1
    for at, value in zip(places.tolist(), values.tolist()):
        total -= cost * (at - last - 1)
        last = at
        if value <= 0:
            total += value
            continue
        first, left, right = at, total, total + value
        total = right
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = earlier[j]
            if j < 0 or found[j][3] >= right:
                break
            first, left = found[j][0], found[j][2]
            del found[j:], earlier[j:]
        found.append([first, at, left, right])
        earlier.append(j)
    return [(int(a), int(b), right - left) for a, b, left, right in found]


def counted_uses(places: np.ndarray, tokens: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Which uses count: the first of each token, and each that is ``distance`` of it words behind the last one that counted."""
    keep = np.ones(len(tokens), bool)
    if len(np.unique(tokens)) < len(tokens):
        last: dict[int, int] = {}
        for k, (at, t, d) in enumerate(zip(places.tolist(), tokens.tolist(), distance[tokens].tolist())):
            if t in last and at - last[t] < d:
                keep[k] = False
            else:
                last[t] = at
    return keep


class WordWeights(ChunkTable):
    """Words of texts: a chunk's code leads to its number of words and to its lexicon words with their places."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model = model
        self.number = {t: k for k, t in enumerate(model.weights)}
        self.weight = np.array([*model.weights.values(), 0.0])
        self.distance = REPEAT * self.weight / model.cost
        super().__init__(False, limit)

    def forget(self) -> None:
        super().forget()
        self.words, self.hits = np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        number = self.number
        counts, codes = [], []
        for chunk in chunks:
            if chunk.isalpha():
                own = [chunk.lower()]
            else:
                own = WORD.findall(lowered(chunk))
            counts.append(len(own))
            hits = [(k, number[t]) for k, w in enumerate(own) if (t := next((t for t in tokens_of(w) if t in number), None))]
            codes.append(len(self.held) if hits else -1)
            if hits:
                self.held.append((np.array([k for k, _ in hits]), np.array([v for _, v in hits])))
        n = self.index.n
        self.words = grown(self.words, n, counts)
        self.hits = grown(self.hits, n, codes)

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray] | None]]:
        """Words of each text, and the places and weights of those lexicon words that count."""
        codes, counts = self.coded(data, offsets)
        words = self.words[codes].astype(np.int64)
        total = np.r_[0, np.cumsum(words)]
        ends = np.cumsum(counts)
        own = total[ends] - total[ends - counts]
        hits = np.flatnonzero(self.hits[codes] >= 0)
        row = np.searchsorted(ends, hits, "right")
        out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(counts)
        cuts = np.flatnonzero(np.diff(row)) + 1
        for part in np.split(np.arange(len(hits)), cuts) if len(hits) else []:
            r = int(row[part[0]])
            base = total[ends[r] - counts[r]]
            held = [self.held[c] for c in self.hits[codes[hits[part]]].tolist()]
            at = np.concatenate([total[h] - base + p for h, (p, _) in zip(hits[part].tolist(), held)])
            tokens = np.concatenate([v for _, v in held])
            keep = counted_uses(at, tokens, self.distance)
            out[r] = (at[keep], self.weight[tokens[keep]])
        return own, out


def segments_of(model: Model, words: int, hits: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int, float]]:
    return [] if hits is None else maximal_segments(*hits, model.cost)


def evidence(model: Model, table: WordWeights, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text: words, best raw score, calibrated best, calibrated sum of significant segments."""
    words, hits = table.documents(data, offsets)
    out = np.zeros((len(words), 4))
    out[:, 0] = words
    for k, h in enumerate(hits):
        found = segments_of(model, int(words[k]), h)
        if found:
            raw = np.array([s for _, _, s in found])
            level = model.calibrated(raw, words[k])
            significant = level[level > -np.log(model.expected)]
            out[k, 1:] = raw.max(), max(level.max(), 0.0), significant.sum()
    return out


def features(found: np.ndarray) -> np.ndarray:
    return np.c_[np.minimum(found[:, 2], 50.0) / 10, np.log1p(found[:, 3])]


def evidence_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordWeights(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_slices(data, offsets):
                found = evidence(model, table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*[pa.array(found[:, k]) for k in (0, 1)], batch.column(1).slice(a, b - a)], names=["words", "raw", "label"])

    return run


def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: text, label and fold to the number of documents with each token, by label and fold, as far as they met in one batch."""
    for batch in batches:
        counts: dict[str, list[int]] = {}
        for text, label, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = set(WORD.findall(lowered(text.as_py() or "")))
            for token in {t for w in words for t in tokens_of(w)}:
                counts.setdefault(token, [0] * (2 * FOLDS))[2 * part + label] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(2 * FOLDS)]], names=["word", *COUNTS])


#: Columns of ``word_rows``: documents of each fold with a token, other and toxic ones.
COUNTS = [f"{kind}_{k}" for k in range(FOLDS) for kind in ("other", "toxic")]


def trial_rows(trials: list[list[Model]]):
    """For mapInArrow: text, label and fold to the number of words and the best raw score under each model of the row's fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = [{t: k for k, t in enumerate({t: None for m in models for t in m.weights})} for models in trials]
        known: list[dict[str, list[str | None] | None]] = [{} for _ in trials]
        distances = [[np.array([REPEAT * m.weights.get(t, 0.0) / m.cost for t in number]) for m in models] for models, number in zip(trials, numbers)]
        for batch in batches:
            rows = []
            for text, label, part in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words, models, memo = WORD.findall(lowered(text.as_py() or "")), trials[part], known[part]
                if len(memo) > 200_000:
                    memo.clear()
                for w in set(words).difference(memo):
                    tokens = tokens_of(w)
                    own = [next((t for t in tokens if t in m.weights), None) for m in models]
                    memo[w] = own if any(own) else None
                hits = [(k, own) for k, w in enumerate(words) if (own := memo[w])]
                best = []
                for j, m in enumerate(models):
                    some = [(k, own[j]) for k, own in hits if own[j]]
                    at = np.array([k for k, _ in some], np.int64)
                    keep = counted_uses(at, np.array([numbers[part][t] for _, t in some], np.int64), distances[part][j])
                    found = maximal_segments(at[keep], np.array([m.weights[t] for _, t in some])[keep], m.cost) if some else []
                    best.append(max((x for _, _, x in found), default=0.0))
                rows.append([float(part), float(label), float(len(words)), *best])
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3 + len(ODDS))], names=["fold", "label", "words", *[f"best_{k}" for k in range(len(ODDS))]])

    return run


def solved_rate(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive lambda with sum(share * exp(lambda * score)) = 1."""
    low, high = 0.0, 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 700))).sum()) - 1
    while value(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if value(middle) < 0 else (low, middle)
    return high


def log_k_of(rate: float, raw: np.ndarray, n: np.ndarray, y: np.ndarray, default: float) -> float:
    """K from the mean of the extreme-value law over other documents that have a segment."""
    plain = (y == 0) & (raw > 0)
    return float(np.mean(rate * raw[plain] - np.log(np.maximum(n[plain], 1))) - 0.5772156649) if plain.sum() >= 20 else default


def lexicon_model(chosen: list, c0: float, expected: float, odds: float) -> Model:
    """The model of these tokens (word, delta, other), whose documents have ``c0`` tokens of the other kind; not calibrated yet."""
    model = Model({r["word"]: float(r["delta"]) for r in chosen}, expected=expected, odds=odds)
    # In other documents a word must cost on average, lexicon words included.
    shares = np.array([r["other"] / max(c0, 1.0) for r in chosen])
    deltas = np.array([r["delta"] for r in chosen])
    gain = float((shares * deltas).sum()) if len(chosen) else 0.0
    rest = max(1 - float(shares.sum()), 1e-6)
    model.cost = max(0.5, 2 * gain / rest)
    model.rate = solved_rate(np.r_[deltas, -model.cost], np.r_[shares, rest]) if (deltas > 0).any() else 1.0
    return model


def chosen_odds(sample: DataFrame, trials: list[list[Model]]) -> float:
    """The least log odds whose models make fewest errors on the folds they were not made of; of several, those of the smallest log loss."""
    got = sample.mapInArrow(trial_rows(trials), "fold double, label double, words double, " + ", ".join(f"best_{k} double" for k in range(len(ODDS)))).toArrow()
    part, y, n = (np.asarray(got[c], float) for c in ("fold", "label", "words"))
    marks = []
    for k, odds in enumerate(ODDS):
        raw, level = np.asarray(got[f"best_{k}"], float), np.zeros(len(y))
        for f, models in enumerate(trials):
            own, m = part == f, models[k]
            m.log_k = log_k_of(m.rate, raw[own], n[own], y[own], m.log_k)
            level[own] = np.where(raw[own] > 0, np.maximum(m.calibrated(raw[own], n[own]), 0.0), 0.0)
        x = np.minimum(level, 50.0)[:, None] / 10
        order = np.lexsort((y, x[:, 0]))
        w = logistic_fit(x[order], y[order])
        p = np.clip(sigmoid(x @ w[:1] + w[1]), 1e-9, 1 - 1e-9)
        loss = -np.log(np.where(y == 1, p, 1 - p))
        marks.append((int(((p >= 0.5) != (y == 1)).sum()), round(float(np.sort(loss).mean()), 9), odds))
    return min(marks)[2]


def fit_model(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, lexicon: int = 20_000, least_z: float = 3.0, least_odds: float | None = None, least_docs: int = 3, prior: float = 0.01, expected: float = 0.05) -> Model:
    """The model of the labelled documents; ``least_odds`` is chosen by cross-validation unless given."""
    small_batches(docs.sparkSession)
    folded = labelled(docs, labels, "toxic", fit_rows).select("text", "label", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"))
    sample = stored(folded, "labelled")
    seen = {(r["fold"], r["label"]): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    rows = lambda label, out=None: sum(n for (f, kind), n in seen.items() if kind == label and f != out)
    n1, n0 = rows(1), rows(0)
    if not n1 or not n0:
        return Model(constant=(n1 / (n0 + n1) if n0 + n1 else 0.5))
    counted = sample.mapInArrow(word_rows, "word string, " + ", ".join(f"{c} long" for c in COUNTS))
    words = stored(counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS]), "words")
    totals = words.agg(*[F.sum(c).alias(c) for c in COUNTS]).first()
    total = lambda kind, out=None: float(sum(totals[f"{kind}_{f}"] or 0 for f in range(FOLDS) if f != out))
    if not total("other") or not total("toxic"):
        return Model(constant=n1 / (n0 + n1))

    def telling(odds: float, out: int | None = None) -> list:
        """Tokens that point to toxic documents, those of fold ``out`` left aside."""
        m0, m1 = rows(0, out), rows(1, out)
        if not m0 or not m1:
            return []
        sums = {kind: sum((F.col(f"{kind}_{f}") for f in range(FOLDS) if f != out), F.lit(0)) for kind in ("other", "toxic")}
        own = words.select("word", *[c.alias(kind) for kind, c in sums.items()])
        # Prior counts: half a document for each token, and a part of its share of all documents.
        alpha = 0.5 + (F.col("other") + F.col("toxic")) * prior
        log_odds = lambda c, n: F.log((c + alpha) / (F.lit(n * (1 + prior) + 1) - c - alpha))
        delta = log_odds(F.col("toxic"), m1) - log_odds(F.col("other"), m0)
        z = delta / F.sqrt(1 / (F.col("toxic") + alpha) + 1 / (F.col("other") + alpha))
        own = own.where(F.col("toxic") + F.col("other") >= least_docs).withColumns({"delta": delta, "z": z})
        return own.where((F.col("z") >= least_z) & (F.col("delta") >= odds)).orderBy(F.desc("z"), "word").limit(lexicon).collect()

    if least_odds is None:
        tokens = [telling(ODDS[0], f) for f in range(FOLDS)]
        least_odds = chosen_odds(sample, [[lexicon_model([r for r in tokens[f] if r["delta"] >= odds], total("other", f), expected, odds) for odds in ODDS] for f in range(FOLDS)])
    model = lexicon_model(telling(least_odds), total("other"), expected, least_odds)
    found = sample.select("text", "label").mapInArrow(evidence_rows(model), "words double, raw double, label int").toArrow()
    n, raw, y = (np.asarray(found[c], float) for c in ("words", "raw", "label"))
    model.log_k = log_k_of(model.rate, raw, n, y, model.log_k)
    level = np.where(raw > 0, np.maximum(model.calibrated(raw, n), 0.0), 0.0)
    model = fitted_logistic(model, sample, level, y)
    return model


def fitted_logistic(model: Model, sample: DataFrame, level: np.ndarray, y: np.ndarray) -> Model:
    """The last step needs the sums of significant segments too, which depend on K: one more pass over the sample."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordWeights(model)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for a, b in row_slices(data, offsets):
                found = evidence(model, table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 2]), pa.array(found[:, 3]), batch.column(1).slice(a, b - a)], names=["best", "sum", "label"])

    found = sample.mapInArrow(rows, "best double, sum double, label int").toArrow()
    x = features(np.c_[np.zeros((len(found), 2)), np.asarray(found["best"], float), np.asarray(found["sum"], float)])
    y = np.asarray(found["label"], float)
    order = np.lexsort((y, *x.T))
    model.logistic = tuple(float(w) for w in logistic_fit(x[order], y[order]))
    return model


def score_of(model: Model, found: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(found), model.constant)
    return sigmoid(features(found) @ np.array(model.logistic[:2]) + model.logistic[2])


def text_scores(model: Model, table: WordWeights, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text, and its evidence."""
    data, offsets = text_bytes(column)
    found = [evidence(model, table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_slices(data, offsets)]
    found = np.concatenate([*found, np.zeros((0, 4))])
    return score_of(model, found), found


def score_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordWeights(model)
        for batch in batches:
            score, _ = text_scores(model, table, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def scores(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit_model(docs, labels, fit_rows)
    scored = docs.select("doc_id", "text").mapInArrow(score_rows(model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def segment_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordWeights(model)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, offsets = text_bytes(pa.array([text], pa.string()))
                words, hits = table.documents(data, offsets)
                spans = [m.span() for m in WORD.finditer(lowered(text or ""))] if hits[0] is not None else []
                for a, b, raw in segments_of(model, int(words[0]), hits[0]):
                    level = float(model.calibrated(np.array(raw), words[0]))
                    if level > -np.log(model.expected):
                        rows.append((doc, a, b + 1, raw, level, text[spans[a][0] : spans[b][1]] if b < len(spans) else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string()))],
                names=[c.split()[0] for c in SEGMENTS.split(", ")],
            )

    return run


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: words begin to end of the document, its scores, and its text."""
    return docs.select("doc_id", "text").mapInArrow(segment_rows(model), SEGMENTS)


def accepted_rows(model: Model, threshold: float = 0.5):
    """For mapInArrow over whole rows: those whose text, in column ``text``, scores below ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordWeights(model)
        for batch in batches:
            score, _ = text_scores(model, table, batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array(score < threshold))

    return run
