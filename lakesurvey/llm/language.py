"""Language identification of mixed texts: script ranges, per-word scores, and a Viterbi path with a switching penalty.

A language's model is a table of trigram log shares over hashed trigrams of its words, with the writing systems that its training
words use. Words are runs of letters, whatever stands between them, cut where the writing system changes and after ``PIECE`` letters, so
that texts without blanks are scored like others. A word is scored by the languages that use its writing system, and by no other; words of a
system that no language uses belong to none. Scores are computed once for each distinct chunk of text. The path through a document's words that has the highest score, less a penalty for
every change of language, labels its spans; the language with most letters is the document's.

Most documents never change their language. Where no run of words gains as much in other languages as one change costs, the best path
is constant; this is tested for all documents at once, and only the others go through the path search, word by word,
many documents at a time.

Fitting uses at most ``fit_rows`` documents with a language, chosen by hashed doc_id, and learns every language that they have. Labelling covers every word of every document.

Defined results: ``und`` with score 0 for null, empty and letterless texts (numerals aren't letters), and where no language was learned; a text whose letters
all belong to writing systems that no learned language uses gets the commonest learned one, with score 0 and no spans; ties go to the language that comes first by name; rows with equal doc_id are labelled each on
their own; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import SLICE, ChunkTable, mixed, row_slices, text_bytes
from lakesurvey.llm.common import gather_runs, grown, small_batches, starts_of, sums_of

WORD = re.compile(r"[^\W\d_]+")
#: First characters of the ranges of writing systems, and the system that begins there.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "other"), (0x20000, "han"),
)
SCRIPT_STARTS = np.array([s for s, _ in SCRIPTS])
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
BUCKETS = 1 << 15
IMPOSSIBLE = -1e4  # a word in a writing system that the language doesn't use, where another one does
PIECE = 16  # letters of a word that are scored as one


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of a text stand: runs of letters. The pattern takes numerals such as a half or a square for letters; they part words here."""
    out = []
    for m in WORD.finditer(text):
        if m.group().isalpha():
            out.append(m.span())
            continue
        letters = [c.isalpha() for c in m.group()]
        edges = [k for k in range(len(letters) + 1) if (k > 0 and letters[k - 1]) != (k < len(letters) and letters[k])]
        out += [(m.start() + a, m.start() + b) for a, b in zip(edges[::2], edges[1::2])]
    return out


def words_of(text: str) -> list[str]:
    return [text[a:b] for a, b in word_spans(text)]


def lowered(text: str) -> str:
    """Lower case with every letter at its place; the only one that would become two is the dotted I."""
    return text.replace("İ", "i").lower()


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of bounded words, one around each letter; letters, writing system and word of each piece of the words."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    chars = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = starts_of(lengths)
    at = gather_runs(np.arange(len(chars)), starts, lengths - 2)
    packed = (chars[at] << np.uint64(42)) ^ (chars[at + 1] << np.uint64(21)) ^ chars[at + 2]
    grams = (mixed(packed) % np.uint64(BUCKETS)).astype(np.int64)
    script = SCRIPT_OF[np.searchsorted(SCRIPT_STARTS, chars[at + 1].astype(np.int64), "right") - 1]
    word, n = np.repeat(np.arange(len(words)), lengths - 2), np.arange(len(at))
    new = np.r_[True, (word[1:] != word[:-1]) | (script[1:] != script[:-1])][: len(at)]
    begin = np.flatnonzero((n - np.maximum.accumulate(np.where(new, n, 0))) % PIECE == 0)
    return grams, np.diff(np.r_[begin, len(at)]), script[begin], word[begin]


@dataclass
class Model:
    languages: list[str]
    shares: list[tuple[np.ndarray, np.ndarray, float]]  # by language: trigram buckets that occur, their log shares, and that of any other
    scripts: np.ndarray  # languages x writing systems: whether used
    penalty: float = 12.0
    commonest: int = 0  # the language with most trigrams in the sample


class WordScores(ChunkTable):
    """A chunk's code leads to its words: the score of each in each language, its letters, and whether any language can write it."""

    def __init__(self, model: Model, limit: int = 500_000):
        self.model = model
        # What is remembered grows with the number of languages.
        super().__init__(False, limit * 8 // max(8, len(model.languages)))

    def forget(self) -> None:
        super().forget()
        width = max(1, len(self.model.languages))
        self.begin, self.count, self.used = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0
        self.score = np.zeros((1 << 14, width), np.float32)
        self.letters, self.known = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, bool)

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > self.limit:
            self.forget()
        return super().coded(data, offsets)

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        words, counts = [], []
        for chunk in chunks:
            own = [lowered(chunk)] if chunk.isalpha() else words_of(lowered(chunk))
            words += own
            counts.append(len(own))
        width = len(self.model.languages)
        grams, sizes, script, word = word_grams(words)
        pieces = np.bincount(np.repeat(np.arange(len(chunks)), counts)[word], minlength=len(chunks))
        self.begin = grown(self.begin, self.index.n, self.used + starts_of(pieces))
        self.count = grown(self.count, self.index.n, pieces)
        n, need = self.used, self.used + len(sizes)
        self.letters = grown(self.letters, n, sizes)
        self.known = grown(self.known, n, self.model.scripts[:, script].any(axis=0))
        if need > len(self.score):
            self.score = np.concatenate([self.score, np.zeros((max(need, 2 * len(self.score)) - len(self.score), self.score.shape[1]), np.float32)])
        if width and len(sizes):
            share = np.empty(BUCKETS)
            for k, (buckets, logs, rest) in enumerate(self.model.shares):
                share.fill(rest)
                share[buckets] = logs
                own = np.add.reduceat(share[grams], starts_of(sizes))
                own += np.where(self.model.scripts[k, script], 0, IMPOSSIBLE)
                # What no language can write is no reason for a change.
                self.score[n:need, k] = np.where(self.known[n:need], own, 0)
        self.used = need

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of these texts are remembered, the words of each text, and those of each chunk."""
        codes, counts = self.coded(data, offsets)
        own, begin = self.count[codes], self.begin[codes]
        at = np.repeat(begin - starts_of(own), own) + np.arange(own.sum())
        return at, sums_of(own, counts), own


def constant_paths(score: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Each document's best single language, and whether no path with changes can beat it.

    A path that leaves that language gains at most the sum, over the words where it is elsewhere, of what the best other
    language has more; a stretch elsewhere costs one change at least. So none pays if no run of words gains more than a change.
    """
    ends = np.cumsum(counts)
    total = np.concatenate([np.zeros((1, score.shape[1])), np.cumsum(score, axis=0, dtype=np.float64)])
    best = (total[ends] - total[ends - counts]).argmax(axis=1)
    row = np.repeat(np.arange(len(counts)), counts)
    own = score[np.arange(len(score)), best[row]]
    gain = score.max(axis=1).astype(np.float64) - own
    if score.shape[1] > 1:
        others = score.astype(np.float64).copy()
        others[np.arange(len(score)), best[row]] = -np.inf
        gain = others.max(axis=1) - own
    else:
        gain = np.full(len(score), -1.0)
    # Largest sum of a run within each document: cumulated gain less its lowest value before, rows kept apart by an offset.
    run = np.cumsum(gain)
    before = np.r_[0.0, run[:-1]] if len(run) else run
    out = np.zeros(len(counts))
    base = np.repeat(before[np.minimum(ends - counts, max(len(run) - 1, 0))], counts) if len(run) else run
    low = before - base
    # The lowest value so far within the row, by a running minimum over values shifted down row by row.
    span = (np.abs(low).max() + 1) * 2 if len(low) else 1.0
    low = np.minimum.accumulate(low - row * span) + row * span
    top = run - base - low
    some = counts > 0
    if some.any():
        out[some] = np.maximum.reduceat(top, (ends - counts)[some])
    return best, out <= penalty


def viterbi(score: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """Language of each word on the best path of its document; documents are done side by side, longest first."""
    order = np.argsort(-counts, kind="stable")
    starts, sizes = starts_of(counts)[order], counts[order]
    steps, width = int(sizes[0]) if len(sizes) else 0, score.shape[1]
    live = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")  # documents that have a word at each step
    offset = np.r_[0, np.cumsum(live)]
    came = np.empty((int(offset[-1]), width), np.int8 if width < 128 else np.int32)
    value = np.zeros((len(sizes), width))
    own = np.arange(width)
    for t in range(steps):
        n = live[t]
        before = value[:n]
        top = before.argmax(axis=1)
        jump = before[np.arange(n), top] - penalty
        change = jump[:, None] > before if t else np.zeros((n, width), bool)
        came[offset[t] : offset[t + 1]] = np.where(change, top[:, None], own)
        value[:n] = np.where(change, jump[:, None], before) + score[starts[:n] + t]
    out = np.empty(len(score), np.int64)
    state = value.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        n = live[t]
        out[starts[:n] + t] = state[:n]
        state[:n] = came[offset[t] : offset[t + 1]][np.arange(n), state[:n]]
    return out


def word_languages(table: WordScores, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language (-1: none) and letters of each word, words of each text, and words of each chunk."""
    at, counts, own = table.words(data, offsets)
    score, letters = table.score[at], table.letters[at].astype(np.int64)
    if not table.model.languages:
        return np.full(len(at), -1), letters, counts, own
    best, constant = constant_paths(score, counts, table.model.penalty)
    out = np.repeat(best, counts)
    if not constant.all():
        some = np.repeat(~constant, counts)
        out[some] = viterbi(score[some], counts[~constant], table.model.penalty)
    # A word that no language can write belongs to none.
    out[~table.known[at]] = -1
    return out, letters, counts, own


def labelled_texts(table: WordScores, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number (-1: und), score and number of spans of each text."""
    language, letters, counts, _ = word_languages(table, data, offsets)
    rows, width = len(counts), max(1, len(table.model.languages))
    row = np.repeat(np.arange(rows), counts)
    known = (language >= 0) & (letters > 0)
    by_language = np.bincount(row[known] * width + language[known], letters[known], rows * width).reshape(rows, width)
    best, most = by_language.argmax(axis=1), by_language.max(axis=1)
    total = sums_of(letters, counts)
    seen = language[known]
    seen_row = row[known]
    new = np.r_[True, (seen[1:] != seen[:-1]) | (seen_row[1:] != seen_row[:-1])][: len(seen)]
    spans = np.bincount(seen_row[new], minlength=rows)
    # Letters that no learned language uses: the commonest language, with the least score.
    other = np.where((total > 0) & bool(table.model.languages), table.model.commonest, -1)
    return np.where(most > 0, best, other), most / np.maximum(total, 1), spans


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: text and lang to counts by language, kind (trigram or writing system) and bucket."""
    for batch in batches:
        words: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words.setdefault(lang, []).extend(words_of(lowered(text or "")))
        for lang, own in words.items():
            if own:
                grams, _, script, _ = word_grams(own)
                for kind, values, size in ((0, grams, BUCKETS), (1, script, len(SCRIPT_NAMES))):
                    counts = np.bincount(values, minlength=size)
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])],
                        names=["lang", "kind", "bucket", "n"],
                    )


def fit_model(docs: DataFrame, fit_rows: int = 20_000, least_share: float = 0.001, penalty: float = 12.0) -> Model:
    """Trigram shares and writing systems of all languages of the sample; only trigrams that a language has are held, so the sample bounds them.

    A writing system counts for a language if ``least_share`` of its words are in it.
    """
    small_batches(docs.sparkSession)
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    chosen = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = known.select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), "doc_id")
    counted = sample.select("text", "lang").mapInArrow(gram_rows, "lang string, kind int, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    found = counted.toArrow().to_pandas()
    found = found.sort_values(["lang", "kind", "bucket"], ignore_index=True)
    names, shares, totals = sorted(found["lang"].unique()), [], []
    scripts = np.zeros((max(1, len(names)), len(SCRIPT_NAMES)), bool)
    for name, own in found.groupby("lang", sort=True):
        grams, script = own[own["kind"] == 0], own[own["kind"] == 1]
        counts = grams["n"].to_numpy()
        total = counts.sum() + 0.5 * BUCKETS
        totals.append(int(counts.sum()))
        scripts[len(shares), script["bucket"].to_numpy()] = script["n"].to_numpy() >= max(1, least_share * script["n"].sum())
        shares.append((grams["bucket"].to_numpy(), np.log((counts + 0.5) / total).astype(np.float32), float(np.log(0.5 / total))))
    return Model(names, shares, scripts, penalty, int(np.argmax(totals)) if totals else 0)


def label_rows(model: Model):
    """For mapInArrow: doc_id and text to doc_id, lang_pred, score, n_spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(model)
        names = np.array([*model.languages, "und"], object)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(data, offsets, SLICE * 8 // max(8, len(model.languages))):
                best, score, spans = labelled_texts(table, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays(
                    [docs.slice(a, b - a), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(best >= 0, score, 0.0)), pa.array(spans.astype(np.int64))],
                    names=["doc_id", "lang_pred", "score", "n_spans"],
                )

    return run


def languages(docs: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the share of letters in that language), n_spans of every document."""
    model = fit_model(docs, fit_rows)
    labelled = docs.select("doc_id", "text").mapInArrow(label_rows(model), "doc_id long, lang_pred string, score double, n_spans long")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_spans")


def piece_places(chunk: str) -> list[tuple[int, int]]:
    """Where each word of a chunk begins and ends."""
    found = word_spans(lowered(chunk))
    _, sizes, _, word = word_grams([lowered(chunk)[a:b] for a, b in found])
    begins = np.array([a for a, _ in found])[word] + starts_of(sizes) - starts_of(np.bincount(word, sizes).astype(np.int64))[word]
    return list(zip(begins.tolist(), (begins + sizes).tolist()))


def span_rows(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordScores(model)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, offsets = text_bytes(pa.array([text], pa.string()))
                language, _, _, own = word_languages(table, data, offsets)
                at, w = 0, 0
                for chunk, n in zip((text or "").split(" "), own.tolist()):
                    places = piece_places(chunk) if n > 1 else [(0, len(chunk))] * n
                    for k, (begin, end) in enumerate(places):
                        # Marks before the first word and behind the last one of a chunk go with it.
                        begin, end = at + (begin if k else 0), at + (end if k + 1 < n else len(chunk))
                        if rows and rows[-1][0] == doc and rows[-1][3] == language[w]:
                            rows[-1][2] = end
                        else:
                            rows.append([doc, begin, end, int(language[w])])
                        w += 1
                    at += len(chunk) + 1
            names = [*model.languages, "und"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.array([names[r[3]] for r in rows], pa.string())], names=["doc_id", "begin", "end", "lang"]
            )

    return run


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """The spans of every document: characters begin to end, and their language."""
    return docs.select("doc_id", "text").mapInArrow(span_rows(model), "doc_id long, begin long, end long, lang string")
