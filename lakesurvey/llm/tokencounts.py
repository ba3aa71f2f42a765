"""Token counts of a sentencepiece BPE vocabulary by rank-synchronous array merging.

Every distinct pre-token (a run of blanks and the characters up to the next blank) is counted once. A batch of them is held as
ragged numpy arrays of piece ids; in each step every sequence merges its pair of best score, the leftmost of equals, all
sequences at the same time, until none has a pair left. What survives is counted; a character
without a piece counts as its UTF-8 bytes. The vocabulary file supplies pieces and scores; the library itself doesn't encode.

Defined results: null and empty texts have no tokens; rows with equal doc_id give a row each; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakesurvey.llm.chunks import ChunkTable, KeyIndex, mixed, row_slices, text_bytes
from lakesurvey.llm.common import gather_runs, grown, small_batches, starts_of, sums_of
from lakesurvey.llm.merges import merged

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
BLANK = "▁"
LONG = 256  # symbols beyond which a pre-token is merged on its own


class Pieces:
    """Pieces and scores of a sentencepiece BPE model, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        ids = {model.id_to_piece(i): i for i in plain}
        self.unknown = size
        # Best score first: rank 0 merges before all others.
        order = sorted(plain, key=lambda i: (-model.get_score(i), i))
        self.rank = np.full(size + 1, 2**30, np.int32)
        score_rank, last, r = {}, None, -1
        for i in order:
            if model.get_score(i) != last:
                last, r = model.get_score(i), r + 1
            score_rank[i] = r
        self.rank[list(score_rank)] = list(score_rank.values())
        self.of_char = np.full(0x110000, size, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        pairs = {(ids[p[:k]], ids[p[k:]]): i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        self.pairs = pairs
        left, right = (np.array(x, np.uint64) for x in zip(*pairs))
        self.index, self.width = KeyIndex(20), np.uint64(size + 1)
        self.index.add(self._key(left, right))
        self.made = np.array(list(pairs.values()), np.int32)
        #: Whether a piece holds a blank behind another character; then texts couldn't be cut at blanks.
        self.joins_words = any(BLANK in p.lstrip(BLANK) for p in ids)

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mixed(left.astype(np.uint64) * self.width + right.astype(np.uint64) + np.uint64(1))

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank of each pair; rank 2**30 where the pair makes no piece."""
        at = self.index.find(self._key(left, right))
        made = np.where(at >= 0, self.made[at], self.unknown)
        return made, self.rank[made]

    def pair_of(self, left: int, right: int) -> tuple[int, int] | None:
        made = self.pairs.get((left, right))
        return None if made is None else (int(self.rank[made]), made)


def surviving(pieces: Pieces, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of each sequence after all merges, and the number of sequences' symbols.

    A step looks at the best pair of every live sequence, merges it, and ranks only the two pairs beside it anew. Sequences without a
    pair leave the arrays.
    """
    none = np.int32(2**30)
    out_symbols: list[np.ndarray] = []
    out_order: list[np.ndarray] = []
    out_lengths: list[np.ndarray] = []
    who = np.arange(len(lengths))
    seq, size = symbols.astype(np.int32), lengths.astype(np.int64)
    made, rank = np.full(len(seq), pieces.unknown, np.int32), np.full(len(seq), none)
    if len(seq) > 1:
        made[:-1], rank[:-1] = pieces.pair(seq[:-1], seq[1:])
    ends = np.cumsum(size)
    rank[ends[size > 0] - 1] = none  # a pair doesn't reach into the next sequence
    while len(who):
        begin = starts_of(size)
        some = size > 0
        best = np.full(len(size), none)
        best[some] = np.minimum.reduceat(rank, begin[some]) if some.any() else none
        live = best < none
        if not live.all():
            keep = np.repeat(live, size)
            out_symbols.append(seq[~keep])
            out_order.append(who[~live])
            out_lengths.append(size[~live])
            seq, made, rank = seq[keep], made[keep], rank[keep]
            who, size, best = who[live], size[live], best[live]
            if not len(who):
                break
            begin = starts_of(size)
        # The leftmost place of the best rank in each sequence.
        hits = np.flatnonzero(rank == np.repeat(best, size))
        owner = np.repeat(np.arange(len(size)), size)[hits]
        at = hits[np.r_[True, owner[1:] != owner[:-1]]]
        seq[at] = made[at]
        gone = np.ones(len(seq), bool)
        gone[at + 1] = False
        at = at - np.arange(len(at))  # one symbol left each earlier sequence
        seq, made, rank = seq[gone], made[gone], rank[gone]
        size = size - 1
        begin = starts_of(size)
        last = begin + size - 1
        inner = at < last
        rank[at[~inner]] = none
        a = at[inner]
        made[a], rank[a] = pieces.pair(seq[a], seq[a + 1])
        b = at[at > begin] - 1
        made[b], rank[b] = pieces.pair(seq[b], seq[b + 1])
    order = np.concatenate(out_order) if out_order else np.zeros(0, np.int64)
    sizes = np.concatenate(out_lengths) if out_lengths else np.zeros(0, np.int64)
    flat = np.concatenate(out_symbols) if out_symbols else np.zeros(0, np.int32)
    back = np.argsort(order, kind="stable")
    return gather_runs(flat, starts_of(sizes)[back], sizes[back]), sizes[back]


class TokenCounter(ChunkTable):
    """Token counts of texts; a chunk's code leads to the count of blank plus chunk."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.pieces = Pieces(path)
        if self.pieces.joins_words:
            raise ValueError("this vocabulary has pieces that reach across words")
        super().__init__(False, limit)

    def forget(self) -> None:
        super().forget()
        self.tokens = np.empty(1 << 16, np.int64)

    def counts_of(self, runs: list[str]) -> np.ndarray:
        """Tokens of pre-tokens that hold blanks as they are to be read (already marked)."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        chars = np.frombuffer("".join(runs).encode("utf-32-le"), np.uint32)
        symbols = self.pieces.of_char[chars]
        # A character without a piece counts as its bytes.
        size = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        out = sums_of(np.where(symbols == self.pieces.unknown, size - 1, 0), lengths)
        short = lengths <= LONG
        keep = np.repeat(short, lengths)
        _, left = surviving(self.pieces, symbols[keep], lengths[short])
        out[short] += left
        for k in np.flatnonzero(~short).tolist():
            begin = int(lengths[:k].sum())
            out[k] += len(merged(symbols[begin : begin + int(lengths[k])].tolist(), self.pieces.pair_of))
        return out

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        # A chunk that is empty or ends in a blank mark lengthens the run of blanks after it: such texts are read anew.
        counts = self.counts_of([BLANK + c for c in chunks])
        empty = np.fromiter((not c or c[-1] == BLANK for c in chunks), bool, len(chunks))
        self.tokens = grown(self.tokens, self.index.n, np.where(empty, -1, counts))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, counts = self.coded(data, offsets)
        tokens = self.tokens[codes]
        out = sums_of(tokens, counts)
        sizes = np.diff(offsets)
        blanks = sums_of(tokens < 0, counts) > 0
        for k in np.flatnonzero(blanks & (sizes > 0)).tolist():
            out[k] = self.count_spaced(data[offsets[k] : offsets[k + 1]].tobytes().decode())
        out[sizes == 0] = 0
        return out

    def count_spaced(self, text: str) -> int:
        """A text with several blanks in a row, or at its ends: its runs of blanks go with the word after them."""
        runs, blanks = [], 1
        words = text.replace(BLANK, " ").split(" ")
        for k, word in enumerate(words):
            if word:
                runs.append(BLANK * blanks + word)
                blanks = 1
            elif k + 1 < len(words):
                blanks += 1
            else:
                runs.append(BLANK * blanks)
        distinct = list(dict.fromkeys(runs))
        count = dict(zip(distinct, self.counts_of(distinct).tolist()))
        return sum(count[r] for r in runs)


_COUNTERS: dict[str, TokenCounter] = {}


def count_rows(path: str, limit: int):
    """For mapInArrow: doc_id and text to the counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _COUNTERS:
            _COUNTERS[path] = TokenCounter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            tokens = np.zeros(batch.num_rows, np.int64)
            for a, b in row_slices(data, offsets):
                tokens[a:b] = counter.count(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """Bytes and tokens of each document, and whether it has more than ``limit`` tokens."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(count_rows(model, limit), COUNTS)
