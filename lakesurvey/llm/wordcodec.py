"""BPE encoding by speculation and verification, and decoding, for a word vocabulary with word ends.

Distinct pre-tokens are encoded in batches. Greedy longest match proposes tokens for all of them at once: hashes of all substrings
up to the longest token are looked up in one table. A proposal is the merge result exactly when every two
adjacent tokens would also come out of merging their own text, which is checked for all distinct pairs in numpy by undoing
merges from both sides of the border. Only words with a failing pair undergo exact merging. Normalising and splitting follow
the vocabulary's own rules: by pattern for Latin text, by the library's normaliser and pre-tokenizer for other chunks.

Defined results: null and empty texts have no ids and decode to the empty text; rows with equal doc_id give a row each; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakesurvey.llm.chunks import ChunkTable, KeyIndex, mixed, row_slices, run_keys, text_bytes
from lakesurvey.llm.common import gather_runs, grown, small_batches, starts_of, sums_of
from lakesurvey.llm.merges import merged
from lakesurvey.llm.tokencounts import LONG, surviving

CODEC = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
END = "</w>"
LATIN = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼½¾"
WHITE = r"\t-\r \x85\xa0"


def byte_signs() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Merges:
    """A vocabulary's tokens and merges as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.texts = [""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.texts[i] = token
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        n = len(self.texts)
        self.unknown = -1
        self.rank = np.full(n, -1, np.int32)  # when a token is made; -1: never, it is a byte
        self.left, self.right = np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            made = vocab[a + b]
            if self.rank[made] >= 0:
                raise ValueError("this vocabulary makes a token in two ways; adjacent pairs don't decide then")
            self.rank[made], self.left[made], self.right[made] = r, vocab[a], vocab[b]
            self.pairs[vocab[a], vocab[b]] = (r, made)
        self.width = np.uint64(n)
        self.pair_index = KeyIndex(18)
        left, right = (np.array(x, np.uint64) for x in zip(*self.pairs))
        self.pair_index.add(self._pair_key(left, right))
        self.pair_rank, self.pair_made = (np.array(x, np.int32) for x in zip(*self.pairs.values()))
        signs = {c: b for b, c in enumerate(byte_signs())}
        plain = np.zeros(256, np.int32)
        ending = np.zeros(256, np.int32)
        words: list[tuple[bytes, bool, int]] = []
        for i, token in enumerate(self.texts):
            end = token.endswith(END)
            body = token[: -len(END)] if end else token
            if not body or any(c not in signs for c in body):
                continue
            raw = bytes(signs[c] for c in body)
            if len(raw) == 1:
                (ending if end else plain)[raw[0]] = i
            if len(raw) == 1 or self.rank[i] >= 0:
                words.append((raw, end, i))
        self.plain, self.ending = plain, ending
        #: Tokens by the key of their bytes, those with a word's end apart; only such that merging their own text gives.
        self.inner, self.final = self._by_text([w for w in words if not w[1]]), self._by_text([w for w in words if w[1]])
        self.longest = max(len(w[0]) for w in words)

    def _pair_key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return mixed(left.astype(np.uint64) * self.width + right.astype(np.uint64) + np.uint64(1))

    def _by_text(self, words: list[tuple[bytes, bool, int]]) -> tuple[KeyIndex, np.ndarray]:
        data = np.frombuffer(b"".join(w[0] for w in words), np.uint8)
        sizes = np.array([len(w[0]) for w in words])
        begin, ids = starts_of(sizes), np.array([w[2] for w in words], np.int32)
        got, lengths = self.exact_batch(data, begin, sizes, words[0][1])
        good = (lengths == 1) & (got[starts_of(lengths)] == ids)
        index = KeyIndex(18)
        index.add(run_keys(data, begin, begin + sizes)[good])
        return index, ids[good]

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and rank of each pair; rank 2**30 where the pair isn't merged."""
        at = self.pair_index.find(self._pair_key(left, right))
        return np.where(at >= 0, self.pair_made[at], -1), np.where(at >= 0, self.pair_rank[at], np.int32(2**30))

    def exact_batch(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens by merging in rank order, all of them at a time, and the number of ids of each."""
        raw = gather_runs(data, starts, sizes)
        symbols = self.plain[raw]
        if end:
            last = np.cumsum(sizes) - 1
            symbols[last] = self.ending[raw[last]]
        short = sizes <= LONG
        ids, lengths = surviving(self, symbols[np.repeat(short, sizes)], sizes[short])
        if short.all():
            return ids, lengths
        begin, out, kept, sizes_out = starts_of(sizes), [], starts_of(lengths), np.zeros(len(sizes), np.int64)
        sizes_out[short] = lengths
        place = np.cumsum(short) - 1
        for k in range(len(sizes)):
            if short[k]:
                out.append(ids[kept[place[k]] : kept[place[k]] + lengths[place[k]]])
            else:
                own = symbols[begin[k] : begin[k] + sizes[k]].tolist()
                out.append(np.array(merged(own, lambda a, b: self.pairs.get((a, b))), np.int32))
                sizes_out[k] = len(out[-1])
        return np.concatenate(out), sizes_out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the text of both tokens gives these two tokens.

        Going back in time, the symbols at the border are ``left`` and ``right`` until the younger of them is taken
        apart. While both stand there, a merge across the border would have come first if its rank is below the rank
        at which one of them was used up; of equal ranks the one further left comes first.
        """
        ok = np.ones(len(left), bool)
        live = np.arange(len(left))
        left, right = left.copy(), right.copy()
        limit = np.full(len(left), 2**30, np.int32)
        while len(live):
            at = self.pair_index.find(self._pair_key(left, right))
            rank = np.where(at >= 0, self.pair_rank[at], 2**30)
            bad = rank < limit
            ok[live[bad]] = False
            born_left, born_right = self.rank[left], self.rank[right]
            undo_left = born_left > born_right
            limit = np.where(undo_left, born_left, born_right + 1)
            goes = ~bad & (np.maximum(born_left, born_right) >= 0)
            left = np.where(undo_left, self.right[left], left)[goes]
            right = np.where(undo_left, right, self.left[right])[goes]
            live, limit = live[goes], limit[goes]
        return ok

    def longest_match(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of these words: length and id of the longest token that starts there."""
        n = len(data)
        rest = np.repeat(starts + sizes, sizes) - np.arange(n)
        reach = np.ones(n, np.int32)
        token = np.where(rest == 1, self.ending[data], self.plain[data])
        places = np.flatnonzero((rest > 1))
        for size in range(2, self.longest + 1):
            places = places[rest[places] >= size]
            if not len(places):
                break
            keys = run_keys(data, places, places + size)
            last = rest[places] == size
            for (index, ids), some in ((self.inner, ~last), (self.final, last)):
                at = index.find(keys[some])
                hit = at >= 0
                where = places[some][hit]
                reach[where], token[where] = size, ids[at[hit]]
        return reach, token

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """All ids of these pre-tokens one after another, ids of each, and how many words failed the check."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        starts = starts_of(sizes)
        reach, token = self.longest_match(data, starts, sizes)
        # Walk all words at once: mark the places where proposed tokens start.
        chosen = np.zeros(len(data), bool)
        at, end = starts[sizes > 0], (starts + sizes)[sizes > 0]
        while len(at):
            chosen[at] = True
            at = at + reach[at]
            go = at < end
            at, end = at[go], end[go]
        places = np.flatnonzero(chosen)
        ids = token[places]
        owner = np.searchsorted(starts, places, "right") - 1
        lengths = np.bincount(owner, minlength=len(words)).astype(np.int64)
        both = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = ids[both].astype(np.int64) * int(self.width) + ids[both + 1]
        distinct, back = np.unique(pairs, return_inverse=True)
        good = self.compatible((distinct // int(self.width)).astype(np.int32), (distinct % int(self.width)).astype(np.int32))
        failed = np.unique(owner[both[~good[back]]])
        if len(failed):
            own, own_lengths = self.exact_batch(data, starts[failed], sizes[failed])
            # Put the exact ids of failed words between the proposed ids of the others.
            both_ids = np.concatenate([ids, own])
            begin = starts_of(lengths)
            begin[failed] = len(ids) + starts_of(own_lengths)
            lengths[failed] = own_lengths
            ids = gather_runs(both_ids, begin, lengths)
        return ids, lengths, len(failed)


class WordCodec(ChunkTable):
    """Ids and decoded texts of whole texts; a chunk's code leads to its ids."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)  # for its normaliser, pre-tokenizer and added tokens only
        self.merges = Merges(path)
        self.simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[{NUMBERS}]|[^{WHITE}{LATIN}{NUMBERS}]+").findall
        self.latin = re.compile("[\0-\xff]*").fullmatch
        self.signs = {c: b for b, c in enumerate(byte_signs())}
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        known = dict(enumerate(self.merges.texts)) | {i: t for t, i in self.added.items()}
        self.texts = np.array([known.get(i, "") for i in range(max(known) + 1)], object)
        super().__init__(False, limit)

    def forget(self) -> None:
        super().forget()
        self.flat, self.used = np.empty(1 << 18, np.uint32), 0
        self.begin, self.length = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32)
        self.words: dict[bytes, int] = {}
        self.failed = 0

    def pre_tokens(self, chunk: str) -> list[bytes]:
        if self.latin(chunk):
            return [w.encode() for w in self.simple(chunk.lower())]
        text = self.tokenizer.normalizer.normalize_str(chunk)
        return [bytes(self.signs[c] for c in w) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        words: dict[bytes, int] = {}
        parts, counts = [], []
        for chunk in chunks:
            if chunk.isascii() and chunk.isalpha():
                parts.append(words.setdefault(chunk.lower().encode(), len(words)))
                counts.append(1)
                continue
            n = len(parts)
            for piece in self.special.split(chunk) if "<|" in chunk else (chunk,):
                if piece in self.added:
                    parts.append(-1 - self.added[piece])
                elif piece:
                    parts += [words.setdefault(w, len(words)) for w in self.pre_tokens(piece)]
            counts.append(len(parts) - n)
        flat, sizes, failed = self.merges.encode(list(words))
        self.failed += failed
        # Added tokens are words of one id behind the others.
        parts = np.array(parts, np.int64)
        own = np.flatnonzero(parts < 0)
        sizes = np.r_[sizes, np.ones(len(own), np.int64)]
        flat = np.r_[flat, (-1 - parts[own]).astype(flat.dtype)]
        parts[own] = len(words) + np.arange(len(own))
        ids = gather_runs(flat, starts_of(sizes)[parts], sizes[parts])
        lengths = sums_of(sizes[parts], np.array(counts, np.int64))
        n = self.index.n
        self.begin = grown(self.begin, n, self.used + starts_of(lengths))
        self.length = grown(self.length, n, lengths)
        self.flat = grown(self.flat, self.used, ids)
        self.used += len(ids)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = self.coded(data, offsets)
        sizes = self.length[codes]
        return gather_runs(self.flat, self.begin[codes], sizes), sums_of(sizes, counts)

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes without a decoder step: the tokens' own texts, a blank between them."""
        return " ".join(self.texts[ids])


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def digest_rows(path: str):
    """For mapInArrow: doc_id and text to the digests of each document's ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(data, offsets):
                ids, lengths = own.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                raw = ids.astype("<u4", copy=False)
                runs = list(zip(starts_of(lengths).tolist(), np.cumsum(lengths).tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.slice(a, b - a),
                        pa.array(lengths),
                        pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in runs], pa.string()),
                        pa.array([hashlib.sha256(own.decode(ids[i:j]).encode()).hexdigest() for i, j in runs], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Number of ids of each document, and digests of its ids and of the text they decode to."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(digest_rows(tokenizer), CODEC)
