"""Whole texts as codes of their distinct blank-separated chunks, in numpy.

Texts are handled as the UTF-8 bytes that Arrow delivers. Every chunk between two blanks gets a 64-bit key,
and each distinct chunk is looked at once: its ids, token count or score is computed from the chunk's text and
remembered. Remembered chunks live in flat arrays; beyond ``limit`` of them, or of bytes to match, the memory starts anew, so it is
bounded whatever the data. A chunk found by its key is compared with the remembered bytes; one that differs from them
takes its next key, so chunks with equal keys are never mixed up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from lakesurvey.llm.common import gather_runs, grown, starts_of, sums_of

#: Bytes of text handled at a time.
SLICE = 2 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_1
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


def run_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each run ``data[start:end]`` as 64-bit words, the last one filled up with zeros, and the number of words of each run."""
    sizes = ends - starts
    counts = (sizes + 7) >> 3
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    anywhere = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at = np.repeat(starts - 8 * starts_of(counts), counts)
    words = anywhere[at + 8 * np.arange(len(at))].astype(np.uint64, copy=False)
    some = counts > 0
    words[np.cumsum(counts)[some] - 1] &= _MASKS[((sizes[some] - 1) & 7) + 1]
    return words, counts


def word_keys(words: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """A 64-bit key, never 0, of each run of words and its tag: every word is scrambled with its place before they are summed."""
    place = np.arange(len(words)) - np.repeat(starts_of(counts), counts)
    salted = mixed(words ^ mixed(place.astype(np.uint64) * _STEP + _MIX_2))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(salted, out=total[1:])
    ends = np.cumsum(counts)
    return mixed(total[ends] - total[ends - counts] + tags.astype(np.uint64) * _MIX_1) | np.uint64(1)


def run_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit key of each byte run ``data[start:end]``, the same for equal runs wherever they stand."""
    return word_keys(*run_words(data, starts, ends), ends - starts)


class KeyIndex:
    """Codes 0, 1, 2... of 64-bit keys: open addressing in two arrays."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.keys = np.zeros(1 << bits, np.uint64)
        self.codes = np.full(1 << bits, -1, np.int32)
        self.shift, self.n = np.uint64(64 - bits), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each key, -1 where it isn't known."""
        mask = len(self.keys) - 1
        slot = (keys >> self.shift).astype(np.int64)
        there = self.keys[slot]
        out = np.where(there == keys, self.codes[slot], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there != 0))
        slot = (slot[open_] + 1) & mask
        while len(open_):
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.codes[slot[hit]]
            go = ~hit & (there != 0)
            open_, slot = open_[go], (slot[go] + 1) & mask
        return out

    def add(self, keys: np.ndarray) -> None:
        """Give distinct new keys the next codes."""
        while 2 * (self.n + len(keys)) > len(self.keys):
            old, codes = self.keys, self.codes
            bits = 65 - int(self.shift)
            n = self.n
            self.clear(bits)
            self.n = n
            self._put(old[old != 0], codes[old != 0])
        self._put(keys, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, codes: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            won = free & (self.keys[slot] == keys)
            self.codes[slot[won]] = codes[won]
            keys, codes, slot = keys[~won], codes[~won], (slot[~won] + 1) & mask


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def plain_cuts(data: np.ndarray, begin: int, end: int, limit: int) -> list[int]:
    """Where a very long text may be cut: before single blanks between visible ASCII characters."""
    cuts, at = [begin], begin + limit
    while at < end - 1:
        window = data[at : min(at + limit + 1, end)]
        seen = (window > 32) & (window < 127)
        good = np.flatnonzero((window[1:-1] == 32) & seen[:-2] & seen[2:])
        if len(good):
            cuts.append(at + 1 + int(good[0]))
            at = cuts[-1] + limit
        else:
            at += limit
    return cuts


def row_slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last


def chunks_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all blank-separated chunks, and where each row's first chunk stands among them."""
    blanks = np.flatnonzero(data == 32)
    rows = len(offsets) - 1
    first = np.arange(rows) + np.searchsorted(blanks, offsets[:-1])
    is_first = np.zeros(len(blanks) + rows, bool)
    is_first[first] = True
    starts, ends = np.empty(len(is_first), np.int64), np.empty(len(is_first), np.int64)
    starts[first], starts[~is_first] = offsets[:-1], blanks + 1
    is_last = np.r_[is_first[1:], np.ones(min(rows, 1), bool)]
    ends[is_last], ends[~is_last] = offsets[1:], blanks
    return starts, ends, first


class ChunkTable:
    """Codes of chunks; a subclass computes in ``learn`` what it wants to know of each new one.

    ``first_counts``: a row's first chunk, which no blank precedes, differs from the same chunk elsewhere.
    """

    def __init__(self, first_counts: bool, limit: int = 1_000_000):
        self.first_counts, self.limit = first_counts, limit
        self.index = KeyIndex()
        self.forget()

    def forget(self) -> None:
        self.index.clear()
        self.seen_words, self.seen_used = np.empty(1 << 16, np.uint64), 0
        self.seen_begin, self.seen_tags = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return chunks_of(data, offsets)

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        raise NotImplementedError

    def coded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all chunks and the number of chunks of each row."""
        if self.index.n > self.limit or self.seen_used > 8 * self.limit:
            self.forget()
        starts, ends, first = self.cut(data, offsets)
        words, counts = run_words(data, starts, ends)
        tags = 2 * (ends - starts)
        if self.first_counts:
            tags[first] += 1
        keys, begin = word_keys(words, counts, tags), starts_of(counts)
        codes = np.empty(len(starts), np.int32)
        todo = np.arange(len(starts))
        while len(todo):
            found = self.index.find(keys[todo])
            missing = np.flatnonzero(found < 0)
            if len(missing):
                new, at = np.unique(keys[todo[missing]], return_index=True)
                at = todo[missing[at]]
                whole = data.tobytes()
                names = [whole[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                self.learn(names, tags[at] % 2 == 1)
                self._keep(gather_runs(words, begin[at], counts[at]), counts[at], tags[at])
                self.index.add(new)
                found[missing] = self.index.find(keys[todo[missing]])
            same = self._same(found, words, begin[todo], counts[todo], tags[todo])
            codes[todo[same]] = found[same]
            todo = todo[~same]
            keys[todo] = mixed(keys[todo]) | np.uint64(1)
        return codes, np.diff(np.r_[first, len(codes)])

    def _keep(self, words: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> None:
        """Remember the bytes of the next codes."""
        self.seen_begin = grown(self.seen_begin, self.index.n, self.seen_used + starts_of(counts))
        self.seen_tags = grown(self.seen_tags, self.index.n, tags)
        self.seen_words = grown(self.seen_words, self.seen_used, words)
        self.seen_used += len(words)

    def _same(self, codes: np.ndarray, words: np.ndarray, begin: np.ndarray, counts: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Whether each chunk has the length, the place and the bytes of the remembered one."""
        same = self.seen_tags[codes] == tags
        if not same.all():
            codes, begin, counts = codes[same], begin[same], counts[same]
        differ = gather_runs(self.seen_words, self.seen_begin[codes], counts) != gather_runs(words, begin, counts)
        same[same] = sums_of(differ, counts) == 0
        return same


class ChunkEncoder(ChunkTable):
    """Ids of whole texts as a ``tokenizers`` vocabulary gives them without added special tokens.

    No pre-tokenizer joins characters across a blank that stands between two other characters, so a text's
    ids are those of its chunks, one after another. Where blanks become part of the ids (``blanks_count``),
    a text with doubled or trailing blanks or a special token goes to the library whole. A chunk that is a
    word of Latin letters and a run of marks goes to the library's merges as these two pre-tokens; every
    other chunk goes through its whole ``encode``.
    """

    def __init__(self, path: str, blanks_count: bool, lower: bool, limit: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blanks_count, self.lower = blanks_count, lower
        letters = "A-Za-zÀ-ÖØ-öø-ÿ"
        marks = re.escape("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
        self.simple = re.compile(f"([{letters}]+)([{marks}]*)").fullmatch
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        spare = iter(range(256, 512))
        shown = {b: chr(b) if b in visible else chr(next(spare)) for b in range(256)}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(256) if c >= 128}
        self.marks: dict[str, list[int]] = {"": []}
        super().__init__(blanks_count, limit)

    def forget(self) -> None:
        super().forget()
        self.flat, self.used = np.empty(1 << 18, np.uint32), 0
        self.begin, self.length, self.odd = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.empty(1 << 16, bool)

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_run(self, run: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(run)]

    def is_odd(self, chunk: str, first: bool) -> bool:
        if not self.blanks_count or first and not chunk:
            return False
        return not chunk or chunk[-1].isspace() or "<|" in chunk or chunk[0].isspace() and not first

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        blank = "Ġ" if self.blanks_count else ""
        shown, simple, marks = self.shown, self.simple, self.marks
        if len(marks) > 100_000:
            marks.clear()
        runs: dict[str, int] = {}
        parts, rest, odd = [], [], np.zeros(len(chunks), bool)
        for k, (chunk, is_first) in enumerate(zip(chunks, first.tolist())):
            if chunk.isascii() and chunk.isalpha():
                word, end = chunk, ""
            elif m := simple(chunk):
                word, end = m.groups()
                if end not in marks:
                    marks[end] = self.ids_of_run(end)
            else:
                rest.append(k)
                parts.append(None)
                continue
            if self.lower:
                word = word.lower()
            if not word.isascii():
                word = word.translate(shown)
            parts.append((runs.setdefault(word if is_first else blank + word, len(runs)), end))
        ids = [[t.id for t in tokens] for tokens in map(self.tokenizer.model.tokenize, runs)]
        found = [None if x is None else ids[x[0]] + marks[x[1]] if x[1] else ids[x[0]] for x in parts]
        if rest:
            lead = " " if self.blanks_count else ""
            own = self.library_ids([chunks[k] if first[k] else lead + chunks[k] for k in rest])
            for k, x in zip(rest, own):
                found[k] = x
                odd[k] = self.is_odd(chunks[k], bool(first[k]))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        n = self.index.n
        self.begin = grown(self.begin, n, self.used + starts_of(sizes))
        self.length = grown(self.length, n, sizes)
        self.odd = grown(self.odd, n, odd)
        flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        self.flat = grown(self.flat, self.used, flat)
        self.used += len(flat)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these rows one after another, and the number of ids of each row."""
        cuts = [plain_cuts(data, int(a), int(b), SLICE) if b - a > 2 * SLICE else [int(a)] for a, b in zip(offsets[:-1], offsets[1:])]
        if sum(map(len, cuts)) > len(cuts):
            # The pieces of one very long text, each apart; a piece after the first begins with its blank.
            parts = [p for c in cuts for p in c] + [int(offsets[-1])]
            done = [self._encode(data[a:b], np.array([0, b - a])) for a, b in zip(parts[:-1], parts[1:])]
            sizes = np.array([int(n[0]) for _, n in done])
            return np.concatenate([ids for ids, _ in done]), sums_of(sizes, np.array([len(c) for c in cuts]))
        return self._encode(data, offsets)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = self.coded(data, offsets)
        bad = sums_of(self.odd[codes], counts) > 0
        whole = {}
        if bad.any():
            rows = np.flatnonzero(bad).tolist()
            whole = dict(zip(rows, self.library_ids([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in rows])))
            codes, counts = codes[np.repeat(~bad, counts)], np.where(bad, 0, counts)
        sizes = self.length[codes]
        ids = gather_runs(self.flat, self.begin[codes], sizes)
        lengths = sums_of(sizes, counts)
        if whole:
            ends, out, last = np.cumsum(lengths), [], 0
            for k, own in whole.items():
                out += [ids[last : ends[k]], np.asarray(own, np.uint32)]
                last, lengths[k] = ends[k], len(own)
            ids = np.concatenate([*out, ids[last:]])
        return ids, lengths

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For slices of the rows: the first row, all ids, and the number of ids of each row."""
        data, offsets = text_bytes(column)
        for a, b in row_slices(data, offsets):
            yield a, *self.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, blanks_count: bool, lower: bool) -> ChunkEncoder:
    """The worker's own encoder for a vocabulary file, kept between tasks."""
    key = (path, blanks_count, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
