"""Sentencepiece encoding and decoding that keeps the place of every piece in the original text.

A text is normalised first: at each character the longest prefix that the model's compiled character map knows is replaced, other
characters stand for themselves. All places of a batch walk the map's double array together, one byte a step; only matches
of several characters are then taken in order, since they hide the places within them. Every normalised byte records the original byte its
unit began at. Blanks are one byte here (the blank mark of the vocabulary), the marker at the beginning has no length in the original.

The normalised text is cut to pre-tokens, runs of blanks with the characters after them, which no piece of the vocabulary crosses.
Each distinct one is merged once (best score first, the leftmost of equals; one of more than 256 symbols with a heap, as merging
in arrays takes a step for each merge of the longest) and remembered with its pieces and their lengths. The lengths,
summed along the text and looked up in the alignment, give each piece its original byte span. A character without a piece is spelled in byte
pieces, of which the last one has the character's span and the others are empty. Decoding puts the pieces' bytes together.

Defined results: null and empty texts have no pieces and decode to an empty text; repeated rows give a row each; an empty table no
rows; other columns don't matter. A text of any length is encoded whole; where the model has no character map, a text of more than two
slices is encoded slice by slice, cut at blanks between visible ASCII characters, so working arrays stay bounded; with a map they grow with the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakesurvey.llm.chunks import SLICE, ChunkTable, plain_cuts, row_slices, text_bytes
from lakesurvey.llm.common import gather_runs, grown, small_batches, starts_of, sums_of
from lakesurvey.llm.merges import merged
from lakesurvey.llm.tokencounts import BLANK, LONG, Pieces, surviving

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPANS = "doc_id long, ids array<int>, begins array<long>, ends array<long>"
MARK = np.frombuffer(BLANK.encode(), np.uint8)


def starts_character(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


class CharMap:
    """The compiled character map of a model: a double array of prefixes and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4) if blob else np.zeros(0, np.uint32)
        self.texts = np.frombuffer(blob, np.uint8, len(blob) - 4 - size, 4 + size) if blob else np.zeros(0, np.uint8)
        ends = np.flatnonzero(self.texts == 0)
        self.ends = np.r_[ends, len(self.texts)]

    def __len__(self) -> int:
        return len(self.units)

    @staticmethod
    def _base(units: np.ndarray) -> np.ndarray:
        """Where a node's children lie, relative to the node."""
        return ((units >> 10) << ((units & 0x200) >> 6)).astype(np.int64)

    def longest(self, data: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the length of the longest known prefix of ``data[place:end]``, 0 if none, and where its replacement begins."""
        length, value = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live, where, stop = np.arange(len(at)), at, ends
        node = np.broadcast_to(self._base(self.units[:1]), len(at)) if len(at) else np.zeros(0, np.int64)
        depth = 0
        while len(live):
            inside = where + depth < stop
            live, where, stop, node = live[inside], where[inside], stop[inside], node[inside]
            byte = data[where + depth]
            node = node ^ byte
            unit = self.units[np.minimum(node, len(self.units) - 1)]
            on = (node < len(self.units)) & ((unit & np.uint32(0x800000FF)) == byte)
            live, where, stop, node, unit = live[on], where[on], stop[on], node[on], unit[on]
            node = node ^ self._base(unit)
            depth += 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]] = depth
            value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        return length, value


class Normalised(NamedTuple):
    """Normalised bytes of rows, their row offsets, and for each byte, and the end of each row, the original byte it comes from.

    Row ``k`` has its sources at ``offsets[k] + k``: one more than it has bytes.
    """

    data: np.ndarray
    offsets: np.ndarray
    source: np.ndarray


class Normaliser:
    """The normalisation of a sentencepiece model."""

    def __init__(self, spec):
        if not spec.escape_whitespaces:
            raise ValueError("a normalisation that keeps blanks isn't supported")
        self.map = CharMap(spec.precompiled_charsmap)
        self.lead, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The longest-prefix units of the rows, replaced: all bytes, the original place each comes from, each row's size, and where it begins.

        A row begins at its first unit, or, where blanks are squeezed, at the first one that isn't a blank.
        """
        if not len(self.map):
            return data, np.arange(len(data)), np.diff(offsets), self._beginnings(np.arange(len(data)), data == 32, offsets)
        at = np.flatnonzero(starts_character(data))
        row = np.searchsorted(offsets, at, "right") - 1
        length, value = self.map.longest(data, offsets[row + 1], at)
        own = np.diff(np.r_[at, len(data)])
        wide = np.flatnonzero(length > own)
        hidden, reach = np.zeros(len(at), bool), 0
        last = np.searchsorted(at, at[wide] + length[wide])
        for k, end in zip(wide.tolist(), last.tolist()):
            if k >= reach:
                hidden[k + 1 : end] = True
                reach = end
        at, length, value, own, row = (x[~hidden] for x in (at, length, value, own, row))
        known = length > 0
        text_end = self.map.ends[np.searchsorted(self.map.ends, value)]
        sizes = np.where(known, text_end - value, own)
        both = np.concatenate([data, self.map.texts])
        begin = np.where(known, len(data) + value, at)
        blank = (sizes == 1) & (both[np.minimum(begin, len(both) - 1)] == 32)
        return gather_runs(both, begin, sizes), np.repeat(at, sizes), np.bincount(row, sizes, len(offsets) - 1).astype(np.int64), self._beginnings(at, blank, offsets)

    def _beginnings(self, at: np.ndarray, blank: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.squeeze:
            return offsets[:-1]
        visible = np.r_[at[~blank], offsets[-1]]
        return np.minimum(visible[np.searchsorted(visible[:-1], offsets[:-1])], offsets[1:])

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> Normalised:
        out, source, sizes, entry = self._units(data, offsets)
        finish = offsets[1:].copy()
        if self.squeeze and len(out):
            # Blanks go at the beginning of a row and after another blank.
            blank = out == 32
            begin = starts_of(sizes)
            begins_row = np.zeros(len(out) + 1, bool)
            begins_row[begin] = True
            keep = ~(blank & (begins_row[:-1] | np.r_[True, blank[:-1]]))
            sizes = sums_of(keep, sizes)
            out, source = out[keep], source[keep]
        # A blank mark written in the text is a blank from here on.
        if len(out) >= 3 and (hits := np.flatnonzero((out[:-2] == MARK[0]) & (out[1:-1] == MARK[1]) & (out[2:] == MARK[2]))).size:
            keep = np.ones(len(out), bool)
            keep[hits + 1] = keep[hits + 2] = False
            out = out.copy()
            out[hits] = 32
            sizes = sums_of(keep, sizes)
            out, source = out[keep], source[keep]
        if self.squeeze and len(out):
            # Blanks at the end of a row go too; what is left ends where they began.
            ends = np.cumsum(sizes)
            visible = np.r_[0, np.maximum.accumulate(np.where(out != 32, np.arange(1, len(out) + 1), 0))]
            cut = np.maximum(visible[ends], ends - sizes)
            trailing = ends - cut
            finish = np.where(trailing > 0, source[np.minimum(cut, len(source) - 1)], finish)
            keep = np.arange(len(out)) < np.repeat(cut, sizes)
            sizes = sizes - trailing
            out, source = out[keep], source[keep]
        some = sizes > 0 if self.squeeze else np.diff(offsets) > 0
        lead = (some & self.lead).astype(np.int64)
        # One array with each row's leading blank, its bytes, and a place for its end.
        total = sizes + lead + 1
        begin = starts_of(total)
        data_out, source_out = np.full(int(total.sum()), 32, np.uint8), np.empty(int(total.sum()), np.int64)
        inner = gather_runs(np.arange(len(source_out)), begin + lead, sizes)
        data_out[inner], source_out[inner] = out, source
        source_out[begin + total - 1] = finish
        source_out[begin[lead > 0]] = entry[lead > 0]
        is_end = np.zeros(len(data_out), bool)
        is_end[begin + total - 1] = True
        return Normalised(data_out[~is_end], np.r_[0, np.cumsum(sizes + lead)], source_out)


class Encoded(NamedTuple):
    """Ids of rows one after another, the original byte span of each, and the number of ids of each row."""

    ids: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


class PieceCodec(ChunkTable):
    """Pieces of pre-tokens; a pre-token's code leads to its ids and to the normalised bytes each covers."""

    def __init__(self, path: str, limit: int = 1_000_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or kinds & {4, 5}:
            raise ValueError("only BPE models with byte fallback, blanks in front, and no user-defined or unused pieces are supported")
        self.pieces = Pieces(path)
        if self.pieces.joins_words:
            raise ValueError("this vocabulary has pieces that reach across words")
        self.normalise = Normaliser(spec.normalizer_spec)
        size = model.get_piece_size()
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        raw = [model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(size)]
        for i in range(size):
            if model.is_control(i):
                raw[i] = b""
            elif model.is_unknown(i):
                raw[i] = spec.trainer_spec.unk_surface.encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            raw[i] = bytes([b])
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        self.piece_size = np.fromiter(map(len, raw), np.int64, size)
        self.piece_begin = starts_of(self.piece_size)
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.decimal = np.array([str(i) for i in range(size)], object)
        super().__init__(False, limit)

    def forget(self) -> None:
        super().forget()
        self.flat, self.used = np.empty(1 << 18, np.int32), 0
        self.begin, self.length = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pre-tokens: runs of blanks and the characters after them; a row without bytes has none."""
        blank = data == 32
        begins = blank & ~np.r_[False, blank[:-1]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        return starts, np.r_[starts[1:], len(data)][: len(starts)], np.searchsorted(starts, offsets[:-1])

    def merged_symbols(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each sequence and their number: long sequences on their own with a heap, all others together."""
        short = lengths <= LONG
        if short.all():
            return surviving(self.pieces, symbols, lengths)
        flat, counts = surviving(self.pieces, symbols[np.repeat(short, lengths)], lengths[short])
        begin, own = starts_of(lengths), dict(zip(np.flatnonzero(short).tolist(), np.split(flat, np.cumsum(counts)[:-1])))
        for k in np.flatnonzero(~short).tolist():
            own[k] = np.array(merged(symbols[begin[k] : begin[k] + lengths[k]].tolist(), self.pieces.pair_of), np.int32)
        parts = [own[k] for k in range(len(lengths))]
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chars = np.frombuffer("".join(chunks).replace(" ", BLANK).encode("utf-32-le"), np.uint32)
        symbols = self.pieces.of_char[chars]
        unknown = symbols == self.pieces.unknown
        left, counts = self.merged_symbols(symbols, lengths)
        # Characters without a piece survive in order: their places among what is left take their bytes.
        missing = left == self.pieces.unknown
        odd = chars[unknown]
        raw = np.frombuffer(odd.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        widths = 1 + (odd >= 0x80) + (odd >= 0x800) + (odd >= 0x10000).astype(np.int64)
        sizes = np.ones(len(left), np.int64)
        sizes[missing] = widths
        flat = np.repeat(left, sizes)
        flat[np.repeat(missing, sizes)] = self.byte_ids[raw]
        counts = sums_of(sizes, counts)
        self.begin = grown(self.begin, self.index.n, self.used + starts_of(counts))
        self.length = grown(self.length, self.index.n, counts)
        self.flat = grown(self.flat, self.used, flat)
        self.used += len(flat)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        text = self.normalise(data, offsets)
        codes, chunks = self.coded(text.data, text.offsets)
        sizes = self.length[codes]
        ids = gather_runs(self.flat, self.begin[codes], sizes)
        counts = sums_of(sizes, chunks)
        # Normalised ends of all pieces, and from them the original spans; a row has one source more than it has bytes.
        ends = np.cumsum(self.piece_size[ids])
        row = np.repeat(np.arange(len(counts)), counts)
        begins = ends - self.piece_size[ids]
        if len(ids):
            # The bytes of one character: all begin at it, and only the last one covers it.
            odd = np.flatnonzero(self.is_byte[ids])
            char = np.zeros(len(text.data) + 1, bool)
            char[:-1], char[-1] = starts_character(text.data), True
            opening = np.maximum.accumulate(np.where(char, np.arange(len(char)), 0))
            begins[odd] = opening[begins[odd]]
            inside = odd[~char[ends[odd]]]
            ends[inside] = begins[inside]
        return Encoded(ids, text.source[begins + row], text.source[ends + row], counts)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Ids and spans, in bytes from the beginning of ``data``."""
        whole = bool(len(self.normalise.map)) or self.normalise.squeeze
        cuts = [[int(a)] if whole or b - a <= 2 * SLICE else plain_cuts(data, int(a), int(b), SLICE) for a, b in zip(offsets[:-1], offsets[1:])]
        if sum(map(len, cuts)) == len(cuts):
            return self._encode(data, offsets)
        # A slice after the first begins with its blank, which is the marker that the normaliser puts there itself.
        parts = []
        for own, end in zip(cuts, offsets[1:].tolist()):
            for k, (a, b) in enumerate(zip(own, [*own[1:], end])):
                skip = int(k > 0 and self.normalise.lead)
                e = self._encode(data[a + skip : b], np.array([0, b - a - skip]))
                begins = e.begins + a + skip
                if skip and len(begins):
                    begins[0] = a
                parts.append(Encoded(e.ids, begins, e.ends + a + skip, e.counts))
        counts = sums_of(np.concatenate([p.counts for p in parts]), np.array([len(c) for c in cuts]))
        return Encoded(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("ids", "begins", "ends")), counts)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text of these ids; bytes that spell no character become replacement characters."""
        data = gather_runs(self.piece_bytes, self.piece_begin[ids], self.piece_size[ids]).tobytes()
        if len(ids) and data[:1] == b" " and not self.is_byte[ids[0]] and self.normalise.lead:
            data = data[1:]
        try:
            data.decode()
            return data
        except UnicodeDecodeError:
            spelled = "�".encode()
            return b"".join(spelled if b[0] >= 0x80 and len(b) == 1 else b for b in _CHARACTERS(data))


#: Well-formed UTF-8 characters, and single bytes that belong to none.
_CHARACTERS = re.compile(
    rb"[\x00-\x7f]+|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}|.",
    re.DOTALL,
).findall


@cache
def codec(path: str) -> PieceCodec:
    """The worker's own codec for a model file, kept between tasks."""
    return PieceCodec(path)


def encoded_slices(path: str, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, Encoded]]:
    """For slices of the rows: first and last row, their byte offsets, and their pieces."""
    data, offsets = text_bytes(column)
    for a, b in row_slices(data, offsets):
        yield a, b, offsets[a:b] - offsets[a], codec(path).encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def span_rows(path: str):
    """For mapInArrow: doc_id and text to ids and the original byte span of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            for a, b, begin, e in encoded_slices(path, batch.column(1)):
                shift = np.repeat(begin, e.counts)
                ends = pa.array(np.r_[0, np.cumsum(e.counts)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (e.ids, e.begins - shift, e.ends - shift)]
                yield pa.RecordBatch.from_arrays([docs[a:b], *lists], names=["doc_id", "ids", "begins", "ends"])

    return run


def digest_rows(path: str):
    """For mapInArrow: doc_id and text to digests of the ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            for a, b, _, e in encoded_slices(path, batch.column(1)):
                own, ids, texts = codec(path), [], []
                for part in np.split(e.ids, np.cumsum(e.counts)[:-1]):
                    ids.append(hashlib.sha256(",".join(own.decimal[part].tolist()).encode()).hexdigest())
                    texts.append(hashlib.sha256(own.decode(part)).hexdigest())
                yield pa.RecordBatch.from_arrays([docs[a:b], pa.array(e.counts), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def spans(docs: DataFrame, model: str) -> DataFrame:
    """Ids of each document and the byte span of each in the original text."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(span_rows(model), SPANS)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of the text that they decode to."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(digest_rows(model), DIGESTS)
