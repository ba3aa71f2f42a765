"""Token-id files: shards of ids under a Re-Pair grammar, readable at any place.

The file format is a Parquet table with one row per shard; shards lie in ascending doc_id order:

| column | content |
| --- | --- |
| part, shard | place of the shard: writing task, number within it |
| part_start | ids that the same task wrote before this shard |
| docs, doc_lengths | doc_id (int64; ``doc_nulls`` marks null ones) and number of ids of each document |
| alphabet | uint32 ids of the symbols 0, 1, 2 ... that are plain ids |
| rules | uint16 pairs: the symbol ``len(alphabet) + k`` stands for pair k |
| expansions | uint32: how many ids each symbol stands for |
| symbols | uint16: the shard's ids as symbols |

All numbers are little-endian. A shard has its own grammar, so shards are written and read apart from each other; with the
lengths of expansions any range of ids is decoded from the few symbols that cover it (:func:`decode_range`).

Defined results: a null text is empty and holds the end id alone; rows with equal doc_id are kept, each with ids of its own,
one after another; a null doc_id comes first; an empty table gives an empty file; other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakesurvey.llm.chunks import encoder
from lakesurvey.llm.common import gather_runs, small_batches, starts_of
from lakesurvey.llm.packing import with_end
from lakesurvey.session import shared_folder

SHARD_SCHEMA = "part int, shard int, part_start long, n_ids long, docs binary, doc_nulls binary, doc_lengths binary, alphabet binary, rules binary, expansions binary, symbols binary"
SYMBOLS = 1 << 16  # a symbol takes two bytes


def frequent_pairs(seq: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pairs (as left * 2**16 + right) that occur ``least`` times, and their counts; the ``most`` commonest."""
    keys = np.sort((seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:])
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, int)
    counts = np.diff(edges)
    often = np.flatnonzero(counts >= least)
    if len(often) > most:
        often = often[np.argsort(-counts[often], kind="stable")[:most]]
    return keys[edges[often]], counts[often]


def chosen_places(rank: np.ndarray) -> np.ndarray:
    """Places of non-overlapping pairs: those of lower rank than both neighbours; runs of one pair alternate.

    ``rank[i]`` is the rank of the pair at i, or a value above all ranks where none is wanted.
    """
    wide = np.concatenate([[np.int32(2**31 - 1)], rank, [np.int32(2**31 - 1)]])
    ok = (rank < np.int32(2**30)) & (wide[:-2] >= rank) & (rank <= wide[2:])
    at = np.flatnonzero(ok)
    if not len(at):
        return at
    # Neighbours that both remain have equal rank: keep every other one of each run.
    fresh = np.r_[True, np.diff(at) > 1]
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return at[run % 2 == 0]


def compress(ids: np.ndarray, least: int = 32, per_round: int = 8192, gain: float = 0.02) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet, rules, expansion lengths and symbols of a shard.

    Each round gives the commonest pairs new symbols and replaces them where they don't overlap with a commoner
    one; it ends when no pair occurs ``least`` times, symbols run out, or a round shortens the shard by less than ``gain``.
    """
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    if len(alphabet) > SYMBOLS:
        raise ValueError("a shard may hold 65,536 different ids at most")
    code = np.zeros(len(present), np.uint16)
    code[alphabet] = np.arange(len(alphabet), dtype=np.uint16)
    seq = code[ids]
    rules = [np.zeros((0, 2), np.uint16)]
    n = len(alphabet)
    while len(seq) > 1 and n < SYMBOLS:
        pairs, counts = frequent_pairs(seq, least, min(per_round, SYMBOLS - n))
        if not len(pairs):
            break
        order = np.argsort(-counts, kind="stable")
        pairs = pairs[order]
        rank = ranks_at(seq, pairs)
        at = chosen_places(rank)
        used = np.bincount(rank[at], minlength=len(pairs))
        worth = used >= max(2, least // 2)
        if not worth.any():
            break
        at = at[worth[rank[at]]]
        symbol = n + np.cumsum(worth) - 1
        kept = pairs[worth]
        rules.append(np.stack([(kept >> np.uint32(16)).astype(np.uint16), kept.astype(np.uint16)], axis=1))
        n += len(kept)
        new = symbol[rank[at]].astype(np.uint16)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq[at] = new
        before = len(seq)
        seq = seq[stay]
        if before - len(seq) < gain * before:
            break
    rules = np.concatenate(rules)
    return alphabet, rules, expansion_lengths(len(alphabet), rules), seq


def ranks_at(seq: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Rank of the pair at each place, or 2**30 where it isn't one of ``pairs``; through a hashed table."""
    bits, none = 17, np.int32(2**30)
    keys = (seq[:-1].astype(np.uint32) << np.uint32(16)) | seq[1:]
    times, shift = np.uint32(2654435769), np.uint32(32 - bits)
    slots = (pairs * times) >> shift
    table_key, table_rank = np.zeros(1 << bits, np.uint32), np.full(1 << bits, none, np.int32)
    # Where two pairs want one slot, the commoner has it; the other is left to the next round.
    table_key[slots[::-1]], table_rank[slots[::-1]] = pairs[::-1], np.arange(len(pairs), dtype=np.int32)[::-1]
    slot = (keys * times) >> shift
    return np.where(table_key[slot] == keys, table_rank[slot], none)


def expansion_lengths(plain: int, rules: np.ndarray) -> np.ndarray:
    out = np.ones(plain + len(rules), np.int64)
    done = plain
    while done < len(out):
        # Rules of one round refer to older symbols only.
        ready = done - plain
        size = int(np.argmax(np.r_[(rules[ready:] >= done).any(axis=1), True]))
        part = rules[ready : ready + size].astype(np.int64)
        out[done : done + size] = out[part[:, 0]] + out[part[:, 1]]
        done += size
    return out.astype("<u4")


def expanded(symbols: np.ndarray, alphabet: np.ndarray, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that these symbols stand for: expansions of all symbols once, then one gather."""
    plain = len(alphabet)
    begin = starts_of(lengths.astype(np.int64))
    flat = np.empty(int(lengths.sum(dtype=np.int64)), np.uint32)
    flat[:plain] = alphabet
    done = plain
    size = lengths.astype(np.int64)
    while done < len(lengths):
        ready = done - plain
        n = int(np.argmax(np.r_[(rules[ready:] >= done).any(axis=1), True]))
        pair = rules[ready : ready + n].reshape(-1)
        flat[begin[done] : begin[done] + size[done : done + n].sum()] = gather_runs(flat, begin[pair], size[pair])
        done += n
    return gather_runs(flat, begin[symbols], size[symbols])


class Shard:
    """A shard's row, ready to decode."""

    def __init__(self, row: dict):
        self.alphabet = np.frombuffer(row["alphabet"], "<u4")
        self.rules = np.frombuffer(row["rules"], "<u2").reshape(-1, 2)
        self.expansions = np.frombuffer(row["expansions"], "<u4")
        self.symbols = np.frombuffer(row["symbols"], "<u2")
        self.docs = np.frombuffer(row["docs"], "<i8")
        self.nulls = np.frombuffer(row["doc_nulls"], np.uint8).astype(bool)
        self.doc_lengths = np.frombuffer(row["doc_lengths"], "<i8")

    def ids(self) -> np.ndarray:
        return expanded(self.symbols, self.alphabet, self.rules, self.expansions)


def decode_range(shard: Shard, begin: int, end: int) -> np.ndarray:
    """Ids ``begin`` to ``end`` of a shard, from the symbols that cover them alone."""
    ends = np.cumsum(shard.expansions[shard.symbols], dtype=np.int64)
    end = min(end, int(ends[-1]) if len(ends) else 0)
    if begin >= end:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
    before = int(ends[a - 1]) if a else 0
    out, plain, stack = [], len(shard.alphabet), shard.symbols[a:b][::-1].tolist()
    while stack:
        symbol = stack.pop()
        if symbol < plain:
            out.append(shard.alphabet[symbol])
        else:
            left, right = shard.rules[symbol - plain].tolist()
            stack += [right, left]
    return np.array(out[begin - before : end - before], np.uint32)


def shard_rows(path: str, end_id: int, shard_ids: int, options: dict):
    """For mapInArrow over documents in doc_id order: their shards."""
    names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path, True, False).encode, TaskContext.get().partitionId()
        state = {"shard": 0, "start": 0}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def written() -> pa.RecordBatch:
            docs, nulls, lengths, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            alphabet, rules, expansions, symbols = compress(ids, **options)
            row = [part, state["shard"], state["start"], len(ids)]
            row += [x.tobytes() for x in (docs.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<i8"), alphabet, rules.astype("<u2"), expansions, symbols.astype("<u2"))]
            state["shard"] += 1
            state["start"] += len(ids)
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            nulls = np.asarray(docs.is_null())
            docs = np.asarray(docs.fill_null(0))
            for first, ids, lengths in encode(batch.column(1)):
                ids, lengths = with_end(ids, lengths, end_id)
                rows = slice(first, first + len(lengths))
                held.append((docs[rows], nulls[rows], lengths, ids))
                if sum(len(x[3]) for x in held) >= shard_ids:
                    yield written()
        if held:
            yield written()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, shard_ids: int = 4_000_000, least: int = 32) -> None:
    """Write the ids of all documents, in ascending doc_id order, to shards of about ``shard_ids`` ids in ``path``."""
    small_batches(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    shards = ordered.mapInArrow(shard_rows(tokenizer, end_id, shard_ids, {"least": least}), SHARD_SCHEMA)
    shards.write.option("compression", "none").parquet(path)


def doc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over shards: every document's place within its task, length and checksum, from decoded ids."""
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row)
            ids = shard.ids().astype("<u4", copy=False)
            lengths = shard.doc_lengths
            if len(ids) != lengths.sum():
                raise ValueError("a shard doesn't hold the ids of its documents")
            starts = starts_of(lengths)
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist())]
            n = len(lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, row["part"], np.int32)), pa.array(shard.docs, mask=shard.nulls), pa.array(row["part_start"] + starts), pa.array(lengths), pa.array(crc, pa.int64())],
                names=["part", "doc_id", "own_start", "n_tokens", "ids_crc32"],
            )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the decoded file.

    Starts add up what earlier tasks wrote: one row for each writing task is summed in order, a number set by
    the partitions of the job, not by the data; the sums are joined back by task.
    """
    small_batches(spark, rows=1)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = shards.mapInArrow(doc_rows, "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    return docs.join(base, "part").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write the documents' ids to a file in the shared folder and read them back."""
    path = shared_folder(docs.sparkSession, "tokenfile")
    write(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)
