"""Near-duplicate groups by MinHash with tensored banding.

Two collections of sub-keys, each of ``BANDS`` sub-keys over ``ROWS`` minhashes, are computed for a document. A
table's key pairs one sub-key of the first with one of the second collection, so ``2 * BANDS * ROWS`` minhashes
serve ``BANDS ** 2`` tables of ``2 * ROWS`` minhashes each. Two documents meet in a table exactly when they share a sub-key in both
collections, so rows are grouped by sub-keys of the first and matched on the second within the group.

1. One row for each distinct shingle set goes on; its copies are linked through it.
2. Groups are cut to cells of bounded size, large ones at random. A cell names the pairs that meet in a table there for the first time and whose
   2 * BANDS * ROWS minhashes agree often enough to be worth a look.
3. The documents so named come to their cells with their full sets. A cell takes its pairs, those that agree most first, and
   confirms each unless confirmed links connect it already; so it gives as many links as join its documents, and no more.
4. Components of the links. They join what a large group of near copies holds, as its members meet in other blocks at every sub-key.
5. In large groups that still hold several components, only members of different ones are compared: the commonest component is
   cut to blocks that meet the blocks of the others, never each other, and where the others are many too, the group is dealt by full pairs of
   sub-keys first. The components so linked are joined. A group of near copies costs in proportion to its size this way; blocks
   multiply only where many members of one table key belong to other components than its commonest.

All links are confirmed on full shingle sets. A pair at similarity 0.75 is missed with a chance of about 2e-4, one at 0.8 of about 1e-5,
and components lose it only if no other path links its documents.

Defined results: null, empty and wordless texts have no shingles and stand alone, as does a row without doc_id (its
component is null, and it is kept). doc_id is a key: rows that repeat one are seen as one document with the same links. An empty table
gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import mixed, row_slices, run_keys, text_bytes
from lakesurvey.llm.common import gather_runs, small_batches, starts_of, stored
from lakesurvey.llm.components import components

WORDS, PERCENT = 5, 75
BANDS, ROWS = 18, 3
HASHES = 2 * BANDS * ROWS
#: Agreeing minhashes below which a pair isn't verified: 3.8 standard deviations under what similarity 0.75 has.
AGREE = 64
#: Rows of a cell: all its pairs are looked at together.
CELL = 1024

_RNG = np.random.default_rng(75)
_WORD_TIMES = _RNG.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HASH_XOR = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_HASH_TIMES = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW_TIMES = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, a array<int>, b array<int>, sig binary"


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row's distinct shingles, ascending within the row, and their number."""
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data):
        before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    keys = run_keys(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    words = np.diff(first)
    shingles = np.where(words >= WORDS, words - WORDS + 1, np.minimum(words, 1))
    begin = starts_of(shingles)
    at = gather_runs(np.arange(len(keys) + 1), first[:-1], shingles)
    row = np.repeat(np.arange(len(words)), shingles)
    total = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        there = k < words[row]
        total[there] += keys[at[there] + k] * _WORD_TIMES[k]
    total = mixed(total + np.minimum(words[row], WORDS).astype(np.uint64))
    sets = [np.unique(total[i : i + n]) for i, n in zip(begin.tolist(), shingles.tolist())]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else total, sizes


def minhashes(keys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of ``HASHES`` minima for each set that isn't empty."""
    begin = starts_of(sizes)[sizes > 0]
    out = np.empty((len(begin), HASHES), np.uint64)
    if len(begin):
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat((keys ^ _HASH_XOR[k]) * _HASH_TIMES[k], begin)
    return out


def signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: doc_id and text to set size, set hash, the two collections of sub-keys, and the short minhashes."""
    names = [c.split()[0] for c in SIGNED.split(", ")]
    for batch in batches:
        docs = batch.column(0).cast(pa.int64())
        data, offsets = text_bytes(batch.column(1))
        for i, j in row_slices(data, offsets):
            keys, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            some = sizes > 0
            begin = starts_of(sizes)[some]
            minima = minhashes(keys, sizes)
            halves = [np.zeros(0, np.uint64)] * 2
            if len(begin):
                halves = [np.add.reduceat(mixed(keys ^ np.uint64(s)), begin) for s in (1, 2)]
            n = len(begin)
            bands = (minima.reshape(n, 2 * BANDS, ROWS) * _ROW_TIMES).sum(axis=2, dtype=np.uint64)
            bands = (mixed(bands) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            short = (mixed(minima) & np.uint64(0xFFFF)).astype("<u2")
            place = np.where(some, np.cumsum(some) - 1, -1)
            take = pa.array(place, mask=~some)
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(bands[:, x : x + BANDS].reshape(-1)), BANDS).cast(pa.list_(pa.int32())).take(take) for x in (0, BANDS)]
            sig = pa.array([x.tobytes() for x in short], pa.binary()).take(take)
            hashes = [pa.array(h.view(np.int64)).take(take) for h in halves]
            yield pa.RecordBatch.from_arrays([docs.slice(i, j - i), pa.array(sizes), *hashes, *arrays, sig], names=names)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows of documents at cells, text last, to the same rows with the document's shingle set in its place.

    A document's rows come one after another, and its set is computed once for them.
    """
    for batch in batches:
        doc = np.asarray(batch.column(1))
        new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]][: len(doc)])
        data, offsets = text_bytes(batch.column(5).take(pa.array(new)))
        sets: list[bytes] = []
        for i, j in row_slices(data, offsets):
            keys, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sets += [x.tobytes() for x in np.split(keys, np.cumsum(sizes)[:-1])]
        for i in range(0, len(doc), 500):
            own = np.searchsorted(new, np.arange(i, min(i + 500, len(doc))), "right") - 1
            columns = [batch.column(k).slice(i, len(own)) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sets[k] for k in own.tolist()], pa.binary())], names=["cell", "node", "component", "partners", "agree", "shingles"])


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        edges = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)].tolist()
        if held and held[0].column(0)[0].as_py() != int(key[0]):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(edges[:-1], edges[1:]):
            if held and i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def named_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by cell: the documents that are in a pair worth a look, with their partners.

    A pair is named where it first meets: at the first sub-key of the first collection that both share, and in a group
    that was dealt by pairs of sub-keys at the first one of the second. Members of one component aren't compared, nor those of one block where two blocks meet.
    """
    out: dict[str, list] = {"cell": [], "node": [], "component": [], "partners": [], "agree": []}

    def packed() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))
        for v in out.values():
            v.clear()
        return batch

    for group in sorted_groups(batches):
        n = group.num_rows
        if n < 2:
            continue
        cell, at, table = (group.column(k)[0].as_py() for k in (0, 4, 5))
        node, component, block = (np.asarray(group.column(k)) for k in (1, 2, 3))
        a, b = (group.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, BANDS) for k in (6, 7))
        sig = np.frombuffer(b"".join(group.column(8).to_pylist()), "<u2").reshape(n, HASHES)
        two_blocks = bool((block != block[0]).any())
        partners: dict[int, tuple[list[int], list[int]]] = {}
        for i in range(n - 1):
            apart = component[i + 1 :] != component[i]
            if two_blocks:
                apart &= block[i + 1 :] != block[i]
            others = np.flatnonzero(apart) + i + 1
            agree = (sig[others] == sig[i]).sum(axis=1)
            near = np.flatnonzero(agree >= AGREE)
            if not len(near):
                continue
            others = others[near]
            same_a, same_b = a[others] == a[i], b[others] == b[i]
            here = (same_a.argmax(axis=1) == at) & same_b.any(axis=1)
            if table >= 0:
                here &= same_b.argmax(axis=1) == table
            if here.any():
                partners[i] = (node[others[here]].tolist(), agree[near[here]].tolist())
                for j in others[here].tolist():
                    partners.setdefault(j, ([], []))
        for i, (others, agree) in partners.items():
            for column, value in zip(out.values(), (cell, int(node[i]), int(component[i]), others, agree)):
                column.append(value)
        if len(out["cell"]) > 10_000:
            yield packed()
    yield packed()


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    if 100 * min(len(one), len(two)) < PERCENT * max(len(one), len(two)):
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= PERCENT * (len(one) + len(two) - common)


def linked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by cell, with sets: confirmed links that join the components of the cell's documents."""
    for group in sorted_groups(batches):
        sets = {k: np.frombuffer(v.as_buffer(), np.uint64) for k, v in zip(group.column(1).to_pylist(), group.column(5))}
        pairs = []
        for x, others, agree in zip(*(group.column(k).to_pylist() for k in (1, 3, 4))):
            pairs += [(-n, x, y) for y, n in zip(others, agree)]
        own = dict(zip(group.column(1).to_pylist(), group.column(2).to_pylist()))
        root = {k: k for k in own.values()}

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        links = []
        for _, x, y in sorted(pairs):
            p, q = top(own[x]), top(own[y])
            if p != q and similar(sets[x], sets[y]):
                root[p] = q
                links.append((own[x], own[y]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.int64()) for k in (0, 1)], names=["x", "y"])


def members_of(reps: DataFrame) -> DataFrame:
    """Rows (group, at, node, n) of the documents that share a sub-key of the first collection with others, n in all."""
    grouped = reps.select(F.col("doc_id").alias("node"), F.posexplode("a").alias("at", "sub")).withColumn("group", F.xxhash64("at", "sub"))
    sizes = grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    return stored(grouped.join(sizes, "group").select("group", "at", "node", "n"), "groups")


def with_payload(rows: DataFrame, reps: DataFrame) -> DataFrame:
    payload = reps.select(F.col("doc_id").alias("node"), "a", "b", "sig")
    return rows.join(payload, "node").select("cell", "node", "component", "block", "at", "table", "a", "b", "sig")


def block_cells(members: DataFrame) -> DataFrame:
    """Cells of the groups, each member in one cell of its group: the whole group, or a random block of it."""
    block = F.pmod(F.xxhash64("node", "group"), F.ceil(F.col("n") / CELL))
    return members.select(F.xxhash64("group", block).alias("cell"), "node", F.col("node").alias("component"), F.lit(0).cast("long").alias("block"), "at", F.lit(-1).alias("table"))


def with_parts(keyed: DataFrame) -> DataFrame:
    """Rows of keys that hold several components, with the number of all rows of the key and of its commonest component."""
    parts = keyed.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key")
    sizes = parts.agg(F.sum("rows").alias("all"), F.max(F.struct("rows", "component")).alias("most")).where(F.col("most.rows") < F.col("all"))
    return keyed.join(sizes, "key")


def dealt_blocks(keyed: DataFrame) -> DataFrame:
    """Cells in which members of different components meet.

    The commonest component of a key has the blocks -1, -2 and so on, all others together the blocks 0, 1 and so on.
    """
    whole, main = F.col("all") <= CELL, F.col("component") == F.col("most.component")
    mains, others = F.ceil(F.col("most.rows") / CELL), F.ceil((F.col("all") - F.col("most.rows")) / CELL)
    place, zero = F.xxhash64("node", "key"), F.lit(0).cast("long")
    dealt = keyed.withColumn("block", F.when(whole, zero).when(main, -1 - F.pmod(place, mains)).otherwise(F.pmod(place, others)))
    met = F.when(whole, F.array(zero)).when(main, F.sequence(zero, others - 1)).otherwise(F.sequence(-mains, others - 1))
    dealt = dealt.withColumn("other", F.explode(met))
    cell = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.select(cell.alias("cell"), "node", "component", "block", "at", "table")


def apart_cells(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """Cells of the large groups that hold several components.

    Where all but the commonest component fit one block, that block meets the others; else the group is dealt by pairs of sub-keys first.
    """
    large = members.where(F.col("n") > CELL).join(labels, "node", "left")
    large = large.select(F.col("group").alias("key"), "node", F.coalesce("component", "node").alias("component"), "at", F.lit(-1).alias("table"))
    large = stored(with_parts(large), "mixed")
    few = F.col("all") - F.col("most.rows") <= CELL
    seconds = reps.select(F.col("doc_id").alias("node"), F.posexplode("b").alias("second", "sub"))
    paired = large.where(~few).select("key", "node", "component", "at").join(seconds, "node")
    paired = paired.select(F.xxhash64("key", "second", "sub").alias("key"), "node", "component", "at", F.col("second").alias("table"))
    return dealt_blocks(large.where(few)).unionByName(dealt_blocks(with_parts(paired)))


def confirmed_links(cells: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (x, y) that join the components of each cell's documents, confirmed on full sets.

    Texts move to the named rows by doc_id once, sets to the cells once. The named rows grow with the data, so the join is
    never a broadcast, however few they happen to be.
    """
    ordered = cells.repartition("cell").sortWithinPartitions("cell")
    named = stored(ordered.mapInArrow(named_rows, "cell long, node long, component long, partners array<long>, agree array<int>"), "named")
    texts = docs.select(F.col("doc_id").alias("node"), "text").where("node is not null")
    rows = named.hint("merge").join(texts, "node").select("cell", "node", "component", "partners", "agree", "text")
    full = rows.mapInArrow(set_rows, "cell long, node long, component long, partners array<long>, agree array<int>, shingles binary")
    return stored(full.repartition("cell").sortWithinPartitions("cell").mapInArrow(linked_rows, "x long, y long"), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    signed = stored(docs.mapInArrow(signed_rows, SIGNED), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stored(full.groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.join(classes.select("n_shingles", "h1", "h2", F.col("rep").alias("doc_id")), ["doc_id", "n_shingles", "h1", "h2"], "left_semi")
    reps = stored(reps.select("doc_id", "a", "b", "sig"), "reps")

    members = members_of(reps)
    labels = components(confirmed_links(with_payload(block_cells(members), reps), docs))
    joined = components(confirmed_links(with_payload(apart_cells(members, labels, reps), reps), docs))
    nodes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("first", F.coalesce("component", "rep"))
    nodes = nodes.drop("component").join(joined.withColumnRenamed("node", "first"), "first", "left")
    nodes = nodes.select("n_shingles", "h1", "h2", F.coalesce("component", "first").alias("component_id"))
    # Texts without words link with nothing: they need no join, in which they would all have one key.
    some = F.col("n_shingles") > 0
    out = signed.where(some).select("doc_id", "n_shingles", "h1", "h2").join(nodes, ["n_shingles", "h1", "h2"], "left").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(signed.where(~some).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
