"""Ranked lexical search with geometrically blocked posting lists.

1. The terms of the items are collected in bounded sets, one pass over the documents for each. A document becomes its length and the terms of the set with
   their counts, as a written table; document counts, lengths and frequencies are summed over all of it.
2. Each task takes its documents in shards. A shard's posting list of a term is cut to blocks of similar documents: each document goes to the
   most similar of the seeds spread over the list, by inner products of random projections of the documents' weights; large clusters are
   cut further. A block is summarised by the largest weight of every term among its documents.
3. An item takes the blocks of its terms, those of largest bound first; the bound is the item's score under the summary. Blocks
   are read, and their documents scored in full, until the bound of the rest is below the item's k-th best score so far. No score of a document in a skipped
   block can exceed that bound, so results are exact; a bound equal to the k-th best score is read, as the tie may go to it.
4. The best of all tasks are merged in two steps. A task gives k rows an item, whatever it reads.

Blocks and summaries live as long as their shard: stored for all documents they would take several times the room of the texts.

Defined results: null and empty texts and those without terms are no documents of the collection, and no items; documents without doc_id are ranked, after
others of equal score; rows that repeat a doc_id are documents of their own, and so are rows that repeat an item_id; scores of 0 aren't given; an empty table
gives no rows; other columns don't matter. Whole texts are taken, whatever their length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import ChunkTable, mixed, row_slices, run_words, text_bytes, word_keys
from lakesurvey.llm.common import gather_runs, small_batches, starts_of, stored, sums_of

VECTORS = "doc_id long, n long, terms array<int>, counts array<int>"
ITEM_TERMS = "uid long, terms array<string>, repeats array<int>"
FOUND = "uid long, doc_id long, score long"

#: Terms of items that one pass over the documents looks for.
SET_TERMS = 200_000
#: Documents, and their postings, that a task blocks at a time.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1_000_000
#: Documents of a block, dimensions of the projections that tell similar documents, and cells of the summaries held at a time.
BLOCK, DIMENSIONS, CELLS = 16, 32, 4_000_000
NO_DOC = np.iinfo(np.int64).max

_IS_TERM = np.zeros(256, bool)
_IS_TERM[128:] = _IS_TERM[48:58] = _IS_TERM[65:91] = _IS_TERM[97:123] = True


def term_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all terms, and the place of each row's first term among them, one more at the end."""
    term = _IS_TERM[data]
    before, after = np.r_[False, term[:-1]], np.r_[term[1:], False]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    if len(data):
        before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(term & ~before), np.flatnonzero(term & ~after) + 1
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data), starts, ends, np.searchsorted(starts, offsets)


def places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``begin, begin + 1, ... begin + size - 1`` of each run, one after another."""
    return np.repeat(begin - starts_of(size), size) + np.arange(int(size.sum()))


class TermTable(ChunkTable):
    """Numbers of the terms of a set, matched by their bytes."""

    def __init__(self, terms: list[str]):
        super().__init__(False, limit=2**31)
        self.names: list[str] = []
        column = pa.array(terms, pa.string())
        self.coded(*text_bytes(column))

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return offsets[:-1], offsets[1:], np.arange(len(offsets) - 1)

    def learn(self, chunks: list[str], first: np.ndarray) -> None:
        self.names += chunks

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each run of bytes, -1 for those that aren't of the set."""
        words, counts = run_words(data, starts, ends)
        tags, begin = 2 * (ends - starts), starts_of(counts)
        keys = word_keys(words, counts, tags)
        out = self.index.find(keys)
        todo = np.flatnonzero(out >= 0)
        while len(todo):
            same = self._same(out[todo], words, begin[todo], counts[todo], tags[todo])
            todo = todo[~same]
            keys[todo] = mixed(keys[todo]) | np.uint64(1)
            out[todo] = self.index.find(keys[todo])
            todo = todo[out[todo] >= 0]
        return out


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: uid and text to the distinct terms of each item and their repeats."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        data, starts, ends, first = term_runs(data, offsets)
        whole = data.tobytes()
        terms, repeats = [], []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            count: dict[str, int] = {}
            for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist()):
                word = whole[x:y].decode()
                count[word] = count.get(word, 0) + 1
            terms.append(list(count))
            repeats.append(list(count.values()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string())), pa.array(repeats, pa.list_(pa.int32()))], names=["uid", "terms", "repeats"])


def vector_rows(terms: list[str]):
    """For mapInArrow: doc_id and text to the number of all terms, and the numbers and counts of the terms of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = TermTable(terms)
        width = max(len(table.names), 1)
        for batch in batches:
            docs = batch.column(0).cast(pa.int64())
            data, offsets = text_bytes(batch.column(1))
            for a, b in row_slices(data, offsets):
                own, starts, ends, first = term_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                numbers = table.numbers(own, starts, ends)
                row = np.repeat(np.arange(b - a), np.diff(first))
                known = numbers >= 0
                pairs, counts = np.unique(row[known] * width + numbers[known], return_counts=True)
                ends_of = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) * width).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends_of, pa.array(x.astype(np.int32))) for x in (pairs % width, counts)]
                yield pa.RecordBatch.from_arrays([docs[a:b], pa.array(np.diff(first)), *lists], names=["doc_id", "n", "terms", "counts"])

    return run


class Shard(NamedTuple):
    """Documents of a shard: ids, and the terms of each, ascending, with their weights."""

    ids: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


class Blocks(NamedTuple):
    """Blocks of all posting lists, ascending by term: the term of each, and its documents (places in the shard)."""

    term: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    docs: np.ndarray


def weights_of(w: np.ndarray, terms: np.ndarray, counts: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """What each posting adds to a score, ``n`` being its document's length."""
    m = 25 + (75 * n * documents) // max(length, 1)
    return w[terms] * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def projected(shard: Shard, width: int) -> np.ndarray:
    """Random projections of the documents' weights, of length 1."""
    signs = (mixed(np.arange(width, dtype=np.uint64) + np.uint64(1))[:, None] >> np.arange(DIMENSIONS, dtype=np.uint64)) & np.uint64(1)
    out = np.zeros((len(shard.ids), DIMENSIONS), np.float32)
    some = shard.size > 0
    for k in range(DIMENSIONS):
        part = np.where(signs[shard.terms, k] == 1, shard.weights, -shard.weights).astype(np.float32)
        out[some, k] = np.add.reduceat(part, shard.begin[some]) if some.any() else 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)


def blocked(shard: Shard, width: int) -> Blocks:
    """Posting lists, each cut to blocks of similar documents."""
    doc = np.repeat(np.arange(len(shard.ids)), shard.size)
    order = np.argsort(shard.terms, kind="stable")
    terms, docs = shard.terms[order], doc[order]
    place = projected(shard, width)
    first = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[first, len(terms)])
    piece = np.zeros(len(terms), np.int64)  # number of a posting's block within its list
    for a, n in zip(first[lengths > BLOCK].tolist(), lengths[lengths > BLOCK].tolist()):
        own = docs[a : a + n]
        seeds = own[np.arange(0, n, BLOCK)]
        cluster = np.argmax(place[own] @ place[seeds].T, axis=1)
        by = np.argsort(cluster, kind="stable")
        docs[a : a + n], cluster = own[by], cluster[by]
        new = np.r_[True, cluster[1:] != cluster[:-1]]
        within = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        piece[a : a + n] = np.cumsum(new | (within % BLOCK == 0))
    new = np.r_[True, (terms[1:] != terms[:-1]) | (piece[1:] != piece[:-1])] if len(terms) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    return Blocks(terms[begin], begin, np.diff(np.r_[begin, len(terms)]), docs)


def summaries(shard: Shard, blocks: Blocks, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """First and last block, and the largest weight of each term in each of these blocks.

    The first documents of all blocks are entered together, then the second ones: within such a layer no cell is met twice.
    """
    step = max(CELLS // width, 1)
    for a in range(0, len(blocks.term), step):
        b = min(a + step, len(blocks.term))
        top = np.zeros((b - a) * width, np.int64)
        size, begin = blocks.size[a:b], blocks.begin[a:b]
        for layer in range(int(size.max())):
            live = np.flatnonzero(size > layer)
            doc = blocks.docs[begin[live] + layer]
            own = shard.size[doc]
            at = places(shard.begin[doc], own)
            cell = np.repeat(live * width, own) + shard.terms[at]
            top[cell] = np.maximum(top[cell], shard.weights[at])
        yield a, b, top.reshape(b - a, width)


class Items(NamedTuple):
    """Items of a set: uid, and the numbers of the terms of each with their repeats."""

    uid: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    terms: np.ndarray
    repeats: np.ndarray


class Search:
    """The best documents of every item, over shards seen one after another."""

    def __init__(self, items: Items, width: int, k: int):
        self.items, self.width, self.k = items, width, k
        self.scores = [np.zeros(0, np.int64)] * len(items.uid)
        self.docs = [np.zeros(0, np.int64)] * len(items.uid)
        # Items of each term.
        holder = np.repeat(np.arange(len(items.uid)), items.size)
        self.by_term = np.argsort(items.terms, kind="stable")
        self.holder, self.held = holder[self.by_term], items.terms[self.by_term]
        self.scored = self.offered = 0

    def bounds(self, shard: Shard, blocks: Blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, block and bound, for the blocks of every item's terms."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        items = self.items
        for a, b, top in summaries(shard, blocks, self.width):
            term = blocks.term[a:b]
            low, high = np.searchsorted(self.held, term), np.searchsorted(self.held, term, "right")
            block = np.repeat(np.arange(b - a), high - low)
            item = gather_runs(self.holder, low, high - low)
            for x in range(0, len(item), 50_000):
                own, at = item[x : x + 50_000], block[x : x + 50_000]
                size = items.size[own]
                place = places(items.begin[own], size)
                value = top[np.repeat(at, size), items.terms[place]] * items.repeats[place]
                out.append((own, at + a, sums_of(value, size)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def add(self, shard: Shard) -> None:
        blocks = blocked(shard, self.width)
        item, block, bound = self.bounds(shard, blocks)
        order = np.lexsort((-bound, item))
        item, block, bound = item[order], block[order], bound[order]
        ends = np.searchsorted(item, np.arange(len(self.items.uid) + 1))
        wanted = np.zeros(self.width, np.int64)
        for q, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            if a == b:
                continue
            own = slice(self.items.begin[q], self.items.begin[q] + self.items.size[q])
            wanted[self.items.terms[own]] = self.items.repeats[own]
            self._search(q, wanted, shard, blocks, block[a:b], bound[a:b])
            wanted[self.items.terms[own]] = 0

    def _search(self, q: int, wanted: np.ndarray, shard: Shard, blocks: Blocks, block: np.ndarray, bound: np.ndarray) -> None:
        seen = np.zeros(len(shard.ids), bool)
        at, step = 0, 4
        self.offered += len(block)
        while at < len(block):
            full = len(self.scores[q]) >= self.k
            least = int(self.scores[q][-1]) if full else 1
            stop = min(at + step, int(np.searchsorted(-bound, -least, "right")))
            if stop <= at:
                return
            self.scored += stop - at
            here = block[at:stop]
            docs = np.unique(gather_runs(blocks.docs, blocks.begin[here], blocks.size[here]))
            docs = docs[~seen[docs]]
            seen[docs] = True
            place = places(shard.begin[docs], shard.size[docs])
            scores = sums_of(wanted[shard.terms[place]] * shard.weights[place], shard.size[docs])
            good = scores >= max(least, 1)
            if good.any():
                scores = np.r_[self.scores[q], scores[good]]
                ids = np.r_[self.docs[q], shard.ids[docs[good]]]
                best = np.lexsort((ids, -scores))[: self.k]
                self.scores[q], self.docs[q] = scores[best], ids[best]
            at, step = stop, step * 2


def search_rows(items: Items, w: np.ndarray, documents: int, length: int, k: int):
    """For mapInArrow over document vectors: the k best documents of each item among those of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, max(len(w), 1), k)
        parts: list[list[np.ndarray]] = []
        held_docs = held_postings = 0

        def flush() -> None:
            ids, n, size, terms, counts = (np.concatenate(x) for x in zip(*parts))
            weights = weights_of(w, terms, counts.astype(np.int64), np.repeat(n, size), documents, length)
            search.add(Shard(ids, starts_of(size), size, terms, weights))

        for batch in batches:
            ids = batch.column(0).fill_null(NO_DOC).to_numpy()
            n = batch.column(1).to_numpy()
            offsets = batch.column(2).offsets.to_numpy().astype(np.int64)
            terms, counts = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            size, offsets = np.diff(offsets), offsets - offsets[0]
            at = 0
            while at < len(ids):
                room = int(np.searchsorted(offsets, offsets[at] + SHARD_POSTINGS - held_postings, "right")) - 1
                stop = min(len(ids), at + SHARD_DOCS - held_docs, max(room, at + (not held_docs)))
                if stop > at:
                    own = slice(offsets[at], offsets[stop])
                    parts.append([ids[at:stop], n[at:stop], size[at:stop], terms[own], counts[own]])
                    held_docs, held_postings, at = held_docs + stop - at, held_postings + int(offsets[stop] - offsets[at]), stop
                if at < len(ids):
                    flush()
                    parts, held_docs, held_postings = [], 0, 0
        if parts:
            flush()
        sizes = np.fromiter(map(len, search.docs), np.int64, len(search.docs))
        if sizes.sum():
            docs = np.concatenate(search.docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(items.uid, sizes)), pa.array(docs, mask=docs == NO_DOC), pa.array(np.concatenate(search.scores))], names=["uid", "doc_id", "score"]
            )

    return run


def item_sets(items: DataFrame) -> Iterator[tuple[list[str], Items]]:
    """The terms of all items and the items, in sets of about ``SET_TERMS`` terms; one set is held at a time."""
    total = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    sets = -(-total // SET_TERMS)
    for k in range(sets):
        rows = items.where(F.pmod(F.xxhash64("uid"), F.lit(sets)) == k).where(F.size("terms") > 0).toArrow()
        if not rows.num_rows:
            continue
        texts = rows.column("terms").combine_chunks()
        names = texts.flatten().unique().to_pylist()
        table = TermTable(names)
        flat = texts.flatten()
        numbers = table.numbers(*(lambda d, o: (d, o[:-1], o[1:]))(*text_bytes(flat))).astype(np.int64)
        size = np.diff(texts.offsets.to_numpy().astype(np.int64))
        yield table.names, Items(rows.column("uid").to_numpy(), starts_of(size), size, numbers, rows.column("repeats").combine_chunks().flatten().to_numpy().astype(np.int64))


def term_weights(vectors: DataFrame, terms: int) -> tuple[np.ndarray, int, int]:
    """The weight of each term of the set, and the number and the length of all documents."""
    documents, length = vectors.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    counts = np.zeros(terms, np.int64)
    counts[df.column("term").to_numpy()] = df.column("count").to_numpy()
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in counts.tolist()], np.int64), documents, length


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The k best documents of each item: ``item_id, rank, doc_id, score``."""
    spark = docs.sparkSession
    small_batches(spark)
    items = stored(items.select("item_id", "text").withColumn("uid", F.monotonically_increasing_id()), "items")
    terms = stored(items.select("uid", "text").mapInArrow(item_terms, ITEM_TERMS), "item-terms")
    found = None
    for names, own in item_sets(terms):
        vectors = stored(docs.select("doc_id", "text").mapInArrow(vector_rows(names), VECTORS), "vectors")
        w, documents, length = term_weights(vectors, len(names))
        part = vectors.where(F.size("terms") > 0).mapInArrow(search_rows(own, w, documents, length, k), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # Tasks grow with the documents: their rows are first cut down in parts of each item.
    parts = found.withColumn("part", F.spark_partition_id() % 64).withColumn("rank", F.row_number().over(Window.partitionBy("uid", "part").orderBy(*order)))
    best = parts.where(F.col("rank") <= k).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(items.select("uid", "item_id"), "uid").select("item_id", "rank", "doc_id", "score")
