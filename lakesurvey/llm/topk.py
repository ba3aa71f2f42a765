"""Exact top-k search by columnar branch and bound.

Components are turned into integers. Candidates lie in blocks, dimension by dimension (vertical layout), with the mass (Euclidean norm) that
each has left after every few dimensions. For a block of queries, products are accumulated one group of dimensions after another;
after each, what a pair has so far plus the product of the masses left bounds its score from above. Pairs that can't reach their query's k-th best score
are dropped, and once few are left they are compacted to lists and only those are carried on. The k-th best score comes from earlier
blocks of the task, and from the lower bounds within the block. Every query meets every block, in a grid of query groups and block shares; each cell of the
grid gives its queries' best, and the best of those are the result. Nothing is pruned on a guess: results are exact.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; vectors of another dimension aren't
candidates of a query; scores beyond 63 bits are set to the range's end; rows that repeat a vec_id are candidates of their own,
but none is a candidate of a query with its vec_id; without queries there are no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lakesurvey.llm.common import small_batches, stored

BLOCK, QUERIES, STEP = 4096, 256, 16
PACKED = "dimension int, n int, ids binary, columns binary"
EXACT = 2**53  # doubles hold whole numbers below this; sums that may pass it are made of Python integers


def packed_rows(size: int, scale: int):
    """For mapInArrow over vec_id, embedding: blocks of up to ``size`` vectors of one dimension, as int64 columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def packed(dimension: int) -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(dimension)))
            columns = [pa.array([dimension], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([np.ascontiguousarray(rows.T).astype("<i8").tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["dimension", "n", "ids", "columns"])

        for batch in batches:
            ids, vectors = np.asarray(batch.column(0)), batch.column(1)
            sizes = np.asarray(vectors.value_lengths())
            for dimension in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dimension)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dimension)
                # Beyond 2**62 the integer is set to that end; such scores end at the range's end as well.
                x = np.clip(np.floor(scale * x), -(2.0**62), 2.0**62).astype(np.int64)
                for i in range(0, len(at), size):
                    held.setdefault(dimension, []).append((ids[at[i : i + size]], x[i : i + size]))
                    if sum(len(r[0]) for r in held[dimension]) >= size:
                        yield packed(dimension)
        for dimension in list(held):
            yield packed(dimension)

    return run


class Best:
    """The k best candidates so far of a block of queries."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.query = np.zeros(0, np.int64)
        self.candidate, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, query: np.ndarray, candidate: np.ndarray, score: np.ndarray) -> None:
        query, candidate, score = (np.concatenate(x) for x in ((self.query, query), (self.candidate, candidate), (self.score, score)))
        order = np.lexsort((candidate, -score, query))
        query, candidate, score = query[order], candidate[order], score[order]
        first = np.searchsorted(query, query)
        keep = np.arange(len(query)) - first < self.k
        self.query, self.candidate, self.score = query[keep], candidate[keep], score[keep]
        last = np.arange(len(self.query)) - np.searchsorted(self.query, self.query) == self.k - 1
        self.floor[self.query[last]] = self.score[last]


def search_block(best: Best, queries: np.ndarray, ids: np.ndarray, columns: np.ndarray) -> None:
    """Take a block of candidates (dimension by candidate) into the best of these queries (query by dimension)."""
    dimension, n = columns.shape
    most = max(int(np.abs(queries).max(initial=0)), int(np.abs(columns).max(initial=0)))
    if dimension * most * most >= EXACT:
        exact = np.clip(queries.astype(object) @ columns.astype(object), -(2**63), 2**63 - 1).astype(np.int64)
        i, j = np.nonzero(best.ids[:, None] != ids[None, :])
        best.add(i, ids[j], exact[i, j])
        return
    q, c = queries.astype(np.float64), columns.astype(np.float64)
    cuts = [*range(0, dimension, STEP), dimension]
    left_q = np.sqrt(np.cumsum((q * q)[:, ::-1], axis=1))[:, ::-1] if dimension else np.zeros((len(q), 0))
    left_c = np.sqrt(np.cumsum((c * c)[::-1], axis=0))[::-1] if dimension else np.zeros((0, n))
    score = np.zeros((len(q), n))
    score[best.ids[:, None] == ids[None, :]] = -np.inf  # not a candidate of itself
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    own: np.ndarray | None = None
    for a, b in zip(cuts[:-1], cuts[1:]):
        if pairs is None:
            score += q[:, a:b] @ c[a:b]
        else:
            own = own + np.einsum("pd,dp->p", q[pairs[0], a:b], c[a:b][:, pairs[1]])
        if b == dimension:
            break
        if pairs is None:
            rest = left_q[:, b][:, None] * left_c[b][None, :] * (1 + 1e-9) + 1e-6
            floor = best.floor
            if n > best.k:
                lower = np.partition(score - rest, n - best.k, axis=1)[:, n - best.k]
                floor = np.maximum(floor, lower)
            alive = score + rest >= floor[:, None]
            if alive.sum() < 0.2 * alive.size:
                pairs = np.nonzero(alive & (score > -np.inf))
                own = score[pairs]
        else:
            rest = left_q[pairs[0], b] * left_c[b][pairs[1]] * (1 + 1e-9) + 1e-6
            alive = own + rest >= floor[pairs[0]]
            pairs, own = (pairs[0][alive], pairs[1][alive]), own[alive]
    if pairs is None:
        floor = best.floor
        if n > best.k:
            floor = np.maximum(floor, np.partition(score, n - best.k, axis=1)[:, n - best.k])
        pairs = np.nonzero((score >= floor[:, None]) & (score > -np.inf))
        own = score[pairs]
    best.add(pairs[0], ids[pairs[1]], own.astype(np.int64))


def searched_rows(k: int):
    """For mapInArrow over grid cells (query block beside candidate block), sorted by query block: each query's best in this task."""
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best, queries = None, None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(best.ids[best.query]), pa.array(best.candidate), pa.array(best.score)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["query_block"] != now:
                    if best is not None:
                        yield result()
                    now = row["query_block"]
                    best = Best(np.frombuffer(row["query_ids"], "<i8"), k)
                    queries = np.frombuffer(row["query_columns"], "<i8").reshape(row["dimension"], -1).T if row["dimension"] else np.zeros((len(best.ids), 0), np.int64)
                columns = np.frombuffer(row["columns"], "<i8").reshape(row["dimension"], row["n"])
                search_block(best, queries, np.frombuffer(row["ids"], "<i8"), columns)
        if best is not None:
            yield result()

    return run


def top_products(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` candidates of largest integer product for each query."""
    spark = vectors.sparkSession
    small_batches(spark, rows=1000)
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = good.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    blocks = stored(good.select("vec_id", "embedding").mapInArrow(packed_rows(BLOCK, scale), PACKED), "blocks")
    queries = good.where("is_query").select("vec_id", "embedding").distinct().mapInArrow(packed_rows(QUERIES, scale), PACKED)
    queries = stored(queries.select("*", F.monotonically_increasing_id().alias("query_block")), "queries")
    # The grid: candidate blocks are dealt to shares, and every query block goes to each share.
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = blocks.withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(shares)))
    asked = queries.select("query_block", "dimension", F.col("ids").alias("query_ids"), F.col("columns").alias("query_columns"))
    asked = asked.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    grid = asked.hint("merge").join(dealt, ["share", "dimension"]).sortWithinPartitions("query_block")
    small_batches(spark, rows=16)
    found = grid.mapInArrow(searched_rows(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
