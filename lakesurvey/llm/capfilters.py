"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; a vector belongs to the caps of all filters whose product with it exceeds the vector's own threshold, which lets
``LISTED`` of them pass. Directions form structured random product codes: the dimensions, after a random rotation, are cut into ``BLOCKS``
blocks of random codewords each, and a filter is one codeword of every block, so that ``CODEWORDS ** BLOCKS`` directions need no more
storage than their blocks. A vector is list-decoded: the best sums of the first block are joined with those of the next, and only sums that can
still exceed the threshold are kept. ``CODES`` such codes are used. Vectors of equal label and dimension are joined on filters they share, and
each pair is verified by cosine in double precision, in the first filter that both share.

Equal vectors count as one with a multiplicity. A filter's vectors are cut to cells of bounded size, where links are counted, and as many of
them kept as join the cell's vectors; no task holds a whole group, and no list of all pairs exists.

Measured on random pairs at cosine 0.93, at least one filter is shared by all of 1500 pairs in 64 dimensions, by 99.9 % in 16 and by 99 % in 8.

Defined results: vectors that are null, zero, empty or hold null or non-finite components, and those without label or vec_id, have no links; without
vec_id the component is null and the row kept. vec_id is a key: rows that repeat one are seen as one vector. An empty table gives no rows. Other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesurvey.llm.chunks import mixed
from lakesurvey.llm.common import small_batches, stored
from lakesurvey.llm.components import components
from lakesurvey.llm.neardup import sorted_groups

CODES, BLOCKS, CODEWORDS, LISTED = 4, 4, 64, 16
CELL = 512


class ProductCode:
    """Random rotation and codewords for vectors of one dimension; the same in every task."""

    def __init__(self, dimension: int, number: int):
        rng = np.random.default_rng([93, number, dimension])
        # Short vectors are padded, so that each block has a dimension at least.
        self.width = max(-(-dimension // BLOCKS), 1)
        size = self.width * BLOCKS
        self.rotation = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dimension]
        self.words = rng.normal(size=(BLOCKS, CODEWORDS, self.width))

    def filters(self, unit: np.ndarray) -> np.ndarray:
        """For each unit vector: the ``LISTED`` filters of highest score."""
        turned = (unit @ self.rotation.T).reshape(len(unit), BLOCKS, self.width)
        scores = np.einsum("nbw,bcw->nbc", turned, self.words)
        # A sum among the best has a best part in each block: no more than LISTED of any block are needed.
        order = np.argsort(-scores, axis=2)[:, :, :LISTED]
        best = np.take_along_axis(scores, order, axis=2)
        value, code = best[:, 0], order[:, 0]
        for k in range(1, BLOCKS):
            sums = (value[:, :, None] + best[:, k][:, None, :]).reshape(len(unit), -1)
            codes = (code[:, :, None] * CODEWORDS + order[:, k][:, None, :]).reshape(len(unit), -1)
            keep = np.argpartition(-sums, LISTED - 1, axis=1)[:, :LISTED]
            value, code = np.take_along_axis(sums, keep, axis=1), np.take_along_axis(codes, keep, axis=1)
        return code


def decoded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over node, label, embedding: keys of the node's filters, ascending; a key holds label and dimension too."""
    codes: dict[int, list[ProductCode]] = {}
    for batch in batches:
        node, label, vectors = batch.column(0), np.asarray(batch.column(1).cast(pa.int64())), batch.column(2)
        sizes = np.asarray(vectors.value_lengths())
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
            x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            if size not in codes:
                codes[size] = [ProductCode(size, c) for c in range(CODES)]
            own = np.concatenate([code.filters(x) + c * CODEWORDS**BLOCKS for c, code in enumerate(codes[size])], axis=1).astype(np.uint64)
            kind = mixed(label[at].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(size))
            keys = np.sort(mixed(own + kind[:, None]).view(np.int64), axis=1)
            for k, row in zip(at.tolist(), keys):
                found[k] = row
        yield pa.RecordBatch.from_arrays([node, pa.array(found, pa.list_(pa.int64()))], names=["node", "filters"])


def met_before(filters: np.ndarray, key: int) -> np.ndarray:
    """For every two rows of a table of keys: whether they have one below ``key`` in common."""
    value, where, count = np.unique(filters, return_inverse=True, return_counts=True)
    useful = (count > 1) & (value < key)
    place = np.cumsum(useful) - 1
    at = np.flatnonzero(useful[where.reshape(-1)])
    held = np.zeros((len(filters), int(useful.sum())), np.float32)
    held[at // filters.shape[1], place[where.reshape(-1)[at]]] = 1
    return held @ held.T > 0.5


def verified_rows(least: float):
    """For mapInArrow over rows sorted by cell: link counts of its nodes (y null), and links that join them (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches):
            rows = group.num_rows
            if rows < 2:
                continue
            node, own, weight = (np.asarray(group.column(k)) for k in (1, 2, 4))
            key, cross = group.column(5)[0].as_py(), group.column(3)[0].as_py()
            vectors = group.column(6).combine_chunks()
            sizes = np.asarray(vectors.value_lengths())
            if sizes.min() != sizes.max():  # another dimension under the same key
                continue
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
            x /= np.abs(x).max(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            cosine = (x @ x.T) / (norm[:, None] * norm[None, :])
            near = np.triu(cosine >= least, 1)
            if cross:
                near &= own[:, None] != own[None, :]
            near &= node[:, None] != node[None, :]
            if not near.any():
                continue
            filters = group.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)
            i, j = np.nonzero(near & ~met_before(filters, key))
            if not len(i):
                continue
            count = np.bincount(i, weight[j], rows) + np.bincount(j, weight[i], rows)
            at = np.flatnonzero(count)
            root = list(range(rows))
            links = []
            for p, q in zip(i.tolist(), j.tolist()):
                a, b = p, q
                while root[a] != a:
                    root[a] = root[root[a]]
                    a = root[a]
                while root[b] != b:
                    root[b] = root[root[b]]
                    b = root[b]
                if a != b:
                    root[a] = b
                    links.append((p, q))
            first, second = (node[[link[k] for link in links]] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[node[at], first]),
                    pa.array(np.r_[np.zeros(len(at), np.int64), second], mask=np.r_[np.ones(len(at), bool), np.zeros(len(first), bool)]),
                    pa.array(np.r_[count[at].astype(np.int64), np.zeros(len(first), np.int64)], mask=np.r_[np.zeros(len(at), bool), np.ones(len(first), bool)]),
                ],
                names=["x", "y", "n"],
            )

    return run


def usable(vector: str, label: str | None = None):
    """Whether a vector takes part: no null or non-finite component, not empty or zero, and a label if one is asked for."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    fine = F.coalesce(fine, F.lit(False)) & F.col(vector).isNotNull()
    return fine & F.col(label).isNotNull() if label else fine


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    small_batches(vectors.sparkSession, rows=1000)
    vectors = vectors.select("vec_id", "embedding", "label")
    good = vectors.where(usable("embedding", "label") & F.col("vec_id").isNotNull())
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("weight"))
    classes = stored(classes, "vectors")
    decoded = stored(classes.select("node", "label", "embedding").mapInArrow(decoded_rows, "node long, filters array<long>"), "filters")
    listed = decoded.select("node", F.explode("filters").alias("key"))
    sizes = listed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(listed.join(sizes, "key"), "members")
    blocks = F.ceil(F.col("m") / CELL)
    dealt = members.withColumn("own", F.pmod(F.xxhash64("node", "key"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", "own", (F.col("own") != F.col("other")).alias("cross"), "key"
    )
    payload = classes.select("node", "weight", "embedding").join(decoded, "node")
    rows = dealt.join(payload, "node").select("cell", "node", "own", "cross", "weight", "key", "embedding", "filters")
    found = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(verified_rows(least), "x long, y long, n long")
    found = stored(found, "found")
    counts = found.where("y is null").groupBy(F.col("x").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(found.where("y is not null").select("x", "y"))
    nodes = classes.select("label", "embedding", "node", "weight").join(counts, "node", "left").join(labels, "node", "left")
    nodes = nodes.select("label", "embedding", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = good.join(nodes, ["label", "embedding"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = vectors.where(~(usable("embedding", "label") & F.col("vec_id").isNotNull()))
    return out.unionByName(rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
