"""Cap filters and exact top-k, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakesurvey.llm import capfilters, topk

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x long, component long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], k, 1, 2, 3, 4) for i, v, k in rows], SCHEMA)


ODD = [
    (900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [float("inf")] + [1.0] * 15, 1),
    (906, [1.0] * 16, None), (907, [1.0] * 16, None), (908, [1.0] * 3, 1), (909, [2.0] * 3, 1), (910, [1.0] * 16, 1), (911, [3e38] * 16, 1), (912, [1e-38] * 16, 1),
    (None, [1.0] * 16, 1), (913, [1.0], 1), (914, [5.0], 1), (915, [-1.0], 1),
]


def clusters(seed, size=60):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(12):
            centre = rng.normal(size=16)
            centre /= np.linalg.norm(centre)
            for _ in range(int(rng.integers(1, size))):
                v = centre + rng.normal(size=16) * rng.choice([0, 0.02, 0.06, 0.1])
                rows.append((k, [float(np.float32(c)) for c in v * rng.choice([1, 7])], label))
                k += 1
    return rows


def brute_links(rows, least):
    good = [(i, np.array(v, float), k) for i, v, k in rows if i is not None and v and k is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i, *_ in rows if i is not None}
    for a in range(len(good)):
        for b in range(a):
            (i, x, k), (j, y, m) = good[a], good[b]
            if k == m and len(x) == len(y):
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].add(j)
                    links[j].add(i)
    return links


def brute_components(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo, out[i] = [i], i
            while todo:
                for j in links[todo.pop()]:
                    if j not in out:
                        out[j] = i
                        todo.append(j)
    return out


@pytest.mark.parametrize("cell", [16, 512])
def test_near_vectors(spark, cell, monkeypatch):
    monkeypatch.setattr(capfilters, "CELL", cell)  # small cells: a filter's vectors are cut to blocks
    rows = clusters(cell) + ODD
    links = brute_links(rows, 0.93)
    top = brute_components(links)
    got = capfilters.near_vectors(frame(spark, rows)).collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == sorted(links)
    # Filters may miss a pair near the limit; what is found is right, and nearly everything is found.
    assert sum(r.n_links for r in got) >= 0.995 * sum(map(len, links.values()))
    assert all(r.n_links <= len(links[r.vec_id]) for r in got if r.vec_id is not None)
    assert all(top[r.vec_id] == top[r.component_id] and r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert np.mean([r.component_id == top[r.vec_id] for r in got if r.vec_id is not None]) >= 0.98
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_one_hot_vector(spark):
    rows = [(k, [1.0, 2.0, 3.0], 0) for k in range(3000)] + [(3000 + k, [1.0, 2.0, 3.0 + 1e-3 * k], 0) for k in range(5)]
    got = capfilters.near_vectors(frame(spark, rows))
    assert got.groupBy("component_id", "n_links").count().collect() == [(0, 3004, 3005)]
    assert capfilters.near_vectors(frame(spark, [])).count() == 0


def test_list_decoding_finds_the_best_filters():
    code = capfilters.ProductCode(10, 1)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for v, found in zip(x, code.filters(x)):
        turned = (code.rotation @ v).reshape(capfilters.BLOCKS, code.width)
        s = [code.words[b] @ turned[b] for b in range(capfilters.BLOCKS)]
        whole = (s[0][:, None, None, None] + s[1][None, :, None, None] + s[2][None, None, :, None] + s[3][None, None, None, :]).reshape(-1)
        level = np.sort(whole)[-capfilters.LISTED]
        assert sorted(found.tolist()) == np.flatnonzero(whole >= level - 1e-12).tolist()


def brute_top(rows, step, k):
    good = [(i, [int(np.floor(1024 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for q, x in good:
        if q % step == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), i) for i, y in good if i != q and len(x) == len(y)]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(scores, key=lambda t: (-t[0], t[1]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, step", [(64, 16), (4096, 5)])
def test_top_products(spark, block, step, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rows = [r for r in clusters(block) + ODD if r[0] != 911]
    rows += [(2000 + k, rows[k][1], None) for k in range(300)]  # repeated vectors: ties
    got = topk.top_products(frame(spark, rows), F.col("vec_id") % step == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, step, 10)


def test_top_products_of_large_and_few_vectors(spark):
    rows = [(0, [3e4, -2e4], 0), (1, [1e5, 5e4], 0), (100, [1e30, 1.0], 0), (3, [2e30, 0.0], 0), (4, [], 0), (200, [], 0)]
    got = {(r.query_id, r.rank, r.vec_id): r.score for r in topk.top_products(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()}
    assert [got[100, rank, vec] for rank, vec in ((1, 0), (2, 1), (3, 3))] == [2**63 - 1] * 3 and got[200, 1, 4] == 0
    assert (0, 1, 3) in got and got[0, 3, 1] == 1024 * 1024 * (3e4 * 1e5 - 2e4 * 5e4)
    few = [r for r in rows if r[0] < 3]
    assert sorted(map(tuple, topk.top_products(frame(spark, few), F.col("vec_id") % 100 == 0).collect())) == brute_top(few, 100, 10)
    assert topk.top_products(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert topk.top_products(frame(spark, rows[1:2]), F.col("vec_id") % 100 == 0).count() == 0


def test_pruning_keeps_the_best():
    rng = np.random.default_rng(9)
    for scale in (1, 40):
        queries, columns = rng.integers(-900, 900, (20, 64)), rng.integers(-900, 900, (64, 3000))
        columns[32:] //= scale  # most mass in the first dimensions: pairs are compacted
        best = topk.Best(np.arange(20), 10)
        for a in range(0, 3000, 700):
            topk.search_block(best, queries, np.arange(100 + a, min(100 + a + 700, 3100)), columns[:, a : a + 700])
        exact = queries @ columns
        for q in range(20):
            order = np.lexsort((np.arange(3000), -exact[q]))[:10]
            assert best.candidate[best.query == q].tolist() == (order + 100).tolist()
            assert best.score[best.query == q].tolist() == exact[q, order].tolist()


def test_sums_beyond_what_doubles_hold_are_exact():
    """Components that alone are small enough, in so many dimensions that their sums are not."""
    rng = np.random.default_rng(3)
    queries, columns = rng.integers(2**20 - 9, 2**20 - 1, (2, 20_000)), rng.integers(2**20 - 9, 2**20 - 1, (20_000, 12))
    best = topk.Best(np.arange(2), 10)
    topk.search_block(best, queries, np.arange(100, 112), columns)
    exact = [[sum(map(int.__mul__, q, c)) for c in columns.T.tolist()] for q in queries.tolist()]
    assert max(map(max, exact)) > 2**53
    for q in range(2):
        order = sorted(range(12), key=lambda i: (-exact[q][i], i))[:10]
        assert best.candidate[best.query == q].tolist() == [i + 100 for i in order]
        assert best.score[best.query == q].tolist() == [exact[q][i] for i in order]
