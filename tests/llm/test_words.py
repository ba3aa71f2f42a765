"""Spelling variants and lexical search, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakesurvey.llm import lexical, spelling

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    """Word, n, near words, form, its count, root: every pair of words is compared."""
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    words = {w: n for w, n in count.items() if n >= 2}
    close = {w: [v for v in words if near(v, w)] for w in words}
    form = {w: min((v for v in close[w] if words[v] >= 10 * words[w]), key=lambda v: (-words[v], v), default=None) for w in words}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n, len(close[w]), form[w] or "", words.get(form[w], 0), root(w)) for w, n in words.items())


def found(df):
    return sorted((r.word, r.n, r.n_near, r.form or "", r.form_n or 0, r.root) for r in df.collect())


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_variants_against_every_pair(spark, batch, monkeypatch):
    rnd = random.Random(batch)
    chosen = spelling.small_batches
    monkeypatch.setattr(spelling, "small_batches", lambda s, rows: chosen(s, batch))
    base = ["aaaabaaa", "abcabcabc", "ñandúes", "ÿÀzzzzzz", "overlook", "bbbbbbb"]
    words = set(base)
    while len(words) < 160:
        w = rnd.choice(sorted(words))
        i, c = rnd.randrange(len(w) + 1), rnd.choice("abcñÿo")
        words.add(rnd.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))
    words = sorted(words)
    rows = [(d, " ".join(w.upper() if rnd.random() < 0.3 else w for w in rnd.choices(words, weights=[10 ** (k % 4) for k in range(len(words))], k=150))) for d in range(40)]
    rows += [(None, "aaaabaaa aaaabaaa overlook"), (3, None), (4, ""), (5, "x overlook-overlook7overlook"), (0, rows[0][1])]
    rows += [(100 + k, "chainaaa " * (k < 3) + "chainaab " * (k < 40) + "chainabb " * 900) for k in range(45)]
    expected = variants(rows)
    assert any(e[4] for e in expected) and any(e[3] and e[5] != e[3] for e in expected)
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == expected


def test_variants_of_odd_rows(edge, no_docs):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert found(spelling.variants(edge)) == variants(rows)
    assert spelling.variants(no_docs).count() == 0


def test_one_very_frequent_word_and_one_hot_prefix(spark):
    """A third of all words in one text, and as many words as letters allow around one prefix."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    rows = [(k, f"prefixe{c}s prefixe{c}s") for k, c in enumerate(letters)] + [(500, "prefixes " * 900), (501, "commonest " * 3000)]
    got = found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == variants(rows)
    assert max(g[2] for g in got) > 80


def rank(docs, items, k=10):
    """Every document scored for every item, in Python integers."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    bags = [(d, Counter(pattern.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    length, df = sum(n for *_, n in bags), Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        terms = pattern.findall((text or "").translate(LOWER))
        scores = []
        for d, bag, n in bags:
            m = 100 - 75 + (75 * n * len(bags)) // length
            score = sum(math.floor(1000 * math.log((2 * len(bags) + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if bag[t])
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(map(str, out))


def ranked(df):
    return sorted(str((r.item_id, r["rank"], r.doc_id, r.score)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(150)] + ["Été", "日本", "x1", "a"]
    topics = [rnd.sample(words, 12) for _ in range(12)]
    docs = [(k, " ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(1, 40)) + rnd.choices(words, k=3))) for k in range(900)]
    docs += [(k, docs[7][1]) for k in range(1000, 1040)]  # equal scores
    items = [(k, ", ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(1, 9)))) for k in range(30)]
    return docs, items


@pytest.mark.parametrize("shard, block, cells, terms", [(4096, 16, 4_000_000, 200_000), (100, 4, 900, 40)])
def test_search_against_every_score(spark, corpus, shard, block, cells, terms, monkeypatch):
    docs, items = corpus
    for name, value in (("SHARD_DOCS", shard), ("BLOCK", block), ("CELLS", cells), ("SET_TERMS", terms)):
        monkeypatch.setattr(lexical, name, value)
    odd = [(None, "w1 w2"), (2000, None), (2001, ""), (2002, "--"), (7, "w3 w3 W3"), (7, "w3 w3 W3")]
    more = [(None, "w1 w1"), (99, ""), (98, None), (97, "unknown words"), (5, "w5"), (5, "w6 w6")]
    got = lexical.ranked(spark.createDataFrame(docs + odd, "doc_id long, text string").repartition(3), spark.createDataFrame(items + more, "item_id long, text string"))
    assert ranked(got) == rank(docs + odd, items + more)


def test_search_of_odd_rows(spark, edge, no_docs):
    items = spark.createDataFrame([(1, "the same text in Two rows"), (2, "日本語 x lorem"), (3, "<|endoftext|> s")], "item_id long, text string")
    assert ranked(lexical.ranked(edge, items)) == rank([(r.doc_id, r.text) for r in edge.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert lexical.ranked(no_docs, items).count() == 0
    assert lexical.ranked(edge, items.limit(0)).count() == 0


def test_summaries_bound_all_scores_and_blocks_are_skipped():
    """Bounds are never below a score of the block, and items of one topic leave blocks of others unread."""
    rng = np.random.default_rng(3)
    topic = np.sort(rng.integers(0, 20, 600))
    bags = [np.unique(np.r_[rng.choice(10, 6) + 10 * t, 200]) for t in topic]
    size = np.array(list(map(len, bags)))
    shard = lexical.Shard(np.arange(600), lexical.starts_of(size), size, np.concatenate(bags), rng.integers(1, 100, int(size.sum())))
    blocks = lexical.blocked(shard, 201)
    assert np.bincount(blocks.term, blocks.size, 201).tolist() == np.bincount(shard.terms, minlength=201).tolist()
    terms = [np.r_[rng.choice(10, 4, replace=False) + 10 * t, 200] for t in range(20)]
    own = np.array(list(map(len, terms)))
    items = lexical.Items(np.arange(20), lexical.starts_of(own), own, np.concatenate(terms), np.ones(int(own.sum()), np.int64))
    search = lexical.Search(items, 201, 5)
    item, block, bound = search.bounds(shard, blocks)
    for q, b, top in zip(item[::7].tolist(), block[::7].tolist(), bound[::7].tolist()):
        for d in blocks.docs[blocks.begin[b] : blocks.begin[b] + blocks.size[b]]:
            place = slice(shard.begin[d], shard.begin[d] + shard.size[d])
            assert shard.weights[place][np.isin(shard.terms[place], terms[q])].sum() <= top
    search.add(shard)
    assert search.scored < search.offered / 2


def test_terms_are_matched_by_their_bytes(monkeypatch):
    monkeypatch.setattr(lexical, "word_keys", lambda words, counts, tags: (tags % 3 + 1).astype(np.uint64))
    monkeypatch.setattr("lakesurvey.llm.chunks.word_keys", lexical.word_keys)
    table = lexical.TermTable(["one", "two", "three", "four", "a much longer term of its own"])
    data, offsets = lexical.text_bytes(pa.array(["two", "six", "three", "", "a much longer term of its owN", "a much longer term of its own"]))
    got = table.numbers(data, offsets[:-1], offsets[1:]).tolist()
    assert [table.names[g] if g >= 0 else None for g in got] == ["two", None, "three", None, None, "a much longer term of its own"]
