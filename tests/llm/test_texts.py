"""Near-duplicates, classifiers and language spans, against brute force and held-out documents."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakesurvey.llm import language, neardup, quality, toxicity
from lakesurvey.llm.common import table


def brute_groups(rows):
    """doc_id, n_shingles, component_id, kept of rows (doc_id, text) with distinct doc_id."""
    sets = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[doc] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return sorted((d, len(s), top(d), top(d) == d) for d, s in sets.items())


def families(seed, families=6, size=40, words=90):
    """Families of near copies at all distances, exact copies, and a passage that all documents share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(20)]
    rows, doc = [], 0
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 8])):
                own[rnd.randrange(len(own))] = word()
            text = " ".join(passage + own if rnd.random() < 0.5 else own)
            rows.append((doc, text.upper() if rnd.random() < 0.2 else text.replace(" ", "\n", 3)))
            doc += 1
    rows += [(doc + k, t) for k, t in enumerate(["", None, " \n ", "one two", "one  TWO", "one two three four", "ONE two three four", "a b c d e", "b c d e a"])]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("cell", [8, 1024])
def test_near_duplicates(spark, cell, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", cell)  # small cells: groups are cut to blocks, then dealt by pairs of sub-keys
    rows = families(cell)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def near_copies(n, kinds, seed):
    """Signed rows of near copies of ``kinds`` texts, dealt in turn."""
    rnd = random.Random(seed)
    words = [[f"w{rnd.randrange(10**6)}" for _ in range(400)] for _ in range(kinds)]
    texts = []
    for k in range(n):
        own = list(words[k % kinds])
        own[rnd.randrange(400)] = f"x{k}"
        texts.append(" ".join(own))
    return [(k, t) for k, t in enumerate(texts)]


def test_cells_of_near_copies_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 32)
    rows = {}
    for n in (256, 512):
        docs = spark.createDataFrame(near_copies(n, 1, 3), "doc_id long, text string")
        reps = docs.mapInArrow(neardup.signed_rows, neardup.SIGNED).select("doc_id", "a", "b", "sig").cache()
        members = neardup.members_of(reps)
        cells = neardup.with_payload(neardup.block_cells(members), reps)
        labels = neardup.components(neardup.confirmed_links(cells, docs))
        assert labels.select("component").distinct().count() == 1
        rows[n] = cells.count() + neardup.apart_cells(members, labels, reps).count()
        # One document outside the component: every other meets it once for each sub-key they share, and none of its own component.
        alone = labels.where("node <> 7")
        apart = neardup.apart_cells(members, alone, reps)
        assert apart.count() <= 18 * 2 * n
        links = neardup.confirmed_links(neardup.with_payload(apart, reps), docs)
        assert {tuple(sorted(r)) for r in links.collect()} == {(0, 7)}
    assert rows[256] <= 18 * 256 and rows[512] <= 18 * 512


def test_large_components_that_share_keys_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL", 4)
    monkeypatch.setattr(neardup, "block_cells", lambda members: members.where("n < 0").selectExpr("group as cell", "node", "node as component", "0L as block", "at", "-1 as table"))
    rows = near_copies(90, 2, 5)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute_groups(rows)


def test_near_duplicates_of_odd_rows(edge, no_docs):
    assert neardup.near_duplicates(no_docs).count() == 0
    got = neardup.near_duplicates(edge).collect()
    assert len(got) == edge.count()
    assert {tuple(r) for r in got if r.doc_id is not None} == set(brute_groups({r.doc_id: r.text for r in edge.collect() if r.doc_id is not None}.items()))
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2


def held_out(df, docs, label):
    rows = df.join(docs.select("doc_id", F.col(label).alias("truth")).where("truth is not null"), "doc_id").where("held_out").collect()
    return rows


def test_quality_is_learned(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = held_out(quality.scores(docs, labels), labels, "quality")
    assert np.mean([r.predicted == r.truth for r in rows]) >= 0.95
    assert quality.scores(docs, labels).count() == docs.count()


def test_toxicity_is_learned(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = held_out(toxicity.scores(docs, labels), labels, "toxic")
    assert np.mean([r.predicted == r.truth for r in rows]) >= 0.93
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_is_learned(spark, sf):
    docs = table(spark, sf, "documents")
    got = language.languages(docs)
    rows = held_out(got, docs, "lang")
    assert np.mean([r.lang_pred == r.truth for r in rows]) >= 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.collect())


def test_classifiers_take_odd_rows(spark, edge, no_docs, labels, no_labels):
    for operator in (quality.scores, toxicity.scores):
        assert operator(no_docs, labels).count() == 0
        for own in (labels, no_labels, labels.where("doc_id < 3")):
            got = operator(edge, own).collect()
            assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
        assert {r.score for r in operator(edge, no_labels).collect()} == {0.5}
    assert language.languages(no_docs).count() == 0
    got = language.languages(edge).collect()
    assert len(got) == edge.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 17, 18)} == {"und"}
    nothing = language.languages(edge.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_inputs_are_text_alone(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality.fit_model(docs, labels)
    text = docs.first().text
    data = [pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, text])], names=["doc_id", "text"])]
    (batch,) = quality.score_rows(model, 0.3)(iter(data))
    assert len(set(batch.column(1).to_pylist())) == 1


def test_measures_by_hand():
    column = pa.array(["Ab ab. Ab\nab ##", "", None, "x"])
    from lakesurvey.llm.chunks import text_bytes

    got = dict(zip(quality.MEASURES, quality.measures(*text_bytes(column)).T))
    assert np.allclose(np.expm1(got["log_words"]), [5, 0, 0, 1])
    assert got["longest_word"].tolist() == [3, 0, 0, 1]
    assert np.isclose(got["distinct_words"][0], 4 / 5) and np.isclose(got["mark_1"][0], 2 / 15)
    assert got["same_as_before"].tolist() == [0, 0, 0, 0]


def brute_maximal(scores):
    """Maximal segments by their definition: recursively the best segment, then both sides of it."""
    found = []

    def split(a, b):
        best = (0.0, None)
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > best[0] + 1e-9 or best[1] and abs(s - best[0]) < 1e-9 and (i < best[1][0] or j - i < best[1][1] - best[1][0]) and i >= best[1][0] and j <= best[1][1]:
                    best = (s, (i, j))
        if best[1]:
            i, j = best[1]
            found.append((i, j - 1, round(best[0], 6)))
            split(a, i)
            split(j, b)

    split(0, len(scores))
    return sorted(found)


def test_maximal_segments():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(1, 14))
        scores = np.where(rng.random(n) < 0.5, rng.normal(1, 1.5, n), -0.7).round(3) + rng.random(n) * 1e-4
        scores[np.abs(scores + 0.7) < 0.01] = -0.7
        places = np.flatnonzero(scores != -0.7)
        got = toxicity.maximal_segments(places, scores[places], 0.7)
        assert sorted((a, b, round(s, 6)) for a, b, s in got) == brute_maximal(scores.tolist())


def test_significant_passages_are_returned(spark):
    model = toxicity.Model({"idiot": 6.0, "mor*": 3.0}, cost=0.5, rate=1.0, log_k=0.0)
    docs = spark.createDataFrame([(1, "what an Idiot, moron you are " + "and so on " * 50 + "idiot"), (2, "nothing"), (3, None)], "doc_id long, text string")
    rows = toxicity.passages(docs, model).collect()
    assert all(r.doc_id == 1 for r in rows)
    assert "Idiot, moron" in [r.passage for r in rows]
    assert toxicity.solved_rate(np.array([1.0, -1.0]), np.array([0.25, 0.75])) == pytest.approx(np.log(3))


def best_path(score, penalty):
    def value(path):
        return sum(score[i][k] for i, k in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))

    return max(value(p) for p in itertools.product(range(len(score[0])), repeat=len(score))), value


def test_paths_are_the_best_ones():
    rng = np.random.default_rng(7)
    for _ in range(60):
        counts = rng.integers(0, 7, 6)
        score = rng.normal(0, 5, (int(counts.sum()), 3)).astype(np.float32)
        penalty = float(rng.choice([0.5, 4, 12]))
        best, constant = language.constant_paths(score, counts, penalty)
        path = language.viterbi(score, counts, penalty)
        for k, end in enumerate(np.cumsum(counts)):
            own = score[end - counts[k] : end].astype(float)
            if len(own):
                top, value = best_path(own, penalty)
                assert value(path[end - counts[k] : end].tolist()) == pytest.approx(top)
                if constant[k]:
                    assert value([best[k]] * len(own)) == pytest.approx(top)


def test_mixed_text_gets_spans(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit_model(docs)
    one = docs.where("lang = 'en' and length(text) between 300 and 2000").first().text
    two = docs.where("lang = 'fr' and length(text) between 300 and 2000").first().text
    rows = language.spans(spark.createDataFrame([(1, one + " " + two), (2, None)], "doc_id long, text string"), model).collect()
    assert [r.lang for r in rows][0] == "en" and [r.lang for r in rows][-1] == "fr"
    assert abs(rows[-1].end - len(one) - len(two) - 1) < 2


def language_docs(spark, samples, copies=40):
    rnd = random.Random(3)
    rows = [(k * copies + c, "".join(rnd.choice(letters) for _ in range(200)), lang) for k, (lang, letters) in enumerate(samples.items()) for c in range(copies)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_texts_without_blanks_have_a_language(spark):
    samples = {"aa": "abcdefgh  ", "cc": "ijklmnop  ", "ru": "бвгдежзи  ", "zh": "".join(map(chr, range(0x4E00, 0x4E40)))}
    model = language.fit_model(language_docs(spark, samples))
    rnd = random.Random(4)
    letters = lambda lang, n: "".join(rnd.choice(samples[lang].strip()) for _ in range(n))
    texts = [letters("zh", 2000), letters("aa", 2000), "\n".join(letters("cc", 6) for _ in range(600)), "\t".join(letters("ru", 5) for _ in range(600)), letters("aa", 900) + letters("ru", 300), "ខ្មែរ" * 600, letters("zh", 300) + "กขค" * 10]
    table, column = language.WordScores(model), pa.array(texts)
    from lakesurvey.llm.chunks import text_bytes

    best, score, spans = language.labelled_texts(table, *text_bytes(column))
    common = model.languages[model.commonest]  # of a text whose writing system no language uses
    assert [[*model.languages, "und"][k] for k in best] == ["zh", "aa", "cc", "ru", "aa", common, "zh"]
    assert score.round(4).tolist() == [1, 1, 1, 1, 0.75, 0, round(300 / 330, 4)] and spans.tolist() == [1, 1, 1, 1, 2, 0, 1]
    rows = language.spans(spark.createDataFrame([(1, "(" + texts[4] + "!) " + letters("cc", 400) + "\n" + letters("ru", 60))], "doc_id long, text string"), model).collect()
    assert [(r.begin, r.end, r.lang) for r in rows] == [(0, 901, "aa"), (901, 1203, "ru"), (1204, 1604, "cc"), (1605, 1665, "ru")]


def test_und_is_for_texts_without_letters_alone(spark):
    samples = {"aa": "abcdefgh  ", "cc": "ijklmnop  "}
    docs = language_docs(spark, samples).where("lang = 'cc' or doc_id < 20")
    texts = [(9001, "½ ² ³ ① Ⅳ"), (9002, "привет мир"), (9003, "abc²def ½"), (9004, "12 !?"), (9005, None), (9006, "²"), (9007, "ª")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(docs.unionByName(spark.createDataFrame(texts, "doc_id long, text string"), allowMissingColumns=True)).where("doc_id > 9000").collect()}
    assert got[9001] == got[9004] == got[9005] == got[9006] == ("und", 0.0)
    assert got[9002] == ("cc", 0.0) and got[9003] == ("aa", 1.0) and got[9007][0] in samples
    assert language.words_of("ab²cd½ x¾ ¾y") == ["ab", "cd", "x", "y"] and language.piece_places("a²b") == [(0, 1), (2, 3)]


def test_passages_hold_the_words_that_were_scored(spark):
    """The dotted I is one letter of one word, before and after lower-casing."""
    assert toxicity.WORD.findall(toxicity.lowered("İstanbul İİ x")) == ["istanbul", "ii", "x"]
    assert [m.span() for m in toxicity.WORD.finditer(toxicity.lowered("İstanbul İİ x"))] == [(0, 8), (9, 11), (12, 13)]


def test_words_that_hash_alike_modulo_a_power_of_two_are_not_linked(spark):
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = ("".join("ab"[b ^ x] for b in bits) for x in (0, 1))
    rows = [(1, one), (2, two), (3, " ".join([one] * 9)), (4, " ".join([two] * 9)), (5, one)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute_groups(rows)


def test_every_language_of_the_sample_is_learned(spark):
    rnd = random.Random(5)
    samples = {f"l{k:03}": "".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 6)) + " " for k in range(130)}
    docs = language_docs(spark, samples, copies=8)
    model = language.fit_model(docs)
    assert model.languages == sorted(samples)
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == 1040 and np.mean([r.lang_pred == r.lang for r in rows]) > 0.95


def test_passages_of_words_that_were_used_before(spark):
    insults = ["idiot", "moron", "stupid", "fool", "jerk", "liar"]
    model = toxicity.Model(dict.fromkeys(insults, 4.0), cost=0.5, rate=1.0, log_k=0.0)
    dense, gap = " ".join(insults), "and so on then " * 30
    scattered = gap.join(w + " " for w in insults) + gap
    docs = spark.createDataFrame([(1, scattered + dense), (2, dense + " " + gap + dense), (3, "idiot " * 500), (4, ("idiot " + "a " * 7) * 60)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.begin, r.passage) for r in toxicity.passages(docs, model).collect())
    assert [(d, p) for d, _, p in rows] == [(1, dense), (2, dense), (2, dense)]
    scores = toxicity.evidence(model, toxicity.WordWeights(model), *toxicity.text_bytes(pa.array([scattered + dense, dense + " " + gap + dense])))
    assert scores[:, 1].tolist() == [24, 24] and scores[1, 3] > 1.5 * scores[0, 3]


def test_moderately_toxic_words_are_learned(spark):
    """Words of nine-fold odds tell the documents only together; the odds limit is chosen from the learning rows."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    telling, filler, rows, truth = [word() for _ in range(40)], [word() for _ in range(300)], [], []
    for doc in range(900):
        toxic = doc % 3 == 0
        own = [w for w in telling if rnd.random() < (0.5 if toxic else 0.1)] + [rnd.choice(filler) for _ in range(25)]
        rnd.shuffle(own)
        rows.append((doc, " ".join(own)))
        truth.append((doc, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    assert toxicity.fit_model(docs, labels).odds < 2.5
    got = held_out(toxicity.scores(docs, labels), labels, "toxic")
    assert np.mean([r.predicted == r.truth for r in got]) > 0.95
