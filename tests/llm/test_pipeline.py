"""The pipeline against a brute-force version of it, and every registered query against its contract."""

import os

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from lakesurvey.llm import quality, toxicity
from lakesurvey.llm.chunks import text_bytes
from tests.llm.test_texts import brute_groups

SMALL = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_file": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op2_toxicity_segments": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op4_near_duplicates": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op6_language_spans": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_quality_model": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op8_word_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op9_cap_filters": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op11_piece_codec": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op12_spelling_variants": {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"},
    "op13_lexical_search": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
    "op10_top_products": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    df = entry.queries()[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    db = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    if sql := entry.oracle_sql().get(name):
        expected = db.execute(sql)
        names = [d[0] for d in expected.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, (tuple(r[n] for n in names) for r in rows))) == sorted(map(str, expected.fetchall()))
    elif name != "op3_best_fit_packing":
        assert len(rows) == db.execute("SELECT count(*) FROM documents").fetchone()[0]


@pytest.fixture
def folder(spark, edge, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = edge.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars", "label", "score", "kept", "node")
    twice = docs.limit(40).select((F.col("doc_id") + 500_000 - F.col("doc_id") % 2).alias("doc_id"), F.concat(F.lit("x "), F.reverse("text")).alias("text"), "lang", "source", "n_chars")
    docs.unionByName(odd, allowMissingColumns=True).unionByName(twice, allowMissingColumns=True).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def one(text):
    return text_bytes(pa.array([text], pa.string()))


def test_pipeline_is_its_brute_force_version(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "near_duplicates", "packing"]
    rows = docs.collect()
    now = docs
    for name in ("quality", "toxicity", "near_duplicates"):
        out = stages[name](spark, now, folder)
        assert out.columns == docs.columns
        if name == "quality":
            model = quality.fit_model(now, labels)
            rows = [r for r in rows if model.score(quality.measures(*one(r.text)))[0] >= 0.3]
        elif name == "toxicity":
            model = toxicity.fit_model(now, labels)
            rows = [r for r in rows if toxicity.text_scores(model, toxicity.WordWeights(model), pa.array([r.text], pa.string()))[0][0] < 0.5]
        else:
            known = sorted((r for r in rows if r.doc_id is not None), key=lambda r: r.doc_id)
            keep = {k for k, _, _, kept in brute_groups((k, r.text) for k, r in enumerate(known)) if kept}
            assert any(known[k].doc_id == known[k + 1].doc_id for k in keep if k + 1 in keep)  # an id of two texts keeps both
            rows = [r for k, r in enumerate(known) if k in keep] + [r for r in rows if r.doc_id is None]
        path = f"{folder}/{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        assert sorted((r.doc_id or -1, r.text or "") for r in now.collect()) == sorted((r.doc_id or -1, r.text or "") for r in rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted((r.doc_id or -1, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in rows)
    packed = stages["packing"](spark, now, folder).collect()
    total = {}
    for r in packed:
        total.setdefault(r.doc_id or -1, []).append(r.length)
    assert sum(map(sum, total.values())) == sum(n for _, n in sizes)
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in whole) == sorted((r.doc_id or -1, r.piece, r.length, r.ids_crc32) for r in packed)
    fill = np.bincount(np.unique([r.sequence_id for r in whole], return_inverse=True)[1], [r.length for r in whole])
    assert fill.max() <= 4096


def test_pipeline_of_empty_tables(spark, no_docs, no_labels, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_the_rest_works_without_this_subpackage():
    """Nothing outside imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for top in ("lakesurvey", "catalog"):
        for where, _, names in os.walk(os.path.join(root, top)):
            if "llm" in where.split(os.sep):
                continue
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(where, name), encoding="utf-8") as f:
                        assert "llm" not in f.read()
