"""Sentencepiece encoding with spans, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from lakesurvey.llm import chunks, piececodec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "İ", "<s>", "<0x0A>", "<unk>", "1", "²", "　", "日本", "ガ", "\x1c", ".", "!!", "😀", "\0", "ﬁ", "ß", "ing", "the", "▁", "①", "ﷺ", "�", "​", "한", "한", "of "]


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(11)
    some = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    return some + ["", " ", "   ", None, "x " * 40_000, "ab" * 3000, "日" * 700 + " end", "lorem ipsum dolor " * 500]


@pytest.fixture(scope="module")
def nfkc(tmp_path_factory):
    """The same vocabulary under a compiled character map, keeping blanks and squeezing them."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.ModelProto()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    model.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    paths = []
    for squeeze in (False, True):
        model.normalizer_spec.remove_extra_whitespaces = squeeze
        path = tmp_path_factory.mktemp("model") / "nfkc.model"
        path.write_bytes(model.SerializeToString())
        paths.append(str(path))
    return paths


def library_pieces(library, text):
    """Ids and byte spans as the library gives them."""
    return [(p.id, p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]


@pytest.mark.parametrize("mapped", [None, 0, 1])
@pytest.mark.parametrize("size", [300, 2 << 20])
def test_ids_spans_and_decoding_match_the_library(odd_texts, nfkc, mapped, size, monkeypatch):
    monkeypatch.setattr(piececodec, "SLICE", size)
    path = MODEL if mapped is None else nfkc[mapped]
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piececodec.PieceCodec(path, limit=500)
    data, offsets = chunks.text_bytes(pa.array(odd_texts))
    for a, b in chunks.row_slices(data, offsets, 20_000):
        e = own.encode_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        stops = np.cumsum(e.counts)
        for k in range(a, b):
            text, part = odd_texts[k] or "", slice(stops[k - a] - e.counts[k - a], stops[k - a])
            expected = library_pieces(library, text)
            shift = offsets[k] - offsets[a]
            got = list(zip(e.ids[part].tolist(), (e.begins[part] - shift).tolist(), (e.ends[part] - shift).tolist()))
            assert got == expected, text[:200]
            assert own.decode(e.ids[part]).decode() == library.decode([i for i, _, _ in expected]), text[:200]


def test_normaliser_matches_the_library_text(odd_texts, nfkc):
    data, offsets = chunks.text_bytes(pa.array(odd_texts))
    for path in nfkc:
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        got = piececodec.PieceCodec(path).normalise(data, offsets)
        for k, text in enumerate(odd_texts):
            normal = got.data[got.offsets[k] : got.offsets[k + 1]].tobytes().decode()
            assert normal == library.normalize(text or "").replace("▁", " "), text


def test_decoding_of_ids_that_no_text_gives():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piececodec.PieceCodec(MODEL)
    rnd = random.Random(3)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randint(3, 258), rnd.randint(3, 31999), 259, 29871]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


def test_runs_that_hash_alike():
    bits = [bin(k).count("1") % 2 for k in range(2048)]
    texts = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), piececodec.PieceCodec(MODEL)
    data, offsets = chunks.text_bytes(pa.array(texts))
    assert own.encode_rows(data, offsets).ids.tolist() == [i for t in texts for i in library.encode(t)]


def test_piece_codec(spark, edge, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert piececodec.digests(no_docs, MODEL).count() == 0 and piececodec.spans(no_docs, MODEL).count() == 0
    got = sorted(map(str, (tuple(r) for r in piececodec.digests(edge, MODEL).collect())))
    expected, rows = [], edge.select("doc_id", "text").collect()
    for r in rows:
        ids = library.encode(r.text or "")
        expected.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(map(str, expected))
    got = sorted(str((r.doc_id, list(zip(r.ids, r.begins, r.ends)))) for r in piececodec.spans(edge, MODEL).collect())
    assert got == sorted(str((r.doc_id, library_pieces(library, r.text or ""))) for r in rows)
