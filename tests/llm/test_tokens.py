"""Token files, packing, counts and the word codec, against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lakesurvey.llm import chunks, packing, tokencounts, tokenfile, wordcodec
from lakesurvey.llm.merges import merged

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = ["a", "B", " ", "  ", "\n", "\t", "é", "é", "́", "Σ", "ς", "İ", "<|endoftext|>", "<|startoftext|>", "<|", "'s", "'S", "1", "²", "　", "日", "\x1c", "\x85", ".", "!!", "😀", "ll", "\0", "ǅ", "ﬁ", "ß", "'", "ing", "th", "▁", "<s>"]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def odd_texts():
    rnd = random.Random(5)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)] + ["", " ", None, "x " * 50_000, "ab" * 3000, "a" * 700]


@pytest.mark.parametrize("path, blanks, lower", [(BYTES, True, False), (WORDS, False, True)])
@pytest.mark.parametrize("size", [1000, 4 << 20])
def test_chunk_encoder_matches_library(odd_texts, path, blanks, lower, size, monkeypatch):
    monkeypatch.setattr(chunks, "SLICE", size)
    encoder = chunks.ChunkEncoder(path, blanks, lower, limit=2000)  # the memory is dropped now and then
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in odd_texts], add_special_tokens=False)]
    seen = 0
    for first, ids, lengths in encoder.encode(pa.array(odd_texts)):
        ends = np.cumsum(lengths)
        for k, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist())):
            assert ids[end - n : end].tolist() == expected[first + k], odd_texts[first + k]
        seen += len(lengths)
    assert seen == len(odd_texts)


def thue_morse(n):
    """Two complementary runs of n letters, whose polynomial hashes modulo a power of two are equal."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


ALIKE = [t for n in (1024, 2048, 4096, 8192) for pair in [thue_morse(n)] for t in (*pair, f"x {pair[1]} y {pair[0]}", pair[0][:-1] + "!")]


@pytest.mark.parametrize("path, blanks, lower", [(BYTES, True, False), (WORDS, False, True)])
def test_runs_that_hash_alike_keep_their_own_ids(path, blanks, lower):
    expected = [i for e in Tokenizer.from_file(path).encode_batch(ALIKE, add_special_tokens=False) for i in e.ids]
    encoder = chunks.ChunkEncoder(path, blanks, lower)
    assert np.concatenate([ids for _, ids, _ in encoder.encode(pa.array(ALIKE))]).tolist() == expected
    data, offsets = chunks.text_bytes(pa.array(ALIKE))
    if lower:
        assert wordcodec.WordCodec(path).encode_rows(data, offsets)[0].tolist() == expected
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert tokencounts.TokenCounter(PIECES).count(data, offsets).tolist() == [len(library.encode(t)) for t in ALIKE]
    assert len(set(chunks.run_keys(data, offsets[:-1], offsets[1:]).tolist())) == len(ALIKE)


def test_chunks_with_equal_keys_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(chunks, "word_keys", lambda words, counts, tags: (tags % 3 + 1).astype(np.uint64))
    texts = ["to be or not to be that is the question", "", "whether tis nobler in the mind to suffer", "the slings and arrows of outrageous fortune to"] * 3
    encoder = chunks.ChunkEncoder(BYTES, True, False)
    got = np.concatenate([ids for _, ids, _ in encoder.encode(pa.array(texts))]).tolist()
    assert got == [i for e in Tokenizer.from_file(BYTES).encode_batch(texts, add_special_tokens=False) for i in e.ids]


def test_key_index_finds_what_was_added():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 5000, dtype=np.uint64))
    keys[:50] = np.arange(1, 51, dtype=np.uint64)  # these share a slot
    keys = np.unique(keys)
    index = chunks.KeyIndex(4)
    for part in np.array_split(keys, 7):
        index.add(part)
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert (index.find(np.array([2**63 + 5, 60], np.uint64)) == -1).all()


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 50, 400, 3000]:
        for values in (1, 2, 5, 60000):
            ids = (rng.integers(0, values, n) * 3).astype(np.uint32)
            alphabet, rules, lengths, symbols = tokenfile.compress(ids, least=2, gain=0)
            assert tokenfile.expanded(symbols, alphabet, rules, lengths).tolist() == ids.tolist()
            row = {"alphabet": alphabet.tobytes(), "rules": rules.tobytes(), "expansions": lengths.tobytes(), "symbols": symbols.tobytes(), "docs": b"", "doc_nulls": b"", "doc_lengths": b""}
            shard = tokenfile.Shard(row)
            for _ in range(5):
                a, b = sorted(rng.integers(0, n + 2, 2).tolist())
                assert tokenfile.decode_range(shard, a, b).tolist() == ids[a:b].tolist()
    ids = np.tile(np.arange(8, dtype=np.uint32), 1000)
    assert len(tokenfile.compress(ids)[3]) < len(ids) / 6


def test_token_file(spark, edge, no_docs):
    assert tokenfile.round_trip(no_docs, BYTES).count() == 0
    got = sorted(map(tuple, tokenfile.round_trip(edge, BYTES).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(BYTES)
    rows = [(r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in edge.collect()]
    assert [r[0] for r in got] == sorted([d for d, _ in rows], key=lambda d: (d is not None, d))
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((d or -1, len(i), crc(i)) for d, i in rows)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]


def test_bounds_never_exceed_a_packing_and_best_fit_is_near():
    rng = np.random.default_rng(2)
    for _ in range(150):
        cuts = [np.diff(np.r_[0, np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 6), replace=False)), 60]) for _ in range(20)]
        lengths = np.concatenate(cuts)
        assert packing.least_bins(lengths, 60) == 20
        bins, offsets, fills = packing.best_fit(lengths, 60)
        assert fills.max() <= 60 and len(fills) >= 20 and np.bincount(bins, lengths).tolist() == fills.tolist()
    assert packing.least_bins(np.array([31] * 7), 60) == 7
    assert packing.least_bins(np.zeros(0, int), 60) == 0


@pytest.mark.parametrize("part_rows", [3, 50_000])
def test_packing(edge, no_docs, part_rows):
    assert packing.pack(no_docs, WORDS).count() == 0
    got = packing.pack(edge, WORDS, part_rows=part_rows).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for r in edge.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        expected += [(r.doc_id or -1, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 4096
    assert all(r.gap >= 0 for r in got) and (part_rows < 1000 or {r.gap for r in got} == {0})
    total = sum(r.length for r in got)
    assert len(places) <= -(-total // 4096) + (0 if part_rows > 1000 else 8)


def test_exchanges_go_on_while_they_save_bins(spark):
    """Parts of a few pieces that fit only across parts: the bins come close to the bound of all."""
    rnd = random.Random(6)
    texts = [(k, " ".join(["dog"] * rnd.choice([1365, 1400, 2690, 2730, 700, 3390]))) for k in range(120)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), WORDS, part_rows=10).collect()
    least = packing.least_bins(np.array([r.length for r in got]), 4096)
    once = sum(len(packing.best_fit(np.array([r.length for r in got])[k::12], 4096)[2]) for k in range(12))
    bins = len({r.sequence_id for r in got})
    assert least <= bins < once and bins <= 1.06 * least + 2


def test_merging_long_sequences_agrees_with_the_arrays():
    pieces = tokencounts.Pieces(PIECES)
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abcdeinrst▁") for _ in range(rng.randint(1, 60)))
        symbols = pieces.of_char[[ord(c) for c in text]]
        flat, lengths = tokencounts.surviving(pieces, symbols, np.array([len(text)]))
        assert merged(symbols.tolist(), pieces.pair_of) == flat.tolist() and lengths[0] == len(flat)


def test_token_counts(edge, no_docs, odd_texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counter = tokencounts.TokenCounter(PIECES, limit=500)
    data, offsets = chunks.text_bytes(pa.array(odd_texts))
    assert counter.count(data, offsets).tolist() == [len(library.encode(t or "")) for t in odd_texts]
    assert tokencounts.token_counts(no_docs, PIECES).count() == 0
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(edge, PIECES).collect())
    expected = [(r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in edge.collect()]
    assert got == sorted((*e, e[2] > 4096) for e in expected)


def test_compatible_pairs_are_those_that_merging_gives():
    merges = wordcodec.Merges(WORDS)
    rng = np.random.default_rng(4)
    tokens = np.sort(rng.choice(merges.inner[1], 300, replace=False))
    left, right = rng.choice(tokens, 2000).astype(np.int32), rng.choice(np.r_[tokens, merges.final[1][:300]], 2000).astype(np.int32)
    signs = {c: b for b, c in enumerate(wordcodec.byte_signs())}
    expected = []
    for a, b in zip(left.tolist(), right.tolist()):
        text = merges.texts[b]
        end = text.endswith("</w>")
        raw = bytes(signs[c] for c in merges.texts[a] + (text[:-4] if end else text))
        ids, _ = merges.exact_batch(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), end)
        expected.append(ids.tolist() == [a, b])
    assert merges.compatible(left, right).tolist() == expected
    assert any(expected) and not all(expected)


def test_word_codec(edge, no_docs, odd_texts):
    library = Tokenizer.from_file(WORDS)
    own = wordcodec.WordCodec(WORDS, limit=500)
    data, offsets = chunks.text_bytes(pa.array(odd_texts))
    ids, lengths = own.encode_rows(data, offsets)
    ends = np.cumsum(lengths)
    for k, text in enumerate(odd_texts):
        expected = library.encode(text or "", add_special_tokens=False).ids
        got = ids[ends[k] - lengths[k] : ends[k]]
        assert got.tolist() == expected, text
        assert own.decode(got) == library.decode(expected, skip_special_tokens=False)
    assert 0 < own.failed
    assert wordcodec.digests(no_docs, WORDS).count() == 0
    got = sorted(map(str, (tuple(r) for r in wordcodec.digests(edge, WORDS).collect())))
    expected = []
    for r in edge.collect():
        own_ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(own_ids, skip_special_tokens=False)
        expected.append((r.doc_id, len(own_ids), hashlib.sha256(np.array(own_ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(map(str, expected))
