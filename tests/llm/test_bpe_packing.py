"""BPE automaton against the tokenizers library, and packing invariants."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from tidemark.llm import packing  # noqa: E402
from tidemark.llm.bpe import LibraryCodec, MergeAutomaton, WordCodec, codec, decode_ids, encode_documents, token_digests  # noqa: E402
from tidemark.llm.queries import word_bpe  # noqa: E402

ODD = ["", " \n\t", "aaaaaaaaaaaaa", "Hello<|endoftext|>World <|ENDOFTEXT|>", "İstanbul ΣΑΣ ß é", "it's WE'LL 123 ²½ _-_", "\x1c\x1f\x85\xa0a b", "中文 ١٢٣ 😀", "x" * 5000]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe())


def test_same_ids_and_text_as_the_library(library):
    rng = random.Random(1)
    alphabet = "aehotrn étöß'.,!?ÀİΣς\x1c 中😀½²_-\ń"
    samples = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000)]
    c = codec(word_bpe())
    for t in samples:
        ids = np.frombuffer(c.encode(t.encode()), "<u4").tolist()
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert c.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_documents(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_digests(docs, word_bpe()).collect():
        e = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(e)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, None, 7), (1, "a b", 8), (1, "a b", 8), (None, "c", 9)], "doc_id long, text string, ids long")
    got = encode_documents(docs, word_bpe())
    assert got.columns == ["doc_id", "ids"] and got.count() == 4
    assert sorted(len(r["ids"]) for r in got.collect()) == [0, 1, 2, 2]
    assert {r["text"] for r in decode_ids(got, word_bpe()).collect()} == {"", "a</w> b</w>", "c</w>"}
    assert token_digests(docs.limit(0), word_bpe()).count() == 0


def test_tree_places_leftmost():
    tree = packing.CapacityTree(4, 10)
    assert [tree.place(n) for n in (7, 5, 3, 5, 4)] == [0, 1, 0, 1, 2]


def check_pieces(rows, ids):
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for d, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[d])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[d][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[d])
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    return sum(length for b in bins.values() for _, length in b) / (packing.LENGTH * len(bins))


def test_packing(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = {r["doc_id"]: [*library.encode(r["text"], add_special_tokens=False).ids, 1] for r in docs.collect()}
    for group in (10**9, 40_000):
        assert check_pieces(packing.pack_documents(docs, word_bpe(), group=group).collect(), ids) > (0.98 if group > 40_000 else 0.9)


def test_packing_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a " * 5000, "x")], "doc_id long, text string, length string")
    assert check_pieces(packing.pack_documents(docs, word_bpe()).collect(), {1: [1], 2: [1], 3: [codec_id("a")] * 5000 + [1]}) > 0.8
    assert packing.pack_documents(docs.where(F.lit(False)), word_bpe()).count() == 0
    kept = packing.pack_documents(docs.where("doc_id = 2"), word_bpe(), keep_ids=True).first()
    assert kept["ids"] == [1]


def codec_id(word):
    return int(np.frombuffer(codec(word_bpe()).encode(word.encode()), "<u4")[0])


def test_frequent_words_stay_remembered(monkeypatch):
    c = type(codec(word_bpe()))(word_bpe())
    monkeypatch.setattr(type(c), "REMEMBERED", 8)
    met, plain = [], c.automaton.encode
    c.automaton.encode = lambda symbols: met.append(symbols) or plain(symbols)
    for i in range(40):
        c.encode(f"often, {'abcdefghij'[i % 10] * (2 + i // 10)}".encode())
    assert met.count("often") == 1 and len(met) == 42


def test_arcs_are_listed_only_to_turn_back(monkeypatch):
    c, listed = WordCodec(word_bpe()), []
    inner = MergeAutomaton._inner
    monkeypatch.setattr(MergeAutomaton, "_inner", lambda self, *a: listed.append(a[0]) or inner(self, *a))
    rng = random.Random(4)
    words = ["".join(rng.choice(["th", "er", "an", "in", "ou", "le", "qu", "z"]) for _ in range(rng.randrange(1, 9))) for _ in range(2000)]
    assert [np.frombuffer(c.encode(w.encode()), "<u4").tolist() for w in words] == [e.ids for e in c.library.encode_batch(words, add_special_tokens=False)]
    assert 0 < len(set(listed)) < len(words) // 2


def test_packing_takes_merges_from_the_library(library, monkeypatch):
    monkeypatch.setattr(MergeAutomaton, "encode", None)
    c = codec(word_bpe(), LibraryCodec)
    rng = random.Random(7)
    alphabet = "aehotrn étöß'.,!?ÀİΣς\x1c 中😀½²_-\ń"
    for t in [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(3000))]:
        assert np.frombuffer(c.encode(t.encode()), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert not hasattr(c, "automaton")
