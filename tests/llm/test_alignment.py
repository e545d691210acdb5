"""Cross-tokenizer alignment against whole encodings, and the fragments' composition."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidemark.llm.alignment import Fragment, Pair, alignment_digests, cut, fragments, segments
from tidemark.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox's tail, 1,234 times.", "", None, "   two  spaces \n\n and\ttabs  ", " ", "日本語の文章です。한국어 текст", "a▁b keeps no bytes", "x" * 3000, "😀é́   　wide᠎ zero​",
    "word " * 900 + "end", "<|endoftext|> and <s> are plain", "ab\x00c\x1f d", "it's we'll 's 're", "\n", "漢字" * 700, "e" * 700 + " " * 700 + "!" * 700,
]


def brute(rows):
    """Digests by whole encodings."""
    pair, links, out = Pair(A, B), Counter(), []
    for i, text in rows:
        a = pair.a.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = pair.b.encode(text) if text else []
        whole = f" {text}".encode()
        if not text or b"".join(pair.bytes_a[x] for x in a) != whole or b"".join(pair.bytes_b[x] for x in b) != whole:
            out.append((i, 0, 0, [], ""))
            continue
        ends = [{sum(map(len, (table[y] for y in ids[: n + 1]))): n for n in range(len(ids))} for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b))] if len(text) < 400 else [_ends(ids, table) for ids, table in ((a, pair.bytes_a), (b, pair.bytes_b))]
        groups, found, p, q = [], [], 0, 0
        for e in sorted(ends[0].keys() & ends[1].keys()):
            n, m = ends[0][e] + 1, ends[1][e] + 1
            groups.append(f"{','.join(map(str, a[p:n]))}|{','.join(map(str, b[q:m]))}")
            found.append((a[n - 1], b[m - 1]))
            p, q = n, m
        links.update(found)
        out.append((i, len(a), len(b), found, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, y), n in links.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((i, a, b, len(f), len(f), sum(links[x] == best[x[1]] for x in f), sum(links[x] for x in f), h) for i, a, b, f, h in out)


def _ends(ids, table):
    out, at = {}, 0
    for n, i in enumerate(ids):
        at += len(table[i])
        out[at] = n
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 100])
def test_digests(spark, chunk):
    rng = random.Random(5)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join("".join(rng.choice("aetionsdé'-3") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 120)))) for i in range(40)]
    rows += [(0, TEXTS[0]), (None, TEXTS[5]), (None, TEXTS[5])]  # repeated rows and null ids stay apart
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("pair", F.lit("clash")).withColumn("n_a", F.lit(1)).repartition(3)
    got = alignment_digests(docs, A, B, chunk)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute(rows)


def test_empty(spark):
    assert alignment_digests(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_fragments_compose_in_any_order():
    rng = random.Random(3)
    for _ in range(60):
        size_a, size_b = [rng.randint(1, 5) for _ in range(9)], [rng.randint(1, 4) for _ in range(9)]
        a = [rng.randrange(9) for _ in range(rng.randint(1, 40))]
        b, total = [], sum(size_a[i] for i in a)
        while (left := total - sum(size_b[i] for i in b)) > 0:
            some = [i for i in range(9) if size_b[i] <= left] or None
            if some is None:
                break
            b.append(rng.choice(some))
        if left:
            continue
        (_, whole), = fragments(a, b, size_a, size_b, total)
        parts = [f for _, f in fragments(a, b, size_a, size_b, rng.randint(1, 7))]
        assert reduce(Fragment.then, parts) == whole
        assert reduce(lambda x, y: y.then(x), reversed(parts)) == whole
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].then(parts[i + 1])]
        assert parts == [whole] and whole.suffix_a == whole.suffix_b == "" and whole.groups.count("|") == whole.closed


def test_cuts_lose_nothing():
    for t in filter(None, TEXTS):
        assert " ".join(segments(t)) == t and " ".join(cut(t, 20)) == t
