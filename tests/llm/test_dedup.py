"""MinHash near-dedup and substring dedup against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import _common, minhash, substring
from tidemark.llm.shingles import shingle_sets
from tidemark.operators.components import connected_components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = {i: {j for j in sets if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])} for i in sets}
    out = {}
    for i in sets:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(sets[i]), min(seen), min(seen) == i)
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(30, 300))]
        family = [base]
        for _ in range(12):
            copy = list(rng.choice(family))
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = word()
            family.append(copy)
        texts += [" ".join(f) for f in family]
    texts += ["", None, " \n ", "One two", "one TWO", "one two three", texts[0].upper(), texts[0] + " ", "a b c d e", "A B C D E"]
    return list(enumerate(texts))


def test_shingle_hashes():
    rows = corpus()
    texts = [(t or "").encode() for _, t in rows]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for _, t in rows]


@pytest.mark.parametrize("block, shingles_", [(512, 1 << 19), (7, 1 << 19), (7, 900)])
def test_near_duplicates(spark, monkeypatch, block, shingles_):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHINGLES", shingles_)
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicate_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("least", [0, 32])
def test_links_of_what_hubs_leave_apart(monkeypatch, least):
    rows = corpus(9)
    sets = dict(zip([i for i, _ in rows], shingle_sets([(t or "").encode() for _, t in rows])))
    members = np.array([i for i in sets if len(sets[i])])
    near = np.zeros((len(members), 4), np.uint64)  # all signatures alike: full sets decide
    links, component = minhash.links_of(np.arange(len(members)), members, members, [sets[i] for i in members], near, 75)
    true = {i: c for i, (_, c, _) in brute(rows).items() if i in sets and len(sets[i])}
    assert dict(zip(members.tolist(), component.tolist())) == true
    assert len(links) == len(members) - len(set(true.values()))


def test_rounds_of_components_are_tables_of_known_size(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(a, b) for a, b in ((rng.randrange(90), rng.randrange(90)) for _ in range(70))] + [(i, i + 1) for i in range(100, 140)] + [(5, 5), (None, 3)]
    edges = spark.createDataFrame(rows, "u long, v long")
    monkeypatch.setattr(type(edges), "checkpoint", None)  # its rows' size isn't known: nothing is broadcast, jobs run twice
    root = {x: x for r in rows for x in r}
    for _ in rows:
        for a, b in rows:
            if a is not None and a != b:
                root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in rows if a is not None and a != b for x in (a, b)}
    found = connected_components(edges).collect()
    assert sorted(map(tuple, found)) == sorted((x, root[x]) for x in linked)


def test_near_duplicate_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(3, text, 1, 2), (2, text + " end", 1, 2), (2, text[:9], 1, 2), (7, "x" * 500_000 + " " + long, 1, 2), (8, "x" * 500_000 + " " + long + " y", 1, 2), (9, None, 1, 2)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string, hub int, key int")).collect()}
    assert {(d, c) for d, _, c in got} == {(3, 3), (2, 2), (7, 7), (8, 7), (9, 9)}  # of the rows of id 2 the least text counts


def test_empty_and_null_ids(spark):
    assert minhash.near_duplicate_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    r = minhash.near_duplicate_documents(spark.createDataFrame([(None, "a b c d e f")], SCHEMA)).first()
    assert r["component_id"] is None and r["n_shingles"] == 2
    assert substring.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_fenwick_chain_is_the_best_chain():
    rng = random.Random(1)
    for _ in range(50):
        pairs = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(12)})
        d, h = (np.array(x) for x in zip(*pairs))
        best = {}
        for i in range(len(pairs)):
            before = [best[j] - substring.GAP_COST * (d[i] - d[j] + h[i] - h[j]) for j in range(i) if d[j] < d[i] and h[j] < h[i]]
            best[i] = substring.GAIN + max([0, *before])
        path = substring.chains(d, h)[0]
        got = sum(substring.GAIN for _ in path) - sum(substring.GAP_COST * (d[b] - d[a] + h[b] - h[a]) for a, b in zip(path, path[1:]))
        assert got == pytest.approx(max(best.values()))


def passages(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    shared, fuzzy = some(70), some(90)
    changed = list(fuzzy)
    for i in range(7, 90, 11):
        changed[i] = word()
    docs = [some(100) + shared + some(50), some(20) + shared, some(40) + fuzzy + some(30), changed + some(60), some(200), some(60) + shared[:30]]
    return [(i, "é " + " ".join(d)) for i, d in enumerate(docs)], " ".join(shared), " ".join(changed)


def test_passages(spark):
    rows, shared, changed = passages()
    docs = spark.createDataFrame([*rows, (90, None), (91, "")], SCHEMA)
    found = {r["doc_id"]: r for r in substring.repeated_passages(docs).collect()}
    assert set(found) == {1, 3}
    text = dict(rows)
    assert text[1][found[1]["start"] : found[1]["end"]] == shared and text[0][found[1]["other_start"] : found[1]["other_end"]] == shared
    assert found[3]["other_id"] == 2 and found[3]["n_words"] >= 80 and found[3]["n_same"] >= 0.75 * found[3]["n_words"]
    left = {r["doc_id"]: r["text"] for r in substring.without_repeats(docs).collect()}
    assert shared not in left[1] and shared in left[0] and left[4] == text[4] and left[90] is None and len(left) == 8


def test_passage_whose_parts_occur_first_elsewhere(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    for n in (50, 51, 60, 90):
        shared = some(n)
        # Every 45 words occur earlier, each in a document of its own, so only runs of more lead to document 400.
        parts = [(i, some(3) + shared[i : i + 45] + some(3)) for i in range(0, n - 44)]
        # The second half occurs earlier in the holder, too.
        rows = [*parts, (400, some(20) + shared[-30:] + some(80) + shared + some(9)), (500, some(30) + shared + some(30))]
        docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)
        found = [r for r in substring.repeated_passages(docs).where("doc_id = 500").collect() if r["other_id"] == 400]
        assert any(rows[-1][1][30 : 30 + n] == " ".join(rows[-1][1])[r["start"] : r["end"]].split() for r in found), n


@pytest.mark.parametrize("together", [1, 16])
def test_fuzzy_passage_whose_seeds_occur_first_elsewhere(spark, monkeypatch, together):
    monkeypatch.setattr(substring, "TOGETHER", together)  # 1: all chains are lengthened
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    base = [some(10) for _ in range(7)]
    # Each ten words occur first in a document of their own; only 400 and 500 have them all, with other words between.
    rows = [(i, some(30) + b + some(30)) for i, b in enumerate(base)]
    rows += [(i, some(20) + sum((b + some(2) for b in base), []) + some(20)) for i in (400, 500)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA).coalesce(1)
    found = [r for r in substring.repeated_passages(docs).collect() if r["doc_id"] == 500]
    assert [(r["other_id"], r["n_same"]) for r in found] == [(400, 70)] and found[0]["n_words"] >= 82


def test_repeated_lines_are_one_row_a_chain(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    line, n = some(9), []
    rows = [(i, sum((line + some(6) for _ in range(12)), [])) for i in range(18)]
    write = substring.written

    def counted(df):
        out = write(df)
        n.append(out.count())
        return out

    monkeypatch.setattr(substring, "written", counted)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], SCHEMA)
    assert substring.repeated_passages(docs).collect() == []  # 9 of 15 words are equal
    assert max(n) < 6_000


@pytest.mark.parametrize("percent, least", [(75, 0.75), (80, 0.85), (90, 0.97)])
def test_recall_of_fuzzy_passages(spark, percent, least):
    rng = random.Random(percent)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    rows, true = [], {}
    for k in range(200):
        n = rng.randrange(50, 101)
        base, before = some(n), some(rng.randrange(30, 80))
        new = list(base)
        for i in rng.sample(range(n), n * (100 - percent) // 100):
            new[i] = word()
        rows += [(2 * k, " ".join(some(60) + base + some(40))), (2 * k + 1, " ".join(before + new + some(40)))]
        # Words in one place are aligned with no gap, so the best alignment runs from the first equal word to the last.
        same = [i for i in range(n) if base[i] == new[i]]
        if same[-1] - same[0] >= 49 and 100 * len(same) >= 75 * (same[-1] - same[0] + 1):
            at = len(" ".join(before)) + 1
            true[2 * k + 1] = (at, at + len(" ".join(new)))
    found = set()
    for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect():
        at, end = true.get(r["doc_id"], (0, 0))
        if r["other_id"] == r["doc_id"] - 1 and 2 * (min(end, r["end"]) - max(at, r["start"])) >= end - at:
            found.add(r["doc_id"])
    print(f"recall at {percent} %: {len(found)} of {len(true)}")
    assert len(true) > 150 and len(found) >= least * len(true)


@pytest.mark.parametrize("seed, common", [(1, 200), (2, 1), (3, 200)])
def test_every_run_of_50_words_is_found(spark, monkeypatch, seed, common):
    monkeypatch.setattr(substring, "SAMPLE", 1)
    monkeypatch.setattr(substring, "COMMON", common)  # 1: only what each document holds is dealt out as runs
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    parts = [[word() for _ in range(rng.randrange(20, 140))] for _ in range(25)]
    everywhere = [word() for _ in range(60)]
    docs = []
    for i in range(60):
        d = [word() for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(parts)
            a = rng.randrange(len(p) // 2)
            d += p[a : a + rng.randrange(15, 140)] + [word() for _ in range(rng.randrange(1, 40))]
        docs.append(d + everywhere if seed == 2 or i % 3 == 0 else d)
    rows = [(7 * i, " ".join(d)) for i, d in enumerate(docs)] + [(7 * 3, " ".join(docs[3]))]
    found = {}
    for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        assert r["other_id"] <= r["doc_id"] and 100 * r["n_same"] >= 75 * r["n_words"]
        found.setdefault(r["doc_id"], []).append((r["start"], r["end"]))
    first = {}
    missed = 0
    for i, d in enumerate(docs):
        begin = np.cumsum([0, *(len(w) + 1 for w in d)])
        for a in range(len(d) - 49):
            run = tuple(d[a : a + 50])
            j, b = first.setdefault(run, (i, a))
            if j < i or a - b >= 50:
                missed += not any(s <= begin[a] and e >= begin[a + 50] - 1 for s, e in found.get(7 * i, []))
    assert not missed


def test_substring_edges(spark):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(70))
    rows = [(1, "x", text, 5), (2, "y", "z " + text, 5), (2, "y", text[:40], 5), (3, "z", None, None), (None, "n", text, 1), (4, "p", "same old words here " * 80, 2), (5, "q", "w" * 300_000 + " " + text, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, other_id string, text string, start int")
    found = {(r["doc_id"], r["other_id"], r["start"], r["end"]) for r in substring.repeated_passages(docs.where("doc_id <> 4 or doc_id is null")).collect()}
    assert found == {(5, 1, 300_001, 300_001 + len(text))}  # of the rows of id 2 the least counts, which is short
    # Few words over and over: what is listed of them does lie 50 words apart.
    again = substring.repeated_passages(docs.where("doc_id = 4")).collect()
    assert all(r["start"] - r["other_start"] >= 50 * 4 for r in again)
    left = {(r["doc_id"], r["other_id"], r["text"], r["start"]) for r in substring.without_repeats(docs).collect()}
    assert {x for x in left if x[0] != 4} == {(a, b, "w" * 300_000 + " " if a == 5 else c, d) for a, b, c, d in rows if a != 4}
    assert substring.without_repeats(docs.limit(0)).columns == docs.columns


def test_own_passages_are_not_linked_with_their_own_place(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    line = some(20)  # twice, apart: short of a passage, so all k-mers of the text are looked at
    rows = [(i, " ".join(line[:15] + some(90 + i) + line + some(30) + line[:12])) for i in range(8)]
    found = substring.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r for r in found if r["doc_id"] == r["other_id"]] == []


def test_chains_of_a_pair_are_one_row(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    some = lambda n: [word() for _ in range(n)]
    parts = [some(70) for _ in range(6)]
    rows = [(i, " ".join(w for p in parts for w in p + some(120))) for i in range(2)]
    write, n = substring.written, []

    def counted(df):
        out = write(df)
        n.extend([out.where("other_id = 0").count()] if "d" in out.columns else [])
        return out

    monkeypatch.setattr(substring, "written", counted)
    assert substring.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 6
    assert n[0] == 1  # its texts are shuffled and read once


def test_alike_places_nearest_to_the_line():
    rng = random.Random(6)
    for k in range(60):
        a, b = ([rng.choice("abc") for _ in range(80)] for _ in range(2))
        x, y = substring._Words(" ".join(a)), substring._Words(" ".join(b))
        at, to = np.array([10, 40]), np.array([5 + k % 30, 60])
        got = dict(zip(*(c.tolist() for c in substring.every_match(x, y, at, to))))
        for i, j in got.items():
            line = np.interp(i, at, to) + min(i - 10, 0) + max(i - 40, 0)
            alike = [n for n in range(76) if b[n : n + 5] == a[i : i + 5]]
            assert j == min(alike, key=lambda n: (abs(n - line), n))


def test_packed_columns_come_back():
    rng = np.random.default_rng(3)
    for x in (np.zeros(0, np.int64), np.array([-1, 2**62, -(2**63)]), rng.integers(-(2**63), 2**63 - 1, 1000)):
        assert (substring._unpacked(substring._packed(x), len(x)) == x).all()


def test_batches_are_gathered_whole():
    batches = [pa.record_batch([pa.array([i] * n), pa.array(["x" * 100] * n)], names=["i", "t"]) for i, n in enumerate([3, 0, 5, 400, 1])]
    got = list(_common.gathered(iter(batches), 1500))
    assert [r for b in got for r in b.column(0).to_pylist()] == [r for b in batches for r in b.column(0).to_pylist()]
    assert len(got) == 3 and list(_common.gathered(iter([]), 10)) == []


@pytest.mark.parametrize("tasks", [minhash.signatures, lambda docs: substring.occurrences(docs, np.zeros(0, np.int64), 4)])
def test_tasks_give_up_what_workers_kept(monkeypatch, tasks):
    class Docs:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    given = []
    plain = _common.make_room
    monkeypatch.setattr(_common, "make_room", lambda forget=False: given.append(forget) or plain(forget))
    _common.kept("codecs")["some"] = object()
    words = " ".join(f"w{i}" for i in range(80))
    batch = pa.record_batch([pa.array([1, 2]), pa.array([words, words])], names=["doc_id", "text"])
    out = list(tasks(Docs())(iter([batch])))
    assert sum(b.num_rows for b in out) >= 2
    assert not _common.kept("codecs") and given == [True, False]
