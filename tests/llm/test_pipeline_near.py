import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from quarry.llm import jaccard, rare_prefix
from quarry.llm.jaccard import jaccard_groups


def brute_roots(rows, n, pct):
    sets = {}
    for i, t in rows:
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t)
        w = re.findall(r"[^\x20\x09-\x0D]+", w)
        sets[i] = {tuple(w[k:k + n]) for k in range(max(len(w) - n + 1, 0))} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def planted(seed=3):
    """Texts with a few words changed, replaced in one stretch or added at the end."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    rows = []
    for size in (9, 30, 100, 100, 240, 600):
        base = words(size)
        rows.append(base)
        for changed in (1, 2, 3, 4):
            w = list(base)
            for k in rng.sample(range(size), changed):
                w[k] = words(1)[0]
            rows.append(w)
        for pct in (5, 8, 11, 20, 30):
            cut = max(1, size * pct // 100)
            rows += [base[:-cut] + words(cut), base + words(cut)]
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_stage_joins_five_words_at_four_fifths(spark, sf):
    rows = planted()
    want, thin = brute_roots(rows, 5, 80), brute_roots(rows, 3, 90)
    assert {i for i in want if want[i] == i} < {i for i in thin if thin[i] == i}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_copies_stage(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i in want if want[i] == i)
    assert {r.doc_id: r.component_id for r in jaccard_groups(docs).collect()} == thin


def crowded(seed):
    """Texts with common phrases, copies, chains of small changes, short texts and repeated ids."""
    rng = random.Random(seed)
    words = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    common = [words(20) for _ in range(3)]
    bases = [words(rng.choice([4, 5, 6, 12, 40, 150])) for _ in range(12)]
    texts = []
    for _ in range(170):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 1)] = words(1)
        if rng.random() < 0.5:
            w += rng.choice(common)
        texts.append(" ".join(w))
    return [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[3]) for i in range(15)] + [(700, ""), (701, "a b"), (702, "a b")]


@pytest.mark.parametrize("seed", range(3))
def test_rare_prefixes_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(rare_prefix, "BUCKET_ROWS", 2000)
    monkeypatch.setattr(rare_prefix, "OFTEN", 3)
    monkeypatch.setattr(rare_prefix, "LEAST", 8)
    rows = crowded(seed)
    want = brute_roots(rows, 5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard_groups(df, 5, 80).collect()}
    assert got == {**want, 700: 700}
    # rows of one id are one document: each of its texts links it
    again = df.union(spark.createDataFrame([(0, rows[60][1]), (0, rows[90][1]), (1, rows[1][1])], df.schema))
    assert rare_prefix.needed(80) and not rare_prefix.needed(90)
    near = {r.doc_id: r.component_id for r in jaccard_groups(again, 5, 80).collect()}
    join = {want[0], want[60], want[90]}
    assert near == {i: min(join) if want[i] in join else want[i] for i in want}
    none = df.filter("false")
    assert jaccard_groups(none, 5, 80).count() == 0


def test_packed_arrays_come_back():
    rng = random.Random(0)
    a, b = (np.array([rng.randrange(2**64) for _ in range(50)], np.uint64) for _ in range(2))
    got = rare_prefix.unpack([rare_prefix.pack(a, b), rare_prefix.pack(a[:3], b[:3])], 2)
    assert (got[0] == np.concatenate((a, a[:3]))).all() and (got[1] == np.concatenate((b, b[:3]))).all()


@pytest.mark.parametrize("least", [1, 2, 3])
def test_large_groups_of_tiny_sets_meet(spark, monkeypatch, least):
    monkeypatch.setattr(jaccard, "TILE", 8)
    size = {i: least + i % 7 for i in range(60)}
    nodes = spark.createDataFrame([(i, n, 0) for i, n in size.items()], "node long, n_shingles long, root long")
    tiles = {}
    for r in jaccard._tiles(nodes, 80).collect():
        tiles.setdefault(r.tile, {0: set(), 1: set()})[r.side].add(r.node)
    met = {(a, b) for t in tiles.values() for a in t[0] | t[1] for b in t[0] | t[1]
           if not (t[0] and t[1]) or (a in t[0]) != (b in t[0])}
    assert all((a, b) in met for a in size for b in size if a != b and 80 * size[a] <= 100 * size[b] <= 125 * size[a])


def test_one_document_of_each_set_is_dealt(spark, monkeypatch):
    dealt = []
    real = rare_prefix.prefix_keys

    def seen(raw, *args):
        dealt.append(sorted(r.doc_id for r in raw.collect()))
        return real(raw, *args)
    monkeypatch.setattr(rare_prefix, "prefix_keys", seen)
    rows = planted()
    want = brute_roots(rows, 5, 80)
    copies = [(i + k * 1000, t) for k in (1, 2) for i, t in rows]
    # 1005 also has a text of its own: all its rows are dealt
    df = spark.createDataFrame(rows + copies + [(1005, "a text that no other document of the table has at all")], "doc_id long, text string")
    for most in (jaccard.BROADCAST_ROWS, 0):
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", most)
        got = jaccard_groups(df.repartition(6), n=5, pct=80).collect()
        assert {r.doc_id: r.component_id for r in got if r.doc_id < 1000} == want
        assert {r.doc_id: r.component_id for r in got if r.doc_id >= 2000} == {i + 2000: c for i, c in want.items()}
    assert dealt == [sorted([*want, 1005, 1005])] * 2
