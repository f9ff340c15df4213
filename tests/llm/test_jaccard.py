import random
import re

import pyarrow as pa
import pytest

from quarry.llm import jaccard
from quarry.llm.jaccard import jaccard_groups
from quarry.llm.links import components


def brute_sets(rows):
    out = {}
    for i, t in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(w[k:k + 3]) for k in range(max(len(w) - 2, 0))} or ({tuple(w)} if w else set())
    return out


def brute_components(sets):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 90 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def planted(seed, n=160):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÉ") for _ in range(rng.randint(1, 6)))
    rows = [(1000, None), (1001, "  \t"), (1002, "One"), (1003, "one"), (1004, "a b"), (1005, "A\nb"), (1006, "x " * 50), (1007, "x x x")]
    bases = [[word() for _ in range(rng.choice([5, 11, 12, 25, 60, 130, 400]))] for _ in range(14)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            k = rng.randrange(len(w))
            w[k:k + rng.randint(0, 1)] = [word()]
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(5))
def test_linked_sets_share_a_key(seed):
    rows = planted(seed)
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                        pa.array([(r[1] or "").encode() for r in rows], pa.binary())], ["doc_id", "data"])
    keys = {}
    for _, part, b, e in jaccard.slices(batch.column("data")):
        who, h = jaccard.shingles(part, b, e)
        row, key = jaccard.tile_keys(who, h, len(b), jaccard.bands(), 90)
        for r, k in zip(row, key):
            keys.setdefault(rows[r][0], set()).add(int(k))
    sets = brute_sets(rows)
    for a in sets:
        for b in sets:
            if a < b and sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * max(1, len(sets[a] | sets[b])):
                assert keys[a] & keys[b], (a, b)


@pytest.mark.parametrize("tile", [512, 8])
def test_groups_match_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = planted(11)
    sets = brute_sets(rows)
    want = {i: (len(sets[i]), c) for i, c in brute_components(sets).items()}
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, rows[0][1] or "q", 1), rows[3] + (2,)],
                               "doc_id long, text string, Component_ID int")
    got = jaccard_groups(df).collect()
    assert len(got) == len(rows) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_groups(df.filter("false")).count() == 0


def test_components_of_long_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(3, 3), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{k: 100 for k in range(101, 161)}, **{k: 7 for k in range(200, 260)}, 301: 300}
