import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import repeats
from quarry.llm.suffix import common_prefixes, suffix_order
from quarry.llm.suffix_dedup import dedup


def brute_covered(rows, window, smaller=True):
    """rows: (id, bytes). Per row the set of covered bytes."""
    holders = {}
    for i, b in rows:
        for p in range(len(b) - window + 1):
            holders.setdefault(b[p:p + window], set()).add(i)
    out = []
    for i, b in rows:
        gone = set()
        for p in range(len(b) - window + 1):
            have = holders[b[p:p + window]]
            if (min(have) < i) if smaller else len(have) > 1:
                gone.update(range(p, p + window))
        out.append(gone)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffix_order_matches_sorting(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 2 + seed, 3000).astype(np.uint8) * np.uint8([1, 100, 255, 3, 7, 9][seed] // max(1, 1 + seed))
    text[500:700] = text[:200]
    text[1000:1400] = 0
    depth = 50
    wanted = np.zeros(len(text), bool)
    wanted[: len(text) - depth] = rng.random(len(text) - depth) < 0.7
    order = suffix_order(text, wanted, depth)
    raw = text.tobytes()
    assert sorted(order.tolist()) == np.flatnonzero(wanted).tolist()
    cut = [raw[p:p + depth] for p in order]
    assert cut == sorted(cut)
    same = [a == b for a, b in zip(cut, cut[1:])]
    assert (common_prefixes(text, order, depth) >= depth).tolist() == same


def local(rows, window, gram, smaller, n_buckets, groups=None):
    """The blocks and buckets of a job, without Spark."""
    ids = pa.array([r[0] for r in rows], pa.int64())
    table = pa.RecordBatch.from_arrays(
        [ids, pa.array([r[1] for r in rows], pa.binary()), pa.array(groups or [0] * len(rows), pa.int64()),
         pa.array(range(len(rows)), pa.int64())], ["id", "data", "grp", "tag"])
    half = len(rows) // 2
    out = [b for part in (table.slice(0, half), table.slice(half)) for b in repeats.scan([part], window, gram, n_buckets, smaller)]
    spans = [[] for _ in rows]
    if out:
        whole = pa.Table.from_batches(out)
        for k in set(whole.column("bucket").to_pylist()):
            mask = pa.array(np.array(whole.column("bucket").to_pylist()) == k)
            got = repeats.match_bucket(whole.filter(mask), window, gram, smaller)
            for tag, blob in zip(got.column("tag").to_pylist(), got.column("span").to_pylist()):
                spans[tag].append(blob)
    gone = []
    for blobs in spans:
        s, e = repeats.unpack(blobs)
        gone.append({p for a, b in zip(s, e) for p in range(a, b)})
    return gone


def planted(rng, n, letters, window):
    base = "".join(rng.choice(letters) for _ in range(400))
    rows = []
    for i in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, window - 1, window, 90, 300])))
        a = rng.randrange(300)
        t += base[a:a + rng.randrange(120)] + "".join(rng.choice(letters) for _ in range(rng.randrange(40)))
        if rng.random() < 0.2 and rows:
            t = rng.choice(rows)[1].decode()
        if rng.random() < 0.1:
            t += "a" * 200
        rows.append((i, t.encode()))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_blocks_and_buckets_match_brute_force(seed):
    rng = random.Random(seed)
    window, gram = rng.choice([(50, 16), (12, 5), (20, 8), (9, 9)])
    rows = planted(rng, 40, rng.choice(["ab", "abcdefgh", "ab\xe9ü "]), window)
    for smaller in (True, False):
        assert local(rows, window, gram, smaller, rng.choice([1, 3])) == brute_covered(rows, window, smaller)


def test_groups_do_not_match_each_other():
    t = b"the same long passage stands on pages of two different hosts, word for word"
    rows = [(1, t), (2, t), (3, t)]
    gone = local(rows, 30, 10, False, 2, groups=[7, 7, 8])
    assert [len(g) for g in gone] == [len(t), len(t), 0]


def test_dedup_on_spark(spark):
    rng = random.Random(3)
    rows = [(i, b.decode()) for i, b in planted(rng, 60, "abcdefghij é", 50)]
    rows += [(None, rows[0][1]), (500, None), (501, ""), (7, "short"), (7, "x" * 60), rows[5]]
    df = spark.createDataFrame([(i, t, "extra", 5) for i, t in rows], "doc_id long, text string, N_Bytes string, n_chars long")
    got = dedup(df, with_text=True)
    assert [c for c in got.columns if c.lower() == "n_bytes"] == ["n_bytes"]
    known = [(i, (t or "").encode()) for i, t in rows if i is not None]
    gone = brute_covered(known, 50)
    want = []
    for (_, b), g in zip(known, gone):
        left = bytes(x for p, x in enumerate(b) if p not in g)
        n = sum(1 for p in g if p - 1 not in g)
        want.append((len(b), len(g), n, hashlib.sha256(left).hexdigest()))
    want = sorted([(i, *w) for (i, _), w in zip(known, want)], key=repr)
    have = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()]
    assert sorted([h for h in have if h[0] is not None], key=repr) == want
    assert [h[2] for h in have if h[0] is None] == [0]
    assert dedup(df.filter("false")).count() == 0


def test_sides_of_anchors_drop_only_runs_without_a_match():
    rng = random.Random(8)
    window, gram = 50, 12
    anchor = bytes(rng.randrange(97, 123) for _ in range(gram))
    pad = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    common = pad(88)
    runs, where = [], []
    for k in range(60):
        before, after = pad(rng.randrange(0, 39)), pad(38)
        if k % 3 == 0:  # a string of another run, at a random place around the anchor
            b = rng.randrange(0, 39)
            before, after = pad(rng.randrange(0, 3)) + common[:b], common[b:38] + pad(rng.randrange(0, 9))
            before = before[-38:]
        runs.append(before + anchor + after)
        where.append(len(before))
    text = np.frombuffer(b"".join(runs) + bytes(16), np.uint8)
    length = np.array([len(r) for r in runs])
    begin = np.cumsum(length) - length
    keep = repeats.shared_sides(text, begin, length, begin + np.array(where), np.full(60, 5, np.uint64), np.arange(60), window, gram)
    strings = [{r[i:i + window] for i in range(len(r) - window + 1) if i <= w <= i + window - gram} for r, w in zip(runs, where)]
    for k in range(60):
        if any(strings[k] & strings[j] for j in range(60) if j != k):
            assert keep[k]
    assert keep.sum() < 40
