import hashlib
import random
import re

import numpy as np

from quarry.llm import fill_middle as M


def brute(text, doc_id, seed=1, fim=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(rng):
    parts = ["word", "A", "é", "漢", "🙂", " ", "\n", "1", "<", "<P", "S>", "<M", ">", "\x00", "ß"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 90))) for _ in range(400)] + [
        "", "a", "é", "<P>", "x<M>y", "<S", "<" * 50, "a" * 9000, "🙂" * 4000, "".join(rng.choice("a é") for _ in range(30000))]


def test_lanes_reach_every_rank():
    rng = random.Random(1)
    for size in (1, 2, 8, 9, 700, 6000):
        text = "".join(rng.choice(["ab", " ", "é", "🙂", "c", "1"]) for _ in range(size))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        starts, n_points = M.unit_starts(text.encode())
        places = np.concatenate(([0], np.cumsum([len(u) for u in units])))
        assert n_points == len(text) and starts.tolist() == places[:-1].tolist()
        nodes = M.SkipList(starts, n_points)
        ranks = range(len(units) + 1) if size < 1000 else [0, 1, len(units), *rng.sample(range(len(units)), 300)]
        assert [nodes.place(r) for r in ranks] == [places[r] for r in ranks]
        for units_wide, points_wide, _ in nodes.lanes:
            assert units_wide.sum() == len(units) and points_wide.sum() == len(text)
    assert len(nodes.lanes) > 3


def test_texts_match_brute_force_and_come_back():
    forms = set()
    for k, text in enumerate(odd_texts(random.Random(2))):
        got = M.transform(text, k)
        assert got == brute(text, k)
        assert M.restore(got[4], got[1]) == text
        forms.add(got[1])
    assert forms == {"plain", "psm", "spm"}


def test_table(spark):
    rows = [(k, t, "x") for k, t in enumerate(odd_texts(random.Random(3)))] + [(None, "null id text", "x"), (7, None, "x"), (3, "twice it is", "x"), (3, "twice it is", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, FORM string").repartition(6)

    def digest(t):
        return hashlib.sha256(t.encode()).hexdigest()
    got = M.fill_middle(df, with_text=True)
    assert got.columns == ["doc_id", *M.OUT]
    have = sorted((str(r.doc_id), r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256, r.restored) for r in got.collect())
    assert have == sorted((str(i), *brute(t, i), digest(brute(t, i)[4]), digest(t or ""), t or "") for i, t, _ in rows)
    assert M.fill_middle(df.filter("false")).count() == 0
    assert M.fill_middle(df, fim_pct=0).filter("form <> 'plain'").count() == 0
