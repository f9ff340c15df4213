import hashlib
import random
import re

import pytest

from quarry.llm.decontaminate import contamination


def brute(docs, items, window):
    def words(t):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    pats = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            pats.setdefault(tuple(w[k:k + n]), set()).add("" if i is None else str(i))
    sizes = {len(p) for p in pats}
    out = []
    for i, t in docs:
        w, hit, got = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in pats:
                    hit.update(range(k, k + n))
                    got |= pats[tuple(w[k:k + n])]
        ids = ",".join(sorted(got))
        out.append((i, len(w), len(hit), len(got), hashlib.sha256(ids.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("pattern_bytes", [3 << 20, 2000])
def test_matches_brute_force(spark, pattern_bytes):
    rng = random.Random(5)
    vocab = ["Alpha", "beta", "été", "x1", "42", "ÜBER", "end"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 13, 14, 30])))) for k in range(12)]
    items += [(None, "quite another text"), (3, "same id twice here"), (99, None), (98, "?! --")]
    docs = []
    for k in range(40):
        w = [rng.choice(vocab + ["fill", "word"]) for _ in range(rng.choice([0, 2, 20, 200]))]
        if k % 3 == 0:
            w[3:3] = items[rng.randrange(14)][1].split()
        docs.append((k, rng.choice([" ", "\n", ", ", "—"]).join(w)))
    docs += [(None, "quite another text"), (50, None), (51, ""), docs[0]]
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, N_WORDS string")
    got = contamination(df, spark.createDataFrame(items, "item_id long, text string"), pattern_bytes=pattern_bytes).collect()
    have = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]
    assert sorted(have, key=repr) == sorted(brute(docs, items, 13), key=repr)
    assert contamination(df.filter("false"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_offsets_point_into_the_original(spark):
    items = spark.createDataFrame([(1, "Où est-ce que tu vas")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Dit-il: « OÙ est ce  que… où EST, ce que TU vas?» oui")], "doc_id long, text string")
    row = contamination(docs, items).first()
    assert [row.text[s.start:s.end] for s in row.hit_spans] == ["où EST, ce que TU vas"]
    assert row["items"] == ["1"]
