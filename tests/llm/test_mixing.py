import pytest

from quarry.llm.mixing import emit, mix, source_targets


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: cap * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100, None: 100},
    {"a": 1, "b": 2, "c": 900, "d": 3, "e": 40, None: 0},
    {"zz": 10, "é": 1000, "A": 1, "a": 7, "b": 0},
    {"only": 5},
])
def test_targets_match_repeated_sharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_words_taken_near_targets_and_reruns_agree(spark):
    rows = [(k, "w " * (1 + (k * 7919) % 90), f"s{k % 4}" if k % 5 else None, "x") for k in range(800)]
    rows += [(None, None, None, "x"), (None, "a b", "s1", "x"), (3, "", "empty", "x"), rows[7], rows[7]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Size string")
    m = mix(df).collect()
    assert len(m) == len(rows)
    by = {}
    for r in m:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        taken = sum(r.copies * r["size"] for r in rs)
        assert abs(taken - rs[0].target) <= 90
        assert all(r.copies <= 3 for r in rs)
        assert rs[0].source_size == sum(r["size"] for r in rs)
    key = lambda rs: sorted((str(r.doc_id), r["size"], r.copies) for r in rs)
    assert key(m) == key(mix(df.repartition(7), slice_digits=1).collect())
    assert emit(mix(df)).count() == sum(r.copies for r in m)
    assert mix(df.filter("false")).count() == 0
