import pytest

import corpus_pipeline as cp
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_pipeline_near import brute_roots
from tests.llm.test_repeats import brute_covered


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows that each stage got and returned."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.union(docs.limit(3)).union(spark.createDataFrame(
        [(None, "a text without an id " * 20, "en", None, 9), (10**9, None, None, None, None), (10**9 + 1, "", "en", "src1", 0)], docs.schema))
    out = []
    for k, (_, f) in enumerate(cp.STAGES):
        got = f(spark, docs, sf)
        assert k == 4 or got.columns == docs.columns
        got.write.parquet(f"{folder}/{k}")
        got = spark.read.parquet(f"{folder}/{k}")
        out.append((docs.collect(), got.collect()))
        docs = got
    return out


def test_quality_keeps_clean_documents_and_drops_toxic_ones(stages, spark, sf):
    before, after = stages[0]
    kept = {r.doc_id for r in after}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0]
    bad = [r.doc_id for r in labels if r.quality == 0 or r.toxic == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
    assert sum(i in kept for i in bad) <= 0.4 * len(bad)  # 200 documents are few to learn from


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    root = brute_roots([(r.doc_id, r.text or "") for r in before if r.doc_id is not None], 5, 80)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in root if root[i] == i)
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)


def test_passages_are_cut(stages):
    before, after = stages[2]
    rows = [(r.doc_id, (r.text or "").encode()) for r in before if r.doc_id is not None]
    want = {}
    for (i, b), gone in zip(rows, brute_covered(rows, 50)):
        left = bytes(x for p, x in enumerate(b) if p not in gone)
        if left or not b:
            want[i] = left.decode("utf-8", "ignore")
    got = {r.doc_id: r.text or "" for r in after if r.doc_id is not None}
    assert got == want
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_contaminated_documents_go(stages, spark, sf):
    before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [i for i, *_, bad in brute_contamination([(r.doc_id, r.text) for r in before], items, 13) if not bad]
    assert sorted(map(str, (r.doc_id for r in after))) == sorted(map(str, want))


def test_mix_nears_its_targets(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    longest = max(r.size for r in after)
    for source in {r.source for r in after}:
        mine = [r for r in after if r.source == source]
        assert abs(sum(r.size for r in mine) - mine[0].target) <= 3 * longest
        assert max(r["copy"] for r in mine) <= 3
