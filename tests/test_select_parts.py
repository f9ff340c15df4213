import pytest

from quarry.operators import select


@pytest.mark.parametrize("run", [lambda d: select.select_from_model(d, ["a", "b"], "y", n_trees=3),
                                 lambda d: select.rfe(d, ["a", "b"], "y", 1, n_trees=3)])
def test_forests_read_parts_of_bounded_rows(spark, monkeypatch, run):
    monkeypatch.setattr(select, "ROWS_PER_TASK", 100, raising=False)
    rows = spark.range(0, 950, 1, 1).selectExpr("id", "cast(id % 37 as double) a", "cast(id % 5 as double) b", "cast(3 * (id % 37) as double) y")
    parts, plain = [], select._forest_importances
    monkeypatch.setattr(select, "_forest_importances", lambda d, *a: parts.append((sorted(d.columns), d.rdd.glom().map(len).collect())) or plain(d, *a))
    got = {r["feature"]: r["selected"] for r in run(rows).collect()}
    assert got == {"a": True, "b": False}
    for columns, sizes in parts:
        assert columns == ["a", "b", "y"] and sum(sizes) == 950 and max(sizes) <= 150
