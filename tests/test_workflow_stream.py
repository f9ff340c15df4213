import tempfile

from pyspark.sql import functions as F

from quarry.plans import workflow
from quarry.streaming.score import score_stream

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def test_train_and_score_regression(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    roles = workflow.Roles(indicators=["l_quantity", "l_discount", "l_tax"], targets=["l_extendedprice"], key=KEYS,
                           categoricals=["l_returnflag"])
    run = workflow.train(li, roles, workflow.TrainConfig(model="Ridge", outlier_method="IQR",
                                                         select_method="SelectKBest", select_k=3))
    m = {r["split"]: r for r in run.metrics.collect()}
    assert set(m) == {"train", "test"}
    scored = workflow.score(run, li.limit(50))
    assert "Predicted_Target" in scored.columns and scored.where(F.col("Predicted_Target").isNull()).count() == 0


def test_train_classification(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    roles = workflow.Roles(indicators=["l_quantity", "l_discount", "l_tax", "l_extendedprice"],
                           targets=["l_returnflag"], key=KEYS)
    run = workflow.train(li, roles, workflow.TrainConfig(model="LDA_classifier", stratify=True))
    r = run.metrics.first()
    assert 0 <= r["accuracy"] <= 1


def test_streaming_scoring(spark, sf):
    from quarry.operators import linear
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    model = linear.fit(li, ["l_quantity"], "l_extendedprice")
    src = tempfile.mkdtemp(prefix="quarry-stream-", dir="/tmp") + "/in"
    li.write.parquet(src)  # a streaming file source reads a directory
    stream = spark.readStream.schema(li.schema).parquet(src)
    q = score_stream(model, stream, None, tempfile.mkdtemp(dir="/tmp"), "scored_test", fmt="memory")
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored_test").count() == li.count()


def test_save_and_load_models(spark, sf):
    from quarry.operators import bayes, linear
    from quarry.plans import models
    from quarry.sources.sinks import load_model, save_model
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    d = tempfile.mkdtemp(dir="/tmp")
    for name, m in (("lin", linear.fit(li, ["l_quantity"], "l_extendedprice")),
                    ("nb", bayes.fit_gaussian_nb(li, ["l_quantity", "l_tax"], "l_returnflag")),
                    ("tree", models.make("DecisionTree").fit(li, ["l_quantity", "l_tax"], "l_extendedprice"))):
        save_model(spark, m, f"{d}/{name}")
        back = load_model(spark, f"{d}/{name}")
        a = [r["prediction"] for r in m.transform(li.limit(20)).collect()]
        b = [r["prediction"] for r in back.transform(li.limit(20)).collect()]
        assert a == b


def test_cluster_run(spark, sf):
    emb = spark.read.parquet(f"{sf}/embeddings.parquet")
    from quarry.operators.neighbors import vector_columns
    e, feats = vector_columns(emb, "embedding", 8)
    run = workflow.train_cluster(e.drop("embedding"), feats, ["vec_id"], "kmeans", k=3, scan=range(2, 4))
    assert run.k in (2, 3)
    r = run.scores.first()
    assert r["n_clusters"] == run.k and r["calinski_harabasz"] > 0
    assert run.sizes.agg(F.sum("size")).first()[0] == emb.count()


def test_both_runs_share_one_split_and_leave_no_cache(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    roles = workflow.Roles(["l_quantity", "l_discount"], ["l_extendedprice"], ["l_orderkey", "l_linenumber"])
    cfg = workflow.TrainConfig(outlier_method="IQR")
    want = {}
    for name, one in (("baseline", workflow.TrainConfig()), ("advanced", cfg)):
        run = workflow.train(df, roles, one)
        want.update({(name, r["split"]): r for r in run.metrics.collect()})
        run.predictions.unpersist()
    calls, cached = [], spark.sparkContext._jsc.getPersistentRDDs().size()
    whole = workflow.split.train_test_split
    monkeypatch.setattr(workflow.split, "train_test_split", lambda *a, **k: calls.append(1) or whole(*a, **k))
    got = workflow.baseline_vs_advanced(df, roles, cfg).collect()
    assert len(calls) == 1
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert len(got) == len(want) == 4
    for r in got:
        for c, v in want[r["run"], r["split"]].asDict().items():
            assert abs(r[c] - v) <= 1e-9 * abs(v) if isinstance(v, float) else r[c] == v
