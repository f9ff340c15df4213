import math

import duckdb

import __spark_entry__ as entry_mod

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
FAST = ["s4_profile_lineitem", "a1_describe_lineitem", "a5_pearson_lineitem_nulls", "b9_split_lineitem",
        "b12_stratified_kfold_lineitem", "p8_replace_patterns_lineitem", "f3_standard_scale_lineitem",
        "o7_outlier_info_lineitem", "r1_ols_lineitem", "e5_classification_summary_nb_lineitem",
        "e17_cluster_scores_embeddings", "b7_label_order_mixed"]


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert {r["split"] for r in rows} == {"train", "test"}
    assert set(df.columns) >= {"r2", "mse", "rmse", "mae"}


def test_every_oracle_has_a_query():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80


def test_fast_queries_match_duckdb(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    for name in FAST:
        sdf = q[name](spark, sf)
        rel = con.execute(o[name])
        dcols = [d[0] for d in rel.description]
        drows = rel.fetchall()
        srows = [tuple(r) for r in sdf.collect()]
        assert sorted(sdf.columns) == sorted(dcols), name
        si = sorted(range(len(dcols)), key=lambda i: sdf.columns[i])
        di = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = sorted((tuple(_norm(r[i]) for i in si) for r in srows), key=repr)
        b = sorted((tuple(_norm(r[i]) for i in di) for r in drows), key=repr)
        assert a == b, name
