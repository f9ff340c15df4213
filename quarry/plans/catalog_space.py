"""Registered distance/cluster queries (J4-J6, R25, R26, C10, U7, O4, E16-E18,
A22) on the embeddings and part tables, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.labels import order_labels
from quarry.operators import metrics, neighbors, profile, split
from quarry.plans.common import SEED, sig_all, t
from quarry.plans.registry import HASH, SIG, register

DIM = 64
EF = [f"x{i}" for i in range(DIM)]


def emb(spark, sf):
    df, _ = neighbors.vector_columns(t(spark, sf, "embeddings"), "embedding", DIM)
    return df.drop("embedding")


def _sqd_sql(a: str, b: str, b_is_center: bool = False) -> str:
    terms = []
    for i in range(DIM):
        rhs = f"{b}.c{i}" if b_is_center else f"{b}.embedding[{i + 1}]::DOUBLE"
        terms.append(f"({a}.embedding[{i + 1}]::DOUBLE - {rhs}) * ({a}.embedding[{i + 1}]::DOUBLE - {rhs})")
    return "(" + " + ".join(terms) + ")"


_CENTERS_SQL = ("cen AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx, "
                + ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS c{i}" for i in range(DIM))
                + " FROM embeddings GROUP BY label)")


@register("j4_nearest_center_embeddings", f"""WITH {_CENTERS_SQL},
d AS (SELECT e.vec_id, cen.idx, {_sqd_sql('e', 'cen', True)} AS d2 FROM embeddings e CROSS JOIN cen)
SELECT vec_id, CAST(idx AS INTEGER) AS cluster FROM (
  SELECT vec_id, idx, row_number() OVER (PARTITION BY vec_id ORDER BY d2, idx) AS p FROM d) WHERE p = 1""")
def q_j4(spark, sf):
    e = emb(spark, sf)
    rows = e.groupBy("label").agg(*[F.avg(f).alias(f) for f in EF]).collect()  # one row per label
    rows = sorted(rows, key=lambda r: r["label"])
    centers = [[r[f] for f in EF] for r in rows]
    return neighbors.nearest_center(e, EF, centers, "cluster").select("vec_id", "cluster")


@register("a22_cluster_sizes_embeddings", """
SELECT label AS value, count(*) AS count FROM embeddings GROUP BY label""")
def q_a22(spark, sf):
    return profile.value_counts(t(spark, sf, "embeddings"), "label")


_LONG_EMB = """el AS (SELECT vec_id, label, d, v FROM (
    SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS v FROM embeddings))"""


@register("e17_cluster_scores_embeddings", f"""WITH {_LONG_EMB},
c AS (SELECT label, d, avg(v) AS m FROM el GROUP BY label, d),
g AS (SELECT d, avg(v) AS mu FROM el GROUP BY d),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
B AS (SELECT sum(n.n * (c.m - g.mu) * (c.m - g.mu)) AS b FROM c JOIN g USING (d) JOIN n USING (label)),
rowsq AS (SELECT el.vec_id, el.label, sum((el.v - c.m) * (el.v - c.m)) AS sq FROM el JOIN c USING (label, d)
          GROUP BY el.vec_id, el.label),
W AS (SELECT sum(sq) AS w FROM rowsq),
s AS (SELECT label, avg(sqrt(sq)) AS s FROM rowsq GROUP BY label),
cd AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS dist
       FROM c a JOIN c b ON a.d = b.d AND a.label <> b.label GROUP BY a.label, b.label),
r AS (SELECT i, max((si.s + sj.s) / dist) AS r FROM cd JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i),
k AS (SELECT count(*) AS k, sum(n) AS nn FROM n)
SELECT k.k AS n_clusters, k.nn AS n_samples,
       {SIG('(B.b / (k.k - 1)) / (W.w / (k.nn - k.k))')} AS calinski_harabasz,
       {SIG('(SELECT avg(r) FROM r)')} AS davies_bouldin
FROM B, W, k""")
def q_e17(spark, sf):
    return sig_all(metrics.cluster_scores(emb(spark, sf), EF, "label"), 8)


@register("e16_silhouette_sq_embeddings", f"""WITH
pd AS (SELECT a.vec_id, a.label AS la, b.label AS lb, {_sqd_sql('a', 'b')} AS d2
       FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT vec_id, la, lb, sum(d2) AS s FROM pd GROUP BY vec_id, la, lb),
ab AS (SELECT vec_id, la,
              max(CASE WHEN la = lb THEN s / (n.n - 1) END) AS a,
              min(CASE WHEN la <> lb THEN s / n.n END) AS b
       FROM m JOIN n ON n.label = m.lb GROUP BY vec_id, la)
SELECT {SIG('avg(CASE WHEN n.n <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END)', 6)} AS silhouette_sq
FROM ab JOIN n ON n.label = ab.la""")
def q_e16(spark, sf):
    return sig_all(metrics.silhouette_squared(emb(spark, sf), EF, "label"), 6)


def _emb_split(spark, sf):
    e = emb(spark, sf)
    sp = split.train_test_split(e, ["vec_id"], 0.2, SEED)
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


_EMB_SPLIT_SQL = f"""sp AS (
  SELECT e.*, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split
  FROM embeddings e JOIN (SELECT vec_id, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n
                          FROM (SELECT vec_id, {HASH(SEED, ['vec_id'])} AS h FROM embeddings)) USING (vec_id)),
nb AS (SELECT q.vec_id, r.vec_id AS rid, r.label AS rl,
              row_number() OVER (PARTITION BY q.vec_id ORDER BY sqrt({_sqd_sql('q', 'r')}), r.vec_id) AS rnk
       FROM sp q JOIN sp r ON q.split = 'test' AND r.split = 'train')"""


@register("c10_knn_classify_embeddings", f"""WITH {_EMB_SPLIT_SQL},
v AS (SELECT vec_id, rl, count(*) AS c FROM nb WHERE rnk <= 5 GROUP BY vec_id, rl)
SELECT vec_id, rl AS prediction FROM (
  SELECT vec_id, rl, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, rl) AS p FROM v) WHERE p = 1""")
def q_c10(spark, sf):
    train, test = _emb_split(spark, sf)
    return neighbors.knn_classify(train, test, "vec_id", EF, "label", 5)


@register("r25_knn_regress_embeddings", f"""WITH {_EMB_SPLIT_SQL}
SELECT vec_id, {SIG('avg(rl)', 10)} AS prediction FROM nb WHERE rnk <= 5 GROUP BY vec_id""")
def q_r25(spark, sf):
    train, test = _emb_split(spark, sf)
    return sig_all(neighbors.knn_regress(train, test, "vec_id", EF, "label", 5), 10)


def _part_xy(spark, sf):
    pt = t(spark, sf, "part")
    return pt.select("p_partkey", F.col("p_size").cast("double").alias("x1"),
                     (F.col("p_partkey") / 40.0).alias("x2"), "p_retailprice")


@register("r26_radius_regress_part", f"""WITH pts AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS x1, p_partkey / 40.0 AS x2, p_retailprice,
         {HASH(SEED, ['p_partkey'])} AS h FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS rk, count(*) OVER () AS n FROM pts),
sp AS (SELECT *, CASE WHEN rk < ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r),
m AS (SELECT q.p_partkey, avg(t.p_retailprice) AS pred FROM sp q JOIN sp t
        ON q.split = 'test' AND t.split = 'train'
       AND sqrt((q.x1 - t.x1) * (q.x1 - t.x1) + (q.x2 - t.x2) * (q.x2 - t.x2)) <= 1.0
      GROUP BY q.p_partkey)
SELECT sp.p_partkey, {SIG('m.pred', 10)} AS prediction FROM sp LEFT JOIN m USING (p_partkey) WHERE sp.split = 'test'""")
def q_r26(spark, sf):
    pts = _part_xy(spark, sf)
    sp = split.train_test_split(pts, ["p_partkey"], 0.2, SEED)
    out = neighbors.radius_regress(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test"),
                                   "p_partkey", ["x1", "x2"], "p_retailprice", 1.0)
    return sig_all(out, 10)


@register("u7_dbscan_part", """WITH RECURSIVE
pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x1, p_retailprice / 10.0 AS x2 FROM part),
pr AS (SELECT a.id AS q, b.id AS r FROM pts a JOIN pts b
         ON sqrt((a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2)) <= 0.5),
core AS (SELECT q AS id FROM pr GROUP BY q HAVING count(*) >= 5),
ce AS (SELECT pr.q, pr.r FROM pr JOIN core c1 ON pr.q = c1.id JOIN core c2 ON pr.r = c2.id),
reach(id, lab) AS (SELECT id, id FROM core UNION SELECT ce.q, reach.lab FROM reach JOIN ce ON ce.r = reach.id),
cl AS (SELECT id, min(lab) AS lab FROM reach GROUP BY id),
bd AS (SELECT pr.q AS id, min(cl.lab) AS blab FROM pr JOIN cl ON cl.id = pr.r GROUP BY pr.q)
SELECT pts.id AS p_partkey, CAST(coalesce(cl.lab, bd.blab, -1) AS BIGINT) AS cluster
FROM pts LEFT JOIN cl USING (id) LEFT JOIN bd USING (id)""")
def q_u7(spark, sf):
    pt = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x1"),
                                     (F.col("p_retailprice") / 10.0).alias("x2"))
    return neighbors.dbscan(pt, "p_partkey", ["x1", "x2"], eps=0.5, min_samples=5)


@register("o4_lof_embeddings", f"""WITH
nb AS (SELECT * FROM (
   SELECT a.vec_id AS p, b.vec_id AS o, sqrt({_sqd_sql('a', 'b')}) AS dist,
          row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt({_sqd_sql('a', 'b')}), b.vec_id) AS rnk
   FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rnk <= 20),
kd AS (SELECT p AS o, dist AS kd FROM nb WHERE rnk = 20),
lrd AS (SELECT nb.p, 1.0 / (avg(greatest(nb.dist, kd.kd)) + 1e-10) AS lrd FROM nb JOIN kd USING (o) GROUP BY nb.p),
lof AS (SELECT nb.p, avg(l2.lrd) / l1.lrd AS lof FROM nb JOIN lrd l2 ON l2.p = nb.o JOIN lrd l1 ON l1.p = nb.p
        GROUP BY nb.p, l1.lrd),
thr AS (SELECT quantile_cont(-lof, 0.1) AS t FROM lof)
SELECT p AS vec_id, {SIG('lof')} AS lof, (-lof >= t) AS inlier FROM lof, thr""")
def q_o4(spark, sf):
    out = neighbors.local_outlier_factor(emb(spark, sf), "vec_id", EF, 20, 0.1)
    return sig_all(out.select("vec_id", "lof", "inlier"), 8)
