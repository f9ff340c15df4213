"""Seeded, deterministic, partition-independent splits and folds.

Every row gets ``h = md5(seed|key...)``. A split "first m rows in h order" is
resolved without a global sort:

1. one aggregation counts rows per (stratum, leading 3 hex digits); only a row
   per stratum goes to the driver, which turns sizes into cut ranks;
2. running sums over a stratum's buckets (at most 4,096 rows a window) find the
   bucket that holds each cut and the offset inside; a bucket of more than
   ``MAX_WINDOW`` rows is counted again by its next 4 digits, all such cuts in one
   grouped count, until it is that small; a window inside the bucket then names
   the threshold hash h*. The driver reads a row per cut;
3. every row's piece is the number of its stratum's thresholds with h >= h*: one
   projection, or, with many strata, one join with the table of thresholds.

md5 prefixes are uniform, so each narrowing divides a bucket by 65,536 whatever
the skew of the strata; rows of equal keys share a hash, and a bucket that is down
to one hash needs no narrowing. The result is identical to ``row_number() OVER
(PARTITION BY stratum ORDER BY h)`` cut at the same ranks, which is what the SQL
oracle computes (rows with equal keys never part).

Where a table is split many times, ``hash_prefixes`` gives it the leading digits of each
seed's hash as a small number. Given such a column (``prefix``), the counts and nearly
all labels come from it, and md5 is only computed in the buckets that hold a cut.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.functions.exprs import bounded_broadcast, col, hash_bucket, key_hash

BUCKET_DIGITS = 3
HASH_DIGITS = 32
MAX_WINDOW = 10_000  # rows of a bucket that one window may order
MAX_CASES = 64  # strata up to which thresholds are a CASE; beyond, a join
_H, _S = "__h", "__stratum"


def _with_hash(df: DataFrame, seed, key_cols: list[str], strata_col: str | None) -> DataFrame:
    s = col(strata_col).cast("string") if strata_col else F.lit(None).cast("string")
    return df.withColumn(_H, key_hash(seed, key_cols)).withColumn(_S, s)


def hash_prefixes(df: DataFrame, key_cols: list[str], seeds) -> tuple[DataFrame, dict]:
    """``df`` with a column per seed that has its hash's leading digits as a number, and
    the columns' names by seed."""
    names = {seed: f"__prefix_{i}" for i, seed in enumerate(dict.fromkeys(seeds))}
    return df.withColumns({name: hash_bucket(key_hash(seed, key_cols), BUCKET_DIGITS).cast("smallint") for seed, name in names.items()}), names


class _Counts:
    """Rows per (stratum, leading digits), kept until the cuts are found."""

    def __init__(self, hdf: DataFrame, prefix: str | None = None):
        p = F.substring(_H, 1, BUCKET_DIGITS) if prefix is None else col(prefix)
        table = hdf.groupBy(_S, p.alias("p")).agg(F.count(F.lit(1)).alias("c"))
        if prefix is not None:
            table = table.withColumn("p", F.lpad(F.lower(F.hex(F.col("p").cast("long"))), BUCKET_DIGITS, "0"))
        self.table = table.persist(StorageLevel.MEMORY_AND_DISK)
        self.sizes = {r[_S]: r["n"] for r in self.table.groupBy(_S).agg(F.sum("c").alias("n")).collect()}

    def release(self) -> None:
        self.table.unpersist()


def _narrow(counts: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """(cut, stratum, prefix, offset inside it, its rows) for the bucket of ``counts``
    (``by``, p, c) that holds each cut's offset."""
    w = Window.partitionBy(*by).orderBy("p")
    placed = (counts.withColumn("__to", F.sum("c").over(w)).withColumn("__from", F.col("__to") - F.col("c"))
              .withColumnRenamed(_S, "__s2").withColumnRenamed("__parent", "__p2"))
    on = F.col("__s2").eqNullSafe(F.col(_S))
    if "__parent" in by:
        on = on & (F.col("__p2") == F.col("prefix"))
    # the cuts are a local table of a row per stratum and cut
    hit = placed.join(cuts, on).where((F.col("off") >= F.col("__from")) & (F.col("off") < F.col("__to")))
    return hit.select("cut", _S, F.col("p").alias("prefix"), (F.col("off") - F.col("__from")).alias("off"),
                      F.col("c").alias("n"))


_CUTS = f"cut long, {_S} string, prefix string, off long, n long"


def _threshold_hashes(hdf: DataFrame, counts: _Counts, wanted: list[tuple], max_window: int = MAX_WINDOW,
                      prefix: str | None = None) -> dict[int, str]:
    """The hash at each (cut, stratum, rank); cuts past the end have none."""
    spark = hdf.sparkSession
    found: dict[int, str] = {}
    cuts = spark.createDataFrame([(i, s, "", int(r), 0) for i, s, r in wanted], _CUTS)
    open_ = _narrow(counts.table, cuts, [_S]).collect()  # a row per cut
    if prefix is not None:  # no other row needs its hash
        hdf = hdf.where(col(prefix).isin(sorted({int(r["prefix"], 16) for r in open_})))
    digits = BUCKET_DIGITS
    while open_:
        found.update({r["cut"]: r["prefix"] for r in open_ if digits >= HASH_DIGITS})
        open_ = [r for r in open_ if digits < HASH_DIGITS]
        small = [tuple(r) for r in open_ if r["n"] <= max_window]
        large = [tuple(r) for r in open_ if r["n"] > max_window]
        if small:
            found.update(_ranked(hdf, spark.createDataFrame(small, _CUTS), digits))
        if not large:
            break
        cuts = spark.createDataFrame(large, _CUTS)
        finer = min(digits + 4, HASH_DIGITS)
        rows = (_rows_of(hdf, cuts, digits)
                .groupBy(_S, F.col("__at").alias("__parent"), F.substring(_H, 1, finer).alias("p"))
                .agg(F.count(F.lit(1)).alias("c")))
        open_ = _narrow(rows, cuts, [_S, "__parent"]).collect()
        digits = finer
    return found


def _rows_of(hdf: DataFrame, cuts: DataFrame, digits: int) -> DataFrame:
    """The hashes of rows in the buckets of the cuts, once per bucket."""
    buckets = cuts.select(F.col(_S).alias("__s2"), F.col("prefix").alias("__at")).distinct()
    rows = hdf.select(_S, _H)
    return (rows.join(bounded_broadcast(buckets), F.col(_S).eqNullSafe(F.col("__s2"))
                      & (F.substring(_H, 1, digits) == F.col("__at"))).drop("__s2"))


def _ranked(hdf: DataFrame, cuts: DataFrame, digits: int) -> dict[int, str]:
    w = Window.partitionBy(_S, "__at").orderBy(_H)
    rows = (_rows_of(hdf, cuts, digits).withColumn("__r", F.row_number().over(w) - 1)
            .withColumnRenamed(_S, "__s2"))
    hit = rows.join(cuts, F.col("__s2").eqNullSafe(F.col(_S)) & (F.col("__at") == F.col("prefix"))
                    & (F.col("__r") == F.col("off")))
    return {r["cut"]: r[_H] for r in hit.select("cut", _H).collect()}  # a row per cut


def _reached(hashes: list[str], h: Column, prefix: str | None) -> Column:
    """How many of the hashes aren't above the row's."""
    exact = sum(((h >= F.lit(t)).cast("int") for t in hashes), F.lit(0))
    if prefix is None:
        return exact
    heads = [int(t[:BUCKET_DIGITS], 16) for t in hashes]
    # a branch of its own, so that md5 is left alone for rows in other buckets
    return F.when(col(prefix).isin(sorted(set(heads))), exact).otherwise(sum(((col(prefix) > F.lit(x)).cast("int") for x in heads), F.lit(0)))


def _pieces(hdf: DataFrame, by_stratum: dict, out_col: str, h: Column, prefix: str | None = None) -> DataFrame:
    """Number of the stratum's thresholds not above the row's hash ``h``."""
    if len(by_stratum) <= MAX_CASES:
        expr = None
        for s, hashes in by_stratum.items():
            val = _reached(hashes, h, prefix)
            cond = F.col(_S).isNull() if s is None else F.col(_S) == F.lit(s)
            expr = F.when(cond, val) if expr is None else expr.when(cond, val)
        return hdf.withColumn(out_col, F.lit(0) if expr is None else expr.otherwise(F.lit(0)))
    table = hdf.sparkSession.createDataFrame([(s, h) for s, h in by_stratum.items()], "__s2 string, __t array<string>")
    hdf = hdf.withColumn(_H, h)
    reached = F.size(F.filter("__t", lambda t: t <= F.col(_H)))
    return (hdf.join(bounded_broadcast(table), F.col(_S).eqNullSafe(F.col("__s2")), "left")
            .withColumn(out_col, F.when(F.col("__t").isNotNull(), reached).otherwise(F.lit(0))).drop("__s2", "__t"))


def assign_pieces(df: DataFrame, seed, key_cols: list[str], cuts_by_stratum,
                  strata_col: str | None = None, out_col: str = "piece",
                  counts: _Counts | None = None, max_window: int = MAX_WINDOW, prefix: str | None = None) -> DataFrame:
    """Label each row with the number of cut ranks <= its rank in h order.

    ``cuts_by_stratum``: function ``(stratum, n_stratum) -> sorted cut ranks``.
    Each cut becomes an exact threshold hash; rows are neither sorted nor moved.
    """
    hdf = _with_hash(df, seed, key_cols, strata_col)
    counts = counts if counts is not None else _Counts(hdf, prefix)
    wanted = [(s, r) for s, n in counts.sizes.items() for r in cuts_by_stratum(s, n)]
    found = _threshold_hashes(hdf, counts, [(i, s, r) for i, (s, r) in enumerate(wanted)], max_window, prefix) if wanted else {}
    counts.release()
    by_stratum: dict = {}
    for i, (s, _) in enumerate(wanted):
        if i in found:
            by_stratum.setdefault(s, []).append(found[i])
    if prefix is None:
        return _pieces(hdf, by_stratum, out_col, F.col(_H)).drop(_H, _S)
    return _pieces(hdf.drop(_H), by_stratum, out_col, key_hash(seed, key_cols), prefix).drop(_H, _S)


# ---------------------------------------------------------------- split sizes

def n_test_for(n: int, test_size: float) -> int:
    """Test rows for a fractional test size: ceil(n * size), as the reference."""
    if isinstance(test_size, int) or test_size >= 1:
        return int(test_size)
    return int(math.ceil(float(test_size) * n))


def largest_remainder(class_counts: dict, total: int) -> dict:
    """Allocate ``total`` over classes proportional to counts; leftovers to the
    largest remainders (ties: class name ascending)."""
    n = sum(class_counts.values())
    if n == 0:
        return {k: 0 for k in class_counts}
    base = {k: (total * c) // n for k, c in class_counts.items()}
    rem = {k: (total * c) % n for k, c in class_counts.items()}
    left = total - sum(base.values())
    order = sorted(class_counts, key=lambda k: (-rem[k], str(k)))
    for k in order[:left]:
        base[k] += 1
    return base


def kfold_sizes(n: int, k: int) -> list[int]:
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def _cum(sizes: list[int]) -> list[int]:
    out, acc = [], 0
    for s in sizes[:-1]:
        acc += s
        out.append(acc)
    return out


def round_robin_sizes(offset: int, count: int, k: int) -> list[int]:
    """Per-fold counts of a class occupying positions [offset, offset+count)
    of the label-sorted array dealt round-robin over k folds."""
    def below(x: int, f: int) -> int:
        return (x // k) * f + min(x % k, f)
    cum = [below(offset + count, f) - below(offset, f) for f in range(k + 1)]
    return [cum[f + 1] - cum[f] for f in range(k)]


# ---------------------------------------------------------------- public API

def train_test_split(df: DataFrame, key_cols: list[str], test_size: float = 0.2,
                     seed: int = 42, stratify: str | None = None,
                     out_col: str = "split", prefix: str | None = None) -> DataFrame:
    """Exact-size seeded split; ``split`` is 'train' or 'test'.

    Test rows are the first ceil(n*test_size) rows in h order (per stratum with
    a largest-remainder allocation when ``stratify`` is given). ``prefix``: the
    seed's column of ``hash_prefixes``.
    """
    hdf = _with_hash(df, seed, key_cols, stratify)
    counts = _Counts(hdf, prefix)
    sizes = counts.sizes
    n = sum(sizes.values())
    n_test = n_test_for(n, test_size)
    alloc = largest_remainder(sizes, n_test) if stratify else {None: n_test}
    pieces = assign_pieces(df, seed, key_cols, lambda s, n_s: [alloc.get(s, 0)],
                           strata_col=stratify, out_col="__piece", counts=counts, prefix=prefix)
    return pieces.withColumn(out_col, F.when(F.col("__piece") == 0, F.lit("test"))
                             .otherwise(F.lit("train"))).drop("__piece")


def kfold(df: DataFrame, key_cols: list[str], k: int = 5, seed: int = 42,
          stratify: str | None = None, out_col: str = "fold", prefix: str | None = None) -> DataFrame:
    """Shuffled (stratified) k-fold; fold = contiguous rank range.

    Plain: fold sizes n//k (+1 for the first n%k folds). Stratified: each
    class gets the per-fold counts of a round-robin deal of the label-sorted
    table, so fold sizes and class mix match a stratified k-fold. ``prefix``: the
    seed's column of ``hash_prefixes``.
    """
    if k is None or k < 2:
        k = 5
    if not stratify:
        return assign_pieces(df, seed, key_cols,
                             lambda s, n_s: _cum(kfold_sizes(n_s, k)), out_col=out_col, prefix=prefix)
    hdf = _with_hash(df, seed, key_cols, stratify)
    counts = _Counts(hdf, prefix)
    sizes = counts.sizes
    offsets, acc = {}, 0
    for s in sorted(sizes, key=lambda x: (x is None, str(x))):
        offsets[s] = acc
        acc += sizes[s]
    return assign_pieces(
        df, seed, key_cols,
        lambda s, n_s: _cum(round_robin_sizes(offsets[s], n_s, k)),
        strata_col=stratify, out_col=out_col, counts=counts, prefix=prefix)


def repeated_kfold(df: DataFrame, key_cols: list[str], k: int = 5, repeats: int = 2,
                   seed: int = 42, stratify: str | None = None) -> DataFrame:
    """Repeat r uses seed ``seed + r``; output has ``repeat`` and ``fold``."""
    parts = [kfold(df, key_cols, k, seed + r, stratify).withColumn("repeat", F.lit(r))
             for r in range(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shuffle_split(df: DataFrame, key_cols: list[str], n_splits: int = 5,
                  test_size: float = 0.2, seed: int = 42,
                  stratify: str | None = None) -> DataFrame:
    """Independent seeded splits; output has ``split_id`` and ``split``."""
    parts = [train_test_split(df, key_cols, test_size, seed + i, stratify)
             .withColumn("split_id", F.lit(i)) for i in range(n_splits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- strata / bins

def bin_by_edges(c: Column, inner_edges: list[float]) -> Column:
    """Right-closed bins, lowest included: label = number of inner edges < x."""
    lab = F.lit(0)
    for e in inner_edges:
        lab = lab + (c > F.lit(float(e))).cast("int")
    return F.when(c.isNull(), F.lit(None)).otherwise(lab)


def _accept(counts: dict, test_size: float) -> bool:
    return bool(counts) and all(v >= 2 and v * test_size >= 1 for v in counts.values())


def quantile_strata(df: DataFrame, target: str, max_bins: int = 5, min_bins: int = 2,
                    test_size: float = 0.2, out_col: str = "__stratum"):
    """Quantile bins of ``target``, trying max_bins down to min_bins.

    All candidate edges come from one ``percentile`` pass; each candidate's
    bin counts from one grouped count. Returns (df_with_col or None, q, counts).
    """
    from quarry.functions.quantiles import column_quantiles
    probs = sorted({j / qq for qq in range(min_bins, max_bins + 1) for j in range(qq + 1)})
    qs = column_quantiles(df, [target], probs)[target]
    lookup = dict(zip(probs, qs))
    c = col(target).cast("double")
    collapsed = True
    for qq in range(max_bins, min_bins - 1, -1):
        edges = sorted({lookup[j / qq] for j in range(qq + 1) if lookup[j / qq] is not None})
        if len(edges) < 2:
            continue
        collapsed = False
        inner = edges[1:-1]
        lab = bin_by_edges(c, inner)
        counts = {r[0]: r[1] for r in df.groupBy(lab.alias("b")).count().collect()}
        if None in counts:
            continue
        if _accept(counts, test_size):
            return df.withColumn(out_col, lab), qq, dict(sorted(counts.items()))
    if collapsed and target != "__rq":  # B4: every candidate collapsed -> rank-based bins
        return rank_quantile_strata(df, target, max_bins, min_bins, test_size, out_col)
    return None, None, {}


def fixed_bin_strata(df: DataFrame, target: str, edges: list[float], test_size: float = 0.2,
                     out_col: str = "__stratum"):
    """B2: fixed edges (inf allowed), right-closed, lowest included."""
    if len(edges) < 2:
        return None, {}
    lo, hi = float(edges[0]), float(edges[-1])
    c = col(target).cast("double")
    inner = [float(e) for e in edges[1:-1]]
    lab = F.when((c < F.lit(lo)) | (c > F.lit(hi)), F.lit(None)).otherwise(bin_by_edges(c, inner))
    counts = {r[0]: r[1] for r in df.groupBy(lab.alias("b")).count().collect()}
    if None in counts or not _accept(counts, test_size):
        return None, {}
    return df.withColumn(out_col, lab), dict(sorted(counts.items()))


def class_strata(df: DataFrame, target: str, test_size: float = 0.2,
                 out_col: str = "__stratum"):
    """Class labels as strata when each class has >=2 rows and >=1 test row."""
    lab = col(target).cast("string")
    counts = {r[0]: r[1] for r in df.groupBy(lab.alias("b")).count().collect()}
    if not _accept(counts, test_size):
        return None, {}
    return df.withColumn(out_col, lab), dict(sorted(counts.items(), key=lambda kv: str(kv[0])))


def strata_counts(df: DataFrame, target: str, test_size: float = 0.2) -> DataFrame:
    """B3 as a DataFrame: per class count and whether the class passes."""
    lab = col(target).cast("string").alias("stratum")
    return (df.groupBy(lab).count()
            .withColumn("ok", (F.col("count") >= 2) & (F.col("count") * F.lit(float(test_size)) >= 1)))


def rank_quantile_strata(df: DataFrame, target: str, max_bins: int = 5, min_bins: int = 2,
                         test_size: float = 0.2, out_col: str = "__stratum"):
    """When value quantiles collapse (heavy ties), bin the average rank
    divided by (n + 1e-9) instead. Ranks come from the distributed rank table
    (joined back by value; broadcast only when small)."""
    from quarry.operators.correlate import BROADCAST_MAX_ROWS, rank_tables
    x = col(target).cast("double")
    n = df.where(x.isNotNull()).count()
    ranks = rank_tables(df.select(x.alias("__t")), ["__t"]).select(F.col("v").alias("__v"), "rank")
    size = ranks.count()
    side = F.broadcast(ranks) if size <= BROADCAST_MAX_ROWS else ranks
    ranked = df.join(side, x == F.col("__v"), "left").withColumn(
        "__rq", F.col("rank") / F.lit(n + 1e-9)).drop("__v", "rank")
    got, q, counts = quantile_strata(ranked, "__rq", max_bins, min_bins, test_size, out_col)
    return (got.drop("__rq") if got is not None else None), q, counts


def robustness_strata(df: DataFrame, target: str, max_bins: int = 5, min_bins: int = 2, out_col: str = "__stratum"):
    """The largest number of quantile bins, from ``max_bins`` down to
    ``min_bins``, for which there are at least two strata of at least two rows each
    (equal edges fall together); a column of one value is tried with equal widths.
    Missing targets, or no number of bins that qualifies, raise."""
    from quarry.functions.quantiles import column_quantiles
    x = col(target).cast("double")
    seen = df.agg(F.count_if(x.isNull() | F.isnan(x)).alias("missing"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if not seen["missing"] and seen["lo"] is not None:
        for k in range(max_bins, min_bins - 1, -1):
            edges = column_quantiles(df, [target], [j / k for j in range(1, k)])[target]
            inner = sorted({e for e in edges if seen["lo"] < e < seen["hi"]})
            how = "quantile" if inner or seen["lo"] < seen["hi"] else "width"
            lab = bin_by_edges(x, inner)
            counts = {r[0]: r[1] for r in df.groupBy(lab.alias("b")).count().collect()}
            if len(counts) >= 2 and min(counts.values()) >= 2:
                return df.withColumn(out_col, lab), how, dict(sorted(counts.items()))
    raise ValueError(f"{target}: no strata of at least two rows each")
