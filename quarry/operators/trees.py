"""Tree ensembles grown by grouped statistics.

A pass over the rows computes, for every open node, a row of statistics: each task
keeps dense arrays over the open nodes (bounded by ``CELLS``; more nodes take more
passes), Spark adds them up by groups of nodes, and the driver picks the splits.
Rows travel once, into blocks of packed columns (``BLOCK`` rows in a table row) that
are dealt evenly to tasks; which node a row is in follows from the tree so far.

* Extremely randomised trees: level by level. One pass finds the range of every
  feature in every open node; a threshold per candidate feature is drawn by a seeded
  hash of (tree, node, feature) within it; a second pass counts both sides.
* Histogram boosting, leaf by leaf: the open leaf of largest gain is split next, up to
  ``max_leaf_nodes``. Several of the best leaves are tried in one pass, ahead of their
  turn, so a tree takes few passes but is the best-first tree. Only the smaller child
  is counted; its sibling is the difference to the parent.
* More than two classes: one tree per class and round, on the gradients of the shared
  log loss.

Thresholds and statistics don't depend on the partitioning but for the rounding of
sums. Rows with a missing feature or target are not trained on and get no prediction.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field
from typing import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from quarry.functions.exprs import all_true, col, to_double
from quarry.operators.native import class_list
from quarry.session import cut_lineage

CELLS = 4_000_000   # statistics of one pass
CHUNK = 64          # nodes whose statistics travel together
REWRITE = 10        # boosting rounds between writes of the scores
BATCH = 8192
BLOCK = 1 << 16     # rows packed together
NODE_ROWS = 64      # rows of a block per open node, below which nodes aren't worked one by one


# ------------------------------------------------------------------ trees


def grow(tree: dict, node: int, feature: int, threshold: float, values: tuple) -> tuple[int, int]:
    """Split a leaf; returns the numbers of its children."""
    left = len(tree["feature"])
    tree["feature"][node], tree["threshold"][node], tree["left"][node] = int(feature), float(threshold), left
    for v in values:
        tree["feature"].append(-1)
        tree["threshold"].append(0.0)
        tree["left"].append(-1)
        tree["value"].append(v)
    return left, left + 1


def stump(value) -> dict:
    """A tree of one leaf: ``left`` is the left child, the right one follows it."""
    return {"feature": [-1], "threshold": [0.0], "left": [-1], "value": [value]}


def arrays_of(tree: dict) -> tuple:
    return tuple(np.array(tree[k]) for k in ("feature", "threshold", "left", "value"))


def leaves(tree: tuple, X: np.ndarray) -> np.ndarray:
    """Leaf of every row; a value up to the threshold goes left."""
    feature, threshold, left, _ = tree
    node = np.zeros(len(X), np.int64)
    rows = np.arange(len(X))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        at = node[rows]
        node[rows] = left[at] + (X[rows, feature[at]] > threshold[at])
    return node


def packed(data: DataFrame, p: int, code: Callable | None = None) -> DataFrame:
    """(x, y): the rows of (f0, f1, .., y) as blocks of about ``BLOCK``, dealt to tasks.
    x holds a block's features one after another, each as ``code(number, values)``."""
    def block(held):
        cols = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(p + 1)]
        x = b"".join(np.ascontiguousarray(code(f, c) if code else c).tobytes() for f, c in enumerate(cols[:p]))
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()), pa.array([cols[p].tobytes()], pa.binary())], ["x", "y"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)
    return data.mapInArrow(run, "x binary, y binary").repartition(2 * data.sparkSession.sparkContext.defaultParallelism)


def unpacked(batch: pa.RecordBatch, p: int, dtype=np.float64):
    """(X by feature, y, further columns) of every block."""
    for x, y, *more in zip(*(batch.column(i) for i in range(batch.num_columns))):
        yield (np.frombuffer(x.as_buffer(), dtype).reshape(p, -1), np.frombuffer(y.as_buffer()),
               *[np.frombuffer(m.as_buffer()) for m in more])


def together(batches, size: int):
    """Batches of at least ``size`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def totals(data: DataFrame, n_nodes: int, width: int, work: Callable, op: str, size: int = 1) -> np.ndarray:
    """Statistics (n_nodes x width) of all rows. ``work(batch, out)`` adds an Arrow batch
    (of ``size`` rows or more) to a task's array; ``op`` ('sum' or 'min') joins arrays."""
    start, join = (0.0, np.add) if op == "sum" else (np.inf, np.minimum)

    def run(batches):
        out = np.full((n_nodes, width), start)
        seen = False
        for batch in together(batches, size):
            seen = True
            work(batch, out)
        chunks = range(0, n_nodes if seen else 0, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK for k in chunks], pa.int32()),
                                          pa.array([out[k:k + CHUNK].tobytes() for k in chunks], pa.binary())], ["chunk", "data"])

    def total(table: pa.Table) -> pa.Table:
        parts = (np.frombuffer(b) for b in table.column("data").to_pylist())
        out = next(parts).copy()
        for p in parts:
            join(out, p, out=out)
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "data": pa.array([out.tobytes()], pa.binary())})
    rows = data.mapInArrow(run, "chunk int, data binary").groupBy("chunk").applyInArrow(total, "chunk int, data binary").collect()
    out = np.full((n_nodes, width), start)
    for r in rows:
        part = np.frombuffer(bytes(r["data"])).reshape(-1, width)
        out[r["chunk"] * CHUNK:r["chunk"] * CHUNK + len(part)] = part
    return out


def grouped(data: DataFrame, n_nodes: int, width: int, add: Callable, op: str) -> np.ndarray:
    """``totals`` of plain rows: ``add(table, out)`` works some rows into a task's array."""
    def work(batch, out):
        table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        for a in range(0, len(table), BATCH):
            add(table[a:a + BATCH], out)
    return totals(data, n_nodes, width, work, op)


def rows_of(tree: tuple, X: np.ndarray, wanted: set):
    """(node, its rows) of the wanted nodes that have rows; only paths to them are
    followed. X is by feature."""
    feature, threshold, left, _ = tree
    parent = {int(c) + k: i for i, c in enumerate(left) if c >= 0 for k in (0, 1)}
    path: set = set()
    for node in wanted:
        while node is not None and node not in path:
            path.add(node)
            node = parent.get(node)
    todo = [(0, np.arange(X.shape[1]))]
    while todo:
        node, rows = todo.pop()
        if node in wanted:
            yield node, rows
        first = int(left[node])
        if first < 0 or path.isdisjoint((first, first + 1)):
            continue
        column = X[feature[node]]
        goes = (column if node == 0 else column[rows]) <= X.dtype.type(threshold[node])
        for child, side in ((first, goes), (first + 1, ~goes)):
            if child in path:
                part = rows[side]
                if len(part):
                    todo.append((child, part))


def draw(*key) -> float:
    """A number in [0, 1) that follows from the key alone."""
    return int.from_bytes(hashlib.sha256(repr(key).encode()).digest()[:7], "big") / 2 ** 56


def _training(df: DataFrame, feats: Sequence[str], target: str, classes: list | None) -> DataFrame:
    y = to_double(target)
    if classes:
        y = (F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1).cast("double")
    xs = [to_double(f) for f in feats]
    return (df.where(all_true([F.abs(c) < float("inf") for c in [*xs, y]]))
            .select(*[x.alias(f"f{i}") for i, x in enumerate(xs)], y.alias("y")))


@dataclass
class TreeModel:
    """``kind``: 'mean' averages the trees' leaf values, 'boost' adds them to ``base``.
    Trees of a boosted model go round by round, one per output."""
    features: list
    trees: list
    classes: list | None
    kind: str = "mean"
    base: list = field(default_factory=lambda: [0.0])
    info: dict = field(default_factory=dict)

    def scores(self, X: np.ndarray) -> np.ndarray:
        """Regression: one column of predictions; classification: probabilities."""
        trees = [arrays_of(t) for t in self.trees]
        if self.kind == "mean":
            out = sum(np.atleast_2d(t[3].T).T[leaves(t, X)] for t in trees) / len(trees)
            return out if self.classes is None else out / out.sum(axis=1, keepdims=True)
        raw = raw_scores(trees, self.base, X)
        return raw if self.classes is None else probabilities(raw)

    def transform(self, df: DataFrame, out_col: str = "prediction") -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def score(*cols: pd.Series) -> pd.Series:
            X = np.column_stack([c.to_numpy(float) for c in cols])
            good = np.isfinite(X).all(axis=1)
            out = sent.value.scores(np.where(good[:, None], X, 0.0))
            return pd.Series([row.tolist() if g else None for row, g in zip(out, good)], dtype=object)
        out = df.withColumn("__s", score(*[to_double(f) for f in self.features]))
        s = F.col("__s")
        if self.classes is None:
            return out.withColumn(out_col, s[0]).drop("__s")
        best = F.array_position(s, F.array_max(s)).cast("int")
        name = F.element_at(F.array(*[F.lit(c) for c in self.classes]), best)
        out = out.withColumn(out_col, F.when(s.isNotNull(), name))
        return out.select("*", *[s[i].alias(f"prob_{c}") for i, c in enumerate(self.classes)]).drop("__s")


# ------------------------------------------------------------------ extremely randomised trees


def _by_node(node: np.ndarray):
    """Order of rows by node, where each node's rows begin, and the nodes."""
    order = np.argsort(node, kind="stable")
    sorted_ = node[order]
    head = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(node) else np.zeros(0, np.int64)
    return order, head, sorted_[head]


def _open_nodes(forest: list, slot: list, X: np.ndarray):
    """(open node's number, its rows) of every open node that has rows. X is by feature.
    Trees with many open nodes are worked in pieces, all nodes of a piece at a time."""
    for tree, numbers in zip(forest, slot):
        wanted = np.flatnonzero(numbers >= 0)
        if len(wanted) * NODE_ROWS <= X.shape[1]:
            for node, rows in rows_of(tree, X, set(wanted.tolist())):
                yield int(numbers[node]), rows


def _many_open(forest: list, slot: list, n_rows: int):
    """The trees that ``_open_nodes`` leaves out, and their open nodes."""
    many = [k for k, numbers in enumerate(slot) if np.count_nonzero(numbers >= 0) * NODE_ROWS > n_rows]
    return [forest[k] for k in many], [slot[k] for k in many]


def _open_rows(forest: list, slot: list, X: np.ndarray):
    """(row, open node's number) of every row and tree; ``slot``: number by leaf, -1 if closed.
    X is by row."""
    rows, nodes = [], []
    for tree, numbers in zip(forest, slot):
        at = numbers[leaves(tree, X)]
        keep = np.flatnonzero(at >= 0)
        rows.append(keep)
        nodes.append(at[keep])
    return np.concatenate(rows), np.concatenate(nodes)


def extra_trees(df: DataFrame, features: Sequence[str], target: str, task: str, n_trees: int = 100, max_features=None,
                max_depth: int = 16, min_samples_split: int = 2, min_samples_leaf: int = 1, seed: int = 42) -> TreeModel:
    """R29/C18. ``max_features``: candidate features of a node ('sqrt', a share or a
    number; default all for regression, the root for classification). A leaf's value is
    its mean target or its class shares."""
    feats = list(features)
    p = len(feats)
    classes = class_list(df, target) if task == "classification" else None
    k = len(classes) if classes else 3  # class counts, or n, sum and sum of squares
    if max_features is None:
        max_features = 1.0 if classes is None else "sqrt"
    m = max(1, int(math.sqrt(p)) if max_features == "sqrt" else int(max_features * p) if isinstance(max_features, float) else min(p, max_features))
    data = _training(df, feats, target, classes).persist(StorageLevel.MEMORY_AND_DISK)

    def by_feature(batch):
        return np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])

    def stats(y):
        return np.eye(k)[y.astype(int)] if classes else np.column_stack((np.ones(len(y)), y, y * y))

    def size(s):
        return s.sum() if classes else s[0]

    def value(s):
        return (s / s.sum()).tolist() if classes else float(s[1] / s[0])

    def purity(s):
        """Sum of squares explained by a node's mean; larger is purer."""
        n = size(s)
        return 0.0 if n == 0 else float((s ** 2).sum() / n if classes else s[1] ** 2 / n)

    def is_pure(s):
        n = size(s)
        return (s.max() == n) if classes else s[2] - s[1] ** 2 / n <= 1e-12 * max(1.0, s[2])
    try:
        root = grouped(data, 1, k, lambda t, out: np.add(out, stats(t[:, p]).sum(axis=0), out=out), "sum")[0]
        if not size(root):
            raise ValueError("no row has a target and all features")
        forest = [stump(value(root)) for _ in range(n_trees)]
        todo = [(t, 0, root) for t in range(n_trees)]  # open leaves of a level
        per_pass = max(1, CELLS // (max(2 * p, m * k)))
        for _ in range(max_depth):
            todo = [x for x in todo if size(x[2]) >= max(min_samples_split, 2 * min_samples_leaf) and not is_pure(x[2])]
            after = []
            for a in range(0, len(todo), per_pass):
                some = todo[a:a + per_pass]
                used = sorted({t for t, _, _ in some})
                trees = [arrays_of(forest[t]) for t in used]
                slot = [np.full(len(tree[0]), -1) for tree in trees]
                for number, (t, node, _) in enumerate(some):
                    slot[used.index(t)][node] = number

                def ranges(batch, out):
                    X = by_feature(batch)[:p]
                    for i, rows in _open_nodes(trees, slot, X):
                        V = X[:, rows]
                        out[i] = np.minimum(out[i], np.concatenate((V.min(axis=1), -V.max(axis=1))))
                    deep = _many_open(trees, slot, X.shape[1])
                    for b in range(0, X.shape[1] if deep[0] else 0, BATCH):
                        range_piece(X[:, b:b + BATCH].T, *deep, out)

                def range_piece(X, trees, slot, out):
                    row, node = _open_rows(trees, slot, X)
                    order, head, nodes = _by_node(node)
                    if len(nodes):
                        both = np.concatenate((X, -X), axis=1)[row[order]]
                        out[nodes] = np.minimum(out[nodes], np.minimum.reduceat(both, head))
                span = totals(data, len(some), 2 * p, ranges, "min", BLOCK)
                chosen, cut = np.zeros((len(some), m), np.int64), np.zeros((len(some), m))
                for i, (t, node, _) in enumerate(some):
                    low, high = span[i, :p], -span[i, p:]
                    order = sorted(np.flatnonzero(high > low).tolist(), key=lambda f: draw(seed, t, node, f, "order"))[:m]
                    order = order or [0]
                    for j in range(m):
                        f = order[min(j, len(order) - 1)]
                        chosen[i, j] = f
                        cut[i, j] = low[f] + draw(seed, t, node, f) * (high[f] - low[f])

                def sides(batch, out):
                    table = by_feature(batch)
                    X, S = table[:p], stats(table[p])
                    for i, rows in _open_nodes(trees, slot, X):
                        part = S[rows]
                        for j in range(m):
                            goes = X[chosen[i, j]][rows] <= cut[i, j]
                            out[i, j * k:(j + 1) * k] += goes.astype(float) @ part
                    deep = _many_open(trees, slot, X.shape[1])
                    for b in range(0, X.shape[1] if deep[0] else 0, BATCH):
                        side_piece(X[:, b:b + BATCH].T, S[b:b + BATCH], *deep, out)

                def side_piece(X, S, trees, slot, out):
                    row, node = _open_rows(trees, slot, X)
                    order, head, nodes = _by_node(node)
                    if len(nodes):
                        row, node = row[order], node[order]
                        goes = X[row[:, None], chosen[node]] <= cut[node]
                        both = goes[:, :, None] * S[row][:, None, :]
                        out[nodes] += np.add.reduceat(both.reshape(len(row), -1), head)
                left = totals(data, len(some), m * k, sides, "sum", BLOCK).reshape(len(some), m, k)
                for i, (t, node, whole) in enumerate(some):
                    gains = [purity(x) + purity(whole - x) if min(size(x), size(whole - x)) >= min_samples_leaf else -math.inf for x in left[i]]
                    best = max(gains)
                    if best == -math.inf:
                        continue
                    j = next(j for j, g in enumerate(gains) if g >= best - 1e-9 * abs(best))
                    x = left[i, j]
                    kids = grow(forest[t], node, chosen[i, j], cut[i, j], (value(x), value(whole - x)))
                    after += [(t, kids[0], x), (t, kids[1], whole - x)]
            todo = after
            if not todo:
                break
    finally:
        data.unpersist()
    return TreeModel(feats, forest, classes, "mean")


# ------------------------------------------------------------------ boosting


def raw_scores(trees: list, base: Sequence[float], X: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Sum of the trees' values for each output, from ``base`` or from given scores."""
    out = np.tile(np.asarray(base, float), (len(X), 1)) if start is None else start.copy()
    for i, t in enumerate(trees):
        out[:, i % len(base)] += t[3][leaves(t, X)]
    return out


def probabilities(raw: np.ndarray) -> np.ndarray:
    if raw.shape[1] == 1:
        p = 1.0 / (1.0 + np.exp(-np.clip(raw[:, 0], -700, 700)))
        return np.column_stack((1 - p, p))
    e = np.exp(raw - raw.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_terms(raw: np.ndarray, y: np.ndarray, task: str):
    """(loss, gradient, hessian) of each row."""
    if task == "regression":
        r = raw[:, 0] - y
        return 0.5 * r ** 2, r[:, None], np.ones((len(y), 1))
    prob = probabilities(raw)
    code = y.astype(int)
    loss = -np.log(np.maximum(prob[np.arange(len(y)), code], 1e-300))
    if raw.shape[1] == 1:
        return loss, (prob[:, 1] - y)[:, None], (prob[:, 1] * prob[:, 0])[:, None]
    return loss, prob - np.eye(raw.shape[1])[code], prob * (1 - prob)


def bin_edges(data: DataFrame, p: int, max_bins: int) -> list[np.ndarray]:
    """Thresholds of each feature: between all values while they fit, else quantiles."""
    names = [f"f{i}" for i in range(p)]
    counts = data.agg(*[F.approx_count_distinct(n).alias(n) for n in names]).first()
    few = [n for n in names if counts[n] <= max_bins]
    edges = {}
    for n in few:
        values = [r[0] for r in data.select(n).distinct().orderBy(n).limit(2 * max_bins).collect()]
        if len(values) <= max_bins:  # the count was an estimate
            edges[n] = np.array([(a + b) / 2 for a, b in zip(values, values[1:])])
    many = [n for n in names if n not in edges]
    if many:
        probs = [(i + 1) / max_bins for i in range(max_bins - 1)]
        row = data.agg(*[F.percentile_approx(n, probs, 10_000).alias(n) for n in many]).first()
        edges.update({n: np.unique(np.array(row[n], float)) for n in many})
    return [edges[n] for n in names]


def best_split(hist: np.ndarray, min_leaf: int, l2: float):
    """(gain, feature, bin) of the best split of a node from its histogram (features x
    bins x (gradient, hessian, rows)); gain -inf if there is none."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[0].sum(axis=0)
    right = whole - left

    def score(s):
        return s[..., 0] ** 2 / np.maximum(s[..., 1] + l2, 1e-300)
    gain = score(left) + score(right) - score(whole)
    bad = (left[..., 2] < min_leaf) | (right[..., 2] < min_leaf) | (left[..., 1] < 1e-3) | (right[..., 1] < 1e-3)
    gain = np.where(bad, -np.inf, gain)
    top = gain.max(initial=-np.inf)
    if not top > 1e-10 * max(1.0, score(whole)):
        return -math.inf, -1, -1
    f, b = np.argwhere(gain >= top - 1e-9 * abs(top))[0]
    return float(top), int(f), int(b)


@dataclass
class _Leaf:
    node: int
    depth: int
    hist: np.ndarray
    split: tuple = (-math.inf, -1, -1)
    kids: tuple | None = None  # histograms of the children, once a pass has counted them


def boost(df: DataFrame, features: Sequence[str], target: str, task: str, n_iter: int = 100, learning_rate: float = 0.1,
          max_leaf_nodes: int | None = 31, max_depth: int | None = None, min_samples_leaf: int = 20, l2: float = 0.0,
          max_bins: int = 255) -> TreeModel:
    """R32/C21, C20. ``info['loss']``: mean loss before every round and after the last."""
    if max_leaf_nodes is None and max_depth is None:
        raise ValueError("give max_leaf_nodes or max_depth")
    if not 2 <= max_bins <= 255:
        raise ValueError("max_bins lies between 2 and 255")
    feats = list(features)
    p = len(feats)
    classes = class_list(df, target) if task == "classification" else None
    if classes is not None and len(classes) < 2:
        raise ValueError("a classifier needs two classes")
    n_out = 1 if classes is None or len(classes) == 2 else len(classes)
    data = _training(df, feats, target, classes).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        edges = bin_edges(data, p, max_bins)
        first = data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"), *[F.count_if(F.col("y") == c).alias(f"c{c}") for c in range(len(classes or []))]).first()
        n = first["n"]
        if not n:
            raise ValueError("no row has a target and all features")
        blocks = cut_lineage(packed(data, p, lambda f, c: np.searchsorted(edges[f], c).astype(np.uint8)))
    finally:
        data.unpersist()
    if classes is None:
        base = [first["y"]]
    else:
        share = [max(first[f"c{c}"] / n, 1e-12) for c in range(len(classes))]
        base = [math.log(share[1] / share[0])] if n_out == 1 else [math.log(s) for s in share]
    trees, losses = [], []
    bins = max_bins
    rows = _rescored(blocks, p, [stump(b) for b in base])

    def histograms(open_: list, growing: list, loss: bool = False) -> list[np.ndarray]:
        """Histograms of leaves (output, leaf number) of the growing trees; the row after
        them is the loss."""
        out = []
        width = p * bins * 3
        per_pass = max(1, CELLS // width)
        now = [arrays_of(t) for t in growing]
        for a in range(0, len(open_), per_pass):
            some = open_[a:a + per_pass]
            numbers = [{node: i for i, (d, node) in enumerate(some) if d == c} for c in range(n_out)]

            def work(batch, acc):
                for X, y, raw in unpacked(batch, p, np.uint8):
                    each, g, h = loss_terms(raw.reshape(n_out, -1).T, y, task)
                    if loss:
                        acc[len(some), 0] += each.sum()
                    for c in range(n_out):
                        gc, hc = np.ascontiguousarray(g[:, c]), None if classes is None else np.ascontiguousarray(h[:, c])
                        for node, at in rows_of(now[c], X, set(numbers[c])):
                            hist = acc[numbers[c][node]].reshape(p, bins, 3)
                            whole = len(at) == len(y)
                            ga, ha = (gc, hc) if whole else (gc[at], None if hc is None else hc[at])
                            for f in range(p):
                                cell = (X[f] if whole else X[f][at]).astype(np.intp)
                                count = np.bincount(cell, minlength=bins)
                                hist[f, :, 0] += np.bincount(cell, ga, bins)
                                hist[f, :, 1] += count if ha is None else np.bincount(cell, ha, bins)
                                hist[f, :, 2] += count
            got = totals(rows, len(some) + 1, width, work, "sum")
            losses_now.append(got[-1, 0] / n)
            out += [x.reshape(p, bins, 3) for x in got[:-1]]
        return out

    def leaf_value(hist):
        g, h, _ = hist[0].sum(axis=0)
        return float(-learning_rate * g / max(h + l2, 1e-300))
    rows, past = rows.persist(StorageLevel.MEMORY_AND_DISK), None
    for _ in range(n_iter):
        losses_now: list = []
        grown = [stump(0.0) for _ in range(n_out)]
        queues = []
        for c, hist in enumerate(histograms([(c, 0) for c in range(n_out)], grown, loss=True)):
            leaf = _Leaf(0, 0, hist, best_split(hist, min_samples_leaf, l2))
            grown[c]["value"][0] = leaf_value(hist)
            queues.append([leaf])
        losses.append(losses_now[0])
        if past is not None:  # the newer scores are kept now
            past.unpersist()
        left = [(max_leaf_nodes or 1 << 30) - 1] * n_out
        while True:
            # take splits in best-first order as far as the children are known
            for c, queue in enumerate(queues):
                while left[c]:
                    open_ = [x for x in queue if x.split[0] > 0 and (max_depth is None or x.depth < max_depth)]
                    if not open_:
                        left[c] = 0
                        break
                    leaf = max(open_, key=lambda x: (x.split[0], -x.node))
                    if leaf.kids is None:
                        break
                    queue.remove(leaf)
                    kids = grow(grown[c], leaf.node, leaf.split[1], leaf.split[2], tuple(map(leaf_value, leaf.kids)))
                    queue += [_Leaf(k, leaf.depth + 1, hist, best_split(hist, min_samples_leaf, l2)) for k, hist in zip(kids, leaf.kids)]
                    left[c] -= 1
            # count the smaller children of the best leaves still without
            trial, ask, whose = [{k: list(v) for k, v in t.items()} for t in grown], [], []
            for c, queue in enumerate(queues):
                open_ = [x for x in queue if x.split[0] > 0 and x.kids is None and (max_depth is None or x.depth < max_depth)]
                for leaf in sorted(open_, key=lambda x: -x.split[0])[:left[c]]:
                    _, f, b = leaf.split
                    kids = grow(trial[c], leaf.node, f, b, (0.0, 0.0))
                    small = int(leaf.hist[f, :b + 1, 2].sum() > leaf.hist[f, b + 1:, 2].sum())
                    ask.append((c, kids[small]))
                    whose.append((leaf, small))
            if not ask:
                break
            for (leaf, small), hist in zip(whose, histograms(ask, trial)):
                pair = (hist, leaf.hist - hist)
                leaf.kids = pair[::-1] if small else pair
        trees += grown
        past, rows = rows, _rescored(rows, p, grown)
        if len(trees) // n_out % REWRITE == 0:
            rows = cut_lineage(rows)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)

    def only_loss(batch, acc):
        for _, y, raw in unpacked(batch, p, np.uint8):
            acc[0, 0] += loss_terms(raw.reshape(n_out, -1).T, y, task)[0].sum()
    losses.append(totals(rows, 1, 1, only_loss, "sum")[0, 0] / n)
    for kept in (past, rows):
        if kept is not None:
            kept.unpersist()
    for t in trees:  # bins to values
        t["threshold"] = [float(edges[f][int(b)]) if f >= 0 else 0.0 for f, b in zip(t["feature"], t["threshold"])]
    return TreeModel(feats, trees, classes, "boost", base, {"loss": losses})


def _rescored(blocks: DataFrame, p: int, grown: list) -> DataFrame:
    """Blocks with the scores s (output by output) after one more tree of each output;
    without scores yet, they are the trees' values."""
    now = [arrays_of(t) for t in grown]
    ends = [{i for i, c in enumerate(t[2]) if c < 0} for t in now]

    def run(batches):
        for batch in batches:
            for k, (X, y, *raw) in enumerate(unpacked(batch, p, np.uint8)):
                out = raw[0].reshape(len(now), -1).copy() if raw else np.zeros((len(now), len(y)))
                for c, t in enumerate(now):
                    for node, at in rows_of(t, X, ends[c]):
                        out[c, at] += t[3][node]
                yield pa.RecordBatch.from_arrays([*[batch.column(j).slice(k, 1) for j in range(2)], pa.array([out.tobytes()], pa.binary())], ["x", "y", "s"])
    return blocks.mapInArrow(run, "x binary, y binary, s binary")
