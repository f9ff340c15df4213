"""Operator 3: quality classifier with hierarchical empirical Bayes.

A logistic model on words and on shape (symbols, capitals, repeats, ...) gives each
document evidence for two labels, good and toxic; it uses the words whose share of
labelled documents differs beyond chance (``MIN_Z``). Sites differ, and most
have few documents, so rates are estimated by level: all documents, host, path.
Each level's rate is a beta posterior whose prior mean is the level above and whose
strength comes from the spread between groups (method of moments): a group with few
documents is drawn to its parent, a large one keeps its own rate. A document's
posterior odds are its evidence (classifier odds over the training odds) times the
odds of its path. Documents that are likelier bad than good, or likelier toxic than
not, are rejected.

Counts and sums per path come from one grouped aggregation over all documents,
hosts from paths, and only three numbers per label (global rate and the two prior
strengths) reach the driver. The table of paths is broadcast after it is counted and
found small, otherwise joined by shuffle, where skewed paths are split.

The fit is on a sample of labelled documents, ``max_fit`` at most in expectation and
drawn by a hash of the id (the documented bound); everything else reads all rows.

Defined cases: a null text is an empty text; a null host or path is a group of its
own; labels that are null or repeat are averaged; without labels of a kind its
probability is the neutral one (good 1, toxic 0); rows that repeat are judged alike;
clashing column names are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import bounded_broadcast
from quarry.llm.common import cut_lineage, key_of, need, read_table, tidy, without
from quarry.llm.lang_crf import letter_bytes
from quarry.llm.textvec import ascii_lower_table, ranges, slices, space_word_bytes, span_hashes, word_spans

OUT = ("p_good", "p_toxic", "kept")
LABELS = ("good", "toxic")
# Broken text shows in its shape, toxic text in words and stems wherever they stand;
# stems would only tell the length of a text where quality is concerned.
USES_STEMS = {"good": False, "toxic": True}
SHAPES = 8
STEPS = 12      # levels of each shape
PREFIXES = (4, 5, 6, 7, 8, 9)  # bytes of the prefixes of longer words
MIN_DOCS = 5    # sampled documents that a feature needs
MIN_Z = 6.0     # standard deviations between a word's count in a label and chance


@dataclass
class Model:
    keys: dict = field(default_factory=dict)     # label -> sorted features
    weights: dict = field(default_factory=dict)  # label -> their weights
    shape_weights: dict = field(default_factory=dict)
    bias: dict = field(default_factory=dict)
    rate: dict = field(default_factory=dict)     # label -> share in the sample


def shape_features(data, begins, ends, row, start, end, h):
    """Shares that tell broken text from prose, cut into steps: feature per row and shape."""
    n = len(begins)
    size = np.maximum(ends - begins, 1)

    def share(mask, of):
        sums = np.concatenate(([0], np.cumsum(mask)))
        return (sums[ends] - sums[begins]) / np.maximum(of, 1)
    table = np.zeros((4, 256), bool)
    table[0, list(b"#*$%&|<>!~^{}[]@=_\\")] = True
    table[1, 65:91] = True
    table[2, 48:58] = True
    table[3] = letter_bytes()
    words = np.bincount(row, minlength=n)
    letters = share(table[3][data], 1)
    order = np.lexsort((h, row))
    r, k = row[order], h[order]
    fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (k[1:] != k[:-1]))) if len(r) else np.zeros(0, bool)
    distinct = np.bincount(r[fresh], minlength=n)
    follows = np.concatenate(([False], (h[1:] == h[:-1]) & (row[1:] == row[:-1]))) if len(h) else np.zeros(0, bool)
    values = [share(table[0][data], size), share(table[1][data], letters), share(table[2][data], size), letters / size,
              distinct / np.maximum(np.sqrt(words), 1) / 10, np.bincount(row[follows], minlength=n) / np.maximum(words, 1),
              np.log2(words + 1) / 14, np.bincount(row, end - start, minlength=n) / np.maximum(words, 1) / 16]
    out = np.empty((n, SHAPES), np.int64)
    for s, v in enumerate(values):
        step = np.minimum((np.sqrt(np.clip(v, 0, 1)) * STEPS).astype(np.int64), STEPS - 1)
        out[:, s] = s * STEPS + step
    return out


def words_of(data, begins, ends):
    """(row, word) pairs of each text's distinct words, and the distinct words of the
    stretch: their hashes, starts and ends."""
    row, start, end = word_spans(data, begins, ends, letter_bytes())
    h = span_hashes(data, start, end, ascii_lower_table())
    uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    n = max(len(uniq), 1)
    pairs = np.unique(row * n + inverse) if len(row) else np.zeros(0, np.int64)
    return (pairs // n).astype(np.int32), (pairs % n).astype(np.int32), uniq, start[first], end[first]


def word_features(data, uniq, start, end, kind: int):
    """A feature per distinct word: its hash (kind 0), or that of its proper prefix of
    PREFIXES[kind - 1] bytes, zero where the word is not longer."""
    if kind == 0:
        return uniq
    n = PREFIXES[kind - 1]
    out = np.zeros(len(uniq), np.uint64)
    has = np.flatnonzero(end - start > n)
    out[has] = span_hashes(data, start[has], start[has] + n, ascii_lower_table(), seed=2)
    return out


def shapes_of(data, begins, ends):
    tokens = word_spans(data, begins, ends, space_word_bytes())
    return shape_features(data, begins, ends, *tokens, span_hashes(data, tokens[1], tokens[2], ascii_lower_table()))


def fit_logistic(rows, cols, values, y, n_features, epochs: int = 60, rate: float = 0.5, l2: float = 1e-4, seed: int = 5):
    """Weights and bias by stochastic gradients over sparse rows in ascending order."""
    n = len(y)
    prior = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w, squares = np.zeros(n_features), np.full(n_features, 1e-2)
    bias, bias_squares = float(np.log(prior / (1 - prior))), 1e-2
    limits = np.searchsorted(rows, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(n)
        for b in range(0, n, 64):
            docs = order[b:b + 64]
            lens = limits[docs + 1] - limits[docs]
            at = ranges(limits[docs], lens)
            f, x, who = cols[at], values[at], np.repeat(np.arange(len(docs)), lens)
            score = np.bincount(who, w[f] * x, len(docs)) + bias
            error = y[docs] - 1 / (1 + np.exp(-np.clip(score, -30, 30)))
            grad = np.bincount(f, error[who] * x, n_features) / len(docs) - l2 * w
            squares += grad ** 2
            w += rate * grad / np.sqrt(squares)
            g = float(error.mean())
            bias_squares += g * g
            bias += rate * g / np.sqrt(bias_squares)
    return w, bias, prior


def train(texts: pa.Array, labels: dict[str, np.ndarray]) -> Model:
    """Fit each label (an array with NaN where it is unknown) on the same texts."""
    stretches, shapes = [], []
    for a, d, b, e in slices(texts):
        row, word, uniq, start, end = words_of(d, b, e)
        stretches.append((row + a, word, d, uniq, start.astype(np.int32), end.astype(np.int32)))
        shapes.append(shapes_of(d, b, e))
    shapes = np.concatenate(shapes)
    model = Model()
    for label, given in labels.items():
        docs = np.flatnonzero(~np.isnan(given))
        y = (given[docs] >= 0.5).astype(float)
        if not len(docs) or y.min() == y.max():
            continue
        place = np.full(len(texts), -1)
        place[docs] = np.arange(len(docs))
        prior = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        keys = [np.arange(SHAPES * STEPS, dtype=np.uint64)]
        rows, cols, values = [np.repeat(np.arange(len(docs)), SHAPES)], [shapes[docs].ravel()], [np.ones(len(docs) * SHAPES)]
        n_keys = SHAPES * STEPS
        for kind in range(1 + len(PREFIXES) * USES_STEMS[label]):
            r = np.concatenate([place[row] for row, *_ in stretches])
            f = np.concatenate([word_features(*words, kind)[word] for _, word, *words in stretches])
            ok = (r >= 0) & (f != 0)
            r, f = r[ok], f[ok]
            uniq, slot = np.unique(f, return_inverse=True)
            pair, count = np.unique(slot * len(docs) + r, return_counts=True)
            slot, r = pair // len(docs), pair % len(docs)
            df = np.bincount(slot, minlength=len(uniq))
            hits = np.bincount(slot, y[r], len(uniq))
            z = (hits - df * prior) / np.sqrt(np.maximum(df * prior * (1 - prior) * np.maximum(1 - df / len(docs), 1 / len(docs)), 1e-12))
            use = (df >= MIN_DOCS) & (np.abs(z) >= MIN_Z)
            number = np.cumsum(use) - 1 + n_keys
            keep = use[slot]
            keys.append(uniq[use])
            rows.append(r[keep])
            cols.append(number[slot[keep]])
            values.append(np.minimum(count[keep], 3).astype(float))
            n_keys += int(use.sum())
        rows, cols, values, keys = (np.concatenate(x) for x in (rows, cols, values, keys))
        order = np.argsort(rows, kind="stable")
        w, model.bias[label], model.rate[label] = fit_logistic(rows[order], cols[order], values[order], y, n_keys)
        model.shape_weights[label] = w[:SHAPES * STEPS]
        by = np.argsort(keys[SHAPES * STEPS:])
        model.keys[label], model.weights[label] = keys[SHAPES * STEPS:][by], w[SHAPES * STEPS:][by]
    return model


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = 6000) -> Model:
    """Fit both labels on a sample of the labelled documents."""
    need(labels, "doc_id", "quality", "toxic")
    known = (labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.avg("quality").alias("good"), F.avg("toxic").alias("toxic")))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    picked = known.filter(draw < (max_fit / total if total > max_fit else 1.0))
    sample = (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__raw"))
              .join(bounded_broadcast(picked, 4 * max_fit), "doc_id"))

    got = sample.toArrow()
    if not got.num_rows:
        return Model()
    got = got.sort_by([("doc_id", "ascending"), ("__raw", "ascending")])  # the fit must not depend on the order of tasks
    values = {x: got.column(x).cast(pa.float64()).fill_null(np.nan).to_numpy() for x in LABELS}
    return train(got.column("__raw").combine_chunks(), values)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``__good`` and ``__toxic``: log odds of the classifier, null
    where there is no model of the label. Texts pass once, in small batches."""
    schema = T.StructType([*docs.schema.fields, *[T.StructField(f"__{x}", T.DoubleType()) for x in LABELS]])
    at = [c.lower() for c in docs.columns].index("text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for batch in batches:
            # a null text has no bytes in Spark's batches
            for first, data, begins, ends in slices(batch.column(at).cast(pa.binary())):
                odds = _odds(model, data, begins, ends)
                part = batch.slice(first, len(begins))
                cols = [pa.array(odds[x], pa.float64()) if x in odds else pa.nulls(len(begins), pa.float64()) for x in LABELS]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], schema.names)

    return docs.mapInArrow(lambda it: tidy(run(it)), schema)


def _odds(model: Model, data, begins, ends) -> dict:
    row, word, *words = words_of(data, begins, ends)
    shapes = shapes_of(data, begins, ends)
    odds = {}
    for x in model.bias:
        w = np.zeros(len(words[0]))
        for kind in range(1 + len(PREFIXES) * USES_STEMS[x]) if len(model.keys[x]) else ():
            f = word_features(data, *words, kind)
            at = np.minimum(np.searchsorted(model.keys[x], f), len(model.keys[x]) - 1)
            w += np.where(model.keys[x][at] == f, model.weights[x][at], 0.0)
        odds[x] = np.bincount(row, w[word], len(begins)) + model.shape_weights[x][shapes].sum(axis=1) + model.bias[x]
    return odds


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def path_sums(scored: DataFrame, labels) -> DataFrame:
    """Documents and summed probabilities per path, from one pass over all documents;
    written to the shared folder, as every rate starts from it."""
    p = {x: 1 / (1 + F.exp(-F.col(f"__{x}"))) for x in labels}
    return cut_lineage(scored.groupBy("__host", "__path").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(p[x]).alias(f"s_{x}") for x in labels]))


def path_rates(sums: DataFrame, label: str) -> DataFrame:
    """(__host, __path, rate): the posterior rate of each path for one label."""
    paths = sums.select("__host", "__path", "n", F.col(f"s_{label}").alias("s"))
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    top = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(max((top["s"] or 0.0) / max(top["n"] or 0, 1), 1e-4), 1 - 1e-4)

    def strength(groups: DataFrame, n: str, s: str, centre: Column) -> float:
        """Beta prior strength from the spread of group rates around their parents'."""
        rate = F.col(s) / F.col(n)
        row = groups.agg(F.sum(F.col(n) * (rate - centre) ** 2).alias("q"), F.sum(n).alias("n"),
                         F.count(F.lit(1)).alias("g"), F.sum(centre * (1 - centre)).alias("noise")).first()
        if not row["n"]:
            return 1.0
        spread = max((row["q"] - row["noise"]) / row["n"], 1e-6)
        return min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)

    k_host = strength(hosts, "hn", "hs", F.lit(mean))
    hosts = hosts.withColumn("host_rate", (F.col("hs") + k_host * mean) / (F.col("hn") + k_host))
    both = paths.join(hosts, "__host")
    k_path = strength(both, "n", "s", F.col("host_rate"))
    rate = (F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path)
    return both.select("__host", "__path", F.least(F.greatest(rate, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("rate"))


def quality(docs: DataFrame, model: Model, host: Column, path: Column, min_good: float = 0.5, max_toxic: float = 0.5,
            columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with the columns of OUT; ``columns`` names what else is
    returned (default: everything)."""
    need(docs, "text")
    d = without(docs, *OUT)
    columns = d.columns if columns is None else columns
    d = d.withColumn("__host", key_of(host)).withColumn("__path", key_of(path))
    known = [x for x in LABELS if x in model.bias]
    if "text" in [c.lower() for c in columns]:
        # texts are scored twice rather than stored: once for the rates, once for the rows
        lean, out = score(d.select("text", "__host", "__path"), model), score(d, model)
    else:
        rest = [F.col(f"`{c}`") for c in columns]
        lean = out = cut_lineage(score(d.select("text", "__host", "__path", *rest), model).drop("text"))
    sums = path_sums(lean, known) if known else None
    for label, neutral in (("good", 1.0), ("toxic", 0.0)):
        if label not in known:
            out = out.withColumn(f"p_{label}", F.lit(neutral))
            continue
        rates = bounded_broadcast(cut_lineage(path_rates(sums, label).withColumnRenamed("rate", f"__r_{label}")), 1 << 18)
        start = float(np.log(model.rate[label] / (1 - model.rate[label])))
        out = out.join(rates, ["__host", "__path"]).withColumn(
            f"p_{label}", 1 / (1 + F.exp(-(F.col(f"__{label}") - start + _logit(F.col(f"__r_{label}"))))))
    out = out.withColumn("kept", (F.col("p_good") >= min_good) & (F.col("p_toxic") < max_toxic))
    return out.select(*[F.col(f"`{c}`") for c in columns], *OUT)


def site_of_documents() -> tuple[Column, Column]:
    """Documents have no URL: their source is the host, and its languages the paths."""
    return F.col("source"), F.concat_ws("/", key_of(F.col("source")), key_of(F.col("lang")))


def op3_quality_bayes(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return quality(docs, model, *site_of_documents(), columns=["doc_id"])
