"""Operator 1: language identification by a linear-chain conditional random field.

Each word of a text is a position of the chain. Its features are hashed affixes (1
to 4 bytes), inner n-grams (2 to 4 bytes), and for every language whether the word
is in that language's learned lexicon; transitions between labels are learned too.
Forward-backward gives every word a distribution over languages; the document's
language is the one with the largest mean, and the mean is its score.

Training: labelled documents are sampled by a hash of their id, about
``per_lang`` for each language, and ``excerpt`` characters from a hashed place of
each go to the driver (both are the documented bounds of the fit). Words take their
document's label; training chains splice stretches of different documents, so that
switches of language within a text, and how rarely they happen, are learned.

Prediction reads whole texts. Long chains are exact: a text is cut into cells, each
cell's transfer matrix is the product over its words, cells are chained by those
matrices, and positions are filled in from both ends. Repeated words of a stretch
are scored once.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; equal
means go to the first language in code point order; without any labelled document
everything is ``und``; rows that repeat are judged alike; clashing names are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import need, read_table, without
from quarry.llm.textvec import MULT, ascii_lower_table, mix64, ranges, slices, span_hashes, word_spans

OUT = ("lang_pred", "score", "lang_shares", "n_switches")
BITS = 18        # hashed features
CELL = 64        # words per cell of a chain
MAX_LANGS = 250  # more distinct labels than this raise an error
UND = "und"


def letter_bytes() -> np.ndarray:
    """Bytes of words: ASCII letters and everything beyond ASCII."""
    t = np.zeros(256, bool)
    t[65:91] = t[97:123] = t[128:] = True
    return t


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray   # features x languages, float32
    moves: np.ndarray     # from language x to language
    lexicon: np.ndarray   # sorted word hashes
    lex_lang: np.ndarray  # the language of each

    def emissions(self, part, start, end, word_hash):
        rows, feats = features(part, start, end)
        out = np.add.reduceat(self.weights[feats], rows).astype(np.float64) if len(start) else np.zeros((0, len(self.langs)))
        at = np.searchsorted(self.lexicon, word_hash)
        at = np.minimum(at, max(len(self.lexicon) - 1, 0))
        known = self.lexicon[at] == word_hash if len(self.lexicon) else np.zeros(len(start), bool)
        which = np.where(known, self.lex_lang[at] if len(self.lexicon) else 0, -1)
        return out + self.weights[lexicon_feature(which)]


def lexicon_feature(which: np.ndarray) -> np.ndarray:
    """Feature of lexicon membership; -1 stands for a word of no lexicon."""
    key = mix64((which + 2).astype(np.uint64) * MULT + np.uint64(77))
    return (key >> np.uint64(64 - BITS)).astype(np.int64)


def features(part: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Hashed affixes and n-grams of words: where each word's features begin, and the
    features, word by word."""
    fold = ascii_lower_table()
    padded = np.zeros(len(part) + 8, np.uint8)
    padded[:len(part)] = fold[part]
    view = np.ndarray(shape=(len(part) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = end - start
    who, keys = [], []

    def add(words, at, size, kind):
        gram = view[at] << np.uint64(64 - 8 * size)
        who.append(words)
        keys.append((mix64(gram + mix64(np.full(1, kind * 16 + size, np.uint64))) >> np.uint64(64 - BITS)).astype(np.int64))

    every = np.arange(len(start))
    for size in (1, 2, 3, 4):
        has = np.flatnonzero(length >= size)
        add(has, start[has], size, 1)
        add(has, end[has] - size, size, 2)
        if size > 1:
            n = np.maximum(length - size + 1, 0)
            add(np.repeat(every, n), ranges(start, n), size, 3)
    who, keys = np.concatenate(who), np.concatenate(keys)
    order = np.argsort(who, kind="stable")
    return np.searchsorted(who[order], every), keys[order]


# ---------------------------------------------------------------- chains


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, cell: int = CELL) -> np.ndarray:
    """Label distribution of every word; ``scores`` are the words of all chains, one
    after another. Before its first word a chain is in any label alike."""
    n_labels = scores.shape[1]
    step = np.exp(moves - moves.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    chains = np.flatnonzero(lengths > 0)
    if not len(chains):
        return np.zeros((0, n_labels))
    begins = (np.cumsum(lengths) - lengths)[chains]
    lengths = lengths[chains]
    per = -(-lengths // cell)                      # cells of each chain
    first = np.cumsum(per) - per
    cell_chain = np.repeat(np.arange(len(chains)), per)
    number = np.arange(int(per.sum())) - first[cell_chain]
    at = begins[cell_chain] + number * cell
    size = np.minimum(cell, lengths[cell_chain] - number * cell)
    order = np.argsort(-size, kind="stable")
    size_o, at_o = size[order], at[order]
    active = [int(np.searchsorted(-size_o, -t, side="left")) for t in range(cell)]  # cells longer than t

    transfer = np.broadcast_to(np.eye(n_labels), (len(order), n_labels, n_labels)).copy()
    for t in range(cell):
        k = active[t]
        if not k:
            break
        m = (transfer[:k] @ step) * local[at_o[:k] + t][:, None, :]
        transfer[:k] = m / m.max(axis=(1, 2), keepdims=True)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))

    # chain the cells: longest chains first, so that those still running are a prefix
    into = np.full((len(order), n_labels), 1.0 / n_labels)
    after = np.ones((len(order), n_labels))
    by = np.argsort(-per, kind="stable")
    for j in range(1, int(per.max())):
        c = first[by[:int(np.searchsorted(-per[by], -j, side="left"))]] + j
        v = np.einsum("ca,cab->cb", into[c - 1], transfer[back[c - 1]])
        into[c] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(per.max()) - 1, 0, -1):
        c = first[by[:int(np.searchsorted(-per[by], -j, side="left"))]] + j
        v = np.einsum("cab,cb->ca", transfer[back[c]], after[c])
        after[c - 1] = v / v.sum(axis=1, keepdims=True)

    out = np.empty_like(local)
    state = into[order]
    for t in range(cell):
        k = active[t]
        if not k:
            break
        where = at_o[:k] + t
        v = (state[:k] @ step) * local[where]
        state[:k] = v / v.sum(axis=1, keepdims=True)
        out[where] = state[:k]
    state = after[order]
    for t in range(cell - 1, -1, -1):
        k = active[t]
        if not k:
            continue
        where = at_o[:k] + t
        out[where] *= state[:k]
        v = (local[where] * state[:k]) @ step.T
        state[:k] = v / v.sum(axis=1, keepdims=True)
    return out / out.sum(axis=1, keepdims=True)


def transition_counts(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    """Expected moves between labels, for chains of one cell each (training)."""
    n_labels = scores.shape[1]
    step = np.exp(moves - moves.max())
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    total = np.zeros((n_labels, n_labels))
    width = int(lengths.max())
    begins = np.cumsum(lengths) - lengths
    state = np.full((len(lengths), n_labels), 1.0 / n_labels)
    for t in range(width):
        live = lengths > t
        where = begins[live] + t
        # the pair's distribution given the following words follows from the marginal
        pair = state[live][:, :, None] * step[None] * local[where][:, None, :]
        column = pair.sum(axis=1, keepdims=True)
        total += (pair / np.maximum(column, 1e-300) * gamma[where][:, None, :]).sum(axis=0)
        v = column[:, 0, :]
        state[live] = v / v.sum(axis=1, keepdims=True)
    return total


# ---------------------------------------------------------------- training


def build_lexicon(words: np.ndarray, labels: np.ndarray, n_langs: int, size: int = 4000, purity: float = 0.9):
    """Per language the most frequent words that are nearly always of it."""
    uniq, inverse = np.unique(words, return_inverse=True)
    counts = np.zeros((len(uniq), n_langs))
    np.add.at(counts, (inverse, labels), 1)
    top, total = counts.argmax(axis=1), counts.sum(axis=1)
    pure = (counts.max(axis=1) >= purity * total) & (total >= 3)
    keep = np.zeros(len(uniq), bool)
    for k in range(n_langs):
        mine = np.flatnonzero(pure & (top == k))
        keep[mine[np.argsort(-total[mine], kind="stable")[:size]]] = True
    return uniq[keep], top[keep]


def train(texts: list[tuple[str, str]], seed: int = 7, epochs: int = 4, rate: float = 0.25, l2: float = 1e-6) -> Crf:
    """Fit on (language, text) pairs by stochastic gradients of the chain likelihood."""
    langs = sorted({lang for lang, _ in texts})
    index = {lang: k for k, lang in enumerate(langs)}
    texts = sorted(texts)
    column = pa.array([t.encode() for _, t in texts], pa.binary())
    rng = np.random.default_rng(seed)
    part, words, doc, hashes = b"", [], [], []
    offset = 0
    pieces = []
    for a, data, begins, ends in slices(column):
        row, start, end = word_spans(data, begins, ends, letter_bytes())
        pieces.append(data)
        words.append(np.stack((start + offset, end + offset), axis=1))
        hashes.append(span_hashes(data, start, end, ascii_lower_table()))
        doc.append(row + a)
        offset += len(data)
    part = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    spans, doc, hashes = np.concatenate(words), np.concatenate(doc), np.concatenate(hashes)
    label_of = np.array([index[lang] for lang, _ in texts])
    label = label_of[doc]
    n_langs = len(langs)
    lexicon, lex_lang = build_lexicon(hashes, label, n_langs)
    model = Crf(langs, np.zeros((1 << BITS, n_langs), np.float32), np.zeros((n_langs, n_langs)), lexicon, lex_lang)
    if n_langs < 2 or not len(label):
        return model

    # stretches of 4 to 40 words of one document, spliced in random order
    cuts, k = [], 0
    steps = rng.integers(4, 41, size=len(label) // 4 + 2)
    limits = np.concatenate((np.flatnonzero(np.diff(doc)) + 1, [len(doc)]))
    at, limit = 0, 0
    while at < len(doc):
        while limits[limit] <= at:
            limit += 1
        to = min(at + int(steps[k]), int(limits[limit]))
        cuts.append((at, to))
        at, k = to, k + 1
    order = rng.permutation(len(cuts))
    flow = np.concatenate([np.arange(*cuts[c]) for c in order])
    n_chains = -(-len(flow) // CELL)
    uniq, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    f_at, feats = features(part, spans[first, 0], spans[first, 1])
    f_len = np.diff(np.concatenate((f_at, [len(feats)])))
    where = np.minimum(np.searchsorted(lexicon, uniq), max(len(lexicon) - 1, 0))
    known = lexicon[where] == uniq if len(lexicon) else np.zeros(len(uniq), bool)
    lex_feat = lexicon_feature(np.where(known, lex_lang[where] if len(lexicon) else 0, -1))
    squares, move_squares = np.full((1 << BITS, n_langs), 1e-2, np.float32), np.full((n_langs, n_langs), 1e-2)
    for _ in range(epochs):
        chains = rng.permutation(n_chains)
        for b in range(0, n_chains, 128):
            picked = [flow[c * CELL:(c + 1) * CELL] for c in chains[b:b + 128]]
            lengths = np.array([len(p) for p in picked])
            pos = np.concatenate(picked)
            u, inv = np.unique(inverse[pos], return_inverse=True)
            lens = f_len[u]
            flat = feats[ranges(f_at[u], lens)]
            heads = np.cumsum(lens) - lens
            e = np.add.reduceat(model.weights[flat], heads).astype(np.float64) + model.weights[lex_feat[u]]
            scores = e[inv]
            gamma = marginals(scores, lengths, model.moves)
            diff = -gamma
            diff[np.arange(len(pos)), label[pos]] += 1
            grad_u = np.zeros((len(u), n_langs))
            np.add.at(grad_u, inv, diff)
            spread = np.repeat(grad_u, lens, axis=0)
            ids = np.concatenate((flat, lex_feat[u]))
            spread = np.concatenate((spread, grad_u)) / len(picked)
            touched, slot = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(slot, spread[:, c], len(touched)) for c in range(n_langs)], axis=1)
            grad -= l2 * model.weights[touched]
            squares[touched] += grad ** 2
            model.weights[touched] += (rate * grad / np.sqrt(squares[touched])).astype(np.float32)
            seen = np.zeros((n_langs, n_langs))
            inner = np.ones(len(pos), bool)
            inner[np.cumsum(lengths) - lengths] = False
            np.add.at(seen, (label[pos[np.flatnonzero(inner) - 1]], label[pos[np.flatnonzero(inner)]]), 1)
            move_grad = (seen - transition_counts(scores, lengths, model.moves, gamma)) / len(picked)
            move_squares += move_grad ** 2
            model.moves += rate * move_grad / np.sqrt(move_squares)
    return model


def fit(docs: DataFrame, labelled: Column, per_lang: int = 400, excerpt: int = 1500) -> Crf:
    """Sample labelled documents and train. Counting languages reads two columns."""
    known = docs.filter(F.coalesce(labelled, F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} distinct languages")
    if not counts:
        return Crf([], np.zeros((1 << BITS, 0), np.float32), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_lang / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    room = F.greatest(F.length("text") - excerpt, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64(F.lit("place"), "doc_id"), room.cast("long")) + 1).cast("int")
    rows = known.filter(draw < share).select("lang", F.substring(F.col("text"), start, F.lit(excerpt)).alias("t")).collect()
    return train([(r["lang"], r["t"]) for r in rows])


# ---------------------------------------------------------------- prediction


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore"))


def predict_column(model: Crf, column: pa.Array):
    """Per text: mean distribution over languages (zeros for ``und``) and switches."""
    n_langs = len(model.langs)
    means, switches = [], []
    inside = letter_bytes()
    for _, data, begins, ends in slices(column):
        row, start, end = word_spans(data, begins, ends, inside)
        ascii_ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(inside[data] & (data < 128), out=ascii_ends[1:])
        plain = ascii_ends[end] > ascii_ends[start]
        h = span_hashes(data, start, end, ascii_lower_table())
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        word = np.array([plain[k] or has_letter(data[start[k]:end[k]].tobytes()) for k in first], bool)
        keep = word[inverse] if len(first) else np.zeros(0, bool)
        row, inverse = row[keep], inverse[keep]
        mean, moved = np.zeros((len(begins), n_langs)), np.zeros(len(begins), np.int64)
        if len(row) and n_langs:
            e = model.emissions(data, start[first], end[first], uniq)
            lengths = np.bincount(row, minlength=len(begins))
            gamma = marginals(e[inverse], lengths, model.moves)
            has = np.flatnonzero(lengths)
            mean[has] = np.add.reduceat(gamma, (np.cumsum(lengths) - lengths)[has]) / lengths[has][:, None]
            best = gamma.argmax(axis=1)
            changed = np.flatnonzero((best[1:] != best[:-1]) & (row[1:] == row[:-1]))
            moved = np.bincount(row[changed], minlength=len(begins))
        means.append(mean)
        switches.append(moved)
    return (np.concatenate(means) if means else np.zeros((0, n_langs))), (np.concatenate(switches) if switches else np.zeros(0, np.int64))


def predict(docs: DataFrame, model: Crf) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the columns of OUT."""
    need(docs, "text")
    d = without(docs, *OUT)
    keep = [c for c in d.columns if c.lower() != "text"]
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("__raw"))
    schema = T.StructType([d.schema[c] for c in keep] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("lang_shares", T.ArrayType(T.DoubleType())), T.StructField("n_switches", T.LongType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        names = np.array([*model.langs, UND], object)
        for batch in batches:
            mean, moved = predict_column(model, batch.column("__raw"))
            best = mean.argmax(axis=1) if len(model.langs) else np.zeros(len(mean), np.int64)
            score = mean.max(axis=1) if len(model.langs) else np.zeros(len(mean))
            best = np.where(score > 0, best, len(model.langs))
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))]
                + [pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()),
                   pa.array(mean.tolist(), pa.list_(pa.float64())), pa.array(moved, pa.int64())], schema.names)

    return d.mapInArrow(run, schema)


def op1_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = fit(docs.select("doc_id", "text", "lang"), part != 2)
    return predict(docs.select("doc_id", (part == 2).alias("held_out"), "text"), model)
