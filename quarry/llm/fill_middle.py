"""Operator 13: fill-in-the-middle by an indexable skip list.

A text's units (a run of ASCII letters, or any other single character) are the nodes
of the bottom lane of a skip list. Each express lane keeps the nodes of the lane
below whose hashed rank ends in ``STEP_BITS`` more zero bits, and each link carries
two widths: how many units and how many code points it passes. To reach a cut, the
search goes right while the units passed stay within the cut's rank, then a lane
down; the code points passed with them are the place of the cut in the text.

A document's cuts and form come from a hash of its id, so they don't depend on
partitioning. The text is cut into prefix, middle and suffix at two ranks:

* plain: the text itself, if it is empty, holds a sentinel, or is dealt so;
* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

No shuffle: one ``mapInArrow``; a task holds one Arrow batch and the lanes of one text.

Defined cases: a null text is empty, an empty text is plain with no units; a very
long text takes about twelve bytes of lanes a unit; a null id hashes as the empty
text; rows that repeat are cut alike; an empty table gives an empty result; columns
of the input named like an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import need, read_table, without
from quarry.llm.textvec import MULT, mix64

# The sentinels of the output.
PRE, SUF, MID = "<P>", "<S>", "<M>"
OUT = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output", "restored")
STEP_BITS = 3  # an express lane keeps about an eighth of the lane below

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def unit_starts(raw: bytes) -> tuple:
    """Code point place of each unit of a UTF-8 text, and the number of code points."""
    data = np.frombuffer(raw, np.uint8)
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    start = point.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    at = np.flatnonzero(start)
    n_points = int(np.count_nonzero(point))
    if n_points < len(data):
        at = np.cumsum(point, dtype=np.int32)[at] - 1
    return at, n_points


class SkipList:
    """Lanes over nodes of unit width 1; every link has a width in units and one in code points."""

    def __init__(self, starts: np.ndarray, n_points: int):
        self.n = n = len(starts)
        ranks, places = np.arange(n, dtype=np.int64), starts.astype(np.int64)
        coin = mix64((ranks.astype(np.uint64) + np.uint64(1)) * MULT)
        self.lanes = []  # bottom first: (units, code points, node of the lane below)
        down = ranks
        bits = 0
        while True:
            units = np.diff(ranks, append=n).astype(np.int32)
            points = np.diff(places, append=n_points).astype(np.int32)
            self.lanes.append((units, points, down.astype(np.int32)))
            if len(ranks) <= 8:
                return
            bits += STEP_BITS
            kept = (coin & np.uint64((1 << bits) - 1)) == 0
            kept[0] = True  # the first node heads every lane
            down = np.flatnonzero(kept)
            if len(down) == len(ranks):
                return
            ranks, places, coin = ranks[down], places[down], coin[down]

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank; rank n is the end of the text."""
        node = units = points = 0
        for level in range(len(self.lanes) - 1, -1, -1):
            wide, chars, down = self.lanes[level]
            while node < len(wide) and units + int(wide[node]) <= rank:
                units += int(wide[node])
                points += int(chars[node])
                node += 1
            if units == rank:
                return points
            if level:
                node = int(down[node])
        return points


def draws(doc_id, seed: int) -> list:
    """Four unsigned 32-bit numbers of an id."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k:k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, doc_id, seed: int = 1, fim_pct: int = 90, spm_pct: int = 20):
    """(units, form, prefix code points, middle code points, output) of one text."""
    starts, n_points = unit_starts(text.encode())
    n = len(starts)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PRE in text or SUF in text or MID in text or h3 % 100 >= fim_pct:
        return n, "plain", None, None, text
    ranks = h1 % (n + 1), h2 % (n + 1)
    nodes = SkipList(starts, n_points)
    a, b = nodes.place(min(ranks)), nodes.place(max(ranks))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_pct:
        return n, "spm", a, b - a, f"{SUF}{suffix}{PRE}{prefix}{MID}{middle}"
    return n, "psm", a, b - a, f"{PRE}{prefix}{SUF}{suffix}{MID}{middle}"


def restore(output: str, form: str) -> str:
    """The text from an output and its form: no sentinel is in the text, and none can
    arise across a border, so the first of each is the one put there."""
    if form == "plain":
        return output
    second = PRE if form == "spm" else SUF
    rest, middle = output[3:].split(MID, 1)
    one, two = rest.split(second, 1)
    return two + middle + one if form == "spm" else one + middle + two


def fill_middle(docs: DataFrame, seed: int = 1, fim_pct: int = 90, spm_pct: int = 20, with_text: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the columns of OUT (the last
    two, the output and the restored text, only with ``with_text``)."""
    need(docs, "doc_id", "text")
    d = without(docs, *OUT)
    keep = [c for c in d.columns if c.lower() != "text"]
    d = d.select(*[F.col(f"`{c}`") for c in keep], F.col("doc_id").cast("string").alias("__id"),
                 F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType()] + [T.StringType()] * 4
    names = OUT if with_text else OUT[:6]
    schema = T.StructType([d.schema[c] for c in keep] + [T.StructField(n, k) for n, k in zip(names, kinds)])
    arrow = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + [pa.string()] * 4

    def run(batches):
        for batch in batches:
            cols = [[] for _ in names]
            for key, cell in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1)):
                n, form, prefix, middle, output = transform(cell.as_py(), key, seed, fim_pct, spm_pct)
                again = restore(output, form)
                row = (n, form, prefix, middle, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256(again.encode()).hexdigest(), output, again)
                for col, value in zip(cols, row):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(c, k) for c, k in zip(cols, arrow)], schema.names)

    return d.mapInArrow(run, schema)


def op13_fill_middle(spark, sf_dir: str) -> DataFrame:
    return fill_middle(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t),
p AS (
  SELECT *, CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 >= 90 THEN 'plain'
      WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form,
    coalesce(array_to_string(list_slice(u, 1, least(a, b)), ''), '') AS pre,
    coalesce(array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), ''), '') AS mid,
    coalesce(array_to_string(list_slice(u, greatest(a, b) + 1, n), ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
    ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN x ELSE pre || mid || suf END) AS restored_sha256 FROM p
"""
