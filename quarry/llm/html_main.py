"""Operator 4: main text of web pages, with a suffix array per host for boilerplate.

1. A page is cut into blocks (runs of text between block elements). Elements that
   never hold article text (menus, footers, forms, scripts, ..., or whose class, id
   or role says so) make their blocks furniture. If the page has an article or main
   element, the blocks in it that aren't furniture are its element's blocks. Forms and
   hinted wrappers around such an element, or around most of a page's text, don't hide
   it; elements of comments, advertising and related pages do.
2. All blocks outside the element, and those of its blocks that stand on most pages of
   the host (``usual_blocks``), are the page's token stream: lower-case words, one
   space apart. Streams of a host are searched for substrings of ``window`` bytes that
   stand on distinct pages, by suffix arrays (``repeats``; strings match inside a host
   only). Runs of a host are dealt to buckets by their anchors, so a host with a third
   of all pages is spread over tasks.
3. An element's blocks are the main text, less the usual ones whose words the repeated
   substrings cover. Pages without an element keep their other blocks that aren't
   furniture, less the words covered; blocks left empty go.

Articles are copied and quote each other, so a block of an element is put to the search
only if ``USUAL`` of the host's different articles hold it, ``FEWEST`` at least (copies
of an article count once), and only where such blocks are less than half of the text:
a copy, even with changes, shares nearly all of its text with the others.

A page is parsed once; its parts are checkpointed.

White space in a block becomes one space, blocks are joined by one line feed. Defined
cases: null or empty html, or a page without text, give the empty text; a null url is
a host of its own; pages with a null id keep their repeated runs; repeated rows are
one page to the search, as are rows of one id; markup that is cut off ends where the
page ends; clashing column names are replaced.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.exprs import bounded_broadcast
from quarry.llm.common import need, read_table, without
from quarry.llm.repeats import repeated_spans, same_row, unpack
from quarry.session import cut_lineage

OUT = ("text", "n_chars", "n_blocks_removed")

# Element names of HTML by their use here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe svg select button textarea "
                      "menu dialog object canvas head title option audio video map datalist label fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section "
                  "summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = ("article", "main")
TEASER = 4  # an article element of less than a quarter of the longest is a teaser
USUAL = (4, 5)  # share of a host's different articles that hold a usual block
FEWEST = 4  # and the least number of them
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
                  "notice notices alert popup modal overlay toast sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs "
                  "pagination pager footer header masthead topbar toolbar comment comments disqus reply replies share sharing social "
                  "related recommended recommendations newsletter subscribe subscription signup login search widget widgets copyright "
                  "legal disclaimer skip".split())
BESIDE = frozenset("with has no without".split())
AROUND = frozenset("content layout page wrapper wrap container main body article post story site".split())
OTHERS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply "
                   "replies related recommended recommendations".split())
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

TAG = re.compile(r"""<(?:!--(?:.*?--!?>|>|->)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|[!?/][^>]*>)""", re.DOTALL)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
HINT = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")


def furniture_hint(name: str, attributes: str) -> str:
    """What an element's attributes say: 'no' article text at all, 'other' people's or
    other pages' text, perhaps a 'layout' around the article, or nothing."""
    out = ""
    for key, value in HINT.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES:
            return "no"
        for one in value.split() if key in ("class", "id") else ():
            words = [w for w in re.split(r"[^a-z]+", one) if w]
            hinted = [w for w in words if w in HINTS]
            # "content-with-sidebar" and "layout-sidebar-right" tell of a sidebar elsewhere
            if not hinted or not BESIDE.isdisjoint(words) or words[-1] not in HINTS and not AROUND.isdisjoint(words):
                continue
            if name in TEXT and len(words) > 1 and words[-1] not in HINTS:
                continue  # a paragraph on "social-science"
            out = "other" if not OTHERS.isdisjoint(hinted) or out == "other" else "layout"
    return out


def blocks_of(page: str, spared: frozenset = frozenset()) -> list[tuple]:
    """(text, furniture, container, root, number) of each block that has text, in page
    order. container: the outermost article or main element around it, or nothing, and
    its number; root: the number of the form or hinted element that makes it
    furniture, which may be spared, else -1."""
    out: list[tuple] = []
    open_elements: list[tuple] = []
    start = (False, "", -1, -1)
    state = start
    buffer: list[str] = []
    at, n, number = 0, len(page), 0

    def close_block():
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((text, *state))

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append(page[at:])
            break
        if lt > at:
            buffer.append(page[at:lt])
        if page.startswith("<!--", lt) and page.find("-->", lt) < 0:
            break  # a comment that never ends
        m = TAG.match(page, lt) or LOOSE.match(page, lt)
        if m is None:
            buffer.append("<")  # a sign that opens no tag
            at = lt + 1
            continue
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        is_block = name in BLOCK
        if m.group(1):  # an end tag closes its element and what is still open inside
            if any(e[0] == name for e in open_elements):
                if is_block or name in FURNITURE:
                    close_block()
                while open_elements.pop()[0] != name:
                    pass
                new = open_elements[-1][1:] if open_elements else start
                if new != state:
                    close_block()
                    state = new
            elif is_block:
                close_block()
            continue
        if name == "br":
            buffer.append(" ")
            continue
        attributes = m.group(3) or ""
        if is_block:
            close_block()
            for k in range(len(open_elements) - 1, -1, -1):  # a block ends an open paragraph
                if open_elements[k][0] == "p":
                    del open_elements[k:]
                    state = open_elements[-1][1:] if open_elements else start
                    break
                if open_elements[k][0] in BLOCK:
                    break
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        number += 1
        furniture, container, root, which = state
        hint = furniture_hint(name, attributes) if attributes and name not in ("html", "body", "main") else ""
        if name in CONTAINERS and furniture and root >= 0 and hint == "":
            furniture, root = False, -1  # the layout or form around an article doesn't hide it
        if not furniture:
            if name in FURNITURE and name != "form" and not (name == "header" and container) or hint == "no":
                furniture = True
            elif hint == "other":
                furniture = True
            elif (name == "form" or hint == "layout" and name not in CONTAINERS) and number not in spared:
                furniture, root = True, number
        if not container and name in CONTAINERS and not furniture:
            container, which = name, number
        new = (furniture, container, root, which)
        if new != state:
            close_block()
            state = new
        open_elements.append((name, *new))
    close_block()
    return out


def split_page(page: str | None) -> tuple[str | None, list[str], list[bool]]:
    """The main text if an element holds it, else None; the other blocks, and which
    of them are furniture. Of several article elements those stay that are no shorter
    than a ``TEASER`` of the longest. Without one, a form or a hinted wrapper that
    holds most of the page's text is no furniture."""
    spared: frozenset = frozenset()
    while True:
        blocks = blocks_of(page or "", spared)
        for name in CONTAINERS:
            sizes: dict = {}
            for text, furniture, where, _, number in blocks:
                if where == name and not furniture:
                    sizes[number] = sizes.get(number, 0) + len(text)
            keep = {k for k, v in sizes.items() if v * TEASER >= max(sizes.values())}
            inside = {k for k, b in enumerate(blocks) if b[4] in keep and b[2] == name and not b[1]}
            if inside:
                teasers = sizes.keys() - keep
                rest = [b for k, b in enumerate(blocks) if k not in inside]
                return ("\n".join(blocks[k][0] for k in sorted(inside)), [b[0] for b in rest],
                        [b[1] or b[2] == name and b[4] in teasers for b in rest])
        roots: dict = {}
        for text, _, _, root, _ in blocks:
            roots[root] = roots.get(root, 0) + len(text)
        most = [r for r, size in roots.items() if r >= 0 and 2 * size > sum(roots.values())]
        if not most:
            return None, [b[0] for b in blocks], [b[1] for b in blocks]
        spared |= frozenset(most)


def stream_of(blocks: list[str]) -> bytes:
    """The token stream: words in lower case, one space apart and one at the end."""
    return "".join(w + " " for b in blocks for w in b.lower().split()).encode()


def unique_words(blocks: list[str], furniture: list[bool], spans) -> tuple[str, int]:
    """The blocks that aren't furniture, less words inside the covered spans."""
    starts, ends = unpack(spans)
    out, at, gone = [], 0, 0
    for block, skip in zip(blocks, furniture):
        kept = []
        for w in block.split():
            size = len(w.lower().encode())
            k = int(np.searchsorted(starts, at, side="right")) - 1
            if k < 0 or ends[k] < at + size:
                kept.append(w)
            at += size + 1
        if skip:
            continue
        if kept:
            out.append(" ".join(kept))
        else:
            gone += 1
    return "\n".join(out), gone


PARTS = [T.StructField("__main", T.StringType()), T.StructField("__blocks", T.ArrayType(T.StringType())),
         T.StructField("__furniture", T.ArrayType(T.BooleanType()))]


def parse(pages: DataFrame) -> DataFrame:
    """``pages`` with ``html`` replaced by its parts."""
    d = pages.withColumn("__html", F.col("html")).drop("html")
    schema = T.StructType([*d.schema.fields[:-1], *PARTS])

    def run(batches):
        for batch in batches:
            got = [split_page(x) for x in batch.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(batch.num_columns - 1)]
                + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string())),
                   pa.array([g[2] for g in got], pa.list_(pa.bool_()))],
                schema.names)

    return d.mapInArrow(run, schema)


def block_hash(block: Column) -> Column:
    return F.xxhash64(F.lower(block))


def usual_blocks(parsed: DataFrame) -> DataFrame:
    """(host, usual): hashes of the blocks that most of a host's different articles hold.
    Only hashes are shuffled; a host has few such blocks, whatever its pages."""
    hashes = F.array_distinct(F.transform(F.split("__main", "\n"), block_hash))
    articles = (parsed.filter("__main IS NOT NULL")
                .select(F.col("__host").alias("host"), F.xxhash64("__main").alias("article"), hashes.alias("hashes"))
                .dropDuplicates(["host", "article"]))
    held = articles.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = articles.groupBy("host").agg(F.count(F.lit(1)).alias("articles"))
    share, of = USUAL
    return (held.filter(F.col("n") >= FEWEST).join(sizes, "host").filter(F.col("n") * of >= F.col("articles") * share)
            .groupBy("host").agg(F.collect_list("h").alias("__usual")).withColumnRenamed("host", "__host"))


def with_streams(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``__asked``, the usual blocks of the page's element that are put to
    the search, and its token stream, in which they follow the other blocks."""
    usual = cut_lineage(usual_blocks(parsed))
    d = parsed.join(bounded_broadcast(usual), "__host", "left")
    asked = F.filter(F.split("__main", "\n"), lambda b: F.array_contains("__usual", block_hash(b)))
    d = d.withColumn("__asked", F.when(F.col("__usual").isNotNull() & F.col("__main").isNotNull(), asked)).drop("__usual")
    few = 2 * F.length(F.array_join("__asked", "\n")) < F.length("__main")
    d = d.withColumn("__asked", F.when(few & (F.size("__asked") > 0), F.col("__asked")))
    schema = T.StructType([*d.schema.fields, T.StructField("__stream", T.BinaryType())])

    def run(batches):
        for batch in batches:
            got = [stream_of(b + (a or [])) for b, a in zip(batch.column("__blocks").to_pylist(), batch.column("__asked").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], schema.names)

    return d.mapInArrow(run, schema)


def less_usual(main: str, asked: list[str], blocks: list[str], spans) -> tuple[str, int]:
    """The element's blocks, less those of ``asked`` whose words are all covered.
    ``blocks``: the page's other blocks, which precede them in its stream."""
    starts, ends = unpack(spans)
    at, gone = len(stream_of(blocks)), set()
    for block in asked:
        size = len(stream_of([block]))
        k = int(np.searchsorted(starts, at, side="right")) - 1
        if k >= 0 and ends[k] >= at + size - 1:  # the space at the end may differ
            gone.add(block)
        at += size
    kept = [b for b in main.split("\n") if b not in gone]
    return "\n".join(kept), main.count("\n") + 1 - len(kept)


def main_text(pages: DataFrame, window: int = 40) -> DataFrame:
    """All rows and columns of ``pages`` but the html, with the columns of OUT."""
    need(pages, "page_id", "url", "html")
    d = without(pages, *OUT)
    keep = [c for c in d.columns if c.lower() != "html"]
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), "://([^/?#]*)", 1))
    host = F.when(F.col("url").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), host))
    total = d.agg(F.sum(F.octet_length("html").cast("long"))).first()[0] or 0
    parsed = with_streams(cut_lineage(parse(d.withColumn("__host", host))))
    spans = (repeated_spans(parsed.select("page_id", "__host", "__stream"), F.col("page_id"), F.col("__stream"), F.col("__host"),
                            window=window, smaller=False, total_bytes=total // 4, tagged=True)
             .groupBy("id", "tag").agg(F.collect_list("span").alias("__spans")))
    cols = [F.col(f"`{c}`") for c in keep]
    settled = F.col("__main").isNotNull() & F.col("__asked").isNull()
    whole = parsed.filter(settled).select(
        *cols, F.col("__main").alias("text"), F.lit(0).cast("long").alias("n_blocks_removed"))
    parts = ["__main", "__asked", "__blocks", "__furniture", "__spans"]
    joined = parsed.filter(~settled).join(spans, same_row(F.col("page_id"), F.col("__stream")), "left").select(*cols, *parts)
    schema = T.StructType([*[joined.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_blocks_removed", T.LongType())])

    def run(batches):
        for batch in batches:
            got = [unique_words(b, f, s or ()) if m is None else less_usual(m, a, b, s or ())
                   for m, a, b, f, s in zip(*(batch.column(c).to_pylist() for c in parts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in range(len(keep))] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())],
                schema.names)

    both = whole.union(joined.mapInArrow(run, schema))
    return both.select(*cols, "text", F.length("text").cast("long").alias("n_chars"), "n_blocks_removed")


def op4_html_main(spark, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
