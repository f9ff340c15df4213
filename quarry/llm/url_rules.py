"""Operator 8: URL filters by rules that are indexed by their rarest literal token.

A rule is a pattern with a verdict and the literal tokens (runs of ASCII letters
and digits, lower case) that every URL it fits must contain. One pass counts how
many URLs hold each rule token; every rule is filed under its rarest. A URL's own
tokens fetch the rules filed under them, and only those run their regular
expression. A rule without a literal token is tried on every URL.

Two kinds of rules: host rules (a host with its subdomains and a path prefix; the
longest fitting rule decides, block before allow and then the rule's text on
equal lengths) and pattern rules over the whole URL, which decide only where no
host rule fits: block if any blocking pattern fits, else allow.

The index goes to every task: its rules are counted, and more than ``max_rules``
raise an error instead of being broadcast. Rows never leave their partition.

Defined cases: a null URL, or one without ``://``, has empty host and path; no
rule fits it and the verdict is the default. Rows that repeat are judged alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import need, read_table, without

OUT = ("host", "path", "rule", "verdict", "pattern", "n_candidates")


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}"

    @property
    def literals(self) -> list[str]:
        # the last token may go on in the URL unless a delimiter ends it
        found = tokens(self.name)
        return found if not self.name[-1:].isalnum() else found[:-1]


@dataclass(frozen=True)
class PatternRule:
    """``literals``: tokens that stand whole in every URL that the pattern fits."""
    name: str
    regex: str
    literals: tuple[str, ...] = ()
    verdict: str = "block"


# Fixed values of the query's contract: (host, path, verdict).
HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
PATTERN_RULES = (
    PatternRule("spam-host", r"(?i)://(?:[^/?#]*[.-])?spam[.-]farm\.", ("spam", "farm")),
    PatternRule("casino-host", r"(?i)://(?:[^/?#]*[.-])?casino[.-]", ("casino",)),
    PatternRule("adult-host", r"(?i)://(?:[^/?#]*[.-])?xxx[.-]", ("xxx",)),
    PatternRule("sign-in", r"(?i)://[^/?#]*/(?:[^?#]*/)?login(?:[/?#]|$)", ("login",)),
    PatternRule("program-file", r"(?i)\.exe(?:[?#]|$)", ("exe",)),
)


def split_url(url: str | None) -> tuple[str, str]:
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def token_counts(urls: DataFrame, column: str, wanted: Iterable[str]) -> dict[str, int]:
    """URLs that hold each wanted token; at most one row per rule token comes back."""
    spark = urls.sparkSession
    table = spark.createDataFrame([(t,) for t in sorted(set(wanted))], "token string")
    each = F.array_distinct(F.regexp_extract_all(F.lower(F.col(column)), F.lit("[a-z0-9]+"), F.lit(0)))
    rows = (urls.select(F.explode(each).alias("token")).join(F.broadcast(table), "token")
            .groupBy("token").count().collect())
    return {r["token"]: r["count"] for r in rows}


def build_index(rules: Sequence, counts: dict[str, int]) -> tuple[dict[str, list], list]:
    """Rules by their rarest literal token, and the rules that have none."""
    index: dict[str, list] = {}
    always = []
    for rule in rules:
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(rule)
        else:
            always.append(rule)
    return index, always


def judge(url: str | None, index: dict[str, list], always: list, compiled: dict, default: str):
    host, path = split_url(url)
    candidates = [r for t in set(tokens(url or "")) for r in index.get(t, ())] + always
    best, pattern = None, None
    target = host + path
    for r in candidates:
        if isinstance(r, HostRule):
            if host and compiled[r].match(target) and (best is None or _rank(r) < _rank(best)):
                best = r
        elif url is not None and compiled[r].search(url) and (pattern is None or _rank(r) < _rank(pattern)):
            pattern = r
    verdict = best.verdict if best else pattern.verdict if pattern else default
    return host, path, best.name if best else None, verdict, pattern.name if pattern else None, len(candidates)


def _rank(rule) -> tuple:
    length = len(rule.name) if isinstance(rule, HostRule) else 0
    return -length, rule.verdict != "block", rule.name


def filter_urls(pages: DataFrame, host_rules: Sequence[HostRule] = HOST_RULES,
                pattern_rules: Sequence[PatternRule] = PATTERN_RULES, url: str = "url",
                default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """All rows and columns of ``pages`` with the columns of OUT."""
    need(pages, url)
    rules = [*host_rules, *pattern_rules]
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; an index of more than {max_rules} isn't sent to every task")
    counts = token_counts(pages, url, {t for r in rules for t in r.literals}) if rules else {}
    index, always = build_index(rules, counts)
    kind = "struct<host:string,path:string,rule:string,verdict:string,pattern:string,n_candidates:int>"

    @F.pandas_udf(kind)
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compiled = {r: re.compile(r.regex, re.DOTALL) for r in rules}
        for urls in batches:
            rows = [judge(u, index, always, compiled, default) for u in urls]
            yield pd.DataFrame(rows, columns=list(OUT))

    d = without(pages, *[c for c in OUT if c != url]).withColumn("__judged", judged(F.col(url)))
    keep = [F.col(f"`{c}`") for c in d.columns if c != "__judged"]
    return d.select(*keep, *[F.col(f"__judged.{c}").alias(c) for c in OUT])


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    d = filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return d.select("page_id", "host", "path", "rule", "verdict")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u),
s AS (
  SELECT page_id, url, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
f AS (
  SELECT s.*, rhost || rpath AS rule, rverdict,
    row_number() OVER (PARTITION BY page_id, url ORDER BY length(rhost || rpath) DESC NULLS LAST, rverdict DESC, rhost || rpath) AS k
  FROM s LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(rverdict, CASE
    WHEN regexp_matches(url, '(?i)://([^/?#]*[.-])?spam[.-]farm\.') OR regexp_matches(url, '(?i)://([^/?#]*[.-])?casino[.-]')
      OR regexp_matches(url, '(?i)://([^/?#]*[.-])?xxx[.-]') OR regexp_matches(url, '(?i)://[^/?#]*/([^?#]*/)?login([/?#]|$)')
      OR regexp_matches(url, '(?i)\.exe([?#]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM f WHERE k = 1
"""
