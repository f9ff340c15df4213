import random
import re

import numpy as np
import pytest

from quarry.llm.chat import format_chats
from quarry.llm.line_rules import quality_rules
from quarry.llm.url_rules import HOST_RULES, PatternRule, build_index, filter_urls


# ---- line rules
def brute_rules(rows, max_docs, min_words=50, share=0.5):
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def lines(t):
        return [x for x in (t or "").split("\n") if word.search(x)]

    def norm(x):
        return re.sub("[0-9]", "0", re.sub(" +", " ", re.sub(r"[\x09-\x0D]", " ", x).strip(" ")).lower())
    held = {}
    for _, t, host in rows:
        for x in lines(t):
            held.setdefault((host, norm(x)), set()).add(t)
    out = []
    for i, t, host in rows:
        w = word.findall(t or "")
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        again = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)}
        ls = lines(t)
        failed = len(w) < min_words or 100 * len(again) > 50 * len(w)
        left = len(w) - sum(len(word.findall(x)) for x in ls if len(held[host, norm(x)]) > max_docs)
        out.append((str(i), len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(again),
                    failed, not failed and left >= min_words and left >= share * len(w)))
    return sorted(out)


def test_line_rules_match_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(400)] + ["É#", "a|b", "$5", "Of"]
    common = ["Shared  Line 12 of many words here", "cookie\tnotice 99 we all use them"]
    rows = []
    for k in range(60):
        ls = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(rng.choice([0, 1, 6, 14]))]
        ls += [c.replace("12", str(k)) for c in common if rng.random() < 0.6] * rng.choice([1, 1, 8])
        ls += ls[:rng.choice([0, 0, 3])]
        rng.shuffle(ls)
        rows.append((k, "\n".join(ls), rng.choice(["h1", "h2", None])))
    shared = [" ".join(f"s{a}x{b}" for b in range(9)) for a in range(12)]
    rows += [(100 + k, "\n".join([*shared, " ".join(f"own{k}y{b}" for b in range(60))]), "h2") for k in range(9)]
    rows += [(None, None, "h1"), (70, "", None), (71, " \n\t", "h2"), rows[3], rows[3], (72, "x " * 3000, "h1")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, KEPT int")
    got = quality_rules(df, max_docs=7).collect()
    have = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got)
    assert have == brute_rules(rows, 7)
    assert any(not h[6] and not h[7] for h in have) and any(h[7] for h in have)
    assert quality_rules(df.filter("false")).count() == 0


# ---- chats
def brute_chats(rows):
    chats = {}
    for c, t, r, x in rows:
        chats.setdefault(c, []).append((t is not None, t or 0, r is not None, r or "", x is not None, x or ""))
    turns = {c: [(r if hr else None, x if hx else None) for _, _, hr, r, hx, x in sorted(v)] for c, v in chats.items()}
    keep = []
    for c, v in turns.items():
        longer = any(d != c and len(w) > len(v) and w[:len(v)] == v for d, w in turns.items())
        first = min((d for d, w in turns.items() if w == v), key=lambda d: (d is None, d or 0))
        if not longer and first == c:
            keep.append((str(c), "".join(f"<|{r or 'unknown'}|>\n{x or ''}\n<|end|>\n" for r, x in v)))
    return sorted(keep)


@pytest.mark.parametrize("block", [1024, 3])
def test_chats_match_brute_force(spark, block):
    rng = random.Random(4)
    logs = [[(rng.choice(["user", "assistant"]), rng.choice(["hi", "no", "yes", "", None])) for _ in range(rng.randint(1, 9))] for _ in range(12)]
    rows = []
    for c in range(50):
        log = rng.choice(logs)
        log = log[:rng.randint(1, len(log))]
        rows += [(c, k * 2, r, x) for k, (r, x) in enumerate(log)]
    rows += [(None, 0, "user", "lost"), (None, None, None, None), (90, 5, "user", "b"), (90, 5, "user", "a"), (91, 0, "user", "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, part string")
    got = format_chats(df, block).collect()
    whole = {}
    for r in sorted(got, key=lambda r: r.part):
        assert r.n_turns <= block
        whole.setdefault(str(r.conv_id), []).append(r.text)
    assert sorted((c, "".join(t)) for c, t in whole.items()) == brute_chats(rows)
    assert format_chats(df.filter("false")).count() == 0


# ---- urls
def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://Example.ORG/es/x?y#z", "https://a.b.example.org/en/12", "http://org/", "http://xorg/es/", "http://x.org",
            "http://x.com/fr/1", "ftp://com/de/", "http://spam-farm.example.com/x", "http://SPAM.farm.net", "http://www.casino-x.net/a", "http://a.net/xxx-y",
            "http://a.net/p/login?next=1", "http://a.net/loginx", "http://a.net/s.EXE", "a://b://c/d", "http://h?://q", "http://é.org/es/"]
    df = spark.createDataFrame([(k, u, "x") for k, u in enumerate(urls)] + [(3, urls[3], "x")], "page_id long, url string, VERDICT string")
    got = filter_urls(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = r.url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
        fit = [x for x in HOST_RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: len(x.name), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.name)
        if best:
            assert r.verdict == best.verdict
    by = {r.page_id: r.verdict for r in got}
    assert [by[k] for k in (10, 11, 12, 14, 16)] == ["block"] * 5
    assert [by[k] for k in (0, 1, 2, 13, 15)] == ["allow"] * 5
    assert filter_urls(df.filter("false")).count() == 0


def test_rules_are_filed_under_their_rarest_token():
    rules = [*HOST_RULES, PatternRule("p", "x", ("often", "seldom")), PatternRule("q", "y")]
    index, always = build_index(rules, {"often": 9, "seldom": 1, "org": 5, "example": 2, "en": 7, "es": 3})
    assert [r.name for r in index["seldom"]] == ["p"] and [r.name for r in always] == ["q"]
    assert "example" in index and "en" not in index
    assert sum(map(len, index.values())) == len(rules) - 1


# ---- language
def test_marginals_match_enumeration():
    from itertools import product

    from quarry.llm.lang_crf import marginals
    rng = np.random.default_rng(1)
    moves = rng.normal(size=(3, 3))
    lengths = np.array([0, 1, 5, 0, 7, 2])
    scores = rng.normal(size=(int(lengths.sum()), 3))
    want, at = np.zeros_like(scores), 0
    for n in lengths:
        for path in product(range(3), repeat=int(n)):
            p = sum(scores[at + k, y] for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
            p = np.exp(p) * (np.exp(moves[:, path[0]]).sum() if n else 1)
            for k, y in enumerate(path):
                want[at + k, y] += p
        at += n
    want /= want.sum(axis=1, keepdims=True)
    for cell in (2, 3, 64):
        assert np.allclose(marginals(scores, lengths, moves, cell), want)


def test_language_of_held_out_and_odd_texts(spark, sf):
    from pyspark.sql import functions as F

    from quarry.llm.lang_crf import fit, op1_language_crf, predict
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op1_language_crf(spark, sf).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.n_chars >= 40]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    model = fit(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 34 ... !?", 1), (None, "the and of " * 30000, 1), (5, "— … «", 1), (6, "×", 1)],
                                "doc_id long, text string, SCORE int")
    out = predict(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in out if r.doc_id is not None] == [("und", 0.0)] * 5
    assert [r.lang_pred for r in out if r.doc_id is None] == ["en"]
    assert predict(odd.filter("false"), model).count() == 0
    nothing = fit(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert {r.lang_pred for r in predict(odd, nothing).collect()} == {"und"}


# ---- quality
def test_rates_of_sparse_paths_lean_on_their_host(spark):
    from quarry.llm.quality_eb import path_rates, path_sums
    rows = [("h1", "p1", 3.0)] * 400 + [("h1", "p2", -3.0)] + [("h2", "p3", -3.0)] * 400 + [("h2", "p4", 3.0)] + [("h3", "p5", 3.0), ("h3", "p5", -3.0)]
    scored = spark.createDataFrame(rows, "__host string, __path string, __good double")
    rates = {r["__path"]: r.rate for r in path_rates(path_sums(scored, ["good"]), "good").collect()}
    assert rates["p1"] > 0.9 and rates["p3"] < 0.1
    assert rates["p2"] > 0.5 and rates["p4"] < 0.5  # one document doesn't outweigh its host
    assert 0.3 < rates["p5"] < 0.7


def test_quality_on_odd_rows(spark, sf):
    from pyspark.sql import functions as F

    from quarry.llm.quality_eb import Model, fit, quality, site_of_documents
    docs = spark.createDataFrame([(1, None, None, None, 1), (2, "", "s", "en", 1), (None, "idiot scum moron " * 20, "s", "en", 1),
                                  (4, "Some plain words. " * 3000, None, "en", 1), (4, "Some plain words. " * 3000, None, "en", 1)],
                                 "doc_id long, text string, source string, lang string, Kept int")
    model = fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = quality(docs, model, *site_of_documents()).collect()
    assert len(got) == 5 and all(0 <= r.p_good <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    assert quality(docs.filter("false"), model, *site_of_documents()).count() == 0
    empty = fit(docs, spark.createDataFrame([(9, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert empty == Model()
    assert {(r.p_good, r.p_toxic, r.kept) for r in quality(docs, empty, F.lit("h"), F.lit("p")).collect()} == {(1.0, 0.0, True)}
