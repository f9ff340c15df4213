import pytest

from quarry.llm.html_main import main_text, split_page, stream_of

CASES = [
    ("", (None, [], [])),
    (None, (None, [], [])),
    ("<p>a<p>b &amp; c&nbsp;d", (None, ["a", "b & c d"], [False, False])),
    ("x < y <b>z", (None, ["x < y z"], [False])),
    ("<article><header><h1>T</h1></header><p>one<br>two</p><div class='comments'><p>no</p></div></article><footer>f",
     ("T\none two", ["no", "f"], [True, True])),
    ("<!-- open <p>x", (None, [], [])),
    ("<script>if(a<b){'</p>'}</script>t<div hidden>u</div>", (None, ["t", "u"], [False, True])),
    ("<main><nav>x</nav><p>y</main>z", ("y", ["x", "z"], [True, False])),
    ('<a title="a>b" href=x>link</a>', (None, ["link"], [False])),
    ("<div class='content with-sidebar'>kept</div><div id=cookie-notice>gone</div>", (None, ["kept", "gone"], [False, True])),
    ("<ARTICLE>A&#233; \n\t b<P>c</ARTICLE>", ("Aé b\nc", [], [])),
    ("<article><p>cut off <b", ("cut off", [], [])),
    # layouts and forms around an article, or around most of the text
    ("<div class='content-with-sidebar'><article><p>kept</p></article></div>", ("kept", [], [])),
    ("<form id=f><nav>x</nav><article><p>kept</p></article><input></form>", ("kept", ["x"], [True])),
    ("<form><div class=menu>x</div><p>all of the page's text</p></form><footer>f</footer>",
     (None, ["x", "all of the page's text", "f"], [True, False, True])),
    ("<div class='layout-sidebar-right'><p>body text</p></div>", (None, ["body text"], [False])),
    ("<article><p class='social-science'>on social science</p></article>", ("on social science", [], [])),
    # teasers and other people's articles
    ("<article><p>a long article of many words</p></article><article class=card><p>card</p></article>",
     ("a long article of many words", ["card"], [True])),
    ("<article><p>short</p></article><div class=comments><article><p>a long comment of a reader</p></article></div>",
     ("short", ["a long comment of a reader"], [True])),
    ("<article><p>one half</p></article><article><p>two half</p></article>", ("one half\ntwo half", [], [])),
]


@pytest.mark.parametrize("page, want", CASES)
def test_split_page(page, want):
    assert split_page(page) == want


def brute(pages, window):
    """Pages without a container, less words covered by strings that another page of
    the host holds."""
    streams = {}
    for i, host, page in pages:
        streams.setdefault(host, {}).setdefault(i, []).append(stream_of(split_page(page)[1]))
    out = []
    for i, host, page in pages:
        main, blocks, furniture = split_page(page)
        if main is not None:
            out.append((i, main))
            continue
        own = stream_of(blocks)
        held = {s[p:p + window] for j, ss in streams[host].items() if j != i for s in ss for p in range(len(s) - window + 1)}
        gone = {q for p in range(len(own) - window + 1) if own[p:p + window] in held for q in range(p, p + window)}
        at, parts = 0, []
        for b, f in zip(blocks, furniture):
            kept = []
            for w in b.split():
                n = len(w.lower().encode())
                if not set(range(at, at + n)) <= gone:
                    kept.append(w)
                at += n + 1
            if kept and not f:
                parts.append(" ".join(kept))
        out.append((i, "\n".join(parts)))
    return out


def test_repeated_runs_go_where_no_element_tells(spark):
    note = "We value your privacy and so do all of our many partners on this site"
    long = "an article that was printed on two pages of one host and is kept in its element"
    pages = []
    for k in range(12):
        host = f"h{k % 2}.example"
        own = f"page number {k} tells its very own story about the number {k * 7919} and little else"
        pages.append((k, host, f"<div>{note if k % 3 else note.upper()}</div><p>{own}</p><div>Intro {k} {note} end</div>"))
    pages += [(20, "h0.example", f"<article><p>{long}</p></article>"), (21, "h0.example", f"<article><p>{long}</p></article><p>{note}"),
              (22, "h3.example", f"<p>{note}</p>"), (23, "h0.example", ""), (24, "h0.example", None)]
    rows = [(i, f"https://{h}/x/{i}", p, 1) for i, h, p in pages]
    df = spark.createDataFrame([*rows, (None, None, f"<p>{note}</p>", 1), rows[0]], "page_id long, url string, html string, TEXT int")
    got = main_text(df).collect()
    assert len(got) == len(rows) + 2
    assert {(r.page_id, r.text) for r in got if r.page_id is not None} == set(brute(pages, 40))
    assert [r.text for r in got if r.page_id is None] == [note]
    assert all(r.n_chars == len(r.text) for r in got)
    assert main_text(df.filter("false")).count() == 0


def test_repeated_runs_judge_blocks_of_the_element(spark):
    note = "We value your privacy and so do all of our many partners on this site"
    line = "Read the morning letter of this paper, every day and free of charge"
    quoted = "a passage that three of the twelve articles quote, each with words of its own around it"
    pages, want = [], []
    for k in range(12):
        own = f"page number {k} tells its very own story about the number {k * 7919}, which no other page tells, and it is a long story indeed. " \
              f"Whoever reads it to its end knows more about {k * 7919} than before, and can tell it to {k + 3} others."
        shown = [own, quoted] if k < 3 else [own]
        pages.append((k, "https://a.example/%d" % k, f"<div>{line}</div><article><p>{note}</p>" + "".join(f"<p>{b}</p>" for b in shown)
                      + f"<div>{line.upper() if k % 2 else line}</div></article>"))
        want.append((k, "\n".join(shown)))
    # copies of one article, some with a change, and a host of few articles
    for k in range(20, 26):
        body = f"<article><p>{note}</p><p>{quoted}</p><p>seen {k}</p></article>"
        pages.append((k, "https://b.example/%d" % k, body))
        want.append((k, f"{note}\n{quoted}\nseen {k}"))
    for k in range(30, 33):
        pages.append((k, "https://c.example/%d" % k, f"<article><p>{note}</p><p>{want[k - 30][1]}</p></article>"))
        want.append((k, f"{note}\n" + want[k - 30][1].replace("\n", " ")))
    got = main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.text) for r in got) == want
    assert {r.n_blocks_removed for r in got if r.page_id < 12} == {2}
