import random
import time
from collections import defaultdict

import pytest
from skuloom.llm import html_main

FURNITURE = (
    "<!DOCTYPE html><html lang='en'><head><title>T &amp; t</title><style>p{x:1}</style>"
    "<script>var a = '<p>no</p>';</script></head><body>"
    "<header><a href='/'>Site name</a></header><nav><ul><li><a href='/a'>Menu one</a></li></ul></nav>"
    "<div class='cookie-notice'>We use cookies <button>OK</button></div>"
    "<div class='ad'>Buy this now and save a lot of money on it today</div>"
)
END = (
    "<aside class='sidebar'><p>Side words that are quite long too, but not of the article itself.</p></aside>"
    "<form><label>Mail</label><input name=q><select><option>one</option></select></form>"
    "<div id='comments'><div class='comment'><p>I like this a lot, thank you very much for it!</p></div></div>"
    "<footer>&copy; footer</footer></body></html>"
)


def page(body, wrap="<div class='post-{n} entry'>{body}</div>", n=1):
    return FURNITURE + wrap.format(body=body, n=n) + END


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r for r in html_main.extract(df).collect()}


def test_main_text_without_furniture(spark):
    body = (
        "<h1>Head &amp; line</h1>\n<p>First   para\ngraph with <b>bo</b>ld and <a href='x'>a link</a>.<br>Second&nbsp;line"
        "<p>Unclosed &lt;para&gt;<ul><li>item one<li>item two</ul><table><tr><td>cell</td><td>two</td></tr></table>"
    )
    want = "Head & line First para graph with bold and a link. Second line Unclosed <para> item one item two cell two"
    for wrap in (
        "<div class='post-{n} entry'>{body}</div>",
        "<article>{body}</article>",
        "<main><section id='s{n}'>{body}</section></main>",
        "<div class='outer'><div class='inner content'>{body}</div><div class='related'><p>Other news to read</p></div></div>",
    ):
        rows = [(i, f"http://h.example.org/{i}", page(body, wrap, i)) for i in range(3)]
        for r in texts(spark, rows).values():
            assert r["text"] == want and r["n_chars"] == len(want), (wrap, r)


def test_host_votes_beat_a_page_of_its_own_mind(spark):
    """A page whose promotion block is longer than its article follows its host."""
    prose = "Some words of an article that go on for a while, as articles do. " * 8
    plain = "<div class='text'><p>{a}</p></div><div class='extra'><p>{b}</p></div>"
    rows = [(i, "https://www.host.example/x", FURNITURE + plain.format(a=prose, b="short") + END) for i in range(9)]
    odd = FURNITURE + plain.format(a="Brief article.", b=prose * 3) + END
    got = texts(spark, [*rows, (99, "https://www.host.example:8080/y", odd), (100, "https://other.example/", odd)])
    assert got[99]["text"] == "Brief article."
    assert got[100]["text"] == " ".join((prose * 3).split())
    assert got[99]["path"].endswith("div.text")


def test_numbers_in_classes_are_generalised(spark):
    rows = [(i, "http://n.example/", page("<p>words and words</p>", n=i)) for i in range(5)]
    assert {r["path"] for r in texts(spark, rows).values()} == {"/html/body/div.entry.post-0"}


def test_broken_and_hostile_pages(spark):
    rows = [
        (1, None, None),
        (2, "no address", ""),
        (3, "http://x.example", "plain text only"),
        (4, "http://x.example", "<p>never <b>closed"),
        (5, "http://x.example", "<!-- never closed <p>a</p>"),
        (6, "http://x.example", "<script>never closed <p>a</p>"),
        (7, "http://y.example", "a < b <3 </> <p>c</p"),
        (8, "http://y.example", "<p title='a > b'>quoted</p>"),
        (None, "http://y.example", "<p>null id</p>"),
        (9, "http://z.example", "<nav>only menu</nav>"),
        (10, "http://w.example", "</div></p></article><p>closed too often</p>"),
        (10, "http://w.example", "</div></p></article><p>closed too often</p>"),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, Html string")
    out = html_main.extract(df).collect()
    assert len(out) == len(rows)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[1] == got[2] == got[5] == got[6] == got[9] == ""
    assert got[3] == "plain text only" and got[4] == "never closed" and got[8] == "quoted"
    assert got[None] == "null id" and got[10] == "closed too often"
    assert got[7].startswith("a < b <3")
    assert html_main.extract(df.limit(0)).collect() == []


def test_reading_is_linear():
    for odd in ("<", "<a ", "<!--", "<p title='", "<script>", "</", "<div>", "&amp;", "<div class=\"a b\">x", "<textarea>"):
        start = time.perf_counter()
        read = html_main.Page(odd * 20_000)
        read.scores()
        assert time.perf_counter() - start < 8, odd


def test_every_block_is_in_page_order(spark):
    rng = random.Random(4)
    blocks = [" ".join(str(rng.randrange(999)) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    body = "".join(f"<div class='part'><p>{b}</p></div>" if i % 3 else f"<p>{b}" for i, b in enumerate(blocks))
    got = texts(spark, [(1, "http://o.example/", page(body, "<article>{body}</article>"))])
    assert got[1]["text"] == " ".join(blocks)


def test_hot_hosts_and_others_give_the_same(spark, monkeypatch):
    rows = [(i, f"http://{'big' if i % 3 else f'h{i}'}.example/", page(f"<p>words {i} and words</p>", n=i)) for i in range(40)]
    first = {i: r["text"] for i, r in texts(spark, rows).items()}
    monkeypatch.setattr(html_main, "HOT_SHARE", 2.0)  # no host is hot
    assert {i: r["text"] for i, r in texts(spark, rows).items()} == first
    assert first == {i: f"words {i} and words" for i in range(40)}


def test_left_out_end_tags():
    """What HTML lets authors leave out hides no later text, also in noise."""
    want = "first words of it second words of it"
    for html in (
        "<html><head><title>t</title><script>'<p>no'</script><meta x><body><p>first words of it<p>second words of it",
        "<head><title>t</title><p>first words of it<p>second words of it",
        "<head><title>t</title>first words of it <p>second words of it",
        "<body><div><p>first words of it<p class='ad'>buy<p>second words of it</div>",
        "<body><div><p class='ad'>buy</div><div><p>first words of it<p>second words of it</div>",
        "<body><ul><li class='ad'>buy<ul><li>a<li>b</ul>c<li>first words of it<li>second words of it</ul>",
        "<body><dl><dt>first words of it<dd class='ad'>buy<dt>second words of it</dl>",
        "<body><div><span class='ad'>buy</div><p>first words of it</p><p>second words of it",
        "<table><tr><td class='ad'>buy<td>first words of it<tr class='ad'><td>x</td><td>y<tr><td>second words of it</table>",
        "<div class='comments'><p>first words of it</p><p>second words of it</p></div>",
    ):
        page, _ = html_main._read_page(html)
        assert " ".join(b for b, owner in page.blocks if not owner.noise) == want, html
        assert html_main._extract()([html], [None])["text"][0]


ARTICLE = "<h1>The title</h1><p>Some words of an article that go on for a while.</p><p>And a second paragraph with more of them.</p>"
WANT = "The title Some words of an article that go on for a while. And a second paragraph with more of them."
REMARK = "<p>I liked this a lot, and want to say so at some length, since nobody else has done it so far.</p>" * 3


def wrapped(name, tag="div", attribute="class"):
    return f"<body><nav><a href=/>Home</a></nav><{tag} {attribute}='{name}'>{ARTICLE}</{tag}><footer>Legal line here</footer></body>"


@pytest.mark.parametrize(
    "name",
    [
        "no-sidebar", "post hentry comments-closed", "wrap has-sidebar", "article-with-ads", "main-content has-search", "ad-free",
        "is-open", "withoutComments", "page_has_nav", "comment-count-3 entry", "shareholder-report", "menuplan", "advertorial", "sidebyside",
        "side-effects", "social-history", "cookie-recipes", "banner-of-heaven", "hidden-figures-review", "alerting", "content",
        "newsletter", "sidebar", "search", "related", "widget-text", "ad", "notice", "modal-content",
    ],
)
@pytest.mark.parametrize("attribute", ["class", "id"])
def test_classes_of_wrappers_hide_no_article(name, attribute):
    for tag in ("div", "section"):
        assert html_main._extract()([wrapped(name, tag, attribute)], [None])["text"] == [WANT]


@pytest.mark.parametrize(
    "beside",
    [
        f"<section class='user-responses'>{REMARK}</section>", f"<div id='comments'>{REMARK}</div>", f"<div class='reader-comments'>{REMARK}</div>",
        f"<ol class='commentlist'><li>{REMARK}</ol>", f"<div class='commentThread'>{REMARK}</div>", f"<div id=disqus_thread>{REMARK}</div>",
        f"<div class='guestbook entries'>{REMARK}</div>", f"<div class='ad'>{REMARK}</div>", f"<div class='sidebar-right'>{REMARK}</div>",
        f"<div class='cookie-notice'>{REMARK}</div>", f"<div class='related-posts'>{REMARK}</div>", f"<div class='newsletterSignup'>{REMARK}</div>",
        f"<aside>{REMARK}</aside>", f"<form>{REMARK}</form>", f"<div role=complementary>{REMARK}</div>", f"<div style='display: none'>{REMARK}</div>",
        f"<div hidden>{REMARK}</div>", f"<div class='site-footer'>{REMARK}</div>", f"<div class='widget_area'>{REMARK}</div>", "<p class='share'>Tell all the others",
    ],
)
def test_what_is_beside_an_article_goes_however_long(beside):
    for article in (f"<article>{ARTICLE}</article>", f"<main><div>{ARTICLE}</div></main>"):
        assert html_main._extract()([f"<body>{article}{beside}</body>"], [None])["text"] == [WANT]
        assert html_main._extract()([f"<body class='home search-results-page'>{beside}{article}"], [None])["text"] == [WANT]


@pytest.mark.parametrize("deep", [2, 15, 16, 17, 20, 60])
def test_depth_does_not_matter(deep):
    html = "<body>" + "<div>" * deep + ARTICLE + "</div>" * deep + "<div><p>Legal line here</p></div></body>"
    assert html_main._extract()([html], [None])["text"] == [WANT]


def test_all_votes_count(spark):
    """The fourth path of every page of a host has more votes than any other, and wins."""
    def body(i):
        firsts = "".join(f"<div class='only{chr(97 + i)}{c}'><p>{'long and longer words ' * 9}</p></div>" for c in "xyz")
        return f"<body>{firsts}<div class='common'><p>{'long and longer words ' * 8}</p></div></body>"

    got = texts(spark, [(i, "http://v.example/", body(i)) for i in range(8)])
    assert {r["path"] for r in got.values()} <= {"/body/div.common", "/body"} and len({r["path"] for r in got.values()}) == 1


def chosen_by_hand(rows):
    """Votes and texts with dictionaries, page by page."""
    read = {}
    votes = defaultdict(lambda: defaultdict(float))
    for key, url, html in rows:
        host = (url or "").split("://")[-1].split("/")[0].split("@")[-1].split(":")[0].lower() if "://" in (url or "") else ""
        page, scores = html_main._read_page(html) if html else (None, [])
        read[key] = host, page, scores
        for path, score in scores:
            votes[host][path] += (score / scores[0][1]) ** 2
    out = {}
    for key, (host, page, scores) in read.items():
        text = ""
        for path, _ in sorted(scores, key=lambda x: (-round(votes[host][x[0]], 6), x[0] != scores[0][0], x[0])):
            if round(votes[host][path], 6) > 1 or path == scores[0][0]:
                text = page.text(path)
            if text:
                break
        out[key] = text
    return out


@pytest.mark.parametrize("hot", [True, False])
def test_votes_and_texts_by_brute_force(spark, sf_dir, monkeypatch, hot):
    if not hot:
        monkeypatch.setattr(html_main, "HOT_SHARE", 2.0)
    rng = random.Random(9)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for i in range(120):
        parts = [f"<div class='{rng.choice('abcd')}'><p>{' '.join(rng.choice(['word', 'other', 'more']) for _ in range(rng.randint(1, 60)))}</p></div>" for _ in range(5)]
        inside = rng.choice(["", "<article>", "<section class='no-sidebar'>"])
        rows.append((10_000 + i, f"https://h{rng.randrange(5)}.example/{i}", f"<body>{inside}{''.join(parts)}"))
    got = {i: r["text"] for i, r in texts(spark, rows).items()}
    assert got == chosen_by_hand(rows)
