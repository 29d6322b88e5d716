import random
import time
from html.parser import HTMLParser

from factloom.llm import html_consensus as hc

SCHEMA = "page_id long, url string, html string, host string, path string, text string"
LONG = "This is the sentence that the article is about, and it goes on for long enough to count. "


def page(body, container="<div class='post p12'>%s</div>"):
    return "<html><head><title>t</title><script>var a='</p>';</script></head><body><div class='menu'><a href=1>Home</a></div>" + container % body + "<div class='comments'><p>" + LONG * 30 + "</p></div><footer>foot</footer></body></html>"


def texts(spark, rows):
    return {r.page_id: (r.text, r.n_chars) for r in hc.extract(spark.createDataFrame([(i, u, h, "h", "p", "t") for i, u, h in rows], SCHEMA)).collect()}


def test_blocks_references_and_boilerplate(spark):
    body = f"<h1>Title &amp; more</h1><p>{LONG}<b>bold\n\n  text<br>next</b><p>{LONG}<form>no</form><ul><li>one<li>two &eacute;</ul><!-- <p>no</p> --><aside>no</aside><div class='ad-box ads'>no</div><p hidden>no</p>tail"
    got, n = texts(spark, [(1, "http://a/1", page(body))])[1]
    line = LONG.strip()
    assert got == "\n\n".join(["Title & more", f"{line} bold text next", line, "one", "two é", "tail"])
    assert n == len(got)


def test_the_host_decides_and_pages_without_its_path_decide_for_themselves(spark):
    wide = "<div class='long-read'>" + LONG * 9 + "</div>"
    rows = [(i, "http://h.example/x", page(f"<p>{LONG * 3}")) for i in range(5)]
    rows.append((10, "http://h.example/y", page("<p>short real text", "<div class='post p3'>%s</div>" + wide)))
    rows.append((11, "http://h.example/z", page(f"<p>{LONG}", "<section>%s</section>")))
    rows.append((12, "http://other.example/", page("<p>short real text", "<div class='post p3'>%s</div>" + wide)))
    got = texts(spark, rows)
    assert got[10][0] == "short real text"
    assert got[11][0] == LONG.strip()
    assert got[12][0] == (LONG * 9).strip()


def test_empty_and_broken_pages(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text"), (4, "http://a", "<p>never closed <b>at all"), (5, "http://a", "<script>only()"), (6, "http://a", deep), (6, "http://a", deep), (None, "http://a", "</p></div>a<p"), (8, "http://b/", "<p>" + "w " * 200_000)]
    got = hc.extract(spark.createDataFrame([(i, u, h, "h", "p", "t") for i, u, h in rows], SCHEMA)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[5] == "" and by[3] == "plain text" and by[4] == "never closed at all" and by[6] == "x" and by[None] == "a"
    assert len(by[8]) == 399_999
    assert hc.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shuffled_winners_give_the_same(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/x", page(f"<p>{LONG * (i % 4 + 1)}")) for i in range(12)]
    one = texts(spark, rows)
    monkeypatch.setattr(hc, "BROADCAST_BYTES", -1)
    assert texts(spark, rows) == one


def test_one_long_section_does_not_drop_the_rest_of_the_article(spark):
    line, links = LONG.strip(), "<div class='more'>" + "<a href=1>Another page that is linked from here</a> " * 9 + "</div>"
    article = f"<article><h1>Title</h1><p>{LONG}</p><section><p>{LONG * 30}</p></section><section><p>{LONG * 2}</p></section></article>{links}"
    divs = f"<div class='wrap'><div class='b'><p>{LONG * 20}</p></div><div class='c'><p>{LONG * 2}</p></div></div>{links}"
    bare = f"<h1>Title</h1><p>{LONG * 3}</p><div class='b'><p>{LONG * 40}</p></div>"
    one = f"<article><section><p>{LONG * 9}</p></section></article>"
    bodies = {1: article, 2: divs, 3: bare, **{k: one for k in range(10, 15)}}
    rows = [(k, f"http://{'a' if k in (1, *range(10, 15)) else k}.example/", f"<html><body class='home'>{b}</body></html>") for k, b in bodies.items()]
    got = {k: v[0] for k, v in texts(spark, rows).items()}
    many = lambda n: (LONG * n).strip()
    assert got[1] == "\n\n".join(["Title", line, many(30), many(2)])
    assert got[2] == "\n\n".join([many(20), many(2)])
    assert got[3] == "\n\n".join(["Title", many(3), many(40)])
    assert got[12] == many(9)


def test_names_of_more_than_one_word_keep_their_text(spark):
    names = ["naval-history", "navy", "legal", "print", "related-work", "social-history", "side", "menu-planning"]
    rows = [(k, f"http://h{k}/", f"<body><article><p>{LONG}</p><section class='{n}'><p>{LONG * 2}</p></section></article></body>") for k, n in enumerate(names)]
    got = texts(spark, rows)
    assert all(got[k][0] == f"{LONG.strip()}\n\n{(LONG * 2).strip()}" for k in range(len(names)))
    assert all(map(hc.named, ["ad", "cookie-banner", "x Comments", "related-posts-2", "siteHeader header", "reader_comments"])) and not any(map(hc.named, ["", "post", "loads", "entry-header", "thread-history"]))


def test_form_around_the_page_and_forms_inside(spark):
    html = f"<body><form id='aspnetForm'><input><div class='search'>Find</div><article><p>{LONG * 3}</p><form>Write to us</form></article></form></body>"
    assert texts(spark, [(1, "http://a/", html)])[1][0] == (LONG * 3).strip()


def test_a_name_decides_nothing_against_the_votes_of_the_host(spark):
    wrapped = [(k, "http://w/", f"<body><div class='widget'><p>{LONG * (k + 2)}</p></div></body>") for k in range(4)]
    alone = [(10, "http://one/", f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>")]
    mixed = [(20, "http://m/", f"<body><article><p>{LONG}</p></article></body>"), (21, "http://m/", f"<body><div class='comments'><p>{LONG * 50}</p></div></body>")]
    got = {k: v[0] for k, v in texts(spark, wrapped + alone + mixed).items()}
    assert all(got[k] == (LONG * (k + 2)).strip() for k in range(4)) and got[10] == "" and got[20] == LONG.strip() and got[21] == ""


def test_long_deep_and_odd_pages_are_read_in_linear_time():
    for html in ("<div>" * 90_000 + "x", "<a " * 300_000 + '"', '<a href="' * 110_001, "<a href='" * 110_001 + ">x", "<div>x" * 150_000, "<p>" * 300_000, "<td>x<table>" * 80_000, "<" * 1_000_000, "<b>x" * 250_000):
        began = time.time()
        page = hc.parse(html)
        hc.text_at(page, page.path[-1])
        assert time.time() - began < 30, html[:9]


class Brute(HTMLParser):
    """The blocks of the first article, by elements named here, of well-formed pages."""

    DROP = {"script", "style", "nav", "aside", "form", "footer"}

    def __init__(self, banned):
        super().__init__(convert_charrefs=True)
        self.banned, self.open, self.blocks = banned, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += "\n"
            return
        self.open.append((tag, dict(attrs).get("class")))
        if tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.open.pop()
        if tag not in ("b", "i", "a"):
            self.blocks.append("")

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(t in self.DROP or c in self.banned for t, c in self.open):
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def test_against_a_brute_force_extractor(spark):
    rng = random.Random(4)
    words = ["alpha", "beta &amp; gamma", "d&eacute;j&agrave;", "one <b>two</b>", "three\n four", "five<br>six", "seven &lt;eight&gt;", "nine, <i>ten</i>."]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    junk = [lambda: f"<div class='ad'>{line(30)}</div>", lambda: f"<nav><ul><li><a href='/x'>{line(2)}</a></li></ul></nav>", lambda: f"<aside><p>{line(20)}</p></aside>", lambda: f"<form><p>{line(9)}</p></form>", lambda: "<script>if (a < b) { c = '<p>no</p>' }</script>", lambda: f"<div class='comments'><p>{line(60)}</p></div>", lambda: f"<!-- <p>{line(3)}</p> -->"]
    real = [lambda: f"<p>{line(rng.randint(1, 40))}</p>", lambda: f"<h2>{line(2)}</h2>", lambda: f"<section class='navy'><p>{line(20)}</p><p>{line(30)}</p></section>", lambda: f"<ul><li>{line(4)}</li><li>{line(3)}</li></ul>", lambda: f"<table><tr><td>{line(2)}</td><td>{line(9)}</td></tr></table>", lambda: f"<div class='print'><div>{line(12)}</div></div>"]
    rows, want = [], {}
    for k in range(120):
        some = lambda kinds, n: [rng.choice(kinds)() for _ in range(rng.randint(0, n))]
        inner = [f"<h1>{line(3)}</h1><p>{line(200)}</p>", *some(real, 9), *some(junk, 4)]
        tail = inner[1:]
        rng.shuffle(tail)
        html = "<html><head><style>p{}</style></head><body>" + "".join(some(junk, 4)) + "<article>" + "".join([inner[0], *tail]) + "</article>" + "".join(some(junk, 4)) + f"<footer>{line(9)}</footer></body></html>"
        brute = Brute({"ad", "comments"})
        brute.feed(html)
        want[k] = brute.text()
        rows.append((k, f"http://host{k % 5}.example/{k}", html))
    got = texts(spark, rows)
    assert {k: v[0] for k, v in got.items()} == want
