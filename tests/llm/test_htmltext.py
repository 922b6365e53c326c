import random
import time
from collections import defaultdict
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pytest

from docloom.llm import htmltext
from docloom.llm.common import read


def text(page):
    return htmltext.difference(htmltext.blocks(page))


class Plain(HTMLParser):
    """Lines of pages of the test tables by the library parser: (line, inside the article, in furniture)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.lines, self.part, self.article, self.other, self.skip = [], [], 0, 0, 0
        self.feed(page or "")
        self.close()
        self.cut()

    def cut(self):
        line = " ".join("".join(self.part).split())
        if line:
            self.lines.append((line, self.article > 0 and not self.other, self.other > 0))
        self.part = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "ul", "li", "div", "nav", "article", "footer", "body", "head"):
            self.cut()
        self.part += [" "] if tag == "br" else []
        self.article += tag == "article"
        self.other += tag in ("nav", "footer") or ("class", "ad") in attrs
        self.skip += tag in ("title", "style", "script")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "ul", "li", "div", "nav", "article", "footer", "body", "head"):
            self.cut()
        self.article -= tag == "article"
        self.other -= tag in ("nav", "footer", "div")
        self.skip -= tag in ("title", "style", "script")

    def handle_data(self, data):
        if not self.skip:
            self.part.append(data)


def lcs(a, b):
    """Positions in a of a longest common subsequence, by the table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    i, j, out = len(a), len(b), set()
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.add(i)
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def plain_extract(rows):
    """Every page against all pages of its host: page_id -> (text, lines, longest common subsequence with its neighbour)."""
    hosts, out = defaultdict(list), {}
    for page_id, url, page in rows:
        u = urlsplit(url)
        hosts[u.hostname].append((u.path + ("?" + u.query if u.query else ""), page_id, Plain(page).lines))
    for pages in hosts.values():
        pages.sort(key=lambda x: x[:2])
        for k, (path, page_id, own) in enumerate(pages):
            a = [t for t, *_ in own]
            best = (-1, set())
            for side in (range(k - 1, -1, -1), range(k + 1, len(pages))):
                for j in side:
                    s = lcs(a, [t for t, *_ in pages[j][2]])
                    if sum(len(a[i]) for i in s) < 0.9 * sum(map(len, a)):
                        n = next((i for i, (x, y) in enumerate(zip(path + "\0", pages[j][0] + "\1")) if x != y), len(path))
                        best = max(best, (n, s), key=lambda x: x[0])
                        break
            out[page_id] = ("\n\n".join(t for i, (t, main, other) in enumerate(own) if main or not (other or i in best[1])), len(own), len(best[1]))
    return out


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = sorted(htmltext.common_lines(a, b))
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in rest for i in got)


def test_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><nav><ul><li><a href=/x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><!-- a <p>comment</p> --><div class="ad">Buy</div><script>var t="</p>";</script>
    <article><header><h1>Title &amp; more</h1><span class=byline>By me</span></header><p>One <b>bold<br>line   here.<p>Two &eacute;&#x41;
    <ul><li>item 1<li>item 2</ul><aside>Side</aside><table><tr><td>a<td>b<tr><td>c</table><form><input value=1>Sign up</form>
    <section id="comments"><article class="comment"><p>first!</p></article></section></article>
    <div class="related-posts"><p>Other</p></div><footer>&copy; site</footer>"""
    assert text(page) == "Title & more\n\nBy me\n\nOne bold line here.\n\nTwo éA\n\nitem 1\n\nitem 2\n\na b\n\nc"


def test_without_a_main_element():
    page = "<body><div id=top-menu class=menu>x</div><ul><li><a href=1>Home page</a></li></ul><div>First part.</div>Loose text <p>Second.</p></body>"
    assert text(page) == "First part.\n\nLoose text\n\nSecond."
    assert text("<form><main><p>In a form</p></main></form>") == "In a form"
    assert text(None) == text("") == "" and text("<p>a < b & c <") == "a < b & c <"
    assert text("<script>never closed <p>x") == "" and text("<b>" * 3000 + "deep") == "deep"


def test_shared_lines_go_where_no_article_protects(spark):
    site = lambda k, body: f"<body><div>Site name</div><div>Slogan of all pages</div>{body}<div>Contact us</div></body>"
    rows = [(k, f"http://h.org/a/{k}", site(k, f"<p>Own text {k}</p>")) for k in range(40)]
    rows += [(100 + k, f"http://g.org/{k}", "<article><p>Shared licence line</p><p>x</p></article>") for k in range(3)]
    rows += [(200, "http://alone.org/", site(0, "<p>Alone</p>")), (201, None, None), (None, "no url", "<p>q</p>"), (201, None, None),
            (202, "http://[bad", "<p>z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = htmltext.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert all(by[k] == f"Own text {k}" for k in range(40))
    assert by[101] == "Shared licence line\n\nx" and by[200] == "Site name\n\nSlogan of all pages\n\nAlone\n\nContact us" and by[201] == ""
    assert htmltext.extract(df.where("false")).count() == 0


@pytest.mark.parametrize("table", [0.01])
def test_tables(spark, sf, table):
    pages = read(spark, sf.replace("sf0.001", f"sf{table}"), "pages")
    want = plain_extract([tuple(r) for r in pages.select("page_id", "url", "html").collect()])
    monkey, htmltext._bounds = htmltext._bounds, lambda *a: []  # one bucket, as the plain version has one list
    try:
        got = htmltext.extract(pages).collect()
    finally:
        htmltext._bounds = monkey
    assert {r["page_id"]: (r["text"], r["n_lines"], r["n_shared"] + r["n_spared"]) for r in got} == want
    assert {r["page_id"]: r["text"] for r in htmltext.extract(pages).collect()} == {k: v[0] for k, v in want.items()}


def test_differencing_deletes_menus_that_no_markup_names(spark):
    page = lambda k: f"<body><div>Start</div><div>Products</div><p>Own line {k}</p><p>Another own line {k}</p><div>Imprint</div></body>"
    df = spark.createDataFrame([(k, f"http://h/{k}", page(k)) for k in range(9)], "page_id long, url string, html string")
    for r in htmltext.extract(df).collect():
        assert r["text"] == f"Own line {r['page_id']}\n\nAnother own line {r['page_id']}" and (r["n_lines"], r["n_shared"], r["n_guarded"]) == (5, 3, 0)


def test_repeated_rows_clashing_names_and_long_pages(spark):
    long = "<body><article>" + "".join(f"<p>Line {k} of a long page</p>" for k in range(60_000)) + "</article></body>"
    rows = [(1, "http://h/a", "<body><p>Own</p><p>Text</p></body>", "x", 1, False)] * 3 + [(2, "http://h/b", long, "y", 2, True)] * 2 + [(None, None,
            None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, k string, bucket int, own boolean")
    got = sorted((str(r["page_id"]), r["text"]) for r in htmltext.extract(df).collect())
    whole = "\n\n".join(f"Line {k} of a long page" for k in range(60_000))
    assert got == [("1", "Own\n\nText")] * 3 + [("2", whole)] * 2 + [("None", "")] * 2


@pytest.mark.parametrize("unit", ["<a ", "<div>a", '<a "', "<title>", "<b><dt>", "<dt><ul><b></dt>", "<p><b>x", "</p></x>", "<!-", "&#1", "<main>",
        "<li><a href=x>"])
def test_time_follows_the_length(unit):
    htmltext.blocks(unit * 1000)
    start = time.perf_counter()
    htmltext.blocks(unit * (2_000_000 // len(unit)))
    assert time.perf_counter() - start < 15


def test_large_alignments_are_halved(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(htmltext, "TABLE", 64)
    for _ in range(60):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 60))] for _ in range(2))
        got = sorted(htmltext.common_lines(a, b))
        rest = iter(b)
        assert len(got) == len(lcs(a, b)) and all(a[i] in rest for i in got)


def test_copies_do_not_delete_each_other(spark):
    site = lambda body: f"<body><div>Site name</div><div>Slogan of all pages</div>{body}<div>Contact us</div></body>"
    story = "".join(f"<p>Sentence {i} of the story that copies share.</p>" for i in range(20))
    rows = [(k, f"http://c.org/story?utm={k}", site(story)) for k in range(30)]
    rows += [(50 + k, f"http://c.org/story?x={k}", site(story + f"<p>Line {k}</p>")) for k in range(5)]
    rows += [(90, "http://c.org/z", site("<p>Another page</p>"))]
    rows += [(100 + k, f"http://only.org/{k}", site(story)) for k in range(3)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    whole = "\n\n".join(f"Sentence {i} of the story that copies share." for i in range(20))
    assert all(got[100 + k] == f"Site name\n\nSlogan of all pages\n\n{whole}\n\nContact us" for k in range(3))
    assert all(whole in t for k, t in got.items() if k != 90) and got[90] == "Another page"
    few = spark.createDataFrame(rows[:4] + rows[30:36], "page_id long, url string, html string")
    monkey = htmltext._bounds
    try:
        htmltext._bounds = lambda *a: []  # one bucket: every copy sees the page that differs
        one = {r["page_id"]: r["text"] for r in htmltext.extract(few).collect()}
    finally:
        htmltext._bounds = monkey
    assert all(one[k] == whole for k in range(4)) and all(one[50 + k] == f"{whole}\n\nLine {k}" for k in range(5))
