import html as stdlib
import re
import time
from collections import Counter

import pyarrow as pa

from hearthline.llm import html

CHROME = [
    "<nav><ul><li><a href='/'>Menu</a></ul></nav>", "<header>Site name</header>", "<div class='cookie-notice'>We use cookies</div>", "<div id=sidebar><p>Side<p>bar</div>",
    "<form><input name=q> <label>Find</label></form>", "<div class=\"ad\">Buy</div>", "<script>var t=\"</p>\";</script>", "<style>p{}</style>", "<footer>&copy; us</footer>",
    "<section class=comments><article class=comment><p>First!</p></article></section>", "<aside>Related</aside>", "<!-- no <p>text</p> -->", "<div hidden>secret</div>",
]


def text(page):
    return html.main_text(page, set(), set())


def test_article_without_the_rest():
    page = "<html><body>" + "".join(CHROME) + "<article><h1>A &amp; B</h1>" + "".join(CHROME) + "<p>One\n  <b>two</b><br>three<p>Four&nbsp;&#x41; &lt;x&gt;<p> </article>" + "".join(CHROME)
    assert text(page) == "A & B\nOne two three\nFour A <x>"


def test_no_article_and_broken_markup():
    assert text("<div class=nav>x</div><p>a<p>b<div>c</div>d") == "a\nb\nc\nd"
    assert text("plain < text &amp more") == "plain < text & more"
    assert text("<article><p>cut off &am") == "cut off &am"
    assert text("<article>a</div></b>b<script>never ends") == "ab"
    assert text(None) == text("") == text("<html><body></body></html>") == ""
    assert text("<div class='ads'><main><p>in</p></main></div>") == "in"
    assert text("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n2\n3"


def pages(spark):
    rows = []
    for i in range(30):
        body = "".join(f"<p>Paragraph {i} {k} {'word ' * (i + k)}</p>" for k in range(4))
        rows.append((i, f"http://plain.example.org/{i}", f"<body><div class=x1>Always here</div><div class=x2><div class=story id=n{i}>{body}</div></div><div class=x3>Terms and more terms</div></body>", "c"))
    same = "<body><div class=y><p>Copy</p></div></body>"
    rows += [(100 + i, "http://copies.example.org/a", same, None) for i in range(8)] + [(200, None, None, None), (201, "nonsense", "", None), (202, "http://one.example.org", "<p>x</p>", "d")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string")


def test_template_of_a_host(spark):
    df = pages(spark)
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == df.count()
    for i in range(30):
        assert got[i].text == "\n".join(" ".join(f"Paragraph {i} {k} {'word ' * (i + k)}".split()) for k in range(4)), i
    assert got[200].text == got[201].text == "" and got[202].text == "x" and got[202].n_chars == 1
    assert html.extract(df.limit(0)).count() == 0


def test_joined_templates_give_the_same(spark, monkeypatch):
    df = pages(spark)
    want = sorted(map(str, html.extract(df).collect()))
    monkeypatch.setattr(html, "HOSTS", 1)
    monkeypatch.setattr(html, "HELD", 10)
    assert sorted(map(str, html.extract(df.repartition(5)).collect())) == want


def test_against_plain_expressions(spark):
    """These pages' articles are simple enough for a few substitutions."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r.html for r in df.collect()}
    for r in html.extract(df).collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", rows[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", inner)
        want = [" ".join(stdlib.unescape(re.sub(r"<!--.*?-->|<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b)).split()) for b in blocks]
        assert r.text == "\n".join(x for x in want if x), r.page_id


def test_all_slots_of_a_host_without_articles(spark):
    """Paragraphs hold most of the text; the other blocks are content as well."""
    def page(i):
        long = "".join(f"<p>Paragraph {i} {k} {'word ' * 60}</p>" for k in range(4))
        return (
            f"<body><div class=top>Our town paper</div><div class=lead>Lead {i}</div><div class=story><h1>Title {i}</h1>{long}<h2>Part {i}</h2><ul><li>Item {i}a<li>Item {i}b</ul>"
            f"<blockquote><p>Quote {i}</p></blockquote><table><tr><td>Cell {i}<td>Value {i}</table></div><div class=low>All rights kept</div></body>"
        )

    df = spark.createDataFrame([(i, f"http://blocks.example.org/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    for r in html.extract(df).collect():
        i = r.page_id
        long = [" ".join(f"Paragraph {i} {k} {'word ' * 60}".split()) for k in range(4)]
        assert r.text.split("\n") == [f"Lead {i}", f"Title {i}", *long, f"Part {i}", f"Item {i}a", f"Item {i}b", f"Quote {i}", f"Cell {i}", f"Value {i}"]


def test_copies_and_constant_runs_keep_their_text(spark):
    """Copies of one page are no template, and constant runs beside what varies are content."""
    rows = [(i, "http://copies.example.org/a", "<body><div class=y><p>Copy</p></div></body>") for i in range(8)]
    rows += [(20 + i, "http://mixed.example.org/a", "<body><div class=own><h1>One</h1><div>Two</div></div></body>") for i in range(6)]
    rows += [(40 + i, "http://mixed.example.org/b", f"<body><div class=top>Site</div><div class=in><h2>Summary</h2><p>Text {i} {'word ' * i}</p><div class=note>Note</div></div></body>") for i in range(20)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[i] for i in range(8)} == {"Copy"} and {got[20 + i] for i in range(6)} == {"One\nTwo"}
    for i in range(20):
        assert got[40 + i].split("\n") == ["Summary", " ".join(f"Text {i} {'word ' * i}".split()), "Note"]


def test_names_mark_whole_elements_only():
    assert text("<div class='wrapper has-sidebar'><p>a</p><div class=sidebar>side</div></div>") == "a"
    assert text("<article><h2 class='section-header'>Head</h2><p class='social-history'>b</p><p class='share-buttons'>no</p></article>") == "Head\nb"
    assert text("<div class='sidebar-left'><p>all</p><nav>menu</nav></div>") == "all"
    assert text("<article class='has-comments'>c</article>") == "c"


def test_a_name_around_most_of_a_host_is_not_believed(spark):
    body = "<body><div class='sidebar-left'><div class=ad>Buy {i}</div><div class=foot>Imprint</div><div class=in><p>Text {i} a</p><p>Text {i} b</p></div></div><p>Low {i}</p></body>"
    df = spark.createDataFrame([(i, f"http://names.example.org/{i}", body.format(i=i)) for i in range(10)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == {i: f"Text {i} a\nText {i} b\nLow {i}" for i in range(10)}


def test_long_attributes_and_foreign_elements():
    svg = "<svg><rect></svg>" * 500
    assert text(f"<article><p>a</p><img src='data:image/svg+xml,{svg}'><div data-page='{svg}' class=x>b</div><iframe srcdoc=\"{svg}\"></iframe><p>c</article>") == "a\nb\nc"
    assert text("<article><p title='the hidden class=ad truth'>a</p><p data-id=ad>b</p><p title=\"never closed>c</p></article>") == "a\nb\nc"
    assert text("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math><noscript>plain</noscript><svg><text>label</text></svg><object>fall</object></p></article>") == "a x=1plainlabelfall"
    assert text("<p>a</p>" + "<b " * 100_000) == "a"
    assert text("<p>a</p>" + "<b x='" * 100_000) == "a"


def untold(i):
    """A page without telling tags or names."""
    related = "".join(f"<li><a href=/x{k}>Story {i * 7 + k} of another day</a>" for k in range(4))
    body = "".join(f"<p>Paragraph {i} {k} {'word ' * (20 + i + k)}with <a href=/r{i}>a link</a> in it</p>" for k in range(3))
    menu = "".join(f"<li><a href=/{m}>{m}</a>" for m in ("Start", "World", "Sport", "Money"))
    return (
        f"<body><div class=q1><ul>{menu}</ul></div><div class=q2><div class=q5>Sunday edition</div><h1>Title {i}</h1>{body}<blockquote>Said {i}</blockquote></div>"
        f"<div class=q3><ul>{related}</ul></div><div class=q4><span>Imprint of the house</span></div></body>"
    )


def test_the_template_decides_without_telling_tags_or_names(spark):
    df = spark.createDataFrame([(i, f"http://untold.example.org/{i}", untold(i)) for i in range(20)], "page_id long, url string, html string")
    for r in html.extract(df).collect():
        i = r.page_id
        want = [f"Title {i}", *(" ".join(f"Paragraph {i} {k} {'word ' * (20 + i + k)}with a link in it".split()) for k in range(3)), f"Said {i}"]
        assert [x for x in r.text.split("\n") if x != "Sunday edition"] == want
        without = text(untold(i))
        assert "Imprint of the house" in without and "Start" in without and f"Story {i * 7} of another day" in without


def test_single_words_in_names_dont_decide_inside_an_article(spark):
    page = "<article><p>a<br>b</p><div class='share-price'>c</div><p class='related'>d</p><div class='search-results'>e</div><h2 class='header'>f</h2><div class=ad>no</div></article>"
    assert text(page) == "a b\nc\nd\ne\nf"
    assert text("<div class='notices-archive'><p>all of it</p></div>") == "all of it"


def test_every_step_is_linear():
    for page in (
        "<p>a</p>" + "<a " * 350_000, "<p>a</p><a " + 'k="v" ' * 10_000, "<p>a</p>" + "</" * 300_000, "<p>a</p>" + "<!--" * 200_000, "<p>a</p><script>" + "</script" * 100_000,
        "<p>a</p>" + "<div>" * 60_000 + "</x>" * 60_000, "<p>a</p>" + "<b>" * 30_000 + "<p></p>" * 30_000, "<p>a</p><nav>" + "<main>" * 30_000,
    ):
        began = time.time()
        assert text(page) == "a"
        assert time.time() - began < 5, page[:40]
    batch = pa.RecordBatch.from_pydict({"host": ["h"], "html": ["<div>" * 20_000 + "x" + "</div>" * 20_000]})
    began = time.time()
    assert sum(b.num_rows for b in html.profile(iter([batch]))) == html.DEEP + 2 and time.time() - began < 20


TEASER = "<article class='card'><p>teaser {i}</p></article><div class='story'><p>long main text one {i}</p><p>and the second part {i}</p></div>"


def test_a_teaser_beside_the_story_is_left_out(spark):
    """By length on a page alone, by the main slot on a host where a long teaser would win."""
    assert text(TEASER.format(i=1)) == "long main text one 1\nand the second part 1"
    page = lambda i: TEASER.format(i=i).replace("teaser", "teaser " * (60 if i == 3 else 1))
    df = spark.createDataFrame([(i, f"http://cards.example.org/{i}", page(i)) for i in range(20)], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.chosen) for r in html.extract(df).collect()}
    assert got == {i: (f"long main text one {i}\nand the second part {i}", html.BY_SLOT) for i in range(20)}
    assert text(page(3)).startswith("teaser")


def test_pages_come_by_their_main_slot(spark):
    """On the given pages the deduced slot decides every one, but on hosts of few pages."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    hosts = Counter(r.h for r in pages.select(html.host_of(pages["url"]).alias("h")).collect())
    got = html.extract(pages)
    rows = got.select("chosen", html.host_of(got["url"]).alias("h")).collect()
    assert {r.chosen for r in rows if hosts[r.h] >= html.LEAST} == {html.BY_SLOT} and {r.chosen for r in rows if hosts[r.h] < html.LEAST} <= {html.BY_MARK}


def test_an_articles_own_header_is_a_header():
    assert text("<article><p>Lead</p><header><h1>Title</h1></header><p>b</p></article>") == "Lead\nb"
