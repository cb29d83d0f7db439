"""Main text of pages with known articles."""

import random

import pytest

from opinara.llm import html_text, queries

CASES = [
    ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<br>four</p></article>", "A & B\none two three\nfour"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav><article>x</article><footer>f</footer></body>", "x"),
    ('<div class="ad">buy</div><article><p>keep</p><div class="comments"><p>nice!</p></div><aside>side</aside><p>keep too', "keep\nkeep too"),
    ('<main><form><input name=q><button>Go</button></form><script>var t="</p>";a<b</script><p>text</p></main><p>after</p>', "text"),
    ('<article><p class="notice">we use cookies<p>plain <b>bold</b><i>er</i> <span class="advert">ad</span>end</article>', "plain bolder end"),
    ("<article><!-- gone --><p>a < b &lt; c</p><![CDATA[x]]><p title='>'>quoted</p></article", "a < b < c\nquoted"),
    ("<article><header><h1>Title</h1></header>body</article><header>site</header>", "Title\nbody"),
    ("<article><p>first</article><article><div><div>second</div> third</div></article>", "first\nsecond\nthird"),
    ('<article><p>x</p><textarea>t</textarea><table><tr><td>1</td><td>2</td></tr></table><div class="adult-shadow">stays</div></article>', "x\n1\n2\nstays"),
    ('<article><p>Intro.</p><p class="social-history">a</p><div class="search-results-of-study">b</div><p id="ad-hoc">c</p></article>', "Intro.\na\nb\nc"),
    ('<article><p>x</p><ol class="comment-list"><li>me</li></ol><article class="comment">first!</article><div id="ad-slot-2">buy</div><p>y</p></article>', "x\ny"),
    ('<div class="site-footer">f</div><div class="relatedPosts">r</div><div class="notice-of-death">d</div>', "d"),
    ("", ""), (None, ""), ("   ", ""), ("plain text", "plain text"), ("<article></article>", ""), ("<p>unclosed <b", "unclosed"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], "page_id long, url string, html string, host string, text string")


def test_structure(spark):
    rows = [(i, f"http://host{i}.net/a", h) for i, (h, _) in enumerate(CASES)]
    got = {r.id: r.text for r in html_text.main_texts(frame(spark, rows)).collect()}
    assert got == {i: text for i, (_, text) in enumerate(CASES)}


def test_differencing_without_an_article(spark):
    page = "<body><div>Site name</div><p>{0}</p><p>Shared words</p><p>{1}</p><div>All rights reserved</div></body>"
    rows = [(1, "http://a.net/x/1", page.format("one", "uno")), (2, "http://a.net/x/2", page.format("two", "dos")), (3, "http://b.net/x/2", page.format("three", "tres"))]
    rows += [(None, None, "<p>alone</p>"), (5, "http://a.net/x/2", page.format("two", "dos"))]
    got = {r.id: r.text for r in html_text.main_texts(frame(spark, rows).repartition(2)).collect()}
    assert got[1] == "one\nuno" and got[2] == got[5] == "two\ndos" and got[None] == "alone"
    assert got[3] == "Site name\nthree\nShared words\ntres\nAll rights reserved"


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_parts_and_copies(spark, parts):
    """Every page of a host has a neighbour, whatever the parts; a body that a third of the pages repeat keeps its text."""
    page = "<div>Site {0}</div><p>text {1}</p><div>All rights reserved</div>"
    rows = [(i, f"http://h{i % 2}.net/{i // 5}/{i}", page.format(i % 2, "copied" if i % 3 == 0 else i)) for i in range(90)]
    rows += [(90, "http://h0.net/0/", ""), (91, "http://h0.net/0/9", None)]
    got = {r.id: r.text for r in html_text.main_texts(frame(spark, rows), parts=parts).collect()}
    assert got == {i: f"text {'copied' if i % 3 == 0 else i}" for i in range(90)} | {90: "", 91: ""}


def test_long_page(spark):
    lines = [f"line {i}" for i in range(20_000)]
    html = "<article>" + "".join(f"<p>{x}" for x in lines) + "</article>"
    assert html_text.main_texts(frame(spark, [(1, "http://a.net/", html), (2, "http://a.net/", html)])).first().text == "\n".join(lines)


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
    return row[-1]


@pytest.mark.parametrize("seed", range(30))
def test_common_lines(seed, monkeypatch):
    rng = random.Random(seed)
    a, b = ([rng.randrange(4) for _ in range(rng.randrange(25))] for _ in range(2))
    found = [a[i] for i in html_text.common_lines(a, b)]
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in found) and len(found) == lcs_length(a, b)
    monkeypatch.setattr(html_text, "CELLS", 8)  # halves of halves
    found = [a[i] for i in html_text.common_lines(a, b)]
    rest = iter(b)
    assert all(any(x == y for y in rest) for x in found) and len(found) == lcs_length(a, b)


def test_empty_table(spark):
    assert html_text.main_texts(frame(spark, [])).count() == 0


def test_query(spark, write_tables):
    rows = [(i, f"http://h.net/{i}", h) for i, (h, _) in enumerate(CASES[:6])]
    out = queries.op4_page_text(spark, write_tables(pages=frame(spark, rows))).collect()
    assert {(r.page_id, r.url, r.text, r.n_chars) for r in out} == {(i, f"http://h.net/{i}", t, len(t)) for i, (_, t) in enumerate(CASES[:6])}


def test_pages_with_an_article_are_differenced(spark, write_tables, monkeypatch):
    """Every page meets its neighbour; of a marked page the check by structure puts back what both articles say."""
    monkeypatch.setattr(html_text, "BLOCK_BYTES", 200)
    marked = "<div>Site</div><nav>menu</nav><article><p>text {0}</p><p>Both say this.</p></article><div>by {0}</div>"
    rows = [(i, f"http://a.net/{i:02}", marked.format(i)) for i in range(20)] + [(None, "http://a.net/00", marked.format(0)), (99, "http://b.net/", marked.format(99))]
    rows += [(i, f"http://c.net/{i}", f"<div>Site</div><p>text {i}</p>") for i in (50, 51)]
    out = queries.op4_page_text(spark, write_tables(pages=frame(spark, rows).repartition(3))).collect()
    want = {(i, f"text {i or 0}\nBoth say this.", 5, 0 if i == 99 else 3) for i in [*range(20), None, 99]} | {(i, f"text {i}", 2, 1) for i in (50, 51)}
    assert len(out) == len(rows) and {(r.page_id, r.text, r.n_lines, r.n_shared) for r in out} == want
