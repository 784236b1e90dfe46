"""Main text: markup cases, template removal, and the corpus' own texts."""

import pickle

from conftest import SF01

from pulse.llm import html
from pulse.llm.common import read

CASES = [
    ("<p>a<br>b<p>c</div>d", "a b\nc\nd"),
    ("<article><h1>T</h1><p>a &amp; b&nbsp; c<ul><li>one<li>two</ul><aside>no</aside><form>q</form>"
     "<div class='ad'>z</div>tail</article><footer>f</footer>", "T\na & b c\none\ntwo\ntail"),
    ("", ""), ("<", "<"), ("x < y &lt; z", "x < y < z"),
    ("<nav>menu</nav><article>a<b>c</b>d <i>e</i></article>", "acd e"),
    ("<article><p><b>bold <p>next</article><footer>f</footer>", "bold\nnext"),
    ("<div class='has-sidebar'><article>kept<script>var t='</p>';</script><!-- no --></article></div>", "kept"),
    ("<main><p>a</p><section class='comments'><article>c</article></section></main>", "a"),
    ("<body><div id=cookie-notice>no</div><p>yes</p><div hidden>no</div></body>", "yes"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><h2 id='comments'>On comments</h2><p id='banner'>A banner</p><div class='related-work'>Work</div>"
     "<p class='alert'>Careful</p><div class='cookie-notice'>no</div><canvas>c</canvas><map>m</map></article>",
     "On comments\nA banner\nWork\nCareful\nc\nm"),
    ("<p>&am<b>p;lt;</b> &amp;lt; &l<!-- x -->t;</p>", "&amp;lt; &lt; &lt;"),
    ("<header>site</header><article><header><h1>T</h1></header>x</article>", "T\nx"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")


def test_markup_cases():
    for page, want in CASES:
        assert html.Page(page).text(set()) == want


def test_site_template_goes_and_shared_sentences_stay(spark):
    body = "<div class=x1>From our site</div><article><p>Shared line.</p><p>Own {0}.</p><div><p>Buy {1}</p></div></article><p>end {0}</p>"
    rows = [(i, f"http://A.example/{i}", body.format(i, "now")) for i in range(5)]
    copies = [(10 + i, "http://b.example/x", body.format("same", "here")) for i in range(5)]
    odd = [(20, None, None), (21, "", ""), (None, "http://a.example", "<p>x"), (0, "http://A.example/0", rows[0][2])]
    got = html.main_text(pages(spark, rows + copies + odd)).collect()
    text = {}
    for r in got:
        text.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert len(got) == len(rows + copies + odd) and len(text[0]) == 2
    for i in range(5):
        assert set(text[i]) == {f"Shared line.\nOwn {i}."}  # the container inside recurs, the sentence is content
        assert text[10 + i] == ["Shared line.\nOwn same.\nBuy here"]  # copies of one page are no template
    assert text[20] == text[21] == [""] and text[None] == ["x"]
    assert html.main_text(pages(spark, [])).count() == 0


def test_pages_hold_documents(spark):
    docs = {"\n".join(" ".join(x.split()) for x in r["text"].split("\n") if x.split())
            for r in read(spark, SF01, "documents").collect()}
    got = html.main_text(read(spark, SF01, "pages")).collect()
    assert len(got) == read(spark, SF01, "pages").count()
    # The heading repeats the start of the document.
    assert all(r["text"].split("\n", 1)[1] in docs for r in got)


def test_share_of_the_host_decides_without_article(spark):
    # A host of 40 pages: its template is on all, real text on three or four.
    shell = ("<body><div class=x1><p>Our site, all of it</p></div><p>Own text of page {0}.</p>{1}"
             "<div class=x2><p>Made by us</p></div></body>")
    some = "<p>A real paragraph.</p><ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table>"
    rows = [(i, f"http://big.example/{i}", shell.format(i, some if i < 4 else "")) for i in range(40)]
    small = [(100 + i, f"http://small.example/{i}", shell.format(i, "")) for i in range(4)]
    text = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows + small)).collect()}
    for i in range(40):
        assert text[i] == f"Own text of page {i}." + ("\nA real paragraph.\none\ntwo\ncell" if i < 4 else "")
    assert all(text[100 + i] == f"Own text of page {i}." for i in range(4))


def test_article_of_few_words_does_not_hide_the_page(spark):
    shell = ("<body><div class=x1><p>{1}</p></div><article><p>A teaser.</p></article>"
             "<div><p>The text of page {0}, which is longer.</p><p>More of {0}.</p></div></body>")
    rows = [(i, f"http://a.example/{i}", shell.format(i, "Our site in many words, on every page of it " * 3)) for i in range(10)]
    rows += [(50 + i, f"http://b.example/{i}", f"<body><div>Our site in many words, on every page of it</div>"
              f"<article><p>Text of {i}.</p></article></body>") for i in range(10)]
    text = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows)).collect()}
    for i in range(10):
        assert text[i] == f"A teaser.\nThe text of page {i}, which is longer.\nMore of {i}."
        # The template goes first: an article may be shorter than that.
        assert text[50 + i] == f"Text of {i}."


def test_deep_and_long_pages_take_little_time_and_memory():
    import time
    deep = "<div>" * 20_000 + "<p>text" + "</b></section>" * 2_000
    nested = "<article>" + "<div><p>a</p>" * 8_000 + "</article>"
    for page, want in ((deep, "text"), (nested, "\n".join("a" * 8_000))):
        t = time.perf_counter()
        got = html.Page(page)
        assert got.text(set()) == want and len(pickle.dumps(got.parts())) < 2_000_000
        assert got.text({h for _, h in got.subtrees()}) == ""
        assert time.perf_counter() - t < 5


def test_switching_the_counts_off_changes_the_text(spark):
    """Template that no name tells is found by the host counts alone."""
    shell = "<body><div class=q1>Made with care since 1999.</div><div class=q2><p>Own {0} text.</p></div><div><div>Find us here.</div></div></body>"
    rows = [(i, f"http://a.example/{i}", shell.format(i)) for i in range(6)]
    on = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows)).collect()}
    off = {r["page_id"]: r["text"] for r in html.main_text(pages(spark, rows), min_pages=10 ** 9).collect()}
    assert on == {i: f"Own {i} text." for i in range(6)}
    assert all(off[i] == f"Made with care since 1999.\nOwn {i} text.\nFind us here." for i in range(6))
