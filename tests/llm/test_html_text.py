"""Main text of pages."""

import pytest

from tablegauge.llm.common import table
from tablegauge.llm.html_text import extract_text, main_text

LONG = "This paragraph has enough words to be dense, and says something plain about the matter at hand."


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain words only", "plain words only"), ("<p>one</p><p>two</p>", "one\ntwo"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy</div>"
     "<article><h1>Head &amp; more</h1><p><b>First<br><p>Second&nbsp; line\n here<p>Third</article><footer>&copy; x</footer>", "Head & more\nFirst\nSecond line here\nThird"),
    (f"<body><header><h1>Site</h1></header><main><p>{LONG}</p><aside>Side</aside><p>Short.</p><form><label>Mail</label><input></form>"
     "<section id='comments'><article class='comment'><p>Nice read, thanks a lot for all of this, really.</p></article></section></main>", f"{LONG}\nShort."),
    (f"<article><header><h1>Title</h1><p>by someone</p></header><p>{LONG}</p><div class='cookie-notice'>We use cookies</div><p>End</p></article>", f"Title\n{LONG}\nEnd"),
    (f"<body><div id='menu'><a href=a>A</a> <a href=b>B</a></div><div id='content'><h2>Top</h2><p>{LONG}</p><p>{LONG}</p><p>Bye</p></div><div class='footer'>foot</div></body>",
     f"Top\n{LONG}\n{LONG}\nBye"),
    ("<article><p>a &lt;b&gt; &#233; &#x1F642;</p><script>var t='<p>no</p>'</script><!-- <p>no</p> --><ul><li>x<li>y</ul></article>", "a <b> é 🙂\nx\ny"),
    (f"<nav><a href=x>Home</a><article><p>{LONG}</p></article>", LONG),
    ("<article><p>un<b>bro</b>ken <i>words</i></p><table><tr><td>1</td><td>2</td></tr></table><pre>a\n  b</pre></article>", "unbroken words\n1\n2\na b"),
    ("<nav>only a menu</nav><footer>and a footer</footer>", ""), ("<p", ""), ("<article></article>", ""),
])
def test_pages(html, text):
    assert main_text(html) == text


def test_given_pages_give_their_articles(spark, sf_dir):
    pages = {r.page_id: r.html for r in table(spark, sf_dir, "pages").collect()}
    got = {r.page_id: r for r in extract_text(table(spark, sf_dir, "pages")).collect()}
    assert set(got) == set(pages)
    for i, html in pages.items():
        article = html.split("<article>")[1].split("</article>")[0]
        letters = "".join(c for c in __import__("html").unescape(__import__("re").sub("<[^>]*>", " ", article)) if not c.isspace())
        assert "".join(got[i].text.split()) == letters and got[i].n_chars == len(got[i].text)


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>" + "word " * 100_000, "x"), (2, "u", "<div>" * 3000 + "deep", "x")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(frame).collect()
    assert len(got) == 4 and {r.n_chars for r in got} == {0, 499_999, 4}
    assert extract_text(frame.limit(0)).collect() == []
