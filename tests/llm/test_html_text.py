import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.llm.html_text import extract, main_text

PROSE = "The river rose in the night and the lower fields were under water by morning. "
CASES = [
    ("", ""),
    ("plain words only", "plain words only"),
    ("<html><body><nav><a href=/>Home</a></nav><article><h1>T&amp;t</h1><p>One\n  two<br>three<p>four <b>fi</b>ve</article><footer>f</footer>", "T&t One two three four five"),
    ("<body><div class='cookie-notice'>We use cookies</div><main><p>A &lt;b&gt; c &#233;</p><aside>side</aside><form>f<input></form><p>D</p></main>", "A <b> c é D"),
    ("<body><article><p>Text<script>var a='</p>';</script> goes <!-- no > --> on</p><section id=comments><p>I like it</p></section></article>", "Text goes on"),
    ("<body><nav><ul><li>never closed<article><p>Body</p></article>", "Body"),
    ("<body><p hidden>no</p><p>a < b and <i title='x > y'>c</i></p>", "a < b and c"),
    (f"<body><div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><div><p>{PROSE}</p><p>{PROSE * 3}</p></div><div>© us</div>", " ".join([PROSE.strip(), (PROSE * 3).strip()])),
    ("<body><div class='layout hasSidebar sidebar'><div class=sidebar>links</div><main><p>In a wrapper</p></main></div>", "In a wrapper"),
    (f"<body><div class='page promo'><p>{PROSE * 3}</p></div><div class='cookieNotice'>ok?</div><div id=commentForm>say</div>", (PROSE * 3).strip()),
    (f"<body><p>{PROSE}</p><section class=comments><p>{PROSE * 9}</p></section>", PROSE.strip()),
    ("<body><article><header><h1>Title</h1></header><p>x</p><ul><li>i<li>j</ul><table><tr><td>c<td>d</table><footer>by</footer></article>", "Title x i j c d"),
]


@pytest.mark.parametrize("source, expected", CASES)
def test_cases(source, expected):
    assert main_text(source)[0] == expected


@given(st.text(alphabet="<>/abp!- \"'=&;", max_size=60))
def test_broken_markup_ends(source):
    assert isinstance(main_text(source)[0], str)


def test_generated_pages_give_the_article(spark):
    import html
    import re

    rows = extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    source = dict(duckdb.sql("select page_id, html from '/root/testdata/sf0.01/pages.parquet'").fetchall())
    assert len(rows) == len(source)
    for r in rows:
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        plain = re.sub("<[^>]*>", "", re.sub("</?(p|br|h1|div|li|ul)>", " ", article))
        assert r.text == " ".join(html.unescape(plain).split()) and r.n_chars == len(r.text)


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>a", "y"), (1, None, None, "x"), (2, "v", "<p>" + "word " * 300_000, "")], "page_id long, url string, html string, text string")
    got = extract(df)
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 1), (1, 0), (1, 0), (2, 1_499_999)]
    assert extract(df.limit(0)).count() == 0
