import html
import re

import pytest

from tallymark.llm.block_labeller import blocks_of, extract, train
from tallymark.llm.queries import QUERIES


def article(page):
    """The text of the one article element, by regular expressions."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    if not inner:
        return ""
    parts = re.split(r"</?(?:p|h1|h2|h3|ul|ol|li|div|section)\b[^>]*>", inner[1])
    texts = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", x) and re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_articles_of_all_pages(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op9_block_labeller"](spark, sf).collect()
    assert len(rows) == len(pages)
    wrong = [r.page_id for r in rows if r.text != article(pages[r.page_id].html)]
    assert len(wrong) <= 0.002 * len(rows), (len(wrong), wrong[:5])
    assert all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))


def test_other_layouts(spark, model):
    say = "The river ran high that spring, and the people of the valley moved their cattle up the hill."
    page = (f"<html><head><title>T</title></head><body><header><p>My site</p></header><div id='cookie-notice'><p>We use cookies, ok?</p></div>"
            f"<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><main><h1>High &amp; dry</h1><p>{say}<p>{say} {say}"
            f"<div class=ad>Buy now</div><p>{say}</p></main><aside class='sidebar'><ul><li>Popular</li></ul></aside>"
            f"<section class='comments'><div class='comment'><p>I like this, thanks for it.</p></div></section>"
            f"<form><label>Mail</label><input></form><footer>(c) us</footer></body></html>")
    (row,) = extract(spark.createDataFrame([(1, "u", page)], "page_id int, url string, html string"), model).collect()
    assert row.text == "\n\n".join(["High & dry", say, f"{say} {say}", say])


def test_odd_rows(spark, model):
    long = "<article>" + "<p>A long page, with many sentences in it.</p>" * 20_000 + "</article>"
    rows = [(1, None, None, 1), (2, "u", "", 1), (2, "u", "", 1), (3, "u", "<p", 1), (4, "u", "<script>x", 1), (None, "u", long, 1)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text int")
    got = {r.page_id: r for r in extract(df, model).collect()}
    assert got[1].text == got[2].text == got[4].text == "" and len(got) == 5
    assert got[None].n_blocks == 20_000
    assert extract(df.limit(0), train(df.limit(0))).collect() == []


def test_blocks():
    texts = [b.text for b in blocks_of("<p><b>a<br>b <p>c&eacute;&#33;</p><!-- no --><ul><li>x<li>y z</ul>tail<style>p{}</style>")]
    assert texts == ["a b", "cé!", "x", "y z", "tail"]


def test_head_without_end_tag(spark, model):
    say = "The river ran high that spring, and the people of the valley moved their cattle up the hill."
    head = "<html><head><meta charset=utf-8><title>T</title><script>x<y</script><noscript><img src=p></noscript>"

    def texts(page):
        return [b.text for b in blocks_of(page)]

    for start in ("<body>", "<body class=a><div>", "<p>", "<article>", "<!-- c --><span>", "</head><body>", "<noscript><img src=q><body>"):
        assert texts(f"{head}{start}{say}") == [say], start
    assert texts(f"{head}\n{say}<p>more") == [say, "more"]
    assert texts("<head><title>T</title><head><link href=x></head><body><p>a") == ["a"]
    assert texts("<head><style>p{}</style><template><body><p>t</p></template><meta name=x></head>") == []
    page = f"{head}<body><nav><ul><li><a href=/a>Home</a></ul></nav><article><h1>High</h1><p>{say}</p><p>{say} {say}</p></article></body></html>"
    closed = page.replace("<body>", "</head><body>")
    rows = extract(spark.createDataFrame([(1, "u", page), (2, "u", closed)], "page_id int, url string, html string"), model).collect()
    assert rows[0].text == rows[1].text == "\n\n".join(["High", say, f"{say} {say}"])


def test_self_closed_elements():
    for tag in ("svg", "iframe", "template", "script", "style", "noscript", "title", "head"):
        for form in (f"<{tag}/>", f"<{tag} />", f'<{tag} class="a"/>', f"<{tag} class='a' />"):
            assert [b.text for b in blocks_of(f"<div><p>a</p>{form}<p>b</p></div><p>c</p>")] == ["a", "b", "c"], form
    (block,) = blocks_of("<p><a href=/x/>one</a> <a name='y'/>two</p>")
    assert block.text == "one two" and block.linked == 3
    assert [b.text for b in blocks_of("<p>a</p><svg><path d='x'/><text>no</text></svg><p>b</p>")] == ["a", "b"]
