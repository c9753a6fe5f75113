import html
import re

import pytest

from lumenframe.llm import html_extract, queries


def text_of(page):
    return "\n".join(html_extract.page_blocks(page)[0])


@pytest.mark.parametrize(("page", "want"), [
    (None, ""), ("", ""), ("plain  words\n here", "plain words here"), ("<p>a<p>b<b>c</b>d", "a\nbcd"),
    ("<article><h1>T &amp; x</h1><p>one<br>two &lt;b&gt;</p></article><p>out</p>", "T & x\none two <b>"),
    ("<div><p>a</p><nav>menu<p>x</p></nav>tail</div>", "a\ntail"),
    ("<article><p>keep</p><div class='comment-list'><p>me too</p></div><aside>no</aside><form>f</form></article>", "keep"),
    ("<script>var a='<p>x</p>';</script><p>y<style>p{}</style>z</p><!-- <p>no</p> -->", "yz"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\nb\nc\nd"),
    ("<p title='a > b'>q</p><p hidden>no</p><div id=cookie-banner>no</div>", "q"),
    ("<article><p>cut off", "cut off"), ("</p></div>odd<article", "odd"), ("a < b", "a < b"),
    ("<p>a <span class=ad>buy <span>now</span></span>b</p>c", "a b\nc"), ("<form><article><p>in</p></article></form>", "in"),
    ("<div class=sidebar><div>x</div><p>y</div><p>z", "z"),
    ("<p>x&nbsp;&#8217;y</p>", "x ’y"),
])
def test_blocks(page, want):
    assert text_of(page or "") == want


@pytest.mark.parametrize(("page", "want"), [
    (f"<div {x}><p>a <a href='/hidden-gems'>b</a></p></div>", "a b") for x in (
        "class='overflow-hidden'", "style='overflow: hidden'", 'class="post hidden-print"', "aria-hidden=false",
        "class='with-sidebar'", "class=no-sidebar", "class='search results'", "data-note='display:none hidden'")
] + [(f"<p>a</p><div {x}>b</div>", "a") for x in (
        "hidden", 'hidden=""', "aria-hidden=true", "style='color:red; display : none'", "class='left-sidebar'",
        "class='x related-posts'", "id=site_footer", "role=search")
] + [("<article class='overflow-hidden'><p>a</p></article>", "a"), ("<article hidden><p>a</p></article>", "a")])
def test_only_hidden_and_named_blocks_go(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>a <svg width='1'/> b</p><p>c</p></article><svg><text>no</text></svg>", "a b\nc"),
    ("<p>a<math/>b</p>", "ab"), ("<p>a <svg><g><svg><text>no</text></svg><text>no</text></g></svg>b</p>", "a b"),
    ("<article><div><canvas>no</div><p>b</p></article>", "b"), ("<div><object data=x>no</div><p>b</p>", "b"),
    ("<article><div><iframe src=x></div><p>b</p></article>", "b"), ("<p>a<iframe src=x></iframe>b</p>", "ab"),
    ("<article><p>a</p></article><noscript><article><p>no</p></article></noscript>", "a"),
    ("<template><template>no</template><p>no</p></template><p>a</p>", "a"), ("<p>a</p><script>no", "a"),
])
def test_embedded_elements_end_where_they_end(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "deep", "<" * 200_000, "<p " * 50_000, "<li>x" * 30_000,
                                  "word " * 200_000, "<!--" * 50_000, '<a href="' * 20_000])
def test_odd_long_pages_end(page):
    texts, holders, parents, hashes, _ = html_extract.page_blocks(page)
    assert len(texts) == len(holders) and len(parents) == len(hashes)
    assert len(html_extract._holding(holders, parents)) <= len(parents)


def test_site_templates_go(spark):
    page = lambda i, extra="": f"<body><div><p>About this site</p></div><p>Story {i} is here.</p>{extra}</body>"
    rows = [(i, f"http://Site.example:80/{i}", page(i)) for i in range(12)]
    rows += [(100 + i, "https://copies.example/", "<article><p>same text</p></article>") for i in range(9)]
    rows += [(200, "https://small.example/", page(1)), (201, None, page(2)), (202, "http://site.example/n", None)]
    rows += [(1, "http://site.example/1", page(1))] * 2
    table = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                  "page_id long, url string, html string, row int, text string")
    got = {(r.page_id, r.url): r for r in html_extract.extract_text(table).collect()}
    for i in range(12):
        assert got[i, f"http://Site.example:80/{i}"].text == f"Story {i} is here."
    assert all(got[100 + i, "https://copies.example/"].text == "same text" for i in range(9))
    assert got[200, "https://small.example/"].text == "About this site\nStory 1 is here."
    assert got[201, None].text == "About this site\nStory 2 is here."
    empty = got[202, "http://site.example/n"]
    assert (empty.text, empty.n_chars) == ("", 0)
    assert html_extract.extract_text(table).count() == len(rows)


def test_articles_of_the_given_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op8_site_template"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search("<article>(.*?)</article>", pages[r.page_id], re.S)
        blocks = re.split("</?(?:h1|p)>", body[1]) if body else []
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in blocks]
        assert r.text == "\n".join(b for b in plain if b)
        assert r.n_chars == len(r.text)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_text(empty).collect() == []
