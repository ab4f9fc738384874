import html
import re

import numpy as np
import pytest
from corpusdeck.llm import pages
from corpusdeck.llm.queries import QUERIES


def article(source):
    """The article of the tables' template, read with plain patterns."""
    own = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", re.sub(r"</?b>", "", own))).split())


def test_query_on_the_tables(spark, sf):
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_host_suffix_array"](spark, sf).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: article(h) for i, h in given.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p>a<b>b</b> c&amp;d&nbsp; e</p><p>f", "ab c&d e f"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ("<article>a<aside>no</aside><script>var x='<p>no</p>'</script><p>b</p></article>", "a b"),
        ("<article><p>a</p><div class='comments'><article>no</article></div><p>b</p></article>", "a b"),
        ("<article class='comment'>no</article><p>yes</p>", "yes"),
        ("<header><h1>no</h1></header><article><header><h1>yes</h1></header>text</article>", "yes text"),
        ("<div role=navigation>no</div><form>no<input></form><div id='cookie-notice'>no</div>yes", "yes"),
        ("<p class=ad>no<p>yes<ul><li>one<li>two</ul>", "yes one two"),
        ("a<!-- <p>no</p> -->b<style>no</style>c<br>d<article", "abc d"),
        ("x < y <3 &lt;tag&gt;", "x < y <3 <tag>"),
        ("<p title='a > b' hidden>no</p><p title='a > b'>yes</p>", "yes"),
        ("", ""),
        # Frames whose names only mention what a page has.
        ("<div class='layout with-sidebar'><article><p>whole story</p></article></div>", "whole story"),
        ("<div class='layout with-sidebar'><p>whole story</p></div><div class='sidebar-left'>no</div>", "whole story"),
        ("<div id='page' class='has-footer no-ads'><article>whole story</article><footer>no</footer></div>", "whole story"),
        ("<div class='content-sidebar-wrap'><p>whole story<div class='siteFooter'>no</div></div>", "whole story"),
        ("<div class='sidebar'><article>whole story</article></div>", "whole story"),
        # A whole page in a form, with and without an article; a form on its own.
        ("<form id='aspnetForm'><nav>no</nav><article><p>whole story</p></article></form>", "whole story"),
        ("<form id='aspnetForm'><nav>no</nav><p>whole story</p><input></form>", "whole story"),
        ("<form><label>no</label><input></form>", ""),
        # Menus without an end.
        ("<body><nav><ul><li>no</li></ul><article>whole story</article></body>", "whole story"),
        ("<body><nav><ul><li>no</li></ul><div><p>whole story</p></div></body>", "whole story"),
        ("<body><nav><a>no</a> <a>no</a><p>whole story</p><p>goes on</p></body>", "whole story goes on"),
        ("<body><nav><ul><li>no</li></ul><p>no</p></nav><p>yes</p>", "yes"),
        # Teasers do not take the place of the text.
        ("<p>the whole story</p><aside><article>teaser</article></aside>", "the whole story"),
        ("<main>story</main><aside><article>a longer teaser</article></aside>", "story"),
        ("<div hidden><article>no</article></div>yes", "yes"),
        # Words in other attributes say nothing.
        ("<article style='overflow:hidden' data-id='sidebar' title='hidden comments'>yes</article>", "yes"),
    ],
)
def test_blocks(source, text):
    found = pages.blocks(source)
    words = sum(len(t.split(" ")) + 1 for _, t in found)
    assert pages.main_text(found, np.zeros(words, bool)) == text


def unmarked(k):
    same = "Read all of our other fine stories here today"
    return f"<div>{same}</div><div>story number{k} tells of thing{k} and place{k}</div><div>{same} again</div>"


def rows(spark, count):
    made = [(k, f"http://Host.example/{k}", unmarked(k), "x", 1) for k in range(count)]
    return spark.createDataFrame(made, "page_id long, url string, html string, text string, place int")


def test_repeats_of_a_host_go(spark):
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(rows(spark, 6)).collect()}
    assert all(f"story number{k} tells of thing{k} and place{k}" in t and "fine stories" not in t for k, t in got.items())
    # On fewer pages than it takes nothing is boilerplate.
    assert all("fine stories" in r["text"] for r in pages.extract_pages(rows(spark, 2)).collect())


def test_shards_of_a_large_host(spark, monkeypatch):
    monkeypatch.setattr(pages, "SHARD_PAGES", 4)
    got = pages.extract_pages(rows(spark, 8).repartition(1)).collect()
    assert len(got) == 8 and all("fine stories" not in r["text"] for r in got)


def test_repeated_is_brute_force():
    rng = np.random.default_rng(3)
    streams = [[" ".join(rng.choice(list("abc"), 12)) for _ in range(3)] for _ in range(6)]
    flat = [sum(([*b.split(), "|"] for b in s), []) for s in streams]
    seen = {}
    for k, f in enumerate(flat):
        for a in range(len(f) - pages.RUN + 1):
            seen.setdefault(tuple(f[a : a + pages.RUN]), set()).add(k)
    for f, got in zip(flat, pages.repeated(streams), strict=True):
        want = np.zeros(len(f), bool)
        for a in range(len(f) - pages.RUN + 1):
            if len(seen[tuple(f[a : a + pages.RUN])]) >= pages.PAGES:
                want[a : a + pages.RUN] = True
        assert got.tolist() == want.tolist()


def test_odd_rows(spark):
    made = [(1, None, None, "a"), (None, "no host", "<p>x</p>", None), (2, "//h/", "<p>x</p>", "a"), (2, "//h/", "<p>x</p>", "a"), (3, "http://u@h:1/", "<nav>x", "a")]
    table = spark.createDataFrame(made, "page_id long, url string, html string, host string")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in pages.extract_pages(table).collect())
    assert got == [("1", "", 0), ("2", "x", 1), ("2", "x", 1), ("3", "", 0), ("None", "x", 1)]
    assert pages.extract_pages(table.limit(0)).count() == 0


def test_has_article_is_that_of_blocks(spark, sf):
    given = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    given += ["<p>a</p>", "<nav><article>a", "<aside><article>a</article></aside><p>long text</p>", "<main></main>x", ""]
    for source in given:
        assert pages.has_article(source) == any(mark == pages.ARTICLE for mark, _ in pages.blocks(source))


def test_hosts_of_each_kind(spark, monkeypatch):
    """Hosts without repeats to look for, small and large ones, give the same however they meet."""
    made = [(k, f"http://h{k % 3}/{k}", f"<article>own {k}</article>" if k % 3 == 0 else unmarked(k)) for k in range(30)]
    made += [(100 + k, "http://h2/", unmarked(100 + k)) for k in range(5)]
    table = spark.createDataFrame(made, "page_id long, url string, html string")
    want = sorted(map(tuple, pages.extract_pages(table).collect()))
    assert len(want) == 35 and not any("fine stories" in t for _, _, t, _ in want)
    monkeypatch.setattr(pages, "SHARD_PAGES", 12)
    assert sorted(map(tuple, pages.extract_pages(table).collect())) == want
    monkeypatch.setattr(pages, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, pages.extract_pages(table).collect())) == want
