"""Operators against what the whole job asks, where they once did a part of it."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import chat_rotation, html_extraction, mixing, url_filters
from lamina.llm.common import cut

PAGES = "page_id long, url string, html string"


def kept(body, *neighbours):
    return html_extraction.judge(*html_extraction.lines_of(body), [html_extraction.lines_of(n)[0] for n in neighbours])


# --- html ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("group_pages", [1, 2, 3, 7])
def test_texts_do_not_depend_on_the_size_of_ranges(spark, group_pages):
    rng = random.Random(7)
    make = lambda k, own: f"<div>Site name</div><div>Section {k % 6}</div><p>{own}</p><div>{rng.choice('xyz')}</div><div>All rights</div>"
    rows = [(k, f"http://{'ab'[k % 2]}.c/{k % 6}/{k:03}", make(k, f"own {k // 3}")) for k in range(60)]
    rows += [(100, "http://a.c/0/000", make(0, "same place")), *[(101, "http://a.c/0/000", make(0, "same row"))] * 3]
    rows += [(None, "http://a.c/2/020", make(2, "no id")), (102, None, make(0, "no url")), (103, None, None), (None, None, make(1, "neither"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, PAGES)
    texts = lambda size: sorted(map(str, html_extraction.extract(df, size).collect()))
    whole = texts(1000)
    assert len(whole) == len(rows) and texts(group_pages) == whole
    assert sum("Section" in x for x in whole) < 20
    assert sorted(map(str, html_extraction.extract(df, group_pages, 5).collect())) == whole


@pytest.mark.parametrize(
    "markup",
    [
        '<p><a href="/p?id=42&utm_source=social">kept</a></p>',
        "<p><a href=/p?id=42&class=ad>kept</a></p>",
        '<p data-id="comments-3">kept</p>',
        '<div title="the hidden cost">kept</div>',
        '<div title="a role=banner, class=ad">kept</div>',
        '<div data-hidden aria-hidden="false">kept</div>',
        '<h2 id="related-work">kept</h2>',
        '<h3 id="alert-levels" title="x">kept</h3>',
    ],
)
def test_markup_that_is_no_furniture(markup):
    for body in (markup, f"<article>{markup}</article>", f"<main id='menu-costs' class='has-sidebar'>{markup}</main>"):
        assert kept(body)[0] == "kept", body


@pytest.mark.parametrize("markup", ['<section id="social-impact">kept</section>', '<div class="share-of-votes">kept</div>', '<h2 class="widget">kept</h2>'])
def test_slugs_in_an_article_are_no_furniture(markup):
    assert html_extraction.lines_of(f"<article>{markup}</article>") == (["kept"], "a")


@pytest.mark.parametrize(
    "markup",
    ["<div class='x comments'>no</div>", "<p hidden>no</p>", "<p title='x' hidden=''>no</p>", "<p HIDDEN/>no</p>", "<div role=search>no</div>", '<div title="a > b" CLASS = "ad">no</div>', '<div class="ad>no</div>'],
)
def test_furniture_by_markup(markup):
    for body in (markup, f"<article>{markup}</article>"):
        assert kept(body)[0] == "", body


def test_what_the_differencing_decides_and_what_the_markup():
    page = "<nav>menu</nav><div>Site</div><p>{0}</p><div class=ad>buy {0}</div><footer>end</footer>"
    assert kept(page.format("one"), page.format("two")) == ("one", 5, 3, 0, 1)
    assert kept(page.format("one")) == ("Site\n\none", 5, 0, 0, 3)
    copied = "<nav>menu</nav><article><p>same</p></article><footer>{0}</footer>"
    assert kept(copied.format("x"), copied.format("y")) == ("same", 3, 2, 1, 1)
    assert kept(copied.format("x"), copied.format("x")) == ("same", 3, 0, 0, 2)
    assert kept("<article><p>one</p><div class='notice-period share-price'>The share price fell.</div><p class='ad-hoc'>two</p></article>")[0] == "one\n\nThe share price fell.\n\ntwo"


def test_pages_of_any_kind(spark):
    odd = [(1, "http://a.b/1", "<p>x"), (1, "http://a.b/1", "<p>x"), (None, None, None), (2, "", ""), (3, "http://a.b/2", "<p>x<p>" + "long " * 50_000)]
    df = spark.createDataFrame(odd, PAGES).withColumns({c: F.lit("mine") for c in ("host", "path", "part", "beside", "lines", "zones", "tie", "text", "n_chars")})
    got = {(r["page_id"], r["text"][:4], r["n_chars"]) for r in html_extraction.report(df).collect()}
    # the first of the two copies has no neighbour but the other, the second has page 3, whose line it shares
    assert got == {(1, "", 0), (1, "x", 1), (None, "", 0), (2, "", 0), (3, "long", 249_999)}
    assert html_extraction.report(spark.createDataFrame([], PAGES)).count() == 0

# --- url filters -----------------------------------------------------------------------------------------------------------


def test_entries_of_any_depth_and_urls_with_user_names(spark):
    day = datetime.date(2024, 5, 1)
    entries = [("block", k, "add", day) for k in ("h.io/a/b/c", "h.io/a/b/c/d/e/f/g", "listed.example", "user.name")] + [("allow", "h.io/a/b/c/d", "add", day)]
    urls = {
        "http://h.io/a/b": None,
        "http://h.io/a/b/c": "block:h.io/a/b/c",
        "http://h.io/a//b/c/x?q=/d": "block:h.io/a/b/c",
        "http://h.io/a/b/cc": None,
        "http://h.io/a/b/c/d/e/f": "allow:h.io/a/b/c/d",
        "http://me@h.io:80/a/b/c/d/e/f/g/h": "block:h.io/a/b/c/d/e/f/g",
        "http://user:pw@listed.example/x": "block:listed.example",
        "http://user.name@other.example/": None,
        "http://a@user.name@www.listed.example:8080": "block:listed.example",
        "http://other.example/@listed.example/": None,
        "http://user.name@/x": None,
        "http://user.name/me@h.io": "block:user.name",
    }
    captures = spark.createDataFrame([(k, u, day) for k, u in enumerate(urls)], "page_id long, url string, fetched date")
    log = "list string, key string, action string, since date"
    got = {r["url"]: r for r in url_filters.evaluate(captures, spark.createDataFrame(entries, log)).collect()}
    assert {u: r["decided_by"] for u, r in got.items()} == urls
    assert all(r["blocked"] == (r["decided_by"] or "").startswith("block") for r in got.values())
    assert got["http://me@h.io:80/a/b/c/d/e/f/g/h"]["n_active"] == 3


def test_url_filters_with_clashing_columns_and_empty_tables(spark):
    day = datetime.date(2024, 5, 1)
    names = ("key", "month", "since", "until", "n_active", "best", "blocked", "decided_by", "levels", "first", "last")
    captures = spark.createDataFrame([(1, "http://a.b/" + "x/" * 2000, day), (1, "http://a.b/" + "x/" * 2000, day)], "page_id long, url string, fetched date")
    entries = spark.createDataFrame([("block", "a.b/x/x", "add", day), ("block", "a.b/x/x", "add", day)], "list string, key string, action string, since date")
    odd = captures.withColumns({c: F.lit("mine") for c in names})
    got = url_filters.evaluate(odd, entries.withColumns({c: F.lit("mine") for c in ("url", "fetched", "until", "month", "_before", "levels")})).collect()
    assert [(r["n_active"], r["blocked"], r["decided_by"]) for r in got] == [(1, True, "block:a.b/x/x")] * 2
    assert url_filters.evaluate(odd.limit(0), entries).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------------


def test_stages_on_odd_clashing_and_empty_rows(spark, clashing, empty, tmp_path):
    folder = str(tmp_path / "tables")
    clashing.filter("false").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "the same row"), (None, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (clashing, empty):
        columns, n = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, folder))
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert docs.columns == columns
        assert docs.filter("taken <= 0").count() == 0 and (docs.count() > 0) == (n > 0)
        if n:
            assert docs.filter("_score = 'mine' and may = 'mine' and key = 'mine'").count() == docs.count()


@pytest.mark.parametrize("closed", ["<svg/>", "<SVG />", "<iframe src='/a' />", "<iframe src=/a/>", "<button/>", '<object data="x"/>', "<nav/>", "<textarea/>", "<form action=/s/>"])
def test_what_closes_itself_holds_nothing(closed):
    assert kept(f"<article><p>one</p>{closed}<p>two</p></article>")[0] == "one\n\ntwo"


def test_a_slash_of_a_bare_value_closes_nothing():
    assert kept("<article><p>one</p><form action=/search/><p>ask</p></form><p>two</p></article>")[0] == "one\n\ntwo"
    assert kept("<article><p>one</p><iframe src=/a/>no</iframe><p>two</p></article>")[0] == "one\n\ntwo"


@pytest.mark.parametrize("name", ["content with-sidebar", "social-science", "no-comments"])
def test_differencing_overrules_a_word_of_a_class(name):
    page = '<div>Site</div><div class="{0}"><p>{1}</p><p>Follow us</p></div>'
    assert kept(page.format(name, "own words"), page.format(name, "other words"))[0] == "own words"
    assert kept(page.format(name, "own words"), page.format(name, "own words").replace("Site", "x"))[0] == "Site"  # a shared text goes
    assert kept(page.format(name, "own words"))[0] == "Site"  # without a neighbour hints are followed
    assert kept(f'<div class="{name}">all there is</div>')[0] == "all there is"  # unless nothing would be left
    assert kept(f'<div class="{name}"><article>text</article><p>beside</p></div>')[0] == "text"
    assert kept(f'<div class="{name}"><article>teaser</article></div><article>text</article>')[0] == "text"
    assert kept('<div class="sidebar"><article>teaser</article></div><p>text</p>')[0] == "text"


def test_a_text_changes_with_its_neighbour(spark):
    page = "<div>Site</div><div class='page-content with-sidebar'><p>{0}</p><p>{1}</p></div>"
    rows = [(1, "http://a.b/1", page.format("first", "both")), (2, "http://a.b/2", page.format("second", "both")), (3, "http://c.d/1", page.format("first", "both"))]
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {1: "first", 2: "second", 3: "Site"}


# --- ids ------------------------------------------------------------------------------------------------------------------


def test_a_conversation_called_null_is_not_the_one_without_an_id(spark):
    rows = [("null", 0, "ann", "a"), (None, 0, "bob", "b")]
    got = chat_rotation.rotate(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert sorted((str(r["conv_id"]), r["speaker"], r["n_turns"]) for r in got) == [("None", "bob", 1), ("null", "ann", 1)]


def test_rows_without_an_id_spread_over_the_ranges(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat_ws(" ", F.lit("a b"), "id").alias("text"))
    ranges = mixing.sized(docs, 1).groupBy(F.substring("key", 1, 2)).count()
    assert ranges.count() == 256 and ranges.agg(F.max("count")).first()[0] < 200
    few = docs.filter(F.md5("text") < "05").cache()
    n = few.count()
    one, two = (sorted(r["taken"] for r in mixing.mix(few, digits=d).collect()) for d in (1, 4))
    assert one == two == [3] * n and n > 200
