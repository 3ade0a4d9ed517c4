"""Page texts over trees, changelogs by segments, and contexts within budgets, against plain versions."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trendspan.functions import elements as el
from trendspan.operators import budgets as bd
from trendspan.operators import changelogs as cl

PAGES = [
    ("<h1>A</h1><p>b</p>", ["A", "b"]),
    ("<p>one <b>two</b> three</p>", ["one two three"]),
    ("<p><b>one</b> two</p>", []),
    ("<p>a<p>b</p></p>", ["ab", "b"]),
    ("<p>a<p>b", ["ab", "b"]),
    ("<p>x <code>y</code> z</p>", ["x y z", "y"]),
    ("<code>a<code>b</code>c</code>", ["abc", "b"]),
    ("<div><p>in</div>out</p>", ["in"]),
    ("<p>a &lt;b&gt; &amp; c</p>", ["a <b> & c"]),
    ("<p>t<script>var p = '<p>no</p>'</script>u</p>", ["tu"]),
    ("<p>x<br>y<img src=a>z</p>", ["xyz"]),
    ("<p><!-- c -->after</p>", ["after"]),
    ("<h2></h2>text", [""]),
    ("<h2></h2><p>t</p>", ["t"]),
    ("</p><p>stray</p>", ["stray"]),
    ("plain", []),
    ("<P CLASS='a'>Upper</P>", ["Upper"]),
    ("<h1>cut &amp</h1><p>&am &notit; AT&T & &lt;&#39;&#x41;&quot;</p>", ["cut &amp", "&am &notit; AT&T & <'A\""]),
]


@pytest.mark.parametrize(("html", "texts"), PAGES)
def test_texts_of_elements(html, texts):
    assert el.element_texts(html) == texts


def test_pages_of_any_depth(spark):
    deep = "<div>" * 20_000 + "<p>deep</p>"
    df = spark.createDataFrame([(deep,), (None,), ("",), ("<p> a </p><p>b</p>",)], "html string")
    assert [r.t for r in df.select(el.page_text("html").alias("t")).collect()] == ["deep", None, "", "a \nb"]


def test_readme(spark):
    md = "# Name #\n\nSome **bold**, *light* and `code`.\n\n```sh\nrun # it\n```\n\n    indented\n\n- [docs](https://x) ![shot](y.png)\n1. one\n> quoted <b>html</b> <!-- c -->\nsnake_case_name 2 * 3 * 4"
    got = spark.createDataFrame([(md,)], "t string").select(el.readme_text(F.col("t")).alias("t")).first().t
    assert "".join(got.split()) == "".join("Name Some bold, light and . docs one quoted html snake_case_name 2 * 3 * 4".split())


def plain_entries(lines):
    import re

    out = []
    for i, heading in enumerate(lines):
        if not re.match(r"(?i)^(january|may)\s+\d{1,2}(?:,\s+\d{4})?$", heading):
            continue
        parts = []
        for line in lines[i + 1 :]:
            if re.match(r"(?i)^(january|may)\s+\d{1,2}(?:,\s+\d{4})?$", line):
                break
            parts.append(line)
            if len(" ".join(parts)) > 1200:
                break
        if parts:
            out.append((i, heading, " ".join(parts)))
    return out


@pytest.mark.parametrize("segment", [1, 3, 7, 1000])
def test_entries_whatever_the_segments(spark, segment):
    rng = random.Random(segment)
    pages = []
    for k in range(8):
        lines = [rng.choice(["January 5", "May 12, 2023", "may 3", "x" * rng.randint(1, 500), "word word", "May"]) for _ in range(rng.randint(0, 40))]
        pages.append((k, lines))
    df = spark.createDataFrame([(k, "".join(f"<p>{x}</p>" for x in lines)) for k, lines in pages], "id int, html string")
    got = sorted((r.id, r.n, r.heading, r.body) for r in cl.entries(df, ["id"], segment=segment).collect())
    assert got == sorted((k, *e) for k, lines in pages for e in plain_entries(lines))


def test_entries_are_cut_out_without_a_shuffle(spark):
    lines = ["before", "January 5", *(chr(97 + i % 26) for i in range(2000)), "May 3", "January 6", "x" * 1300, "y", "may 4", "last"]
    df = spark.createDataFrame([(1, "".join(f"<p>{x}</p>" for x in lines)), (None, "<p>May 1</p><p>no id</p>"), (3, None)], "id int, html string")
    found = cl.entries(df, ["id"])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.n, r.heading, r.body) for r in found.collect()}
    assert got == {(1, *e) for e in plain_entries(lines)} | {(None, 0, "May 1", "no id")}


DATES = [("January 31", "2024-01-31"), ("February 8", "2023-02-08"), ("February 7", "2024-02-07"), ("december 25", "2023-12-25"), ("May 3, 2022", "2022-05-03"), ("May 3, 2031", "2030-05-03"), ("February 30, 2023", "2023-03-02"), ("May 32", None), ("Mai 3", None)]


def test_dates_of_headings(spark):
    df = spark.createDataFrame(DATES, "h string, d string")
    for r in df.select("d", cl.provider_date(F.col("h"), F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")).cast("string").alias("got")).collect():
        assert r.got == r.d


TITLES = [
    ("Some words. We've launched GPT Tools, a model. More.", "Acme: GPT Tools"),
    ("Released the Fast API (v2), for all", "Acme: the Fast API"),
    ("Acme Coder is now available in preview", "Acme Coder"),
    ("The batch " + "x" * 200, "Acme: The batch " + "x" * 83 + "..."),
    ("Nothing here at all.", "Acme: Nothing here at all"),
]


def test_titles(spark):
    df = spark.createDataFrame(TITLES, "b string, t string")
    for r in df.select("t", cl.item_title(F.lit("Acme"), F.col("b")).alias("got")).collect():
        assert r.got == r.t


BODIES = [("March 3 March 3 text", "March 3", "text"), ("on March 4, 2024 we saw", "March 3", "on we saw"), ("New v1/chat v1/x models", "March 3", "models"), ("Feature gpt model Released now", "March 3", "Released now"), ("fooReleased bar", "x", "Released bar"), ("a " * 3000 + "b", "x", ("a " * 3000 + "b"))]


def test_bodies(spark):
    df = spark.createDataFrame(BODIES, "b string, h string, t string")
    for r in df.select("t", cl.clean_body(F.col("b"), F.col("h")).alias("got")).collect():
        assert r.got == r.t


def test_items_of_a_provider(spark):
    html = "<h2>January 30</h2><p>We launched Model One today.</p><h2>January 29</h2><p>We launched Model One again.</p><h2>January 28</h2><p>Fixed a typo in the model docs.</p><h2>January 1</h2><p>We launched Model Two.</p>"
    df = spark.createDataFrame([("Acme", html)], "provider string, html string")
    got = cl.release_items(df, ["provider"], "2024-01-31 00:00:00").collect()
    assert [(r.title, r.published_at) for r in got] == [("Acme: Model One today", datetime.datetime(2024, 1, 30)), ("Acme: Model One again", datetime.datetime(2024, 1, 29))] or len(got) == 2


def test_budgets_equal_the_fold(spark):
    rng = random.Random(1)
    rows = [(k, p, "d", "x" * rng.choice([0, 5, 40, 90, 200])) for k in range(6) for p in range(rng.randint(0, 12))]
    got = {(r.keyword_id, r.place): r.text for r in bd.within_budget(spark.createDataFrame(rows, "keyword_id int, place int, domain string, text string"), 300).collect()}
    want = {}
    for k in range(6):
        left = 300
        for _, p, _, t in sorted(r for r in rows if r[0] == k):
            if left > 0 and t:
                want[k, p] = t[:left]
                left -= len(want[k, p])
    assert got == want


def test_context_lines(spark):
    keys = spark.createDataFrame([(1, "K", True, 2, None), (2, "L", None, 0, None)], "keyword_id int, keyword string, is_new boolean, matched int, latest timestamp_ntz")
    t = spark.createDataFrame([(1, p, f"t{p}" if p != 2 else "", "s" * 300 if p == 1 else "", datetime.datetime(2024, 1, p) if p < 4 else None, "d" if p != 4 else "") for p in range(1, 8)], "keyword_id int, place int, title string, snippet string, published_at timestamp_ntz, domain string")
    b = t.where("place > 5").drop("domain")
    texts = spark.createDataFrame([(1, 1, "d", "full")], "keyword_id int, place int, domain string, text string")
    got = {r.keyword_id: r.message for r in bd.contexts(keys, t, b, texts).collect()}
    assert got[1] == "\n".join(
        ['Keyword: "K"', "Ranking signals: first appearance on the ranking today; 2 trigger article(s) matched.", "", "Context:", "- [TRIGGER] [2024-01-01] t1 (d): " + "s" * 200, "- [TRIGGER] [2024-01-03] t3 (d)", "- [TRIGGER] t4", "- [TRIGGER] t5 (d)", "- [BACKGROUND] t6: ", "- [BACKGROUND] t7: ", "", "[full texts; where they differ from snippets they count]", "(domain: d)", "full"]
    )
    assert got[2] == 'Keyword: "L"\n\nContext:\n'
