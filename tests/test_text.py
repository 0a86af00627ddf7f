import pytest
from pyspark.sql import functions as F

from tarnfold.functions import markup, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("raw, want", [
    ("a  b—c “d”", 'a b-c "d"'),
    (" x​…\t\ty \n\n\n\n z’s ", "x... y\n\nz's"),
    ("a \n b", "a\nb"), ("", ""), (None, ""), ("　 x﻿", "x"),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, text.normalize) == want


def test_clean(spark):
    assert one(spark, "the bud-\nget was\napproved\nPage 3 of 9\n-----", text.clean_extracted) == "the budget was approved"
    assert one(spark, "abc def", lambda c: text.clean_extracted(c, 3)) == "abc\n[truncated]"
    assert one(spark, "a-\nb-\nc\nd", text.rejoin_lines) == "ab-\nc d"
    assert one(spark, "PAGE 4\nPage x\n***\n====\n\nx", text.drop_page_furniture) == "Page x\n***\n\nx"


@pytest.mark.parametrize("raw, want", [
    ("August 3, 2026 at 7:00 PM - Business Meeting", ("2026-08-03", "7:00 PM", "Business Meeting")),
    ("August  13,2026 at 7:00pm - x", (None, None, "August 13,2026 at 7:00pm - x")),
    ("Special gathering, no date", (None, None, "Special gathering, no date")),
    ("May 1,2026 at 11:05  AM-Early - and long", ("2026-05-01", "11:05 AM", "Early - and long")),
    ("may 1, 2026 at 7:00 PM - x", (None, None, "may 1, 2026 at 7:00 PM - x")),
    ("May 1, 2026 at 7:00 PM - ", (None, None, "May 1, 2026 at 7:00 PM -")),
    ("Smarch 3, 2026 at 7:00 PM - x", (None, None, "Smarch 3, 2026 at 7:00 PM - x")),
    ("February 31, 2026 at 7:00 PM - x", (None, None, "February 31, 2026 at 7:00 PM - x")),
])
def test_titles(spark, raw, want):
    got = one(spark, raw, text.title_parts)
    assert (got.date, got.time, got.name) == want


def test_a_title_is_read_once(spark):
    df = spark.createDataFrame([("x",)], "t string")
    regexps = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    once = regexps(df.select(text.normalize(F.col("t"))))
    assert 0 < regexps(df.select(text.title_parts(F.col("t")).alias("p")).select("p.date", "p.time", "p.name")) <= once + 2  # a line of it, the date's commas


def test_headings(spark):
    got = one(spark, "5.A. Bond Presentation (30 minutes)", text.item_heading)
    assert tuple(got) == ("5.A.", "Bond Presentation", "30 minutes")
    assert tuple(one(spark, "Adjourn (roll call VOTE) ", text.item_heading)) == ("", "Adjourn", "roll call VOTE")
    for raw, want in [("U.S. trade", ("U.S.", "trade", "")), ("12.5 million", ("12.", "5 million", "")), ("A.B", ("A.", "B", "")), ("plain", ("", "plain", "")), ("", ("", "", "")), ("x (a) (Discussion)", ("", "x (a)", "Discussion")), ("x (vote) y", ("", "x (vote) y", "")), ("(action)", ("", "", "action")), ("3. y (see note)", ("3.", "y (see note)", ""))]:
        assert tuple(one(spark, raw, text.item_heading)) == want


@pytest.mark.parametrize("href, want", [("https://x/y", "https://x/y"), ("//h/z", "https://h/z"), ("/p?q", "https://a.b/p?q"), ("z", "https://a.b/c/z")])
def test_urls(spark, href, want):
    assert one(spark, href, lambda c: text.resolve_url(c, "https://a.b/c/d")) == want


def test_escapes(spark):
    assert one(spark, "<b>&\"'", markup.escape_html) == "&lt;b&gt;&amp;&quot;'"
    assert one(spark, "<img src=x>\x01y\x02", markup.highlight) == "&lt;img src=x&gt;<mark>y</mark>"
    assert one(spark, None, markup.highlight) == "" and one(spark, None, markup.escape_xml) == ""
    assert one(spark, "Bell\x07 schedule\x00 'x'", markup.escape_xml) == "Bell schedule &apos;x&apos;"
    assert [one(spark, s, markup.has_match) for s in ("a\x01b\x02", "ab", None)] == [True, False, False]


def test_formats(spark):
    assert one(spark, "2026-08-03", markup.show_date) == "Aug 3, 2026"
    assert one(spark, None, markup.show_date) == one(spark, "soon", markup.show_date) == "Undated"
    assert one(spark, 6_849_999, markup.show_bytes, "long") == "6.8 MB" and one(spark, 999_499, markup.show_bytes, "long") == "999 KB"
    got = one(spark, "5.A.", lambda c: markup.context_line(F.lit("Business Meeting"), F.lit("2026-08-03"), c))
    assert got == "Business Meeting · 2026-08-03 · item 5.A."
    assert one(spark, "a b/c", lambda c: markup.deep_link(F.lit("u"), c)) == "u#a%20b%2Fc"
    assert one(spark, "odd", markup.kind_label) == "odd"


def test_block_text(spark):
    page = "<div>a<br>b</div><p>c &amp; &lt;d&gt;</p><script>no()</script><td>e</td><td>f</td><!-- g -->"
    assert one(spark, page, lambda c: text.block_text(text.drop_chrome(c))) == "a\nb\nc & <d>\nef"
