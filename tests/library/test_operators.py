"""Small goldens of the operators and functions."""

import pytest
from pyspark.sql import functions as F

from quoin.functions import numbers, text
from quoin.operators import ordered
from quoin.plans.alternatives import alternatives
from quoin.plans.roles import guess_role, mood_of, remap_styles

CASES = [
    ("the quick brown fox jumps", "the quick brown fox jumps over lazy", "overset"),
    ("the quick brown fox", "cat the quick brown fox", "differs"),
    ("the quick brown fox", "fox cat quick", "overset"),
    ("alpha beta", "alpha beta c d e f", "mismatch"),
    ("adven ture begins", "adventure begins", "ok"),
    ("one fox here", "fox fox", "overset"),
    ("café", "cafe", "ok"),
    ("any", "", "no-text"),
]


def test_containment(spark):
    pages = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(CASES)], "page int, text string")
    frames = spark.createDataFrame([(i, "f", s) for i, (_, s, _) in enumerate(CASES)] + [(6, "g", "cafe")], "page int, frame string, text string")
    words = lambda df, *c: df.select(*c, F.posexplode(text.words(F.col("text"))).alias("pos", "word"))
    v = ordered.frame_verdicts(ordered.contained_words(words(frames, "page", "frame"), words(pages, "page"), ["page"], ["frame"]), ["page"], ["frame"])
    got = {r.page: r.status for r in ordered.page_verdicts(v, pages.select("page"), ["page"]).collect()}
    assert [got[i] for i in range(len(CASES))] == [s for _, _, s in CASES]
    first = {r.page: r for r in v.collect()}
    assert (first[0].first_missing, first[0].last_kept, first[1].trailing) == (5, "quick brown fox jumps", False)


@pytest.mark.parametrize("name,first,weight,slant", [("HelveticaNeueLTStd-BoldOblique", "Arimo", 700, "italic"), ("TimesNewRomanPSMT", "Tinos", 400, "normal"), ("StencilStd-Bold", "Stardos Stencil", 700, "normal"), ("Inter-Bold", "Inter", 700, "normal")])
def test_alternatives(spark, name, first, weight, slant):
    got = alternatives(spark.createDataFrame([(name,), ("Uncatalogued Example",), ("",)], "name string")).orderBy("place").collect()
    assert {r.name for r in got} == {name} and len(got) <= 3
    assert (got[0].family, got[0].weight, got[0].slant) == (first, weight, slant)
    if name == "StencilStd-Bold":
        assert got[1].different_style
    if name == "Inter-Bold":
        assert got[0].exact and not any(r.exact for r in got[1:])


def test_roles(spark):
    names = [("card title", 0.0, ""), ("item description", 0.0, ""), ("Small print", 0.0, ""), ("Body text", 0.0, ""), ("Foo", 18.0, "Bold"), ("Foo", 9.0, ""), ("Foo", 12.0, "")]
    df = spark.createDataFrame(names, "name string, size double, font_style string").select(guess_role(F.col("name"), F.col("size"), F.col("font_style")).alias("r"))
    assert [x.r for x in df.collect()] == ["card-heading", "item-description", "caption", "body", "section-heading", "caption", "none"]
    runs = spark.createDataFrame([("d", "P/A"), ("d", "P/AB")], "doc_id string, para_style string")
    styles = spark.createDataFrame([("d", "P/A", "body")], "doc_id string, self string, role string")
    assert sorted(x.para_style for x in remap_styles(runs, styles, ["doc_id"]).collect()) == ["P/AB", "ParagraphStyle/Role_body"]
    assert styles.select(mood_of(F.col("role"), "editorial").alias("m")).first().m.font == "Source Serif 4"


def test_scalars(spark):
    row = spark.range(1).select(
        numbers.half_up(F.lit(-2.5)).alias("a"), numbers.plain(F.lit(80.0)).alias("b"), text.unescape(F.lit("&amp;lt;")).alias("c"), text.clean_family(F.lit("Luminari (TT) ")).alias("d"),
        text.without_subset(F.lit("ABCDEF+Helvetica")).alias("e"), text.utf16_length(F.lit("a😀")).alias("f"), text.file_of(F.lit("file:/x/a+b%20c.tif")).alias("g"), text.page_list(F.array(*map(F.lit, range(8)))).alias("h"),
        numbers.number_or(F.lit(""), 5.0).alias("i"), numbers.number_or(F.lit("-1"), 5.0).alias("j"), text.font_label(F.lit("g_d0_f1")).alias("k"),
    ).first()
    assert tuple(row) == (-2, "80", "&lt;", "Luminari", "Helvetica", 3, "a+b c.tif", "1, 2, 3, 4, 5, 6 and 2 more", 0.0, 5.0, "")


def test_entry_without_corpus_part():
    import __spark_entry__ as e

    assert set(e.library.SQL) <= set(e.queries()) and callable(e.entry)


def test_inventory_breaks_ties_by_key(spark):
    from quoin.operators.aggregates import inventory

    rows = [("d", f"k{k * 7 % 30:02}", 1, 5) for k in range(30)]  # thirty keys of as many pages, uses and one first place
    events = spark.createDataFrame(rows, "doc string, key string, page int, seq int").repartition(5)
    got = inventory(events, ["doc"], "key", page="page", order="seq").collect()
    assert [x.key for x in sorted(got, key=lambda x: x.place)] == sorted(k for _, k, _, _ in rows)
