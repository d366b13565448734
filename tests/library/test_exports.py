"""Exports, saved profiles, presets, and small lists that reports show."""

import json

import pytest
from pyspark.sql import functions as F

from tests.library.test_idml import files, t  # noqa: F401  fixtures


def test_structure_of_pages(t):  # noqa: F811
    from quoin.plans import structure

    items = structure.placed_items(t["item"], t["page"])
    pages = {json.loads(r.json)["name"]: json.loads(r.json) for r in structure.structure_json(items, t["page"], t["story"], t["run"], t["style"], t["layer"]).collect()}
    assert len(pages) == 2 and all(p["spread"] for p in pages.values())
    frames = {f["id"]: f for p in pages.values() for f in p.get("frames") or []}
    assert set(frames) == {"t1", "t2", "t3"} and frames["t1"]["readiness"] == "approx" and frames["t2"]["reasons"] == ["story not found"] and frames["t2"]["paragraph_styles"] == []
    of = {r.page: r.box for r in t["page"].select(F.col("ord").alias("page"), "box").collect()}
    for r in items.where("page is not null").collect():
        f = frames[r.item_id]
        assert (f["x"], f["y"], f["w"]) == (r.box.x - of[r.page].x, r.box.y - of[r.page].y, r.box.w)
    told = {(r.doc_id, r.story_id): r.styles for r in structure.story_styles(t["run"], t["style"]).collect()}
    assert frames["t1"]["paragraph_styles"] == told["a", frames["t1"]["story"]] and len(told["a", "u1"]) == len(set(told["a", "u1"])) >= 2


def test_styles_in_the_order_met(spark):
    from quoin.plans.structure import story_styles

    run = spark.createDataFrame([("d", "s", k, p) for k, p in enumerate(["ParagraphStyle/Z", "A", "ParagraphStyle/Z", "ParagraphStyle/$ID/Normal", "ParagraphStyle/gone", None])], "doc_id string, story_id string, para_ord int, para_style string")
    style = spark.createDataFrame([("d", "para", "ParagraphStyle/Z", "Zed"), ("d", "para", "ParagraphStyle/A", "Body"), ("d", "char", "ParagraphStyle/gone", "no"), ("d", "para", "ParagraphStyle/$ID/Normal", "$ID/Normal")], "doc_id string, kind string, self string, name string")
    assert story_styles(run, style).first().styles == ["Zed", "Body", "Normal", "gone"]


def test_first_references_as_met(t):  # noqa: F811
    from quoin.plans import structure

    spark = t["item"].sparkSession
    frames = t["item"].where("item_id = 't2'").drop("item_id", "ord")
    more = frames.crossJoin(spark.range(30).select(F.concat(F.lit("f"), (99 - F.col("id")).cast("string")).alias("item_id"), (F.col("id") + 100).cast("int").alias("ord")))
    found = {r.code: r for r in structure.findings(t | {"item": t["item"].unionByName(more)}).collect()}["frame-without-story"]
    assert found["count"] == 31 and found.refs == ["t2", *(f"f{99 - k}" for k in range(19))]


def test_profiles_are_saved(spark, tmp_path):
    from quoin.plans.preflight import DEFAULTS, load_profiles, profile_table, save_profiles

    save_profiles(profile_table(spark, {"a": {"min_ppi": 150.5, "allow_rgb": True}, "b": {}}), str(tmp_path / "p"))
    got = {r.profile_id: r.asDict() for r in load_profiles(spark, str(tmp_path / "p")).collect()}
    assert got["b"] == {"profile_id": "b"} | DEFAULTS and got["a"]["min_ppi"] == 150.5 and got["a"]["allow_rgb"] and not got["a"]["allow_spot"]


def test_presets(spark):
    from quoin.plans.fontmap import font_map, preset, unknown_families

    fonts = spark.createDataFrame([("d", "Old", "Semibold Italic"), ("d", "Old", "Book"), ("d", "Georgia (TT)", None), ("e", "Times New Roman", "Regular")], "doc_id string, family string, style string")
    entries = preset(fonts, "classic")
    got = {(r.doc_id, r.key): (r.family, r.style) for r in font_map(entries).collect()}
    assert got == {("d", "old|semibold italic"): ("Times New Roman", "Bold"), ("d", "old|book"): ("Georgia", "Regular"), ("d", "georgia|regular"): ("Georgia", "Regular"), ("e", "times new roman|regular"): ("Georgia", "Regular")}
    assert {tuple(r) for r in unknown_families(font_map(entries), fonts).collect()} == {("d", "Times New Roman"), ("e", "Georgia")}


@pytest.mark.parametrize("page,font,want", [(None, None, 4), (1, None, 2), (None, "B", 2), (1, "B", 1), (9, None, 0)])
def test_filters_of_runs(spark, page, font, want):
    from quoin.plans.typography import shown_runs

    runs = spark.createDataFrame([(0, "A"), (1, "A"), (1, "B"), (2, "B")], "page int, font_key string")
    assert shown_runs(runs, page, font).count() == want


def test_small_reports(spark):
    from quoin.functions.text import and_more, font_label, is_light
    from quoin.plans import structure

    names = spark.createDataFrame([("Light",), ("Extra-Light Italic",), ("Highlight",), ("Thin",), (None,), ("Bold",)], "s string")
    assert [bool(r.l) for r in names.select(is_light(F.col("s")).alias("l")).collect()] == [True, True, False, True, False, False]
    row = spark.range(1).select(and_more(F.array(*map(F.lit, "abcd")), 2).alias("a"), and_more(F.array(F.lit("a")), 2).alias("b"), font_label(F.lit("ABCDEF+Minion-Bold")).alias("c")).first()
    assert (row.a, row.b) == ("a, b and 2 more", "a") and "Minion" in row.c
    items = spark.createDataFrame([("d", "TextFrame", "L1", False, None), ("d", "TextFrame", "L1", True, None), ("d", "Rectangle", "L1", False, ["Image:a.tif", "PDF:b.pdf", "Image:c.tif"]), ("d", "Group", "L2", False, ["Image:x"])], "doc_id string, kind string, layer_id string, is_master boolean, placed array<string>")
    layer = spark.createDataFrame([("d", "L1", "one"), ("d", "L2", "two")], "doc_id string, self string, name string")
    assert {r.self: r.frames for r in structure.layer_stats(layer, items).collect()} == {"L1": 1, "L2": 0}
    assert {r.format: r.n for r in structure.art_formats(items).collect()} == {"Image": 2, "PDF": 1}
    page = spark.createDataFrame([("d", 0, 100.0, 50.04, False), ("d", 1, 100.0, 50.0, False), ("d", 2, 70.0, 50.0, False), ("d", 0, 9.0, 9.0, True)], "doc_id string, ord int, width_pt double, height_pt double, is_master boolean")
    assert [(r.bucket, r.n) for r in structure.page_sizes(page).orderBy("place").collect()] == [("100.0x50.0", 2), ("70.0x50.0", 1)]
