"""Packages written for the purpose: cascade, structure, print checks, text check, font map."""

import pytest
from pyspark.sql import functions as F

from quoin.plans import fontmap, preflight, printcheck, structure
from quoin.sources import idml


def style(kind, self, based, font=None, font_style=None, size=None):
    attrs = "".join(f' {a}="{v}"' for a, v in (("FontStyle", font_style), ("PointSize", size)) if v)
    inner = (f'<BasedOn type="string">{based}</BasedOn>' if based else "") + (f'<AppliedFont type="string">{font}</AppliedFont>' if font else "")
    return f'<{kind}Style Self="{self}" Name="{self}"{attrs}><Properties>{inner}</Properties></{kind}Style>'


def crange(text, char="CharacterStyle/$ID/[No character style]", attrs="", font=None):
    return f'<CharacterStyleRange AppliedCharacterStyle="{char}"{attrs}>' + (f"<Properties><AppliedFont type=\"string\">{font}</AppliedFont></Properties>" if font else "") + f"<Content>{text}</Content></CharacterStyleRange>"


def para(style, *ranges):
    return f'<ParagraphStyleRange AppliedParagraphStyle="{style}">' + "".join(ranges) + "<Br/></ParagraphStyleRange>"


P = "ParagraphStyle/"
STYLES = '<?xml version="1.0"?><idPkg:Styles xmlns:idPkg="x">' + "".join([
    style("Character", "CharacterStyle/$ID/[No character style]", None), style("Character", "CharacterStyle/Emph", "$ID/[No character style]", font_style="Italic"),
    style("Paragraph", P + "$ID/NormalParagraphStyle", None, "Luminari (TT)", "Regular", 8), style("Paragraph", P + "Body", "$ID/NormalParagraphStyle", "Kereru", "Bold"),
    style("Paragraph", P + "Plain", P + "Body"), style("Paragraph", P + "BoldOnly", P + "$ID/NormalParagraphStyle", font_style="Bold"),
]) + "</idPkg:Styles>"
STORY = '<?xml version="1.0"?><idPkg:Story xmlns:idPkg="x"><Story Self="u1">' + "".join([
    para(P + "Body", crange("A style-driven "), crange("local style ", attrs=' FontStyle="Regular"')),
    para(P + "BoldOnly", crange("inherits bold from a remapped parent "), crange("local regular ", attrs=' FontStyle="Regular"')),
    para(P + "$ID/NormalParagraphStyle", crange("run-level font &amp; size", attrs=' PointSize="4.5"', font="Luminari")),
    para(P + "Plain", crange("char style italic ", "CharacterStyle/Emph"), "<Content>x</Content>"),
]) + "</Story></idPkg:Story>"


def frame(self, story, x, y, w, h, more=""):
    points = "".join(f'<PathPointType Anchor="{a} {b}" LeftDirection="{a} {b}" RightDirection="{a} {b}"/>' for a, b in ((x, y), (x, y + h), (x + w, y + h), (x + w, y)))
    return f'<TextFrame Self="{self}" ParentStory="{story}" ItemTransform="1 0 0 1 0 0" ItemLayer="L1" {more}><Properties><PathGeometry><GeometryPathType PathOpen="false"><PathPointArray>{points}</PathPointArray></GeometryPathType></PathGeometry></Properties></TextFrame>'


PARTS = {
    "designmap.xml": '<Document xmlns:idPkg="x"><Layer Self="L1" Name="One"/><Layer Self="L2" Name="Two" Visible="false"/><idPkg:Spread src="Spreads/Spread_s1.xml"/><idPkg:Story src="Stories/Story_u1.xml"/><idPkg:Story src="Stories/Story_u2.xml"/><idPkg:Story src="Stories/Story_gone.xml"/></Document>',
    "Resources/Styles.xml": STYLES, "Resources/Fonts.xml": '<Fonts><Font Self="f" FontFamily="Kereru" Name="Kereru Bold" FontStyleName="Bold" Status="Substituted"/></Fonts>',
    "Resources/Graphic.xml": '<Graphic><Color Self="Color/K" Name="K" Model="Process" Space="CMYK" ColorValue="0 0 0 100"/><Color Self="Color/R" Name="R" Model="Process" Space="RGB" ColorValue="255 0 0"/><Tint Self="Tint/K" Name="K50" BaseColor="Color/K" TintValue="50"/><Gradient Self="Gradient/G" Name="G"><GradientStop StopColor="Color/R"/><GradientStop StopColor="Tint/K"/></Gradient></Graphic>',
    "Spreads/Spread_s1.xml": '<idPkg:Spread xmlns:idPkg="x"><Spread Self="s1"><Page Self="pA" Name="1" GeometricBounds="0 0 100 100" ItemTransform="1 0 0 1 0 0"/><Page Self="pB" Name="2" GeometricBounds="0 0 100 100" ItemTransform="1 0 0 1 100 0"/>'
    + frame("t1", "u1", 20, 20, 60, 60, 'FillColor="Color/R" NextTextFrame="lost"') + frame("t2", "u9", 90, 40, 20, 20) + frame("t3", "u1", -30, 0, 40, 50) + frame("t4", "u1", 900, 0, 10, 10) + "</Spread></idPkg:Spread>",
    "Stories/Story_u1.xml": STORY, "Stories/Story_u2.xml": '<Story Self="u2"/>',
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([("a", bytearray(idml.zipped({k: v.encode() for k, v in PARTS.items()}))), ("bad", bytearray(b"nothing"))], "doc_id string, content binary")


@pytest.fixture(scope="module")
def t(files):
    facts = idml.scan_idml(files).persist()
    assert [r.doc_id for r in facts.where("kind = 'error'").collect()] == ["bad"]
    return {k: df.persist() for k, df in idml.tables(facts).items()}


def test_scan(t):
    s = {r.story_id: r for r in t["story"].collect()}
    assert s["u1"].paragraphs == 4 and s["u1"].text.startswith("A style-driven local style \n") and s["u2"].text == ""
    assert "run-level font & size" in s["u1"].text
    assert {r.item_id: r.axis_rect for r in t["item"].collect()} == dict.fromkeys(("t1", "t2", "t3", "t4"), True)


def test_cascade(t):
    got = {r.text: r.e for r in structure.effective_runs(t["run"], structure.resolved_styles(t["style"])).collect()}
    assert (got["A style-driven "].font, got["A style-driven "].font_style) == ("Kereru", "Bold")
    assert got["local style "].font_style == "Regular" and got["char style italic "].font_style == "Italic"
    assert (got["inherits bold from a remapped parent "].font, got["x"].font, got["x"].size) == ("Luminari (TT)", "Kereru", "8")


def test_pages(t):
    got = {r.item_id: r.page_id for r in structure.placed_items(t["item"], t["page"]).collect()}
    assert got == {"t1": "pA", "t2": "pA", "t3": "pA", "t4": None}  # t2's centre lies on both edges; t3 overlaps


def test_findings(t):
    got = {r.code: r for r in structure.findings(t).collect()}
    assert {"missing-story", "frame-without-story", "orphan-stories", "broken-thread", "story-in-several-frames", "run-level-fonts", "fonts-unavailable", "hidden-layers", "rgb-swatches"} == set(got)
    assert got["frame-without-story"].refs == ["t2"] and got["orphan-stories"].refs == ["u2"] and got["broken-thread"].refs == ["t1"]


def test_frames(t):
    items = structure.placed_items(t["item"], t["page"])
    got = {r.item_id: (r.level, r.reasons) for r in structure.frame_support(items, t["story"]).collect()}
    assert got["t1"] == ("approx", ["threaded text"]) and got["t2"] == ("unsupported", ["story not found"]) and got["t3"] == ("full", [])
    s = structure.frame_stats(items, t["story"]).first()
    assert (s.total, s.on_pages, s.off_page, s.threaded) == (4, 3, 1, 1)
    assert structure.structure_json(items, t["page"], t["story"]).count() == 2


def test_swatches(t):
    got = {r.name: r for r in structure.resolve_swatches(t["swatch"], ["doc_id"]).collect()}
    assert (got["K"].rgb, got["K"].inks, got["R"].kind, got["K50"].cmyk[3], got["K50"].kind) == ("#232323", 1, "rgb", 50, "tint")
    assert (got["G"].kind, got["G"].rgb, got["G"].inks) == ("gradient", "#ff0000", 1)


def test_print_checks(spark, t):
    items = structure.placed_items(t["item"], t["page"])
    e = structure.effective_runs(t["run"], structure.resolved_styles(t["style"]))
    hits = printcheck.hits(items, t["page"], t["story"], e, t["swatch"], preflight.profile_table(spark, {"p": {}}))
    got = {(r.check): (r.frames, r.chars) for r in printcheck.report(hits).collect()}
    assert got["small-text"] == (2, 42) and got["frame-past-trim"][0] == 1 and "light-weight" not in got
    assert printcheck.shown(hits).count() >= 3


def test_text_check(spark, t):
    pdf = spark.createDataFrame([("a", 0, "A style driven local style inherits bold from a remapped parent local regular run level font size char style italic x")], "doc_id string, page int, text string")
    items = structure.placed_items(t["item"], t["page"]).where("item_id != 't2'")
    got = {r.page: r.status for r in structure.compare_with_pdf(items, t["page"], t["story"], pdf).collect()}
    assert got[1] == "no-pdf-page" and got[0] in ("ok", "overset", "differs")


def test_font_map(spark, files, t):
    entries = [("a", "Kereru", "Bold", "Source Serif 4", "Semibold"), ("a", "Kereru", "Regular", "Source Serif 4", "Regular"), ("a", "Luminari", "Regular", "Cormorant Garamond", "Regular"), ("a", "X", "Y", "", "")]
    m = fontmap.font_map(spark.createDataFrame(entries, "doc_id string, from_family string, from_style string, to_family string, to_style string"))
    good = files.where("doc_id = 'a'")
    out = fontmap.rewrite(good, t, m).persist()
    row = out.first()
    assert "Stories/Story_u1.xml" in row.changed and "Resources/Styles.xml" in row.changed
    after = fontmap.rescan(out)
    v = fontmap.verify(t, after, m).first()
    assert v.ok and (v.total, v.changed, v.unchanged, v.chars) == (7, 5, 2, 63)
    assert out.select(idml.check_package(F.col("content")).alias("c")).first().c.ok
    old, new = (spark.createDataFrame([(n, x) for n, x in idml.unzipped(bytes(c)).items()], "n string, x string") for c in (good.first().content, row.content))
    both = old.withColumnRenamed("x", "a").join(new.withColumnRenamed("x", "b"), "n")
    assert both.where(fontmap.strip_fonts(F.col("a")) != fontmap.strip_fonts(F.col("b"))).count() == 0
    styles = {r.self: r for r in after["style"].collect()}
    assert styles[P + "BoldOnly"].font == "Luminari (TT)" and styles[P + "Plain"].font_style is None
    none = fontmap.rewrite(good, t, m.limit(0)).first()
    assert none.changed == []
