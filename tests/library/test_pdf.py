"""The PDF scan and the rules, on files written for the purpose."""

import pytest

from quoin.plans import preflight
from quoin.sources import pdf as source
from quoin.sources.pdfcolour import calculate, cmyk_rgb, hexed, lab_rgb
from quoin.sources.pdfobjects import lzw, run_lengths
from tests.library import pdfwriter


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pdf")
    for name, data in (("simple", pdfwriter.simple()), ("colour", pdfwriter.colourful()), ("torn", pdfwriter.colourful(xref=False)), ("junk", b"\1\2\3"), ("locked", pdfwriter.pdf({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [] /Count 0 >>"}, extra="/Encrypt << /V 1 >>"))):
        (folder / f"{name}.pdf").write_bytes(data)
    from pyspark.sql import functions as F

    t = source.read_pdf(spark, str(folder), str(folder / "facts"))
    return {k: df.withColumn("doc_id", F.regexp_extract("doc_id", r"(\w+)\.pdf$", 1)).cache() for k, df in t.items()}


def test_errors_are_rows(facts):
    got = {r.doc_id: r for r in facts["doc"].collect()}
    assert got["locked"].error == "encrypted" and got["junk"].error.startswith("unreadable")
    assert got["simple"].error is None and got["simple"].page_count == 2 and got["simple"].pdf_version == "1.7"


def test_simple(facts):
    assert [(r.name, r.type, r.embedded, r.pages) for r in facts["font"].where("doc_id = 'simple'").collect()] == [("Helvetica", "Type1", False, [0])]
    got = sorted((r.page, r.px_w, round(r.w_pt), round(r.ppi_x)) for r in facts["placement"].where("doc_id = 'simple'").collect())
    assert got == [(0, 100.0, 72, 100), (1, 100.0, 36, 200)]
    assert [r.str for r in facts["text"].where("doc_id = 'simple'").collect()] == ["Hello (you)"]


@pytest.mark.parametrize("name", ["colour", "torn"])
def test_colours(facts, name):
    inv = preflight.colours(preflight.all_paint(facts["paint"], facts["placement"], facts["image"])).where(f"doc_id = '{name}'").collect()
    got = {r.key: r for r in inv}
    assert set(got) == {"spot:PANTONE 123 C", "cmyk:0,0,0,100", "registration", "spot:SAMPLED GREEN", "cmyk:0,0,0,50", "cmyk:80,70,70,100", "rgb:255,0,0", "gray:50", "grad:RGB:#ff0000:#0000ff", "grad:CMYK:#ffffff:#00aeef", "rgb:0,0,255"}
    assert got["spot:PANTONE 123 C"].tints == [100, 50] and got["spot:PANTONE 123 C"].rgb == "#fcc907"
    assert got["spot:SAMPLED GREEN"].rgb == "#00a651" and got["cmyk:80,70,70,100"].tac == 320 and got["cmyk:80,70,70,100"].rgb == "#0b0c0c"
    assert got["cmyk:0,0,0,100"].uses == 2 and got["gray:50"].label == "Gray 50% K"
    marks = {r.k: r for r in facts["mark"].where(f"doc_id = '{name}'").collect()}
    assert {"rgb", "reg", "spot", "cmyk"} <= set(marks) and marks["cmyk"].box[0] == 60
    assert [r.overprint for r in facts["page"].where(f"doc_id = '{name}'").collect()] == [True]


def rules(spark, facts, doc, **profile):
    found = preflight.evaluate(facts, preflight.profile_table(spark, {"p": profile})).where(f"doc_id = '{doc}'").orderBy("place").collect()
    return [f"{r.level}:{r.id}" for r in found], {r.id: r for r in found}


def test_rules_simple(spark, facts):
    got, by = rules(spark, facts, "simple", bleed_mm=3, min_ppi=150)
    assert got == ["error:fonts", "warn:page-size", "warn:image-rgb", "warn:vector-rgb", "warn:image-ppi", "info:pdfx", "pass:bleed", "pass:total-ink"]
    assert by["image-ppi"].pages == [0] and (by["image-ppi"].worst_page, by["image-ppi"].worst_ppi) == (0, 100)
    got, _ = rules(spark, facts, "simple", bleed_mm=5, min_ppi=50, allow_rgb=True)
    assert "error:bleed" in got and "warn:image-ppi" not in got and "info:colour-rgb" in got


def test_rules_colour(spark, facts):
    got, _ = rules(spark, facts, "colour", bleed_mm=0, min_ppi=0, max_ink=300)
    assert {"warn:vector-rgb", "warn:gradient-rgb", "warn:blend-rgb", "warn:spot", "warn:registration", "warn:total-ink", "info:overprint", "info:bleed", "info:images", "warn:fonts-type3"} <= set(got)
    got, _ = rules(spark, facts, "colour", bleed_mm=0, min_ppi=0, max_ink=400, allow_rgb=True, allow_spot=True)
    assert "info:spot" in got and not {"warn:vector-rgb", "warn:gradient-rgb", "warn:blend-rgb", "warn:total-ink"} & set(got)


def test_flags_marks_reports(spark, facts):
    flags = {(r.doc_id, r.page): r for r in preflight.page_flags(facts).collect()}
    assert all(flags["colour", 0][k] for k in ("rgb", "spot", "reg", "overprint")) and flags["simple", 1].rgb and not flags["simple", 1].spot
    p = preflight.profile_table(spark, {"p": {"min_ppi": 150}})
    marks = preflight.page_marks(facts, p)
    assert marks.where("doc_id = 'simple' and id = 'image-ppi' and level = 'error'").count() == 1
    found = preflight.evaluate(facts, p)
    assert '"verdict":"bad"' in preflight.report_json(found).where("doc_id = 'simple'").first().json
    assert preflight.report_text(found).where("doc_id = 'simple'").first().text.startswith("ERROR: fonts")


def test_scalars():
    assert [hexed(cmyk_rgb(c)) for c in ((0, 0.19, 1, 0), (1, 0, 1, 0), (0, 0, 0, 1), (0.8, 0.7, 0.7, 1), (1, 1, 1, 1), (0.5, 0.4, 0.4, 0))] == ["#fcc907", "#00a651", "#232323", "#0b0c0c", "#080707", "#868b8c"]
    assert [hexed(lab_rgb(*c)) for c in ((50, 0, 0), (100, 0, 0), (60, 40, -30))] == ["#777777", "#ffffff", "#c175c7"]
    assert calculate("{0 0 0 4 -1 roll}", [1]) == [0, 0, 0, 1]
    assert calculate("{dup 0.5 gt {pop 1} {2 mul} ifelse 3 1 roll}", [7, 8, 0.25]) == [0.5, 7, 8]
    assert run_lengths(bytes([2, 65, 66, 67, 254, 90, 128])) == b"ABCZZZ"
    assert lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == b"-----A---B"


def test_profile(spark):
    rows = [("a", '{"minPpi": "", "maxInk": -3, "allowRgb": true, "bleedMm": "4.5"}'), ("b", "{}")]
    a, b = preflight.sanitise(spark.createDataFrame(rows, "profile_id string, json string")).orderBy("profile_id").collect()
    assert (a.min_ppi, a.max_ink, a.allow_rgb, a.bleed_mm) == (0.0, 300.0, True, 4.5) and (b.min_ppi, b.allow_rgb) == (300.0, False)
