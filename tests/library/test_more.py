"""Chains of any length, names of many suffixes, broken packages, reports, canonical styles, the landing folder."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F


def test_long_chains_and_cycles(spark):
    from quoin.operators.hierarchy import depth_of, resolve_chain

    rows = [("d", k, k - 1 if k else None, "top" if k == 0 else None) for k in range(300)] + [("d", 1000, 1001, None), ("d", 1001, 1002, "ring"), ("d", 1002, 1000, None), ("d", 1003, 1000, "")]
    df = spark.createDataFrame(rows, "doc_id string, self int, based_on int, font string")
    font = {x.self: x.font for x in resolve_chain(df, ["doc_id"], fields=("font",)).collect()}
    assert all(font[k] == "top" for k in range(300)) and all(font[k] == "ring" for k in range(1000, 1004))
    depth = {x.self: (x.root, x.depth) for x in depth_of(df, ["doc_id"], key="self", parent="based_on").collect()}
    assert depth[299] == (0, 299) and depth[0] == (0, 0) and depth[1000] == depth[1003] == (None, None)


def test_names_of_many_suffixes(spark):
    from quoin.plans.alternatives import alternatives, bases

    name = "Arial" + "Bold" * 20
    df = spark.createDataFrame([(name,), ("x",), ("mt",)], "name string")
    forms = df.select(bases(F.lower("name")).alias("b")).collect()
    assert forms[0].b[-1] == "arial" and len(forms[0].b) == 21 and forms[1].b == ["x"] and forms[2].b == ["mt", ""]
    assert [x.slug for x in alternatives(df).orderBy("place").collect()] == ["arimo", "inter", "roboto"]


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, x in parts.items():
            z.writestr(n, x)
    return out.getvalue()


def test_broken_packages_are_rows(spark):
    from quoin.sources.idml import scan_idml

    deep = "<Story>" + "<XMLElement>" * 3000 + "</XMLElement>" * 3000 + "</Story>"
    bad = bytearray(package({"designmap.xml": "<Document/>" * 50}))
    bad[45:60] = b"\xff" * 15
    files = [("none", b""), ("text", b"not a zip"), ("empty", package({"a.xml": "<a/>"})), ("xml", package({"designmap.xml": "<Document>"})), ("bytes", bytes(bad)), ("deep", package({"designmap.xml": '<Document><Story src="s.xml"/></Document>', "s.xml": deep})), ("good", package({"designmap.xml": '<Document><Spread src="gone.xml"/><Spread src="s.xml"/></Document>', "s.xml": "<Spread Self='u1'/>"}))]
    out = scan_idml(spark.createDataFrame([(n, bytearray(x)) for n, x in files], "doc_id string, content binary").repartition(1)).collect()
    errors = {x.doc_id for x in out if x.kind == "error"}
    assert {"none", "text", "empty", "xml", "bytes"} <= errors and "good" not in errors
    # a spread without pages is there; one whose part is not in the package is missing
    assert {json.loads(x.row)["src"]: json.loads(x.row)["there"] for x in out if x.doc_id == "good" and x.kind == "manifest"} == {"gone.xml": False, "s.xml": True}


def test_canonical_styles(spark):
    from quoin.plans.roles import canonical_styles, without_unified

    df = spark.createDataFrame([("d", "S/A", 0, 12.0, "body", None), ("d", "S/B", 1, 14.0, "body", "S/R&D"), ("d", "S/C", 2, 9.0, "none", None)], "doc_id string, self string, ord int, size double, role string, based_on string")
    (row,) = canonical_styles(df, ["doc_id"], "classic").collect()
    assert (row.self, row.based_on, row.font) == ("ParagraphStyle/Role_body", "S/R&D", "Georgia")
    assert row.xml == '<ParagraphStyle Self="ParagraphStyle/Role_body" Name="Body" FontStyle="Regular" PointSize="10.5"><Properties><BasedOn type="object">S/R&amp;D</BasedOn><AppliedFont type="string">Georgia</AppliedFont><Leading type="unit">14</Leading></Properties></ParagraphStyle>'
    assert [x.self for x in without_unified(df).collect()] == ["S/C"]


@pytest.mark.parametrize(
    "before, after",
    [
        ('<R A="1">x</R>', '<R A="1" FontStyle="B&amp;W"><Properties><AppliedFont type="string">N</AppliedFont></Properties>x</R>'),
        ("<R FontStyle='old' A=\"1\" ><Properties>\n<P/></Properties></R>", '<R FontStyle="B&amp;W" A="1" ><Properties>\n<P/><AppliedFont type="string">N</AppliedFont></Properties></R>'),
        ('<R><Properties><AppliedFont type="x">O</AppliedFont><P/></Properties></R>', '<R FontStyle="B&amp;W"><Properties><AppliedFont type="string">N</AppliedFont><P/></Properties></R>'),
    ],
)
def test_splice(before, after):
    from quoin.plans.fontmap import TAG, edited, splice

    assert edited(before, splice(before, TAG.match(before), "N", "B&W")) == after


def test_report_with_profile_and_facts(spark):
    from quoin.plans import preflight
    from quoin.schema import PDF

    facts = {k: spark.createDataFrame([], v) for k, v in PDF.items()}
    facts["doc"] = spark.createDataFrame([("d", 1, 2, "PDF/X-4", True, "FOGRA", "p", "c", "1.6", 0, 0, 0, None)], PDF["doc"])
    facts["font"] = spark.createDataFrame([("d", 0, "F", True, "Type1", False, [0])], PDF["font"])
    profiles = preflight.profile_table(spark, {"p": {"min_ppi": 150}})
    found = spark.createDataFrame([("d", "p", 3, "error", "fonts", "F", [0], 1, None, None, 1)], "doc_id string, profile_id string, rule_ord int, level string, id string, detail string, pages array<int>, count int, worst_page int, worst_ppi int, place int")
    out = json.loads(preflight.report_json(found, profiles, facts).first().json)
    assert out["file"] == "d" and out["profile"]["min_ppi"] == 150 and out["summary"]["error"] == 1
    assert out["facts"]["pages"] == 2 and out["facts"]["fonts"] == [{"name": "F", "type": "Type1", "embedded": False, "subset": True}] and out["facts"]["images"] == 0 and out["facts"]["output"]["intent_id"] == "FOGRA"
    with pytest.raises(ValueError):
        preflight.profile_table(spark, {str(k): {} for k in range(1001)})


def test_landing_folder(spark, tmp_path):
    from quoin.streaming.landing import land

    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"%PDF-1.4 broken"), ("b.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(content)
    for _ in range(2):  # the second run finds nothing new
        land(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "done")).awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "store")).select("doc_id").distinct().count() == 1
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF-1.4 broken too")
    land(spark, str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "done")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "store")).select("doc_id").distinct().count() == 2


def test_ranked_over_all_rows(spark):
    from quoin.operators.ordered import ranked

    out = ranked(spark.range(500).select((F.col("id") * 37 % 501).alias("v")).repartition(7), [F.col("v").desc()]).collect()
    assert [x.v for x in sorted(out, key=lambda x: x.place)] == sorted((k * 37 % 501 for k in range(500)), reverse=True) and sorted(x.place for x in out) == list(range(1, 501))
