"""IDML packages to fact tables: a zip of XML parts, each document in one task."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.schema import IDML

# Names of the format.
LOCAL = {"font_style": "FontStyle", "size": "PointSize", "fill": "FillColor", "tracking": "Tracking", "justification": "Justification"}
FIELDS = ("font", "font_style", "size", "leading", "justification", "fill", "tracking")
ITEMS = ("Group", "TextFrame", "Rectangle", "Oval", "Polygon", "GraphicLine")
PLACED = ("Image", "EPS", "PDF", "WMF", "PICT", "ImportedPage", "SVG")
UNWALKED = ("Properties", "StoryPreference", "InCopyExportOption")
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
INSTRUCTION = "special"  #: stands for a processing instruction


def tag(e) -> str:
    return INSTRUCTION if e.tag is ElementTree.ProcessingInstruction else e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def parsed(xml: str):
    return ElementTree.fromstring(xml, ElementTree.XMLParser(target=ElementTree.TreeBuilder(insert_pis=True)))


def child(e, name: str):
    return next((c for c in e if tag(c) == name), None) if e is not None else None


def inside(e, *path: str):
    for name in path:
        e = child(e, name)
    return e


def numbers(text: str | None) -> list[float]:
    try:
        return [float(x) for x in (text or "").split()]
    except ValueError:
        return []


def matrix(text: str | None) -> tuple:
    m = numbers(text)
    return tuple(m) if len(m) == 6 else IDENTITY


def compose(p, q) -> tuple:
    return (p[0] * q[0] + p[2] * q[1], p[1] * q[0] + p[3] * q[1], p[0] * q[2] + p[2] * q[3], p[1] * q[2] + p[3] * q[3], p[0] * q[4] + p[2] * q[5] + p[4], p[1] * q[4] + p[3] * q[5] + p[5])


def moved(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def box_of(points) -> dict | None:
    if not points:
        return None
    xs, ys = zip(*points)
    return {"x": min(xs), "y": min(ys), "w": max(xs) - min(xs), "h": max(ys) - min(ys)}


def local(e, prefix: str = "") -> dict:
    """Own type settings of a style or of a range of text."""
    out = {k: e.get(a) for k, a in LOCAL.items()}
    for k, name in (("font", "AppliedFont"), ("leading", "Leading")):
        p = inside(e, "Properties", name)
        out[k] = "".join(p.itertext()).strip() if p is not None else None
    return {prefix + k: v for k, v in out.items()}


class Package:
    """The facts of one package, as rows by table."""

    def __init__(self, parts: dict[str, str]):
        self.parts, self.rows = parts, {k: [] for k in IDML}

    def run(self) -> dict[str, list[dict]]:
        xml = self.parts.get("designmap.xml")
        if not xml:
            raise ValueError("designmap.xml is missing")
        root = parsed(xml)
        for kind in ("Spread", "MasterSpread", "Story"):
            for n, e in enumerate(x for x in root.iter() if tag(x) == kind and x.get("src")):
                self.rows["manifest"].append({"kind": kind, "ord": n, "src": e.get("src"), "there": bool(self.parts.get(e.get("src")))})
        for e in root.iter():
            if tag(e) == "Layer":
                self.rows["layer"].append({"self": e.get("Self"), "name": e.get("Name"), "visible": e.get("Visible") != "false", "locked": e.get("Locked") == "true", "printable": e.get("Printable") != "false"})
        self.hidden = {r["self"] for r in self.rows["layer"] if not r["visible"]}
        self.resources()
        for r in self.rows["manifest"]:
            if xml := self.parts.get(r["src"]):
                if r["kind"] == "Story":
                    self.story(parsed(xml), r["src"])
                else:
                    self.spread(parsed(xml), r["kind"])
        return self.rows

    def resources(self) -> None:
        styles = self.parts.get("Resources/Styles.xml")
        for n, e in enumerate(parsed(styles).iter() if styles else ()):
            if tag(e) in ("ParagraphStyle", "CharacterStyle"):
                base = inside(e, "Properties", "BasedOn")
                kind = "para" if tag(e) == "ParagraphStyle" else "char"
                self.rows["style"].append({"kind": kind, "ord": n, "self": e.get("Self"), "name": e.get("Name"), "based_on": "".join(base.itertext()).strip() if base is not None else None} | local(e))
        fonts = self.parts.get("Resources/Fonts.xml")
        for e in parsed(fonts).iter() if fonts else ():
            if tag(e) == "Font":
                self.rows["font"].append({"self": e.get("Self")} | {k: e.get(a) or "" for k, a in (("family", "FontFamily"), ("name", "Name"), ("style", "FontStyleName"), ("postscript", "PostScriptName"), ("status", "Status"), ("type", "FontType"))})
        graphic = self.parts.get("Resources/Graphic.xml")
        for e in parsed(graphic).iter() if graphic else ():
            if not e.get("Self") or tag(e) not in ("Color", "Tint", "Gradient"):
                continue
            row = {"id": e.get("Self"), "type": tag(e).lower(), "name": e.get("Name") or e.get("Self")}
            if tag(e) == "Color":
                row |= {"space": e.get("Space"), "model": e.get("Model"), "value": numbers(e.get("ColorValue"))}
            elif tag(e) == "Tint":
                row |= {"base": e.get("BaseColor"), "tint": (numbers(e.get("TintValue")) or [None])[0]}
            else:
                row |= {"stops": [s.get("StopColor") for s in e.iter() if tag(s) == "GradientStop" and s.get("StopColor")]}
            self.rows["swatch"].append(row)

    def story(self, root, src: str) -> None:
        top = child(root, "Story")
        top = top if top is not None else root
        sid = top.get("Self")
        count = dict.fromkeys(("tables", "footnotes", "anchored", "notes", "specials", "line_breaks", "variables"), 0)
        anchors, paragraphs, runs, open_ = [], [], [], [False]
        ranges = {id(e): n for n, e in enumerate(x for x in root.iter() if tag(x) == "CharacterStyleRange")}

        def walk(e, para, char, in_table) -> None:
            for c in e:
                t = tag(c)
                if t in UNWALKED:
                    continue
                if t == "ParagraphStyleRange":
                    open_[0] = False
                    walk(c, (c.get("AppliedParagraphStyle"), local(c, "p_")), char, in_table)
                elif t == "CharacterStyleRange":
                    walk(c, para, (c.get("AppliedCharacterStyle"), local(c, "c_") | {"range_ord": ranges[id(c)]}), in_table)
                elif t in ("Content", "Br"):
                    if not open_[0]:
                        paragraphs.append([])
                        open_[0] = True
                    if t == "Br":
                        open_[0] = False
                        continue
                    count["specials"] += sum(tag(x) == INSTRUCTION for x in c)
                    text = (c.text or "") + "".join(x.tail or "" for x in c)
                    count["line_breaks"] += text.count(" ")
                    row = {"story_id": sid, "para_ord": len(paragraphs) - 1, "run_ord": len(paragraphs[-1]), "text": text, "para_style": para[0], "char_style": char[0], "in_table": in_table}
                    runs.append(row | para[1] | char[1])
                    paragraphs[-1].append(text)
                elif t == "Note":
                    count["notes"] += 1
                elif t == "TextVariableInstance":
                    count["variables"] += 1
                elif t in ITEMS:
                    count["anchored"] += 1
                    if t == "TextFrame" and c.get("ParentStory"):
                        anchors.append(c.get("ParentStory"))
                else:
                    count["tables"] += t == "Table"
                    count["footnotes"] += t == "Footnote"
                    walk(c, para, char, in_table or t == "Table")

        walk(top, (None, {}), (None, {}), False)
        text = "\n".join("".join(p) for p in paragraphs).replace(" ", "\n")
        chars = sum(len(x.encode("utf-16-le")) // 2 for p in paragraphs for x in p)
        self.rows["story"].append({"story_id": sid, "src": src, "text": text, "chars": chars, "anchored_stories": anchors, "paragraphs": len(paragraphs)} | count)
        self.rows["run"] += runs

    def spread(self, root, kind: str) -> None:
        top = child(root, kind)
        top = top if top is not None else root
        sid, master = top.get("Self"), kind == "MasterSpread"
        for e in top:
            if tag(e) == "Page":
                b = numbers(e.get("GeometricBounds")) or [0.0] * 4
                m = matrix(e.get("ItemTransform"))
                box = box_of([moved(m, b[1], b[0]), moved(m, b[3], b[2])])
                n = sum(r["is_master"] == master for r in self.rows["page"])
                self.rows["page"].append({"spread_id": sid, "page_id": e.get("Self"), "ord": n, "name": e.get("Name"), "box": box, "width_pt": box["w"], "height_pt": box["h"], "master": e.get("AppliedMaster"), "is_master": master})
        self.items(top, IDENTITY, None, sid, master)

    def items(self, parent, world: tuple, group: dict | None, sid: str, master: bool) -> None:
        for e in parent:
            t = tag(e)
            if t not in ITEMS:
                continue
            m = compose(world, matrix(e.get("ItemTransform")))
            layer = e.get("ItemLayer") or (group["layer_id"] if group else None)
            row = {"spread_id": sid, "item_id": e.get("Self"), "kind": t, "ord": len(self.rows["item"]), "name": e.get("Name"), "parent_id": group["item_id"] if group else None, "layer_id": layer, "locked": e.get("Locked") == "true", "world": list(m), "is_master": master}
            row |= {"hidden": e.get("Visible") == "false" or bool(group and group["hidden"]) or layer in self.hidden, "fill": e.get("FillColor"), "stroke": e.get("StrokeColor"), "axis_rect": False}
            path = inside(e, "Properties", "PathGeometry", "GeometryPathType", "PathPointArray")
            if t != "Group" and path is not None:
                points = [[numbers(p.get(a)) for a in ("Anchor", "LeftDirection", "RightDirection")] for p in path if tag(p) == "PathPointType"]
                anchors = [p[0] for p in points if len(p[0]) == 2]
                row["box"] = box_of([moved(m, *a) for a in anchors])
                straight = all(abs(x - y) <= 1e-6 for a, lft, rgt in points for d in (lft, rgt) for x, y in zip(d, a))
                square = len(anchors) == 4 and all(min(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1e-6 for p, q in zip(anchors, anchors[1:] + anchors[:1]))
                row["axis_rect"] = straight and square
            if t == "TextFrame":
                pref = child(e, "TextFramePreference")
                get = lambda k, d: (pref.get(k) if pref is not None else None) or d  # noqa: E731, B023
                link = lambda k: v if (v := e.get(k)) and v != "n" else None  # noqa: E731, B023
                inset = inside(pref, "Properties", "InsetSpacing") if pref is not None else None
                inset = [float("".join(x.itertext())) for x in inset] if inset is not None else None
                row |= {"story_id": e.get("ParentStory"), "prev": link("PreviousTextFrame"), "next": link("NextTextFrame"), "columns": int(float(get("TextColumnCount", 1))), "vj": get("VerticalJustification", "TopAlign"), "auto_size": get("AutoSizingType", "Off"), "inset": inset if inset and len(inset) == 4 else None}
            elif t != "Group":
                links = [(tag(x), child(x, "Link")) for x in e.iter() if tag(x) in PLACED]
                files = [unquote((k.get("LinkResourceURI") or "").rpartition("/")[2]) if k is not None else "" for _, k in links]
                stored = sum(k is not None and k.get("StoredState") == "Embedded" for _, k in links)
                row |= {"placed": [f"{kind}:{f}" for (kind, _), f in zip(links, files)], "embedded": stored, "linked": len(links) - stored, "text_paths": sum(tag(x) == "TextPath" for x in e.iter())}
            self.rows["item"].append(row)
            if t == "Group":
                self.items(e, m, row, sid, master)


def unzipped(data: bytes) -> dict[str, str]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n).decode("utf-8", "replace") for n in z.namelist() if n.endswith(".xml")}


def zipped(parts: dict[str, bytes]) -> bytes:
    """A package: mimetype first and stored, the rest deflated."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), b"application/vnd.adobe.indesign-idml-package")
        for name, data in parts.items():
            if name != "mimetype":
                z.writestr(name, data)
    return out.getvalue()


def check_package(content):
    """struct(zip, first_entry, stored, ok) of a package's bytes, by column functions alone."""
    number = lambda at: F.conv(F.hex(F.substring(content, at + 2, 1)), 16, 10).cast("int") * 256 + F.conv(F.hex(F.substring(content, at + 1, 1)), 16, 10).cast("int")
    is_zip = F.hex(F.substring(content, 1, 4)) == "504B0304"
    first, stored = content.substr(F.lit(31), number(26)).cast("string"), number(8) == 0
    return F.struct(is_zip.alias("zip"), first.alias("first_entry"), stored.alias("stored"), (is_zip & stored & (first == "mimetype")).alias("ok"))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for doc_id, content in zip(b["doc_id"], b["content"]):
            try:
                found = Package(unzipped(bytes(content))).run()
                rows = [(doc_id, kind, json.dumps(r | {"doc_id": doc_id})) for kind, some in found.items() for r in some]
            except Exception as e:  # whatever is wrong with one package must not end the scan of the others
                rows = [(doc_id, "error", json.dumps({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"[:200]}))]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "row"])


def scan_idml(files: DataFrame) -> DataFrame:
    """Tagged facts (doc_id, kind, row as JSON) of files (doc_id, content); what can't be
    opened is a row of kind 'error'. Write or persist them once."""
    return files.select("doc_id", "content").mapInPandas(_rows, "doc_id string, kind string, row string")


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The tables of quoin.schema.IDML from tagged facts."""
    return {kind: facts.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*") for kind, schema in IDML.items()}


def read_idml(spark: SparkSession, path: str, store: str) -> dict[str, DataFrame]:
    """Scan all packages under a path into Parquet at store, by kind, and return the tables."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.idml").option("recursiveFileLookup", "true").load(path)
    scan_idml(files.select(F.col("path").alias("doc_id"), "content")).write.partitionBy("kind").parquet(store)
    return tables(spark.read.schema("doc_id string, row string, kind string").parquet(store))
