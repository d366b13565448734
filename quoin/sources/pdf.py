"""PDF files to fact tables.

A first, light reading of a file gives its table of objects and its table of pages; ranges
of pages then go to tasks of their own, each of which reads from the file only the objects that
its pages need. Ids are numbers of objects and orders are counted page by page, so tasks agree without
knowing of each other; what concerns a whole document is added up afterwards."""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.lineage import cut
from quoin.schema import PDF
from quoin.sources.pdfcolour import CMYK, GRAY, RGB, Space, evaluate, half_up, hexed, shown, space_of
from quoin.sources.pdffonts import says
from quoin.sources.pdfobjects import Document, Encrypted, Keyword, Name, Reader, Ref, Stream
from quoin.sources.ranged import Opened

# Nesting of forms, marks of a page, ink in percent from which paint is marked.
FORM_DEPTH, MARKS, HEAVY = 8, 300, 200
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def through(m, n) -> tuple:
    """The transform that applies m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def percent(v: float) -> float:
    return half_up(v * 1000) / 10


def text_of(x: float) -> str:
    return str(int(x)) if x == int(x) else str(x)


def operators(data: bytes) -> Iterator[tuple[bytes, list]]:
    """(operator, operands) of a content stream; of an inline image (BI, [its dictionary])."""
    r, operands = Reader(data), []
    while True:
        r.gap()
        if r.at >= len(data):
            return
        try:
            v = r.value()
        except ValueError:
            return
        if not isinstance(v, Keyword):
            operands.append(v)
            continue
        if v == b"BI":
            image: dict = {}
            while True:
                try:
                    key = r.value()
                    if isinstance(key, Keyword):
                        break
                    image[str(key)] = r.value()
                except ValueError:
                    break
            end = re.compile(rb"\sEI(?=\s|\Z)").search(data, r.at)
            r.at = end.end() if end else len(data)
            yield b"BI", [image]
        elif v not in (b"]", b">", b")", b"{", b"}"):
            yield bytes(v), operands
        operands = []


@dataclass(frozen=True)
class Paint:
    space: Space = GRAY
    values: tuple = (0.0,)
    pattern: str | None = None


@dataclass(frozen=True)
class State:
    ctm: tuple = IDENTITY
    fill: Paint = Paint()
    stroke: Paint = Paint()
    render: int = 0


class Scan:
    """The facts of some pages of one document, as rows by table."""

    def __init__(self, doc: Document):
        self.rows: dict[str, list[dict]] = {k: [] for k in PDF}
        self.doc = doc
        self.streams: dict[int, list] = {}
        self.images: dict[int, dict] = {}
        self.fonts: dict[int, dict] = {}
        self.maps: dict[int, object] = {}
        self.seq = self.inline = self.gradients = self.patterns = 0
        self.over: set[int] = set()

    # ---- helpers
    def entry(self, d, key: str):
        d = self.doc.get(d)
        d = d.dict if isinstance(d, Stream) else d
        return self.doc.get(d.get(key)) if isinstance(d, dict) else None

    def numbers(self, d, key: str, n: int) -> list[float] | None:
        v = self.entry(d, key)
        v = [self.doc.get(x) for x in v] if isinstance(v, list) else []
        return v[:n] if len(v) >= n and all(isinstance(x, int | float) and not isinstance(x, bool) for x in v[:n]) else None

    def next(self) -> int:
        """The place of a fact in the document: its page, then its turn on the page."""
        self.seq += 1
        return (self.page << 32) + self.seq - 1

    def number(self, value, d: dict) -> int:
        """The id of an image or font: its object's number; for one without, a negative number of its content."""
        known = self.doc.number_of(value)
        return known if known is not None else -2 - (zlib.crc32(repr(sorted(d.items(), key=str)).encode()) & 0x3FFFFFFF)

    def listing(self, stream: Stream) -> list:
        if id(stream) not in self.streams:
            self.streams[id(stream)] = list(operators(self.doc.decoded(stream)))
        return self.streams[id(stream)]

    # ---- documents and pages
    def run(self, pages) -> dict[str, list[dict]]:
        """Facts of pages (number, dictionary); of the document only what is counted on them."""
        for n, page in pages:
            self.one(n, page)
        self.rows["doc"].append({"inline_images": self.inline, "gradients": self.gradients, "patterns": self.patterns})
        self.rows["image"] = list(self.images.values())
        self.rows["font"] = [f | {"pages": sorted(f["pages"])} for f in self.fonts.values()]
        return self.rows

    def one(self, n: int, page: dict) -> None:
        doc = self.doc
        box = lambda key: {"x": min(b[0], b[2]), "y": min(b[1], b[3]), "w": abs(b[2] - b[0]), "h": abs(b[3] - b[1])} if (b := self.numbers(page, key, 4)) else None
        media = box("MediaBox") or {"x": 0.0, "y": 0.0, "w": 612.0, "h": 792.0}
        group = self.entry(page, "Group")
        blend = space_of(doc, group.get("CS")).family if isinstance(group, dict) else "none"
        row = {"page": n, "media": media, "crop": box("CropBox") or media, "trim": box("TrimBox"), "bleed": box("BleedBox"), "art": box("ArtBox"), "blend": blend, "unreadable": False}
        self.page, self.seq, self.marks, self.seen = n, 0, 0, set()
        try:
            content = self.entry(page, "Contents")
            parts = [doc.get(c) for c in content] if isinstance(content, list) else [content]
            data = b"\n".join(doc.decoded(s) for s in parts if isinstance(s, Stream))
            self.interpret(operators(data), self.entry(page, "Resources") or {}, State(), 0, False)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, ArithmeticError, RecursionError):
            row["unreadable"] = True
        self.rows["page"].append(row | {"overprint": n in self.over})

    def about(self, page_count: int) -> dict:
        """What the document says of itself."""
        doc = self.doc
        info, root = self.entry(doc.trailer, "Info"), doc.get(doc.trailer["Root"])
        said = lambda d, k: v.decode("utf-16" if v[:2] in (b"\xfe\xff", b"\xff\xfe") else "latin-1", "replace") if isinstance(v := self.entry(d, k), bytes) else (str(v) if isinstance(v, Name) else None)
        intents = self.entry(root, "OutputIntents")
        has = bool(intents)
        version = re.search(rb"%PDF-(\d\.\d)", doc.source.read(0, 1024))
        return {"bytes": doc.source.size, "page_count": page_count, "pdfx": said(info, "GTS_PDFXVersion"), "has_intent": has, "intent_id": (said(intents[0], "OutputConditionIdentifier") or "") if has else None, "producer": said(info, "Producer") or "", "creator": said(info, "Creator") or "", "pdf_version": version[1].decode() if version else None, "error": None}

    # ---- the interpreter
    def interpret(self, ops, resources: dict, g: State, depth: int, masked: bool) -> None:
        stack: list[State] = []
        points: list[tuple[float, float]] = []
        tm = line = IDENTITY
        size = leading = 0.0
        font = None
        named = lambda kind, operands: (n, self.entry(self.entry(resources, kind), n)) if operands and isinstance(n := operands[0], Name) else (None, None)
        for op, operands in ops:
            v = [x for x in operands if isinstance(x, int | float) and not isinstance(x, bool)]
            if op == b"q":
                stack.append(g)
            elif op == b"Q":
                g = stack.pop() if stack else g
            elif op == b"cm":
                g = replace(g, ctm=through(v[-6:], g.ctm)) if len(v) >= 6 else g
            elif op in DEVICE_OPS:
                which, space, n = DEVICE_OPS[op]
                g = replace(g, **{which: Paint(space, tuple(v[-n:]))})
            elif op in (b"cs", b"CS"):
                if operands and isinstance(operands[0], Name):
                    space = space_of(self.doc, operands[0], resources)
                    g = replace(g, **{"fill" if op == b"cs" else "stroke": Paint(space, tuple([] if space.kind == "pattern" else space.start()))})
            elif op in (b"sc", b"scn", b"SC", b"SCN"):
                which = "fill" if op[:1] == b"s" else "stroke"
                space = getattr(g, which).space
                pattern = str(operands[-1]) if space.kind == "pattern" and operands and isinstance(operands[-1], Name) else None
                g = replace(g, **{which: Paint(space, tuple(v), pattern)})
            elif op in PATH_OPS:
                n = PATH_OPS[op]
                if op == b"re" and len(v) >= 4:
                    x, y, w, h = v[-4:]
                    v = [x, y, x + w, y, x + w, y + h, x, y + h]
                    n = 8
                if len(v) >= n:
                    xy = v[-n:]
                    points += [(x * g.ctm[0] + y * g.ctm[2] + g.ctm[4], x * g.ctm[1] + y * g.ctm[3] + g.ctm[5]) for x, y in zip(xy[::2], xy[1::2])]
            elif op in PAINT_OPS:
                box = (min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)) if points else None
                for which in PAINT_OPS[op]:
                    self.paint(getattr(g, which), resources, g, box, depth, masked)
                points = []
            elif op == b"BT":
                tm = line = IDENTITY
            elif op == b"Tm" and len(v) >= 6:
                tm = line = tuple(v[-6:])
            elif op in (b"Td", b"TD") and len(v) >= 2:
                leading = -v[-1] if op == b"TD" else leading
                tm = line = through((1, 0, 0, 1, v[-2], v[-1]), line)
            elif op == b"TL":
                leading = v[-1] if v else 0.0
            elif op == b"T*":
                tm = line = through((1, 0, 0, 1, 0, -leading), line)
            elif op == b"Tr":
                g = replace(g, render=int(v[0])) if v else g
            elif op == b"Tf":
                size = float(v[-1]) if v else 0.0
                _, d = named("Font", operands)
                font = d if isinstance(d, dict) else None
                if font is not None:
                    self.font(font)["pages"].add(self.page)
            elif op in (b"Tj", b"TJ", b"'", b'"'):
                if op in (b"'", b'"'):
                    tm = line = through((1, 0, 0, 1, 0, -leading), line)
                at = through(tm, g.ctm)
                height = math.hypot(at[2], at[3]) * (size or 1)
                box = (at[4], at[5], at[4] + 3 * height, at[5] + height)
                if g.render in (0, 2, 4, 6):
                    self.paint(g.fill, resources, g, box, depth, masked)
                if g.render in (1, 2, 5, 6):
                    self.paint(g.stroke, resources, g, box, depth, masked)
                if font is not None and not masked:
                    self.text(font, operands, at, height)
            elif op == b"sh":
                _, shading = named("Shading", operands)
                if shading is not None:
                    self.shade(shading, resources)
            elif op == b"gs":
                _, d = named("ExtGState", operands)
                if isinstance(d, dict):
                    if self.entry(d, "OP") is True or self.entry(d, "op") is True:
                        self.over.add(self.page)
                    mask = self.entry(d, "SMask")
                    group = self.entry(mask, "G") if isinstance(mask, dict) else None
                    if isinstance(group, Stream):
                        self.form(group, resources, g, depth, True)
            elif op == b"BI":
                self.inline += 1
                d = operands[0]
                get = lambda *ks: next((self.doc.get(d[k]) for k in ks if k in d), None)  # noqa: E731, B023
                cs = str(get("CS", "ColorSpace") or "") if not isinstance(get("CS", "ColorSpace"), list) else ""
                family = "RGB" if "RGB" in cs else "CMYK" if "CMYK" in cs else "Gray" if cs in ("G", "Gray", "DeviceGray") else "Other"
                self.place({"image_id": -1, "w": float(get("W", "Width") or 0), "h": float(get("H", "Height") or 0), "mask": False, "family": family, "label": f"inline {cs}"}, g.ctm, masked)
            elif op == b"Do":
                _, x = named("XObject", operands)
                if isinstance(x, Stream) and self.entry(x, "Subtype") == "Image":
                    image = self.image(x, resources)
                    image["uses"] += 1
                    self.place(image, g.ctm, masked)
                    if image["mask"]:
                        self.paint(g.fill, resources, g, None, depth, masked)
                elif isinstance(x, Stream) and self.entry(x, "Subtype") == "Form":
                    self.form(x, resources, g, depth, masked)

    def form(self, x: Stream, resources: dict, g: State, depth: int, masked: bool) -> None:
        if depth < FORM_DEPTH:
            inner = State(through(self.numbers(x, "Matrix", 6) or IDENTITY, g.ctm), g.fill, g.stroke)
            try:
                ops = self.listing(x)
            except ValueError:
                return
            self.interpret(ops, self.entry(x, "Resources") or resources, inner, depth + 1, masked)

    # ---- colour
    def paint(self, p: Paint, resources: dict, g: State, box, depth: int, masked: bool) -> None:
        if p.pattern is None:
            return self.colour(p.space, list(p.values), None if masked else box)
        pattern = self.entry(self.entry(resources, "Pattern"), p.pattern)
        if pattern is None or ("pattern", id(pattern)) in self.seen:
            return None
        self.seen.add(("pattern", id(pattern)))
        self.patterns += 1
        kind = self.entry(pattern, "PatternType")
        if kind == 2 and (shading := self.entry(pattern, "Shading")) is not None:
            self.shade(shading, resources)
        elif kind == 1 and isinstance(pattern, Stream) and depth < FORM_DEPTH:
            inner = State(through(self.numbers(pattern, "Matrix", 6) or IDENTITY, g.ctm))
            self.interpret(self.listing(pattern), self.entry(pattern, "Resources") or resources, inner, depth + 1, True)
        return None

    def add(self, key: str, kind: str, label: str, rgb, source: str = "artwork", **more) -> None:
        self.rows["paint"].append({"page": self.page, "seq": self.next(), "key": key, "kind": kind, "label": label, "rgb": rgb if isinstance(rgb, str) else hexed(rgb) if rgb else None, "source": source, "icc": False} | more)

    def mark(self, box, k: str, label: str, tac: float | None = None) -> None:
        if box and all(map(math.isfinite, box)) and self.marks < MARKS:
            self.marks += 1
            self.rows["mark"].append({"page": self.page, "seq": self.next(), "k": k, "box": [half_up(10 * b) / 10 for b in box], "label": label, "tac": tac})

    def colour(self, space: Space, values: list[float], box) -> None:
        rgb, inks = shown(self.doc, space, values)
        v = values + [0.0] * 4
        if space.kind == "gray":
            k = percent(1 - min(1.0, max(0.0, v[0])))
            self.add(f"gray:{text_of(k)}", "gray", {0: "White", 100: "Black (gray)"}.get(k, f"Gray {text_of(k)}% K"), rgb)
        elif space.kind == "rgb":
            n = [half_up(255 * x) for x in v[:3]]
            label = "RGB " + " ".join(map(str, n))
            self.mark(box, "rgb", label)
            self.add("rgb:" + ",".join(map(str, n)), "rgb", label, rgb, icc=space.label != "DeviceRGB")
        elif space.kind == "cmyk":
            n = [percent(x) for x in v[:4]]
            label, tac = " ".join(c + text_of(x) for c, x in zip("CMYK", n)), half_up(10 * sum(n)) / 10
            if sum(n) >= HEAVY:
                self.mark(box, "cmyk", label, tac)
            self.add("cmyk:" + ",".join(map(text_of, n)), "cmyk", label, rgb, cmyk=n, tac=tac)
        elif space.kind == "lab":
            self.mark(box, "lab", "Lab colour")
            self.add("lab:" + ",".join(str(half_up(x)) for x in values), "lab", "Lab " + " ".join(str(half_up(x)) for x in values[:3]), rgb)
        elif space.family == "Registration":
            self.mark(box, "reg", "Registration")
            self.add("registration", "registration", "Registration", (0, 0, 0))
        elif space.kind in ("sep", "devn"):
            rest = list(values)
            for i, name in enumerate(space.names):
                if name in space.spot and (space.kind == "sep" or (i < len(values) and values[i] > 0)):
                    self.mark(box, "spot", name)
                    self.spot(space, i, values[i] if i < len(values) else 1.0)
                    if i < len(rest):
                        rest[i] = 0.0
            process = [x for x, n in zip(rest, space.names) if n not in space.spot and n not in ("None",)]
            if (space.kind == "sep" and space.family == "CMYK") or (space.kind == "devn" and any(x > 0 for x in process)):
                out = evaluate(self.doc, space.tint, rest)
                if out and space.alternate:
                    self.colour(space.alternate, out, box)

    def spot(self, space: Space, i: int, tint: float, source: str = "artwork") -> None:
        full = [1.0 if k == i else 0.0 for k in range(len(space.names))]
        rgb, inks = shown(self.doc, space, full)
        self.add(f"spot:{space.names[i]}", "spot", space.names[i], rgb, source, cmyk=[percent(x) for x in inks] if inks else None, tint=half_up(100 * tint))

    def shade(self, shading, resources: dict) -> None:
        self.gradients += 1
        space = space_of(self.doc, (shading.dict if isinstance(shading, Stream) else shading).get("ColorSpace"), resources)
        function, ends = self.entry(shading, "Function"), self.numbers(shading, "Domain", 2) or [0.0, 1.0]
        colours: list[str | None] = [None, None]
        if function is not None and not isinstance(function, list):
            for k, end in enumerate(ends):
                out = evaluate(self.doc, function, [end])
                rgb = shown(self.doc, space, out)[0] if out else None
                colours[k] = hexed(rgb) if rgb else None
        self.add(f"grad:{space.family}:{colours[0]}:{colours[1]}", "gradient", f"Gradient ({space.family})", colours[0], "gradient", family=space.family, rgb2=colours[1])
        if space.kind == "sep" and space.family == "Spot":
            self.spot(space, 0, 1.0, "gradient")

    # ---- images and fonts
    def image(self, x: Stream, resources: dict) -> dict:
        if id(x) not in self.images:
            space, mask = space_of(self.doc, x.dict.get("ColorSpace"), resources), self.entry(x, "ImageMask") is True
            swatches = {}
            if not mask and space.kind in ("sep", "devn"):
                for n in space.spot:
                    rgb = shown(self.doc, space, [1.0 if m == n else 0.0 for m in space.names])[0]
                    swatches[n] = hexed(rgb) if rgb else None
            f = self.entry(x, "Filter")
            f = self.doc.get(f[-1]) if isinstance(f, list) and f else f
            row = {"image_id": self.number(x, x.dict), "w": self.entry(x, "Width"), "h": self.entry(x, "Height"), "bpc": self.entry(x, "BitsPerComponent") or (1 if mask else 8), "mask": mask}
            self.images[id(x)] = row | {"family": "Mask" if mask else space.family, "label": "1-bit mask" if mask else space.label, "spot": space.spot, "swatches": swatches, "filter": str(f) if f else None, "has_smask": "SMask" in x.dict, "uses": 0}
        return self.images[id(x)]

    def place(self, image: dict, m: tuple, masked: bool) -> None:
        w, h = math.hypot(m[0], m[1]), math.hypot(m[2], m[3])
        xs, ys = [m[4] + a * m[0] + b * m[2] for a in (0, 1) for b in (0, 1)], [m[5] + a * m[1] + b * m[3] for a in (0, 1) for b in (0, 1)]
        box = [half_up(10 * f(s)) / 10 for f, s in ((min, xs), (min, ys), (max, xs), (max, ys))]
        row = {k: image[k] for k in ("image_id", "family", "label", "mask")}
        px, py = float(image["w"] or 0), float(image["h"] or 0)
        self.rows["placement"].append(row | {"seq": self.next(), "page": self.page, "box": box, "soft_mask": masked, "px_w": px, "px_h": py, "w_pt": w, "h_pt": h, "ppi_x": px / (w / 72) if w > 0 else None, "ppi_y": py / (h / 72) if h > 0 else None})

    def font(self, d: dict) -> dict:
        if id(d) not in self.fonts:
            kind, base = str(self.entry(d, "Subtype") or ""), str(self.entry(d, "BaseFont") or "(unnamed)")
            holder = d
            if kind == "Type0":
                below = self.entry(d, "DescendantFonts")
                holder = below[0] if isinstance(below, list) and below else d
            described = self.entry(holder, "FontDescriptor")
            embedded = kind == "Type3" or any(self.entry(described, k) is not None for k in ("FontFile", "FontFile2", "FontFile3"))
            subset = re.match(r"[A-Z]{6}\+", base)
            self.fonts[id(d)] = {"font_id": self.number(d, d), "name": base[7:] if subset else base, "subset": bool(subset), "type": kind, "embedded": embedded, "pages": set()}
        return self.fonts[id(d)]

    def text(self, d: dict, operands: list, at: tuple, size: float) -> None:
        if id(d) not in self.maps:
            self.maps[id(d)] = says(self.doc, d)
        parts = [x for o in operands for x in (o if isinstance(o, list) else [o])]
        codes, known = b"".join(p for p in parts if isinstance(p, bytes)), self.maps[id(d)]
        said = known(codes) if known is not None and codes else None
        if codes and (said is None or said.strip()):
            f = self.font(d)
            self.rows["text"].append({"page": self.page, "seq": self.next(), "str": said, "font_key": f["name"], "size": half_up(10 * size) / 10, "transform": list(at), "vertical": str(self.entry(d, "Encoding") or "").endswith("-V")})


DEVICE_OPS = {op: (which, space, n) for ops, space, n in (((b"g", b"G"), GRAY, 1), ((b"rg", b"RG"), RGB, 3), ((b"k", b"K"), CMYK, 4)) for op, which in zip(ops, ("fill", "stroke"))}
PATH_OPS = {b"m": 2, b"l": 2, b"c": 6, b"v": 4, b"y": 4, b"re": 4}
PAINT_OPS = {b"n": ()} | dict.fromkeys((b"f", b"F", b"f*"), ("fill",)) | dict.fromkeys((b"S", b"s"), ("stroke",)) | dict.fromkeys((b"B", b"B*", b"b", b"b*"), ("fill", "stroke"))


FAULTS = (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError, ArithmeticError, OSError)


def fault(e: Exception) -> str:
    return "encrypted" if isinstance(e, Encrypted) else f"unreadable: {e}"[:200]


def scan_bytes(data: bytes) -> dict[str, list[dict]]:
    """Rows by table of a whole file. A file that can't be opened is one row of doc with its error."""
    try:
        scan = Scan(Document(data))
        pages = scan.doc.pages()
        rows = scan.run(enumerate(pages))
        rows["doc"].append(scan.about(len(pages)))
        return rows
    except (*FAULTS, Encrypted) as e:
        return {"doc": [{"bytes": len(data), "page_count": 0, "error": fault(e)}]}


def tagged(doc_id: str, found: dict[str, list[dict]]) -> pd.DataFrame:
    rows = [(doc_id, kind, json.dumps(r | {"doc_id": doc_id})) for kind, some in found.items() for r in some]
    return pd.DataFrame(rows, columns=["doc_id", "kind", "row"])


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for doc_id, content in zip(b["doc_id"], b["content"]):
            yield tagged(doc_id, scan_bytes(bytes(content)))


FACTS = "doc_id string, kind string, row string"


def scan_pdf(files: DataFrame) -> DataFrame:
    """Tagged facts (doc_id, kind, row as JSON) of files (doc_id, content), each in one task.
    Write or persist them once; each table is then a filter and a parse without Python."""
    return files.select("doc_id", "content").mapInPandas(_rows, FACTS)


# ---- ranges of pages
SURVEY = "doc_id string, path string, root int, numbers array<int>, places array<bigint>, turns array<int>, pages array<array<int>>, about string"


def surveyed(doc_id: str, path: str) -> tuple:
    """A file's objects, its pages and what it says of itself; nothing of its contents is read.
    places: where an object begins in the file, or for one held in a stream of objects the
    stream's number, with its turn there."""
    source = None
    try:
        source = Opened(path)
        doc = Document(source)
        pages = [list(p) for p, _ in doc.walk()]
        root = doc.trailer.get("Root")
        numbers = sorted(doc.places)
        spots = [p if isinstance(p, tuple) else (p, -1) for p in map(doc.places.get, numbers)]
        about = Scan(doc).about(len(pages))
        if not isinstance(root, Ref):
            raise ValueError("no catalogue")
        return doc_id, path, root[0], numbers, [p for p, _ in spots], [t for _, t in spots], pages, json.dumps(about | {"doc_id": doc_id})
    except (*FAULTS, Encrypted) as e:
        size = source.size if source else None
        return doc_id, path, None, [], [], [], [], json.dumps({"doc_id": doc_id, "bytes": size, "page_count": 0, "error": fault(e)})
    finally:
        if source:
            source.close()


def survey(files: DataFrame) -> DataFrame:
    """One row (SURVEY) for each of files (doc_id, path): its object table and its page table."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SURVEY.split(", ")]
        for b in batches:
            for doc_id, path in zip(b["doc_id"], b["path"]):
                one = surveyed(doc_id, path)
                yield pd.DataFrame({n: pd.Series([v], dtype="Int32" if n == "root" else object) for n, v in zip(names, one)})

    return files.select("doc_id", "path").mapInPandas(rows, SURVEY)


def object_table(surveys: DataFrame) -> DataFrame:
    """(doc_id, object, offset, length, holder, turn): where each object lies. length reaches to the
    next object of the file; objects in a stream of objects have that stream as holder and no offset."""
    each = surveys.select("doc_id", F.explode(F.arrays_zip("numbers", "places", "turns")).alias("o"), F.array_sort(F.filter(F.transform(F.arrays_zip("places", "turns"), lambda x: F.when(x["turns"] < 0, x["places"])), lambda x: x.isNotNull())).alias("starts"))
    plain = F.col("o.turns") < 0
    after = F.get("starts", F.array_position("starts", F.col("o.places")).cast("int"))
    return each.select("doc_id", F.col("o.numbers").alias("object"), F.when(plain, F.col("o.places")).alias("offset"), F.when(plain, after - F.col("o.places")).alias("length"), F.when(~plain, F.col("o.places")).cast("int").alias("holder"), F.when(~plain, F.col("o.turns")).alias("turn"))


def page_table(surveys: DataFrame) -> DataFrame:
    """(doc_id, page, path): which kid to take at each node of the page tree."""
    return surveys.select("doc_id", F.posexplode("pages").alias("page", "path"))


def _range_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples(index=False):
            source = Opened(r.path)
            places = {int(n): int(p) if t < 0 else (int(p), int(t)) for n, p, t in zip(r.numbers, r.places, r.turns)}
            doc = Document(source, places, {"Root": Ref((int(r.root), 0))})
            yield tagged(r.doc_id, Scan(doc).run((int(r.first) + k, doc.page_at([int(i) for i in path])) for k, path in enumerate(r.paths)))
            source.close()


def scan_ranges(surveys: DataFrame, pages_per_range: int = 64) -> DataFrame:
    """Tagged facts of surveyed files, pages_per_range pages at a time. A range's row takes the file's
    table of objects along, some bytes an object, and reads the objects that it needs by their places."""
    spark = surveys.sparkSession
    step = int(pages_per_range)
    cuts = surveys.where("root is not null and size(pages) > 0").select("*", F.explode(F.expr(f"sequence(0, size(pages) - 1, {step})")).alias("first"))
    cuts = cuts.select("doc_id", "path", "root", "numbers", "places", "turns", "first", F.slice("pages", F.col("first") + 1, step).alias("paths"))
    n = surveys.agg(F.sum(F.expr(f"(size(pages) + {step - 1}) div {step}"))).first()[0] or 1
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    facts = cuts.repartitionByRange(min(n, tasks), "doc_id", "first").mapInPandas(_range_rows, FACTS)
    return facts.unionByName(surveys.select("doc_id", F.lit("doc").alias("kind"), F.col("about").alias("row")))


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The tables of quoin.schema.PDF from tagged facts. Documents, images and fonts are put
    together from the rows of all ranges of pages that met them."""
    found = {kind: facts.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*") for kind, schema in PDF.items()}
    counted, order = ("inline_images", "gradients", "patterns"), {k: [f.name for f in PDF[k]] for k in PDF}
    found["doc"] = found["doc"].groupBy("doc_id").agg(*[(F.sum(c).cast("int") if c in counted else F.max(c)).alias(c) for c in order["doc"][1:]])
    found["image"] = found["image"].groupBy("doc_id", "image_id").agg(*[(F.sum(c).cast("int") if c == "uses" else F.first(c)).alias(c) for c in order["image"][2:]])
    found["font"] = found["font"].groupBy("doc_id", "font_id").agg(*[(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))) if c == "pages" else F.first(c)).alias(c) for c in order["font"][2:]])
    return found


def read_pdf(spark: SparkSession, path: str, store: str, pages_per_range: int = 64) -> dict[str, DataFrame]:
    """Scan all PDF files under a path into Parquet at store, by kind, and return the tables.

    Contents are not loaded as rows: tasks read the files by ranges of bytes, so one file
    of any number of pages is the work of many tasks.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    surveys = cut(survey(files.select(F.col("path").alias("doc_id"), "path")))
    scan_ranges(surveys, pages_per_range).write.partitionBy("kind").parquet(store)
    return tables(spark.read.schema("doc_id string, row string, kind string").parquet(store))
