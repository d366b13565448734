"""One file of many pages, read by ranges of pages in many tasks."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.library.pdfwriter import colourful, pdf, simple


def long_file(pages: int, xref: bool = True, held: bool = False) -> bytes:
    """Pages in a tree of three levels, with fonts, images and forms that they share or have alone."""
    objects: dict = {1: "<< /Type /Catalog /Pages 2 0 R /OutputIntents [<< /OutputConditionIdentifier (FOGRA39) >>] >>", 3: "<< /Type /Font /Subtype /Type1 /BaseFont /ABCDEF+Shared >>"}
    objects[4] = ("/Type /XObject /Subtype /Image /Width 100 /Height 50 /BitsPerComponent 8 /ColorSpace /DeviceRGB", b"\0endstream" * 1500)
    objects[5] = ("/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Resources << /XObject << /Im 4 0 R >> >>", b"q 9 0 0 9 0 0 cm /Im Do Q 1 0 0 rg 0 0 1 1 re f")
    n, leaves = 10, []
    for k in range(pages):
        own = f"/Own << /Type /Font /Subtype /TrueType /BaseFont /Direct{k % 5} >>"
        extra = f"/J {n + 2} 0 R" if k % 10 == 0 else ""
        objects[n] = f"<< /Type /Page /Parent 9 0 R /Contents {n + 1} 0 R " + (f"/Resources << /Font << /F 3 0 R {own} >> /XObject << /Form 5 0 R {extra} >> >>" if k % 3 else "") + " >>"
        draw = f"q 36 0 0 36 0 0 cm /J Do Q {k % 100 / 100} 0 0 0 k 0 0 5 5 re f" if k % 10 == 0 else "0 0 1 rg 2 2 3 3 re f"
        content = f"BT /F 9 Tf 1 0 0 1 {k % 50} 20 Tm (page {k}) Tj /Own 8 Tf (x) Tj ET /Form Do {draw}".encode()
        objects[n + 1] = ("/Filter /FlateDecode", zlib.compress(content))
        if k % 10 == 0:
            objects[n + 2] = (f"/Type /XObject /Subtype /Image /Width {k + 1} /Height 10 /BitsPerComponent 8 /ColorSpace /DeviceCMYK", b"abc")
        leaves.append(n)
        n += 3
    groups = []
    for at in range(0, pages, 40):
        objects[n] = f"<< /Type /Pages /Kids [{' '.join(f'{x} 0 R' for x in leaves[at : at + 40])}] /Count 40 /MediaBox [0 0 {100 + at % 7} 200] >>"
        groups.append(n)
        n += 1
    objects[2] = f"<< /Type /Pages /Kids [{' '.join(f'{x} 0 R' for x in groups)}] /Count {pages} /Resources << /Font << /F 3 0 R >> /XObject << /Form 5 0 R >> >> >>"
    return pdf(objects, xref=xref)


def counted(df):
    show = lambda v: repr(sorted(v.items())) if isinstance(v, dict) else repr(v)
    return Counter(tuple(map(show, r)) for r in df.collect())


@pytest.mark.parametrize("xref", [True, False])
def test_ranges_give_the_facts_of_the_whole(spark, tmp_path, xref):
    from quoin.sources import pdf as source

    data = {"long": long_file(2000 if xref else 130, xref), "small": simple(), "colours": colourful(xref), "broken": b"%PDF nothing", "empty": b""}
    for name, content in data.items():
        (tmp_path / f"{name}.pdf").write_bytes(content)
    files = spark.createDataFrame([(name, f"file:{tmp_path}/{name}.pdf") for name in data], "doc_id string, path string")
    surveys = source.survey(files).persist()
    facts = source.scan_ranges(surveys).withColumn("task", F.spark_partition_id()).persist()
    if xref:
        assert facts.where("doc_id = 'long' and kind = 'page'").select("task").distinct().count() >= 8
    apart = source.tables(facts.drop("task"))
    whole = source.tables(source.scan_pdf(spark.createDataFrame([(n, bytearray(c)) for n, c in data.items()], "doc_id string, content binary")))
    for kind in whole:
        known = ["bytes"] if kind == "doc" else []  # of a file that can't be opened the ranges know no size
        a, b = (t[kind].drop(*known) for t in (apart, whole))
        assert counted(a) == counted(b), kind
    assert apart["page"].where("doc_id = 'long'").count() == (2000 if xref else 130)
    assert apart["image"].where("doc_id = 'long'").agg(F.max("uses")).first()[0] == (2000 if xref else 130)
    assert {r.name for r in apart["font"].where("doc_id = 'long'").collect()} == {"Shared", *(f"Direct{k}" for k in range(5))}
    objects = source.object_table(surveys).where("doc_id = 'long'")
    for r in objects.where("object < 60").collect():
        body = data["long"][r.offset : r.offset + r.length] if r.length else data["long"][r.offset :]
        assert body.startswith(b"%d 0 obj" % r.object)
    assert source.page_table(surveys).where("doc_id = 'long'").count() == (2000 if xref else 130)


def test_only_what_is_needed_is_read(tmp_path):
    """A range reads a small part of a large file: neither images nor other pages."""
    from quoin.sources.pdf import Scan, surveyed
    from quoin.sources.pdfobjects import Document, Ref
    from quoin.sources.ranged import Held, Opened

    data = long_file(50).replace(b"0000000000 65535 f", b"0000000000 65535 f")
    path = tmp_path / "a.pdf"
    path.write_bytes(data)
    _, _, root, numbers, places, turns, pages, _ = surveyed("a", str(path))

    class Counting(Held):
        asked = 0

        def read(self, start, end):
            out = super().read(start, end)
            Counting.asked += len(out)
            return out

    doc = Document(Counting(data), dict(zip(numbers, places)), {"Root": Ref((root, 0))})
    rows = Scan(doc).run([(7, doc.page_at(pages[7]))])
    assert len(rows["page"]) == 1 and rows["text"][0]["str"] == "page 7"
    assert Counting.asked < 12 * 4096 + 4 * 64  # some objects' beginnings
    assert Opened(str(path)).read(10, 20) == data[10:20] and Opened(f"file:{path}").find(b"startxref", 0) == data.find(b"startxref")
