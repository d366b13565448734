"""Where packages differ, and files that are seen only when all are written."""

import os

import pytest
from pyspark.sql import functions as F

STORY = '<?xml version="1.0"?><idPkg:Story xmlns:idPkg="x"><Story Self="u1" Track="0"><Paragraph Style="a"><Range FontStyle="Bold"><Properties><AppliedFont type="string">A</AppliedFont></Properties><Content>one</Content><Br/></Range><Range><Content>two</Content></Range></Paragraph><Note Self="n1"/><Note Self="n2"><Deep><Deeper v="1"/></Deep></Note></Story></idPkg:Story>'


def test_differences(spark):
    from quoin.plans.fontmap import differences

    at = "/{x}Story/Story[u1]"
    edits = {
        "fonts": (STORY.replace('FontStyle="Bold"', 'FontStyle="Light"').replace(">A<", ">B<"), []),
        "a font more": (STORY.replace("<Range><Content>two", '<Range FontStyle="X"><Properties><AppliedFont type="string">Q</AppliedFont></Properties><Content>two'), []),
        "setting": (STORY.replace('v="1"', 'v="2"'), [(f"{at}/Note[n2]/Deep[1]/Deeper[1]", "changed")]),
        "text": (STORY.replace("two", "TWO"), [(f"{at}/Paragraph[1]/Range[2]/Content[1]", "changed")]),
        "added": (STORY.replace('<Note Self="n1"/>', '<Note Self="n0"><Deep/></Note><Note Self="n1"/>'), [(f"{at}/Note[n0]", "added")]),
        "removed": (STORY.replace("<Br/>", ""), [(f"{at}/Paragraph[1]/Range[1]/Br[1]", "removed")]),
        "order": (STORY.replace('<Note Self="n1"/>', "").replace("</Story>", '<Note Self="n1"/></Story>'), [(at, "moved")]),
        "two": (STORY.replace('v="1"', 'v="2"').replace('Track="0"', 'Track="9"'), [(at, "changed"), (f"{at}/Note[n2]/Deep[1]/Deeper[1]", "changed")]),
        "not xml": (STORY[:-5], [("/", "added"), ("/{x}Story", "removed")]),
    }
    schema = "doc_id string, name string, xml string"
    before = spark.createDataFrame([(k, "s.xml", STORY) for k in edits] + [("gone", "t.xml", "<a/>")], schema)
    after = spark.createDataFrame([(k, "s.xml", x) for k, (x, _) in edits.items()] + [("new", "t.xml", "<a/>")], schema)
    got = sorted((r.doc_id, r.path, r.change) for r in differences(before, after).collect())
    want = [(k, *x) for k, (_, some) in edits.items() if k != "not xml" for x in some] + [("gone", "/", "removed"), ("new", "/", "added")]
    assert [x for x in got if x[0] != "not xml"] == sorted(want)
    assert differences(before, before).count() == 0


def test_files_are_seen_when_all_are_written(spark, tmp_path):
    from quoin.sources.idml import check_package, zipped
    from quoin.sources.packages import write_files

    folder = str(tmp_path)
    rows = [(f"p{k}.idml", bytearray(zipped({"designmap.xml": b"<Document/>" * k}))) for k in range(20)] + [("empty", None)]
    df = spark.createDataFrame(rows, "name string, content binary").repartition(4)
    write_files(df, f"file:{folder}")
    assert sorted(os.listdir(folder)) == sorted(n for n, _ in rows) and (tmp_path / "empty").read_bytes() == b""
    written = spark.read.format("binaryFile").option("pathGlobFilter", "*.idml").load(folder)
    assert written.where(check_package(F.col("content"))["ok"]).count() == 20
    with pytest.raises(Exception, match="there already"):
        write_files(df.limit(1), folder)
    write_files(spark.createDataFrame([("empty", bytearray(b"x"))], "name string, content binary"), folder, "overwrite")
    assert (tmp_path / "empty").read_bytes() == b"x"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    from quoin.sources.packages import write_files

    df = spark.range(40).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("id").cast("string")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken row|aborted|Writing"):
        write_files(df, str(tmp_path))
    with pytest.raises(Exception, match="no name|aborted|Writing"):
        write_files(spark.createDataFrame([("../x", bytearray(b"a"))], "name string, content binary"), str(tmp_path))
    assert os.listdir(tmp_path) == []
