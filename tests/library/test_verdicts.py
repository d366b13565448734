"""Documents and profiles in several versions: only what changes comes out."""

import json

import pytest

from tests.library.pdfwriter import colourful, simple


def test_changes_of_documents_and_profiles(spark, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark talks to its state by it
    from quoin.sources.pdf import scan_pdf, tables
    from quoin.streaming.verdicts import follow, measures

    docs, profiles, store, checkpoint = (str(tmp_path / n) for n in ("docs", "profiles", "store", "checkpoint"))
    (tmp_path / "profiles").mkdir()

    def land(version, **files):
        facts = tables(scan_pdf(spark.createDataFrame([(n, bytearray(c)) for n, c in files.items()], "doc_id string, content binary")))
        measures(facts, version).write.mode("append").parquet(docs)

    def profile(file, *rows):
        (tmp_path / "profiles" / f"{file}.json").write_text("\n".join(json.dumps({"profile_id": n, "version": v, "settings": json.dumps(s)}) for n, v, s in rows))

    seen = set()

    def run():
        follow(spark, docs, profiles, store, checkpoint, buckets=3).awaitTermination(240)
        rows = [(r.doc_id, r.version, r.profile_id, r.profile_version, r.id, r.change, tuple(r.pages)) for r in spark.read.parquet(store).collect()]
        assert len(rows) == len(set(rows))
        new = set(rows) - seen
        seen.update(new)
        return new

    land(1, a=simple(), b=colourful())
    profile("1", ("strict", 1, {"max_ink": 250.0}), ("loose", 1, {"allow_rgb": True, "allow_spot": True, "min_ppi": 50.0, "max_ink": 400.0}))
    first = run()
    assert {x for x in first if x[2] == "loose"} == set()
    assert {(x[0], x[4], x[5], x[6]) for x in first} == {("a", "image-ppi", "new", (0, 1)), ("a", "rgb", "new", (0, 1)), ("b", "rgb", "new", (0,)), ("b", "spot", "new", (0,)), ("b", "total-ink", "new", (0,))}

    profile("2", ("strict", 2, {"max_ink": 330.0, "min_ppi": 150.0}), ("strict", 1, {"max_ink": 10.0}))  # the older one comes late
    assert {(x[0], x[3], x[4], x[5], x[6]) for x in run()} == {("a", 2, "image-ppi", "changed", (0,)), ("b", 2, "total-ink", "gone", ())}

    land(2, a=simple())  # the same file again: nothing to tell
    land(1, b=simple())  # an older version of b
    profile("3", ("strict", 2, {}))
    assert run() == set()

    land(3, a=colourful(), c=simple())
    third = run()
    assert {(x[0], x[1], x[4], x[5]) for x in third if x[0] == "a"} == {("a", 3, "image-ppi", "gone"), ("a", 3, "spot", "new"), ("a", 3, "rgb", "changed")}
    assert {(x[0], x[4], x[5]) for x in third if x[0] == "c"} == {("c", "image-ppi", "new"), ("c", "rgb", "new")} and not any(x[0] == "b" for x in third)


def test_rules_under_a_profile():
    from quoin.streaming.verdicts import findings_of

    m = {"bleed": [{"value": 8.5, "pages": [0]}, {"value": 8.4, "pages": [2, 1]}], "ink": [{"value": 300.5, "pages": [0]}, {"value": 300.6, "pages": [3]}], "spot": [{"value": 1.0, "pages": [4]}]}
    assert findings_of(m, {}) == {"bleed": ("error", [1, 2]), "total-ink": ("warn", [3]), "spot": ("warn", [4])}
    assert findings_of(m, {"max_ink": 0.0, "bleed_mm": 0.0, "allow_spot": True}) == {} and findings_of({}, {}) == {}
