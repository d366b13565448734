"""Nested groups, swatches in layers and pinned styles on tables."""

import random

from pyspark.sql import functions as F


def product(p, q):
    return (p[0] * q[0] + p[2] * q[1], p[1] * q[0] + p[3] * q[1], p[0] * q[2] + p[2] * q[3], p[1] * q[2] + p[3] * q[3], p[0] * q[4] + p[2] * q[5] + p[4], p[1] * q[4] + p[3] * q[5] + p[5])


def test_world_maps(spark):
    from quoin.operators.hierarchy import world_maps

    r = random.Random(1)
    maps = [(1.0, 0.0, 0.0, 1.0, 2.0, 3.0), (0.0, 1.0, -1.0, 0.0, 1.0, 0.0), (-1.0, 0.0, 0.0, 1.0, 0.0, 5.0)]
    rows = [("d", k, k - 1 if k else None, list(r.choice(maps)), "top" if k in (0, 70) else None, k == 90) for k in range(130)]  # a chain 130 deep
    rows += [("d", 1000 + k, r.randrange(130), None if k % 5 == 0 else list(r.choice(maps)), None, None) for k in range(60)]
    rows += [("e", 1, 7777, list(maps[0]), None, False), ("d", 2000, 2001, list(maps[0]), "x", False), ("d", 2001, 2000, list(maps[0]), None, False), ("d", 2002, 2000, list(maps[0]), None, True)]
    df = spark.createDataFrame(rows, "doc string, id int, up int, m array<double>, layer string, hidden boolean")
    got = {(x.doc, x.id): x for x in world_maps(df, ["doc"], key="id", parent="up", own="m", nearest=("layer",), any_of=("hidden",)).collect()}
    known = {(d, i): (u, m, layer, h) for d, i, u, m, layer, h in rows}
    for (d, i), x in got.items():
        if i >= 2000:
            assert (x.m, x.layer, x.hidden) == (None, None, None)
            continue
        m, layer, hidden, at = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), None, False, i
        while (d, at) in known:
            up, own, la, h = known[d, at]
            m, layer, hidden, at = product(own or (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), m), layer or la, hidden or bool(h), up
        assert (tuple(x.m), x.layer, x.hidden) == (m, layer, hidden)
    assert len(got) == len(rows)
    assert world_maps(df.limit(0), ["doc"], key="id", parent="up", own="m").count() == 0


def test_swatches_in_layers(spark):
    from quoin.operators.hierarchy import resolve_swatches

    c = lambda i, v, model="Process": ("d", i, "color", i, "CMYK", model, v, None, None, None)
    tint = lambda i, base, t=50.0: ("d", i, "tint", i, None, None, None, base, t, None)
    grad = lambda i, *stops: ("d", i, "gradient", i, None, None, None, None, None, list(stops))
    rows = [c("a", [100.0, 0.0, 0.0, 50.0]), c("s", [0.0, 100.0, 0.0, 0.0], "Spot"), c("none", [0.0, 0.0, 0.0, 0.0]), ("d", "rgb", "color", "rgb", "RGB", "Process", [255.0, 0.0, 9.6], None, None, None)]
    rows += [tint(f"t{k}", f"t{k - 1}" if k else "a", 90.0) for k in range(9)]  # deeper than four
    rows += [grad("g", "t8", "s"), grad("gg", "g", "a"), tint("tg", "gg"), tint("lost", "nowhere"), tint("n", "Swatch/None"), tint("of rgb", "rgb"), grad("empty"), tint("no base", None), tint("nan", "a", float("nan"))]
    rows += [tint("x", "y"), tint("y", "x"), tint("z", "y"), grad("loop", "loop", "a")]
    df = spark.createDataFrame(rows, "doc string, id string, type string, name string, space string, model string, value array<double>, base string, tint double, stops array<string>")
    got = {x.id: x for x in resolve_swatches(df, ["doc"]).collect()}
    assert len(got) == len(rows)
    assert [got[k].kind for k in ("a", "s", "rgb", "t8", "g", "gg", "tg", "lost", "n", "of rgb", "no base")] == ["process", "spot", "rgb", "tint", "gradient", "gradient", "gradient", "unknown", "none", "rgb", "none"]
    assert abs(got["t8"].cmyk[0] - 100 * 0.9**9) < 1e-9 and got["t8"].inks == 2 and got["nan"].cmyk == [100.0, 0.0, 0.0, 50.0]
    assert got["g"].rgb == got["t8"].rgb == got["gg"].rgb == got["tg"].rgb and got["g"].inks == 2 and got["none"].reversed and got["empty"].inks == 0
    assert {k for k, x in got.items() if x.cyclic} == {"x", "y", "z", "loop"}
    assert got["x"].kind == "none" and got["loop"].kind == "gradient" and got["loop"].inks == 2
    assert resolve_swatches(df.limit(0), ["doc"]).count() == 0


def test_pins(spark):
    """After planning, every style shows the wanted font, and no pin could be left out."""
    from quoin.operators.hierarchy import FIELDS
    from quoin.plans.fontmap import font_map, plan_styles

    r = random.Random(4)
    rows = []
    for d in "pq":
        for k in range(120):
            up = None if k < 4 else r.randrange(k) if r.random() < 0.95 else 9999
            rows.append((d, "para", f"ParagraphStyle/{k}", None if up is None else (f"{up}" if k % 7 == 0 else f"ParagraphStyle/{up}"), r.choice([None, None, "", "A", "B"]), r.choice([None, None, "Bold", "Regular"])))
        rows.append((d, "para", "ParagraphStyle/$ID/NormalParagraphStyle", None, "A", None))
        rows += [(d, "char", f"CharacterStyle/{k}", f"CharacterStyle/{k - 1}" if k else None, "B" if k == 10 else None, "Bold" if k == 3 else None) for k in range(30)]
    none = {f: F.lit(None).cast("string") for f in FIELDS if f not in ("font", "font_style")}
    style = spark.createDataFrame(rows, "doc_id string, kind string, self string, based_on string, font string, font_style string").withColumns(none)
    entries = [(d, "A", "Bold", "X", None) for d in "pq"] + [("p", "B", "Regular", "Y", "Light"), ("q", "A", "Regular", "Z", "Book")]
    mapping = font_map(spark.createDataFrame(entries, "doc_id string, from_family string, from_style string, to_family string, to_style string"))
    plan = {(x.doc_id, x.self): (x.new_font, x.new_font_style) for x in plan_styles(style, mapping).collect()}
    goal = {(d, f.lower() + "|" + s.lower()): (to, w or s) for d, f, s, to, w in entries}
    own = {(d, s): (kind, up, f, st) for d, kind, s, up, f, st in rows}
    assert set(plan) == set(own)

    def shown(d, s, sets):
        kind, font, st, seen = own[d, s][0], None, None, set()
        while s and (d, s) in own and s not in seen:
            seen.add(s)
            f, t = sets(d, s)
            font, st = font or f or None, st or t or None
            up, prefix = own[d, s][1], "ParagraphStyle/" if kind == "para" else "CharacterStyle/"
            s = up if up is None or up.startswith(prefix) else prefix + up
        if kind == "para":
            f, t = sets(d, "ParagraphStyle/$ID/NormalParagraphStyle")
            font, st = font or f or None, st or t or None
        return font, st or "Regular"

    before = lambda d, s: own[d, s][2:]
    n_pins = 0
    for d, s in own:
        f, t = shown(d, s, before)
        want = goal.get((d, f"{f}|{t}".lower()), (f, t)) if f else (f, t)
        assert shown(d, s, lambda *x: plan[x]) == want
        f0, t0 = own[d, s][2:]
        takes = want != (f, t) and (f0 or t0)
        if not takes and plan[d, s] != (f0, t0):  # a pin: without it the style would be wrong
            n_pins += 1
            assert shown(d, s, lambda *x, k=(d, s): plan[x] if x != k else own[k][2:]) != want
    assert n_pins > 10
