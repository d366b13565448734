"""Registered queries of rules with their details and pages: marks, inks, print checks, proofs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.document_queries import FINDINGS, PAGES, PROFILES, facts
from quoin.operators.hierarchy import FIELDS
from quoin.plans import preflight, printcheck, structure
from quoin.queries import joined, query, table


@query(f"""
SELECT CASE grouping(profile_id, id, doc_id) WHEN 7 THEN 'corpus' WHEN 3 THEN 'profile' WHEN 1 THEN 'rule' ELSE 'document' END AS scope, profile_id, id, doc_id,
  count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warn') AS warn, count(*) FILTER (WHERE level = 'info') AS info, count(*) FILTER (WHERE level = 'pass') AS "pass", sum(n)::BIGINT AS pages,
  CASE WHEN bool_or(level = 'error') THEN 'bad' WHEN bool_or(level = 'warn') THEN 'warn' ELSE 'ok' END AS verdict
FROM ({FINDINGS}) GROUP BY GROUPING SETS ((), (profile_id), (profile_id, id), (profile_id, doc_id))
""")
def finding_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings summed over all, by profile, by rule and by document at once."""
    return preflight.levels(preflight.evaluate(facts(spark, sf_dir), preflight.profile_table(spark, PROFILES)))


@query(f"""
WITH {PAGES},
profile(profile_id, min_ppi, rgb_ok, spot_ok, max_ink) AS (VALUES ('strict', 300.0::DOUBLE, false, false, 300.0::DOUBLE), ('loose', 60.0, true, true, 400.0)),
img AS (SELECT p.doc_id, profile_id, page, seq, [seq % 100, 0, seq % 100 + 50, 30]::DOUBLE[] AS box, min_ppi > 0 AND ppi + 0.5 < min_ppi AS low, family = 'RGB' AND NOT rgb_ok AS rgb, family FROM placed p, profile WHERE NOT mask),
a AS (SELECT *, CASE WHEN low THEN 'image-ppi' WHEN rgb THEN 'image-rgb' WHEN family = 'Lab' THEN 'colour-lab' ELSE 'image-ok' END AS id FROM img),
m AS (
  SELECT doc_id, profile_id, page, l_orderkey * 8 + l_linenumber AS seq, [0, l_linenumber, 10, l_linenumber + 10]::DOUBLE[] AS box, spot_ok, l_linenumber AS k,
    CASE WHEN l_linenumber = 1 AND NOT rgb_ok THEN 'vector-rgb' WHEN l_linenumber = 2 THEN 'colour-lab' WHEN l_linenumber = 3 THEN 'spot' WHEN l_linenumber = 4 THEN 'registration' WHEN l_linenumber = 5 AND l_quantity * 8 > max_ink + 0.5 THEN 'total-ink' END AS id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN page ON c_custkey = o_custkey, profile
)
SELECT doc_id, profile_id, page, seq, array_to_string(list_transform(box, lambda v: v::INT), ',') AS box, CASE WHEN low THEN 'error' WHEN id = 'image-ok' THEN 'ok' ELSE 'warn' END AS level, id, low AND rgb AS also_rgb FROM a
UNION ALL SELECT doc_id, profile_id, page, seq + 4611686018427387904, array_to_string(list_transform(box, lambda v: v::INT), ','), CASE WHEN k = 3 AND spot_ok THEN 'ok' ELSE 'warn' END, id, false FROM m WHERE id IS NOT NULL
""")
def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where on which page images and colours need a look."""
    f = facts(spark, sf_dir)
    d, line = (lambda c: c.cast("double")), F.col("l_linenumber")
    left = d(F.col("seq") % 100)
    placement = f["placement"].withColumn("box", F.array(left, F.lit(0.0), left + 50, F.lit(30.0)))
    on = f["placement"].select("doc_id", "page", F.col("seq").alias("o_orderkey"))
    k = F.element_at(F.array(*map(F.lit, ("rgb", "lab", "spot", "reg", "cmyk", "none", "none"))), line)
    mark = table(spark, sf_dir, "lineitem").join(on, F.col("l_orderkey") == F.col("o_orderkey"))
    mark = mark.select("doc_id", "page", (F.col("l_orderkey") * 8 + line).alias("seq"), k.alias("k"), F.array(F.lit(0.0), d(line), F.lit(10.0), d(line + 10)).alias("box"), F.lit("").alias("label"), (F.col("l_quantity") * 8).alias("tac"))
    found = preflight.page_marks({"placement": placement, "mark": mark}, preflight.profile_table(spark, PROFILES))
    return found.select("doc_id", "profile_id", "page", "seq", F.array_join(F.transform("box", lambda v: v.cast("int").cast("string")), ",").alias("box"), "level", "id", "also_rgb")


PAGE_LIST = "array_to_string(list_transform({0}[1:5], lambda p: p + 1), ', ') || CASE WHEN len({0}) > 5 THEN ' and ' || (len({0}) - 5) || ' more' ELSE '' END"


@query(f"""
WITH {PAGES},
profile(profile_id, bleed_mm, min_ppi, rgb_ok, spot_ok, max_ink) AS (VALUES ('strict', 3.0::DOUBLE, 300.0::DOUBLE, false, false, 300.0::DOUBLE), ('loose', 0.0, 60.0, true, true, 400.0)),
more AS (
  SELECT doc_id, page, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_linenumber = 7 THEN 'spot' WHEN l_linenumber = 5 AND l_suppkey % 40 = 0 THEN 'registration' WHEN l_linenumber = 4 AND l_suppkey % 30 = 0 THEN 'gradient' ELSE 'cmyk' END AS kind, l_quantity * 8 AS tac, l_linenumber || ':' || l_quantity::INT AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN page ON c_custkey = o_custkey
),
every AS (SELECT doc_id, page, seq, kind, tac, label, kind || '=' || label AS key FROM more UNION ALL SELECT doc_id, page, seq + 4611686018427387904, 'spot', NULL, 'Ink A', 'spot:Ink A' FROM placed WHERE NOT mask AND seq % 17 = 0),
inv AS (SELECT doc_id, key, any_value(kind) AS kind, any_value(label) AS label, max(tac) AS tac, count(*) AS uses, list_sort(list(DISTINCT page)) AS pages, min(seq) AS first_seen FROM every GROUP BY doc_id, key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY len(pages) DESC, uses DESC, first_seen) AS place FROM inv),
on_pages AS (SELECT doc_id, kind, key, tac, unnest(pages) AS page FROM inv),
spots AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM ranked WHERE kind = 'spot'),
told AS (SELECT doc_id, string_agg(label || ' on ' || {PAGE_LIST.format("pages")}, '; ' ORDER BY nth) AS detail FROM spots WHERE nth <= 8 GROUP BY doc_id),
lists AS (SELECT doc_id, kind, count(DISTINCT key) AS n, list_sort(list(DISTINCT page)) AS pages FROM on_pages GROUP BY ALL),
room AS (SELECT doc_id, page, coalesce(2 * inset > 2, false) AS room FROM page),
reg AS (SELECT o.doc_id, bool_and(room) AS room FROM on_pages o JOIN room USING (doc_id, page) WHERE kind = 'registration' GROUP BY ALL),
ink AS (SELECT doc_id, profile_id, max_ink, list_sort(list(DISTINCT page) FILTER (WHERE tac > max_ink + 0.5)) AS pages FROM on_pages, profile WHERE kind = 'cmyk' GROUP BY ALL),
top AS (SELECT doc_id, arg_max(label, (tac, -place)) AS label, max(tac) AS most FROM ranked WHERE kind = 'cmyk' GROUP BY ALL),
low AS (SELECT doc_id, profile_id, list_sort(list(DISTINCT page) FILTER (WHERE ppi + 0.5 < min_ppi)) AS pages, min(ppi) AS worst FROM placed, profile WHERE NOT mask GROUP BY ALL),
bled AS (SELECT doc_id, profile_id, bleed_mm, list_sort(list(DISTINCT page) FILTER (WHERE greatest(0, inset) + 0.05 < bleed_mm * (72 / 25.4::DOUBLE))) AS pages, count(*) AS n, count(inset) AS known FROM page, profile GROUP BY ALL),
doc AS (SELECT n_name AS doc_id, count(*) AS n, n_nationkey % 2 AS extra, arg_min(w - 2 * coalesce(inset, 0), page) AS w, arg_min(h - 2 * coalesce(inset, 0), page) AS h FROM page JOIN nation ON n_name = doc_id GROUP BY ALL),
found AS (
  SELECT doc_id, profile_id, 'gradient-rgb' AS id, 'warn' AS level, n::VARCHAR AS detail, pages FROM lists, profile WHERE kind = 'gradient' AND NOT rgb_ok
  UNION ALL SELECT doc_id, profile_id, 'spot', CASE WHEN spot_ok THEN 'info' ELSE 'warn' END, detail, pages FROM lists JOIN told USING (doc_id), profile WHERE kind = 'spot'
  UNION ALL SELECT doc_id, profile_id, 'registration', CASE WHEN room THEN 'info' ELSE 'warn' END, '', pages FROM lists JOIN reg USING (doc_id), profile WHERE kind = 'registration'
  UNION ALL SELECT doc_id, profile_id, 'total-ink', CASE WHEN pages IS NULL THEN 'pass' ELSE 'warn' END, label || ' = ' || most::INT || '%', pages FROM ink JOIN top USING (doc_id)
  UNION ALL SELECT doc_id, profile_id, 'image-ppi', CASE WHEN pages IS NULL THEN 'pass' ELSE 'warn' END, floor(worst + 0.5)::INT::VARCHAR, pages FROM low
  UNION ALL SELECT doc_id, profile_id, 'idml-pages', CASE WHEN extra = 0 THEN 'pass' ELSE 'error' END, n || ' / ' || (n + extra), NULL FROM doc, profile
  UNION ALL SELECT doc_id, profile_id, 'idml-size', 'warn', '', NULL FROM doc, profile WHERE NOT (abs(300 - w) < 0.6 AND abs(200 - h) < 0.6)
)
SELECT doc_id, profile_id, id, level, detail, coalesce(array_to_string(pages, ','), '') AS pages FROM found
""")
def preflight_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on inks, gradients, spot colours of images, registration, resolution and the layout file: details and page lists."""
    f = facts(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    line, on = F.col("l_linenumber"), f["placement"].select("doc_id", "page", F.col("seq").alias("o_orderkey"))
    li = table(spark, sf_dir, "lineitem").join(on, F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(line == 7, "spot").when((line == 5) & (F.col("l_suppkey") % 40 == 0), "registration").when((line == 4) & (F.col("l_suppkey") % 30 == 0), "gradient").otherwise("cmyk")
    label = F.concat_ws(":", line.cast("string"), F.col("l_quantity").cast("int").cast("string"))
    set_ = {"doc_id": F.col("doc_id"), "page": F.col("page"), "seq": F.col("l_orderkey") * 8 + line, "key": F.concat_ws("=", kind, label), "kind": kind, "label": label, "tac": F.col("l_quantity") * 8, "family": F.when(kind == "gradient", "RGB")}
    f["paint"] = li.select(*[(set_[c.name] if c.name in set_ else F.lit(None).cast(c.dataType)).alias(c.name) for c in f["paint"].schema])
    spotted = F.col("image_id") % 17 == 0
    f["image"] = f["image"].withColumn("spot", F.when(spotted, F.array(F.lit("Ink A"))).otherwise(F.col("spot"))).withColumn("swatches", F.when(spotted, F.create_map(F.lit("Ink A"), F.lit("#123456"))))
    size = F.array(F.struct(F.lit(300.0).alias("w"), F.lit(200.0).alias("h")))
    idml = f["doc"].join(nation.select(F.col("n_name").alias("doc_id"), (F.col("n_nationkey") % 2).alias("extra")), "doc_id").select("doc_id", (F.col("page_count") + F.col("extra")).cast("int").alias("page_count"), size.alias("sizes"))
    found = preflight.evaluate(f, preflight.profile_table(spark, PROFILES), idml)
    ids = ("gradient-rgb", "spot", "registration", "total-ink", "image-ppi", "idml-pages", "idml-size")
    return found.where(F.col("id").isin(*ids)).select("doc_id", "profile_id", "id", "level", "detail", joined("pages").alias("pages"))


CHECKS = {"strict": {"min_text": 6.0, "light_min": 9.0, "multi_ink_min": 8.0, "reverse_min": 7.0, "safe_mm": 3.0}, "loose": {"min_text": 4.0, "light_min": 4.0, "multi_ink_min": 5.0, "reverse_min": 5.0, "safe_mm": 0.0}}


@query("""
WITH profile(profile_id, min_text, light_min, multi_ink_min, reverse_min, safe_mm) AS (VALUES ('strict', 6.0::DOUBLE, 9.0::DOUBLE, 8.0::DOUBLE, 7.0::DOUBLE, 3.0::DOUBLE), ('loose', 4.0, 4.0, 5.0, 5.0, 0.0)),
frame AS (SELECT (p_partkey % 10)::VARCHAR AS doc_id, p_partkey AS k, p_partkey % 7 AS page, p_size * 4.0 - 10 AS x, p_size * 3.0 - 4 AS y FROM part WHERE p_partkey % 9 <> 0 AND p_partkey % 31 <> 0),
edge AS (SELECT f.*, profile_id, least(x, 200 - x - 20, y, 160 - y - 10) AS gap, safe_mm FROM frame f, profile),
e AS (SELECT doc_id, profile_id, page, k, CASE WHEN gap < -0.01 THEN 'frame-past-trim' WHEN gap < safe_mm * (72 / 25.4::DOUBLE) THEN 'frame-in-safe' END AS "check", 0 AS chars, abs(gap / (72 / 25.4::DOUBLE)) AS size, NULL AS extra FROM edge),
run AS (SELECT l_partkey AS k, l_quantity::INT AS n, l_linenumber + 3.0 AS size, l_suppkey % 8 AS c, CASE WHEN l_suppkey % 6 = 0 THEN 'Light Italic' ELSE 'Bold' END AS style FROM lineitem),
r AS (SELECT f.doc_id, profile_id, page, f.k, n, size, c, style, c % 4 AS inks, size < min_text AS small, style LIKE 'Light%' AND size < light_min AS light, c % 4 = 0 AND size < reverse_min AS turned, c % 4 >= 2 AND size < multi_ink_min AS many FROM run JOIN frame f USING (k), profile),
t AS (
  SELECT doc_id, profile_id, page, k, 'small-text' AS "check", n, size, NULL AS extra FROM r WHERE small
  UNION ALL SELECT doc_id, profile_id, page, k, 'light-weight', n, size, style FROM r WHERE light
  UNION ALL SELECT doc_id, profile_id, page, k, 'reversed-out', n, size, NULL FROM r WHERE turned
  UNION ALL SELECT doc_id, profile_id, page, k, 'multi-ink', n, size, 'Colour ' || c || ', ' || inks || ' inks' FROM r WHERE NOT turned AND many
)
SELECT doc_id, profile_id, page, k::VARCHAR AS item_id, "check", chars::BIGINT AS chars, round(size, 6) AS size, extra FROM e WHERE "check" IS NOT NULL
UNION ALL SELECT doc_id, profile_id, page, k::VARCHAR, "check", sum(n)::BIGINT, round(min(size), 6), max(extra) FROM t GROUP BY doc_id, profile_id, page, k, "check"
""")
def print_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames past the trim, and small, light, reversed or many-inked text under two profiles."""
    k, d = F.col("p_partkey"), lambda c: (c if not isinstance(c, float) else F.lit(c)).cast("double")
    box = lambda x, y, w, h: F.struct(*[d(v).alias(n) for n, v in zip("xywh", (x, y, w, h))])
    part = table(spark, sf_dir, "part")
    doc = (k % 10).cast("string")
    items = part.select(doc.alias("doc_id"), F.lit("TextFrame").alias("kind"), (k % 31 == 0).alias("hidden"), box(F.col("p_size") * 4.0 - 10, F.col("p_size") * 3.0 - 4, 20.0, 10.0).alias("box"), (k % 7).alias("page"), k.cast("string").alias("item_id"), k.cast("string").alias("story_id"))
    story = part.select(doc.alias("doc_id"), k.cast("string").alias("story_id"), F.when(k % 9 == 0, "  ").otherwise("words").alias("text"))
    pages = part.select(doc.alias("doc_id"), (k % 7).alias("ord"), F.lit(False).alias("is_master"), box(0.0, 0.0, 200.0, 160.0).alias("box")).distinct()
    colour = F.col("l_suppkey") % 8
    e = F.struct((F.col("l_linenumber") + 3.0).cast("string").alias("size"), colour.cast("string").alias("fill"), F.when(F.col("l_suppkey") % 6 == 0, "Light Italic").otherwise("Bold").alias("font_style"), F.lit("Face").alias("font"))
    effective = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 10).cast("string").alias("doc_id"), F.col("l_partkey").cast("string").alias("story_id"), F.col("l_quantity").cast("int").alias("n"), e.alias("e"))
    c = F.col("c")
    used = effective.select("doc_id", F.col("e.fill").cast("int").alias("c")).distinct()
    value = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.when(i < c % 4, 50.0).otherwise(0.0))
    swatch = used.select("doc_id", c.cast("string").alias("id"), F.lit("color").alias("type"), F.concat(F.lit("Colour "), c.cast("string")).alias("name"), F.lit("CMYK").alias("space"), F.lit("Process").alias("model"), value.alias("value"), F.lit(None).cast("string").alias("base"), F.lit(None).cast("double").alias("tint"), F.lit(None).cast("array<string>").alias("stops"))
    found = printcheck.hits(items, pages, story, effective, swatch, preflight.profile_table(spark, CHECKS))
    return found.select("doc_id", "profile_id", "page", "item_id", "check", "chars", F.round("size", 6).alias("size"), "extra")


@query("""
WITH c AS (SELECT c_custkey AS k, (c_custkey % 10)::VARCHAR AS doc_id, c_custkey % 8 <> 7 AS there FROM customer),
o AS (SELECT o_orderkey AS k, (o_custkey % 10)::VARCHAR AS doc_id, o_custkey AS c, o_orderkey % 3 <> 2 AS frame, o_orderkey % 37 = 0 AS master, CASE WHEN o_orderkey % 29 = 0 THEN 'nowhere' WHEN o_orderkey % 31 = 0 THEN 'i' || o_orderkey END AS next, o_orderkey % 12 AS fill, o_orderkey % 23 = 0 AS hidden FROM orders),
f AS (SELECT * FROM o WHERE frame AND NOT master),
art AS (SELECT * FROM o WHERE NOT frame AND NOT master),
lost AS (SELECT * FROM c WHERE there AND k NOT IN (SELECT c FROM o WHERE frame) AND k NOT IN (SELECT k + 10 FROM c WHERE there AND k % 11 = 0)),
several AS (SELECT doc_id, c FROM f GROUP BY ALL HAVING count(*) > 1 AND NOT bool_and(next IS NOT NULL)),
used AS (SELECT DISTINCT doc_id, fill, ['process', 'rgb', 'spot', 'registration'][(fill % 4 + 1)::INT] AS kind FROM o WHERE NOT master AND NOT hidden),
found(doc_id, level, code, ref, nth) AS (
  SELECT (s_suppkey % 10)::VARCHAR, 'error', 'missing-spread', 'Spreads/' || s_suppkey, s_suppkey FROM supplier WHERE s_suppkey % 7 = 0
  UNION ALL SELECT doc_id, 'error', 'missing-story', 'Stories/' || k, k FROM c WHERE NOT there
  UNION ALL SELECT doc_id, 'error', 'frame-without-story', 'i' || k, k FROM f WHERE c NOT IN (SELECT k FROM c WHERE there)
  UNION ALL SELECT doc_id, 'info', 'orphan-stories', 's' || k, k FROM lost
  UNION ALL SELECT doc_id, 'warn', 'broken-thread', 'i' || k, k FROM f WHERE next = 'nowhere'
  UNION ALL SELECT s.doc_id, 'warn', 'story-in-several-frames', 's' || s.c, c.k FROM several s LEFT JOIN c ON c.k = s.c AND c.there
  UNION ALL SELECT doc_id, 'info', 'linked-artwork', 'i' || k, k FROM art WHERE k % 5 = 0
  UNION ALL SELECT doc_id, 'warn', 'text-on-path', 'i' || k, k FROM art WHERE k % 14 = 0
  UNION ALL SELECT doc_id, 'warn', 'run-level-fonts', (4 * count(*))::VARCHAR, 0 FROM c WHERE there AND k % 50 = 0 GROUP BY doc_id
  UNION ALL SELECT DISTINCT doc_id, 'warn', 'fonts-unavailable', CASE WHEN k % 50 = 0 THEN 'X Regular' ELSE 'Base Regular' END, 0 FROM c WHERE there AND CASE WHEN k % 50 = 0 THEN doc_id::INT % 2 = 0 ELSE doc_id::INT % 3 = 0 END
  UNION ALL SELECT (s_suppkey % 10)::VARCHAR, 'info', 'hidden-layers', 'Layer ' || s_suppkey, 0 FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL SELECT doc_id, CASE kind WHEN 'spot' THEN 'info' ELSE 'warn' END, CASE kind WHEN 'rgb' THEN 'rgb-swatches' WHEN 'spot' THEN 'spot-swatches' ELSE 'registration-swatch' END, 'Colour ' || fill, 0 FROM used WHERE kind <> 'process'
),
nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY nth NULLS LAST, ref) AS place FROM found)
SELECT doc_id, level, code, string_agg(ref, ',' ORDER BY place) FILTER (WHERE place <= 20) AS refs, count(*) AS "count" FROM nth GROUP BY doc_id, level, code
""")
def structure_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is amiss in the structure of ten layouts, with the first references."""
    c, k, none = F.col("c_custkey"), F.col("o_orderkey"), lambda t: F.lit(None).cast(t)
    text_id = lambda prefix, of: F.concat(F.lit(prefix), of.cast("string"))
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip("xywh", v)])
    customer, supplier = table(spark, sf_dir, "customer").withColumn("doc_id", (c % 10).cast("string")), table(spark, sf_dir, "supplier").withColumn("doc_id", (F.col("s_suppkey") % 10).cast("string"))
    told = customer.where(c % 8 != 7)
    story = told.select("doc_id", text_id("s", c).alias("story_id"), text_id("Stories/", c).alias("src"), F.lit("abcd").alias("text"), F.when(c % 11 == 0, F.array(text_id("s", c + 10))).otherwise(F.array().cast("array<string>")).alias("anchored_stories"))
    manifest = customer.select("doc_id", F.lit("Story").alias("kind"), c.alias("ord"), text_id("Stories/", c).alias("src"), (c % 8 != 7).alias("there"))
    manifest = manifest.unionByName(supplier.select("doc_id", F.lit("Spread").alias("kind"), F.col("s_suppkey").alias("ord"), text_id("Spreads/", F.col("s_suppkey")).alias("src"), (F.col("s_suppkey") % 7 != 0).alias("there")))
    frame = k % 3 != 2
    one = lambda test: F.when(~frame & test, 1).otherwise(0)
    item = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).cast("string").alias("doc_id"), F.lit("sp").alias("spread_id"), text_id("i", k).alias("item_id"), F.when(frame, "TextFrame").otherwise("Rectangle").alias("kind"), k.alias("ord"), (k % 37 == 0).alias("is_master"),
        F.when(frame, text_id("s", F.col("o_custkey"))).alias("story_id"), F.when(k % 29 == 0, "nowhere").when(k % 31 == 0, text_id("i", k)).alias("next"), none("string").alias("prev"), one(k % 5 == 0).alias("linked"), one(k % 14 == 0).alias("text_paths"),
        text_id("c", k % 12).alias("fill"), none("string").alias("stroke"), (k % 23 == 0).alias("hidden"), box(10, 10, 5, 5).alias("box"),
    )
    docs = customer.select("doc_id").distinct()
    page = docs.select("doc_id", F.lit("sp").alias("spread_id"), F.lit("p").alias("page_id"), F.lit(0).alias("ord"), F.lit(False).alias("is_master"), box(0, 0, 100, 100).alias("box"))
    own = {f"{p}_{f}": none("string") for p in "pc" for f in FIELDS} | {"c_font": F.when(c % 50 == 0, "X")}
    run = told.select("doc_id", text_id("s", c).alias("story_id"), F.lit(0).alias("para_ord"), F.lit("abcd").alias("text"), none("string").alias("para_style"), none("string").alias("char_style"), *[v.alias(n) for n, v in own.items()])
    style = docs.select("doc_id", F.lit("para").alias("kind"), F.lit(structure.NORMAL).alias("self"), none("string").alias("based_on"), *[(F.lit("Base") if f == "font" else none("string")).alias(f) for f in FIELDS])
    d = F.col("doc_id").cast("int")
    font = docs.select("doc_id", F.explode(F.array(F.struct(F.lit("Base").alias("family"), F.when(d % 3 == 0, "Substituted").otherwise("Installed").alias("status")), F.struct(F.lit("X").alias("family"), F.when(d % 2 == 0, "NotAvailable").otherwise("Installed").alias("status")))).alias("f")).select("doc_id", "f.*", F.lit("Regular").alias("style"))
    layer = supplier.select("doc_id", text_id("l", F.col("s_suppkey")).alias("self"), text_id("Layer ", F.col("s_suppkey")).alias("name"), (F.col("s_suppkey") % 4 != 0).alias("visible"))
    n = F.substring("id", 2, 9).cast("int")
    swatch = item.select("doc_id", F.col("fill").alias("id")).distinct().select(
        "doc_id", "id", F.lit("color").alias("type"), text_id("Colour ", n).alias("name"), F.when(n % 4 == 1, "RGB").otherwise("CMYK").alias("space"), F.when(n % 4 == 2, "Spot").when(n % 4 == 3, "Registration").otherwise("Process").alias("model"),
        F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40)]).alias("value"), none("string").alias("base"), none("double").alias("tint"), none("array<string>").alias("stops"),
    )
    found = structure.findings({"item": item, "page": page, "run": run, "style": style, "swatch": swatch, "story": story, "manifest": manifest, "font": font, "layer": layer})
    return found.select("doc_id", "level", "code", F.array_join("refs", ",").alias("refs"), "count")
