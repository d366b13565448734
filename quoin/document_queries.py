"""Registered queries of rules and reports: tables of documents are drawn from the driver's
tables (nations as documents, customers as pages, orders as placed images, and so on), and
the library's plans run over them whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions import text
from quoin.lineage import cut
from quoin.operators import hierarchy, joins, ordered
from quoin.plans import alternatives, preflight, structure, typography
from quoin.queries import query, table

# ------------------------------------------------------------------ preflight
PAGES = """
page AS (
  SELECT n_name AS doc_id, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS page, 300.0 + c_custkey % 2 * 10 AS w, 200.0 AS h,
    CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 4 * 4.0 END AS inset, c_custkey % 50 = 0 AS rgb_blend, c_custkey % 9 = 0 AS overprint, c_custkey % 11 = 0 AS unreadable
  FROM customer JOIN nation ON n_nationkey = c_nationkey
),
placed AS (
  SELECT doc_id, page, o_orderkey AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'RGB' WHEN '2-HIGH' THEN 'Lab' ELSE 'CMYK' END AS family, o_orderstatus = 'P' AS mask, o_orderkey % 400 + 50.0 AS ppi
  FROM orders JOIN page ON c_custkey = o_custkey
),
paint AS (
  SELECT doc_id, page, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_linenumber = 7 THEN 'spot' WHEN l_linenumber = 6 AND l_quantity > 45 THEN 'rgb' ELSE 'cmyk' END AS kind, l_quantity * 8 AS tac, l_linenumber || ':' || l_quantity::INT AS label
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN page ON c_custkey = o_custkey WHERE l_linenumber < 7 OR l_suppkey % 3 = 0
)
"""
PROFILES = {"strict": {"bleed_mm": 3.0, "min_ppi": 300.0, "max_ink": 300.0}, "loose": {"bleed_mm": 0.0, "min_ppi": 60.0, "allow_rgb": True, "allow_spot": True, "max_ink": 400.0}}


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Tables of quoin.schema.PDF: nations as documents, customers as their pages."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), F.col("n_nationkey").alias("key"), "n_regionkey")
    box = lambda x, y, w, h: F.struct(*[c.cast("double").alias(n) for c, n in zip((x, y, w, h), "xywh")])
    k, zero = F.col("c_custkey"), F.lit(0.0)
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("key"))
    w, inset = 300.0 + k % 2 * 10, F.when(k % 5 != 0, k % 4 * 4.0)
    trim = F.when(inset.isNotNull(), box(inset, inset, w - 2 * inset, 200.0 - 2 * inset))
    number = (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).cast("int")
    page = c.select("doc_id", "c_custkey", number.alias("page"), box(zero, zero, w, F.lit(200.0)).alias("media"), trim.alias("trim"), F.lit(None).cast("struct<x:double,y:double,w:double,h:double>").alias("bleed"), F.when(k % 50 == 0, "RGB").otherwise("none").alias("blend"), (k % 11 == 0).alias("unreadable"), (k % 9 == 0).alias("overprint"))
    o = table(spark, sf_dir, "orders").join(page.select("doc_id", "page", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    priority, ppi = F.col("o_orderpriority"), F.col("o_orderkey") % 400 + 50.0
    family = F.when(priority == "1-URGENT", "RGB").when(priority == "2-HIGH", "Lab").otherwise("CMYK")
    placement = o.select("doc_id", F.col("o_orderkey").alias("seq"), "page", F.col("o_orderkey").alias("image_id"), family.alias("family"), (F.col("o_orderstatus") == "P").alias("mask"), F.lit(False).alias("soft_mask"), F.lit(500.0).alias("px_w"), F.lit(300.0).alias("px_h"), ppi.alias("ppi_x"), (ppi + 10).alias("ppi_y"))
    image = o.select("doc_id", F.col("o_orderkey").alias("image_id"), F.array().cast("array<string>").alias("spot"), F.lit(None).cast("map<string,string>").alias("swatches"))
    li = table(spark, sf_dir, "lineitem").join(o.select("doc_id", "page", "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_linenumber < 7 or l_suppkey % 3 = 0")
    line = F.col("l_linenumber")
    kind = F.when(line == 7, "spot").when((line == 6) & (F.col("l_quantity") > 45), "rgb").otherwise("cmyk")
    label = F.concat_ws(":", line.cast("string"), F.col("l_quantity").cast("int").cast("string"))
    none = {n: F.lit(None).cast(t).alias(n) for n, t in (("family", "string"), ("rgb", "string"), ("rgb2", "string"), ("cmyk", "array<double>"), ("icc", "boolean"), ("source", "string"), ("tint", "int"))}
    paint = li.select("doc_id", "page", (F.col("l_orderkey") * 8 + line).alias("seq"), F.concat_ws("=", kind, label).alias("key"), kind.alias("kind"), label.alias("label"), (F.col("l_quantity") * 8).alias("tac"), *none.values())
    s = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("key"))
    font = s.select("doc_id", F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, "Type3").otherwise("Type1").alias("type"), (F.col("s_suppkey") % 3 != 0).alias("embedded"), F.array((F.col("s_suppkey") % 4).cast("int")).alias("pages"))
    doc = page.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count")).withColumns({"pdfx": F.lit("PDF/X-4"), "has_intent": F.lit(True), "intent_id": F.col("doc_id"), "inline_images": F.lit(0), "error": F.lit(None).cast("string")})
    found = {"doc": doc, "page": page.drop("c_custkey"), "font": font, "image": image, "placement": placement, "paint": paint}
    return {k: cut(v) for k, v in found.items()}  # facts are written once and read by all rules


FINDINGS = f"""
WITH {PAGES},
profile(profile_id, bleed_mm, min_ppi, rgb_ok, spot_ok, max_ink) AS (VALUES ('strict', 3.0::DOUBLE, 300.0::DOUBLE, false, false, 300.0::DOUBLE), ('loose', 0.0, 60.0, true, true, 400.0)),
d AS (SELECT DISTINCT doc_id FROM page),
bled AS (SELECT *, CASE WHEN inset IS NOT NULL THEN greatest(0, inset) END AS bleed FROM page),
mm AS (SELECT doc_id, page, floor((w - 2 * coalesce(inset, 0)) / (72 / 25.4::DOUBLE) * 10 + 0.5) AS mw, floor((h - 2 * coalesce(inset, 0)) / (72 / 25.4::DOUBLE) * 10 + 0.5) AS mh FROM page),
size AS (SELECT doc_id, mw, mh, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(page)) AS place FROM mm GROUP BY doc_id, mw, mh),
font AS (SELECT n_name AS doc_id, s_suppkey % 3 <> 0 AS embedded, s_suppkey % 10 = 0 AS t3, s_suppkey % 4 AS page FROM supplier JOIN nation ON n_nationkey = s_nationkey),
real AS (SELECT * FROM placed WHERE NOT mask),
rgb AS (SELECT doc_id, 'image' AS part, page FROM real WHERE family = 'RGB' UNION ALL SELECT doc_id, 'vector', page FROM paint WHERE kind = 'rgb' UNION ALL SELECT doc_id, 'blend', page FROM page WHERE rgb_blend UNION ALL SELECT doc_id, 'lab', page FROM real WHERE family = 'Lab' UNION ALL SELECT doc_id, 'spot', page FROM paint WHERE kind = 'spot'),
parts AS (SELECT doc_id, part, count(DISTINCT page) AS pages FROM rgb GROUP BY ALL),
any_rgb AS (SELECT doc_id, count(DISTINCT page) AS pages FROM rgb WHERE part IN ('image', 'vector', 'blend') GROUP BY ALL),
ink AS (SELECT doc_id, profile_id, count(DISTINCT page) FILTER (WHERE tac > max_ink + 0.5) AS pages FROM paint, profile WHERE kind = 'cmyk' AND max_ink > 0 GROUP BY ALL),
worst AS (SELECT doc_id, arg_min(page, (ppi, seq)) AS page, min(ppi) AS ppi FROM real GROUP BY ALL),
low AS (SELECT doc_id, profile_id, count(*) FILTER (WHERE ppi + 0.5 < min_ppi) AS n, count(DISTINCT page) FILTER (WHERE ppi + 0.5 < min_ppi) AS pages FROM real, profile GROUP BY ALL),
found AS (
  SELECT doc_id, profile_id, 1 AS ord, 'page-size' AS id, CASE WHEN max(place) = 1 THEN 'pass' ELSE 'warn' END AS level, coalesce(max(size.n) FILTER (WHERE size.place = 2), 0) AS n FROM size CROSS JOIN profile GROUP BY doc_id, profile_id
  UNION ALL SELECT doc_id, profile_id, 2, 'bleed', CASE WHEN bool_and(inset IS NULL) AND bleed_mm > 0 THEN 'error' WHEN bool_and(inset IS NULL) THEN 'info' WHEN count(*) FILTER (WHERE bleed + 0.05 < bleed_mm * (72 / 25.4::DOUBLE)) > 0 THEN 'error' ELSE 'pass' END,
    CASE WHEN bool_and(inset IS NULL) THEN least(200, count(*)) ELSE count(*) FILTER (WHERE bleed + 0.05 < bleed_mm * (72 / 25.4::DOUBLE)) END FROM bled CROSS JOIN profile GROUP BY doc_id, profile_id, bleed_mm
  UNION ALL SELECT d.doc_id, profile_id, 3, 'fonts', CASE WHEN count(f.doc_id) = 0 THEN 'info' WHEN bool_or(NOT embedded) THEN 'error' ELSE 'pass' END, count(DISTINCT f.page) FILTER (WHERE NOT embedded) FROM d CROSS JOIN profile LEFT JOIN font f USING (doc_id) GROUP BY ALL
  UNION ALL SELECT doc_id, profile_id, 4, 'fonts-type3', 'warn', count(DISTINCT page) FROM font, profile WHERE t3 AND doc_id IN (SELECT doc_id FROM d) GROUP BY ALL
  UNION ALL SELECT doc_id, profile_id, CASE part WHEN 'image' THEN 5 WHEN 'vector' THEN 6 ELSE 8 END, part || '-rgb', 'warn', pages FROM parts, profile WHERE part IN ('image', 'vector', 'blend') AND NOT rgb_ok
  UNION ALL SELECT doc_id, profile_id, 9, 'colour-rgb', 'info', pages FROM any_rgb, profile WHERE rgb_ok
  UNION ALL SELECT doc_id, profile_id, 10, 'colour-lab', 'warn', pages FROM parts, profile WHERE part = 'lab'
  UNION ALL SELECT doc_id, profile_id, 11, 'colour', 'pass', 0 FROM d, profile WHERE doc_id NOT IN (SELECT doc_id FROM any_rgb) AND doc_id NOT IN (SELECT doc_id FROM parts WHERE part = 'lab')
  UNION ALL SELECT doc_id, profile_id, 12, 'images', 'info', 0 FROM d, profile WHERE doc_id NOT IN (SELECT doc_id FROM placed)
  UNION ALL SELECT doc_id, profile_id, 13, 'spot', CASE WHEN spot_ok THEN 'info' ELSE 'warn' END, pages FROM parts, profile WHERE part = 'spot'
  UNION ALL SELECT doc_id, profile_id, 15, 'total-ink', CASE WHEN pages > 0 THEN 'warn' ELSE 'pass' END, pages FROM ink
  UNION ALL SELECT doc_id, profile_id, 16, 'overprint', 'info', count(*) FROM page, profile WHERE overprint GROUP BY ALL
  UNION ALL SELECT doc_id, profile_id, 17, 'image-ppi', CASE WHEN n > 0 THEN 'warn' ELSE 'pass' END, pages FROM low
  UNION ALL SELECT doc_id, profile_id, 18, 'pdfx', 'info', 0 FROM d, profile
  UNION ALL SELECT doc_id, profile_id, 19, 'unreadable', 'info', count(*) FROM page, profile WHERE unreadable GROUP BY ALL
)
SELECT f.doc_id, f.profile_id, f.id, f.level, f.n::INT AS n, CASE WHEN f.id = 'image-ppi' AND f.level = 'warn' THEN worst.page END::INT AS worst_page, CASE WHEN f.id = 'image-ppi' AND f.level = 'warn' THEN floor(worst.ppi + 0.5) END::INT AS worst_ppi,
  row_number() OVER (PARTITION BY f.doc_id, f.profile_id ORDER BY CASE f.level WHEN 'error' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, f.ord)::INT AS place
FROM found f LEFT JOIN worst USING (doc_id)
"""


@query(FINDINGS)
def preflight_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over 25 documents under two profiles, by severity."""
    found = preflight.evaluate(facts(spark, sf_dir), preflight.profile_table(spark, PROFILES))
    return found.select("doc_id", "profile_id", "id", "level", F.col("count").alias("n"), "worst_page", "worst_ppi", "place")


@query(f"""
WITH {PAGES}, hit AS (
  SELECT doc_id, page, 'rgb' AS what FROM placed WHERE family = 'RGB' AND NOT mask UNION SELECT doc_id, page, kind FROM paint WHERE kind IN ('rgb', 'spot') UNION SELECT doc_id, page, 'rgb' FROM page WHERE rgb_blend UNION SELECT doc_id, page, 'overprint' FROM page WHERE overprint
)
SELECT doc_id, page, bool_or(coalesce(what = 'rgb', false)) AS rgb, bool_or(coalesce(what = 'spot', false)) AS spot, false AS reg, bool_or(coalesce(what = 'overprint', false)) AS overprint FROM page LEFT JOIN hit USING (doc_id, page) GROUP BY ALL
""")
def preflight_page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page has: RGB, spot colours, registration, overprint."""
    return preflight.page_flags(facts(spark, sf_dir))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN greatest(0.0::DOUBLE, least(x - ox, y - oy, ow - x - w, oh - y - h)) END AS bleed_pt FROM (
  SELECT c_custkey, c_custkey % 7 + 0.5::DOUBLE AS x, c_custkey % 4 * 4.0::DOUBLE AS y, 280.0::DOUBLE AS w, 180.0::DOUBLE AS h, CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0 END AS ox, CASE WHEN c_custkey % 3 = 0 THEN 2.0::DOUBLE ELSE 0 END AS oy, 300.0::DOUBLE AS ow, 205.0::DOUBLE AS oh FROM customer)
""".replace("ow - x - w, oh - y - h", "ox + ow - x - w, oy + oh - y - h"))
def page_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far pages go past their trim, by the bleed box, else the media box."""
    k = F.col("c_custkey")
    box = lambda x, y, w, h: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    bleed = F.when(k % 3 == 0, box(F.lit(1.0), F.lit(2.0), 300.0, 205.0))
    pages = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 != 0, box(k % 7 + 0.5, k % 4 * 4.0, 280.0, 180.0)).alias("trim"), bleed.alias("bleed"), box(F.lit(0.0), F.lit(0.0), 300.0, 205.0).alias("media"))
    return preflight.bleed_of(pages).select("c_custkey", "bleed_pt")


@query("""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '-3' WHEN 2 THEN 'x' WHEN 3 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE '2.5' END AS ppi, CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS rgb FROM orders)
SELECT o_orderkey, CASE WHEN ppi = '' THEN 0.0 WHEN try_cast(ppi AS DOUBLE) >= 0 THEN try_cast(ppi AS DOUBLE) ELSE 300.0 END::DOUBLE AS min_ppi, coalesce(rgb = 'true', false) AS allow_rgb, 3.0::DOUBLE AS bleed_mm FROM v
""")
def profile_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles given as JSON, each setting kept if it is sound."""
    k = F.col("o_orderkey")
    ppi = F.when(k % 5 == 0, "").when(k % 5 == 1, "-3").when(k % 5 == 2, "x").when(k % 5 == 3, F.floor("o_totalprice").cast("string")).otherwise("2.5")
    rgb = F.when(k % 3 == 0, "true").when(k % 3 == 1, "false")
    given = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(ppi.alias("minPpi"), rgb.alias("allowRgb"))).alias("json"))
    return preflight.sanitise(given).select("o_orderkey", "min_ppi", "allow_rgb", "bleed_mm")


# ------------------------------------------------------------------ layouts
FRAMES = """
frame AS (
  SELECT o_custkey % 20 AS doc_id, o_orderkey AS item_id, o_custkey AS story_id, CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey + 1 END AS next, o_orderkey % 3 + 1 AS columns, o_orderkey % 7 <> 0 AS axis_rect, o_orderkey % 5 AS turn, o_orderkey % 11 = 0 AS hidden,
    CASE WHEN o_orderkey % 4 = 0 THEN 'JustifyAlign' ELSE 'TopAlign' END AS vj, CASE WHEN o_orderkey % 13 = 0 THEN 'HeightOnly' ELSE 'Off' END AS auto_size, CASE WHEN o_orderkey % 10 <> 0 THEN 1 END AS page
  FROM orders
),
story AS (SELECT c_custkey % 20 AS doc_id, c_custkey AS story_id, CASE WHEN c_custkey % 8 = 0 THEN 1 ELSE 0 END AS tables, CASE WHEN c_custkey % 9 = 0 THEN 1 ELSE 0 END AS footnotes, CASE WHEN c_custkey % 14 = 0 THEN 2 ELSE 0 END AS anchored, CASE WHEN c_custkey % 15 = 0 THEN ' ' ELSE c_comment END AS text FROM (SELECT *, c_name AS c_comment FROM customer) WHERE c_custkey % 25 <> 0)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    turn = F.when(k % 5 == 0, F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 5.0, 5.0)))).when(k % 5 == 1, F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 0.0, 0.0)))).when(k % 5 == 2, F.array(*map(F.lit, (2.0, 0.0, 0.0, 1.0, 0.0, 0.0)))).when(k % 5 == 3, F.array(*map(F.lit, (-1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.5, 1.0, 0.0, 0.0))))
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).cast("string").alias("doc_id"), k.cast("string").alias("item_id"), F.col("o_custkey").cast("string").alias("story_id"), F.when(k % 6 == 0, (k + 1).cast("string")).alias("next"), F.lit(None).cast("string").alias("prev"), (k % 3 + 1).alias("columns"), (k % 7 != 0).alias("axis_rect"),
        turn.alias("world"), (k % 11 == 0).alias("hidden"), F.when(k % 4 == 0, "JustifyAlign").otherwise("TopAlign").alias("vj"), F.when(k % 13 == 0, "HeightOnly").otherwise("Off").alias("auto_size"), F.when(k % 10 != 0, 1).alias("page"), F.when(k % 17 == 0, F.array(F.lit(0.0), F.lit(3.0))).alias("inset"), F.when(k % 19 == 0, "g").alias("parent_id"),
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda n, v=1: F.when(k % n == 0, v).otherwise(0)
    return table(spark, sf_dir, "customer").where("c_custkey % 25 <> 0").select((k % 20).cast("string").alias("doc_id"), k.cast("string").alias("story_id"), some(8).alias("tables"), some(9).alias("footnotes"), some(14, 2).alias("anchored"), some(6).alias("specials"), some(7).alias("line_breaks"), (k % 4).alias("paragraphs"), F.when(k % 15 == 0, " ").otherwise(F.col("c_name")).alias("text"))


REASONS = [("s.story_id IS NULL", "story not found"), ("s.tables > 0", "table in story"), ("s.footnotes > 0", "footnotes in story"), ("s.anchored > 0", "anchored objects in story"), ("next IS NOT NULL", "threaded text"), ("columns > 1", "multiple columns"), ("NOT axis_rect", "non-rectangular frame"), ("turn IN (2, 3, 4)", "scaled, skewed or mirrored"), ("vj = 'JustifyAlign'", "vertically justified"), ("auto_size <> 'Off'", "auto-sizing frame")]
LISTED = ", ".join(f"CASE WHEN {c} THEN '{w}' END" for c, w in REASONS)


@query(f"""
WITH {FRAMES}
SELECT item_id::VARCHAR AS item_id, CASE WHEN s.story_id IS NULL OR s.tables > 0 OR s.footnotes > 0 OR s.anchored > 0 THEN 'unsupported' WHEN next IS NOT NULL OR columns > 1 OR NOT axis_rect OR turn IN (2, 3, 4) OR vj = 'JustifyAlign' OR auto_size <> 'Off' THEN 'approx' ELSE 'full' END AS level,
  array_to_string(list_filter([{LISTED}], lambda x: x IS NOT NULL), '; ') AS reasons
FROM frame LEFT JOIN story s USING (doc_id, story_id)
""")
def frame_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each text frame can be shown as, and why not in full."""
    out = structure.frame_support(frames(spark, sf_dir), stories(spark, sf_dir))
    return out.select("item_id", "level", F.array_join("reasons", "; ").alias("reasons"))


@query(f"""
WITH {FRAMES}
SELECT frame.doc_id::VARCHAR AS doc_id, count(*) AS total, count(page) AS on_pages, count(*) - count(page) AS off_page, count(*) FILTER (WHERE hidden) AS hidden, count(next) AS threaded, count(*) FILTER (WHERE NOT axis_rect) AS non_rect, count(*) FILTER (WHERE columns > 1) AS multi_column,
  count(*) FILTER (WHERE item_id % 17 = 0) AS inset, count(*) FILTER (WHERE auto_size <> 'Off') AS auto_sizing, count(*) FILTER (WHERE turn IN (2, 3, 4)) AS scaled, count(*) FILTER (WHERE item_id % 19 = 0) AS in_group, count(*) FILTER (WHERE trim(text) = '') AS empty
FROM frame LEFT JOIN story USING (doc_id, story_id) GROUP BY ALL
""")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.frame_stats(frames(spark, sf_dir), stories(spark, sf_dir))


@query(f"WITH {FRAMES} SELECT doc_id::VARCHAR AS doc_id, CASE turn WHEN 1 THEN '90' WHEN 3 THEN '180' ELSE '0' END AS bucket, count(*) AS frames FROM frame GROUP BY ALL")
def frame_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.rotations(frames(spark, sf_dir))


@query(f"""
WITH {FRAMES}, orphan AS (SELECT story_id FROM story WHERE story_id NOT IN (SELECT story_id FROM frame WHERE next IS NOT NULL))
SELECT doc_id::VARCHAR AS doc_id, count(*) AS total, count(orphan.story_id) AS orphan, count(*) FILTER (WHERE trim(text) = '') AS empty, count(*) FILTER (WHERE tables > 0) AS with_tables, count(*) FILTER (WHERE footnotes > 0) AS with_footnotes, count(*) FILTER (WHERE anchored > 0) AS with_anchored,
  count(*) FILTER (WHERE story_id % 6 = 0) AS with_specials, count(*) FILTER (WHERE story_id % 7 = 0) AS with_line_breaks, sum(story_id % 4)::BIGINT AS paragraphs
FROM story LEFT JOIN orphan USING (story_id) GROUP BY doc_id
""")
def story_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories by what they hold, and those that no threaded frame refers to."""
    s = stories(spark, sf_dir)
    lost = joins.unreferenced(s, frames(spark, sf_dir).where("next is not null"), [("doc_id", "doc_id"), ("story_id", "story_id")])
    return structure.story_stats(s, lost)


@query("""
WITH p AS (SELECT p_brand AS doc_id, (p_partkey % 50)::VARCHAR AS spread_id, p_partkey FROM part WHERE p_size > 5),
s AS (SELECT doc_id, spread_id, count(*) AS pages FROM p GROUP BY ALL)
SELECT doc_id, pages, count(*) AS spreads FROM s GROUP BY ALL
""")
def spread_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), (F.col("p_partkey") % 50).cast("string").alias("spread_id"), (F.col("p_size") <= 5).alias("is_master"))
    return structure.spread_sizes(p)


@query("""
WITH i AS (SELECT p_brand AS doc_id, p_partkey, CASE p_size % 4 WHEN 0 THEN 'TextFrame' WHEN 1 THEN 'Group' ELSE 'Rectangle' END AS kind, p_size % 5 AS linked, p_size % 2 AS embedded, CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END AS text_paths FROM part)
SELECT doc_id, count(*) AS shapes, sum(linked + embedded)::BIGINT AS placed, sum(linked)::BIGINT AS linked, sum(embedded)::BIGINT AS embedded, sum(text_paths)::BIGINT AS text_paths FROM i WHERE kind = 'Rectangle' GROUP BY ALL
""")
def art_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes and what is placed in them."""
    s = F.col("p_size")
    kind = F.when(s % 4 == 0, "TextFrame").when(s % 4 == 1, "Group").otherwise("Rectangle")
    n = (s % 5 + s % 2).cast("int")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), kind.alias("kind"), (s % 5).alias("linked"), (s % 2).alias("embedded"), F.when(s % 7 == 0, 1).otherwise(0).alias("text_paths"), F.array_repeat(F.lit("Image:x"), n).alias("placed"))
    return structure.art_stats(p)


RUNS = """
run AS (
  SELECT l_suppkey % 10 AS doc_id, CASE l_linenumber WHEN 1 THEN 'Arial (TT)' WHEN 2 THEN 'Arial' ELSE 'Font ' || l_linenumber END AS font, CASE WHEN l_quantity < 20 THEN 'Bold' END AS font_style, l_quantity > 30 AS own_font, l_quantity > 45 AS own_style, l_quantity::INT AS n, CASE WHEN l_discount > 0.05 THEN 'ParagraphStyle/$ID/NormalParagraphStyle' ELSE 'ParagraphStyle/Body' END AS para_style
  FROM lineitem
)
"""


def effective(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs with the fields in effect, as structure.effective_runs gives them."""
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    font = F.when(line == 1, "Arial (TT)").when(line == 2, "Arial").otherwise(F.concat(F.lit("Font "), line.cast("string")))
    e = F.struct(font.alias("font"), F.when(q < 20, "Bold").alias("font_style"))
    para = F.when(F.col("l_discount") > 0.05, structure.NORMAL).otherwise("ParagraphStyle/Body")
    return table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("string").alias("doc_id"), e.alias("e"), F.when(q > 30, font).alias("c_font"), F.when(q > 45, "Bold").alias("c_font_style"), q.cast("int").alias("n"), para.alias("para_style"))


@query(f"""
WITH {RUNS}, known AS (SELECT s_suppkey % 10 AS doc_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Arial' ELSE 'Font ' || (s_suppkey % 5 + 3) END AS family, CASE WHEN s_suppkey % 3 = 0 THEN 'bold' ELSE 'regular' END AS style, s_suppkey % 3 + 1 AS worth FROM supplier),
worst AS (SELECT doc_id, family, style, max(worth) AS worth FROM known GROUP BY ALL),
used AS (SELECT doc_id, regexp_replace(font, ' \\(TT\\)$', '') AS family, coalesce(font_style, 'Regular') AS style, sum(n) AS chars, sum(CASE WHEN own_font THEN 0 ELSE n END) AS via_style, sum(CASE WHEN own_font THEN n ELSE 0 END) AS via_override FROM run GROUP BY ALL)
SELECT u.doc_id::VARCHAR AS doc_id, u.family, u.style, chars::BIGINT AS chars, via_style::BIGINT AS via_style, via_override::BIGINT AS via_override, CASE worth WHEN 1 THEN 'Installed' WHEN 2 THEN 'Substituted' WHEN 3 THEN 'NotAvailable' END AS status
FROM used u LEFT JOIN worst w ON w.doc_id = u.doc_id AND w.family = u.family AND w.style = lower(u.style)
""")
def layout_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each font, how they were set, and the worst status of the font."""
    k = F.col("s_suppkey")
    status = F.when(k % 3 == 0, "Installed").when(k % 3 == 1, "Substituted").otherwise("NotAvailable")
    known = table(spark, sf_dir, "supplier").select((k % 10).cast("string").alias("doc_id"), F.when(k % 2 == 0, "Arial").otherwise(F.concat(F.lit("Font "), (k % 5 + 3).cast("string"))).alias("family"), F.when(k % 3 == 0, "Bold").otherwise("Regular").alias("style"), status.alias("status"))
    return structure.font_usage(effective(spark, sf_dir), known)


@query(f"""
WITH {RUNS} SELECT doc_id::VARCHAR AS doc_id, sum(n)::BIGINT AS chars, sum(CASE WHEN own_font THEN n ELSE 0 END)::BIGINT AS run_font_chars, sum(CASE WHEN own_style THEN n ELSE 0 END)::BIGINT AS run_style_chars, sum(CASE WHEN para_style LIKE '%NormalParagraphStyle' THEN n ELSE 0 END)::BIGINT AS default_style_chars FROM run GROUP BY ALL
""")
def text_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.text_totals(effective(spark, sf_dir))


@query("""
WITH s AS (SELECT p_partkey AS id, p_brand AS doc_id, CASE WHEN p_partkey % 4 = 3 THEN 'tint' ELSE 'color' END AS type, CASE p_partkey % 10 WHEN 0 THEN 'Registration' WHEN 1 THEN 'Spot' ELSE 'Process' END AS model, [p_size, p_size % 7 * 10, 0, p_size % 2 * 50]::DOUBLE[] AS v, p_size * 2.0::DOUBLE AS tint FROM part),
c AS (SELECT *, len(list_filter(v, lambda x: x >= 0.5)) AS used FROM s WHERE type = 'color'),
flat AS (SELECT doc_id, id, CASE model WHEN 'Registration' THEN 'registration' WHEN 'Spot' THEN 'spot' ELSE 'process' END AS kind, CASE model WHEN 'Registration' THEN 4 WHEN 'Spot' THEN 1 ELSE used END AS inks, model <> 'Registration' AND used = 0 AS reversed, CASE WHEN model <> 'Registration' THEN v END AS cmyk FROM c),
t AS (SELECT s.doc_id, s.id, b.id AS base, b.kind, b.inks, b.reversed, b.cmyk, len(list_filter(list_transform(b.cmyk, lambda x: x * s.tint / 100), lambda x: x >= 0.5)) AS used FROM s LEFT JOIN flat b ON b.doc_id = s.doc_id AND b.id = s.id - 1 WHERE s.type = 'tint')
SELECT doc_id, id::VARCHAR AS id, kind, inks::INT AS inks, reversed FROM flat
UNION ALL SELECT doc_id, id::VARCHAR, CASE WHEN base IS NULL THEN 'unknown' WHEN cmyk IS NULL THEN kind ELSE 'tint' END, CASE WHEN base IS NULL THEN NULL WHEN cmyk IS NULL THEN inks ELSE used END::INT, CASE WHEN base IS NULL THEN false WHEN cmyk IS NULL THEN reversed ELSE used = 0 END FROM t
""")
def swatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swatches resolved, tints by what they refer to."""
    k, s = F.col("p_partkey"), F.col("p_size")
    value = F.array(*[c.cast("double") for c in (s, s % 7 * 10, F.lit(0), s % 2 * 50)])
    sw = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("doc_id"), k.cast("string").alias("id"), F.when(k % 4 == 3, "tint").otherwise("color").alias("type"), F.col("p_name").alias("name"), F.lit("CMYK").alias("space"),
        F.when(k % 10 == 0, "Registration").when(k % 10 == 1, "Spot").otherwise("Process").alias("model"), value.alias("value"), (k - 1).cast("string").alias("base"), (s * 2.0).alias("tint"), F.lit(None).cast("array<string>").alias("stops"),
    )
    return hierarchy.resolve_swatches(sw, ["doc_id"]).select("doc_id", "id", "kind", "inks", "reversed")


@query("""
WITH c AS (SELECT DISTINCT l_quantity * 2 AS c, l_linenumber * 5.0 AS m FROM lineitem), s AS (SELECT DISTINCT (p_size * 2.0)::DOUBLE AS c, (p_size % 9 * 5.0)::DOUBLE AS m FROM part WHERE p_size % 3 = 0)
SELECT c.c AS c, c.m AS m, CASE WHEN bool_or(abs(c.c - s.c) <= 0.6 AND abs(c.m - s.m) <= 0.6) THEN 'exact' WHEN bool_or(c.c / s.c < 1.001 AND c.c > 0 AND abs(s.m * (c.c / s.c) - c.m) <= 0.8) THEN 'tint' ELSE 'other' END AS match FROM c, s GROUP BY ALL
""")
def swatch_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours that are a swatch, or a tint of one."""
    c = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 2).alias("c"), (F.col("l_linenumber") * 5.0).alias("m")).distinct().withColumn("key", F.struct("c", "m"))
    s = table(spark, sf_dir, "part").where("p_size % 3 = 0").select((F.col("p_size") * 2.0).alias("c"), (F.col("p_size") % 9 * 5.0).alias("m")).distinct()
    return joins.swatch_match(c, s, ["c", "m"], key="key").select("c", "m", "match")


# ------------------------------------------------------------------ fonts and words
NAMES = ["Arial", "Helvetica Neue", "Times New Roman", "Futura", "Garamond", "Inter", "Montserrat", "Impact", "Unheard Of", "Rockwell Std"]
ENDS = ["", " Bold", " Bold Italic", "-Light", " MT"]


def family_sql() -> str:
    rows = [(n, r, slug) for names, slugs in alternatives.STAND_INS for n in names for r, slug in enumerate(slugs)] + [(f, -1, slug) for slug, (f, _, _) in alternatives.FAMILIES.items()]
    return ", ".join(f"('{n.lower().replace(' ', '')}', {r}, '{slug}')" for n, r, slug in rows)


@query(f"""
WITH RECURSIVE fam(slug, family, b, i) AS (VALUES {", ".join(f"('{s}', '{f}', {b}, {i})" for s, (f, b, i) in alternatives.FAMILIES.items())}), known(alias, rank, slug) AS (VALUES {family_sql()}),
n AS (SELECT DISTINCT {NAMES}[(p_partkey % 10 + 1)::INT] || {ENDS}[(p_size % 5 + 1)::INT] AS name FROM part), k AS (SELECT name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS raw FROM n),
f AS (SELECT name, raw, raw AS base, 0 AS cut FROM k UNION ALL SELECT name, raw, regexp_replace(base, '(?:{alternatives.SUFFIXES})$', ''), cut + 1 FROM f WHERE regexp_matches(base, '(?:{alternatives.SUFFIXES})$')),
m AS (SELECT name, raw, base, slug, cut, min(rank) AS rank FROM f JOIN known ON alias = base GROUP BY ALL), g AS (SELECT *, min(cut) OVER (PARTITION BY name) AS least FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank) AS place, substr(raw, length(base) + 1) AS style FROM g WHERE cut = least)
SELECT name, place::INT AS place, family, fam.slug, CASE WHEN regexp_matches(style, 'bold|black|heavy|demi') AND b THEN 700 ELSE 400 END AS weight, CASE WHEN regexp_matches(style, 'italic|oblique') AND i THEN 'italic' ELSE 'normal' END AS slant, rank < 0 AS exact,
  (regexp_matches(style, 'bold|black|heavy|demi') AND NOT b) OR (regexp_matches(style, 'italic|oblique') AND NOT i) AS different_style FROM p JOIN fam USING (slug) WHERE place <= 3
""")
def font_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free fonts to use instead of named ones."""
    pick = lambda of, at: F.element_at(F.array(*map(F.lit, of)), (at + 1).cast("int"))
    names = table(spark, sf_dir, "part").select(F.concat(pick(NAMES, F.col("p_partkey") % 10), pick(ENDS, F.col("p_size") % 5)).alias("name"))
    return alternatives.alternatives(names)


@query("""
WITH r AS (SELECT o_custkey % 30 AS doc_id, o_clerk_key AS font_key, o_orderkey % 12 AS page, floor(sqrt((l_quantity * l_quantity)::DOUBLE) * 10 + 0.5) / 10 AS size FROM (SELECT *, o_orderkey % 4 AS o_clerk_key FROM orders) JOIN lineitem ON l_orderkey = o_orderkey)
SELECT doc_id::VARCHAR AS doc_id, font_key::VARCHAR AS font_key, count(*) AS items, count(DISTINCT page) AS pages, array_to_string(list_transform(list_sort(list(DISTINCT size))[1:12], lambda s: s::DOUBLE::VARCHAR), ', ') || CASE WHEN count(DISTINCT size) > 12 THEN '…' ELSE '' END || ' pt' AS sizes FROM r GROUP BY ALL
""")
def pdf_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, pages and sizes of each font of a document's text."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    q, zero = F.col("l_quantity"), F.lit(0.0)
    runs = o.select((F.col("o_custkey") % 30).cast("string").alias("doc_id"), (F.col("o_orderkey") % 12).alias("page"), F.col("l_linenumber").alias("seq"), (F.col("o_orderkey") % 4).cast("string").alias("font_key"), F.array(q, zero, zero, q, zero, zero).alias("transform"))
    return typography.font_runs(runs).select("doc_id", "font_key", "items", "pages", typography.size_label(F.col("sizes")).alias("sizes"))


@query(r"SELECT doc_id, len(w)::INT AS n, md5(array_to_string(w, ' ')) AS words FROM (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents)")
def plain_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words of each whole text and a digest of them, in lower case and without accents."""
    found = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w"))
    return found.select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("words"))


@query("SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1)::INT AS index FROM orders")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered in their groups, from 0."""
    return ordered.ordinals(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
WITH o AS (SELECT o_custkey AS g, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) END AS named, o_orderkey % 97 AS own FROM orders),
a AS (SELECT *, count(named) OVER (PARTITION BY g) = count(*) OVER (PARTITION BY g) AS agree FROM o)
SELECT g, k, (row_number() OVER (PARTITION BY g ORDER BY CASE WHEN NOT agree THEN own END NULLS FIRST, CASE WHEN agree THEN named END NULLS LAST, k) - 1)::INT AS ord FROM a
""")
def manifest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest's order where it names all rows of a group, else the rows' own."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 97).alias("own"), "o_orderstatus", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("named"))
    return joins.restore_order(o.select("g", "k", "own"), o.where("o_orderstatus = 'F'").select("g", "k", "named"), ["g"], "k", "named", own="own").select("g", "k", "ord")
