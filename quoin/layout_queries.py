"""Registered queries of nested layouts, styles and swatches: trees are drawn from the
numbers of parts (five children to a group, groups of one remainder in one document)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.operators import hierarchy
from quoin.plans import fontmap
from quoin.queries import query, table

#: Part k hangs under (k // 25) * 5 + k % 5, in the document of its remainder; the first 25 are roots.
TREE = "SELECT p_partkey AS k, (p_partkey % 5)::VARCHAR AS doc_id, CASE WHEN p_partkey >= 25 THEN p_partkey // 25 * 5 + p_partkey % 5 END AS up, * FROM part"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    up = F.when(k >= 25, F.expr("p_partkey div 25 * 5 + p_partkey % 5"))
    return table(spark, sf_dir, "part").select(k.alias("k"), (k % 5).cast("string").alias("doc_id"), up.alias("up"), "*")


@query(f"""
WITH RECURSIVE i AS (
  SELECT k, doc_id, CASE WHEN up IN (SELECT p_partkey FROM part) THEN up END AS up, CASE WHEN k % 3 = 0 THEN 'layer ' || k % 6 END AS layer, k % 13 = 0 AS hidden,
    CASE k % 4 WHEN 0 THEN [1, 0, 0, 1, k % 7, k % 11] WHEN 1 THEN [0, 1, -1, 0, k % 7, k % 11] WHEN 2 THEN [-1, 0, 0, 2, k % 7, k % 11] ELSE [1, 0, 0.5, 1, k % 7, k % 11] END::DOUBLE[] AS m
  FROM ({TREE})
),
w AS (
  SELECT k, doc_id, layer, hidden, m FROM i WHERE up IS NULL
  UNION ALL SELECT i.k, i.doc_id, coalesce(i.layer, w.layer), i.hidden OR w.hidden,
    [w.m[1] * i.m[1] + w.m[3] * i.m[2], w.m[2] * i.m[1] + w.m[4] * i.m[2], w.m[1] * i.m[3] + w.m[3] * i.m[4], w.m[2] * i.m[3] + w.m[4] * i.m[4], w.m[1] * i.m[5] + w.m[3] * i.m[6] + w.m[5], w.m[2] * i.m[5] + w.m[4] * i.m[6] + w.m[6]]
  FROM i JOIN w ON i.up = w.k AND i.doc_id = w.doc_id
)
SELECT k, doc_id, layer, hidden, m[1] + 0 AS a, m[2] + 0 AS b, m[3] + 0 AS c, m[4] + 0 AS d, m[5] + 0 AS e, m[6] + 0 AS f FROM w
""")
def group_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map from each item of nested groups to its spread, its layer, and whether it is hidden."""
    rows, k = tree(spark, sf_dir), F.col("k")
    linear = F.when(k % 4 == 0, F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0)))).when(k % 4 == 1, F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0)))).when(k % 4 == 2, F.array(*map(F.lit, (-1.0, 0.0, 0.0, 2.0)))).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.5, 1.0))))
    items = rows.select("doc_id", "k", "up", F.concat(linear, F.array((k % 7).cast("double"), (k % 11).cast("double"))).alias("m"), F.when(k % 3 == 0, F.concat(F.lit("layer "), (k % 6).cast("string"))).alias("layer"), (k % 13 == 0).alias("hidden"))
    found = hierarchy.world_maps(items, ["doc_id"], key="k", parent="up", own="m", nearest=("layer",), any_of=("hidden",))
    return found.select("k", "doc_id", "layer", "hidden", *[(F.col("m")[i] + F.lit(0.0)).alias(c) for i, c in enumerate("abcdef")])


@query("""
WITH s AS (SELECT p_partkey AS id, (p_partkey // 8 % 100)::VARCHAR AS doc_id, p_partkey % 8 AS r, [p_size, p_size % 7 * 10, 0, p_size % 2 * 50]::DOUBLE[] AS v, p_size * 2.0::DOUBLE AS share, p_partkey % 10 AS model FROM part),
c AS (SELECT doc_id, id, CASE model WHEN 0 THEN 'registration' WHEN 1 THEN 'spot' ELSE 'process' END AS kind, CASE model WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE len(list_filter(v, lambda x: x >= 0.5)) END AS inks, model <> 0 AND len(list_filter(v, lambda x: x >= 0.5)) = 0 AS back, CASE WHEN model <> 0 THEN v END AS cmyk FROM s WHERE r < 4),
t4 AS (SELECT s.doc_id, s.id, CASE WHEN c.id IS NULL THEN 'unknown' WHEN cmyk IS NULL THEN kind ELSE 'tint' END AS kind, inks AS base_inks, back AS base_back, list_transform(cmyk, lambda x: x * (share / 100)) AS cmyk FROM s LEFT JOIN c ON c.id = s.id - 1 WHERE r = 4),
d4 AS (SELECT doc_id, id, kind, CASE WHEN cmyk IS NULL THEN base_inks ELSE len(list_filter(cmyk, lambda x: x >= 0.5)) END AS inks, CASE WHEN cmyk IS NULL THEN coalesce(base_back, false) ELSE len(list_filter(cmyk, lambda x: x >= 0.5)) = 0 END AS back, cmyk FROM t4),
t5 AS (SELECT s.doc_id, s.id, CASE WHEN d4.id IS NULL THEN 'unknown' WHEN cmyk IS NULL THEN kind ELSE 'tint' END AS kind, inks AS base_inks, back AS base_back, list_transform(cmyk, lambda x: x * (share / 100)) AS cmyk FROM s LEFT JOIN d4 ON d4.id = s.id - 1 WHERE r = 5),
d5 AS (SELECT doc_id, id, kind, CASE WHEN cmyk IS NULL THEN base_inks ELSE len(list_filter(cmyk, lambda x: x >= 0.5)) END AS inks, CASE WHEN cmyk IS NULL THEN coalesce(base_back, false) ELSE len(list_filter(cmyk, lambda x: x >= 0.5)) = 0 END AS back, cmyk FROM t5),
g6 AS (SELECT s.doc_id, s.id, 'gradient' AS kind, greatest(0, coalesce(d5.inks, 0), coalesce(c.inks, 0)) AS inks, false AS back, NULL::DOUBLE[] AS cmyk FROM s LEFT JOIN d5 ON d5.id = s.id - 1 LEFT JOIN c ON c.id = s.id - 3 WHERE r = 6),
t7 AS (SELECT s.doc_id, s.id, coalesce(kind, 'unknown') AS kind, inks, coalesce(back, false) AS back, NULL::DOUBLE[] AS cmyk FROM s LEFT JOIN g6 ON g6.id = s.id - 1 WHERE r = 7),
u AS (SELECT * FROM c UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM g6 UNION ALL SELECT * FROM t7)
SELECT doc_id, id::VARCHAR AS id, kind, inks::INT AS inks, back AS reversed, cmyk[1] AS cyan FROM u
""")
def swatch_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Swatches that refer to swatches: tints of tints, gradients of these, tints of gradients."""
    k, s, kind = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 8
    id_ = lambda n: (k - n).cast("string")
    value = F.array(*[c.cast("double") for c in (s, s % 7 * 10, F.lit(0), s % 2 * 50)])
    rows = table(spark, sf_dir, "part").select(
        F.expr("cast(p_partkey div 8 % 100 as string)").alias("doc_id"), k.cast("string").alias("id"), F.when(kind < 4, "color").when(kind == 6, "gradient").otherwise("tint").alias("type"), F.col("p_name").alias("name"), F.lit("CMYK").alias("space"),
        F.when(k % 10 == 0, "Registration").when(k % 10 == 1, "Spot").otherwise("Process").alias("model"), value.alias("value"), id_(1).alias("base"), (s * 2.0).alias("tint"), F.array(id_(1), id_(3), F.lit("not there"), F.lit("Swatch/None")).alias("stops"),
    )
    return hierarchy.resolve_swatches(rows, ["doc_id"]).select("doc_id", "id", "kind", "inks", "reversed", F.get("cmyk", F.lit(0)).alias("cyan"))


#: Styles from the roots down: what they showed, what they shall show, what they must set, and what they show then.
STYLES = f"""
WITH RECURSIVE i AS (
  SELECT k, doc_id, CASE WHEN up IN (SELECT p_partkey FROM part) THEN up END AS up, CASE WHEN k % 4 = 1 OR k < 10 THEN 'Face ' || k % 3 END AS font, CASE k % 6 WHEN 0 THEN 'Bold' WHEN 1 THEN 'Regular' END AS style FROM ({TREE})
),
goal(key, family, weight) AS (VALUES ('face 0|regular', 'New 0', 'Light'), ('face 1|bold', 'New 1', 'Bold')),
w AS (
  SELECT k, doc_id, was_font, was_style, want_font, want_style, CASE WHEN takes OR pinned THEN want_font ELSE font END AS new_font, CASE WHEN takes OR pinned THEN want_style ELSE style END AS new_style,
    CASE WHEN takes OR pinned THEN want_font ELSE got_font END AS end_font, CASE WHEN takes OR pinned THEN want_style ELSE got_style END AS end_style
  FROM (
    SELECT *, NOT takes AND was_font IS NOT NULL AND (got_font IS DISTINCT FROM want_font OR coalesce(got_style, 'Regular') <> want_style) AS pinned
    FROM (
      SELECT e.*, coalesce(family, was_font) AS want_font, coalesce(weight, was_style, 'Regular') AS want_style, family IS NOT NULL AND (font IS NOT NULL OR style IS NOT NULL) AS takes
      FROM (SELECT i.*, font AS was_font, style AS was_style, font AS got_font, style AS got_style FROM i WHERE up IS NULL) e LEFT JOIN goal ON key = lower(was_font) || '|' || lower(coalesce(was_style, 'Regular'))
    )
  )
  UNION ALL
  SELECT k, doc_id, was_font, was_style, want_font, want_style, CASE WHEN takes OR pinned THEN want_font ELSE font END AS new_font, CASE WHEN takes OR pinned THEN want_style ELSE style END AS new_style,
    CASE WHEN takes OR pinned THEN want_font ELSE got_font END AS end_font, CASE WHEN takes OR pinned THEN want_style ELSE got_style END AS end_style
  FROM (
    SELECT *, NOT takes AND was_font IS NOT NULL AND (got_font IS DISTINCT FROM want_font OR coalesce(got_style, 'Regular') <> want_style) AS pinned
    FROM (
      SELECT e.*, coalesce(family, was_font) AS want_font, coalesce(weight, was_style, 'Regular') AS want_style, family IS NOT NULL AND (font IS NOT NULL OR style IS NOT NULL) AS takes
      FROM (SELECT i.*, coalesce(i.font, o.was_font) AS was_font, coalesce(i.style, o.was_style) AS was_style, coalesce(i.font, o.end_font) AS got_font, coalesce(i.style, o.end_style) AS got_style FROM i JOIN w o ON i.up = o.k AND i.doc_id = o.doc_id) e LEFT JOIN goal ON key = lower(was_font) || '|' || lower(coalesce(was_style, 'Regular'))
    )
  )
)
"""


def styles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(character styles in trees, font map of their documents)"""
    rows, k = tree(spark, sf_dir), F.col("k")
    own = {"font": F.when((k % 4 == 1) | (k < 10), F.concat(F.lit("Face "), (k % 3).cast("string"))), "font_style": F.when(k % 6 == 0, "Bold").when(k % 6 == 1, "Regular")}
    none = {f: F.lit(None).cast("string") for f in hierarchy.FIELDS if f not in own}
    style = rows.select("doc_id", F.lit("char").alias("kind"), F.concat(F.lit("CharacterStyle/"), k.cast("string")).alias("self"), F.concat(F.lit("CharacterStyle/"), F.col("up").cast("string")).alias("based_on"), *[c.alias(f) for f, c in (own | none).items()])
    entries = [(str(d), f, s, to, w) for d in range(5) for f, s, to, w in (("Face 0", "Regular", "New 0", "Light"), ("Face 1", "Bold", "New 1", None))]
    return style, fontmap.font_map(spark.createDataFrame(entries, "doc_id string, from_family string, from_style string, to_family string, to_style string"))


@query(f"{STYLES} SELECT k::VARCHAR AS k, doc_id, new_font, new_style FROM w")
def pinned_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each style must set so that mapped fonts change and no others do."""
    found = fontmap.plan_styles(*styles(spark, sf_dir))
    return found.select(F.substring_index("self", "/", -1).alias("k"), "doc_id", "new_font", F.col("new_font_style").alias("new_style"))


@query(f"""
{STYLES},
run AS (
  SELECT w.*, p_size AS n, CASE WHEN doc_id = '2' AND k % 10 = 0 THEN 'Other' ELSE end_font END AS got, coalesce(end_style, 'Regular') AS got_style, coalesce(was_style, 'Regular') AS style,
    doc_id = '1' AND k % 50 = 1 AS other_text, doc_id = '3' AND k % 100 = 3 AS gone
  FROM w JOIN part ON p_partkey = k
),
t AS (
  SELECT *, NOT gone AND (was_font IS NULL OR (got IS NOT DISTINCT FROM want_font AND got_style = want_style)) OR (gone AND was_font IS NULL) AS fits,
    was_font IS NOT NULL AND (gone OR got IS DISTINCT FROM was_font OR got_style <> style) AS altered FROM run
)
SELECT doc_id, NOT bool_or(gone) AS same_structure, NOT bool_or(gone OR other_text) AS same_text, count(*) AS total, count(*) FILTER (WHERE altered) AS changed, count(*) FILTER (WHERE NOT altered) AS unchanged,
  coalesce(sum(n) FILTER (WHERE altered), 0)::BIGINT AS chars, count(*) FILTER (WHERE NOT fits) AS mismatches, NOT bool_or(gone OR other_text OR NOT fits) AS ok
FROM t GROUP BY doc_id
""")
def font_map_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether substituted documents say the same in the fonts that they should have; in three of five something was spoilt."""
    style, mapping = styles(spark, sf_dir)
    rows, k, doc = tree(spark, sf_dir), F.col("k"), F.col("doc_id")
    own = [F.lit(None).cast("string").alias(f"{p}_{f}") for p in "pc" for f in hierarchy.FIELDS]
    run = rows.select("doc_id", F.lit("s").alias("story_id"), k.alias("para_ord"), F.lit(0).alias("run_ord"), F.repeat(F.lit("a"), F.col("p_size").cast("int")).alias("text"), F.lit(None).cast("string").alias("para_style"), F.concat(F.lit("CharacterStyle/"), k.cast("string")).alias("char_style"), *own)
    at = F.col("para_ord")
    after = run.where(~((doc == "3") & (at % 100 == 3))).withColumn("text", F.when((doc == "1") & (at % 50 == 1), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    after = after.withColumn("c_font", F.when((doc == "2") & (at % 10 == 0), "Other"))
    new = fontmap.plan_styles(style, mapping)
    new = new.withColumn("font", F.col("new_font")).withColumn("font_style", F.col("new_font_style")).drop("new_font", "new_font_style")
    return fontmap.verify({"run": run, "style": style}, {"run": after, "style": new}, mapping)
