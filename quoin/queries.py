"""Registered queries of the library's operators over the driver's tables.

The tables hold no print documents, so each query is an analog: it applies an operator as
it is to columns that play the parts of pages, frames, runs or styles. Beside each stands
DuckDB SQL for the same rows. Doubles are rounded on both sides where sums could differ in
their order; lists are joined to text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions import affine, colour, numbers, text
from quoin.lineage import cut
from quoin.operators import aggregates, hierarchy, joins, ordered
from quoin.plans import alternatives, roles, structure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(pages: Column | str) -> Column:
    return F.array_join(F.transform(pages, lambda x: x.cast("string")), ",")


# ------------------------------------------------------------------ text containment
BAG = r"""
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM documents)),
items AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(coalesce(text, ''))), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark)),
-- a document is a page of those items that share three words in a row with it, or all their words, if these are fewer
item_size AS (SELECT item_id, least(3, count(*)) AS n FROM items GROUP BY item_id),
doc_runs AS (SELECT doc_id, [word, word || ' ' || lead(word) OVER w, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w] AS runs FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
item_runs AS (SELECT DISTINCT item_id, n, run FROM (SELECT item_id, [word, word || ' ' || lead(word) OVER w, word || ' ' || lead(word) OVER w || ' ' || lead(word, 2) OVER w] AS runs FROM items WINDOW w AS (PARTITION BY item_id ORDER BY pos)) JOIN item_size USING (item_id), unnest([runs[n]]) AS r(run) WHERE run IS NOT NULL),
each_run AS (SELECT DISTINCT doc_id, n, runs[n] AS run FROM doc_runs, (SELECT DISTINCT n FROM item_size)),
pair AS (SELECT DISTINCT doc_id, item_id FROM each_run JOIN item_runs USING (n, run)),
bag AS (SELECT doc_id, word, count(*) AS have FROM words GROUP BY ALL),
compact AS (SELECT doc_id, string_agg(word, '' ORDER BY pos) AS txt FROM words GROUP BY doc_id),
checked AS (
  SELECT doc_id, item_id, pos, word,
    CASE WHEN have IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, item_id, word ORDER BY pos) <= have ELSE length(word) >= 5 AND contains(txt, word) END AS ok
  FROM pair JOIN items USING (item_id) LEFT JOIN bag USING (doc_id, word) LEFT JOIN compact USING (doc_id)
),
first AS (SELECT doc_id, item_id, count(*) AS words, count(*) FILTER (WHERE NOT ok) AS missing, min(pos) FILTER (WHERE NOT ok) AS first_missing FROM checked GROUP BY ALL),
verdict AS (
  SELECT *, CASE WHEN missing > 0 THEN (words - first_missing - missing) <= greatest(1, floor((words - first_missing) * 0.25)) END AS "trailing" FROM first
)
"""


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark items (frames) on documents (pages) that share three words in a row
    with them; only the words of such documents and items go further."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    told = lambda df, key: df.select(key, text.words(F.col("text")).alias("ws"))
    items = told(table(spark, sf_dir, "benchmark"), "item_id")
    pair = cut(ordered.shared_runs(told(docs, "doc_id"), items, "doc_id", "item_id"))
    spread = lambda df, key: df.select(key, F.posexplode("ws").alias("pos", "word"))
    words = spread(cut(told(docs.join(pair.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")), "doc_id")
    return ordered.contained_words(pair.join(spread(items, "item_id"), "item_id"), words, ["doc_id"], ["item_id"])


@query(f'WITH {BAG} SELECT doc_id, item_id, words, missing, first_missing, "trailing" FROM verdict')
def text_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset containment and the overset test."""
    out = ordered.frame_verdicts(containment(spark, sf_dir), ["doc_id"], ["item_id"])
    return out.select("doc_id", "item_id", "words", "missing", F.col("first_missing").cast("long").alias("first_missing"), "trailing")


VERDICT = f"""
WITH {BAG},
page AS (SELECT doc_id, sum(words) AS words, sum(missing) AS missing, bool_or("trailing") AS "trailing" FROM verdict GROUP BY doc_id)
SELECT d.doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(missing, 0)::BIGINT AS missing,
  CASE WHEN coalesce(words, 0) = 0 THEN 'no-text' WHEN words >= 6 AND missing / words > 0.6 THEN 'mismatch' WHEN "trailing" THEN 'overset' WHEN missing > 0 THEN 'differs' ELSE 'ok' END AS status
FROM documents d LEFT JOIN page USING (doc_id)
"""


@query(VERDICT)
def text_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each page from the verdicts on its frames."""
    frames = ordered.frame_verdicts(containment(spark, sf_dir), ["doc_id"], ["item_id"])
    pages = table(spark, sf_dir, "documents").select("doc_id")
    return ordered.page_verdicts(frames, pages, ["doc_id"]).select("doc_id", F.col("words").cast("long").alias("words"), F.col("missing").cast("long").alias("missing"), "status")


# ------------------------------------------------------------------ inventories and histograms
@query("""
WITH e AS (SELECT *, event_type || ':' || (floor(value / 50)::BIGINT)::VARCHAR AS key FROM events),
g AS (
  SELECT key, count(*) AS uses, list_sort(list(DISTINCT user_id)) AS pages, list_sort(list(DISTINCT json_extract_string(props, '$.k')::BIGINT % 3)) AS sources, min(event_id) AS first_seen, arg_min(event_type, event_id) AS kind
  FROM e GROUP BY key
)
SELECT key, uses, len(pages)::INT AS n_pages, array_to_string(sources, ',') AS sources, kind, row_number() OVER (ORDER BY len(pages) DESC, uses DESC, first_seen)::INT AS place FROM g
""")
def colour_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses, pages and sources of each key, ordered by pages and uses."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("key", F.concat("event_type", F.lit(":"), F.floor(F.col("value") / 50).cast("string"))).withColumn("source", F.get_json_object("props", "$.k").cast("long") % 3)
    out = aggregates.inventory(e, [], "key", page="user_id", order="event_id", sets=["source"], base=["event_type"], lists=False)
    return out.select("key", "uses", F.col("n_pages").cast("int").alias("n_pages"), joined("sources").alias("sources"), F.col("event_type").alias("kind"), "place")


@query("""
WITH g AS (SELECT p_type AS scope, p_size AS bucket, count(*) AS n, min(p_partkey) AS first_seen FROM part GROUP BY ALL)
SELECT scope, bucket, n, row_number() OVER (PARTITION BY scope ORDER BY n DESC, first_seen)::INT AS place FROM g
""")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of each kind of part, the most frequent first."""
    p = table(spark, sf_dir, "part").withColumn("scope", F.col("p_type"))
    return aggregates.histogram(p, ["scope"], F.col("p_size"), page="p_partkey").select("scope", "bucket", "n", "place")


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, coalesce(bool_or(value > 100), false) AS high, coalesce(bool_or(event_type = 'purchase'), false) AS bought
FROM events GROUP BY user_id
""")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each page in one aggregate."""
    e = table(spark, sf_dir, "events")
    seen = aggregates.flags(e, ["user_id"], high=F.col("value") > 100, bought=F.col("event_type") == "purchase")
    return seen.join(aggregates.counts(e, ["user_id"], clicks=F.col("event_type") == "click"), "user_id")


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity AS ppi, CASE WHEN l_quantity + 0.5 < 10 THEN 'error' WHEN l_quantity + 0.5 < 20 THEN 'warn' ELSE 'pass' END AS level FROM lineitem WHERE l_quantity > 0),
w AS (SELECT l_orderkey, level, count(*) AS n, arg_min(l_linenumber, (ppi, l_linenumber)) AS worst_line, min(ppi) AS worst_ppi FROM p GROUP BY ALL)
SELECT l_orderkey, level, n, worst_line, worst_ppi, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE level WHEN 'error' THEN 0 WHEN 'warn' THEN 1 ELSE 3 END)::INT AS place FROM w
""")
def threshold_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by thresholds with a tolerance, the worst row of each, by severity."""
    p = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("ppi"))
    p = p.withColumn("level", F.when(F.col("ppi") + 0.5 < 10, "error").when(F.col("ppi") + 0.5 < 20, "warn").otherwise("pass"))
    w = p.groupBy("l_orderkey", "level").agg(F.count("*").alias("n"), F.min_by("l_linenumber", F.struct("ppi", "l_linenumber")).alias("worst_line"), F.min("ppi").alias("worst_ppi"))
    severity = F.when(F.col("level") == "error", 0).when(F.col("level") == "warn", 1).otherwise(3)
    return w.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(severity)))


@query("""
WITH f AS (SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'error' WHEN '2-HIGH' THEN 'warn' WHEN '3-MEDIUM' THEN 'info' ELSE 'pass' END AS level FROM orders)
SELECT o_custkey, count(*) FILTER (WHERE level = 'error') AS error, count(*) FILTER (WHERE level = 'warn') AS warn, count(*) FILTER (WHERE level = 'info') AS info, count(*) FILTER (WHERE level = 'pass') AS pass FROM f GROUP BY o_custkey
""")
def finding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each document by level."""
    p = F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").withColumn("level", F.when(p == "1-URGENT", "error").when(p == "2-HIGH", "warn").when(p == "3-MEDIUM", "info").otherwise("pass"))
    return aggregates.level_counts(o, ["o_custkey"])


@query("""
SELECT l_returnflag, l_shipmode_band, count(*) AS placements, count(DISTINCT l_partkey) AS images, min(l_linenumber) AS first_page, count(DISTINCT l_linenumber)::INT AS n_pages
FROM (SELECT *, l_quantity::INT % 3 AS l_shipmode_band FROM lineitem) GROUP BY ALL
""")
def image_colour_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements, distinct images and pages of each colour space."""
    li = table(spark, sf_dir, "lineitem").withColumn("l_shipmode_band", F.col("l_quantity").cast("int") % 3)
    out = aggregates.image_spaces(li, ["l_returnflag"], family="l_shipmode_band", image="l_partkey", page="l_linenumber")
    return out.select("l_returnflag", "l_shipmode_band", "placements", "images", F.array_min("pages").alias("first_page"), F.size("pages").alias("n_pages"))


@query("""
WITH f AS (SELECT l_suppkey, l_returnflag, l_orderkey, l_quantity, l_extendedprice FROM lineitem WHERE l_discount < 0.05),
per AS (SELECT l_returnflag, l_suppkey, l_orderkey, sum(l_quantity) AS chars, min(l_extendedprice) AS size FROM f GROUP BY ALL)
SELECT l_returnflag, l_suppkey, count(*) AS items, sum(chars)::DOUBLE AS chars, min(size) AS size FROM per GROUP BY ALL
""")
def two_level_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits summed by frame, then by check."""
    hits = table(spark, sf_dir, "lineitem").where("l_discount < 0.05").select("l_suppkey", "l_returnflag", "l_orderkey", F.col("l_quantity").alias("chars"), F.col("l_extendedprice").alias("size"))
    return aggregates.two_level(hits, ["l_orderkey"], ["l_returnflag", "l_suppkey"], chars="chars", size="size")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, example FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS example FROM lineitem) WHERE example <= 10
""")
def examples_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten examples of each group."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregates.examples(li, ["l_suppkey"], [F.col("l_extendedprice").desc(), F.col("l_orderkey"), F.col("l_linenumber")], 10)


@query("""
SELECT lang, source, sum(n_chars)::BIGINT AS chars, coalesce(sum(n_chars) FILTER (WHERE doc_id % 3 = 0), 0)::BIGINT AS via_override, coalesce(sum(n_chars) FILTER (WHERE doc_id % 3 <> 0), 0)::BIGINT AS via_style, count(DISTINCT doc_id % 7) AS raw_names
FROM documents GROUP BY ALL
""")
def font_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each font, by how the font was set."""
    d = table(spark, sf_dir, "documents")
    over = F.col("doc_id") % 3 == 0
    sums = [F.coalesce(F.sum(F.when(c, F.col("n_chars"))), F.lit(0)).alias(n) for c, n in ((over, "via_override"), (~over, "via_style"))]
    return d.groupBy("lang", "source").agg(F.sum("n_chars").alias("chars"), *sums, F.count_distinct(F.col("doc_id") % 7).alias("raw_names"))


# ------------------------------------------------------------------ colour and geometry
INKS = "l_extendedprice % 97 / 97 AS c, l_tax * 9.7 + l_extendedprice % 7 / 33 AS m, (l_quantity - 1) / 49.0 AS y, (l_linenumber - 1) / 10.0 AS k"


def inks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") % 97 / 97).alias("c"), (F.col("l_tax") * 9.7 + F.col("l_extendedprice") % 7 / 33).alias("m"), ((F.col("l_quantity") - 1) / 49.0).alias("y"), ((F.col("l_linenumber") - 1) / 10.0).alias("k"))


def corner_sql(channel: int) -> str:
    terms = [f"{float(rgb[channel])}::DOUBLE * " + " * ".join(v if on else f"(1 - {v})" for v, on in zip("cmy", key)) for key, rgb in colour.CORNERS.items()]
    return f"floor(({' + '.join(terms)}) * (1 - k * (1 - 35 / 255.0::DOUBLE)) + 0.5)::INT"


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, {", ".join(f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v})) AS {v}" for v in "cmyk")} FROM (SELECT l_orderkey, l_linenumber, {INKS} FROM lineitem)),
v AS (SELECT l_orderkey, l_linenumber, {", ".join(f"{corner_sql(n)} AS {c}" for n, c in enumerate("rgb"))} FROM i)
SELECT l_orderkey, l_linenumber, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS hex FROM v
""")
def cmyk_to_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process inks as sRGB."""
    return inks(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.hex_of(colour.cmyk_to_rgb(*map(F.col, "cmyk"))).alias("hex"))


@query("""
WITH i AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l, l_extendedprice % 80 - 40 AS a, l_tax * 700 - 30 AS b FROM lineitem),
t AS (SELECT l_orderkey, l_linenumber, (l + 16) / 116 + a / 500 AS fx, (l + 16) / 116 AS fy, (l + 16) / 116 - b / 200 AS fz FROM i),
x AS (SELECT l_orderkey, l_linenumber, 0.9642::DOUBLE * CASE WHEN fx > 6/29.0::DOUBLE THEN fx*fx*fx ELSE (fx - 4/29.0::DOUBLE) * (3 * (6/29.0::DOUBLE) * (6/29.0::DOUBLE)) END AS x,
  CASE WHEN fy > 6/29.0::DOUBLE THEN fy*fy*fy ELSE (fy - 4/29.0::DOUBLE) * (3 * (6/29.0::DOUBLE) * (6/29.0::DOUBLE)) END AS y,
  0.8249::DOUBLE * CASE WHEN fz > 6/29.0::DOUBLE THEN fz*fz*fz ELSE (fz - 4/29.0::DOUBLE) * (3 * (6/29.0::DOUBLE) * (6/29.0::DOUBLE)) END AS z FROM t),
u AS (SELECT l_orderkey, l_linenumber, 3.1338561::DOUBLE*x - 1.6168667::DOUBLE*y - 0.4906146::DOUBLE*z AS r, -0.9787684::DOUBLE*x + 1.9161415::DOUBLE*y + 0.0334540::DOUBLE*z AS g, 0.0719453::DOUBLE*x - 0.2289914::DOUBLE*y + 1.4052427::DOUBLE*z AS b FROM x),
w AS (SELECT l_orderkey, l_linenumber, list_transform([r, g, b], lambda s: floor(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN s <= 0.0031308 THEN 12.92::DOUBLE * s ELSE 1.055::DOUBLE * pow(greatest(s, 0), 1 / 2.4::DOUBLE) - 0.055::DOUBLE END)) + 0.5)::INT) AS c FROM u)
SELECT l_orderkey, l_linenumber, '#' || lower(printf('%02x%02x%02x', c[1], c[2], c[3])) AS hex FROM w
""")
def lab_to_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIE Lab as sRGB."""
    li = table(spark, sf_dir, "lineitem")
    lab = (F.col("l_quantity") * 2, F.col("l_extendedprice") % 80 - 40, F.col("l_tax") * 700 - 30)
    return li.select("l_orderkey", "l_linenumber", colour.hex_of(colour.lab_to_rgb(*lab)).alias("hex"))


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, {", ".join(f"floor({v} * 1000 + 0.5) / 10.0::DOUBLE AS {v}" for v in "cmyk")} FROM (SELECT l_orderkey, l_linenumber, {INKS} FROM lineitem))
SELECT l_orderkey, l_linenumber, floor((c + m + y + k) * 10 + 0.5) / 10.0::DOUBLE AS tac, c + m + y + k >= 200 AS marked FROM i
""")
def total_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total ink in percent, and whether it is marked."""
    v = [colour.percent(F.col(c)) for c in "cmyk"]
    return inks(spark, sf_dir).select("l_orderkey", "l_linenumber", colour.total_ink(v).alias("tac"), (sum(v[1:], v[0]) >= 200).alias("marked"))


TURN = "cos(l_linenumber * 0.5) AS c0, sin(l_linenumber * 0.5) AS s0, l_quantity AS sx, l_discount * 100 + 1 AS sy, l_extendedprice / 100 AS tx, l_tax * 1000 AS ty"


@query(f"""
WITH i AS (SELECT l_orderkey, l_linenumber, {TURN} FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, c0 * sx AS a, s0 * sx AS b, -s0 * sy AS c, c0 * sy AS d, c0 * tx - s0 * ty AS e, s0 * tx + c0 * ty AS f FROM i)
SELECT l_orderkey, l_linenumber, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(d, 4) AS d, round(e, 4) AS e, round(f, 4) AS f,
  round(greatest(e, a + e, c + e, a + c + e) - least(e, a + e, c + e, a + c + e), 4) AS w, round(sqrt(a * a + b * b), 4) AS side, a * d - b * c < 0 AS flipped FROM m
""")
def affine_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed transforms, bounding boxes and sides."""
    n, sy = F.col("l_linenumber") * 0.5, F.col("l_discount") * 100 + 1
    zero = F.lit(0.0)
    outer = F.array(F.cos(n), F.sin(n), -F.sin(n), F.cos(n), zero, zero)
    inner = F.array(F.col("l_quantity"), zero, zero, sy, F.col("l_extendedprice") / 100, F.col("l_tax") * 1000)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", affine.compose(outer, inner).alias("m"))
    m = F.col("m")
    corners = [affine.apply(m, F.lit(float(u)), F.lit(float(v))) for u in (0, 1) for v in (0, 1)]
    box = affine.box_of([c[0] for c in corners], [c[1] for c in corners])
    return li.select("l_orderkey", "l_linenumber", *[F.round(m[k], 4).alias(c) for k, c in enumerate("abcdef")], F.round(box["w"], 4).alias("w"), F.round(affine.sides(m)[0], 4).alias("side"), affine.flipped(m).alias("flipped"))


@query("""
WITH a AS (SELECT *, (l_linenumber - 4) * 90 + CASE WHEN l_quantity < 25 THEN 0.3 WHEN l_quantity < 40 THEN 0.5 ELSE 0 END AS angle FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(angle) < 0.5 THEN '0' WHEN abs(angle - 90) < 0.5 THEN '90' WHEN abs(angle - 180) < 0.5 THEN '180' WHEN abs(angle + 90) < 0.5 THEN '-90' WHEN abs(angle + 180) < 0.5 THEN '180' ELSE 'other' END AS bucket FROM a
""")
def rotation_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    angle = (F.col("l_linenumber") - 4) * 90 + F.when(q < 25, 0.3).when(q < 40, 0.5).otherwise(0.0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", affine.rotation_bucket(angle).alias("bucket"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round((l_partkey % 3000) / (l_tax * 1000 / 72), 6) END AS ppi,
  round(greatest(0, least(l_quantity - l_discount * 100, l_tax * 500)) , 6) AS bleed, floor((l_quantity / (72 / 25.4::DOUBLE)) * 10 + 0.5) / 10.0::DOUBLE AS mm
FROM lineitem
""")
def resolution_and_bleed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective resolution, bleed and millimetres."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    bleed = F.greatest(F.lit(0.0), F.least(q - d * 100, t * 500))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(affine.ppi(F.col("l_partkey") % 3000, t * 1000), 6).alias("ppi"), F.round(bleed, 6).alias("bleed"), numbers.places(numbers.mm(q)).alias("mm"))


# ------------------------------------------------------------------ joins
@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories that no frame of a kind refers to."""
    return joins.unreferenced(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 200000"), [("c_custkey", "o_custkey")])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def missing_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose story is not there."""
    return joins.dangling(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), table(spark, sf_dir, "part").where("p_size > 10"), [("l_partkey", "p_partkey")])


THREADS = "SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS nxt, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey - 1 END AS prv FROM orders"


@query(f"""
WITH t AS ({THREADS})
SELECT o_custkey, o_orderkey FROM t WHERE (nxt IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t u WHERE u.o_custkey = t.o_custkey AND u.o_orderkey = t.nxt)) OR (prv IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t u WHERE u.o_custkey = t.o_custkey AND u.o_orderkey = t.prv))
""")
def broken_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames threaded to frames that are not there."""
    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 4 == 0, k + 1).alias("nxt"), F.when(k % 5 == 0, k - 1).alias("prv"))
    return joins.broken_links(t, ["o_custkey"], "o_orderkey", ["nxt", "prv"]).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, count(*) AS items FROM orders GROUP BY o_custkey HAVING count(*) > 1 AND NOT bool_and(o_orderstatus = 'F')")
def shared_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories in several frames that are not all threaded."""
    return joins.in_several(table(spark, sf_dir, "orders"), [], "o_custkey", F.col("o_orderstatus") == "F")


@query("""
WITH i AS (SELECT c_custkey AS item, c_nationkey AS spread, c_acctbal % 300 AS x, (c_custkey % 97) * 3.0 AS y, (c_custkey % 7) * 10.0 AS w, (c_custkey % 5) * 8.0 AS h FROM customer),
p AS (SELECT s_suppkey AS page, s_nationkey AS spread, (s_suppkey % 3) * 100.0 AS x, 0.0 AS y, 100.0 AS w, 150.0 + s_suppkey % 4 * 20 AS h FROM supplier),
b AS (
  SELECT item, page, CASE WHEN i.x + i.w / 2 BETWEEN p.x AND p.x + p.w AND i.y + i.h / 2 BETWEEN p.y AND p.y + p.h THEN 1e300
    WHEN least(i.x + i.w, p.x + p.w) > greatest(i.x, p.x) AND least(i.y + i.h, p.y + p.h) > greatest(i.y, p.y) THEN (least(i.x + i.w, p.x + p.w) - greatest(i.x, p.x)) * (least(i.y + i.h, p.y + p.h) - greatest(i.y, p.y)) END AS r
  FROM i JOIN p USING (spread)
)
SELECT i.item, best.page FROM i LEFT JOIN (SELECT item, page FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY r DESC, page) AS n FROM b WHERE r IS NOT NULL) WHERE n = 1) best USING (item)
""")
def spatial_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items to the pages that hold their centres, or that they overlap most."""
    k = F.col("c_custkey")
    box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    items = table(spark, sf_dir, "customer").select(k.alias("item"), F.col("c_nationkey").alias("spread"), box(F.col("c_acctbal") % 300, (k % 97) * 3.0, (k % 7) * 10.0, (k % 5) * 8.0).alias("box"))
    s = F.col("s_suppkey")
    pages = table(spark, sf_dir, "supplier").select(s.alias("page"), F.col("s_nationkey").alias("spread"), box((s % 3) * 100.0, F.lit(0.0), F.lit(100.0), s % 4 * 20 + 150.0).alias("box"))
    pages = pages.withColumn("ord", F.col("page"))
    return joins.assign_boxes(items, pages, ["spread"], item="item", page="page", order="ord").select("item", "page")


@query("""
WITH u AS (SELECT DISTINCT p_brand, p_type FROM part),
r AS (SELECT p_brand, p_type, CASE p_size % 3 WHEN 0 THEN 'Installed' WHEN 1 THEN 'Substituted' ELSE 'NotAvailable' END AS status FROM part WHERE p_size < 12)
SELECT u.p_brand, u.p_type, arg_max(status, CASE status WHEN 'NotAvailable' THEN 3 WHEN 'Substituted' THEN 2 WHEN 'Installed' THEN 1 END) AS status
FROM u LEFT JOIN r ON r.p_brand = u.p_brand OR r.p_type = u.p_type GROUP BY ALL
""")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst status among resources that match on either of two keys."""
    p = table(spark, sf_dir, "part")
    s = F.col("p_size") % 3
    r = p.where("p_size < 12").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.when(s == 0, "Installed").when(s == 1, "Substituted").otherwise("NotAvailable").alias("status"))
    return joins.worst_status(p.select("p_brand", "p_type").distinct(), r, [], keys=[("p_brand", "brand"), ("p_type", "type")], status="status", ranks={"NotAvailable": 3, "Substituted": 2, "Installed": 1})


@query("""
WITH a AS (SELECT o_custkey AS g, floor(o_totalprice / 1000)::BIGINT AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY floor(o_totalprice / 1000)) AS n FROM orders),
b AS (SELECT o_custkey AS g, floor(sum(l_extendedprice) / 1000)::BIGINT AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey, o_orderkey),
c AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) AS n FROM b)
SELECT g, n::INT AS n, a.v AS v_a, c.v AS v_b FROM a FULL JOIN c USING (g, n)
""")
def multiset_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two multisets of each group, matched in order. An order's prices are added as they are stored, file by file
    and row by row: where their sum is a whole thousand, another order of adding can fall just below it."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    li = li.select("l_orderkey", "l_extendedprice", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    a = o.select(F.col("o_custkey").alias("g"), F.floor(F.col("o_totalprice") / 1000).alias("v"))
    lines = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("g"), "o_orderkey", "l_extendedprice", "file", "place")
    b = aggregates.sums_in_order(lines, ["g", "o_orderkey"], "l_extendedprice", ["file", "place"]).select("g", F.floor(F.col("l_extendedprice") / 1000).alias("v"))
    return joins.paired(a, b, ["g"], "v")


@query("""
SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 5 AND abs(c_nationkey - s_nationkey) <= 5
""")
def tolerance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours and swatches whose components all lie within a tolerance."""
    a = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    b = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return joins.near_numbers(a, b, ["x", "y"], 5.0).select("c_custkey", "s_suppkey")


@query("""
SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END NULLS LAST, o_orderkey) - 1)::INT AS ord FROM orders
""")
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads in the order of the manifest, the unnamed last."""
    o = table(spark, sf_dir, "orders")
    m = o.where("o_orderstatus <> 'P'").select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.restore_order(o.select("o_custkey", "o_orderkey"), m, ["o_custkey"], "o_orderkey", "o_orderdate")


# ------------------------------------------------------------------ order and hierarchy
@query("""
WITH e AS (SELECT user_id, event_id, event_type, floor(value + 0.5) AS y FROM events),
m AS (SELECT *, coalesce((abs(y - lag(y) OVER (PARTITION BY user_id ORDER BY event_id)) > 4)::INT, 0) AS moved FROM e),
i AS (SELECT *, (sum(moved) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS island FROM m)
SELECT user_id, island, string_agg(event_type, ' ' ORDER BY event_id) AS line FROM i GROUP BY ALL
""")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs joined into lines by their heights."""
    return ordered.text_lines(table(spark, sf_dir, "events"), ["user_id"], seq="event_id", text="event_type", y="value")


@query(r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
h AS (SELECT doc_id, ls, coalesce(list_filter(ls, lambda x: length(x) BETWEEN 3 AND 90 AND len(regexp_split_to_array(x, '\s+')) <= 12)[1], ls[1]) AS headline FROM l),
k AS (SELECT *, coalesce(list_filter(ls, lambda x: x <> headline AND length(x) < 45 AND upper(x) = x AND regexp_matches(x, '[A-Z]'))[1], 'PAGE') AS kicker FROM h),
b AS (SELECT *, substr(trim(regexp_replace(array_to_string(list_filter(ls, lambda x: x <> headline AND x <> kicker), ' '), '\s+', ' ', 'g')), 1, 700) AS body FROM k)
SELECT doc_id, kicker, CASE WHEN len(ls) = 0 THEN 'No text detected' ELSE headline END AS headline,
  CASE WHEN len(ls) = 0 THEN 'This PDF page may contain outlined text or image-only artwork.' WHEN body = '' THEN substr(array_to_string(ls[2:], ' '), 1, 700) ELSE body END AS body FROM b
""")
def page_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kicker, headline and body of each page."""
    d = table(spark, sf_dir, "documents")
    return ordered.page_hierarchy(d.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines")), "lines").drop("lines")


@query("""
WITH s AS (SELECT lang, doc_id, source, length(source) + length(lang) AS n, (n_chars % 40)::DOUBLE AS size, n_chars % 3 = 0 AS upright FROM documents),
r AS (SELECT *, CASE WHEN upright THEN 500 ELSE 0 END + CASE WHEN length(source) <= 65 THEN 100 ELSE 0 END - abs(length(source) - CASE WHEN size >= 16 THEN 12 ELSE 32 END) AS score FROM s)
SELECT lang, doc_id, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM r) WHERE k = 1
""")
def sample_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that shows each font best."""
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", (F.col("n_chars") % 40).cast("double").alias("size"), (F.col("n_chars") % 3 == 0).alias("upright"))
    return ordered.sample_run(d, ["lang"], text="source", size="size", upright=F.col("upright"), order=["doc_id"]).select("lang", "doc_id", "score")


STYLES = "SELECT p_partkey AS self, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS based_on, CASE WHEN p_size % 3 = 0 THEN p_brand END AS font, CASE WHEN p_size % 4 = 0 THEN p_type WHEN p_size % 4 = 1 THEN '' END AS font_style FROM part"


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(k.alias("self"), F.when(k > 1, F.floor(k / 2)).alias("based_on"), F.when(s % 3 == 0, F.col("p_brand")).alias("font"), F.when(s % 4 == 0, F.col("p_type")).when(s % 4 == 1, "").alias("font_style"))


@query(f"""
WITH RECURSIVE s AS ({STYLES}),
up AS (SELECT self, self AS cur, 0 AS d FROM s UNION ALL SELECT up.self, s.based_on, d + 1 FROM up JOIN s ON s.self = up.cur WHERE s.based_on IS NOT NULL)
SELECT up.self, arg_min(nullif(s.font, ''), d) FILTER (WHERE nullif(s.font, '') IS NOT NULL) AS font, arg_min(nullif(s.font_style, ''), d) FILTER (WHERE nullif(s.font_style, '') IS NOT NULL) AS font_style
FROM up JOIN s ON s.self = up.cur GROUP BY up.self
""")
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles resolved along their chains by pointer doubling."""
    return hierarchy.resolve_chain(styles(spark, sf_dir), [], fields=("font", "font_style"))


@query("""
WITH RECURSIVE up AS (SELECT p_partkey AS self, p_partkey AS cur, 0 AS d FROM part UNION ALL SELECT self, p_partkey // 2, d + 1 FROM up JOIN part ON p_partkey = cur WHERE p_partkey > 1 AND EXISTS (SELECT 1 FROM part q WHERE q.p_partkey = part.p_partkey // 2))
SELECT self, arg_max(cur, d) AS root, max(d)::INT AS depth FROM up GROUP BY self
""")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root and the length of each chain."""
    return hierarchy.depth_of(styles(spark, sf_dir), [], key="self", parent="based_on")


@query(f"""
WITH s AS ({STYLES}),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN l_returnflag END AS font, CASE WHEN l_quantity > 40 THEN l_linestatus ELSE '' END AS font_style FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(nullif(r.font, ''), nullif(s.font, ''), 'Base') AS font, coalesce(nullif(r.font_style, ''), nullif(s.font_style, ''), 'Regular') AS font_style FROM r LEFT JOIN s ON s.self = l_partkey
""")
def run_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's own settings over those of its styles."""
    q = F.col("l_quantity")
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.struct(F.when(q < 10, F.col("l_returnflag")).alias("font"), F.when(q > 40, F.col("l_linestatus")).otherwise("").alias("font_style")).alias("run"))
    both = joins.look_up(r, styles(spark, sf_dir), [("l_partkey", "self")], "s_")
    unset = F.struct(F.lit(None).cast("string").alias("font"), F.lit("").alias("font_style"))
    base = F.struct(F.lit("Base").alias("font"), F.lit("Regular").alias("font_style"))
    own = F.struct(F.col("s_font").alias("font"), F.col("s_font_style").alias("font_style"))
    return both.select("l_orderkey", "l_linenumber", hierarchy.cascade(F.col("run"), own, unset, base, ("font", "font_style")).alias("e")).select("l_orderkey", "l_linenumber", "e.*")


# ------------------------------------------------------------------ text and markup
@query(r"""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\b[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(html, '<a\b[^>]*>'), 1) AS n FROM pages)
SELECT page_id, n::INT AS n, replace(replace(replace(replace(nullif(regexp_extract(tag, 'href="([^"]*)"', 1), ''), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href FROM t
""")
def html_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of start tags by text alone."""
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(text.start_tags(F.col("html"), "a")).alias("k", "tag"))
    return tags.select("page_id", (F.col("k") + 1).alias("n"), F.nullif(text.attributes(F.col("tag"))["href"], F.lit("")).alias("href"))


@query(r"SELECT page_id, replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages".replace(r"\"", '"'))
def decode_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four named entities, decoded once."""
    return table(spark, sf_dir, "pages").select("page_id", text.unescape(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(r"""
SELECT p_partkey, lower(trim(regexp_replace(trim(p_name || CASE p_size % 3 WHEN 0 THEN ' (TT) ' WHEN 1 THEN ' (TrueType)' ELSE '' END), '(?i)\s*\((?:TT|OT|T1|Type 1|TrueType|OpenType|PS|CFF)\)\s*$', ''))) || '|' || lower(trim(p_type)) AS key,
  regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS alias FROM part
""")
def name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of font names."""
    s = F.col("p_size") % 3
    name = F.concat("p_name", F.when(s == 0, " (TT) ").when(s == 1, " (TrueType)").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", text.font_key(name, F.col("p_type")).alias("key"), text.alias_key(F.col("p_brand")).alias("alias"))


@query("SELECT source, sum(len(list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')))::BIGINT AS words FROM documents GROUP BY source".replace("\\\\", "\\"))
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all stories."""
    return structure.word_counts(table(spark, sf_dir, "documents"), ["source"])


ROLE = "CASE " + " ".join(f"WHEN regexp_matches(n, '{pattern}') THEN '{role}'" for role, pattern in roles.NAMES) + " WHEN size >= 18 AND bold THEN 'section-heading' WHEN size >= 13 AND bold THEN 'item-heading' WHEN size > 0 AND size <= 9 THEN 'caption' ELSE 'none' END"
ROLE_STYLES = "SELECT p_partkey, p_brand, regexp_replace(lower(p_name || ' ' || p_type), '[_-]+', ' ', 'g') AS n, p_size::DOUBLE AS size, p_partkey % 2 = 0 AS bold FROM part"


def role_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    style = F.when(F.col("p_partkey") % 2 == 0, "Semibold").otherwise("Regular")
    return p.select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("size"), roles.guess_role(F.concat_ws(" ", "p_name", "p_type"), F.col("p_size").cast("double"), style).alias("role"))


@query(f"SELECT p_partkey, {ROLE} AS role FROM ({ROLE_STYLES})")
def role_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The role of each style by its name, else by its size."""
    return role_styles(spark, sf_dir).select("p_partkey", "role")


@query(f"SELECT p_brand, role, arg_min(p_partkey, (-size, p_partkey)) AS master FROM (SELECT *, {ROLE} AS role FROM ({ROLE_STYLES})) WHERE role <> 'none' GROUP BY ALL")
def role_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest style of each role."""
    return roles.role_masters(role_styles(spark, sf_dir), ["p_brand"], key="p_partkey", order="p_partkey").select("p_brand", "role", F.col("p_partkey").alias("master"))


@query(r"""
WITH RECURSIVE n AS (SELECT DISTINCT regexp_replace(lower(split_part(p_name, ' ', 1) || CASE p_size % 4 WHEN 0 THEN 'BoldItalic' WHEN 1 THEN 'StdMT' WHEN 2 THEN '-Light' ELSE '' END), '[^a-z0-9]', '', 'g') AS raw FROM part),
s AS (SELECT raw, raw AS base, 0 AS d FROM n UNION ALL
  SELECT raw, regexp_replace(base, '(?:extrabold|ultrabold|semibold|demibold|demi|bold|extrablack|ultrablack|black|heavy|extralight|ultralight|light|thin|medium|regular|normal|roman|book|italic|oblique|upright|psmt|ps|mt|std|pro|lt|bt)$', ''), d + 1
  FROM s WHERE d < 20 AND regexp_matches(base, '(?:extrabold|ultrabold|semibold|demibold|demi|bold|extrablack|ultrablack|black|heavy|extralight|ultralight|light|thin|medium|regular|normal|roman|book|italic|oblique|upright|psmt|ps|mt|std|pro|lt|bt)$'))
SELECT raw, arg_max(base, d) AS base FROM s GROUP BY raw
""")
def suffix_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names without their style suffixes."""
    s = F.col("p_size") % 4
    name = F.concat(F.split("p_name", " ")[0], F.when(s == 0, "BoldItalic").when(s == 1, "StdMT").when(s == 2, "-Light").otherwise(""))
    return table(spark, sf_dir, "part").select(text.alias_key(name).alias("raw")).distinct().select("raw", alternatives.strip_styles(F.col("raw")).alias("base"))
