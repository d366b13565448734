"""Preflight rules over PDF fact tables, for any number of documents and profiles at once.

Each rule is one small query that yields findings (doc_id, profile_id, rule_ord, level, id,
detail, pages, count, worst_page, worst_ppi). Aggregates run on facts, before profiles are
joined; profiles are few rows, so the join with them multiplies only what is aggregated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.numbers import half_up, mm, number_or, places, plain
from quoin.functions.text import page_list
from quoin.lineage import cut
from quoin.operators.aggregates import best_row, distinct_sorted, flags, histogram, inventory, level_counts

# What a printer accepts unless told otherwise.
DEFAULTS = {"min_text": 5.0, "light_min": 8.0, "multi_ink_min": 8.0, "reverse_min": 6.0, "safe_mm": 3.0, "bleed_mm": 3.0, "min_ppi": 300.0, "allow_rgb": False, "allow_spot": False, "max_ink": 300.0}
SEVERITY = ("error", "warn", "info", "pass")
MM_PT = 72 / 25.4


MOST_PROFILES = 1000  #: that are compared at once: all rules broadcast them


def profile_table(spark: SparkSession, profiles: dict[str, dict]) -> DataFrame:
    """A row for each named profile, with defaults for what it leaves out."""
    if len(profiles) > MOST_PROFILES:
        raise ValueError(f"{len(profiles)} profiles; {MOST_PROFILES} at a time")
    rows = [(name, *[type(v)(given.get(k, v)) for k, v in DEFAULTS.items()]) for name, given in profiles.items()]
    kinds = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'double'}" for k, v in DEFAULTS.items())
    return spark.createDataFrame(rows, f"profile_id string, {kinds}")


def sanitise(settings: DataFrame, json: str = "json") -> DataFrame:
    """Profiles from JSON text: numbers are kept if finite and not negative ('' is 0),
    booleans by truth, anything else takes the default."""
    raw = F.from_json(json, "map<string,string>")
    out = []
    for k, v in DEFAULTS.items():
        given = raw[camel(k)]
        if isinstance(v, bool):
            out.append(F.when(F.map_contains_key(raw, F.lit(camel(k))), ~F.coalesce(given, F.lit("")).isin("", "0", "false")).otherwise(v).alias(k))
        else:
            out.append(F.coalesce(number_or(given, v), F.lit(v)).alias(k))
    return settings.select(*[c for c in settings.columns if c != json], *out)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def save_profiles(profiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Profiles as lines of JSON: the name, and the settings as text that sanitise() reads."""
    settings = F.to_json(F.struct(*[F.col(k).alias(camel(k)) for k in DEFAULTS]))
    profiles.select("profile_id", settings.alias("json")).write.mode(mode).json(path)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Saved profiles, each setting checked, with defaults for what is missing."""
    return sanitise(spark.read.schema("profile_id string, json string").json(path))


def bleed_of(page: DataFrame) -> DataFrame:
    """page with bleed_pt: how far the page goes past its trim on the narrowest side, null without a trim box."""
    t, o = (lambda f: F.col(f"trim.{f}")), (lambda f: F.coalesce(F.col(f"bleed.{f}"), F.col(f"media.{f}")))
    sides = [t("x") - o("x"), t("y") - o("y"), o("x") + o("w") - t("x") - t("w"), o("y") + o("h") - t("y") - t("h")]
    return page.withColumn("bleed_pt", F.when(F.col("trim").isNotNull(), F.greatest(F.lit(0.0), F.least(*sides))))


def size_label(box: Column) -> Column:
    return F.concat(plain(places(mm(box["w"]))), F.lit(" × "), plain(places(mm(box["h"]))), F.lit(" mm"))


def finding(rows: DataFrame, order: int, id: str, level: Column | str, detail: Column | str = "", pages: Column | None = None, worst: tuple[Column, Column] | None = None) -> DataFrame:
    pages = F.coalesce(pages, F.array().cast("array<int>")) if pages is not None else F.array().cast("array<int>")
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    page, ppi = worst or (F.lit(None), F.lit(None))
    return rows.select("doc_id", "profile_id", F.lit(order).alias("rule_ord"), lit(level).alias("level"), F.lit(id).alias("id"), lit(detail).alias("detail"), pages.cast("array<int>").alias("pages"), F.size(pages).alias("count"), page.cast("int").alias("worst_page"), ppi.cast("int").alias("worst_ppi"))


def gradeable(placement: DataFrame) -> DataFrame:
    """Placed images whose resolution counts: drawn, not masks, larger than a pixel."""
    fine = F.col("ppi_x").isNotNull() & F.col("ppi_y").isNotNull() & (F.col("ppi_x") > 0) & (F.col("ppi_y") > 0) & ~((F.col("px_w") <= 1) & (F.col("px_h") <= 1))
    return placement.where(~F.col("mask") & ~F.col("soft_mask") & fine).withColumn("ppi", F.least("ppi_x", "ppi_y"))


def colours(paint: DataFrame) -> DataFrame:
    """The colour inventory: what is painted, by key, in the order of pages and uses."""
    out = inventory(paint, ["doc_id"], "key", page="page", order="seq", sets=["source", "tint"], base=["kind", "label", "family", "rgb", "rgb2", "cmyk", "tac", "icc"])
    return out.withColumn("tints", F.reverse("tints"))


def all_paint(paint: DataFrame, placement: DataFrame, image: DataFrame) -> DataFrame:
    """Paint, and one use of each spot colour of an image wherever it is placed."""
    spots = image.select("doc_id", "image_id", "swatches", F.explode("spot").alias("name"))
    used = placement.where(~F.col("mask") & ~F.col("soft_mask") & (F.col("image_id") >= 0)).select("doc_id", "page", "seq", "image_id").join(spots, ["doc_id", "image_id"])
    base = {f.name: F.lit(None).cast(f.dataType) for f in paint.schema.fields}
    base |= {"doc_id": F.col("doc_id"), "page": F.col("page"), "seq": F.col("seq") + (1 << 62), "key": F.concat(F.lit("spot:"), "name"), "kind": F.lit("spot"), "label": F.col("name"), "rgb": F.col("swatches")[F.col("name")], "source": F.lit("image")}
    return paint.unionByName(used.select(*[c.alias(n) for n, c in base.items()]))


def steps_of(profiles: DataFrame, setting: str) -> list[float]:
    """The distinct limits that profiles set, in order."""
    found = sorted({r[0] for r in profiles.select(setting).limit(MOST_PROFILES + 1).collect()})
    if len(found) > MOST_PROFILES:
        raise ValueError(f"more than {MOST_PROFILES} profiles at a time")
    return found


def stepped(rows: DataFrame, value: Column, limits: list[float], pages: Column, *, above: bool = False) -> DataFrame:
    """(doc_id, step, n, pages): facts summed between limits, before they meet any profile. step is how many
    limits the value has reached (with above: passed); pages an array."""
    reached = F.filter(F.array(*map(F.lit, limits)), (lambda t: t < value) if above else (lambda t: t <= value))
    return rows.groupBy("doc_id", F.size(reached).alias("step")).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))).alias("pages"))


def beyond(sums: DataFrame, profiles: DataFrame, setting: str, limits: list[float], *, above: bool = False) -> DataFrame:
    """(doc_id, profile_id, n, pages) of what lies below each profile's limit (with above: beyond it)."""
    nth = F.array_position(F.array(*map(F.lit, limits)), F.col(setting)) - 1
    p = F.broadcast(profiles.select("profile_id", nth.alias("__nth")))
    both = sums.join(p, F.col("step") > F.col("__nth") if above else F.col("step") <= F.col("__nth"))
    return both.groupBy("doc_id", "profile_id").agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))


def evaluate(facts: dict[str, DataFrame], profiles: DataFrame, idml: DataFrame | None = None) -> DataFrame:
    """All findings of all documents under all profiles, numbered by place: severity, then
    the order of the rules.

    facts: doc, page, font, image, placement, paint as in quoin.schema.PDF. idml, if given:
    doc_id, page_count, sizes array<struct<w, h>>. Documents that could not be opened
    (error is set) have none.
    """
    doc = facts["doc"].where("error is null").select("doc_id", "page_count", "pdfx", "has_intent", "intent_id", "inline_images")
    page = bleed_of(facts["page"])
    real = facts["placement"].where(~F.col("mask") & ~F.col("soft_mask"))
    inv = cut(colours(all_paint(facts["paint"], facts["placement"], facts["image"])))  # nine rules read it
    every = lambda df: df.crossJoin(F.broadcast(profiles))  # noqa: E731  profiles: the users' few rows
    out = []

    # sizes: one is fine; of several the second most frequent is reported
    sizes = histogram(page, ["doc_id"], size_label(F.coalesce("trim", "media")), page="page")
    kinds = sizes.groupBy("doc_id").agg(F.count("*").alias("sizes"), F.max(F.when(F.col("place") == 2, F.col("pages"))).alias("second"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 5, F.struct("place", "bucket", "n")))), lambda x: F.concat(x["bucket"], F.lit(": "), x["n"].cast("string"))), " · ").alias("list"))
    out.append(finding(every(kinds), 1, "page-size", F.when(F.col("sizes") == 1, "pass").otherwise("warn"), F.col("list"), F.col("second")))

    # bleed
    limits = steps_of(profiles, "bleed_mm")
    lacking = beyond(stepped(page.where("bleed_pt is not null"), F.col("bleed_pt") + 0.05, [v * MM_PT for v in limits], F.array("page")), profiles, "bleed_mm", limits)
    short = page.groupBy("doc_id").agg(
        F.count_if(F.col("trim").isNull()).alias("unknown"), F.count("*").alias("pages_n"), distinct_sorted(F.when(F.col("trim").isNull(), F.col("page"))).alias("no_box"),
        F.slice(distinct_sorted(places(mm(F.col("bleed_pt")))), 1, 4).alias("have"),
    )
    short = every(short).join(lacking.withColumnRenamed("pages", "lacking"), ["doc_id", "profile_id"], "left").withColumn("lacking", F.coalesce("lacking", F.array().cast("array<int>")))
    none = F.col("unknown") == F.col("pages_n")
    level = F.when(none & (F.col("bleed_mm") > 0), "error").when(none, "info").when(F.size("lacking") > 0, "error").otherwise("pass")
    out.append(finding(short, 2, "bleed", level, F.array_join(F.transform("have", plain), ", "), F.when(none, F.slice("no_box", 1, 200)).otherwise(F.col("lacking"))))

    # fonts
    font = doc.select("doc_id").join(facts["font"].select("doc_id", "name", "type", "embedded", "pages"), "doc_id", "left")
    missing, type3 = ~F.col("embedded"), F.col("type") == "Type3"
    pages_of = lambda test: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(test, F.col("pages"))))))
    fonts = every(font.groupBy("doc_id").agg(F.count("name").alias("n"), F.count_if(missing).alias("missing"), F.count_if(type3).alias("t3"), distinct_sorted(F.when(missing, F.col("name"))).alias("names"), pages_of(missing).alias("m_pages"), pages_of(type3).alias("t_pages")))
    out.append(finding(fonts, 3, "fonts", F.when(F.col("n") == 0, "info").when(F.col("missing") > 0, "error").otherwise("pass"), F.array_join("names", ", "), F.when(F.col("missing") > 0, F.col("m_pages"))))
    out.append(finding(fonts.where("t3 > 0"), 4, "fonts-type3", "warn", "", F.col("t_pages")))

    # RGB and Lab: one row for each document
    rgb = lambda df, test, name: df.where(test).groupBy("doc_id").agg(F.count("*").alias(f"{name}_n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias(name))
    placed = real.select("doc_id", "family", F.array("page").alias("pages"))
    blend = page.where("blend = 'RGB'").groupBy("doc_id").agg(F.count("*").alias("blend_n"), distinct_sorted("page").alias("blend"))
    parts = [("image", placed, "family = 'RGB'"), ("vector", inv, "kind = 'rgb'"), ("gradient", inv, "kind = 'gradient' and family = 'RGB'"), ("labimage", placed, "family = 'Lab'"), ("labpaint", inv, "kind = 'lab'"), ("spot", inv, "kind = 'spot'"), ("registration", inv, "kind = 'registration'")]
    wide = reduce(lambda d, p: d.join(rgb(p[1], p[2], p[0]), "doc_id", "left"), parts, doc).join(blend, "doc_id", "left")
    images = facts["image"].groupBy("doc_id").agg(F.count("*").alias("images"))
    wide = every(wide.join(images, "doc_id", "left"))
    has = lambda n: F.col(f"{n}_n").isNotNull()
    any_rgb = has("image") | has("vector") | has("gradient") | has("blend")
    any_lab = has("labimage") | has("labpaint")
    both = lambda *names: F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(n), F.array().cast("array<int>")) for n in names]))))
    for k, (part, id) in enumerate((("image", "image-rgb"), ("vector", "vector-rgb"), ("gradient", "gradient-rgb"), ("blend", "blend-rgb"))):
        out.append(finding(wide.where(has(part) & ~F.col("allow_rgb")), 5 + k, id, "warn", F.col(f"{part}_n").cast("string"), F.col(part)))
    out.append(finding(wide.where(any_rgb & F.col("allow_rgb")), 9, "colour-rgb", "info", "", both("image", "vector", "gradient", "blend")))
    out.append(finding(wide.where(any_lab), 10, "colour-lab", "warn", "", both("labimage", "labpaint")))
    out.append(finding(wide.where(~any_rgb & ~any_lab), 11, "colour", "pass"))
    out.append(finding(wide.where(F.col("images").isNull() & (F.coalesce("inline_images", F.lit(0)) == 0)), 12, "images", "info"))

    # spot colours, registration
    spots = inv.where("kind = 'spot'").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("place"))).where("n <= 8")
    told = spots.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.col("label"), F.lit(" on "), page_list(F.col("pages"), 5)).alias("t")))), lambda x: x["t"]), "; ").alias("told"))
    out.append(finding(wide.where(has("spot")).join(told, "doc_id"), 13, "spot", F.when(F.col("allow_spot"), "info").otherwise("warn"), F.col("told"), F.col("spot")))
    room = page.select("doc_id", "page", (F.col("trim").isNotNull() & ((F.col("media.w") - F.col("trim.w") > 2) | (F.col("media.h") - F.col("trim.h") > 2))).alias("room"))
    registered = inv.where("kind = 'registration'").select("doc_id", F.explode("pages").alias("page")).join(room, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("room", F.lit(False))).alias("room"), distinct_sorted("page").alias("on"))
    out.append(finding(every(registered), 14, "registration", F.when(F.col("room"), "info").otherwise("warn"), "", F.col("on")))

    # total ink
    paid = inv.where("kind = 'cmyk' and tac is not null").select("doc_id", "tac", "pages", "label", "place")
    limits = steps_of(profiles, "max_ink")
    over = beyond(stepped(paid, F.col("tac"), [v + 0.5 for v in limits], F.col("pages"), above=True), profiles, "max_ink", limits, above=True)
    top = paid.groupBy("doc_id").agg(F.max_by("label", F.struct("tac", -F.col("place"))).alias("top"), F.max("tac").alias("most"))
    ink = every(top).where("max_ink > 0").join(over, ["doc_id", "profile_id"], "left")
    is_over = F.col("n").isNotNull()
    out.append(finding(ink, 15, "total-ink", F.when(is_over, "warn").otherwise("pass"), F.concat("top", F.lit(" = "), plain(F.col("most")), F.lit("%")), F.when(is_over, F.col("pages"))))

    # overprint, resolution, PDF/X, pages that could not be read
    lists = page.groupBy("doc_id").agg(distinct_sorted(F.when(F.col("overprint"), F.col("page"))).alias("overprint"), distinct_sorted(F.when(F.col("unreadable"), F.col("page"))).alias("unreadable"))
    lists = every(lists)
    out.append(finding(lists.where(F.size("overprint") > 0), 16, "overprint", "info", "", F.col("overprint")))
    grade = gradeable(facts["placement"])
    worst = best_row(grade.select("doc_id", "page", "seq", "ppi"), ["doc_id"], [F.col("ppi"), F.col("seq")]).select("doc_id", F.col("page").alias("w_page"), F.col("ppi").alias("w_ppi"))
    limits = steps_of(profiles, "min_ppi")
    low = beyond(stepped(grade, F.col("ppi") + 0.5, limits, F.array("page")), profiles, "min_ppi", limits)
    res = every(worst).join(low, ["doc_id", "profile_id"], "left")
    is_low = F.col("n").isNotNull()
    out.append(finding(res, 17, "image-ppi", F.when(is_low, "warn").otherwise("pass"), half_up(F.col("w_ppi")).cast("string"), F.when(is_low, F.col("pages")), (F.when(is_low, F.col("w_page")), F.when(is_low, half_up(F.col("w_ppi"))))))
    out.append(finding(every(doc), 18, "pdfx", "info", F.concat_ws(" ", "pdfx", "intent_id")))
    out.append(finding(lists.where(F.size("unreadable") > 0), 19, "unreadable", "info", "", F.col("unreadable")))

    if idml is not None:
        first = page.where("page = 0").select("doc_id", F.coalesce("trim", "media").alias("first"))
        cross = every(doc.join(idml.withColumnRenamed("page_count", "idml_pages"), "doc_id").join(first, "doc_id", "left"))
        out.append(finding(cross, 20, "idml-pages", F.when(F.col("idml_pages") == F.col("page_count"), "pass").otherwise("error"), F.concat_ws(" / ", F.col("page_count").cast("string"), F.col("idml_pages").cast("string"))))
        fits = F.exists("sizes", lambda s: (F.abs(s["w"] - F.col("first.w")) < 0.6) & (F.abs(s["h"] - F.col("first.h")) < 0.6))
        out.append(finding(cross.where((F.size("sizes") > 0) & ~fits), 21, "idml-size", "warn"))

    found = reduce(DataFrame.unionByName, out)
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("level"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "profile_id").orderBy(rank, "rule_ord")))


def summary(findings: DataFrame) -> DataFrame:
    """Findings by level, and the verdict: bad, warn or ok."""
    s = level_counts(findings, ["doc_id", "profile_id"])
    return s.withColumn("verdict", F.when(F.col("error") > 0, "bad").when(F.col("warn") > 0, "warn").otherwise("ok"))


LEVELS = {"corpus": [], "profile": ["profile_id"], "rule": ["profile_id", "id"], "document": ["profile_id", "doc_id"]}


def levels(findings: DataFrame) -> DataFrame:
    """Findings counted at four levels in one pass: over all, by profile, by profile and
    rule, by profile and document. scope names the level; keys that a level sums over are null. pages is the number
    of page references, verdict as in summary(). Only sums cross the exchange."""
    keys = ["profile_id", "id", "doc_id"]
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("level"))
    sums = [F.count_if(F.col("level") == s).alias(s) for s in SEVERITY]
    sets = findings.select(*keys, "level", "count", rank.alias("__rank")).groupingSets([[F.col(c) for c in some] for some in LEVELS.values()], *keys)
    out = sets.agg(F.grouping_id().alias("__g"), *sums, F.coalesce(F.sum("count"), F.lit(0)).alias("pages"), F.min("__rank").alias("__worst"))
    bit = lambda some: sum(1 << (2 - i) for i, c in enumerate(keys) if c not in some)
    scope = F.coalesce(*[F.when(F.col("__g") == bit(some), name) for name, some in LEVELS.items()])
    verdict = F.when(F.col("__worst") == 1, "bad").when(F.col("__worst") == 2, "warn").otherwise("ok")
    return out.select(scope.alias("scope"), *keys, *SEVERITY, "pages", verdict.alias("verdict"))


def problems(inv: DataFrame, profiles: DataFrame) -> DataFrame:
    """The colour inventory under each profile, with problem."""
    bad = F.col("kind").isin("rgb", "lab", "registration") | ((F.col("kind") == "gradient") & (F.col("family") == "RGB")) | ((F.col("kind") == "spot") & ~F.col("allow_spot"))
    forgiven = F.col("allow_rgb") & ((F.col("kind") == "rgb") | F.coalesce(F.col("family") == "RGB", F.lit(False)))
    return inv.crossJoin(F.broadcast(profiles.select("profile_id", "allow_rgb", "allow_spot"))).withColumn("problem", F.coalesce(bad, F.lit(False)) & ~forgiven)


def page_flags(facts: dict[str, DataFrame]) -> DataFrame:
    """For each page whether it has RGB, spot colours, registration and overprint."""
    inv = colours(all_paint(facts["paint"], facts["placement"], facts["image"]))
    hits = inv.select("doc_id", F.explode("pages").alias("page"), F.when((F.col("kind") == "rgb") | ((F.col("kind") == "gradient") & (F.col("family") == "RGB")), "rgb").when(F.col("kind") == "spot", "spot").when(F.col("kind") == "registration", "reg").alias("what"))
    hits = hits.unionByName(facts["placement"].where("family = 'RGB' and not mask and not soft_mask").select("doc_id", "page", F.lit("rgb").alias("what")))
    page = facts["page"]
    hits = hits.unionByName(page.where("blend = 'RGB'").select("doc_id", "page", F.lit("rgb").alias("what"))).unionByName(page.where("overprint").select("doc_id", "page", F.lit("overprint").alias("what")))
    seen = flags(hits, ["doc_id", "page"], **{w: F.col("what") == w for w in ("rgb", "spot", "reg", "overprint")})
    out = page.select("doc_id", "page").join(seen, ["doc_id", "page"], "left")
    return out.select("doc_id", "page", *[F.coalesce(w, F.lit(False)).alias(w) for w in ("rgb", "spot", "reg", "overprint")])


def page_marks(facts: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """Positioned marks of each page: box, level, id. Low resolution is an error here."""
    p = F.broadcast(profiles.select("profile_id", "allow_rgb", "allow_spot", "min_ppi", "max_ink"))
    img = facts["placement"].where("not mask and not soft_mask and box is not null").withColumn("ppi", F.least("ppi_x", "ppi_y")).crossJoin(p)
    low = (F.col("min_ppi") > 0) & F.col("ppi").isNotNull() & (F.col("ppi") + 0.5 < F.col("min_ppi"))
    rgb = (F.col("family") == "RGB") & ~F.col("allow_rgb")
    id = F.when(low, "image-ppi").when(rgb, "image-rgb").when(F.col("family") == "Lab", "colour-lab").otherwise("image-ok")
    level = F.when(low, "error").when(id == "image-ok", "ok").otherwise("warn")
    out = img.select("doc_id", "profile_id", "page", "seq", "box", level.alias("level"), id.alias("id"), (low & rgb).alias("also_rgb"))
    k = F.col("k")
    mark = facts["mark"].crossJoin(p)
    m_id = F.when((k == "rgb") & ~F.col("allow_rgb"), "vector-rgb").when(k == "lab", "colour-lab").when(k == "spot", "spot").when(k == "reg", "registration").when((k == "cmyk") & (F.col("max_ink") > 0) & (F.col("tac") > F.col("max_ink") + 0.5), "total-ink")
    mark = mark.withColumn("id", m_id).where("id is not null")
    m_level = F.when((k == "spot") & F.col("allow_spot"), "ok").otherwise("warn")
    return out.unionByName(mark.select("doc_id", "profile_id", "page", (F.col("seq") + (1 << 62)).alias("seq"), "box", m_level.alias("level"), "id", F.lit(False).alias("also_rgb")))


def facts_digest(facts: dict[str, DataFrame]) -> DataFrame:
    """doc_id, facts: of each document its pages, fonts, numbers of images and placements,
    spot colours, and what it says of its output."""
    doc = facts["doc"].where("error is null")
    font = facts["font"].groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("name", "type", "embedded", "subset"))).alias("fonts"))
    number = lambda t: facts[t].groupBy("doc_id").agg(F.count("*").alias(f"{t}s"))
    spot = facts["paint"].where("kind = 'spot'").select("doc_id", "label").union(facts["image"].select("doc_id", F.explode("spot"))).groupBy("doc_id").agg(distinct_sorted("label").alias("spots"))
    out = doc.join(font, "doc_id", "left").join(number("image"), "doc_id", "left").join(number("placement"), "doc_id", "left").join(spot, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    output = F.struct("pdfx", "has_intent", "intent_id").alias("output")
    return out.select("doc_id", F.struct(F.col("page_count").alias("pages"), "fonts", zero("images"), zero("placements"), "spots", output, F.struct("producer", "creator", "pdf_version").alias("meta")).alias("facts"))


def report_json(findings: DataFrame, profiles: DataFrame | None = None, facts: dict[str, DataFrame] | None = None) -> DataFrame:
    """One JSON text for each document and profile: the file, its summary and findings in
    order; with profiles the settings too, with facts a digest of them."""
    f = F.struct("place", "level", "id", "detail", "pages", "count")
    body = findings.groupBy("doc_id", "profile_id").agg(F.array_sort(F.collect_list(f)).alias("findings")).join(summary(findings), ["doc_id", "profile_id"])
    parts = [F.col("doc_id").alias("file"), "verdict", F.struct(*SEVERITY).alias("summary"), "findings"]
    if profiles is not None:
        body = body.join(profiles.select("profile_id", F.struct(*profiles.columns).alias("profile")), "profile_id")
        parts.insert(1, "profile")
    if facts is not None:
        body = body.join(facts_digest(facts), "doc_id", "left")
        parts.append("facts")
    return body.select("doc_id", "profile_id", F.to_json(F.struct(*parts)).alias("json"))


def report_text(findings: DataFrame) -> DataFrame:
    """A line for each finding that is not a pass, with up to 20 pages, counted from 1."""
    pages = F.when(F.size("pages") > 0, F.concat(F.lit(" [pages "), F.array_join(F.transform(F.slice("pages", 1, 20), lambda x: (x + 1).cast("string")), ", "), F.lit("]"))).otherwise("")
    line = F.concat(F.upper("level"), F.lit(": "), "id", F.when(F.col("detail") != "", F.concat(F.lit(" - "), "detail")).otherwise(""), pages)
    rows = findings.where("level != 'pass'").select("doc_id", "profile_id", F.struct("place", line.alias("line")).alias("x"))
    return rows.groupBy("doc_id", "profile_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias("text"))
