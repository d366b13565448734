"""What an IDML document says of itself: the cascade, font usage, frames and structural findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions import affine
from quoin.functions.numbers import places
from quoin.functions.text import clean_family, is_default_paragraph, visible_length
from quoin.lineage import cut, unsent
from quoin.operators import aggregates, joins
from quoin.operators.hierarchy import FIELDS, cascade, resolve_chain, resolve_swatches

NORMAL = "ParagraphStyle/$ID/NormalParagraphStyle"


def resolved_styles(style: DataFrame) -> DataFrame:
    """Both style tables resolved along their chains; paragraph styles end in the root style."""
    out = []
    for kind, prefix, root in (("para", "ParagraphStyle/", NORMAL), ("char", "CharacterStyle/", None)):
        own = style.where(F.col("kind") == kind)
        own = own.withColumn("based_on", joins.normalised_key(F.col("based_on"), prefix))
        out.append(resolve_chain(own, ["doc_id"], root=root).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1])


def effective_runs(run: DataFrame, resolved: DataFrame) -> DataFrame:
    """Runs with e, the fields in effect, and n, their visible characters."""
    out = run
    is_para, is_root = F.col("kind") == "para", (F.col("kind") == "para") & (F.col("self") == NORMAL)
    sizes = resolved.agg(F.count_if(is_para).alias("para"), F.count_if(~is_para).alias("char"), F.count_if(is_root).alias("root")).first()
    for kind, col, prefix in (("para", "para_style", "ParagraphStyle/"), ("char", "char_style", "CharacterStyle/")):
        dim = resolved.where(F.col("kind") == kind).select(F.col("doc_id").alias(f"{kind}_doc"), F.col("self").alias(f"{kind}_self"), F.struct(*FIELDS).alias(kind))
        key = joins.normalised_key(F.col(col), prefix)
        out = out.withColumn(f"{kind}_key", key).join(unsent(dim, sizes[kind]), (F.col("doc_id") == F.col(f"{kind}_doc")) & (F.col(f"{kind}_key") == F.col(f"{kind}_self")), "left").drop(f"{kind}_doc", f"{kind}_self", f"{kind}_key")
    # a paragraph without a known style still has the root style
    root = resolved.where(is_root).select(F.col("doc_id").alias("root_doc"), F.struct(*FIELDS).alias("root"))
    out = out.join(unsent(root, sizes["root"]), F.col("doc_id") == F.col("root_doc"), "left").drop("root_doc")
    own = lambda p: F.struct(*[F.col(f"{p}_{f}").alias(f) for f in FIELDS])
    return out.withColumn("e", cascade(own("c"), F.col("char"), own("p"), F.coalesce("para", "root"))).withColumn("n", visible_length(F.col("text")))


def font_usage(effective: DataFrame, font: DataFrame) -> DataFrame:
    """Characters of each family and style, how they were set, and the worst status of the font."""
    used = effective.where("n > 0").withColumn("family", clean_family(F.col("e.font"))).withColumn("style", F.coalesce("e.font_style", F.lit("Regular")))
    over = F.coalesce(F.col("c_font") != "", F.lit(False))
    total = used.groupBy("doc_id", "family", "style").agg(F.sum("n").alias("chars"), F.sum(F.when(over, 0).otherwise(F.col("n"))).alias("via_style"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias("via_override"))
    key = lambda f, s: F.concat_ws("|", f, F.lower(s))
    # a font matches by its clean family, so the raw names need no second key
    known = font.withColumn("key", key(clean_family(F.col("family")), F.col("style"))).select("doc_id", "key", "status")
    return joins.worst_status(total.withColumn("key", key(F.col("family"), F.col("style"))), known, ["doc_id"], keys=[("key", "key")], status="status", ranks={"NotAvailable": 3, "Substituted": 2, "Installed": 1}).drop("key")


def text_totals(effective: DataFrame) -> DataFrame:
    used = effective.where("n > 0")
    some = lambda test: F.sum(F.when(F.coalesce(test, F.lit(False)), F.col("n")).otherwise(0))
    return used.groupBy("doc_id").agg(F.sum("n").alias("chars"), some(F.col("c_font") != "").alias("run_font_chars"), some(F.col("c_font_style") != "").alias("run_style_chars"), some(is_default_paragraph(F.col("para_style"))).alias("default_style_chars"))


def placed_items(item: DataFrame, page: DataFrame) -> DataFrame:
    """Items of spreads with page_id, the page that holds them, and its number."""
    pages = page.where("not is_master")
    out = joins.assign_boxes(item.where("not is_master"), pages, ["doc_id", "spread_id"], item="item_id", page="page_id", order="ord")
    return out.join(pages.select("doc_id", "page_id", F.col("ord").alias("page")), ["doc_id", "page_id"], "left")


def frame_support(frames: DataFrame, story: DataFrame) -> DataFrame:
    """Text frames with level (full, approx, unsupported) and reasons."""
    s = story.select("doc_id", "story_id", "tables", "footnotes", "anchored", F.lit(True).alias("has_story"))
    f = frames.join(s, ["doc_id", "story_id"], "left")
    m = F.col("world")
    known = F.coalesce("has_story", F.lit(False))
    # The reasons, in the order that they are told.
    hard = [(~known, "story not found"), (known & (F.col("tables") > 0), "table in story"), (known & (F.col("footnotes") > 0), "footnotes in story"), (known & (F.col("anchored") > 0), "anchored objects in story")]
    soft = [
        (F.col("next").isNotNull() | F.col("prev").isNotNull(), "threaded text"), (F.col("columns") > 1, "multiple columns"), (~F.col("axis_rect"), "non-rectangular frame"),
        (affine.skewed(m) | affine.scaled(m) | affine.flipped(m), "scaled, skewed or mirrored"), (F.col("vj") == "JustifyAlign", "vertically justified"), (F.col("auto_size") != "Off", "auto-sizing frame"),
    ]
    listed = lambda some: F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(w)) for t, w in some]), lambda x: x.isNotNull())
    f = f.withColumn("hard", listed(hard)).withColumn("soft", listed(soft))
    level = F.when(F.size("hard") > 0, "unsupported").when(F.size("soft") > 0, "approx").otherwise("full")
    return f.withColumn("level", level).withColumn("reasons", F.concat("hard", "soft")).drop("hard", "soft", "has_story", "tables", "footnotes", "anchored")


def frame_stats(frames: DataFrame, story: DataFrame) -> DataFrame:
    m = F.col("world")
    f = frames.join(story.select("doc_id", "story_id", F.col("text").alias("story_text")), ["doc_id", "story_id"], "left")
    return aggregates.counts(
        f, ["doc_id"], total=F.lit(True), on_pages=F.col("page").isNotNull(), off_page=F.col("page").isNull(), hidden=F.col("hidden"), threaded=F.col("next").isNotNull() | F.col("prev").isNotNull(), non_rect=~F.col("axis_rect"),
        multi_column=F.col("columns") > 1, inset=F.exists("inset", lambda v: v > 0), auto_sizing=F.col("auto_size") != "Off", scaled=affine.skewed(m) | affine.scaled(m) | affine.flipped(m), in_group=F.col("parent_id").isNotNull(), empty=F.trim("story_text") == "",
    )


def rotations(frames: DataFrame) -> DataFrame:
    return frames.groupBy("doc_id", affine.rotation_bucket(affine.angle(F.col("world"))).alias("bucket")).agg(F.count("*").alias("frames"))


def page_sizes(page: DataFrame) -> DataFrame:
    size = F.concat_ws("x", places(F.col("width_pt")).cast("string"), places(F.col("height_pt")).cast("string"))
    return aggregates.histogram(page.where("not is_master"), ["doc_id"], size, page="ord").drop("pages")


def spread_sizes(page: DataFrame) -> DataFrame:
    """How many spreads have how many pages."""
    per = page.where("not is_master").groupBy("doc_id", "spread_id").agg(F.count("*").alias("pages"))
    return per.groupBy("doc_id", "pages").agg(F.count("*").alias("spreads"))


def art_stats(items: DataFrame) -> DataFrame:
    """Shapes, what is placed in them (linked, embedded) and texts on paths."""
    art = items.where("kind not in ('TextFrame', 'Group')")
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).alias(n)
    return art.groupBy("doc_id").agg(F.count("*").alias("shapes"), total(F.greatest(F.size(F.coalesce("placed", F.array().cast("array<string>"))), F.lit(0)), "placed"), total("linked", "linked"), total("embedded", "embedded"), total("text_paths", "text_paths"))


def art_formats(items: DataFrame) -> DataFrame:
    """Placed files by format: the kind of the placed element."""
    placed = items.where("kind not in ('TextFrame', 'Group')").select("doc_id", F.explode("placed").alias("placed"))
    return placed.groupBy("doc_id", F.substring_index("placed", ":", 1).alias("format")).agg(F.count("*").alias("n"))


def story_stats(story: DataFrame, orphans: DataFrame) -> DataFrame:
    """Stories by what they hold; orphans: doc_id, story_id of those that nothing refers to."""
    some = {"empty": F.trim("text") == "", **{f"with_{c}": F.col(c) > 0 for c in ("tables", "footnotes", "anchored", "specials", "line_breaks")}}
    lost = orphans.select("doc_id", "story_id").distinct().withColumn("lost", F.lit(True))
    told = story.join(lost, ["doc_id", "story_id"], "left")
    return told.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("lost").alias("orphan"), *[F.count_if(c).alias(n) for n, c in some.items()], F.coalesce(F.sum("paragraphs"), F.lit(0)).alias("paragraphs"))


def layer_stats(layer: DataFrame, items: DataFrame) -> DataFrame:
    """Layers with the number of their text frames."""
    frames = items.where("kind = 'TextFrame' and not is_master").groupBy("doc_id", F.col("layer_id").alias("self")).agg(F.count("*").alias("frames"))
    return layer.join(frames, ["doc_id", "self"], "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


def word_counts(story: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Words of all texts: runs of characters other than white space."""
    n = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda w: w != ""))
    return story.groupBy(*by).agg(F.sum(n).alias("words"))


def swatch_usage(items: DataFrame, effective: DataFrame, swatches: DataFrame) -> DataFrame:
    """Swatches in use: by items' fills and strokes, and once for each frame by its text."""
    shown = items.where("not hidden and kind != 'Group'")
    use = shown.select("doc_id", F.explode(F.array("fill", "stroke")).alias("id"), "page")
    frames = items.where("kind = 'TextFrame' and not hidden and page is not null").select("doc_id", "story_id", "item_id", "page")
    text = effective.where(F.trim("text") != "").select("doc_id", "story_id", F.col("e.fill").alias("id")).distinct()
    use = use.unionByName(frames.join(text, ["doc_id", "story_id"]).select("doc_id", "id", "page")).where(F.col("id").isNotNull() & (F.col("id") != "") & ~F.col("id").rlike("Swatch/None$"))
    out = use.groupBy("doc_id", "id").agg(F.count("*").alias("uses"), aggregates.distinct_sorted("page").alias("pages"))
    return out.join(resolve_swatches(swatches, ["doc_id"]).select("doc_id", "id", "name", F.col("kind"), "rgb", "inks", "reversed"), ["doc_id", "id"], "left").withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def compare_with_pdf(items: DataFrame, pages: DataFrame, story: DataFrame, pdf_text: DataFrame) -> DataFrame:
    """Each page's status by the words of its frames in the text of the PDF page of the same number.

    pdf_text: doc_id, page, text; a page that it lacks is no-pdf-page.
    """
    from quoin.functions.text import words
    from quoin.operators import ordered

    key = ["doc_id", "page"]
    told = lambda df, *cols: df.select(*cols, F.posexplode(words(F.col("text"))).alias("pos", "word"))
    frames = items.where("kind = 'TextFrame' and not hidden and page is not null").select("doc_id", "page", "item_id", "story_id")
    frame_words = frames.join(told(story, "doc_id", "story_id"), ["doc_id", "story_id"])
    known = pdf_text.select("doc_id", "page", F.lit(True).alias("has_pdf"))
    on = pages.select("doc_id", F.col("ord").alias("page")).join(known, key, "left")
    checked = ordered.contained_words(frame_words.join(known.drop("has_pdf"), key), told(pdf_text, *key), key, ["item_id"])
    return ordered.page_verdicts(ordered.frame_verdicts(checked, key, ["item_id"]), on, key, F.coalesce("has_pdf", F.lit(False))).drop("has_pdf")


def findings(t: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, level, code, refs, count) of all documents; refs are the first 20 in the order met:
    items as they come in the document, stories as it lists them, others by name."""
    # fourteen reports read these two: they are computed once
    items = cut(placed_items(t["item"], t["page"]))
    frames, masters = items.where("kind = 'TextFrame'"), t["item"].where("kind = 'TextFrame' and is_master")
    effective = cut(effective_runs(t["run"], resolved_styles(t["style"])))
    used = cut(swatch_usage(items, effective, t["swatch"]))  # three reports read it
    stories = t["story"].select("doc_id", "story_id")
    named = masters.select("doc_id", "story_id").unionByName(frames.select("doc_id", "story_id")).unionByName(t["story"].select("doc_id", F.explode("anchored_stories").alias("story_id")))
    everything = frames.select("doc_id", "item_id").unionByName(masters.select("doc_id", "item_id"))

    listed = t["story"].join(t["manifest"].where("kind = 'Story'").select("doc_id", "src", F.col("ord").alias("nth")), ["doc_id", "src"], "left").select("doc_id", "story_id", "nth")

    def report(rows: DataFrame, level: str, code: str, ref: str | Column, order: str | None = None) -> DataFrame:
        if order == "nth":
            rows = rows.join(listed, ["doc_id", "story_id"], "left")
        ref = F.col(ref) if isinstance(ref, str) else ref
        # the first 20, found without gathering the others
        counts = rows.groupBy("doc_id").agg(F.count("*").alias("count"))
        refs = rows.select("doc_id", ref.alias("ref"), (F.col(order) if order else F.lit(0)).alias("nth")).where("ref is not null").groupBy("doc_id", "ref").agg(F.min("nth").alias("nth"))
        refs = aggregates.examples(refs, ["doc_id"], [F.col("nth").asc_nulls_last(), F.col("ref")], 20)
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("example", "ref"))), lambda x: x["ref"])
        out = counts.join(refs.groupBy("doc_id").agg(in_order.alias("refs")), "doc_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<string>")))
        return out.select("doc_id", F.lit(level).alias("level"), F.lit(code).alias("code"), "refs", "count")

    parts = t["manifest"]
    have = t["story"].select("doc_id", "src")
    art = items.where("kind not in ('TextFrame', 'Group')")
    totals = text_totals(effective)
    fonts = font_usage(effective, t["font"])
    missing = parts.where("kind = 'Spread' and not there")  # whatever the part is named, and whether it has pages or not
    out = [
        report(missing, "error", "missing-spread", "src", "ord"),
        report(joins.dangling(parts.where("kind = 'Story'"), have, [("doc_id", "doc_id"), ("src", "src")]), "error", "missing-story", "src", "ord"),
        report(joins.dangling(frames, stories, [("doc_id", "doc_id"), ("story_id", "story_id")]), "error", "frame-without-story", "item_id", "ord"),
        report(joins.unreferenced(stories, named, [("doc_id", "doc_id"), ("story_id", "story_id")]), "info", "orphan-stories", "story_id", "nth"),
        report(joins.broken_links(frames, ["doc_id"], "item_id", ["next", "prev"], everything), "warn", "broken-thread", "item_id", "ord"),
        report(joins.in_several(frames, ["doc_id"], "story_id", F.col("next").isNotNull() | F.col("prev").isNotNull()), "warn", "story-in-several-frames", "story_id", "nth"),
        report(art.where("linked > 0"), "info", "linked-artwork", "item_id", "ord"),
        report(art.where("text_paths > 0"), "warn", "text-on-path", "item_id", "ord"),
        report(totals.where("run_font_chars > 0"), "warn", "run-level-fonts", F.col("run_font_chars").cast("string")),
        report(fonts.where("status in ('NotAvailable', 'Substituted')"), "warn", "fonts-unavailable", F.concat_ws(" ", "family", "style")),
        report(t["layer"].where("not visible"), "info", "hidden-layers", "name"),
        report(used.where("kind = 'rgb'"), "warn", "rgb-swatches", "name"),
        report(used.where("kind = 'spot'"), "info", "spot-swatches", "name"),
        report(used.where("kind = 'registration'"), "warn", "registration-swatch", "name"),
    ]
    return reduce(DataFrame.unionByName, out)


def story_styles(run: DataFrame, style: DataFrame) -> DataFrame:
    """(doc_id, story_id, styles): the names of the paragraph styles of each story, each once, in the order met.
    A style that the document doesn't define shows the last part of its id."""
    met = run.groupBy("doc_id", "story_id", "para_style").agg(F.min("para_ord").alias("first")).where("para_style is not null")
    names = style.where("kind = 'para'").select(F.col("doc_id").alias("s_doc"), F.col("self").alias("s_self"), F.col("name").alias("s_name"))
    key = joins.normalised_key(F.col("para_style"), "ParagraphStyle/")
    named = met.withColumn("key", key).join(names, (F.col("doc_id") == F.col("s_doc")) & (F.col("key") == F.col("s_self")), "left")
    shown = F.regexp_replace(F.coalesce("s_name", F.substring_index("para_style", "/", -1)), r"^\$ID/", "")
    named = named.withColumn("shown", shown).where("shown != ''").groupBy("doc_id", "story_id", "shown").agg(F.min("first").alias("first"))
    return named.groupBy("doc_id", "story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "shown"))), lambda x: x["shown"]).alias("styles"))


def structure_json(items: DataFrame, pages: DataFrame, story: DataFrame, run: DataFrame | None = None, style: DataFrame | None = None, layer: DataFrame | None = None, limit: int = 300) -> DataFrame:
    """One JSON text for each page: its spread and size, and its frames in order, with their place on
    the page, layer, threads, readiness, and the first characters of their text.

    run and style, if given, add the names of the paragraph styles of each frame's story; layer the names of layers."""
    f = items.where("kind = 'TextFrame' and page is not null").join(story.select("doc_id", "story_id", F.substring("text", 1, limit).alias("text")), ["doc_id", "story_id"], "left")
    f = frame_support(f, story)
    f = f.join(story_styles(run, style), ["doc_id", "story_id"], "left") if run is not None and style is not None else f.withColumn("styles", F.lit(None).cast("array<string>"))
    named = layer.select("doc_id", F.col("self").alias("layer_id"), F.col("name").alias("layer")) if layer is not None else None
    f = f.join(named, ["doc_id", "layer_id"], "left") if named is not None else f.withColumn("layer", F.col("layer_id"))
    p = pages.where("not is_master").select("doc_id", F.col("ord").alias("page"), F.col("spread_id").alias("spread"), "name", "width_pt", "height_pt", "master", F.col("box").alias("of"))
    f = f.join(p.select("doc_id", "page", "of"), ["doc_id", "page"])
    told = F.struct(
        "ord", F.col("item_id").alias("id"), F.col("story_id").alias("story"), "layer", "hidden", (F.col("box.x") - F.col("of.x")).alias("x"), (F.col("box.y") - F.col("of.y")).alias("y"), F.col("box.w").alias("w"), F.col("box.h").alias("h"),
        affine.angle(F.col("world")).alias("angle"), F.col("vj").alias("vertical"), "columns", "inset", F.col("next").alias("threaded_to"), F.col("prev").alias("threaded_from"), F.col("level").alias("readiness"), "reasons", F.coalesce("styles", F.array().cast("array<string>")).alias("paragraph_styles"), "text",
    )
    frames = f.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(told)).alias("frames"))
    return p.join(frames, ["doc_id", "page"], "left").select("doc_id", "page", F.to_json(F.struct("page", "spread", "name", "width_pt", "height_pt", "master", "frames")).alias("json"))
