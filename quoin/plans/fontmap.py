"""Font substitution in IDML packages: plan on tables, edit texts, prove the edit."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from html import escape
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.text import clean_family, font_key
from quoin.lineage import cut, unsent
from quoin.operators import joins
from quoin.operators.hierarchy import given, pins
from quoin.plans.roles import MOODS
from quoin.plans.structure import NORMAL, effective_runs, resolved_styles
from quoin.sources.idml import scan_idml, tables, unzipped, zipped

STYLES = "Resources/Styles.xml"
TAG = re.compile(r"<(/?)([\w:.-]+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>")
# The parts of a definition that say its font, and what a font edit may touch.
PROPERTIES = re.compile(r"\s*<Properties>(.*?)</Properties>", re.S)
FONT = re.compile(r"<AppliedFont\b[^>]*>[^<]*</AppliedFont>")
STYLE = re.compile(r"\bFontStyle\s*=\s*(?:\"[^\"]*\"|'[^']*')")
FONT_SETTINGS = (r'\sFontStyle="[^"]*"', r"<AppliedFont\b[^>]*>[^<]*</AppliedFont>", r"<Properties>\s*</Properties>", r"<Properties\s*/>")


def font_map(entries: DataFrame) -> DataFrame:
    """(doc_id, key, family, style) from doc_id, from_family, from_style, to_family, to_style;
    entries without a target family are left out, a missing target style stays as it was."""
    named = entries.where(F.trim(F.coalesce("to_family", F.lit(""))) != "")
    style = F.trim(F.coalesce(F.nullif("to_style", F.lit("")), F.nullif("from_style", F.lit("")), F.lit("Regular")))
    return named.select("doc_id", font_key(F.col("from_family"), F.nullif("from_style", F.lit(""))).alias("key"), F.trim("to_family").alias("family"), style.alias("style"))


# Fixed value: what makes a font of a preset a headline's.
BOLDISH = "(?i)bold|black|heavy|semibold|demi|extrabold"


def preset(fonts: DataFrame, mood: str) -> DataFrame:
    """Entries of a font map for all fonts (doc_id, family, style) of documents: bold ones take
    the mood's headline font, others that of its body."""
    head, body, _ = MOODS[mood]
    bold = F.coalesce(F.col("style").rlike(BOLDISH), F.lit(False))
    pick = lambda k: F.when(bold, head[k]).otherwise(body[k])
    return fonts.select("doc_id", F.col("family").alias("from_family"), F.col("style").alias("from_style"), pick(0).alias("to_family"), pick(1).alias("to_style")).distinct()


def unknown_families(mapping: DataFrame, fonts: DataFrame) -> DataFrame:
    """(doc_id, family): target families that a document's font list (doc_id, family) doesn't have."""
    told = lambda df: df.select("doc_id", "family", F.lower(clean_family(F.col("family"))).alias("__clean"))
    return told(mapping).join(told(fonts).select("doc_id", "__clean").distinct(), ["doc_id", "__clean"], "left_anti").select("doc_id", "family").distinct()


def wanted(fonts: DataFrame, mapping: DataFrame) -> DataFrame:
    """fonts (doc_id, font, font_style, …) with want_font and want_style: the mapped font, or
    the same as before."""
    key = font_key(F.col("font"), F.col("font_style"))
    m = mapping.select(F.col("doc_id").alias("m_doc"), F.col("key").alias("m_key"), F.col("family").alias("m_family"), F.col("style").alias("m_style"))
    both = fonts.withColumn("__key", key).join(m, (F.col("doc_id") == F.col("m_doc")) & (F.col("__key") == F.col("m_key")), "left")
    both = both.withColumn("want_font", F.coalesce("m_family", "font")).withColumn("want_style", F.coalesce("m_style", "font_style", F.lit("Regular")))
    return both.drop("__key", "m_doc", "m_key", "m_family", "m_style")


def plan_styles(style: DataFrame, mapping: DataFrame) -> DataFrame:
    """Styles with new_font and new_font_style, set where the style must say its font itself.

    Styles that set a font or a style, and whose font in effect is mapped, take the target.
    All others keep what they set, unless they would then show another font than the one
    wanted, because of what they inherit: these are pinned to it (hierarchy.pins).
    """
    before = resolved_styles(style).select("doc_id", "kind", "self", "font", "font_style")
    rows = before.count()
    goal = wanted(before, mapping).select("doc_id", "kind", "self", F.col("font").alias("eff"), "want_font", "want_style", F.col("font_style").alias("eff_style"))
    now = style.join(unsent(goal, rows), ["doc_id", "kind", "self"])
    mapped = F.col("eff").isNotNull() & ((F.col("want_font") != F.col("eff")) | (F.col("want_style") != F.coalesce("eff_style", F.lit("Regular"))))
    takes = mapped & (given(F.col("font")).isNotNull() | given(F.col("font_style")).isNotNull())
    now = now.withColumn("new_font", F.when(takes, F.col("want_font")).otherwise(F.col("font"))).withColumn("new_font_style", F.when(takes, F.col("want_style")).otherwise(F.col("font_style")))
    # the parent as the chain goes on: the named style, if it is there, else the root of its kind
    para = F.col("kind") == "para"
    named = joins.normalised_key(F.col("based_on"), F.when(para, "ParagraphStyle/").otherwise("CharacterStyle/"))
    there = style.select(F.col("doc_id").alias("__doc"), F.col("kind").alias("__kind"), F.col("self").alias("__named"))
    now = now.withColumn("__key", named)
    now = now.join(unsent(there, rows), (now["doc_id"] == there["__doc"]) & (now["kind"] == there["__kind"]) & (now["__key"] == there["__named"]), "left").drop("__doc", "__kind", "__key")
    now = now.withColumn("__up", F.coalesce("__named", F.when(para & (F.col("self") != NORMAL), NORMAL))).drop("__named")
    # a style without any font hands on its style name as it was
    wants = {"__font": F.when(F.col("eff").isNotNull(), F.col("want_font")), "__style": F.when(F.col("eff").isNotNull(), F.col("want_style")).otherwise(F.coalesce("eff_style", F.lit("Regular")))}
    now = now.withColumns(wants).withColumn("__own_style", F.coalesce(given(F.col("new_font_style")), F.when(F.col("__up").isNull(), "Regular")))
    now = pins(now, ["doc_id", "kind"], key="self", parent="__up", fields={"font": ("new_font", "__font"), "style": ("__own_style", "__style")}, rows=rows)
    pinned = F.col("pinned") & F.col("eff").isNotNull()
    now = now.withColumn("new_font", F.when(pinned, F.col("want_font")).otherwise(F.col("new_font"))).withColumn("new_font_style", F.when(pinned, F.col("want_style")).otherwise(F.col("new_font_style")))
    return now.drop("eff", "eff_style", "want_font", "want_style", "pinned", "__up", "__font", "__style", "__own_style")


def plan_runs(run: DataFrame, style: DataFrame, mapping: DataFrame) -> DataFrame:
    """Runs with e (before), want_font, want_style and visible characters n."""
    effective = effective_runs(run, resolved_styles(style))
    fonts = effective.withColumn("font", F.col("e.font")).withColumn("font_style", F.col("e.font_style"))
    return wanted(fonts, mapping)


def verify(before: dict[str, DataFrame], after: dict[str, DataFrame], mapping: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """For each document: whether texts and structure are the same and every run has the
    font it should have; how many runs and characters changed.

    parts, if given: the XML parts (doc_id, name, xml) of the packages before and after; ok
    then also says that nothing but font settings differs in any of them (only_fonts)."""
    key = ["doc_id", "story_id", "para_ord", "run_ord"]
    old = plan_runs(before["run"], before["style"], mapping).select(*key, F.col("text").alias("text_a"), "n", "font", F.coalesce("font_style", F.lit("Regular")).alias("font_style"), "want_font", "want_style")
    new = effective_runs(after["run"], resolved_styles(after["style"])).select(*key, F.col("text").alias("text_b"), F.col("e.font").alias("got"), F.coalesce("e.font_style", F.lit("Regular")).alias("got_style"))
    both = old.join(new, key, "full_outer")
    seen = F.col("n") > 0
    right = F.col("font").isNull() | ((F.col("got") == F.col("want_font")) & (F.col("got_style") == F.col("want_style")))
    changed = seen & F.col("font").isNotNull() & (~F.col("got").eqNullSafe(F.col("font")) | (F.col("got_style") != F.col("font_style")))
    out = both.groupBy("doc_id").agg(
        F.bool_and(F.col("text_a").isNotNull() & F.col("text_b").isNotNull()).alias("same_structure"),
        F.bool_and(F.col("text_a").eqNullSafe(F.col("text_b"))).alias("same_text"), F.count_if(seen).alias("total"), F.count_if(changed).alias("changed"), F.count_if(seen & ~F.coalesce(changed, F.lit(False))).alias("unchanged"),
        F.coalesce(F.sum(F.when(changed, F.col("n"))), F.lit(0)).alias("chars"), F.count_if(seen & ~F.coalesce(right, F.lit(False))).alias("mismatches"),
    )
    if parts is not None:
        a, b = (p.select("doc_id", "name", F.md5(strip_fonts(F.col("xml"))).alias(f"sum_{s}")) for p, s in zip(parts, "ab"))
        same = a.join(b, ["doc_id", "name"], "full_outer").groupBy("doc_id").agg(F.bool_and(F.col("sum_a").eqNullSafe(F.col("sum_b"))).alias("only_fonts"))
        out = out.join(same, "doc_id", "left")
    only = F.coalesce("only_fonts", F.lit(False)) if parts is not None else F.lit(True)
    return out.withColumn("ok", F.col("same_text") & F.col("same_structure") & (F.col("mismatches") == 0) & only)


def xml_parts(files: DataFrame) -> DataFrame:
    """(doc_id, name, xml) of the XML parts of packages (doc_id, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, content in zip(b["doc_id"], b["content"]):
                yield pd.DataFrame([(doc_id, n, x) for n, x in unzipped(bytes(content)).items()], columns=["doc_id", "name", "xml"])

    return files.select("doc_id", "content").mapInPandas(rows, "doc_id string, name string, xml string")


def strip_fonts(xml):
    """Column: XML without what a font edit may touch, to compare two texts by."""
    for pattern in FONT_SETTINGS:
        xml = F.regexp_replace(xml, pattern, "")
    return xml


ELEMENTS = "doc_id string, name string, path string, parent string, own string, whole string"


def element_rows(xml: str) -> list[tuple[str, str, str, str]]:
    """(path, parent's path, hash of the element alone, hash with all below it) of the elements of a
    part, without font settings. A step of a path is the element's name with its Self, or with its turn among
    those of its name without one, so that an element put between others doesn't shift them."""
    out: list[tuple[str, str, str, str]] = []
    text = lambda t: (t or "").strip()
    digest = lambda *parts: hashlib.md5("\0".join(parts).encode("utf-8", "surrogatepass")).hexdigest()

    def kept(e) -> bool:
        return e.tag != "AppliedFont" and not (e.tag == "Properties" and not text(e.text) and not any(map(kept, e)))

    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, RecursionError):
        return [("/", "", digest(xml), digest(xml))]
    todo, order, below = [(root, f"/{root.tag}", "")], [], {}
    while todo:
        e, path, parent = todo.pop()
        settings = [f"{k}={v}" for k, v in sorted(e.attrib.items()) if k != "FontStyle"]
        kids = [k for k in e if kept(k)]
        # texts between elements belong to the element that they stand in
        own = digest(str(e.tag), *settings, text(e.text), *(text(k.tail) for k in e if text(k.tail)))
        order.append((path, parent, own))
        turns: dict[str, int] = {}
        for k in kids:
            mark = k.get("Self")
            if mark is None:
                turns[k.tag] = turns.get(k.tag, 0) + 1
                mark = str(turns[k.tag])
            below.setdefault(path, []).append(f"{path}/{k.tag}[{mark}]")
            todo.append((k, f"{path}/{k.tag}[{mark}]", path))
    whole: dict[str, str] = {}
    for path, _, own in reversed(order):  # kids come after their parents
        whole[path] = digest(own, *(whole[k] for k in below.get(path, [])))
    return [(path, parent, own, whole[path]) for path, parent, own in order]


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, name, path, change) of the elements in which two sets of XML parts (doc_id, name, xml)
    differ, font settings apart: 'changed' in itself, 'moved' (its kids are the same in another
    order), 'added' or 'removed' with all below it, told once at its top.

    Parts are compared as wholes first; only those that differ are taken apart. Of these, elements
    whose hash with all below is the same on both sides drop out, so what is joined is the way
    from the root to each change. Parts on one side alone are one row with the path '/'."""
    key = ["doc_id", "name"]
    sums = [p.select(*key, F.md5(strip_fonts(F.col("xml"))).alias(f"sum_{s}"), F.lit(True).alias(f"in_{s}")) for p, s in ((before, "a"), (after, "b"))]
    unlike = cut(sums[0].join(sums[1], key, "full_outer").where(~F.col("sum_a").eqNullSafe(F.col("sum_b"))))
    alone = unlike.where("in_a is null or in_b is null").select(*key, F.lit("/").alias("path"), F.when(F.col("in_a").isNull(), "added").otherwise("removed").alias("change"))
    both = unlike.where("in_a and in_b").select(*key)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, name, xml in zip(b["doc_id"], b["name"], b["xml"]):
                yield pd.DataFrame([(doc_id, name, *r) for r in element_rows(xml)], columns=[c.split()[0] for c in ELEMENTS.split(", ")])

    a, b = (p.join(both, key, "left_semi").select(*key, "xml").mapInPandas(rows, ELEMENTS) for p in (before, after))
    step = [*key, "path"]
    met = cut(a.select(*step, F.col("parent").alias("parent_a"), F.col("own").alias("own_a"), F.col("whole").alias("whole_a")).join(b.select(*step, F.col("parent").alias("parent_b"), F.col("own").alias("own_b"), F.col("whole").alias("whole_b")), step, "full_outer").where(~F.col("whole_a").eqNullSafe(F.col("whole_b"))))
    changed = met.where("own_a != own_b").select(*step, F.lit("changed").alias("change"))
    # one side alone, under a parent that both have
    shared = met.where("whole_a is not null and whole_b is not null").select(*key, F.col("path").alias("__up"))
    single = met.where("whole_a is null or whole_b is null").withColumn("__up", F.coalesce("parent_a", "parent_b"))
    single = single.join(shared, [*key, "__up"], "left_semi").select(*step, F.when(F.col("whole_a").isNull(), "added").otherwise("removed").alias("change"), "__up")
    # the same in itself, and so are all its kids, yet not as a whole: another order
    under = met.select(*key, F.coalesce("parent_a", "parent_b").alias("path")).distinct()
    moved = met.where("own_a = own_b").join(under, step, "left_anti").select(*step, F.lit("moved").alias("change"))
    return alone.unionByName(changed).unionByName(single.drop("__up")).unionByName(moved)


# ------------------------------------------------------------------ editing texts
def splice(xml: str, tag: re.Match, family: str, style: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, text) that give the element of a start tag its font: the style is
    an attribute, the family a child of the properties; each replaces its like or is added."""
    quoted = style.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    font = f'<AppliedFont type="string">{escape(family, quote=False)}</AppliedFont>'
    old = STYLE.search(xml, tag.start(3), tag.end(3))
    tail = len(tag[3]) - len(tag[3].rstrip())
    edits = [(*old.span(), f'FontStyle="{quoted}"') if old else (tag.end(3) - tail, tag.end(3), f' FontStyle="{quoted}"')]
    properties = PROPERTIES.match(xml, tag.end())
    if properties is None:
        return [*edits, (tag.end(), tag.end(), f"<Properties>{font}</Properties>")]
    old = FONT.search(xml, properties.start(1), properties.end(1))
    return [*edits, (*old.span(), font) if old else (properties.end(1), properties.end(1), font)]


def edited(xml: str, edits: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, text in sorted(edits):
        out += [xml[at:s], text]
        at = e
    return "".join([*out, xml[at:]])


def edit_styles(xml: str, new: dict[tuple[str, str], tuple[str, str]]) -> str:
    """new: (kind, self) -> (family, style)."""
    edits = []
    for m in TAG.finditer(xml):
        kind = {"ParagraphStyle": "para", "CharacterStyle": "char"}.get(m[2])
        own = re.search(r'\bSelf="([^"]*)"', m[3])
        if kind and not m[1] and not m[4] and own and (kind, own[1]) in new:
            edits += splice(xml, m, *new[kind, own[1]])
    return edited(xml, edits)


def edit_story(xml: str, new: dict[int, tuple[str, str]]) -> str:
    """Set the fonts of character ranges, by their numbers in the order of their start tags."""
    ranges = [m for m in TAG.finditer(xml) if m[2] == "CharacterStyleRange" and not m[1]]
    return edited(xml, [e for n, m in enumerate(ranges) if n in new and not m[4] for e in splice(xml, m, *new[n])])


def _rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, content, styles, stories in zip(b["doc_id"], b["content"], b["styles"], b["stories"]):
            parts = unzipped(bytes(content))
            changed = {}
            if len(styles) and STYLES in parts:
                changed[STYLES] = edit_styles(parts[STYLES], {(s["kind"], s["self"]): (s["font"], s["font_style"]) for s in styles})
            for s in stories:
                if s["src"] in parts:
                    changed[s["src"]] = edit_story(parts[s["src"]], {f["range_ord"]: (f["font"], f["font_style"]) for f in s["fonts"]})
            with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                everything = {n: z.read(n) for n in z.namelist()}
            files = sorted(n for n, x in changed.items() if x != parts[n])
            rows.append((doc_id, zipped(everything | {n: changed[n].encode() for n in files}), files))
        yield pd.DataFrame(rows, columns=["doc_id", "content", "changed"])


def rewrite(files: DataFrame, t: dict[str, DataFrame], mapping: DataFrame) -> DataFrame:
    """(doc_id, content, changed): packages with fonts substituted by the map.

    Styles are planned on tables (plan_styles); then every run whose font would still not
    be the wanted one gets it in its own range. Only start tags and their properties are
    edited; all other bytes of a part stay.
    """
    new = plan_styles(t["style"], mapping)
    differ = ~F.col("new_font").eqNullSafe(F.col("font")) | ~F.col("new_font_style").eqNullSafe(F.col("font_style"))
    styles = new.where(differ).groupBy("doc_id").agg(F.collect_list(F.struct("kind", "self", F.col("new_font").alias("font"), F.col("new_font_style").alias("font_style"))).alias("styles"))
    key = ["doc_id", "story_id", "para_ord", "run_ord"]
    goal = plan_runs(t["run"], t["style"], mapping)
    trial = new.withColumn("font", F.col("new_font")).withColumn("font_style", F.col("new_font_style")).drop("new_font", "new_font_style")
    got = effective_runs(t["run"], resolved_styles(trial)).select(*key, F.col("e.font").alias("got"), F.coalesce("e.font_style", F.lit("Regular")).alias("got_style"))
    own = (F.col("c_font").isNotNull() | F.col("c_font_style").isNotNull()) & ((F.col("want_font") != F.col("font")) | (F.col("want_style") != F.coalesce("font_style", F.lit("Regular"))))
    wrong = F.col("font").isNotNull() & (~F.col("got").eqNullSafe(F.col("want_font")) | (F.col("got_style") != F.col("want_style")) | own)
    # runs outside a character range follow their paragraph's style, which is planned already
    runs = goal.join(got, key).where(wrong & F.col("range_ord").isNotNull()).select("doc_id", "story_id", F.struct("range_ord", F.col("want_font").alias("font"), F.col("want_style").alias("font_style")).alias("f"))
    fonts = runs.groupBy("doc_id", "story_id").agg(F.collect_set("f").alias("fonts")).join(t["story"].select("doc_id", "story_id", "src"), ["doc_id", "story_id"])
    stories = fonts.groupBy("doc_id").agg(F.collect_list(F.struct("src", "fonts")).alias("stories"))
    full = files.select("doc_id", "content").join(styles, "doc_id", "left").join(stories, "doc_id", "left")
    empty = lambda c, df: F.coalesce(c, F.array().cast(df.schema[c].dataType))
    full = full.withColumn("styles", empty("styles", styles)).withColumn("stories", empty("stories", stories))
    return full.mapInPandas(_rewrite, "doc_id string, content binary, changed array<string>")


def rescan(files: DataFrame) -> dict[str, DataFrame]:
    return tables(scan_idml(files))
