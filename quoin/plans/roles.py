"""Roles of paragraph styles, masters, and type moods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.numbers import plain
from quoin.functions.text import escape_attribute, is_bold
from quoin.operators.aggregates import best_row

# What names mean, in order; the first that matches counts.
NAMES = (
    ("card-heading", r"card.*(head|heading|title|name)|(head|heading|title|name).*card"),
    ("item-heading", r"item.*(head|heading|title|name)|(head|heading|title|name).*item"),
    ("item-description", r"item.*(desc|description|copy|text)|description|flavour|flavor"),
    ("caption", r"caption|folio|credit|footer|small|figure|fig\.?"),
    ("rules-note", r"rule.*note|note|tip|warning|callout|important|remember|example"),
    ("section-heading", r"section|chapter|subhead|sub head|heading ?[123]|head ?[123]|^heading$|^title$|main head"),
    ("body", r"body|normal|copy|paragraph|para|main text|body text|rules text|description text"),
)
HEADINGS, LABELS = ("card-heading", "item-heading", "section-heading"), ("caption", "rules-note")

# Font, style, size and leading of headings, body and labels in each mood.
MOODS = {
    "editorial": (("Cormorant Garamond", "Semibold", 28.0, 30.0), ("Source Serif 4", "Regular", 10.5, 14.0), ("Inter", "Bold", 8.5, 10.0)),
    "modern": (("Arial", "Bold", 27.0, 28.0), ("Arial", "Regular", 10.0, 13.5), ("Arial", "Bold", 8.0, 9.5)),
    "humanist": (("Trebuchet MS", "Bold", 26.0, 29.0), ("Trebuchet MS", "Regular", 10.5, 14.0), ("Arial", "Bold", 8.5, 10.0)),
    "classic": (("Times New Roman", "Bold", 26.0, 29.0), ("Georgia", "Regular", 10.5, 14.0), ("Arial", "Bold", 8.0, 9.5)),
}


def guess_role(name: Column, size: Column, font_style: Column) -> Column:
    """The role that a style's name tells, else its size and weight, else 'none'."""
    n = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[_-]+", " ")
    size, bold = F.coalesce(size, F.lit(0.0)), is_bold(font_style)
    rules = [(n.rlike(pattern), role) for role, pattern in NAMES]
    rules += [((size >= 18) & bold, "section-heading"), ((size >= 13) & bold, "item-heading"), ((size > 0) & (size <= 9), "caption")]
    out = F.lit("none")
    for test, role in reversed(rules):
        out = F.when(test, F.lit(role)).otherwise(out)
    return out


def role_masters(styles: DataFrame, scope: list[str], *, key: str = "self", order: str = "ord") -> DataFrame:
    """The largest style of each role; of equals the first."""
    return best_row(styles.where("role != 'none'"), [*scope, "role"], [F.coalesce("size", F.lit(0.0)).desc(), F.col(order), F.col(key)])


def mood_of(role: Column, mood: str) -> Column:
    """struct(font, font_style, size, leading) that a mood gives a role."""
    spec = lambda s: F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("font", "font_style", "size", "leading"))])
    head, body, label = map(spec, MOODS[mood])
    return F.when(role == "none", F.lit(None)).when(role.isin(*HEADINGS), head).when(role.isin(*LABELS), label).otherwise(body)


def canonical_id(role: Column, prefix: str = "Role_") -> Column:
    return F.concat(F.lit(f"ParagraphStyle/{prefix}"), F.regexp_replace(role, "(?i)[^a-z0-9]+", "_"))


def remap_styles(runs: DataFrame, styles: DataFrame, scope: list[str], *, style: str = "para_style", key: str = "self", prefix: str = "Role_") -> DataFrame:
    """Runs with the styles that have a role renamed to the role's canonical style; ids are
    compared whole, so no id that begins like another is hit."""
    to = styles.where("role != 'none'").select(*scope, F.col(key).alias(style), canonical_id(F.col("role"), prefix).alias("__to"))
    return runs.join(to, [*scope, style], "left").withColumn(style, F.coalesce("__to", style)).drop("__to")


def canonical_styles(styles: DataFrame, scope: list[str], mood: str, *, key: str = "self", prefix: str = "Role_") -> DataFrame:
    """A style for each role in use: scope, role, self, name, based_on (the style that the
    role's master is based on), the mood's font, size and leading, and xml, its definition."""
    masters = role_masters(styles, scope, key=key)
    based = F.coalesce(F.nullif(F.col("based_on"), F.lit("")), F.lit("ParagraphStyle/$ID/NormalParagraphStyle"))
    out = masters.select(*scope, "role", canonical_id(F.col("role"), prefix).alias("self"), F.initcap(F.regexp_replace("role", "-", " ")).alias("name"), based.alias("based_on"), mood_of(F.col("role"), mood).alias("m")).select(*scope, "role", "self", "name", "based_on", "m.*")
    own = lambda name, value: F.concat(F.lit(f' {name}="'), escape_attribute(value), F.lit('"'))
    child = lambda name, kind, value: F.concat(F.lit(f'<{name} type="{kind}">'), escape_attribute(value), F.lit(f"</{name}>"))
    start = F.concat(F.lit("<ParagraphStyle"), own("Self", F.col("self")), own("Name", F.col("name")), own("FontStyle", F.col("font_style")), own("PointSize", plain(F.col("size"))), F.lit(">"))
    inner = F.concat(child("BasedOn", "object", F.col("based_on")), child("AppliedFont", "string", F.col("font")), child("Leading", "unit", plain(F.col("leading"))))
    return out.withColumn("xml", F.concat(start, F.lit("<Properties>"), inner, F.lit("</Properties></ParagraphStyle>")))


def without_unified(styles: DataFrame) -> DataFrame:
    """The style definitions that stay once each role has its canonical style."""
    return styles.where("role = 'none'")
