"""Chains of based-on references, cascades and swatches that refer to swatches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.affine import compose
from quoin.functions.colour import cmyk_to_rgb, hex_of
from quoin.lineage import cut, unsent

FIELDS = ("font", "font_style", "size", "leading", "justification", "fill", "tracking")


def given(c: Column) -> Column:
    """Null for what counts as unset: null and the empty string."""
    return F.nullif(c, F.lit(""))


def resolve_chain(styles: DataFrame, scope: list[str], *, key: str = "self", parent: str = "based_on", fields: tuple[str, ...] = FIELDS, root: str | None = None) -> DataFrame:
    """Each style's fields, unset ones taken from the nearest ancestor that sets them.

    Pointer doubling: after k rounds a style knows what its 2**k nearest ancestors set and
    points to the next one, so chains of any length need log2 of it joins, whatever the
    number of documents. Rounds end when no style learns anything: none loses its pointer
    and none gains a field, so a cycle, which brings back what is known, ends them too. The
    root style, if named, is the weakest ancestor of all.
    """
    now = styles.select(*scope, key, F.col(parent).alias("__next"), *[given(F.col(f)).alias(f) for f in fields])
    state = None
    while True:
        now = cut(now)  # each round reads the one before twice: without a cut the plan doubles too
        before, state = state, now.agg(F.count("__next"), *[F.count(f) for f in fields], F.count("*").alias("__rows")).first()
        if state == before or not state[0]:
            break
        up = now.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"), F.col("__next").alias("__after"), *[F.col(f).alias(f"__{f}") for f in fields])
        both = now.join(unsent(up, state["__rows"]), [*[now[s].eqNullSafe(up[f"__{s}"]) for s in scope], now["__next"] == up["__key"]], "left")
        now = both.select(*[now[s] for s in scope], now[key], up["__after"].alias("__next"), *[F.coalesce(now[f], up[f"__{f}"]).alias(f) for f in fields])
    if root is not None:
        base = styles.where(F.col(key) == root).select(*[F.col(s).alias(f"__{s}") for s in scope], *[given(F.col(f)).alias(f"__{f}") for f in fields])
        both = now.join(unsent(base, base.count()), [now[s].eqNullSafe(base[f"__{s}"]) for s in scope], "left") if scope else now.crossJoin(F.broadcast(base.limit(1)))
        now = both.select(*[now[s] for s in scope], now[key], *[F.coalesce(now[f], base[f"__{f}"]).alias(f) for f in fields])
    return now.select(*scope, key, *fields)


def depth_of(rows: DataFrame, scope: list[str], *, key: str, parent: str) -> DataFrame:
    """(scope, key, root, depth): the end of each row's chain and the steps to it, both null
    for rows whose chain runs into a cycle."""
    now = rows.select(*scope, key, F.col(parent).alias("__next"), F.col(key).alias("root"), F.lit(0).alias("depth"))
    known = rows.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"))
    # a parent that is not in the table ends the chain
    now = now.join(known, [*[now[s] == known[f"__{s}"] for s in scope], now["__next"] == known["__key"]], "left")
    now = now.select(*scope, key, F.col("__key").alias("__next"), F.coalesce(F.col("__key"), F.col(key)).alias("root"), F.when(F.col("__key").isNotNull(), 1).otherwise(0).alias("depth"))
    left = None
    while True:
        now = cut(now)
        before, left = left, now.agg(F.count("__next")).first()[0]
        if not left or left == before:  # each round ends the chains that are left, but for cycles
            break
        up = now.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"), F.col("__next").alias("__after"), F.col("root").alias("__root"), F.col("depth").alias("__depth"))
        both = now.join(up, [*[now[s] == up[f"__{s}"] for s in scope], now["__next"] == up["__key"]], "left")
        now = both.select(*[now[s] for s in scope], now[key], up["__after"].alias("__next"), F.coalesce(up["__root"], now["root"]).alias("root"), (now["depth"] + F.coalesce(up["__depth"], F.lit(0))).alias("depth"))
    return now.select(*scope, key, *[F.when(F.col("__next").isNull(), F.col(c)).alias(c) for c in ("root", "depth")])


def cascade(run: Column, char: Column, para_local: Column, para: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The effective fields of a run: its own settings, then its character style's, then
    the paragraph's own, then the paragraph style's; each a struct with the fields."""
    return F.struct(*[F.coalesce(*[given(level[f]) for level in (run, char, para_local, para)]).alias(f) for f in fields])


def world_maps(items: DataFrame, scope: list[str], *, key: str, parent: str, own: str, nearest: tuple[str, ...] = (), any_of: tuple[str, ...] = ()) -> DataFrame:
    """(scope, key, own, nearest…, any_of…) of every item: its affine map composed with those
    of all groups around it, outermost applied last; for each column of `nearest` its own
    value or that of the innermost group that has one; whether a flag of any_of holds for it or any group.

    Maps don't commute, so products are taken in order by pointer doubling: an item holds the
    product up to a group 2**k levels out and a pointer to it, and each round multiplies its
    product with that group's. Nesting of any depth takes log2 of it rounds. Items that have
    arrived are put aside, so a round joins only those that still have groups around them.

    A null map is the identity; a parent that is not in the table is no parent; items whose groups
    run in a circle have a null map and null columns. Keys are unique in a scope.
    """
    identity = F.array(*[F.lit(float(v)) for v in (1, 0, 0, 1, 0, 0)])
    rest = [*nearest, *any_of]
    known = items.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"))
    now = items.select(*scope, key, F.col(parent).alias("__up"), F.coalesce(own, identity).alias(own), *nearest, *[F.coalesce(c, F.lit(False)).alias(c) for c in any_of])
    now = now.join(known, [*[now[s] == known[f"__{s}"] for s in scope], now["__up"] == known["__key"]], "left").select(*scope, key, F.col("__key").alias("__next"), own, *rest)
    whole, left = None, None  # those that have arrived; how many have not
    while True:
        now = cut(now)
        arrived = now.where("__next is null").drop("__next")
        whole = arrived if whole is None else whole.unionByName(arrived)
        open_ = now.where("__next is not null")
        before, left = left, open_.count()
        if not left or left == before:  # each round brings some home, but for circles
            break
        # the groups pointed to are open or have arrived; whole holds each of these once
        up = whole.withColumn("__after", F.lit(None).cast(now.schema["__next"].dataType)).unionByName(open_.withColumnRenamed("__next", "__after"))
        up = up.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"), "__after", *[F.col(c).alias(f"__{c}") for c in (own, *rest)])
        both = open_.join(up, [*[open_[s] == up[f"__{s}"] for s in scope], open_["__next"] == up["__key"]])
        now = both.select(*scope, key, F.col("__after").alias("__next"), compose(F.col(f"__{own}"), F.col(own)).alias(own), *[F.coalesce(c, f"__{c}").alias(c) for c in nearest], *[(F.col(c) | F.col(f"__{c}")).alias(c) for c in any_of])
    lost = open_.select(*scope, key, *[F.lit(None).cast(now.schema[c].dataType).alias(c) for c in (own, *rest)])
    return whole.unionByName(lost)


def pins(styles: DataFrame, scope: list[str], *, key: str, parent: str, fields: dict[str, tuple[str, str]], rows: int = 0) -> DataFrame:
    """styles with pinned: whether a style must set its fields itself to show what is wanted.

    fields: for each field the columns of what the style itself sets, and of what is wanted in
    the end. Once every style shows what is wanted, so does its parent; so what a style
    inherits in the end is what is wanted of its parent, and one look at the parent settles
    each style: no round resolves a chain again. A style is pinned only if it would
    differ although all above it are right. A null wanted value of the parent stands for nothing inherited;
    a parent that is not in the table gives nothing. rows, if known: how many styles there are (lineage.unsent)."""
    up = styles.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col(key).alias("__key"), *[F.col(w).alias(f"__up_{f}") for f, (_, w) in fields.items()])
    both = styles.join(unsent(up, rows), [*[styles[s].eqNullSafe(up[f"__{s}"]) for s in scope], styles[parent] == up["__key"]], "left")
    wrong = F.lit(False)
    for f, (own, want) in fields.items():
        wrong = wrong | ~F.coalesce(given(styles[own]), F.col(f"__up_{f}")).eqNullSafe(styles[want])
    return both.select(*[styles[c] for c in styles.columns], wrong.alias("pinned"))


NONE = r"Swatch/None$|^n$"
SWATCH = "struct<kind:string,rgb:string,cmyk:array<double>,inks:int,reversed:boolean>"


def _swatch(kind: Column | str, rgb=None, cmyk=None, inks=None, back=None) -> Column:
    lit = lambda v, t: (F.lit(v) if not isinstance(v, Column) else v).cast(t)
    return F.struct(lit(kind, "string").alias("kind"), lit(rgb, "string").alias("rgb"), lit(cmyk, "array<double>").alias("cmyk"), lit(inks, "int").alias("inks"), lit(False if back is None else back, "boolean").alias("reversed"))


def _colour_swatch() -> Column:
    """A swatch of type color from its own columns."""
    v = lambda k: F.get("value", F.lit(k))
    four, three = (F.size("value") >= 4) & (F.col("space") == "CMYK"), (F.size("value") >= 3) & (F.col("space") == "RGB")
    inks = F.size(F.filter(F.slice("value", 1, 4), lambda x: x >= 0.5))
    spot, registration = F.coalesce(F.col("model") == "Spot", F.lit(False)), F.coalesce(F.col("model") == "Registration", F.lit(False))
    as_rgb = [F.floor(v(k) + 0.5).cast("int") for k in range(3)]
    kind = F.when(registration, "registration").when(four & spot, "spot").when(four, "process").when(three, "rgb").otherwise("other")
    hexes = F.when(registration, "#000000").when(four, hex_of(cmyk_to_rgb(*[v(k) / 100 for k in range(4)]))).when(three, hex_of(as_rgb))
    return _swatch(kind, hexes, F.when(four & ~registration, F.slice("value", 1, 4)), F.when(registration, 4).when(four & spot, 1).when(four, inks), F.coalesce(four & ~registration & (inks == 0), F.lit(False)))


def _made_swatch() -> Column:
    """A tint or gradient from what its references gave: `first`, and `most`, the greatest number of inks."""
    share = F.coalesce(F.when(~F.isnan("tint"), F.col("tint")), F.lit(100.0)) / 100
    tinted = F.transform(F.col("first.cmyk"), lambda x: x * share)
    inks = F.size(F.filter(tinted, lambda x: x >= 0.5))
    tint = _swatch("tint", hex_of(cmyk_to_rgb(*[F.get(tinted, F.lit(k)) / 100 for k in range(4)])), tinted, inks, inks == 0)
    gradient = _swatch("gradient", F.col("first.rgb"), None, F.greatest(F.lit(0), F.col("most")))
    return F.when(F.col("type") == "gradient", gradient).when(F.col("first.cmyk").isNotNull(), tint).otherwise(F.col("first"))


def resolve_swatches(swatches: DataFrame, scope: list[str]) -> DataFrame:
    """Each swatch's kind, rgb, cmyk (percent), inks, reversed (no ink at all) and cyclic.

    swatches: scope, id, type (color, tint, gradient), name, space, model, value
    array<double>, base, tint, stops array<string>. A tint takes its base, a gradient its stops, each
    of which may be a tint or gradient again.

    Resolved in layers: every tint or gradient counts its references that are not
    resolved yet; in each round the swatches resolved in the round before meet the references to them, and
    those whose count falls to none are computed, each once. References to None count as no
    ink, to nothing known as 'unknown'. Where no count falls any more, what is left leads
    into a circle: these are cyclic, and their references into it count as none.

    Ids are unique in a scope. Null scopes match nothing. An empty table gives no rows.
    """
    state = swatches.select(*scope, "id", "name", "type", "tint", F.when(F.col("type") == "color", _colour_swatch()).cast(SWATCH).alias("r"), F.when(F.col("type") == "tint", F.array("base")).when(F.col("type") == "gradient", F.col("stops")).alias("refs"))
    refs = state.where("type != 'color'").select(*scope, "id", "name", "type", "tint", F.posexplode_outer("refs").alias("pos", "ref"))
    of = state.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col("id").alias("__id"), F.col("r").alias("__r"))
    both = refs.join(of, [*[refs[s] == of[f"__{s}"] for s in scope], refs["ref"] == of["__id"]], "left")
    part = F.when(F.col("ref").isNull() | F.col("ref").rlike(NONE), _swatch("none", inks=0)).when(F.col("__id").isNull(), _swatch("unknown")).otherwise(F.col("__r"))
    met = cut(both.select(*scope, "id", "name", "type", "tint", F.coalesce("pos", F.lit(0)).alias("pos"), "ref", part.alias("part")))
    first, most = F.max_by("part", F.when((F.col("pos") == 0) & F.col("part").isNotNull(), 1)), F.coalesce(F.max("part.inks"), F.lit(0))
    waiting = met.groupBy(*scope, "id", "name", "type", "tint").agg(F.count_if(F.col("part").isNull()).alias("left"), first.alias("first"), most.alias("most"))
    open_ = met.where("part is null").select(*scope, "id", "pos", "ref")
    done = [state.where("type = 'color'").select(*scope, "id", "name", "r", F.lit(False).alias("cyclic"))]
    while True:
        waiting = cut(waiting)
        ready, left = waiting.agg(F.count_if(F.col("left") <= 0), F.count_if(F.col("left") > 0)).first()
        stuck = not ready
        new = waiting.where(F.lit(stuck) | (F.col("left") <= 0)).withColumn("first", F.coalesce("first", _swatch("none", inks=0)))
        new = cut(new.select(*scope, "id", "name", _made_swatch().cast(SWATCH).alias("r"), F.lit(stuck).alias("cyclic")))  # computed once, read twice
        done.append(new)
        if stuck or not left:
            break
        told = new.select(*[F.col(s).alias(f"__{s}") for s in scope], F.col("id").alias("__id"), F.col("r").alias("part"))
        both = cut(open_.join(told, [*[open_[s] == told[f"__{s}"] for s in scope], open_["ref"] == told["__id"]], "left").select(*scope, "id", "pos", "ref", F.col("__id").isNotNull().alias("met"), "part"))
        gain = both.where("met").groupBy(*scope, "id").agg(F.count("*").alias("__n"), first.alias("__first"), most.alias("__most"))
        open_ = both.where("not met").select(*scope, "id", "pos", "ref")
        waiting = waiting.where("left > 0").join(gain, [*scope, "id"], "left").select(*scope, "id", "name", "type", "tint", (F.col("left") - F.coalesce("__n", F.lit(0))).alias("left"), F.coalesce("first", "__first").alias("first"), F.greatest("most", F.coalesce("__most", F.lit(0))).alias("most"))
    return reduce(DataFrame.unionByName, done).select(*scope, "id", "name", "r.*", "cyclic")
