"""Joins: dimension look-ups, references that lead nowhere, and the page that holds an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.lineage import cut


def normalised_key(raw: Column, prefix: str, known: Column | None = None) -> Column:
    """An id as the dimension spells it: a reference may leave the prefix out."""
    return F.when(raw.startswith(prefix), raw).otherwise(F.concat(F.lit(prefix), raw))


def look_up(fact: DataFrame, dim: DataFrame, on: list[tuple[str, str]], prefix: str = "") -> DataFrame:
    """A left join; dim's columns get the prefix, so that names can't clash."""
    renamed = dim.select(*[F.col(c).alias(f"{prefix}{c}") for c in dim.columns])
    cond = [fact[a] == renamed[f"{prefix}{b}"] for a, b in on]
    return fact.join(renamed, cond, "left")


def unreferenced(dim: DataFrame, refs: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Rows of dim that no row of refs names."""
    keys = refs.select(*[F.col(b).alias(f"__r{i}") for i, (_, b) in enumerate(on)])
    return dim.join(keys, [dim[a] == keys[f"__r{i}"] for i, (a, _) in enumerate(on)], "left_anti")


#: Rows of a fact whose reference names no row of the dimension: the same anti-join, read the other way.
dangling = unreferenced


def broken_links(items: DataFrame, scope: list[str], key: str, links: list[str], targets: DataFrame | None = None) -> DataFrame:
    """Items with a link column that is set and names no target of the same scope. All
    links are checked in one pass: exploded, anti-joined, and brought back as a set."""
    targets = (targets if targets is not None else items).select(*scope, F.col(key).alias("__to")).distinct()
    out = items.select(*scope, key, F.explode(F.array(*links)).alias("__to")).where("__to is not null")
    bad = out.join(targets, [*scope, "__to"], "left_anti").select(*scope, key).distinct()
    return items.join(bad, [*scope, key], "left_semi")


def in_several(items: DataFrame, scope: list[str], group: str, linked: Column) -> DataFrame:
    """Groups with several items of which some are not linked."""
    return items.groupBy(*scope, group).agg(F.count("*").alias("items"), F.bool_and(linked).alias("__all")).where("items > 1 and not __all").drop("__all")


#: Extents below 2 ** FINEST share the finest grid, so that a box without extent has a cell too.
FINEST = -20


def _level(box: str) -> Column:
    """The grid whose cells are as wide as the box or up to twice as wide."""
    size = F.greatest(F.abs(f"{box}.w"), F.abs(f"{box}.h"), F.lit(2.0**FINEST))
    return F.ceil(F.log2(size)).cast("int")


def _cells(rows: DataFrame, levels: Column, box: Column) -> DataFrame:
    """rows once for each cell that the box touches on each of the levels."""
    rows = rows.withColumn("__level", F.explode(levels)).withColumn("__b", box)
    size = F.pow(F.lit(2.0), F.col("__level"))
    span = lambda at, extent: F.sequence(F.floor(F.col(f"__b.{at}") / size), F.floor((F.col(f"__b.{at}") + F.col(f"__b.{extent}")) / size))
    return rows.withColumn("__cx", F.explode(span("x", "w"))).withColumn("__cy", F.explode(span("y", "h"))).drop("__b")


#: A scope of up to so many different pages is looked through page by page, a larger one by its grids.
FEW = 64
#: Lists of pages are broadcast if there are so many of both scopes and pages at most.
SENT = 10_000


def _best(box: str, pages: str) -> Column:
    """(rank, first, page) of the best of a list of pages (first, page, of), or null: one that holds the centre of
    the box, else the one that it overlaps most."""
    own = F.col(box)

    def told(p: Column) -> Column:
        of = p["of"]
        inside, spans = F.lit(True), []
        for at, size in (("x", "w"), ("y", "h")):
            inside = inside & (own[at] + own[size] / 2).between(of[at], of[at] + of[size])
            spans.append(F.least(own[at] + own[size], of[at] + of[size]) - F.greatest(own[at], of[at]))
        laid = (own["w"] > 0) & (own["h"] > 0) & (spans[0] > 0) & (spans[1] > 0)
        return F.struct(F.when(inside, float("inf")).when(laid, spans[0] * spans[1]).alias("rank"), p["first"].alias("first"), p["page"].alias("page"))

    return F.array_max(F.filter(F.transform(pages, told), lambda x: x["rank"].isNotNull()))


def assign_boxes(items: DataFrame, pages: DataFrame, scope: list[str], *, item: str, page: str, order: str) -> DataFrame:
    """For each item the page of its scope that holds the centre of its box (edges count;
    the first page wins), else the page that it overlaps most, else null.

    Boxes are structs (x, y, w, h) in a column named box on both sides. Of pages with one box only the
    first can win, so the others are left out before any item is looked at. An item of a scope with few different
    pages meets their list, which is broadcast if all lists are few; no row is made for a pair. Scopes
    with more pages are looked up in grids (_from_grids). Whatever is met, the best is taken where it is met, so what is exchanged
    is a row for each item, or, with grids, for each cell that an item touches.

    Null boxes and boxes that are not finite have no page; a page of negative extent holds nothing, an item of
    negative extent only has its centre. Pages of equal order: one of them. Rows of one item and box count once.
    """
    finite = lambda box: F.col(box).isNotNull() & F.forall(F.array(*[F.col(f"{box}.{f}") for f in "xywh"]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e300))
    p = pages.where(finite("box")).where("box.w >= 0 and box.h >= 0").groupBy(*scope, F.struct(*[F.col(f"box.{f}").alias(f) for f in "xywh"]).alias("of"))
    p = cut(p.agg(F.max(F.struct((-F.col(order)).alias("first"), F.col(page).alias("page"))).alias("__p")).select(*scope, "__p.first", "__p.page", "of"))
    sizes = p.groupBy(*scope).agg(F.count("*").alias("__n"))
    few, many = (sizes.where(c).select(*scope) for c in (F.col("__n") <= FEW, F.col("__n") > FEW))
    lists = cut(p.join(few, scope, "left_semi").groupBy(*scope).agg(F.collect_list(F.struct("first", "page", "of")).alias("__pages")))
    scopes, n = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("__pages")), F.lit(0))).first()
    # the size of the written table says little of its rows, so the join is named
    lists = F.broadcast(lists) if max(scopes, n) <= SENT else lists.hint("merge")
    met = items.join(lists, scope, "left").withColumn("__best", F.when(finite("box"), _best("box", "__pages"))).select(*[items[c] for c in items.columns], "__best")
    each = Window.partitionBy(*scope, item)  # an item may have rows of other boxes
    out = met.withColumn("__best", F.when(F.col(item).isNotNull(), F.max("__best").over(each)))
    if not many.isEmpty():
        b = items.where(finite("box")).join(many, scope, "left_semi").select(*scope, item, "box").distinct()
        grids = _from_grids(b, p.join(many, scope, "left_semi"), scope, item)
        out = out.join(grids, [*scope, item], "left").withColumn("__best", F.coalesce("__best", "__far"))
    return out.select(*items.columns, F.col("__best.page").alias(page))


def _from_grids(b: DataFrame, p: DataFrame, scope: list[str], item: str) -> DataFrame:
    """(scope, item, __far): the best (_best) of the pages (first, page, of) that each item (box) meets in grids.

    Grids of cells of 2**k stand on levels k, and every box belongs to the level of its own size, where it touches four cells at
    most. An item's centre is looked up in one cell on each level that has pages. Boxes that overlap
    meet on the coarser level of the two: items also stand on the coarser levels of pages, and pages
    on the coarser ones of items, so neither a page nor an item of any size is spread over many cells, and
    pages without extent have a cell of their own. The pages of a cell are dealt into 64 lists, so one that holds very many
    makes no row for each pair; items keep the best of each list."""
    p, b = p.withColumn("__own", _level("of")), b.withColumn("__own", _level("box"))
    # the levels of a scope: some dozens at most, whatever the number of boxes
    of_pages, of_items = (rows.groupBy(*scope).agg(F.collect_set("__own").alias("__levels")) for rows in (p, b))
    both = F.array_union(F.array("__own"), F.filter("__levels", lambda k: k > F.col("__own")))
    centre = F.struct((F.col("box.x") + F.col("box.w") / 2).alias("x"), (F.col("box.y") + F.col("box.h") / 2).alias("y"), F.lit(0.0).alias("w"), F.lit(0.0).alias("h"))
    key = [*scope, "__level", "__cx", "__cy"]
    near = b.join(of_pages, scope)
    left = _cells(near.withColumn("__c", centre), F.col("__levels"), F.col("__c")).select(*key, item, "box")
    left = left.unionByName(_cells(near.where("box.w > 0 and box.h > 0"), both, F.col("box")).select(*key, item, "box"))
    right = _cells(p.join(of_items, scope), both, F.col("of")).groupBy(*key, F.pmod(F.xxhash64("of"), F.lit(64)).alias("__part")).agg(F.collect_list(F.struct("first", "page", "of")).alias("__pages"))
    found = left.join(right.hint("merge"), key).select(*scope, item, _best("box", "__pages").alias("__far")).where("__far is not null")
    return found.groupBy(*scope, item).agg(F.max("__far").alias("__far"))


def worst_status(usage: DataFrame, resources: DataFrame, scope: list[str], *, keys: list[tuple[str, str]], status: str, ranks: dict[str, int]) -> DataFrame:
    """usage with the worst status of all resources that match on any pair of keys (an OR
    join, split into equi-joins that are united before the aggregate)."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    # unknown statuses rank lowest, so that any known one replaces them
    worth = F.coalesce(rank[F.col(status)], F.lit(0))
    usage = usage.withColumn("__id", F.struct(*usage.columns))
    hits = None  # a row for each key at most: resources are reduced to their worst before they meet the usage
    for left, right in keys:
        r = resources.groupBy(*[F.col(s).alias(f"__{s}") for s in scope], F.col(right).alias("__key")).agg(F.max_by(status, worth).alias(status), F.max(worth).alias("__worth"))
        h = usage.join(r, [*[usage[s] == r[f"__{s}"] for s in scope], usage[left] == r["__key"]]).select("__id", status, "__worth")
        hits = h if hits is None else hits.unionByName(h)
    best = hits.groupBy("__id").agg(F.max_by(status, "__worth").alias(status))
    return usage.join(best, usage["__id"].eqNullSafe(best["__id"]), "left").select(*[usage[c] for c in usage.columns if c != "__id"], best[status])


def paired(a: DataFrame, b: DataFrame, group: list[str], value: str) -> DataFrame:
    """Two multisets of values compared group by group, in order: the n-th smallest of each
    side stand in one row; rows of one side alone have nulls on the other. Null values come last."""
    w = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_last())
    left, right = (x.select(*group, F.col(value).alias(f"{value}_{s}"), F.row_number().over(w).alias("n")) for x, s in ((a, "a"), (b, "b")))
    return left.join(right, [*group, "n"], "full_outer")


def near_numbers(a: DataFrame, b: DataFrame, cols: list[str], tolerance: float) -> DataFrame:
    """Rows of a and b with all columns within the tolerance of each other. Values are
    dealt into cells as wide as the tolerance, and each row of b into its own and the
    neighbouring cells of the first column, so the join has an equi-key."""
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = a.select(*[F.col(c).alias(f"{c}_a") for c in cols], *[c for c in a.columns if c not in cols], cell(cols[0]).alias("__cell"))
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in cols], *[c for c in b.columns if c not in cols], F.explode(F.sequence(cell(cols[0]) - 1, cell(cols[0]) + 1)).alias("__cell"))
    both = left.join(right, "__cell").drop("__cell")
    for c in cols:
        both = both.where(F.abs(F.col(f"{c}_a") - F.col(f"{c}_b")) <= tolerance)
    return both


def restore_order(rows: DataFrame, manifest: DataFrame, scope: list[str], key: str, order: str, own: str | None = None) -> DataFrame:
    """rows numbered from 0 in the order of the manifest; what it doesn't name comes last, by key.

    own, if named, is the rows' own order: in scopes where the manifest names another number
    of rows than there are, it holds instead of the manifest's."""
    m = manifest.select(*scope, F.col(key).alias("__k"), F.col(order).alias("__o"))
    both = rows.join(m, [*[rows[s] == m[s] for s in scope], rows[key] == m["__k"]], "left").select(*[rows[c] for c in rows.columns], "__o")
    if own is not None:
        whole = Window.partitionBy(*scope)
        agree = F.count("__o").over(whole) == F.count("*").over(whole)
        both = both.withColumn("__agree", agree).withColumn("__o", F.when(F.col("__agree"), F.col("__o"))).withColumn("__own", F.when(~F.col("__agree"), F.col(own)))
        w = Window.partitionBy(*scope).orderBy("__own", F.col("__o").asc_nulls_last(), key)
        return both.withColumn("ord", F.row_number().over(w) - 1).drop("__o", "__own", "__agree")
    w = Window.partitionBy(*scope).orderBy(F.col("__o").asc_nulls_last(), key)
    return both.withColumn("ord", F.row_number().over(w) - 1).drop("__o")


def near_keys(a: DataFrame, b: DataFrame, cols: list[str], tolerance: float, key: str) -> DataFrame:
    """The keys of a that have a row of b within the tolerance in all columns. Cells in all (up to three) columns."""
    dims = cols[:3]
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = a.select(key, *cols, *[cell(c).alias(f"__c{i}") for i, c in enumerate(dims)])
    right = b.select(*[F.col(c).alias(f"{c}_b") for c in cols]).distinct()
    for i, c in enumerate(dims):
        right = right.withColumn(f"__c{i}", F.explode(F.sequence(F.floor(F.col(f"{c}_b") / tolerance) - 1, F.floor(F.col(f"{c}_b") / tolerance) + 1)))
    both = left.join(right, [f"__c{i}" for i in range(len(dims))])
    for c in cols:
        both = both.where(F.abs(F.col(c) - F.col(f"{c}_b")) <= tolerance)
    return both.select(key).distinct()


def scaled_matches(colours: DataFrame, swatches: DataFrame, inks: list[str], key: str, tolerance: float, most: float = 1.001) -> DataFrame:
    """The keys of colours that are a swatch times one factor above 0 and below `most`, within the tolerance in every ink.

    The factor is given by the swatch's first ink that is not 0. With it, whether the other inks fit
    depends on their ratios to that ink alone: |ratio * own - ink| <= tolerance. So swatches of equal
    ratios are one, of which the fullest counts, and colours meet swatches in cells of ratios. A colour's
    cells are as wide as its tolerance, a power of two on the level of its own amount of that ink; swatches stand on all levels
    that colours have, a few dozen, in the cells around their own."""
    first = F.coalesce(*[F.when(F.col(c) > 0, F.lit(i)) for i, c in enumerate(inks)])
    amounts = F.array(*[F.col(c).cast("double") for c in inks])
    b = swatches.select(first.alias("__first"), amounts.alias("__v")).where("__first is not null")
    lead = F.get("__v", F.col("__first"))
    b = b.select("__first", lead.alias("__lead"), F.transform("__v", lambda v: F.try_divide(v, lead)).alias("__ratios"))
    b = b.groupBy("__first", "__ratios").agg(F.max("__lead").alias("__lead"))
    # a colour can be a tint by any ink that it has
    a = colours.select(key, amounts.alias("__a")).select(key, "__a", F.posexplode("__a").alias("__first", "__own")).where("__own > 0")
    a = a.withColumn("__level", F.ceil(F.log2(F.try_divide(F.lit(tolerance), F.col("__own")))).cast("int"))
    levels = a.select("__first", "__level").distinct().groupBy("__first").agg(F.collect_set("__level").alias("__levels"))
    others = lambda values: F.filter(values, lambda v, i: i != F.col("__first"))
    cells = min(3, len(inks) - 1)
    width = F.pow(F.lit(2.0), F.col("__level"))
    b = b.join(levels, "__first").withColumn("__level", F.explode("__levels"))
    for i in range(cells):
        mid = F.floor(F.get(others("__ratios"), F.lit(i)) / width)
        b = b.withColumn(f"__c{i}", F.explode(F.sequence(mid - 1, mid + 1)))
        a = a.withColumn(f"__c{i}", F.floor(F.try_divide(F.get(others("__a"), F.lit(i)), F.col("__own")) / width))
    both = a.join(b.drop("__levels"), ["__first", "__level", *[f"__c{i}" for i in range(cells)]]).where(F.try_divide(F.col("__own"), F.col("__lead")) < most)
    fits = F.forall(F.arrays_zip("__a", "__ratios"), lambda x: F.abs(x["__ratios"] * F.col("__own") - x["__a"]) <= tolerance)
    return both.where(fits).select(key).distinct()


def swatch_match(colours: DataFrame, swatches: DataFrame, inks: list[str], *, key: str, tolerance: float = 0.6, tint_tolerance: float = 0.8) -> DataFrame:
    """colours (key, inks in percent) with match: 'exact' where a swatch has all inks within
    the tolerance, 'tint' where all inks of a swatch, times one factor up to 1, come within
    tint_tolerance of the colour's, else 'other'. Both sides meet in cells (near_keys, scaled_matches), so
    neither is compared with all of the other. Null inks match nothing; keys are unique."""
    near = near_keys(colours, swatches, inks, tolerance, key).select(F.col(key).alias("__k"), F.lit(True).alias("__exact"))
    tints = scaled_matches(colours, swatches.select(*inks).distinct(), inks, key, tint_tolerance).select(F.col(key).alias("__t"), F.lit(True).alias("__tint"))
    out = colours.join(near, colours[key] == near["__k"], "left").join(tints, colours[key] == tints["__t"], "left")
    return out.select(*[colours[c] for c in colours.columns], F.when(F.col("__exact"), "exact").when(F.col("__tint"), "tint").otherwise("other").alias("match"))
