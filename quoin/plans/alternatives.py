"""Free fonts to use instead of a named one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.functions.text import alias_key

# Free families by their slugs, and whether each has a bold and an italic.
FAMILIES = {
    "arimo": ("Arimo", True, True),
    "tinos": ("Tinos", True, True),
    "cousine": ("Cousine", True, True),
    "inter": ("Inter", True, True),
    "roboto": ("Roboto", True, True),
    "lato": ("Lato", True, True),
    "montserrat": ("Montserrat", True, True),
    "poppins": ("Poppins", True, True),
    "figtree": ("Figtree", True, True),
    "jost": ("Jost", True, True),
    "outfit": ("Outfit", True, False),
    "nunitosans": ("Nunito Sans", True, True),
    "gelasio": ("Gelasio", True, True),
    "sourceserif4": ("Source Serif 4", True, True),
    "librebaskerville": ("Libre Baskerville", True, True),
    "librecaslontext": ("Libre Caslon Text", True, True),
    "ebgaramond": ("EB Garamond", True, True),
    "cormorantgaramond": ("Cormorant Garamond", True, True),
    "playfairdisplay": ("Playfair Display", True, True),
    "bodonimoda": ("Bodoni Moda", True, True),
    "robotomono": ("Roboto Mono", True, True),
    "ibmplexmono": ("IBM Plex Mono", True, True),
    "oswald": ("Oswald", True, False),
    "anton": ("Anton", False, False),
    "bebasneue": ("Bebas Neue", False, False),
    "stardosstencil": ("Stardos Stencil", True, False),
    "blackopsone": ("Black Ops One", False, False),
    "allertastencil": ("Allerta Stencil", False, False),
    "permanentmarker": ("Permanent Marker", False, False),
    "kalam": ("Kalam", True, False),
    "caveat": ("Caveat", True, False),
    "comicneue": ("Comic Neue", True, True),
    "bangers": ("Bangers", False, False),
    "robotoslab": ("Roboto Slab", True, False),
    "courierprime": ("Courier Prime", True, True),
}
# Names of fonts, and the families that may stand in for them, the best first.
STAND_INS = [
    (["Arial", "ArialMT", "Arial Unicode MS", "Helvetica", "Helvetica Neue", "HelveticaNeueLTStd", "Nimbus Sans"], ["arimo", "inter", "roboto"]),
    (["Times", "Times Roman", "Times New Roman", "Nimbus Roman"], ["tinos", "librebaskerville", "sourceserif4"]),
    (["Courier", "Courier New", "Nimbus Mono PS"], ["cousine", "courierprime", "ibmplexmono"]),
    (["Inter"], ["arimo", "roboto"]),
    (["Roboto"], ["inter", "arimo"]),
    (["Montserrat"], ["figtree", "poppins"]),
    (["Bangers"], ["permanentmarker", "comicneue"]),
    (["Black Ops One", "Stardos Stencil", "Allerta Stencil"], ["stardosstencil", "blackopsone", "allertastencil"]),
    (["Georgia"], ["gelasio", "sourceserif4", "librebaskerville"]),
    (["Garamond", "Adobe Garamond", "Adobe Garamond Pro", "Garamond Premier Pro", "AGaramondPro"], ["ebgaramond", "cormorantgaramond", "librecaslontext"]),
    (["Baskerville", "Baskerville Old Face", "Baskerville MT"], ["librebaskerville", "sourceserif4", "gelasio"]),
    (["Didot", "Bodoni", "Bodoni MT", "Bodoni 72"], ["bodonimoda", "playfairdisplay", "cormorantgaramond"]),
    (["Futura", "Futura PT", "Futura Std"], ["jost", "outfit", "poppins"]),
    (["Avenir", "Avenir Next", "Avenir Next LT Pro"], ["nunitosans", "figtree", "lato"]),
    (["Gotham", "Gotham Pro", "Proxima Nova"], ["montserrat", "figtree", "inter"]),
    (["Verdana", "Tahoma"], ["lato", "arimo", "nunitosans"]),
    (["Impact", "Haettenschweiler", "Trade Gothic Condensed", "DIN Condensed"], ["anton", "oswald", "bebasneue"]),
    (["Stencil", "Stencil Std", "Stencil MT", "Stencil BT", "USAAF Stencil"], ["stardosstencil", "blackopsone", "allertastencil"]),
    (["Bank Gothic", "Bank Gothic BT", "Agency FB"], ["oswald", "bebasneue", "outfit"]),
    (["Comic Sans", "Comic Sans MS", "ComicSansMS"], ["comicneue", "kalam", "caveat"]),
    (["Marker Felt", "Felt Tip Roman", "Bradley Hand", "Bradley Hand ITC"], ["permanentmarker", "kalam", "caveat"]),
    (["Komika Text", "Komika Title", "Action Man", "Anime Ace", "CC Wild Words", "Wild Words"], ["bangers", "permanentmarker", "comicneue"]),
    (["Rockwell", "Rockwell Std", "Clarendon", "Clarendon BT"], ["robotoslab", "sourceserif4", "gelasio"]),
]
# Style words and maker's marks that may end a name.
SUFFIXES = "extrabold|ultrabold|semibold|demibold|demi|bold|extrablack|ultrablack|black|heavy|extralight|ultralight|light|thin|medium|regular|normal|roman|book|italic|oblique|upright|psmt|ps|mt|std|pro|lt|bt"


def strip_styles(key: Column) -> Column:
    """A name's key without all the suffixes at its end."""
    return F.regexp_replace(key, f"(?:{SUFFIXES})+$", "")


def bases(key: Column) -> Column:
    """The key and what is left of it after each suffix, one by one from the end, however
    many there are: a suffix has two letters at least, so half the key's length is enough."""

    def shorter(found: Column, _: Column) -> Column:
        last = F.element_at(found, -1)
        cut = F.regexp_replace(last, f"(?:{SUFFIXES})$", "")
        return F.when(cut == last, found).otherwise(F.concat(found, F.array(cut)))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.length(key) / 2).cast("int")), F.array(key), shorter)


def catalogue(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(families, stand-ins): the dimensions as DataFrames of fixed size."""
    families = [(slug, *about) for slug, about in FAMILIES.items()]
    key = lambda name: "".join(c for c in name.lower() if c.isascii() and c.isalnum())
    rows = [(key(name), slug, rank) for names, slugs in STAND_INS for name in names for rank, slug in enumerate(slugs)]
    return spark.createDataFrame(families, "slug string, family string, has_bold boolean, has_italic boolean"), spark.createDataFrame(rows, "alias string, slug string, rank int")


def alternatives(names: DataFrame, name: str = "name", limit: int = 3) -> DataFrame:
    """Up to `limit` rows for each distinct name: place, family, slug, weight, slant, exact,
    different_style. Names that nothing is known of have none.

    The longest form of the name that is known, as a family or as an alias, is its base;
    the family itself comes first, then the stand-ins. The dimensions are of fixed size.
    """
    families, stand_ins = (F.broadcast(d) for d in catalogue(names.sparkSession))
    families = families.withColumn("f_key", alias_key(F.col("family")))
    keyed = names.select(F.col(name).alias("name")).distinct().withColumn("raw", alias_key(F.col("name"))).where("raw != ''")
    forms = keyed.select("name", "raw", F.posexplode(bases(F.col("raw"))).alias("cut", "base"))
    own = forms.join(families.select(F.col("f_key").alias("base"), "slug"), "base").select("name", "raw", "cut", "base", "slug", F.lit(-1).alias("rank"))
    other = forms.join(stand_ins.withColumnRenamed("alias", "base"), "base").select("name", "raw", "cut", "base", "slug", "rank")
    found = own.unionByName(other)
    least = Window.partitionBy("name")
    found = found.withColumn("first", F.min("cut").over(least)).where("cut = first")
    found = found.groupBy("name", "raw", "base", "slug").agg(F.min("rank").alias("rank"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("rank"))).where(F.col("place") <= limit)
    style = F.substring("raw", F.length("base") + 1, F.length("raw"))
    bold, italic = style.rlike("bold|black|heavy|demi"), style.rlike("italic|oblique")
    out = found.join(families.drop("f_key"), "slug")
    bold_there, italic_there = bold & F.col("has_bold"), italic & F.col("has_italic")
    return out.select(
        "name", "place", "family", "slug",
        F.when(bold_there, 700).otherwise(400).alias("weight"),
        F.when(italic_there, "italic").otherwise("normal").alias("slant"),
        (F.col("rank") < 0).alias("exact"),
        ((bold & ~F.col("has_bold")) | (italic & ~F.col("has_italic"))).alias("different_style"),
    )
