"""Schemas of the fact tables."""

from pyspark.sql import types as T


def _struct(ddl: str) -> T.StructType:
    """Fields from 'name type' pairs; box is struct(x, y, w, h), list<t> an array."""
    simple = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType()}
    simple["box"] = T.StructType([T.StructField(c, T.DoubleType()) for c in "xywh"])

    def of(name: str) -> T.DataType:
        if name.startswith("list<"):
            return T.ArrayType(of(name[5:-1]))
        if name.startswith("map<"):
            return T.MapType(T.StringType(), of(name[4:-1]))
        return simple[name]

    return T.StructType([T.StructField(n, of(t)) for n, t in (x.split(" ") for x in ddl.split(", "))])


PDF = {
    "doc": _struct("doc_id string, bytes long, page_count int, pdfx string, has_intent boolean, intent_id string, producer string, creator string, pdf_version string, inline_images int, gradients int, patterns int, error string"),
    "page": _struct("doc_id string, page int, media box, crop box, trim box, bleed box, art box, blend string, unreadable boolean, overprint boolean"),
    "font": _struct("doc_id string, font_id int, name string, subset boolean, type string, embedded boolean, pages list<int>"),
    "image": _struct("doc_id string, image_id int, w double, h double, bpc int, mask boolean, family string, label string, spot list<string>, swatches map<string>, filter string, has_smask boolean, uses int"),
    "placement": _struct("doc_id string, seq long, page int, box list<double>, image_id int, family string, label string, mask boolean, soft_mask boolean, px_w double, px_h double, w_pt double, h_pt double, ppi_x double, ppi_y double"),
    "paint": _struct("doc_id string, page int, seq long, key string, kind string, label string, family string, rgb string, rgb2 string, cmyk list<double>, tac double, icc boolean, source string, tint int"),
    "mark": _struct("doc_id string, page int, seq long, k string, box list<double>, label string, tac double"),
    "text": _struct("doc_id string, page int, seq long, str string, font_key string, size double, transform list<double>, vertical boolean"),
}

IDML = {
    "manifest": _struct("doc_id string, kind string, ord int, src string, there boolean"),
    "layer": _struct("doc_id string, self string, name string, visible boolean, locked boolean, printable boolean"),
    "style": _struct("doc_id string, kind string, ord int, self string, name string, based_on string, font string, font_style string, size string, leading string, justification string, fill string, tracking string"),
    "font": _struct("doc_id string, self string, family string, name string, style string, postscript string, status string, type string"),
    "swatch": _struct("doc_id string, id string, type string, name string, space string, model string, value list<double>, base string, tint double, stops list<string>"),
    "story": _struct("doc_id string, story_id string, src string, text string, chars int, tables int, footnotes int, anchored int, notes int, specials int, line_breaks int, variables int, anchored_stories list<string>, paragraphs int"),
    "run": _struct("doc_id string, story_id string, para_ord int, run_ord int, text string, para_style string, p_font string, p_font_style string, p_size string, p_leading string, p_justification string, p_fill string, p_tracking string, char_style string, c_font string, c_font_style string, c_size string, c_leading string, c_justification string, c_fill string, c_tracking string, in_table boolean, range_ord int"),
    "page": _struct("doc_id string, spread_id string, page_id string, ord int, name string, box box, width_pt double, height_pt double, master string, is_master boolean"),
    "item": _struct("doc_id string, spread_id string, item_id string, kind string, ord int, name string, parent_id string, layer_id string, hidden boolean, locked boolean, world list<double>, fill string, stroke string, box box, axis_rect boolean, story_id string, prev string, next string, columns int, inset list<double>, vj string, auto_size string, placed list<string>, linked int, embedded int, text_paths int, is_master boolean"),
}

FINDING = _struct("doc_id string, profile_id string, rule_ord int, level string, id string, detail string, pages list<int>, count int, worst_page int, worst_ppi int")
