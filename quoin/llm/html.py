"""Main text of web pages, with site templates found by counting subtrees in Spark."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._spark import materialise

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>|<[/!?a-zA-Z][^<>]*\Z", re.S)
NAMED = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
SPACES = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: nothing in these is markup, up to the end tag
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
FURNITURE = frozenset("head nav footer aside form menu button select dialog".split()) | RAW
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: of RAW, those whose end tag is looked for to the end of the page
LETTERS = frozenset("script style textarea title iframe".split())
ZONE = frozenset(["article", "main"])
WHOLE = ZONE | {"html", "body"}
HEAD_ONLY = frozenset("base head html link meta noscript script style template title".split())
#: an opening tag ends an open element of the same family, up to the nearest scope
FAMILY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div dl footer form header html li main nav ol section table td th ul".split())
#: words of class, id and role that mark what is not the article
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies contentinfo copyright disqus footer hidden login menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
REMARKS = frozenset("comment comments disqus replies reply respond".split())
#: words that may stand beside a mark in one class, as in cookie-banner-box or related-posts
BESIDE = frozenset("area bar block bottom box buttons container content form global icons inner item items left links list main menu outer overlay page panel posts right section site slot text thread top unit wrap wrapper".split())
#: A subtree is template if it recurs on so many pages of its host, and on such a share of them.
PAGES, SHARE = 5, 0.05
#: Elements below this depth stand beside each other; none of their text is lost.
DEPTH = 256


def marks_of(attributes: str) -> set[str]:
    """The marks among the classes, ids and roles of a tag: a mark itself, or marks joined
    with each other and with words of BESIDE; any other word beside them makes a name of its own."""
    out = set()
    for v in NAMED.findall(attributes):
        for name in v.strip("\"'").split():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower())
            if all(w in MARKS or w in BESIDE for w in words):
                out.update(MARKS.intersection(words))
    return out


class Element:
    """An open or closed element; gone, zone and link hold for all that is in it."""

    __slots__ = ("tag", "parent", "gone", "zone", "link", "marked", "closed", "parts", "chars", "linked", "hash", "place")

    def __init__(self, tag: str, parent: Element | None, gone: bool = False, zone: bool = False, link: bool = False, marked: int = 0):
        self.tag, self.parent, self.gone, self.zone, self.link, self.marked = tag, parent, gone, zone, link, marked
        self.closed, self.parts, self.chars, self.linked, self.hash, self.place = False, [tag], 0, 0, None, -1

    def close(self) -> None:
        """Hash the subtree, if it has text, and count it in the parent."""
        self.closed = True
        if self.chars:
            self.hash = xxhash.xxh64_intdigest("\x00".join(self.parts)) - (1 << 63)
            self.parent.parts.append(str(self.hash))
            self.parent.chars += self.chars
            self.parent.linked += self.linked
        self.parts.clear()


class Tree:
    """The elements of a page, and its blocks of text outside page furniture."""

    def __init__(self, page: str):
        self.page, self.root = page, Element("", None)
        self.stack, self.elements = [self.root], [self.root]
        self.blocks: list[tuple[str, Element]] = []
        self.buffer: list[tuple[str, bool]] = []  # text, in a link
        self.holder: Element | None = None  # of the first text of the block
        self.in_head, self.unclosed = False, set()
        at, last = 0, page.rfind(">")
        while at <= last:
            m = TOKEN.search(page, at)
            if m is None or m.end() > last + 1:
                break
            self.text(page[at : m.start()])
            at = m.end() if m[2] is None else self.end(m) if m[1] else self.start(m)
        rest = page[at:]  # no tag ends here
        cut = re.search(r"<[/!?a-zA-Z]", rest)
        self.text(rest[: cut.start()] if cut else rest)
        self.flush()
        self.close(1)

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if text and not top.gone:
            if self.holder is None and not text.isspace():
                self.holder = top
            self.buffer.append((text, top.link))

    def flush(self) -> None:
        if self.holder is not None:
            text = SPACES.sub(" ", entities.unescape("".join(t for t, _ in self.buffer))).strip()
            if text:
                e = self.holder
                while e.closed:
                    e = e.parent
                e.parts.append(text)
                e.chars += len(text)
                linked = sum(len(t.strip()) for t, link in self.buffer if link)
                e.linked += len(text) if 2 * linked >= sum(len(t.strip()) for t, _ in self.buffer) else 0
                self.blocks.append((text, e))
        self.buffer.clear()
        self.holder = None

    def close(self, upto: int) -> None:
        while len(self.stack) > upto:
            e = self.stack[-1]
            if e.tag in BLOCK:
                self.flush()
            self.stack.pop().close()
            self.in_head = self.in_head and e.tag != "head"

    def open(self, e: Element) -> None:
        if len(self.stack) > DEPTH:
            self.close(len(self.stack) - 1)
            e.parent = self.stack[-1]
        self.stack.append(e)
        self.elements.append(e)

    def end(self, m: re.Match) -> int:
        tag = m[2].lower()
        if tag in BLOCK:
            self.flush()
        k = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k].tag == tag), 0)
        if k:
            self.close(k)
        return m.end()

    def end_implied(self, tag: str) -> None:
        """Close what an opening block ends: a paragraph, or an element of its family."""
        for k in range(len(self.stack) - 1, 0, -1):
            open_tag = self.stack[k].tag
            if open_tag == "p" or open_tag in FAMILY.get(tag, ()):
                self.close(k)
                if tag != "tr" or all(e.tag not in FAMILY["tr"] for e in self.stack[max(1, k - 2) :]):
                    return
            elif open_tag in SCOPE:
                return

    def start(self, m: re.Match) -> int:
        tag, attributes, at = m[2].lower(), m[3] or "", m.end()
        if tag == "br":
            self.text(" ")
            return at
        if tag in BLOCK:
            self.flush()
            self.end_implied(tag)
        if self.in_head and tag not in HEAD_ONLY:
            self.close(next(k for k in range(1, len(self.stack)) if self.stack[k].tag == "head"))
        if tag in VOID or (tag in ("svg", "math") and attributes.endswith("/")):
            return at
        up = self.stack[-1]
        if tag in RAW:
            end = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(self.page, at)
            if end is None:
                self.unclosed.add(tag)
                if tag in LETTERS:  # no markup up to the end of the page
                    return len(self.page)
            self.open(Element(tag, up, True))
            return end.start() if end else at
        marks = marks_of(attributes)
        gone = up.gone or tag in FURNITURE or (tag == "header" and not up.zone) or (tag == "article" and bool(marks & {"comment", "comments", "reply", "related", "promo"}))
        marked = 0 if tag in WHOLE or not marks else 2 if marks & REMARKS else 1
        self.open(Element(tag, up, gone, not gone and (up.zone or tag in ZONE), up.link or tag == "a", marked))
        self.in_head = self.in_head or tag == "head"
        return at


def unmarked(tree: Tree) -> list[tuple[str, Element]]:
    """The blocks outside elements that their names mark. Names don't count on what holds
    the article, where no article or main stands outside marks, nor on an element with more
    than half of the text of a page that has neither, unless it is one of readers' remarks."""
    under: dict[Element, bool] = {}

    def marked(e: Element | None) -> bool:
        chain = []
        while e is not None and e not in under:
            chain.append(e)
            e = e.parent
        got = under[e] if e is not None else False
        for x in reversed(chain):
            got = under[x] = got or x.marked > 0
        return got

    zones = [e for e in tree.elements if e.tag in ZONE and e.zone and e.chars]
    if zones and all(marked(e) for e in zones):
        for e in zones:
            while (e := e.parent) is not None and e.marked >= 0:
                e.marked = -1  # seen, and no mark
        under.clear()
    elif not zones:
        for e in tree.elements:
            if e.marked == 1 and 2 * e.chars > tree.root.chars:
                e.marked = 0
        under.clear()
    return [b for b in tree.blocks if not marked(b[1])]


def parse(page: str | None) -> dict[str, list]:
    """The blocks of a page: texts, and for each the element that holds it (at), elements
    given by their parents (before them; -1 at the top) and by the hash of the subtree that
    they may be deleted as (0 for none); and the hashes of all subtrees with text (subtrees).

    Where a page has an article or a main part, its blocks are those inside it, and there
    only subtrees that are mostly links may be deleted: prose may recur, as in copies of an
    article. The time is in proportion to the page, however its tags are nested.
    """
    tree = Tree(page or "")
    blocks = unmarked(tree)
    zone = any(e.zone for _, e in blocks)
    blocks = [b for b in blocks if b[1].zone or not zone]
    parents, hashes, at = [], [], []
    for _, e in blocks:
        chain = []
        while e is not None and e.place < 0:
            chain.append(e)
            e = e.parent
        for x in reversed(chain):
            may = x.hash is not None and x.tag not in WHOLE and (not zone or 2 * x.linked >= x.chars)
            parents.append(x.parent.place if x.parent is not None else -1)
            hashes.append(x.hash if may else 0)
            x.place = len(parents) - 1
    at = [e.place for _, e in blocks]
    return {"texts": [t for t, _ in blocks], "at": at, "parents": parents, "hashes": hashes, "subtrees": sorted({e.hash for e in tree.elements if e.hash is not None})}


def left_of(page: dict, gone: set[int]) -> list[str]:
    """The texts of a parsed page outside the subtrees that are gone."""
    dead: list[bool] = []
    for p, h in zip(page["parents"], page["hashes"]):
        dead.append((h != 0 and h in gone) or (p >= 0 and dead[p]))
    return [t for t, e in zip(page["texts"], page["at"]) if not dead[e]]


def host_of(url: pd.Series) -> pd.Series:
    return url.fillna("").str.extract(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", expand=False).fillna("").str.lower()


COLUMNS = "texts array<string>, at array<int>, parents array<int>, hashes array<bigint>, subtrees array<bigint>"


def page_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for k in range(0, len(b), 100):
            part = b.iloc[k : k + 100]
            parsed = pd.DataFrame([parse(h) for h in part["html"]])
            yield pd.concat([part[["id", "url"]].reset_index(drop=True), host_of(part["url"]).rename("host").reset_index(drop=True), parsed], axis=1)


def text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts, deleted = [], []
        for texts_of, at, parents, hashes, gone in zip(b["texts"], b["at"], b["parents"], b["hashes"], b["gone"]):
            left = list(texts_of)
            if gone is not None and len(gone):
                left = left_of({"texts": texts_of, "at": np.asarray(at).tolist(), "parents": np.asarray(parents).tolist(), "hashes": np.asarray(hashes).tolist()}, set(np.asarray(gone).tolist()))
            texts.append("\n".join(left))
            deleted.append(len(texts_of) - len(left))
        yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": texts, "n_deleted": deleted})


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = PAGES, share: float = SHARE) -> DataFrame:
    """The main text of each page: id_col, url, text, n_chars (code points), n_deleted.

    Each page is parsed once, in whole. Scripts, styles, menus, headers outside articles,
    footers, sidebars, forms, notices, adverts and comments go by their tags and by whole
    names in their class, id and role (unmarked tells where names don't count). Every
    element's subtree is hashed; Spark counts the pages of each host that hold a hash, and
    blocks in a subtree found on `least` pages and on `share` of the host's pages or more
    are deleted. Where a page has an article or a main part, its text is theirs, and in them
    only lists of links count as template, since an article and its copies may stand on many
    pages. Character references are decoded, white space in a block becomes one space,
    blocks are joined by one newline in page order.

    Pages of a hot host are spread: counts are combined before the shuffle, and only
    pages that could lose a block take part in the join. Null or empty html gives an empty
    text; null urls form one host; repeated rows are separate pages (each is counted and
    returned); an empty table gives no rows; other columns are not read, so none can clash.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    parsed = materialise(rows.mapInPandas(page_rows, f"id {kind}, url string, host string, {COLUMNS}").withColumn("row", F.monotonically_increasing_id()), "pages")
    hosts = parsed.groupBy("host").agg(F.count("*").alias("of_host"))
    found = parsed.select("host", F.explode("subtrees").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    templates = found.join(hosts, "host").where(F.col("n") >= share * F.col("of_host")).select("host", "hash")
    open_hashes = parsed.select("row", "host", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash != 0")
    hits = open_hashes.join(templates, ["host", "hash"]).groupBy("row").agg(F.collect_set("hash").alias("gone"))
    columns = ["id", "url", "texts", "at", "parents", "hashes"]
    may = F.exists("hashes", lambda h: h != 0)  # pages that could not lose a block stay out of the join
    both = parsed.where(may).join(hits, "row", "left").select(*columns, "gone")
    both = both.unionByName(parsed.where(~may).select(*columns, F.lit(None).cast("array<bigint>").alias("gone")))
    out = both.mapInPandas(text_rows, f"id {kind}, url string, text string, n_deleted int")
    return out.withColumnRenamed("id", id_col).withColumn("n_chars", F.length("text").cast("long"))
