"""What the codes of a font say: ToUnicode maps, encodings, and the tables of embedded fonts read backwards."""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

from quoin.sources.pdfobjects import Document, Keyword, Name, Reader, Stream

Says = Callable[[bytes], str | None]

# Glyph names in the order of the standard strings of compact fonts, from number 1 on, without letters
# (34 to 59 and 66 to 91), and the characters of numbers 96 to 228.
STANDARD_NAMES = """
space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash
zero one two three four five six seven eight nine colon semicolon less equal greater question at
bracketleft backslash bracketright asciicircum underscore quoteleft
braceleft bar braceright asciitilde
exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl endash dagger daggerdbl
periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron
breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls
onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters twosuperior registered minus eth multiply
threesuperior copyright
""".split()
STANDARD_CHARACTERS = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ–†‡·¶•‚„”»…‰¿`´ˆ˜¯˘˙¨˚¸˝˛ˇ—ÆªŁØŒºæıłøœß¹¬µ™Ð½±Þ¼÷¦°þ¾²®−ð×³©ÁÂÄÀÅÃÇÉÊËÈÍÎÏÌÑÓÔÖÒÕŠÚÛÜÙÝŸŽáâäàåãçéêëèíîïìñóôöòõšúûüùýÿž"
# Accents in names of letters, and the codecs of predefined encodings of composite fonts.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "macron": "̄", "breve": "̆", "dotaccent": "̇", "dieresis": "̈", "ring": "̊", "hungarumlaut": "̋", "caron": "̌", "cedilla": "̧", "ogonek": "̨"}
CODECS = [
    (r"Uni\w+-UTF8-", "utf-8"), (r"Uni\w+-UTF16-", "utf-16-be"), (r"Uni\w+-UTF32-", "utf-32-be"), (r"Uni\w+-UCS2-", "utf-16-be"),
    (r"GBK2K-", "gb18030"), (r"GBKp?-EUC-", "gbk"), (r"GB(pc)?-EUC-", "gb2312"), (r"HKscs-B5-", "big5hkscs"), (r"(B5pc|ETen-B5|ETenms-B5)-", "cp950"),
    (r"(90ms|90msp)-RKSJ-", "cp932"), (r"(83pv|90pv|Add|Ext)-RKSJ-", "shift_jis"), (r"EUC-[HV]$", "euc_jp"), (r"KSCms-UHC-", "cp949"), (r"KSC(pc)?-EUC-", "euc_kr"),
]


def standard(n: int) -> str | None:
    """The character of a standard string; 1 to 95 are those of ASCII but for the two quotes."""
    if 1 <= n <= 95:
        return {8: "’", 65: "‘"}.get(n, chr(31 + n))
    return STANDARD_CHARACTERS[n - 96] if 96 <= n < 96 + len(STANDARD_CHARACTERS) else None


def _named() -> dict[str, str]:
    letters = (*range(34, 60), *range(66, 92))
    return dict(zip(STANDARD_NAMES, (standard(n) for n in range(1, 171) if n not in letters)))


NAMED = _named()


def glyph_text(name: str) -> str | None:
    """The text of a glyph by its name: a letter, a letter with an accent, a known name, a number of
    a character; what follows a dot says only how it looks, underscores join parts."""
    name = name.partition(".")[0]
    if "_" in name:
        parts = [glyph_text(p) for p in name.split("_")]
        return "".join(parts) if all(parts) else None
    if name in NAMED:
        return NAMED[name]
    if len(name) == 1 and name.isalpha():
        return name
    if re.fullmatch(r"uni(?:[0-9A-F]{4})+", name):
        return bytes.fromhex(name[3:]).decode("utf-16-be", "replace")
    if re.fullmatch(r"u[0-9A-F]{4,6}", name) and int(name[1:], 16) < 0x110000:
        return chr(int(name[1:], 16))
    if name[:1].isalpha() and name[1:] in ACCENTS:
        made = unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
        return made if len(made) == 1 else None
    return None


# ---- embedded programs
def sfnt_tables(data: bytes) -> dict[str, bytes]:
    n = struct.unpack_from(">H", data, 4)[0]
    found = (struct.unpack_from(">4sIII", data, 12 + 16 * k) for k in range(n))
    return {tag.decode("latin-1"): data[at : at + size] for tag, _, at, size in found}


def mapped(table: bytes) -> Iterator[tuple[int, int]]:
    """(code, glyph) of one subtable of cmap, of formats 0, 4, 6, 10, 12 and 13."""
    kind = struct.unpack_from(">H", table)[0]
    if kind == 0:
        yield from enumerate(table[6:262])
    elif kind == 4:
        n = struct.unpack_from(">H", table, 6)[0] // 2
        ends, starts, deltas, offsets = (struct.unpack_from(f">{n}H", table, at) for at in (14, 16 + 2 * n, 16 + 4 * n, 16 + 6 * n))
        for k, (end, start, delta, offset) in enumerate(zip(ends, starts, deltas, offsets)):
            for code in range(start, min(end, 0xFFFE) + 1):
                glyph = code
                if offset:
                    at = 16 + 6 * n + 2 * k + offset + 2 * (code - start)
                    glyph = struct.unpack_from(">H", table, at)[0] if at + 2 <= len(table) else 0
                yield code, (glyph + delta) & 0xFFFF if glyph or not offset else 0
    elif kind == 6:
        first, n = struct.unpack_from(">HH", table, 6)
        yield from zip(range(first, first + n), struct.unpack_from(f">{n}H", table, 10))
    elif kind == 10:
        first, n = struct.unpack_from(">II", table, 12)
        yield from zip(range(first, first + n), struct.unpack_from(f">{n}H", table, 20))
    elif kind in (12, 13):
        for k in range(struct.unpack_from(">I", table, 12)[0]):
            first, last, glyph = struct.unpack_from(">III", table, 16 + 12 * k)
            for code in range(first, min(last, 0x10FFFF) + 1):
                yield code, glyph + (code - first if kind == 12 else 0)


def subtables(cmap: bytes) -> dict[tuple[int, int], bytes]:
    n = struct.unpack_from(">H", cmap, 2)[0]
    return {(p, e): cmap[at:] for p, e, at in (struct.unpack_from(">HHI", cmap, 4 + 8 * k) for k in range(n))}


def unicode_glyphs(cmap: bytes) -> dict[int, str]:
    """glyph -> character: the least character that leads to it, of the widest subtable."""
    tables, out = subtables(cmap), {}
    order = [(3, 10), (0, 6), (0, 4), (3, 1), (0, 3), (0, 2), (0, 1), (0, 0), (3, 0), (1, 0)]
    for key in (k for k in order if k in tables):
        for code, glyph in sorted(mapped(tables[key])):
            if key == (1, 0):
                said = bytes([code]).decode("mac_roman") if code < 256 else ""
            else:
                said = chr(code - 0xF000 if key == (3, 0) and 0xF000 <= code < 0xF100 else code)
            if glyph and said:
                out.setdefault(glyph, said)
    return out


def index_of(data: bytes, at: int) -> tuple[list[bytes], int]:
    """(entries, end) of an index of a compact font."""
    n = struct.unpack_from(">H", data, at)[0]
    if not n:
        return [], at + 2
    size, at = data[at + 2], at + 3
    ends = [int.from_bytes(data[at + size * k : at + size * (k + 1)], "big") for k in range(n + 1)]
    base = at + size * (n + 1) - 1
    return [data[base + a : base + b] for a, b in zip(ends, ends[1:])], base + ends[-1]


def dictionary(data: bytes) -> dict[int, list[float]]:
    """operator -> operands; two-byte operators are 1200 and more. Real numbers are not needed and read as 0."""
    out, operands, i = {}, [], 0
    while i < len(data):
        b = data[i]
        i += 1
        if b <= 21:
            if b == 12:
                b, i = 1200 + data[i], i + 1
            out[b], operands = operands, []
        elif b == 28:
            operands.append(struct.unpack_from(">h", data, i)[0])
            i += 2
        elif b == 29:
            operands.append(struct.unpack_from(">i", data, i)[0])
            i += 4
        elif b == 30:
            while data[i] & 15 != 15 and data[i] >> 4 != 15:
                i += 1
            operands.append(0)
            i += 1
        elif b <= 246:
            operands.append(b - 139)
        elif b <= 250:
            operands.append((b - 247) * 256 + data[i] + 108)
            i += 1
        elif b <= 254:
            operands.append(-(b - 251) * 256 - data[i] - 108)
            i += 1
    return out


def compact_glyphs(data: bytes) -> tuple[bool, dict[int, int | str]]:
    """(whether glyphs have numbers of characters, glyph -> that number, or else its text by its name)."""
    _, at = index_of(data, data[2])
    tops, at = index_of(data, at)
    strings, _ = index_of(data, at)
    top = dictionary(tops[0])
    n = struct.unpack_from(">H", data, int(top[17][0]))[0]
    where, keyed = int((top.get(15) or [0])[0]), 1230 in top
    names: list[int] = [0]
    if where > 2:
        kind, at = data[where], where + 1
        while len(names) < n:
            first = struct.unpack_from(">H", data, at)[0]
            more = data[at + 2] if kind == 1 else struct.unpack_from(">H", data, at + 2)[0] if kind == 2 else 0
            names += range(first, first + more + 1)
            at += (2, 3, 4)[kind]
    else:
        names = list(range(n if where == 0 else 1))
    if keyed:
        return True, dict(enumerate(names[:n]))
    found = {}
    for glyph, sid in enumerate(names[:n]):
        said = standard(sid) if sid < 391 else glyph_text(strings[sid - 391].decode("latin-1")) if sid - 391 < len(strings) else None
        if said:
            found[glyph] = said
    return False, found


# ---- codes
def operands(data: bytes) -> Iterator[tuple[bytes, list]]:
    """(operator, operands) of a map's program."""
    r, held = Reader(data), []
    while True:
        r.gap()
        if r.at >= len(data):
            return
        v = r.value()
        if isinstance(v, Keyword):
            yield bytes(v), held
            held = []
        else:
            held.append(v)


def number(code: bytes) -> int:
    return int.from_bytes(code, "big")


class Codes:
    """A map from codes of several lengths, told apart by code spaces, to characters' numbers or texts."""

    def __init__(self):
        self.spaces: list[tuple[bytes, bytes]] = []
        self.single: dict[bytes, int | str] = {}
        self.runs: list[tuple[bytes, bytes, int]] = []

    def read(self, data: bytes, used: Callable[[str], Codes | None] | None = None) -> Codes:
        for op, held in operands(data):
            strings = [x for x in held if isinstance(x, bytes)]
            if op == b"usecmap" and held and isinstance(held[-1], Name) and used and (other := used(str(held[-1]))):
                self.spaces, self.runs, self.single = self.spaces + other.spaces, self.runs + other.runs, other.single | self.single
            elif op == b"endcodespacerange":
                self.spaces += list(zip(strings[::2], strings[1::2]))
            elif op == b"endcidchar":
                self.single |= dict(zip(held[::2], held[1::2]))
            elif op == b"endcidrange":
                self.runs += [(lo, hi, first) for lo, hi, first in zip(held[::3], held[1::3], held[2::3])]
        return self

    def split(self, text: bytes) -> Iterator[bytes]:
        at, longest = 0, max((len(lo) for lo, _ in self.spaces), default=2)
        while at < len(text):
            size = next((n for n in range(1, longest + 1) if any(len(lo) == n and len(text) >= at + n and all(a <= c <= b for a, c, b in zip(lo, text[at : at + n], hi)) for lo, hi in self.spaces)), None)
            size = size or min((len(lo) for lo, _ in self.spaces), default=2)
            yield text[at : at + size]
            at += size

    def cid(self, code: bytes) -> int | str | None:
        if code in self.single:
            return self.single[code]
        return next((first + number(code) - number(lo) for lo, hi, first in self.runs if len(lo) == len(code) and lo <= code <= hi), None)


IDENTITY = Codes()
IDENTITY.spaces, IDENTITY.runs = [(b"\0\0", b"\xff\xff")], [(b"\0\0", b"\xff\xff", 0)]


def composite(doc: Document, font: dict) -> Says | None:
    """What the codes of a composite font without a ToUnicode map say, from its encoding's
    name, if that tells it, or else from the glyphs of its embedded program."""
    get = lambda d, k: doc.get((d.dict if isinstance(d, Stream) else d).get(k)) if isinstance(d, dict | Stream) else None
    encoding = get(font, "Encoding")
    if isinstance(encoding, Name):
        codec = next((c for pattern, c in CODECS if re.match(pattern, encoding)), None)
        if codec:
            return lambda text: text.decode(codec, "replace")
        if encoding in ("H", "V"):  # rows and cells of the Japanese set in seven bits
            return lambda text: bytes(b | 0x80 for b in text).decode("euc_jp", "replace")
        codes = IDENTITY if encoding in ("Identity-H", "Identity-V") else None
    else:
        codes = Codes().read(doc.decoded(encoding), lambda n: IDENTITY if n.startswith("Identity") else None) if isinstance(encoding, Stream) else IDENTITY
    below = get(font, "DescendantFonts")
    below = doc.get(below[0]) if isinstance(below, list) and below else None
    descriptor = get(below, "FontDescriptor")
    if codes is None or not isinstance(descriptor, dict):
        return None
    program = next((p for k in ("FontFile2", "FontFile3") if isinstance(p := get(descriptor, k), Stream)), None)
    if program is None:
        return None
    data = doc.decoded(program)
    glyphs: dict[int, str] = {}
    numbered = None  # character number -> glyph
    if data[:4] in (b"\0\1\0\0", b"true", b"OTTO"):
        tables = sfnt_tables(data)
        glyphs = unicode_glyphs(tables["cmap"]) if "cmap" in tables else {}
        data = tables.get("CFF ", b"")
    if data[:1] == b"\1" and (data[1:2] in (b"\0", b"\1")):
        keyed, found = compact_glyphs(data)
        if keyed:
            numbered = {c: g for g, c in found.items()}
        else:
            glyphs = {g: t for g, t in found.items() if isinstance(t, str)} | glyphs
    to = get(below, "CIDToGIDMap")
    table = doc.decoded(to) if isinstance(to, Stream) else None

    def glyph(cid: int) -> int:
        if table is not None:
            return number(table[2 * cid : 2 * cid + 2])
        return numbered.get(cid, 0) if numbered is not None else cid

    def say(text: bytes) -> str | None:
        out = "".join(glyphs.get(glyph(c), "") for code in codes.split(text) if isinstance(c := codes.cid(code), int))
        return out or None

    return say if glyphs else None


def simple(doc: Document, font: dict) -> Says:
    """What the bytes of a simple font say: its base encoding, and names of glyphs that differ from it."""
    encoding = doc.get(font.get("Encoding"))
    base = doc.get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
    codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
    table = {bytes([c]): bytes([c]).decode(codec, "replace") for c in range(256)}
    differ = doc.get(encoding.get("Differences")) if isinstance(encoding, dict) else None
    at = 0
    for x in map(doc.get, differ if isinstance(differ, list) else []):
        if isinstance(x, Name):
            said = glyph_text(str(x))
            if said is not None and at < 256:
                table[bytes([at])] = said
            at += 1
        elif isinstance(x, int):
            at = x
    return lambda text: "".join(table[bytes([c])] for c in text)


def to_unicode(data: bytes) -> Says:
    """A ToUnicode map's codes, all of the length of the longest."""
    utf = lambda b: b.decode("utf-16-be", "replace")
    table: dict[bytes, str] = {}
    for op, held in operands(data):
        if op == b"endbfchar":
            table |= {a: utf(b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)}
        elif op == b"endbfrange":
            for lo, hi, to in zip(held[::3], held[1::3], held[2::3]):
                for k, code in enumerate(range(number(lo), number(hi) + 1)):
                    if isinstance(to, list):
                        said = utf(to[k]) if k < len(to) else ""
                    else:
                        said = utf(to[:-2]) + utf((number(to[-2:]) + k).to_bytes(2, "big"))
                    table[code.to_bytes(len(lo), "big")] = said
    width = max(map(len, table), default=1)
    return lambda text: "".join(table.get(text[k : k + width], "") for k in range(0, len(text), width)) or None


def says(doc: Document, font: dict) -> Says | None:
    """How to read the codes of a font; null if nothing tells."""
    to = doc.get(font.get("ToUnicode"))
    try:
        if isinstance(to, Stream):
            return to_unicode(doc.decoded(to))
        return composite(doc, font) if doc.get(font.get("Subtype")) == "Type0" else simple(doc, font)
    except (ValueError, KeyError, IndexError, TypeError, AttributeError, struct.error, OverflowError):
        return None
