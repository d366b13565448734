"""Texts of fonts that have no ToUnicode map."""

import struct

import pytest

from tests.library.pdfwriter import pdf


def sfnt(tables: dict[bytes, bytes], version: bytes = b"\0\1\0\0") -> bytes:
    out, at = version + struct.pack(">HHHH", len(tables), 0, 0, 0), 12 + 16 * len(tables)
    for tag, data in tables.items():
        out += tag + struct.pack(">III", 0, at, len(data))
        at += len(data)
    return out + b"".join(tables.values())


def cmap(*subs: tuple[int, int, bytes]) -> bytes:
    out, at = struct.pack(">HH", 0, len(subs)), 4 + 8 * len(subs)
    for p, e, data in subs:
        out += struct.pack(">HHI", p, e, at)
        at += len(data)
    return out + b"".join(d for *_, d in subs)


def format4(codes: dict[int, int]) -> bytes:
    """One segment for each code; the last by an offset into an array of glyphs."""
    segments = [(c, c, (g - c) & 0xFFFF, 0) for c, g in sorted(codes.items())]
    last = max(codes)
    segments[-1] = (last, last, 0, 4)  # the array begins behind this offset and the closing one's
    segments.append((0xFFFF, 0xFFFF, 1, 0))
    n = len(segments)
    cols = [[s[k] for s in segments] for k in range(4)]
    body = struct.pack(f">{n}H", *cols[1]) + b"\0\0" + b"".join(struct.pack(f">{n}H", *cols[k]) for k in (0, 2, 3)) + struct.pack(">H", codes[last])
    return struct.pack(">HHHHHHH", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body


def format12(runs: list[tuple[int, int, int]]) -> bytes:
    return struct.pack(">HHIII", 12, 0, 16 + 12 * len(runs), 0, len(runs)) + b"".join(struct.pack(">III", *r) for r in runs)


def index(items: list[bytes]) -> bytes:
    ends = [1]
    for x in items:
        ends.append(ends[-1] + len(x))
    return struct.pack(">HB", len(items), 2) + b"".join(struct.pack(">H", e) for e in ends) + b"".join(items) if items else b"\0\0"


def compact(charset: bytes, n: int, strings: list[bytes], keyed: bool = False) -> bytes:
    """A compact font of n empty glyphs."""
    word = lambda v: b"\x1d" + struct.pack(">i", v)
    ros = word(391) + word(392) + word(0) + b"\x0c\x1e" if keyed else b""
    top = lambda a, b: ros + word(a) + b"\x0f" + word(b) + b"\x11"
    head = lambda a, b: b"\1\0\4\2" + index([b"Font"]) + index([top(a, b)]) + index(strings) + index([])
    at = len(head(0, 0))
    return head(at, at + len(charset)) + charset + index([b"\x0e"] * n)


def one_font(font: str, content: bytes, **objects) -> bytes:
    made = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 9 9] /Contents 4 0 R /Resources << /Font << /F 5 0 R >> >> >>", 4: ("", b"BT /F 9 Tf " + content + b" ET"), 5: font}
    return pdf(made | {int(k[1:]): v for k, v in objects.items()})


TYPE0 = "<< /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+X /Encoding {encoding} /DescendantFonts [6 0 R] >>"
BELOW = "<< /Type /Font /Subtype /{kind} /BaseFont /X /FontDescriptor 7 0 R {more} >>"
TRUETYPE = sfnt({b"cmap": cmap((1, 0, struct.pack(">HHH", 0, 262, 0) + bytes(256)), (3, 1, format4({0x48: 7, 0xE9: 8, 0x20AC: 300})), (3, 10, format12([(0x1F600, 0x1F602, 20)])))})
NAMES = compact(b"\0" + struct.pack(">4H", 41, 207, 391, 392), 5, [b"uni20AC", b"f_i.alt"])
KEYED = sfnt({b"CFF ": compact(b"\2" + struct.pack(">HH", 1000, 2), 4, [b"Adobe", b"Identity"], True), b"cmap": cmap((3, 1, format4({0x41: 1, 0x42: 2, 0x43: 3})))}, b"OTTO")
CMAP = b"1 begincodespacerange <00> <7F> endcodespacerange 1 begincodespacerange <8000> <FFFF> endcodespacerange 1 begincidchar <41> 7 endcidchar 1 begincidrange <8000> <8001> 20 endcidrange"
CASES = {
    "truetype": ("Identity-H", "CIDFontType2", "/CIDToGIDMap /Identity", "FontFile2", TRUETYPE, b"<00070008012C0014> Tj", "Hé€😀"),
    "map of glyphs": ("Identity-V", "CIDFontType2", "/CIDToGIDMap 9 0 R", "FontFile2", TRUETYPE, b"<00010002> Tj", "éH"),
    "embedded encoding": ("10 0 R", "CIDFontType2", "/CIDToGIDMap /Identity", "FontFile2", TRUETYPE, b"<4180008001> Tj", "H😀😁"),
    "names": ("Identity-H", "CIDFontType0", "", "FontFile3", NAMES, b"[<0001> -20 <0002>] TJ <00030004> Tj", "Hé|€fi"),
    "numbers of characters": ("Identity-H", "CIDFontType0", "", "FontFile3", KEYED, b"<03E803E903EA> Tj", "ABC"),
    "unknown glyphs": ("Identity-H", "CIDFontType2", "", "FontFile2", TRUETYPE, b"<00090009> Tj", None),
    "no program": ("Identity-H", "CIDFontType2", "", "Other", TRUETYPE, b"<0007> Tj", None),
    "damaged": ("Identity-H", "CIDFontType2", "", "FontFile2", TRUETYPE[:60], b"<0007> Tj", None),
    "utf-16": ("UniJIS-UTF16-H", "CIDFontType0", "", "Other", b"", b"<65E5672C> Tj", "日本"),
    "shift jis": ("90ms-RKSJ-H", "CIDFontType0", "", "Other", b"", "<%s> Tj" % "日本a".encode("cp932").hex(), "日本a"),
    "gb": ("GBK-EUC-H", "CIDFontType0", "", "Other", b"", "<%s> Tj" % "中文".encode("gbk").hex(), "中文"),
    "seven bits": ("V", "CIDFontType0", "", "Other", b"", b"<467C4B5C> Tj", "日本"),
}


@pytest.mark.parametrize("case", CASES)
def test_composite(case):
    from quoin.sources.pdf import scan_bytes

    encoding, kind, more, file, program, content, want = CASES[case]
    content = content.encode() if isinstance(content, str) else content
    data = one_font(TYPE0.format(encoding=encoding if encoding.endswith(" R") else f"/{encoding}"), content, o6=BELOW.format(kind=kind, more=more), o7=f"<< /Type /FontDescriptor /{file} 8 0 R >>", o8=("", program), o9=("", struct.pack(">3H", 0, 8, 7)), o10=("/Type /CMap", CMAP))
    rows = scan_bytes(data)
    texts = [r["str"] for r in rows["text"]]
    assert ("|".join(texts) if want is not None else texts[0]) == want
    assert not rows["page"][0]["unreadable"] and rows["font"][0]["type"] == "Type0"


def test_simple_encodings():
    from quoin.sources.pdf import scan_bytes
    from quoin.sources.pdffonts import glyph_text

    said = lambda encoding, codes: scan_bytes(one_font(f"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding {encoding} >>", codes))["text"][0]["str"]
    assert said("/WinAnsiEncoding", b"<80E9> Tj") == "€é" and said("/MacRomanEncoding", b"<8E> Tj") == "é"
    assert said("<< /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /uni20AC /f_f_i 65 /Scaron.alt /nowhere] >>", b"<010203414243> Tj") == "é€ffiŠBC"
    assert [glyph_text(n) for n in ("A", "seven", "Ccedilla", "u1F600", "zcaron", "germandbls", "g123", "", "quoteleft")] == ["A", "7", "Ç", "😀", "ž", "ß", None, None, "‘"]
