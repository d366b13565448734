"""A small writer of PDF files for tests."""

import zlib


def pdf(objects: dict[int, str | tuple[str, bytes]], root: int = 1, extra: str = "", xref: bool = True) -> bytes:
    """A file of numbered objects: text, or (dictionary, stream)."""
    out, places = bytearray(b"%PDF-1.7\n"), {}
    for n, o in objects.items():
        places[n] = len(out)
        if isinstance(o, tuple):
            out += f"{n} 0 obj\n<< {o[0]} /Length {len(o[1])} >>\nstream\n".encode() + o[1] + b"\nendstream\nendobj\n"
        else:
            out += f"{n} 0 obj\n{o}\nendobj\n".encode()
    at = len(out)
    if xref:
        out += f"xref\n0 {max(objects) + 1}\n0000000000 65535 f \n".encode()
        for n in range(1, max(objects) + 1):
            out += (f"{places[n]:010d} 00000 n \n" if n in places else "0000000000 00000 f \n").encode()
    out += f"trailer\n<< /Size {max(objects) + 1} /Root {root} 0 R {extra} >>\nstartxref\n{at if xref else 0}\n%%EOF".encode()
    return bytes(out)


def simple() -> bytes:
    """Two pages: one RGB image at 100 and at 200 ppi, text in a font that is not embedded, an RGB box."""
    b = 8.503937
    page = "<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 200] {boxes} /Resources << /Font << /F1 6 0 R >> /XObject << /Im 7 0 R >> >> /Contents {c} 0 R >>"
    first = b"q 72 0 0 72 20 20 cm /Im Do Q 1 0 0 rg 60 60 50 50 re f 0 0 0 1 k BT /F1 12 Tf 1 0 0 1 30 150 Tm (Hello \\(you\\)) Tj ET"
    return pdf({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 >>",
        3: page.format(boxes=f"/TrimBox [{b} {b} {300 - b} {200 - b}] /BleedBox [0 0 300 200]", c=5), 4: page.format(boxes="", c=8),
        5: ("/Filter /FlateDecode", zlib.compress(first)), 6: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        7: ("/Type /XObject /Subtype /Image /Width 100 /Height 100 /BitsPerComponent 8 /ColorSpace /DeviceRGB", b"\0" * 30000), 8: ("", b"q 36 0 0 36 0 0 cm /Im Do Q"),
    })


def colourful(xref: bool = True) -> bytes:
    """One page with every kind of colour."""
    content = b"""/Spot cs 1 scn 0 0 10 10 re f 0.5 scn 0 0 10 10 re f
/Dn cs 1 scn 5 5 10 10 re f /All CS 1 SCN 9 9 2 2 re S /Sampled cs 1 scn 1 1 2 2 re f /Blk cs 0.5 scn 1 1 2 2 re f
0.8 0.7 0.7 1 k 60 60 20 20 re f 1 0 0 rg 60 10 20 20 re f 0.2 0.4 0.6 rg 0.5 g 1 1 1 1 re f
/G1 gs /Sh1 sh /Sh2 sh 0 0 0 1 k q 2 0 0 2 0 0 cm BT /F 10 Tf 3 Tr (x) Tj 0 Tr (y) Tj ET Q /Form Do"""
    space = lambda name, fn: f"[/Separation /{name} /DeviceCMYK {fn}]"
    tint = "<< /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [{}] /N 1 >>"
    axial = "<< /ShadingType 2 /ColorSpace /{} /Coords [0 0 1 1] /Function << /FunctionType 2 /Domain [0 1] /C0 [{}] /C1 [{}] /N 1 >> >>"
    return pdf({
        1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 200] >>",
        3: "<< /Type /Page /Parent 2 0 R /Contents [4 0 R] /Group << /S /Transparency /CS /DeviceRGB >> /Resources 5 0 R >>", 4: ("", content),
        5: f"""<< /ColorSpace << /Spot {space("PANTONE#20123#20C", tint.format("0 0.19 1 0"))} /Dn [/DeviceN [/Black] /DeviceCMYK 6 0 R] /All {space("All", tint.format("1 1 1 1"))}
            /Sampled {space("SAMPLED#20GREEN", "7 0 R")} /Blk {space("Black", tint.format("0 0 0 1"))} >> /ExtGState << /G1 << /OP true >> >>
            /Shading << /Sh1 {axial.format("DeviceRGB", "1 0 0", "0 0 1")} /Sh2 {axial.format("DeviceCMYK", "0 0 0 0", "1 0 0 0")} >>
            /Font << /F << /Type /Font /Subtype /Type3 /BaseFont /T3 >> >> /XObject << /Form 8 0 R >> >>""",
        6: ("/FunctionType 4 /Domain [0 1] /Range [0 1 0 1 0 1 0 1]", b"{0 0 0 4 -1 roll}"),
        7: ("/FunctionType 0 /Domain [0 1] /Range [0 1 0 1 0 1 0 1] /Size [2] /BitsPerSample 8", bytes([0, 0, 0, 0, 255, 0, 255, 0])),
        8: ("/Type /XObject /Subtype /Form /BBox [0 0 9 9] /Matrix [1 0 0 1 100 100]", b"0 0 1 rg 1 1 2 2 re f"),
    }, xref=xref)
