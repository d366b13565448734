"""Colour spaces and functions of PDF, as far as colours can be named and shown."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from quoin.sources.pdfobjects import Document, Name, Stream

# Limits on nesting and on the steps of a calculator function.
SPACE_DEPTH, FUNCTION_DEPTH, STEPS = 5, 6, 5000
PROCESS = ("cyan", "magenta", "yellow", "black")


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def clamp(v: float, lo: float = 0.0, hi: float = 1.0) -> float:
    return lo if v < lo else hi if v > hi else v


def cmyk_rgb(inks: list[float]) -> tuple[int, int, int]:
    from quoin.functions.colour import BLACK, CORNERS

    c, m, y, k = (clamp(v) for v in inks)
    shade = 1 - k * (1 - BLACK / 255)
    total = [0.0, 0.0, 0.0]
    for on, rgb in CORNERS.items():
        part = math.prod(v if o else 1 - v for v, o in zip((c, m, y), on))
        total = [t + part * channel for t, channel in zip(total, rgb)]
    return tuple(half_up(t * shade) for t in total)


def lab_rgb(lightness: float, a: float, b: float) -> tuple[int, int, int]:
    fy, knee = (lightness + 16) / 116, 6 / 29
    back = lambda t: t**3 if t > knee else 3 * knee * knee * (t - 4 / 29)
    x, y, z = 0.9642 * back(fy + a / 500), back(fy), 0.8249 * back(fy - b / 200)
    linear = (3.1338561 * x - 1.6168667 * y - 0.4906146 * z, -0.9787684 * x + 1.9161415 * y + 0.0334540 * z, 0.0719453 * x - 0.2289914 * y + 1.4052427 * z)
    return tuple(half_up(255 * clamp(12.92 * u if u <= 0.0031308 else 1.055 * u ** (1 / 2.4) - 0.055)) for u in linear)


def hexed(rgb) -> str:
    return "#" + "".join(f"{int(clamp(v, 0, 255)):02x}" for v in rgb)


@dataclass(eq=False)
class Space:
    kind: str = "other"
    family: str = "Other"
    label: str = "Other"
    spot: list[str] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    alternate: Space | None = None
    tint: object = None

    def start(self) -> list[float]:
        if self.kind in ("sep", "devn"):
            return [1.0] * max(1, len(self.names))
        return [0.0, 0.0, 0.0, 1.0] if self.kind == "cmyk" else [0.0, 0.0, 0.0]


GRAY, RGB, CMYK = Space("gray", "Gray", "DeviceGray"), Space("rgb", "RGB", "DeviceRGB"), Space("cmyk", "CMYK", "DeviceCMYK")
DEVICE = {"DeviceGray": GRAY, "G": GRAY, "DeviceRGB": RGB, "RGB": RGB, "DeviceCMYK": CMYK, "CMYK": CMYK, "Pattern": Space("pattern", "Pattern", "Pattern")}
CIE = {"CalRGB": Space("rgb", "RGB", "CalRGB"), "CalGray": Space("gray", "Gray", "CalGray"), "Lab": Space("lab", "Lab", "Lab")}
ICC = {1: Space("gray", "Gray", "ICC Gray"), 3: Space("rgb", "RGB", "ICC RGB"), 4: Space("cmyk", "CMYK", "ICC CMYK")}


def space_of(doc: Document, value, resources: dict | None = None, depth: int = 0) -> Space:
    value = doc.get(value)
    if value is None or depth > SPACE_DEPTH:
        return Space()
    if isinstance(value, Name):
        if value in DEVICE:
            return DEVICE[value]
        named = doc.get((doc.get((resources or {}).get("ColorSpace")) or {}).get(value))
        return space_of(doc, named, resources, depth + 1) if named is not None else Space()
    if not isinstance(value, list) or not value:
        return Space()
    kind, rest = doc.get(value[0]), [*value[1:], None, None, None]
    if kind in DEVICE:
        return DEVICE[kind]
    if kind in CIE:
        return CIE[kind]
    if kind == "ICCBased":
        profile = doc.get(rest[0])
        return ICC.get(doc.get(profile.dict.get("N")), Space()) if isinstance(profile, Stream) else Space()
    if kind in ("Indexed", "I"):
        base = space_of(doc, rest[0], resources, depth + 1)
        return Space("indexed", base.family, f"Indexed {base.label}", base.spot)
    if kind in ("Separation", "DeviceN"):
        names = doc.get(rest[0])
        names = [str(doc.get(n) or "?") for n in names] if isinstance(names, list) else [str(names or "Separation")]
        others = [n for n in names if n.lower() not in PROCESS and n != "None" and (kind == "DeviceN" or n != "All")]
        family = "Spot" if others else "CMYK"
        if kind == "Separation" and names[0] in ("All", "None"):
            family = {"All": "Registration", "None": "Other"}[names[0]]
        label = "Registration" if family == "Registration" else str(kind)
        return Space("sep" if kind == "Separation" else "devn", family, label, others, names, space_of(doc, rest[1], resources, depth + 1), rest[2])
    return Space()


def whole(x):
    return math.trunc(x)


def logical(on_bool, on_int):
    return lambda a, b: on_bool(a, b) if isinstance(a, bool) else on_int(int(a), int(b))


BINARY = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b, "idiv": lambda a, b: whole(a / b), "mod": math.fmod,
    "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, "exp": lambda a, b: a**b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b,
    "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "and": logical(lambda a, b: a and b, lambda a, b: a & b), "or": logical(lambda a, b: a or b, lambda a, b: a | b),
    "xor": logical(lambda a, b: a != b, lambda a, b: a ^ b), "bitshift": lambda a, b: int(a) << int(b) if b >= 0 else int(a) >> -int(b),
}
UNARY = {
    "neg": lambda a: -a, "abs": abs, "ceiling": math.ceil, "floor": math.floor, "round": half_up, "truncate": whole, "cvi": whole, "cvr": float, "sqrt": math.sqrt,
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": math.log, "log": math.log10, "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}


def calculate(source: str, inputs: list[float]) -> list[float]:
    """Run a PostScript calculator function."""
    words = iter(source.replace("{", " { ").replace("}", " } ").split())

    def block() -> list:
        out = []
        for w in words:
            if w == "}":
                return out
            out.append(block() if w == "{" else w)
        return out

    if next(words, None) != "{":
        raise ValueError("not a procedure")
    stack, steps = list(inputs), 0

    def run(body: list) -> None:
        nonlocal steps
        held: list[list] = []
        for w in body:
            steps += 1
            if steps > STEPS:
                raise ValueError("too long")
            if isinstance(w, list):
                held.append(w)
            elif w == "if":
                then = held.pop()
                if stack.pop():
                    run(then)
            elif w == "ifelse":
                other, then = held.pop(), held.pop()
                run(then if stack.pop() else other)
            elif w in BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(BINARY[w](a, b))
            elif w in UNARY:
                stack.append(UNARY[w](stack.pop()))
            elif w in ("true", "false"):
                stack.append(w == "true")
            elif w == "pop":
                stack.pop()
            elif w == "dup":
                stack.append(stack[-1])
            elif w == "exch":
                stack[-2:] = stack[:-3:-1]
            elif w == "copy":
                n = int(stack.pop())
                stack.extend(stack[len(stack) - n :] if n > 0 else [])
            elif w == "index":
                n = int(stack.pop())
                stack.append(stack[-1 - n])
            elif w == "roll":
                by, n = int(stack.pop()), int(stack.pop())
                if n > 0:
                    top = stack[-n:]
                    stack[-n:] = top[-(by % n) :] + top[: -(by % n)] if by % n else top
            else:
                stack.append(float(w))

    run(block())
    return [float(x) for x in stack]


def evaluate(doc: Document, function, inputs: list[float], depth: int = 0) -> list[float] | None:
    """The outputs of a function; null if it can't be told."""
    try:
        function = doc.get(function)
        d = function.dict if isinstance(function, Stream) else function
        if not isinstance(d, dict) or depth > FUNCTION_DEPTH:
            return None
        numbers = lambda k: [doc.get(x) for x in v] if isinstance(v := doc.get(d.get(k)), list) else None
        domain, limits, kind = numbers("Domain") or [0, 1], numbers("Range"), doc.get(d.get("FunctionType"))
        x = [clamp(v, *domain[2 * i : 2 * i + 2]) if 2 * i + 1 < len(domain) else v for i, v in enumerate(inputs)]
        if kind == 2:
            zero, one, power = numbers("C0") or [0.0], numbers("C1") or [1.0], doc.get(d.get("N"))
            rise = x[0] ** (1 if power is None else power)
            out = [a + rise * (b - a) for a, b in zip(zero, [*one, *[1.0] * len(zero)])]
        elif kind == 3:
            parts, bounds, encode = doc.get(d["Functions"]), numbers("Bounds") or [], numbers("Encode") or []
            k = sum(1 for b in bounds if x[0] >= b)
            edges = [domain[0], *bounds, domain[1]]
            lo, hi = edges[k], edges[k + 1]
            e0, e1 = encode[2 * k : 2 * k + 2] if len(encode) >= 2 * k + 2 else (0, 1)
            return_ = evaluate(doc, parts[k], [e0 if hi == lo else e0 + (x[0] - lo) * (e1 - e0) / (hi - lo)], depth + 1)
            out = return_
        elif kind == 0 and len(inputs) == 1 and limits:
            size, bits = numbers("Size")[0], doc.get(d["BitsPerSample"])
            encode, decode = numbers("Encode") or [0, size - 1], numbers("Decode") or limits
            n, table, top = len(limits) // 2, int.from_bytes(raw := doc.decoded(function), "big"), (1 << bits) - 1
            total = 8 * len(raw)
            at = clamp(encode[0] + (x[0] - domain[0]) * (encode[1] - encode[0]) / ((domain[1] - domain[0]) or 1), 0, size - 1)
            low = math.floor(at)
            row = lambda i: [decode[2 * k] + (table >> (total - (i * n + k + 1) * bits) & top) * (decode[2 * k + 1] - decode[2 * k]) / top for k in range(n)]
            out = [a + (at - low) * (b - a) for a, b in zip(row(low), row(min(size - 1, low + 1)))]
        elif kind == 4:
            out = calculate(doc.decoded(function).decode("latin-1"), x)
        else:
            return None
        if out and limits:
            out = [clamp(v, *limits[2 * i : 2 * i + 2]) if 2 * i + 1 < len(limits) else v for i, v in enumerate(out)]
        return out if out and all(isinstance(v, int | float) and math.isfinite(v) for v in out) else None
    except (ValueError, IndexError, KeyError, TypeError, ZeroDivisionError, OverflowError, AttributeError):
        return None


def shown(doc: Document, space: Space | None, values: list[float], depth: int = 0) -> tuple[tuple | None, list[float] | None]:
    """(rgb, inks) of a colour, as far as they are known."""
    v = [x if isinstance(x, int | float) and math.isfinite(x) else 0.0 for x in values] + [0.0] * 4
    if space is None or depth > SPACE_DEPTH:
        return None, None
    if space.kind == "gray":
        return (half_up(255 * clamp(v[0])),) * 3, None
    if space.kind == "rgb":
        return tuple(half_up(255 * clamp(x)) for x in v[:3]), None
    if space.kind == "cmyk":
        inks = [clamp(x) for x in v[:4]]
        return cmyk_rgb(inks), inks
    if space.kind == "lab":
        return lab_rgb(*v[:3]), None
    if space.kind in ("sep", "devn"):
        out = evaluate(doc, space.tint, values)
        return shown(doc, space.alternate, out, depth + 1) if out else (None, None)
    return None, None
