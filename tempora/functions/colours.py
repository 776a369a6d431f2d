"""Colours, and numbers kept in the four bytes of a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_rgba(n: Column) -> Column:
    """ceil(n) as a big-endian unsigned 32-bit number over [r, g, b, a]."""
    v = F.ceil(n).cast("bigint")
    return F.array(*[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("int") for s in (24, 16, 8, 0)])


def decode_rgba(p: Column) -> Column:
    at = lambda i: F.get(p, F.lit(i)).cast("double")
    return at(0) * 16777216 + at(1) * 65536 + at(2) * 256 + at(3)


def hex_to_rgb(h: Column) -> Column:
    """#rgb, #rrggbb (with or without alpha) to [r, g, b]."""
    return F.slice(hex_to_rgba(h), 1, 3)


def hex_to_rgba(h: Column) -> Column:
    """Alpha as 0 … 1, 1 where the text has none."""
    bare = F.lower(F.regexp_replace(h, "^#", ""))
    full = F.when(F.length(bare) <= 4, F.regexp_replace(bare, "(.)", "$1$1")).otherwise(bare)
    part = lambda i: F.conv(F.substring(full, 2 * i + 1, 2), 16, 10).cast("double")
    return F.array(part(0), part(1), part(2), F.when(F.length(full) >= 8, part(3) / 255).otherwise(F.lit(1.0)))


def rgb_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(c.cast("int"))), 2, "0") for c in (r, g, b)])


def rgba_to_hex(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.concat(rgb_to_hex(r, g, b), F.lpad(F.lower(F.hex(F.floor(a * 255 + 0.5).cast("int"))), 2, "0"))


def _linear(c: Column, edge: float) -> Column:
    s = c / 255.0
    return F.when(s > edge, F.pow((s + 0.055) / 1.055, F.lit(2.4))).otherwise(s / 12.92)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance, 0 … 1."""
    return 0.2126 * _linear(r, 0.03928) + 0.7152 * _linear(g, 0.03928) + 0.0722 * _linear(b, 0.03928)


def text_colour(r: Column, g: Column, b: Column) -> Column:
    return F.when(luminance(r, g, b) > 0.179, "black").otherwise("white")


def to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIELAB under D65 as [L, a, b]."""
    x, y, z = (_linear(c, 0.04045) for c in (r, g, b))
    # sRGB primaries under D65, by white point
    xyz = ((0.4124, 0.3576, 0.1805, 0.95047), (0.2126, 0.7152, 0.0722, 1.0), (0.0193, 0.1192, 0.9505, 1.08883))
    f = lambda t: F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(7.787 * t + 16 / 116)
    fx, fy, fz = (f((p * x + q * y + s * z) / w) for p, q, s, w in xyz)
    return F.array(116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz))


def delta_e(a: Column, b: Column) -> Column:
    """CIE94 difference of two CIELAB arrays."""
    at = lambda v, i: F.get(v, F.lit(i))
    dl, da, db = (at(a, i) - at(b, i) for i in range(3))
    c1, c2 = (F.sqrt(at(v, 1) * at(v, 1) + at(v, 2) * at(v, 2)) for v in (a, b))
    dc = c1 - c2
    dh2 = F.greatest(da * da + db * db - dc * dc, F.lit(0.0))
    return F.sqrt(dl * dl + F.pow(dc / (1 + 0.045 * c1), F.lit(2.0)) + dh2 / F.pow(1 + 0.015 * c1, F.lit(2.0)))


def grey_value(r: Column) -> Column:
    return r / 255.0


def parse_colour(text: Column, names: dict[str, str] | None = None) -> Column:
    """[r, g, b, a] of #rgb, #rgba, #rrggbb, #rrggbbaa, rgb(), rgba() or a name of `names` (name: #rrggbb); null for anything else. a is 0 to 1."""
    low = F.lower(F.trim(text))
    if names:
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        low = F.coalesce(F.element_at(named, low), low)
    short = low.rlike("^#[0-9a-f]{3,4}$")
    digits = F.substring(F.when(short, F.regexp_replace(low, "([0-9a-f])", "$1$1")).otherwise(low), 2, 8)
    pair = lambda i: F.conv(F.substring(digits, i, 2), 16, 10).cast("double")
    alpha = F.when(F.length(digits) == 8, F.round(pair(7) / 255, 4)).otherwise(1.0)
    parts = F.transform(F.regexp_extract_all(low, F.lit(r"[\d.]+"), F.lit(0)), lambda v: v.cast("double"))
    called = F.concat(F.slice(parts, 1, 3), F.array(F.coalesce(F.get(parts, F.lit(3)), F.lit(1.0))))
    return F.when(low.rlike("^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), F.array(pair(1), pair(3), pair(5), alpha)).when(low.rlike(r"^rgba?\([\d.,\s]+\)$") & (F.size(parts) >= 3), called)
