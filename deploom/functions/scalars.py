"""Scalar functions of the formatting language as columns, with IEEE results where Spark would raise or give null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = float("nan"), float("inf")

#: Unit letters from the largest power of 1024 down.
UNITS = ((60, "E"), (50, "P"), (40, "T"), (30, "G"), (20, "M"), (10, "K"))


def to_float(x: Column) -> Column:
    """Any number, boolean or numeric text; anything else is NaN."""
    return F.coalesce(x.try_cast("double"), F.lit(_NAN))


def to_int(x: Column) -> Column:
    """Truncation toward zero; null where there is no such integer."""
    return to_float(x).try_cast("bigint")


def _divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when(a > 0, F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _fold(f, xs):
    return reduce(f, map(to_float, xs)) if xs else F.lit(_NAN)


def add(*xs: Column) -> Column:
    return _fold(lambda a, b: a + b, xs)


def sub(*xs: Column) -> Column:
    return _fold(lambda a, b: a - b, xs)


def mul(*xs: Column) -> Column:
    return _fold(lambda a, b: a * b, xs)


def div(*xs: Column) -> Column:
    return _fold(_divide, xs)


def round_half_away(x: Column) -> Column:
    return F.round(to_float(x))


def _log(f):
    def out(x: Column) -> Column:
        v = to_float(x)
        return F.when(v == 0, F.lit(-_INF)).when((v < 0) | F.isnan(v), F.lit(_NAN)).otherwise(f(F.when(v > 0, v).otherwise(F.lit(1.0))))

    return out


log, log2, log10 = _log(F.log), _log(F.log2), _log(F.log10)


def _under(prefix: str, id_: Column) -> Column:
    return id_.startswith(prefix + "/")


def rename(id_: Column, *pairs: str) -> Column:
    """First matching prefix is replaced; an odd last prefix becomes ./, an empty replacement drops it."""
    out = None
    for k in range(0, len(pairs), 2):
        prefix, new = pairs[k], pairs[k + 1] if k + 1 < len(pairs) else "./"
        joined = new if new.endswith("/") or new == "" else new + "/"
        rest = F.substring(id_, F.lit(len(prefix) + 2), F.length(id_))
        out = (F if out is None else out).when(id_ == prefix, F.lit(new)).when(_under(prefix, id_), F.concat(F.lit(joined), rest))
    return id_ if out is None else out.otherwise(id_)


def rel(prefix: str, id_: Column) -> Column:
    return rename(id_, prefix)


def json(x: Column) -> Column:
    return F.to_json(x)


def _sized(size: Column, digits: int, suffix: str) -> Column:
    """Half-even at ``digits``; a unit from two thirds of its power on (integer division)."""
    s = F.abs(size)
    sign = F.when(size < 0, F.lit("-")).otherwise(F.lit(""))
    out = None
    for power, unit in UNITS:
        step = 1 << power
        value = F.bround(s.cast("double") / F.lit(float(step)), digits)
        out = (F if out is None else out).when(s >= step * 2 // 3, F.format_string(f"%.{digits}f{unit}{suffix}", value))
    return F.concat(sign, out.otherwise(F.concat(s.cast("string"), F.lit("B"))))


def mem_string(size: Column) -> Column:
    return _sized(size.cast("bigint"), 1, "B")


def mem_string_short(size: Column) -> Column:
    return _sized(size.cast("bigint"), 2, "")


def _once(value: Column, f) -> Column:
    """``f`` of ``value``, which is worked out once however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def line_stats(text: Column) -> Column:
    """struct(files, binary, size, lines, blank) of a source text; sizes are bytes, a NUL makes it binary."""
    zero = F.lit(0).cast("bigint")
    holds = lambda line: line.rlike(r"[^\r \t]")

    def stats(t, parts, filled):
        nul = F.instr(t, F.lit("\x00")) > 0
        blank = F.size(parts) - filled - F.when(holds(F.element_at(parts, -1)), 0).otherwise(1)
        return F.struct(
            F.when(nul, 0).otherwise(1).cast("bigint").alias("files"),
            F.when(nul, 1).otherwise(0).cast("bigint").alias("binary"),
            F.octet_length(t).cast("bigint").alias("size"),
            F.when(nul, zero).otherwise(filled.cast("bigint")).alias("lines"),
            F.when(nul, zero).otherwise(blank.cast("bigint")).alias("blank"),
        )

    return _once(text, lambda t: _once(F.split(t, "\n", -1), lambda parts: _once(F.size(F.filter(parts, holds)), lambda filled: stats(t, parts, filled))))


def hue_number(path: Column) -> Column:
    """First two bytes of the SHA-256 of a path."""
    return F.conv(F.substring(F.sha2(path, 256), 1, 4), 16, 10).cast("bigint")


def hsl_hex(hue: Column, saturation: float, lightness: float, alpha: float | None = None) -> Column:
    """#rrggbb[aa]; channels are truncated, not rounded."""
    top = lightness * (1 + saturation) if lightness < 0.5 else lightness + saturation - saturation * lightness
    low = 2 * lightness - top

    def channel(h: Column) -> Column:
        h = F.when(h < 0, h + 1).when(h > 1, h - 1).otherwise(h)
        v = F.when(6 * h < 1, low + (top - low) * 6 * h).when(2 * h < 1, F.lit(top)).when(3 * h < 2, low + (top - low) * (2.0 / 3.0 - h) * 6).otherwise(F.lit(low))
        return _byte(v)

    h = hue - F.floor(hue)
    parts = [channel(h + 1.0 / 3.0), channel(h), channel(h - 1.0 / 3.0)]
    if alpha is not None:
        parts.append(_byte(F.lit(alpha)))
    return F.lower(F.concat(F.lit("#"), *parts))


def _byte(v: Column) -> Column:
    n = F.least(F.lit(255.0), F.greatest(F.lit(0.0), v * 255.0)).cast("int")
    return F.lpad(F.hex(n), 2, "0")


def path_color(path: Column, saturation: float, lightness: float, alpha: float | None = None) -> Column:
    # bound, so that the digest is worked out once and not wherever the formula names it
    hue = F.array(hue_number(path).cast("double") / 65535.0)
    return F.element_at(F.transform(hue, lambda h: hsl_hex(h, saturation, lightness, alpha)), 1)
