"""WCAG contrast from CSS colour strings, as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, half_up

_RGB = r"rgba?\(([^)]+)\)"


def parse(css: Column) -> Column:
    """``rgb()``/``rgba()`` to struct<r,g,b,a>; null when it is neither."""
    nums = F.transform(F.split(F.regexp_extract(css, _RGB, 1), ","), lambda x: F.trim(x).try_cast("double"))
    colour = bind(
        nums,
        lambda n: F.named_struct(
            F.lit("r"), F.get(n, 0), F.lit("g"), F.get(n, 1), F.lit("b"), F.get(n, 2), F.lit("a"), F.coalesce(F.get(n, 3), F.lit(1.0))
        ),
    )
    return F.when(css.rlike(_RGB), colour)


def blend(fg: Column, bg: Column) -> Column:
    """A translucent colour over its background; an opaque one is returned as is."""

    def mix(ch: str) -> Column:
        return fg[ch] * fg["a"] + bg[ch] * (F.lit(1.0) - fg["a"])

    mixed = F.named_struct(F.lit("r"), mix("r"), F.lit("g"), mix("g"), F.lit("b"), mix("b"), F.lit("a"), F.lit(1.0))
    return F.when(fg["a"] >= 1, fg).otherwise(mixed)


def effective_background(chain: Column) -> Column:
    """Fold the background chain (element first) until it is opaque; white otherwise."""
    empty = F.lit(None).cast("struct<r:double,g:double,b:double,a:double>")

    def step(acc: Column, c: Column) -> Column:
        return (
            F.when(acc.isNotNull() & (acc["a"] >= 1), acc)
            .when(c.isNull() | (c["a"] <= 0), acc)
            .when(acc.isNull(), c)
            .otherwise(blend(acc, c))
        )

    white = F.named_struct(F.lit("r"), F.lit(255.0), F.lit("g"), F.lit(255.0), F.lit("b"), F.lit(255.0), F.lit("a"), F.lit(1.0))
    folded = F.aggregate(F.transform(chain, parse), empty, step)
    return bind(folded, lambda f: F.when(f.isNotNull() & (f["a"] >= 1), f).otherwise(white))


def luminance(c: Column) -> Column:
    def channel(v: Column) -> Column:
        return F.when(v <= 0.03928, v / F.lit(12.92)).otherwise(F.pow((v + F.lit(0.055)) / F.lit(1.055), F.lit(2.4)))

    parts = F.transform(F.array(c["r"], c["g"], c["b"]), lambda x: bind(x / F.lit(255.0), channel))
    return bind(parts, lambda p: F.lit(0.2126) * p[0] + F.lit(0.7152) * p[1] + F.lit(0.0722) * p[2])


def contrast_ratio(fg: Column, bg: Column) -> Column:
    """Ratio of two opaque colour structs, two decimals."""

    def ratio(light: Column) -> Column:
        return half_up((F.array_max(light) + F.lit(0.05)) / (F.array_min(light) + F.lit(0.05)), 2)

    return bind(F.array(luminance(fg), luminance(bg)), ratio)


def text_contrast(css: Column, chain: Column) -> Column:
    """Contrast of a CSS colour over its background chain; null when the colour cannot be read."""

    def over(bg: Column) -> Column:
        return bind(parse(css), lambda raw: F.when(raw.isNotNull(), contrast_ratio(blend(raw, bg), bg)))

    return bind(effective_background(chain), over)
