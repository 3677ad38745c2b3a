"""Per-pixel columns: grey levels, optical densities, stain projections and fields."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit-free stain vectors of the literature; sirius_red has no verified source.
STAINS = {"hematoxylin": (0.65, 0.70, 0.29), "eosin": (0.2159, 0.8012, 0.5581), "dab": (0.27, 0.57, 0.78), "sirius_red": (0.36, 0.66, 0.66)}
VERIFIED = {"hematoxylin", "eosin", "dab"}
# Presets of two domains.
PRESETS = {
    "he-ihc": {"field_A": "hematoxylin/eosin", "field_B": "dab+hematoxylin", "combine": "max"},
    "he-sr": {"field_A": "eosin/hematoxylin", "field_B": "dab/hematoxylin", "combine": "max"},
}
RGB = ("r", "g", "b")


def luma(rgb=RGB) -> Column:
    """Integer grey level of 8-bit channels (the "L" conversion)."""
    r, g, b = map(F.col, rgb)
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def gray(rgb=RGB) -> Column:
    """Grey field on 0..1, not rounded."""
    r, g, b = map(F.col, rgb)
    return (0.299 * r + 0.587 * g + 0.114 * b) / 255.0


def od_estimation(channel: Column) -> Column:
    """Optical density for stain estimation: never negative, channel 0 counts as 1."""
    return F.greatest(F.lit(0.0), -F.log10(F.greatest(channel.cast("double"), F.lit(1.0)) / 255.0))


def od_field(channel: Column) -> Column:
    """Optical density for fields: the channel on 0.001..1."""
    return -F.log10(F.least(F.lit(1.0), F.greatest(F.lit(0.001), channel.cast("double") / 255.0)))


def unit(v: tuple[float, float, float]) -> tuple[float, ...]:
    n = math.sqrt(sum(x * x for x in v))
    return tuple(x / n for x in v)


def unit_column(v: Column) -> Column:
    """An array scaled to length 1; null for the zero vector."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.nullif(norm, F.lit(0.0)))


def angle(a: Column, b: Column) -> Column:
    """Degrees between two unit arrays, the cosine clipped to -1..1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))


def project(stain: tuple, rgb=RGB) -> Column:
    """Projection of the field density on one stain; it doesn't separate stains."""
    return sum((od_field(F.col(c)) * x for c, x in zip(rgb, unit(stain), strict=True)), F.lit(0.0))


def concentration(first: tuple, second: tuple, rgb=RGB) -> Column:
    """Concentration of the first stain with the second solved for and removed; null for parallel stains."""
    a, b = unit(first), unit(second)
    c = sum(x * y for x, y in zip(a, b, strict=True))
    return (project(first, rgb) - c * project(second, rgb)) / F.nullif(F.lit(1 - c * c), F.lit(0.0))


def split_specs(spec: str) -> tuple[str, str]:
    """The two single channels of a two-stain spec."""
    for sign in "+/":
        if sign in spec:
            a, b = spec.split(sign, 1)
            return f"{a}/{b}", f"{b}/{a}"
    raise ValueError(f"not a two-stain spec: {spec!r}")


def field(spec: str, combine: str = "max", vectors: dict | None = None, rgb=RGB) -> Column:
    """The field a spec names: gray, a, a/b or a+b; `vectors` extend and override STAINS."""
    table = STAINS | (vectors or {})
    if spec == "gray":
        return gray(rgb)
    names = spec.replace("+", "/").split("/")
    if missing := [n for n in names if n not in table]:
        raise ValueError(f"unknown stain {missing[0]!r}")
    if len(names) == 1:
        return project(table[names[0]], rgb)
    one = concentration(table[names[0]], table[names[1]], rgb)
    if "/" in spec:
        return one
    two = concentration(table[names[1]], table[names[0]], rgb)
    return {"max": F.greatest(one, two), "sum": one + two, "mean": (one + two) / 2}[combine]


def field_array(spec: str, rgb: np.ndarray, combine: str = "max", vectors: dict | None = None) -> np.ndarray:
    """field() of an array whose last axis is r, g, b on 0..255, whole numbers or averages. Pixels of one grey level, or of one colour, get the same number to the last bit."""
    table = STAINS | (vectors or {})
    # not by a matrix product, whose sums depend on a pixel's place; grey levels that are equal differ by less than the rounding, others by more
    along = lambda x, v: x[..., 0] * v[0] + x[..., 1] * v[1] + x[..., 2] * v[2]
    if spec == "gray":
        return np.round(along(rgb, (299.0, 587.0, 114.0)), 8) / 255_000.0
    names = spec.replace("+", "/").split("/")
    if missing := [n for n in names if n not in table]:
        raise ValueError(f"unknown stain {missing[0]!r}")
    od = -np.log10(np.clip(rgb / 255.0, 0.001, 1.0))
    v = [np.array(unit(table[n])) for n in names]
    if len(v) == 1:
        return along(od, v[0])
    c = float(v[0] @ v[1])
    one, two = ((along(od, a) - c * along(od, b)) / (1 - c * c) for a, b in (v, v[::-1]))
    return one if "/" in spec else {"max": np.maximum(one, two), "sum": one + two, "mean": (one + two) / 2}[combine]


def preset(name: str, **override) -> dict:
    """A preset with the given parts in place of its own."""
    return PRESETS[name] | {k: v for k, v in override.items() if v is not None}


def rendered(conc: Column) -> Column:
    """A concentration as an 8-bit level."""
    return F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.rint(255.0 * F.pow(F.lit(10.0), -F.greatest(conc, F.lit(0.0)))))).cast("int")


def auroc_se(a: Column, n1: Column, n2: Column) -> Column:
    """Hanley-McNeil standard error, at least 0; NaN if a side has fewer than two."""
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    var = (a * (1 - a) + (n1 - 1) * (q1 - a * a) + (n2 - 1) * (q2 - a * a)) / F.nullif(n1 * n2, F.lit(0))
    return F.when((n1 < 2) | (n2 < 2), F.lit(float("nan"))).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))


def null_se(n: Column) -> Column:
    """The standard error where the AUROC is 0.5."""
    return F.sqrt((0.25 + (n - 1) / 6.0) / (n * n))
