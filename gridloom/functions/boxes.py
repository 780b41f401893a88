"""Geometry of boxes: (x, y, w, h) for words, corner form (x1, y1, x2, y2) for cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axis_box(poly: Column) -> Column:
    """The (x, y, w, h) struct around a polygon given as an array of [x, y] arrays."""
    xs, ys = F.transform(poly, lambda p: p[0]), F.transform(poly, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def column_index(cx: Column, separators: Column) -> Column:
    """Column that a centre falls in: the separators left of it. A null list has none."""
    return F.size(F.filter(F.coalesce(separators, F.array().cast("array<double>")), lambda s: cx > s))


def beside_separator(cx: Column, separators: Column, margin: Column) -> Column:
    """[k, k + 1] for the first separator k within margin of a centre, else null."""
    near = F.filter(F.transform(separators, lambda s, k: F.struct(k.alias("k"), s.alias("s"))), lambda e: F.abs(cx - e["s"]) <= margin)
    return F.when(F.size(near) > 0, F.array(near[0]["k"], near[0]["k"] + 1))


def intervals_overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return ~((a_high < b_low) | (b_high < a_low))


def box_from_text(text: Column) -> Column:
    """Corner box of 'x1,y1,x2,y2' (or with ';'): rounded half to even, corners sorted; null if it isn't four finite numbers."""
    parts = F.transform(F.split(F.replace(text, F.lit(";"), F.lit(",")), ","), lambda p: F.when(F.trim(p).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.trim(p).try_cast("double")))
    n = F.transform(parts, lambda v: F.bround(v).cast("int"))
    good = (F.size(parts) == 4) & ~F.exists(parts, lambda v: v.isNull())
    return F.when(good, F.struct(F.least(n[0], n[2]).alias("x1"), F.least(n[1], n[3]).alias("y1"), F.greatest(n[0], n[2]).alias("x2"), F.greatest(n[1], n[3]).alias("y2")))
