"""Boxes and mark measures, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds of the two mark classifiers.
FILL_CHECKED, FILL_EMPTY, HALO_INK = 0.08, 0.025, 0.05
INTERIOR_CHECKED, INTERIOR_EMPTY, STRIKE_CHECKED, STRIKE_AMBIGUOUS = 0.18, 0.045, 0.45, 0.30


def box(points: Column) -> Column:
    """``[x1, y1, x2, y2]`` of four numbers or of a polygon of eight or more; else empty."""
    xs = F.filter(points, lambda v, i: i % 2 == 0)
    ys = F.filter(points, lambda v, i: i % 2 == 1)
    n = F.size(points)
    return F.when((n == 4) | (n >= 8), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))).otherwise(F.array().cast("array<double>"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a: Column, b: Column) -> Column:
    """The area that two boxes share."""
    return (F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1])))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without any area."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, F.nullif(area(a) + area(b) - both, F.lit(0.0))), F.lit(0.0))


def covered(inner: Column, outer: Column) -> Column:
    """The share of ``inner`` that ``outer`` covers."""
    return F.coalesce(F.try_divide(intersection(inner, outer), F.nullif(area(inner), F.lit(0.0))), F.lit(0.0))


def pixels(b: Column, width: Column, height: Column) -> Column:
    """Page fractions as pixels, rounded half to even, within the page."""
    at = lambda i, side: F.greatest(F.lit(0), F.least(side, F.bround(b[i] * side, 0).cast("int")))
    return F.array(at(0, width), at(1, height), at(2, width), at(3, height))


def tidy(x: Column) -> Column:
    """Two decimals; whole numbers stay whole."""
    return F.when(x == F.floor(x), x).otherwise(F.bround(x, 2))


def scaled(b: Column, factor: Column) -> Column:
    """I56."""
    return F.transform(b, lambda v: v * factor)


def _between(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def residual_state(fill: Column, halo: Column) -> Column:
    """(state, score) from the new ink inside a control and around it."""
    halo = F.coalesce(halo, F.lit(0.0))
    span = FILL_CHECKED - FILL_EMPTY
    state = (F.when(fill.isNull(), "uncertain").when(fill >= FILL_CHECKED, "checked").when((fill <= FILL_EMPTY) & (halo >= HALO_INK), "uncertain")
             .when(fill <= FILL_EMPTY, "unchecked").otherwise("uncertain"))
    score = (F.when(fill.isNull(), 0.0).when(fill >= FILL_CHECKED, F.least(F.lit(1.0), 0.6 + (fill - FILL_CHECKED) * 4.0))
             .when((fill <= FILL_EMPTY) & (halo >= HALO_INK), 0.2).when(fill <= FILL_EMPTY, F.least(F.lit(1.0), 0.6 + (FILL_EMPTY - fill) * 20.0))
             .otherwise(F.greatest(F.lit(0.0), 0.5 - F.least(FILL_CHECKED - fill, fill - FILL_EMPTY) / span)))
    return F.struct(state.alias("state"), F.bround(score, 3).alias("score"))


def geometric_state(fill: Column, strike: Column) -> Column:
    """(state, score) from the interior ink and the longest stroke."""
    span = INTERIOR_CHECKED - INTERIOR_EMPTY
    empty = (fill <= INTERIOR_EMPTY) & (strike < STRIKE_AMBIGUOUS)
    near = F.least(INTERIOR_CHECKED - fill, F.greatest(F.lit(0.0), fill - INTERIOR_EMPTY)) / span
    state = F.when(fill.isNull(), "uncertain").when((fill >= INTERIOR_CHECKED) | (strike >= STRIKE_CHECKED), "checked").when(empty, "unchecked").otherwise("uncertain")
    score = (F.when(fill.isNull(), 0.0).when(fill >= INTERIOR_CHECKED, _between(0.6 + (fill - INTERIOR_CHECKED) * 2.0))
             .when(strike >= STRIKE_CHECKED, _between(0.55 + (strike - STRIKE_CHECKED) * 0.8))
             .when(empty, _between(0.6 + (INTERIOR_EMPTY - fill) * 8.0)).otherwise(_between(0.5 - near, 0.0, 0.5)))
    return F.struct(state.alias("state"), F.bround(score, 3).alias("score"))


def verdict(read: Column, measured: Column) -> Column:
    """The text's state stands; a sure measure that contradicts it is noted."""
    against = read.isNotNull() & ~measured["state"].isin("uncertain") & (measured["state"] != read["state"]) & (F.coalesce(measured["score"], F.lit(0.0)) >= 0.55)
    against = F.coalesce(against, F.lit(False))
    return F.struct(F.coalesce(read["state"], F.lit("uncertain")).alias("state"), F.coalesce(read["score"], F.lit(0.0)).alias("score"),
                    F.when(against, "geometry_disagreement").when(read.isNotNull(), "observed").otherwise("needs_review").alias("status"))


def is_figure(b: Column, width: Column, height: Column) -> Column:
    """At least 6 points on the page and 8 pixels in the raster, both ways; an unknown raster passes."""
    large = F.least(b[2] - b[0], b[3] - b[1]) >= 6.0
    known = (width > 0) & (height > 0)
    return large & (~F.coalesce(known, F.lit(False)) | (F.least(width, height) >= 8))


def badge(quality: Column) -> Column:
    """A quality within 0 and 1 as a grade."""
    q = _between(quality)
    return F.when(q >= 0.80, "high").when(q >= 0.60, "medium").otherwise("low")


def node_size(kind: str, n: Column) -> Column:
    """Sizes of graph nodes by how many link to them (a topic of one paper: by its confidence)."""
    # Base and step of each kind of node.
    base, step = {"author": (10, 5), "category": (20, 4), "topic": (10, 2), "cited_author": (8, 2), "ego_topic": (10, 15)}.get(kind, (10, 0))
    return F.lit(15) + F.least(n * 3, F.lit(30)) if kind == "paper" else F.lit(base) + n * step


def is_flat(deviation: Column) -> Column:
    """C14: an image whose luminance hardly varies; one that couldn't be measured isn't."""
    return F.coalesce(deviation <= 3.0, F.lit(False))
