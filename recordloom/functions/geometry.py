"""Boxes (struct of x_min, y_min, x_max, y_max) and rings (array of struct of lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions.text import _c

METRES_PER_DEGREE = 111320.0


def box(x0, y0, x1, y1) -> Column:
    return F.struct(_c(x0).cast("double").alias("x_min"), _c(y0).cast("double").alias("y_min"), _c(x1).cast("double").alias("x_max"), _c(y1).cast("double").alias("y_max"))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x_max"] - b["x_min"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y_max"] - b["y_min"])


def area(b: Column) -> Column:
    """Never below 0."""
    return width(b) * height(b)


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x_max"], b["x_max"]) - F.greatest(a["x_min"], b["x_min"])
    h = F.least(a["y_max"], b["y_max"]) - F.greatest(a["y_min"], b["y_min"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    both = intersection(a, b)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def overlaps(a: Column, b: Column, threshold: float = 0.3) -> Column:
    return iou(a, b) >= threshold


def inside_share(inner: Column, outer: Column) -> Column:
    """Share of the inner box that lies in the outer one."""
    return F.coalesce(F.try_divide(intersection(inner, outer), area(inner)), F.lit(0.0))


def clamped(b: Column, w: Column, h: Column) -> Column:
    """Corners in order, within the image, at least one pixel wide and high."""
    x0, x1 = F.least(b["x_min"], b["x_max"]), F.greatest(b["x_min"], b["x_max"])
    y0, y1 = F.least(b["y_min"], b["y_max"]), F.greatest(b["y_min"], b["y_max"])
    left = F.greatest(F.lit(0.0), F.least(x0, w - 1))
    top = F.greatest(F.lit(0.0), F.least(y0, h - 1))
    return box(left, top, F.greatest(left + 1, F.least(x1, w)), F.greatest(top + 1, F.least(y1, h)))


def normalized(b: Column, w: Column, h: Column) -> Column:
    """0 to 1, four places."""
    part = lambda v, n: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(v, n))), 4)
    return box(part(b["x_min"], w), part(b["y_min"], h), part(b["x_max"], w), part(b["y_max"], h))


def polygon_box(points: Column) -> Column:
    """The box around an array of [x, y]."""
    x, y = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y))


def _edges(ring: Column) -> Column:
    """Neighbouring points as pairs, the last with the first."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), shifted.alias("b"))


def contains(ring: Column, lon: Column, lat: Column) -> Column:
    """Whether a point lies inside, by the crossings of a ray; points on an edge are not inside."""
    lon, lat = _c(lon), _c(lat)

    def crossing(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["lon"] + (lat - a["lat"]) * F.try_divide(b["lon"] - a["lon"], b["lat"] - a["lat"])
        return F.coalesce(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), F.lit(False))

    def on(e: Column) -> Column:
        a, b = e["a"], e["b"]
        cross = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (cross == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    edges = _edges(ring)
    return (F.size(F.filter(edges, crossing)) % 2 == 1) & ~F.exists(edges, on)


def centroid(ring: Column) -> Column:
    """struct(lon, lat) of a polygon's centre of area; of its points' mean if it has no area."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(t: Column, e: Column) -> Column:
        a, b = e["a"], e["b"]
        k = a["lon"] * b["lat"] - b["lon"] * a["lat"]
        return F.struct((t["s"] + k).alias("s"), (t["x"] + (a["lon"] + b["lon"]) * k).alias("x"), (t["y"] + (a["lat"] + b["lat"]) * k).alias("y"))

    mean = lambda f: F.aggregate(ring, F.lit(0.0), lambda t, p: t + p[f]) / F.size(ring)
    return F.aggregate(_edges(ring), zero, add, lambda t: F.struct(F.coalesce(F.try_divide(t["x"], 3 * t["s"]), mean("lon")).alias("lon"), F.coalesce(F.try_divide(t["y"], 3 * t["s"]), mean("lat")).alias("lat")))


def planar_metres(lon: Column, lat: Column, to_lon: Column, to_lat: Column) -> Column:
    """Distance on a plane at the first point's latitude, one place."""
    dy = (_c(lat) - _c(to_lat)) * METRES_PER_DEGREE
    dx = (_c(lon) - _c(to_lon)) * METRES_PER_DEGREE * F.cos(F.radians(_c(lat)))
    return F.bround(F.sqrt(dx * dx + dy * dy), 1)
