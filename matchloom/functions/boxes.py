"""Boxes (x, y, w, h) and point lists as column expressions."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns; ``Box.of("a_")`` names them a_x, a_y, a_w, a_h."""

    def __init__(self, x: Column, y: Column, w: Column, h: Column):
        self.x, self.y, self.w, self.h = x, y, w, h

    @classmethod
    def of(cls, prefix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}") for c in "xywh"))

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))

    @classmethod
    def corners(cls, left: Column, top: Column, right: Column, bottom: Column) -> Box:
        return cls(left, top, right - left, bottom - top)


def clip(b: Box, width: int, height: int) -> Box:
    """The part of a box inside a frame."""
    edge = lambda v, most: F.least(F.greatest(v, F.lit(0)), F.lit(most))
    return Box.corners(edge(b.x, width), edge(b.y, height), edge(b.right, width), edge(b.bottom, height))


def pad(b: Box, by: int, width: int, height: int) -> Box:
    """A box grown by ``by`` on every side, inside a frame."""
    return clip(Box.corners(b.x - by, b.y - by, b.right + by, b.bottom + by), width, height)


def inflate(b: Box, by: int) -> Box:
    return Box.corners(b.x - by, b.y - by, b.right + by, b.bottom + by)


def intersection(a: Box, b: Box) -> Column:
    """Area that two boxes share; null if either is."""
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x)) * F.greatest(zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 where a box is null or the union has no area."""
    both = intersection(a, b)
    union = a.area + b.area - both
    known = a.x.isNotNull() & b.x.isNotNull()
    return F.when(known & (union > 0), both.cast("double") / union).otherwise(0.0)


def center_inside(a: Box, b: Box) -> Column:
    """Whether the centre of ``a`` lies in ``b``, edges included."""
    x, y = a.x + a.w / 2, a.y + a.h / 2
    return (x >= b.x) & (x <= b.right) & (y >= b.y) & (y <= b.bottom)


def overlap_padded(a: Box, b: Box, by: int) -> Column:
    """Whether two boxes meet when each is widened by ``by``."""
    return ~((a.right + by < b.x) | (b.right + by < a.x) | (a.bottom + by < b.y) | (b.bottom + by < a.y))


def scene_point(b: Box, width: float, height: float) -> tuple[Column, Column]:
    """A box's centre in a scene centred at 0 with y upwards, in units of half a frame."""
    return (b.x + b.w / 2) / (width / 2) - 1, 1 - (b.y + b.h / 2) / (height / 2)


def half_up(v: Column) -> Column:
    """floor(v + 0.5)"""
    return F.floor(v + 0.5)


def snap(v: Column, grid: float) -> Column:
    """The nearest multiple of ``grid``, halves upwards."""
    return half_up(v / grid) * grid


def quarter_turn(degrees: Column) -> Column:
    return F.pmod(half_up(degrees / 90) * 90, F.lit(360))


def ordered_quad(points: Column) -> Column:
    """Four ``struct<x, y>`` as top-left, top-right, bottom-right, bottom-left:
    least and largest x + y, least and largest y - x; the first of equals holds."""
    total, tilt = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]

    def pick(value, least: bool) -> Column:
        ranked = F.transform(points, lambda p, i: F.struct((value(p) if least else -value(p)).alias("v"), i.alias("i"), p.alias("p")))
        return F.array_min(ranked)["p"]

    return F.array(pick(total, True), pick(tilt, True), pick(total, False), pick(tilt, False))


def shoelace(points: Column) -> Column:
    """Area of a polygon."""
    following = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, following, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def edge(points: Column, i: int, j: int) -> Column:
    p, q = points[i], points[j]
    return F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))


def quad_features(points: Column) -> dict[str, Column]:
    """Centre, angle of the top edge, area and aspect (longer over shorter mean edge) of an ordered quad."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / 4
    across, down = (edge(points, 0, 1) + edge(points, 3, 2)) / 2, (edge(points, 0, 3) + edge(points, 1, 2)) / 2
    return {
        "cx": mean("x"),
        "cy": mean("y"),
        "angle": F.atan2(points[1]["y"] - points[0]["y"], points[1]["x"] - points[0]["x"]),
        "area": shoelace(points),
        "aspect": F.greatest(across, down) / F.greatest(F.lit(1e-9), F.least(across, down)),
    }


def quad_box(points: Column) -> dict[str, Column]:
    """The upright box of a quad in whole numbers, corners rounded half to even."""
    end = lambda f, axis: F.rint(f(F.transform(points, lambda p: p[axis]))).cast("long")
    x, y = end(F.array_min, "x"), end(F.array_min, "y")
    return {"x": x, "y": y, "w": F.greatest(F.lit(0).cast("long"), end(F.array_max, "x") - x), "h": F.greatest(F.lit(0).cast("long"), end(F.array_max, "y") - y)}


def layout_angle(points: Column, turned: Column) -> Column:
    """Angle of the top edge against the axis, upwards positive; half a turn more where ``turned``."""
    return -F.atan2(points[1]["y"] - points[0]["y"], points[1]["x"] - points[0]["x"]) + F.when(turned, F.lit(math.pi)).otherwise(0.0)


def expand_quad(points: Column, ratio: float, width: float, height: float) -> Column:
    """Points moved away from their centroid by ``ratio``, kept in the frame."""
    mean = lambda axis: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)
    cx, cy = mean("x"), mean("y")
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    return F.transform(points, lambda p: F.struct(inside(cx + (p["x"] - cx) * (1 + ratio), width).alias("x"), inside(cy + (p["y"] - cy) * (1 + ratio), height).alias("y")))


def valid_quad(points: Column, least_area: float = 100, least_edge: float = 2) -> Column:
    edges: Sequence[Column] = [edge(points, i, (i + 1) % 4) for i in range(4)]
    return (F.size(points) == 4) & (shoelace(points) >= least_area) & (F.least(*edges) >= least_edge)
