"""Shapes: circles, tile boxes, simplified lines."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions.geo import DEG_M, EARTH_M, in_box

LINE = T.ArrayType(T.ArrayType(T.DoubleType()))


def circle(lat: Column | str, lon: Column | str, metres: Column | float, sides: int = 32) -> Column:
    """A closed ring of struct(lon, lat) around a point, by bearing on the mean sphere."""
    y, x = (F.radians(F.col(c) if isinstance(c, str) else c) for c in (lat, lon))
    d = (metres if isinstance(metres, Column) else F.lit(float(metres))) / EARTH_M

    def corner(k: Column) -> Column:
        b = k * (2 * math.pi / sides)
        a = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.cos(b))
        o = x + F.atan2(F.sin(b) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(a))
        return F.struct(F.degrees(o).alias("lon"), F.degrees(a).alias("lat"))

    ring = F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), corner)
    return F.concat(ring, F.slice(ring, 1, 1))


def tile_box(zoom: int, x: int, y: int) -> tuple[float, float, float, float]:
    """south, west, north, east of a web map tile."""
    n = 1 << zoom
    if not (0 <= x < n and 0 <= y < n):
        raise ValueError(f"no tile {x}, {y} at zoom {zoom}")
    lat = lambda k: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n))))
    return lat(y + 1), x / n * 360 - 180, lat(y), (x + 1) / n * 360 - 180


def in_tile(lat: Column | str, lon: Column | str, zoom: int, x: int, y: int) -> Column:
    """Range comparisons that reach the scan."""
    return in_box(lat, lon, *tile_box(zoom, x, y))


def simplify_line(line: list | np.ndarray, metres: float) -> list[list[float]]:
    """The vertices of [[lon, lat], ...] that are needed to stay within `metres` of all of them; rings keep at least
    four. Works on stretches, farthest vertex first, without recursion."""
    p = np.array([list(v) for v in line], float)
    if len(p) < 3:
        return p.tolist()
    xy = p * [math.cos(math.radians(float(np.clip(p[:, 1].mean(), -89, 89)))), 1.0]
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    closed = bool((p[0] == p[-1]).all())
    if closed:
        far = int(((xy - xy[0]) ** 2).sum(1).argmax())
        keep[far] = True
        todo = [(0, far), (far, len(p) - 1)]
    else:
        todo = [(0, len(p) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = xy[b] - xy[a]
        rel = xy[a + 1 : b] - xy[a]
        t = np.clip(rel @ d / max(d @ d, 1e-300), 0, 1)
        off = np.sqrt(((rel - t[:, None] * d) ** 2).sum(1)) * DEG_M
        k = int(off.argmax())
        if off[k] > metres:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    if closed and keep.sum() < 4:
        keep[np.linspace(0, len(p) - 1, min(4, len(p))).astype(int)] = True
    return p[keep].tolist()


def simplified(line: Column | str, metres: float) -> Column:
    """`simplify_line` of an array<array<double>> column, in Arrow batches; null for null."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda v: None if v is None else simplify_line(v, metres))

    return run(line)
