"""Encoded polylines: base-64 digits of zigzag differences, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decode_polyline(text: str | None, precision: int = 7) -> list[list[float]] | None:
    """[[lon, lat], ...] of an encoded line; null for null, what is whole of a line cut short."""
    if text is None:
        return None
    values, number, shift = [], 0, 0
    for ch in text:
        digit = ord(ch) - 63
        number |= (digit & 31) << shift
        shift += 5
        if digit < 32:
            values.append(~(number >> 1) if number & 1 else number >> 1)
            number = shift = 0
    line, lat, lon, unit = [], 0, 0, 10**precision
    for dy, dx in zip(values[::2], values[1::2]):
        lat, lon = lat + dy, lon + dx
        line.append([lon / unit, lat / unit])
    return line


def encode_polyline(line: list[list[float]], precision: int = 7) -> str:
    """The inverse of `decode_polyline`."""
    out, last = [], (0, 0)
    for lon, lat in line:
        now = (round(lat * 10**precision), round(lon * 10**precision))
        for a, b in zip(now, last):
            v = a - b
            v = ~(v << 1) if v < 0 else v << 1
            while v >= 32:
                out.append(chr((32 | (v & 31)) + 63))
                v >>= 5
            out.append(chr(v + 63))
        last = now
    return "".join(out)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def polyline_points(text: pd.Series) -> pd.Series:
    return text.map(decode_polyline)
