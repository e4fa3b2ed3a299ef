"""Rolling totals over trailing periods, days without activity included.

Counters are reduced to one row per entity and day before anything else, so an entity with a third of all rows
shrinks to its number of days. Blocks of entities by days are then packed into dense numpy matrices, one per bucket
of entities and tile of days; a tile also holds the days before it that its first windows reach (the halo), and one
multiplication with a banded 0/1 matrix gives all windows of a width.
"""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.util import materialise

ENTITIES_PER_BLOCK = 1024
DAYS_PER_TILE = 64


def latest_versions(df: DataFrame, keys: list[str], version: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the greatest `version`.

    Null versions are the oldest; among rows of one version the greatest values (compared in order) win, so repeated
    rows count once and the result does not depend on the input's order. Null values become 0 and null keys stay keys.
    """
    newest = F.max(F.struct(F.col(version).alias("_v"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in values]))
    picked = df.groupBy(*keys).agg(newest.alias("_n"))
    return picked.select(*keys, *[F.col(f"_n.{c}").alias(c) for c in values])


def rolling_totals(
    daily: DataFrame,
    entity: str,
    day: str,
    values: list[str],
    *,
    first: dt.date,
    last: dt.date,
    widths: tuple[int, ...] = (7, 30),
    averages: bool = True,
) -> DataFrame:
    """For every entity and every day from `first` to `last`: `{value}_{width}` and `avg_{value}_{width}` over the
    trailing `width` days, that day included.

    `daily` may have any number of rows per entity and day; they are added up. Entities without rows in the period
    come out with zeros. Rows whose entity or day is null belong to no entity's period and are left out; null values
    count as 0. An empty table gives an empty result.
    """
    reach = max(widths) - 1
    n_days = (last - first).days + 1
    tiles = math.ceil(n_days / DAYS_PER_TILE)
    sums = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(
        F.col(entity).alias("_e"), F.datediff(F.col(day), F.lit(first)).alias("_d")
    ).agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in values])
    sums = materialise(sums)  # read three times below
    entities = sums.agg(F.approx_count_distinct("_e", 0.02)).first()[0]
    buckets = max(1, math.ceil(entities / ENTITIES_PER_BLOCK))
    # A day belongs to its own tile and, within reach of a later tile's start, also to that one; every entity is in
    # every tile once more without a day, so that idle entities come out too.
    in_range = F.col("_d").between(-reach, n_days - 1)
    size = F.lit(DAYS_PER_TILE)
    low = F.greatest(F.lit(0), F.floor(F.col("_d") / size)).cast("int")
    high = F.least(F.lit(tiles - 1), F.floor((F.col("_d") + reach) / size)).cast("int")
    used = sums.where(in_range).select("*", F.explode(F.sequence(low, high)).alias("_t"))
    idle = sums.select("_e").distinct().select(
        "_e", F.lit(None).cast("int").alias("_d"), *[F.lit(0).cast("long").alias(c) for c in values],
        F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("_t"),
    )
    placed = used.unionByName(idle).withColumn("_b", F.pmod(F.xxhash64("_e"), F.lit(buckets)).cast("int"))

    kind = daily.schema[entity].dataType
    fields = [T.StructField(entity, kind), T.StructField(day, T.DateType())]
    fields += [T.StructField(f"{v}_{w}", T.LongType()) for v in values for w in widths]
    if averages:
        fields += [T.StructField(f"avg_{v}_{w}", T.DoubleType()) for v in values for w in widths]

    def block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tile = int(key[1])
        start, stop = tile * DAYS_PER_TILE, min(n_days, (tile + 1) * DAYS_PER_TILE)
        codes, names = pd.factorize(rows["_e"])
        has = rows["_d"].notna().to_numpy()
        column = rows["_d"].to_numpy(np.float64)[has].astype(np.int64) - (start - reach)
        width = stop - start
        out = {entity: np.repeat(np.asarray(names, dtype=object), width), day: np.tile(pd.date_range(first + dt.timedelta(days=start), periods=width).date, len(names))}
        age = np.arange(width)[None, :] + reach - np.arange(width + reach)[:, None]
        for v in values:
            dense = np.zeros((len(names), width + reach))
            dense[codes[has], column] = rows[v].to_numpy(np.float64)[has]
            for w in widths:
                total = dense @ ((age >= 0) & (age < w)).astype(np.float64)
                out[f"{v}_{w}"] = np.rint(total).astype(np.int64).ravel()
        if averages:
            out |= {f"avg_{v}_{w}": out[f"{v}_{w}"] / w for v in values for w in widths}
        return pd.DataFrame(out)

    return placed.groupBy("_b", "_t").applyInPandas(block, T.StructType(fields))
