"""Writers: keyed tables partitioned by feed, and text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def replace_by_feed(df: DataFrame, path: str, feed: str = "feed_id") -> None:
    """Writes the feeds of `df` in place of what the table has of them; other feeds stay. Feeds are partitions, so
    none of the others is read or written."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(feed).parquet(path)


def upsert(df: DataFrame, path: str, keys: list[str], feed: str = "feed_id", keep_old: bool = False) -> None:
    """Puts the rows of `df` into the table by key: new rows replace old ones, or with `keep_old` only unknown keys
    are added. Within `df` the last row of a key (by its order of columns) counts. Only the feeds that `df` holds are
    read and rewritten; they are staged in a table of their own first, as a table can't be overwritten while read.
    """
    from geoloom.util import materialise

    spark = df.sparkSession
    order = [F.desc(c) for c in df.columns if c not in keys]
    new = df.withColumn("_age", F.lit(1 if keep_old else 0))
    if _exists(spark, path):
        old = spark.read.schema(df.schema).parquet(path).join(df.select(feed).distinct(), feed, "left_semi").select(*df.columns)
        new = new.unionByName(old.withColumn("_age", F.lit(0 if keep_old else 1)))
    one = F.row_number().over(W.partitionBy(*keys).orderBy("_age", *order))
    replace_by_feed(materialise(new.withColumn("_k", one).where("_k = 1").drop("_k", "_age")), path, feed)


def write_transfers(df: DataFrame, path: str) -> None:
    """transfers.txt parts with a header: from, to, type 2 and seconds."""
    rows = df.select("from_stop_id", "to_stop_id", F.lit(2).alias("transfer_type"), F.col("min_transfer_time").cast("int").alias("min_transfer_time"))
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
