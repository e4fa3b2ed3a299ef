"""Small helpers every operator shares: table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SMALL_BYTES = 512 << 10

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from `spark.checkpoint.dir`.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster that would lose data
    with its machine, so there the setting is required.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="geoloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder in the shared folder, deleted when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cuts the lineage: writes `df` as a table in the shared folder and reads that back.

    Unlike a cached or locally checkpointed frame, the table survives the loss of any executor. Encoded files are many
    times smaller than their rows in memory, so a table of more than `SMALL_BYTES` is never broadcast on their word.
    """
    spark = df.sparkSession
    path = scratch(spark, "geoloom")
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out if _bytes(spark, path) <= SMALL_BYTES else out.hint("merge")


def _bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def spread(df: DataFrame) -> DataFrame:
    """`df` on at least as many partitions as there are cores. Only an input of few, large row groups is moved; at
    scale a scan has more partitions than cores and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def forget(df: DataFrame) -> None:
    """Deletes the table behind a frame that `materialise` returned and no later result needs."""
    names = {name.rsplit("/", 2)[-2] for name in df.inputFiles()}
    for entry in [x for x in _WRITTEN if x[1].rsplit("/", 1)[-1] in names]:
        _delete(*entry)
        _WRITTEN.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone when the process ends
        pass


@atexit.register
def _clean() -> None:
    for entry in _WRITTEN:
        if getattr(entry[0].sparkContext, "_jsc", None) is not None:
            _delete(*entry)
    _WRITTEN.clear()
