"""Running a stream over what is there and reading the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.util import scratch


def file_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; its schema is the table's."""
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream reads directories


def append_all(stream: DataFrame) -> DataFrame:
    """Runs an append-mode stream to the end of what is available into a Parquet table and reads that."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")
    q = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def upsert_all(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Runs an update-mode aggregation to the end; each batch's rows replace those of their keys. A batch is written
    under its own number, so a batch that is run again after a failure replaces itself."""
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
    rest = [c for c in stream.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")
