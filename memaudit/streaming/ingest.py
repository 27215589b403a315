"""Results that arrive as files: exactly-once ingest, first writer wins, and rates kept up to date per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def result_stream(spark: SparkSession, path: str, schema: str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def first_rows(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each key's first row. With a time column the state is bounded by a watermark."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed_rates(stream: DataFrame, time: str, flag: str, width: str = "1 hour", late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows and share of a boolean per tumbling window; rows later than the watermark are left out."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg(F.col(flag).cast("double")).alias("rate")).select(F.col("window.start").alias("start"), *by, "n", "rate")


def append_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append to a Parquet table; with the checkpoint a restart neither loses nor repeats a row."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def rates_table(rates: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """The rates of all files there are: every batch writes the windows it changed, and a window's last batch counts.

    A batch that is repeated after a failure writes the same rows under the same number again, which changes nothing.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = rates.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    every = rates.sparkSession.read.schema(rates.schema.add("batch", "long")).parquet(path)
    value = [c for c in rates.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in value])
