"""Helpers shared by the corpus operators: scratch tables, Arrow output and readers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows leave a Python worker in batches of about this many bytes.
BATCH_BYTES = 8 << 20
#: Hot keys are broadcast up to so many; it takes 10^10 rows or more to have them.
BROADCAST_KEYS = 400_000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. A session without one gets a temporary folder if it is local;
    on a cluster, where executors wouldn't see that, it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="memaudit-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/memaudit-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete stored tables that no later plan reads: what came of them must have been stored too."""
    for df in frames:
        _delete(df.sparkSession, df._scratch)


def clean_scratch(spark: SparkSession) -> None:
    """Delete all that this application stored; results that weren't written or collected by then are lost."""
    _delete(spark, scratch_dir(spark))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """docs less the rows whose id and text hash are a row of gone (its two columns, in this order). gone is broadcast
    if it has at most that many rows; whatever docs' columns are called, none clashes."""
    key, th = free_name(docs, "gone_id"), free_name(docs, "gone_th")
    gone = gone.toDF(key, th)
    same = F.col(id_col).eqNullSafe(F.col(key)) & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(th))
    return docs.join(F.broadcast(gone) if gone.count() <= rows else gone, same, "left_anti")


def joined_hot(left: DataFrame, right: DataFrame, on: str | list[str], rows: str, heavy: int = 10_000) -> DataFrame:
    """Left join on a key that is unique in right, without nulls. A key that has more than `heavy` rows of left (right's column `rows`
    says how many) is broadcast, so it isn't dealt to one task; there are at most count(left) / heavy of them. The
    others are joined by a shuffle, with at most `heavy` rows a key."""
    hot = right.where(F.col(rows) > heavy)
    n = hot.count()
    if not n:
        return left.join(right, on, "left")
    hot = F.broadcast(hot) if n <= BROADCAST_KEYS else hot
    cold = left.join(hot.select(on), on, "left_anti").join(right.where(F.col(rows) <= heavy), on, "left")
    return cold.unionByName(left.join(hot, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends rows to Python in batches of at most BATCH_BYTES: 10,000 long texts, or Spark's
    64 MB a batch and worker, are more than a small executor has room for. A lower setting stays."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def batches(rows: Iterable[Sequence], schema: pa.Schema, weigh=None, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row tuples to record batches of bounded size; weigh(row) gives a row's bytes (64 if not given)."""
    columns: list[list] = [[] for _ in schema]
    held = 0
    for row in rows:
        for column, value in zip(columns, row):
            column.append(value)
        held += weigh(row) if weigh else 64
        if held >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
            columns, held = [[] for _ in schema], 0
    if columns[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
