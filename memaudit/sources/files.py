"""Result logs, label files and vectors in; results, tables and reports out."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESULTS = """fact_id string, prompt_id string, prompt string, ground_truth string, model_output string, state string,
object_aliases array<string>, subject string, subject_aliases array<string>, relation string, relation_aliases array<string>,
manifest_id string, row_index long"""


class TornLog(RuntimeError):
    """A log has a broken line that isn't its last."""


def scan_results(spark: SparkSession, path: str, schema: str = RESULTS, state: str | None = None) -> DataFrame:
    """Result rows of JSON lines; one state only, if given (pruned where the table is partitioned by state)."""
    rows = spark.read.schema(schema).json(path)
    return rows if state is None else rows.where(F.col("state") == state)


def scan_partial(spark: SparkSession, path: str, schema: str = RESULTS) -> DataFrame:
    """Rows of append logs. A broken last line of a file is an interrupted write and is left out; any other is an error.

    Lines are parsed where they are read. Only broken lines meet the place of their file's last line.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"))
    lines = lines.where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", schema + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r._corrupt_record").isNotNull()
    last = lines.groupBy("file").agg(F.max("at").alias("last"))
    torn = parsed.where(bad).join(last, "file").where(F.when(F.col("at") < F.col("last"), F.raise_error(F.concat(F.lit("broken line in "), "file")).cast("boolean")).otherwise(F.lit(False)))
    return parsed.where(~bad).select("r.*").unionByName(torn.select("r.*")).drop("_corrupt_record")


def scan_partials(spark: SparkSession, pattern: str, keys: list[str], schema: str = RESULTS) -> DataFrame:
    """All logs that match a pattern, of equal keys the row of the first file by name."""
    files = sorted({r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").collect()})
    rows = [scan_partial(spark, f, schema).withColumn("__file", F.lit(i)) for i, f in enumerate(files)]
    if not rows:
        return spark.createDataFrame([], schema)
    every = union_by_name(*rows)
    return every.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__file", "row_index"))).where("__r = 1").drop("__r", "__file")


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def scan_closure_tar(spark: SparkSession, path: str) -> DataFrame:
    """(name, document) of the JSON members of .tar.gz files."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith(".json"):
                            yield pd.DataFrame({"name": [m.name], "document": [tar.extractfile(m).read().decode()]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "name string, document string")


def read_npz(path: str, state: str | None = "FULL", event: str = "event0") -> pd.DataFrame:
    """(sample_id, fact, vector) of a local .npz sidecar: keys fact/state/event, or flat fact keys. A one-off import."""
    import numpy as np

    rows = []
    with np.load(path) as z:
        for key in z.files:
            parts = key.rsplit("/", 2)
            if len(parts) == 3 and (parts[1], parts[2]) != (state, event):
                continue
            vector = z[key].astype(float).ravel()
            if np.linalg.norm(vector) > 0:
                rows.append((key, parts[0], (vector / np.linalg.norm(vector)).tolist()))
    return pd.DataFrame(rows, columns=["sample_id", "fact", "vector"])


#: Elements of all vectors that one .npz file may hold: it is made on the driver.
NPZ_ELEMENTS = 1 << 27


def write_npz(vectors: DataFrame, path: str) -> None:
    """A local .npz file of (fact, state, event, vector), keys fact/state/event: for exchange, so of bounded size."""
    import numpy as np

    n, width = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n * (width or 0) > NPZ_ELEMENTS:
        raise ValueError(f"{n} vectors are too many for one file; take write_vectors")
    np.savez_compressed(path, **{f"{r.fact}/{r.state}/{r.event}": np.array(r.vector, np.float32) for r in vectors.collect()})


def write_vectors(vectors: DataFrame, path: str) -> None:
    """(fact, state, event, vector) as Parquet, by state."""
    vectors.write.mode("overwrite").partitionBy("state").parquet(path)


def discover_sidecar(spark: SparkSession, directory: str, stem: str) -> str | None:
    """The query vectors that lie beside a stem's results: of the run itself, else of its FULL pass; None without any."""
    for name in (f"{stem}_query_embeddings", f"{stem}_full/full_query_embeddings"):
        for path in (f"{directory}/{name}", f"{directory}/{name}.npz"):
            if exists(spark, path):
                return path
    return None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sha256_file(spark: SparkSession, path: str) -> str:
    """Digest of a file's bytes, read in pieces through Spark's file systems."""
    import hashlib

    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    digest = hashlib.sha256()
    try:
        while piece := bytes(stream.readNBytes(1 << 20)):
            digest.update(piece)
    finally:
        stream.close()
    return digest.hexdigest()


def write_results(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Result rows as Parquet, partitioned by state, so that readers of one state prune the others."""
    df.write.mode(mode).partitionBy("state").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append by Spark's committer: a batch appears whole or not at all."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, parts: bool = False) -> None:
    """One CSV file with a header, for summaries; with parts as many files as df has partitions, each with its header, in
    the order of df: for tables with a row per fact. Nested columns as JSON."""
    flat = df.select(*[F.to_json(c).alias(c) if k.startswith(("array", "struct", "map")) else F.col(c) for c, k in df.dtypes])
    (flat if parts else flat.coalesce(1)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: Bytes of text that a file of in_parts() holds, about.
PART_BYTES = 32 << 20


def in_parts(df: DataFrame, text: str, size: int = PART_BYTES) -> DataFrame:
    """df dealt over so many partitions that each has about `size` bytes of its column text, counted first."""
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(1, -(-total // size)))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Rows of frames with unlike columns under the union of these."""
    out = frames[0].select("*")  # a typed frame, such as a range, would keep its type
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def write_union_csv(spark: SparkSession, path: str, *frames: DataFrame) -> None:
    """CSV of all frames' rows under the union of their columns; no frames, or none with a row, give an empty file."""
    if not frames or not (rows := union_by_name(*frames)).take(1):
        write_text(spark, path, "")
    else:
        write_csv(rows, path)


def write_rows(spark: SparkSession, rows: list[dict], path: str) -> None:
    """CSV of a few summary rows with unlike keys, under the union of these in the order in which they first come."""
    import csv

    names = list(dict.fromkeys(k for r in rows for k in r))
    out = io.StringIO()
    writer = csv.DictWriter(out, names, lineterminator="\n", restval="")
    if rows:
        writer.writeheader()
        writer.writerows(rows)
    write_text(spark, path, out.getvalue().removesuffix("\n"))


class TooManyRows(RuntimeError):
    """A summary has more rows than a report may show."""


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A summary as a Markdown table; one of more than `limit` rows is an error, never cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooManyRows(f"more than {limit} rows are no summary")
    return markdown(df.columns, rows)


def markdown(names: list[str], rows: list) -> str:
    text = lambda v: "n/a" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    head = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*head, *("| " + " | ".join(map(text, r)) + " |" for r in rows)]) + "\n"


def write_neighbors(neighbors: DataFrame, config: dict, path: str) -> None:
    """Adjacency as Parquet, the configuration beside it as one document."""
    neighbors.write.mode("overwrite").parquet(f"{path}/neighbors")
    write_document(neighbors.sparkSession, f"{path}/config", config)


def write_entanglement(curve: DataFrame, gaps: DataFrame, path: str) -> None:
    """Curves, one row a target and radius, and gaps, as CSV."""
    columns = ("rho", "efficacy", "collateral", "neighbor_count", "neighbors_observed", "neighbors_full_correct", "gap_term")
    write_csv(curve.select(F.col("target").alias("target_key"), *columns).orderBy("target_key", F.desc("rho")), f"{path}/entanglement_curves", True)
    write_csv(gaps.select(F.col("target").alias("target_key"), "gap", "gap_rho", "gap_eligible").orderBy("target_key"), f"{path}/entanglement_gaps", True)


def write_adversarial(evasion: DataFrame, margins: DataFrame, path: str) -> None:
    write_csv(evasion.orderBy("epsilon", "template"), f"{path}/evasion")
    write_csv(margins.orderBy("fact"), f"{path}/margins", True)


def closure_documents(closure: DataFrame, manifests: DataFrame, geometry: DataFrame, config) -> DataFrame:
    """(name, document): each closure as one JSON text, named for its fact's safe file name."""
    from memaudit.functions.text import safe_filename

    entry = F.struct("entry_id", "score", "source_id", "value", "caught_by")
    rows = closure.groupBy("fact", "rho").agg(F.sort_array(F.collect_list(entry)).alias("entries")).join(manifests, ["fact", "rho"]).join(geometry, ["fact", "rho"], "left")
    told = F.struct(
        F.col("fact").cast("string").alias("example_key"), "manifest_id", "strategy", F.array(*map(F.lit, config.active)).alias("predicates_active"), F.col("rho").alias("radius"), F.lit(config.envelope_top_k).alias("envelope_top_k"),
        F.lit(config.max_closure_size).alias("max_closure_size"), (F.get_json_object("metadata", "$.truncated") == "true").alias("truncated"), F.lit(None).cast("int").alias("index_nprobe"), F.get_json_object("metadata", "$.audited_event_index").cast("int").alias("audited_event_index"),
        "s_del", "s_surv", "margin", F.col("survivors").alias("top_survivors"), "source_ids", "entries",
    )
    return rows.select(safe_filename(F.col("fact")).alias("name"), F.to_json(told, {"ignoreNullFields": "false"}).alias("document"))


class CanaryMismatch(RuntimeError):
    """Rows that were served from a store come out otherwise when they are made anew."""


def canary_report(mismatches: DataFrame, path: str) -> None:
    """Both sides of every mismatch written to path, and then an error; nothing if there is none."""
    if not mismatches.isEmpty():
        mismatches.write.mode("overwrite").option("ignoreNullFields", False).json(path)
        raise CanaryMismatch(f"reused rows differ from fresh ones; see {path}")


class AuditLogger:
    """Lines on standard output and, where a path is given, at the end of a local file."""

    def __init__(self, path: str | None = None):
        self.path = path

    def __call__(self, *words: object) -> None:
        line = " ".join(map(str, words))
        print(line, flush=True)
        if self.path:
            with open(self.path, "a", encoding="utf-8") as f:
                f.write(line + "\n")


def write_text(spark: SparkSession, path: str, value: str) -> None:
    """One text through Spark's committer."""
    spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_document(spark: SparkSession, path: str, document: dict) -> None:
    write_text(spark, path, json.dumps(document, sort_keys=True, ensure_ascii=False, default=str))
