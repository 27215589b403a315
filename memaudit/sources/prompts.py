"""Prompt rows: explicit schemas, parsing with precedence, and the five public fact sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memaudit.functions import text as T
from memaudit.operators.joins import small
from memaudit.operators.scratch import stored

PROMPTS = """prompt_id string, fact_id string, prompt_text string, gold_object string, object_aliases array<string>,
gold_object_aliases array<string>, answer_aliases array<string>, subject string, relation string, predicate_id string,
subject_aliases array<string>, relation_aliases array<string>"""

#: Where a manifest's entry ids are looked for, first key present wins, even with an empty list.
ENTRY_KEYS = ("$.deletion_manifest.entry_ids", "$.deletion_manifest.deletion_entry_ids", "$.deletion_entry_ids", "$.oracle_entry_ids", "$.entry_ids")
SOURCE_KEYS = ("$.deletion_manifest.source_ids", "$.source_ids")


def scan_jsonl(spark: SparkSession, path: str, schema: str = PROMPTS) -> DataFrame:
    """JSON lines with a declared schema; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a column `row` of VARIANT, for keys of which presence matters."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("row"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """df with row_index from 0 in the order of a column, by ranks within ranges of it (no single task sees all rows). The
    ranges are stored: sizes and ranks are then of the same ones, whatever is computed anew."""
    ranges = stored(df.repartitionByRange(order).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("__p").agg(F.count("*").alias("n"))
    starts = sizes.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("start"))
    return ranges.join(F.broadcast(starts), "__p").withColumn("row_index", F.col("start") + F.row_number().over(Window.partitionBy("__p").orderBy(order)) - 1).drop("__p", "start")


def prefix(df: DataFrame, n: int, order: str) -> DataFrame:
    """The first n rows by a column: a distributed top-n, not an unordered limit."""
    return df.orderBy(order).limit(n)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts: a keyed load must find none."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    """df, where reading it fails if a key repeats."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit(f"duplicate key {key}")).cast("boolean")).otherwise(F.lit(True))).drop("__n")


def parse_prompts(rows: DataFrame) -> DataFrame:
    """Facts from prompt rows: key, prompt, gold, aliases, subject, relation. A missing prompt or gold is an error."""
    def need(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c))

    return rows.select(
        T.fact_key(F.col("prompt_id"), F.col("fact_id")).alias("key"), "prompt_id", "fact_id", need("prompt_text").alias("prompt"), need("gold_object").alias("ground_truth"),
        T.unique_by_norm(T.aliases(F.col("object_aliases"), F.col("gold_object_aliases"), F.col("answer_aliases"))).alias("object_aliases"),
        "subject", F.coalesce("relation", "predicate_id").alias("relation"), "subject_aliases", "relation_aliases",
    )


def _strings(row: Column, keys: tuple[str, ...]) -> Column:
    """The first key present in a VARIANT row, as an array of strings; an empty or null value there wins over later keys."""
    out = None
    for k in reversed(keys):
        present = F.expr(f"variant_get(row, '{k}') is not null")
        value = F.coalesce(F.try_variant_get(row, k, "array<string>"), F.array(F.try_variant_get(row, k, "string")))
        out = F.when(present, value) if out is None else F.when(present, value).otherwise(out)
    return T.string_tuple(F.coalesce(F.filter(out, lambda x: x.isNotNull()), F.array().cast("array<string>")))


def parse_manifests(raw: DataFrame, *keep: str) -> DataFrame:
    """(keep, row, entry_ids, source_ids, strategy, metadata, manifest_id) from a VARIANT column `row`; metadata is JSON text."""
    row = F.col("row")
    strategy = F.coalesce(F.try_variant_get(row, "$.deletion_manifest.strategy", "string"), F.try_variant_get(row, "$.deletion_strategy", "string"), F.lit("oracle-entry"))
    # A variant's object is written with its keys in order.
    metadata = F.coalesce(F.expr("to_json(try_variant_get(row, '$.deletion_manifest.metadata', 'variant'))"), F.lit("{}"))
    out = raw.select(*keep, "row", _strings(row, ENTRY_KEYS).alias("entry_ids"), _strings(row, SOURCE_KEYS).alias("source_ids"), strategy.alias("strategy"), metadata.alias("metadata"))
    return out.withColumn("manifest_id", manifest_id(F.col("entry_ids"), F.col("source_ids"), F.col("strategy"), F.col("metadata")))


def canonical_json(entry_ids: Column, source_ids: Column, strategy: Column, metadata: Column | None = None) -> Column:
    """The manifest as JSON text with sorted keys and a space after commas and colons; metadata is JSON text with sorted
    keys already ({} without any)."""
    quote = lambda c: F.substring(F.to_json(F.array(c)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(c))) - 2)
    listed = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, quote), ", "), F.lit("]"))
    more = spaced_json(F.coalesce(metadata, F.lit("{}"))) if metadata is not None else F.lit("{}")
    return F.concat(F.lit('{"entry_ids": '), listed(entry_ids), F.lit(', "metadata": '), more, F.lit(', "source_ids": '), listed(source_ids), F.lit(', "strategy": '), quote(strategy), F.lit("}"))


def spaced_json(compact: Column) -> Column:
    """Compact JSON text with a space after each comma and colon outside strings."""
    parts = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*+"|[^"]+'), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, "([,:])", "$1 "))), "")


def manifest_id(entry_ids: Column, source_ids: Column, strategy: Column, metadata: Column | None = None) -> Column:
    return F.substring(F.sha2(canonical_json(entry_ids, source_ids, strategy, metadata), 256), 1, 16)


def popqa(rows: DataFrame, least: int = 10_000, seed: int = 0, limit: int | None = None) -> DataFrame:
    """Popular questions: id, question, possible_answers (JSON text), s_pop, subj, prop -> prompt rows, in a seeded order."""
    answers = T.unique_by_norm(F.coalesce(F.from_json("possible_answers", "array<string>"), F.array().cast("array<string>")))
    out = rows.where(F.col("s_pop") >= least).withColumn("answers", answers).where(F.size("answers") > 0)
    out = out.select(F.concat(F.lit("popqa-"), F.col("id").cast("string")).alias("fact_id"), F.concat(F.trim("question"), F.lit("\nThe answer is")).alias("prompt_text"), F.get("answers", F.lit(0)).alias("gold_object"), F.slice("answers", 2, 1 << 20).alias("object_aliases"), F.col("subj").alias("subject"), F.col("prop").alias("relation"), F.xxhash64(F.lit(seed), "id").alias("order"))
    return out.orderBy("order", "fact_id").limit(limit) if limit else out


def trex(rows: DataFrame, least: int = 30) -> DataFrame:
    """Masked evidences: uuid, obj_label, sub_label, predicate_id, evidences array<struct<masked_sentence, sub_surface>> ->
    the shortest prefix before the mask that names the subject and has `least` characters; ties to the earlier evidence."""
    ev = rows.select("uuid", "obj_label", "sub_label", "predicate_id", F.posexplode("evidences").alias("pos", "e"))
    ev = ev.where(F.col("e.masked_sentence").contains("[MASK]")).withColumn("prefix", F.rtrim(F.substring_index("e.masked_sentence", "[MASK]", 1)))
    ev = ev.where((F.length("prefix") >= least) & F.col("prefix").contains(F.coalesce("e.sub_surface", "sub_label")))
    return ev.groupBy("uuid").agg(F.min_by(F.struct("prefix", "obj_label", "sub_label", "predicate_id"), F.struct(F.length("prefix"), F.col("pos"))).alias("b")).select(F.col("uuid").alias("fact_id"), F.col("b.prefix").alias("prompt_text"), F.col("b.obj_label").alias("gold_object"), F.col("b.sub_label").alias("subject"), F.col("b.predicate_id").alias("predicate_id"))


def googlere(rows: DataFrame, templates: DataFrame, cap: int = 2000) -> DataFrame:
    """Relation triples: uuid, sub_label, obj_label, predicate, pos -> prompts from templates (predicate, template with [X]
    and [Y]); at most cap per relation, in order of pos; the first of each uuid."""
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("uuid").orderBy("pos"))).where("__r = 1")
    told = first.join(F.broadcast(templates) if small(templates, "template") else templates, "predicate").withColumn("prompt_text", F.rtrim(F.substring_index(F.replace(F.col("template"), F.lit("[X]"), F.col("sub_label")), "[Y]", 1)))
    kept = told.withColumn("__r", F.row_number().over(Window.partitionBy("predicate").orderBy("pos"))).where(F.col("__r") <= cap)
    return kept.select(F.col("uuid").alias("fact_id"), "prompt_text", F.col("obj_label").alias("gold_object"), F.col("sub_label").alias("subject"), F.col("predicate").alias("relation"))


def counterfact(rows: DataFrame, variants: bool = False) -> DataFrame:
    """Rewrites: case_id, requested_rewrite struct<prompt, subject, relation_id, target_true struct<str>>, and, for
    variants, paraphrase_prompts and neighborhood_prompts -> prompt rows with the true target."""
    r = F.col("requested_rewrite")
    base = rows.where(r["target_true"]["str"].isNotNull()).withColumn("fact_id", F.concat(F.lit("counterfact-"), F.col("case_id").cast("string")))
    direct = base.select("fact_id", F.col("fact_id").alias("prompt_id"), F.replace(r["prompt"], F.lit("{}"), r["subject"]).alias("prompt_text"), r["target_true"]["str"].alias("gold_object"), r["subject"].alias("subject"), r["relation_id"].alias("predicate_id"), F.lit("direct").alias("variant"))
    if not variants:
        return direct
    out = direct
    for column, name in (("paraphrase_prompts", "paraphrase"), ("neighborhood_prompts", "neighborhood")):
        more = base.select("fact_id", r.alias("requested_rewrite"), F.posexplode(column).alias("i", "prompt_text"))
        q = F.col("requested_rewrite")
        out = out.unionByName(more.select("fact_id", F.concat_ws("-", "fact_id", F.lit(name), F.col("i").cast("string")).alias("prompt_id"), "prompt_text", q["target_true"]["str"].alias("gold_object"), q["subject"].alias("subject"), q["relation_id"].alias("predicate_id"), F.lit(name).alias("variant")))
    return out


def zsre(records: DataFrame, rephrase: bool = False) -> DataFrame:
    """Questions: rows of i (the place in the file), question, answers, rephrases -> prompt rows numbered by place."""
    rows = records.select("i", F.struct("question", "answers", "rephrases").alias("r"))
    answers = F.filter(F.col("r.answers"), lambda a: F.trim(a) != "")
    rows = rows.withColumn("answers", answers).where(F.size("answers") > 0).withColumn("fact_id", F.concat(F.lit("zsre-"), F.col("i").cast("string")))
    stub = lambda q: F.concat(F.trim(q), F.lit("\nThe answer is"))
    out = rows.select("fact_id", F.col("fact_id").alias("prompt_id"), stub(F.col("r.question")).alias("prompt_text"), F.get("answers", F.lit(0)).alias("gold_object"), F.slice("answers", 2, 1 << 20).alias("object_aliases"))
    if rephrase:
        more = rows.select("fact_id", "answers", F.posexplode("r.rephrases").alias("k", "q"))
        out = out.unionByName(more.select("fact_id", F.concat_ws("-", "fact_id", F.lit("rephrase"), F.col("k").cast("string")).alias("prompt_id"), stub(F.col("q")).alias("prompt_text"), F.get("answers", F.lit(0)).alias("gold_object"), F.slice("answers", 2, 1 << 20).alias("object_aliases")))
    return out
