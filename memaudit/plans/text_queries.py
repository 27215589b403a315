"""Queries over texts: scans, equivalence, answer scores, sources, statistics and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memaudit.functions import stats
from memaudit.functions import text as T
from memaudit.operators import followups, incremental, mentions
from memaudit.sources import prompts

from .base import spread, sql_holds, sql_judge, sql_norm, sql_tokens, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


# Scans.


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 1000")
def scan_project_filter(spark, d):
    return table(spark, d, "documents").where("lang = 'en' and n_chars > 1000").select("doc_id", "source", "n_chars")


@query("SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def scan_prompts_limit(spark, d):
    return prompts.prefix(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), 50, "doc_id")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) r FROM documents) WHERE r = 1")
def dedupe_first_wins(spark, d):
    return followups.first_wins(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) r FROM documents) WHERE r = 1")
def dedupe_last_wins(spark, d):
    docs = table(spark, d, "documents")
    last = docs.groupBy("source", "lang").agg(F.max_by(F.struct("doc_id", "n_chars"), "doc_id").alias("r"))
    return last.select("source", "lang", "r.doc_id", "r.n_chars")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def scan_examples_unique(spark, d):
    return prompts.duplicate_keys(table(spark, d, "orders"), "o_custkey")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) r FROM events) WHERE r = 1")
def scan_stream_facts(spark, d):
    return followups.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(user_id AS DOUBLE) AS u FROM events")
def cast_numeric_cols(spark, d):
    """Of three text columns the one that isn't all numbers goes."""
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("user_id").cast("string").alias("u"), F.col("event_type").alias("word"))
    return followups.cast_numeric(e).select("event_id", "k", "u")


# Text equivalence.


@query(f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5 FROM documents")
def normalize_text(spark, d):
    return documents(spark, d).select("doc_id", F.md5(T.norm(F.col("text"))).alias("norm_md5"))


@query(f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({sql_tokens('text')})) AS INTEGER) AS n_distinct FROM documents")
def tokenize(spark, d):
    t = documents(spark, d).select("doc_id", T.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _turn_pairs(spark, d) -> DataFrame:
    """Each assistant turn with the turn before it as its gold."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("gold", F.lag("text").over(w))
    rows = rows.where("role = 'assistant' and gold is not null").select("conv_id", "turn", F.col("text").alias("prediction"), "gold")
    # An alias that a prediction can hold: the gold's third token.
    rows = rows.withColumn("pt", T.tokens(F.col("prediction"))).withColumn("gt", T.tokens(F.col("gold")))
    return rows.withColumn("pn", F.array_join("pt", " ")).withColumn("alias", F.coalesce(F.get("gt", F.lit(2)), F.lit("")))


SQL_TURNS = f"""
t AS (SELECT conv_id, turn, role, text AS prediction, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS gold FROM conversations),
u AS (SELECT conv_id, turn, prediction, gold, {sql_tokens('prediction')} AS pt, {sql_tokens('gold')} AS gt FROM t WHERE role = 'assistant' AND gold IS NOT NULL),
s AS (SELECT *, array_to_string(pt, ' ') AS pn, array_to_string(gt, ' ') AS gn, coalesce(gt[3], '') AS alias FROM u)
"""


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, CAST((pn <> '' AND (pn = gn OR pn = alias)) AS DOUBLE) AS exact FROM s")
def exact_match(spark, d):
    s = _turn_pairs(spark, d)
    return s.select("conv_id", "turn", T.exact_match(F.col("prediction"), F.col("gold"), F.array("alias")).alias("exact"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, CAST(({sql_holds('pn', 'gn')} OR {sql_holds('pn', 'alias')}) AS DOUBLE) AS contains FROM s")
def contains_match(spark, d):
    s = _turn_pairs(spark, d).withColumn("golds", T.norm_set(F.col("gold"), F.array("alias")))
    return s.select("conv_id", "turn", T.contains_norms(F.col("pn"), F.col("golds")).cast("double").alias("contains"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, CAST(pn IN ('', 'unknown', 'n a', 'na', 'none', 'no answer', 'i don''t know', 'i do not know', 'i don t know') AS DOUBLE) AS unknown FROM s")
def is_unknown(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", T.is_unknown(F.col("prediction")).alias("unknown"))


@query(f"""WITH {SQL_TURNS}, o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_filter(pt, lambda x: list_contains(gt, x))),
  lambda x: least(len(list_filter(pt, lambda y: y = x)), len(list_filter(gt, lambda y: y = x))))), 0) AS shared FROM s)
SELECT conv_id, turn, round(CASE WHEN pn = gn THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / len(pt) END, 9) AS p,
  round(CASE WHEN pn = gn THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE CAST(shared AS DOUBLE) / len(gt) END, 9) AS r,
  round(CASE WHEN pn = gn THEN 1.0 WHEN shared = 0 THEN 0.0 ELSE CAST(2 * shared AS DOUBLE) / (len(pt) + len(gt)) END, 9) AS f FROM o""")
def precision_recall_f1(spark, d):
    s = _turn_pairs(spark, d).withColumn("b", T.prf1(F.col("pt"), F.col("gt"), (F.col("pn") != "") & (F.col("pn") == F.array_join("gt", " "))))
    return s.select("conv_id", "turn", F.round("b.precision", 9).alias("p"), F.round("b.recall", 9).alias("r"), F.round("b.f1", 9).alias("f"))


@query(f"""WITH a AS (SELECT doc_id, [source, upper(source), lang, '!!', text, upper(text), lang] AS xs FROM documents),
x AS (SELECT doc_id, unnest(xs) AS v, unnest(range(7)) AS i FROM a), y AS (SELECT *, {sql_norm('v')} AS n FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS r FROM y WHERE n <> '')
SELECT doc_id, md5(string_agg(v, '|' ORDER BY i)) AS kept FROM z WHERE r = 1 GROUP BY doc_id""")
def unique_by_norm(spark, d):
    xs = F.array("source", F.upper("source"), "lang", F.lit("!!"), "text", F.upper("text"), "lang")
    return documents(spark, d).select("doc_id", xs.alias("xs")).select("doc_id", F.md5(F.array_join(T.unique_by_norm(F.col("xs")), "|")).alias("kept"))


@query(f"""WITH g AS (SELECT doc_id, lang, source, text AS a FROM documents)
SELECT doc_id, ({sql_norm('a')}) <> '' AND (({sql_norm('a')}) = ({sql_norm("upper(a)")}) OR ({sql_norm('a')}) = lang) AS same FROM g""")
def values_equivalent(spark, d):
    g = documents(spark, d).select("doc_id", "lang", F.col("text").alias("a"))
    return g.select("doc_id", T.values_equivalent(F.col("a"), F.upper("a"), None, F.array("lang")).alias("same"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, array_to_string(list_transform(gt, lambda x: substr(x, 1, 1)), '') AS acronym, CASE WHEN alias = '' THEN 'fact:' || conv_id ELSE alias || '|' || gn || '|' || pn END AS grp FROM s")
def acronym_and_group(spark, d):
    s = _turn_pairs(spark, d)
    return s.select("conv_id", "turn", T.acronym(F.col("gold")).alias("acronym"), T.proposition_group(F.col("conv_id"), F.col("alias"), F.col("gold"), F.col("prediction"), "|").alias("grp"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query(r"""WITH a AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace('it is ' || text, '(?s)<FACT>.*?</FACT>', ' ', 'g'), '</?[A-Z_]+>', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM conversations),
b AS (SELECT conv_id, turn, trim(regexp_replace(s, '(?i)^(?:answer:|the answer is|it is|it''s)', '')) AS s FROM a),
c AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[.!?]\s') THEN regexp_extract(s, '^(.*?[.!?])\s', 1) ELSE s END AS s FROM b)
SELECT conv_id, turn, trim(s, ' .,;:`"''') AS answer FROM c""")
def clean_completion(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.clean_completion(F.concat(F.lit("it is "), "text")).alias("answer"))


# Mentions: texts and phrases by the phrases' rarest grams.


def _mentions(spark, d) -> DataFrame:
    texts = documents(spark, d).select(F.col("doc_id").alias("id"), T.norm(F.col("text")).alias("n"))
    phrases = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id"), T.norm(F.col("text")).alias("m"))
    return mentions.mention_pairs(texts, phrases)


SQL_MENTIONS = f"""n AS (SELECT doc_id, {sql_norm('text')} AS n FROM documents), b AS (SELECT item_id, {sql_norm('text')} AS m FROM benchmark),
hit AS (SELECT n.doc_id, b.item_id FROM n JOIN b ON {sql_judge('n.n', 'b.m')})"""


@query(f"WITH {SQL_MENTIONS} SELECT doc_id, item_id FROM hit")
def judge_mentions(spark, d):
    return _mentions(spark, d).select(F.col("id").alias("doc_id"), F.col("phrase_id").alias("item_id"))


@query(f"""WITH {SQL_MENTIONS}, c AS (SELECT b.item_id, count(h.doc_id) AS n FROM b LEFT JOIN hit h ON b.item_id = h.item_id GROUP BY 1)
SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' WHEN n <= 9 THEN '5-9' WHEN n <= 24 THEN '10-24' WHEN n <= 49 THEN '25-49' WHEN n <= 99 THEN '50-99' ELSE '100+' END AS bin,
count(*) AS items, CAST(sum(n) AS BIGINT) AS mentions FROM c GROUP BY 1""")
def frequency_bins(spark, d):
    counts = _mentions(spark, d).groupBy("phrase_id").agg(F.count("*").alias("n"))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("phrase_id")).join(counts, "phrase_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return items.groupBy(T.frequency_bin(F.col("n")).alias("bin")).agg(F.count("*").alias("items"), F.sum("n").alias("mentions"))


# Sources.


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos, lang FROM documents),
q AS (SELECT doc_id, pos, rtrim(string_split(replace(line, ' the ', '[MASK]'), '[MASK]')[1]) AS prefix FROM s WHERE contains(line, ' the ')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(prefix), pos) AS r FROM q WHERE length(prefix) >= 30)
SELECT CAST(doc_id AS VARCHAR) AS fact_id, prefix AS prompt_text FROM r WHERE r = 1""")
def src_trex(spark, d):
    docs = table(spark, d, "documents")
    ev = F.transform(F.split("text", "\n"), lambda s: F.struct(F.replace(s, F.lit(" the "), F.lit("[MASK]")).alias("masked_sentence"), F.lit("").alias("sub_surface")))
    rows = docs.select(F.col("doc_id").cast("string").alias("uuid"), F.lit("the").alias("obj_label"), F.lit("").alias("sub_label"), F.lit("P").alias("predicate_id"), ev.alias("evidences"))
    return prompts.trex(rows).select("fact_id", "prompt_text")


@query("""WITH a AS (SELECT CAST(page_id AS VARCHAR) AS fact_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, split_part(url, ':', 1) AS predicate, page_id FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY predicate ORDER BY page_id) AS r FROM a)
SELECT fact_id, host || ' is reached by' AS prompt_text, predicate AS relation FROM r WHERE r <= 2000""")
def src_googlere(spark, d):
    pages = table(spark, d, "pages")
    rows = pages.select(F.col("page_id").cast("string").alias("uuid"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("sub_label"), F.substring_index("url", ":", 1).alias("obj_label"), F.substring_index("url", ":", 1).alias("predicate"), F.col("page_id").alias("pos"))
    templates = spark.createDataFrame([("http", "[X] is reached by [Y]."), ("https", "[X] is reached by [Y].")], "predicate string, template string")
    return prompts.googlere(rows, templates, cap=2000).select("fact_id", "prompt_text", "relation")


@query("""SELECT 'counterfact-' || c_custkey AS fact_id, 'counterfact-' || c_custkey || CASE v WHEN 0 THEN '' ELSE '-paraphrase-' || (v - 1) END AS prompt_id,
CASE v WHEN 0 THEN 'The name of customer ' || c_custkey || ' is' WHEN 1 THEN 'Customer ' || c_custkey || ', called' ELSE 'One calls ' || c_custkey END AS prompt_text, c_name AS gold_object
FROM customer, (SELECT unnest([0, 1, 2]) AS v)""")
def src_counterfact(spark, d):
    key = F.col("c_custkey").cast("string")
    r = F.struct(F.lit("The name of customer {} is").alias("prompt"), key.alias("subject"), F.lit("P1").alias("relation_id"), F.struct(F.col("c_name").alias("str")).alias("target_true"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), r.alias("requested_rewrite"), F.array(F.concat(F.lit("Customer "), key, F.lit(", called")), F.concat(F.lit("One calls "), key)).alias("paraphrase_prompts"), F.array().cast("array<string>").alias("neighborhood_prompts"))
    return prompts.counterfact(rows, variants=True).select("fact_id", "prompt_id", "prompt_text", "gold_object")


@query("""SELECT 'popqa-' || p_partkey AS fact_id, 'What is part ' || p_partkey || '?' || chr(10) || 'The answer is' AS prompt_text, p_name AS gold_object FROM part WHERE p_size * 1000 >= 10000 AND p_name IS NOT NULL""")
def src_popqa(spark, d):
    rows = table(spark, d, "part").where("p_name is not null").select(F.col("p_partkey").alias("id"), F.concat(F.lit("What is part "), F.col("p_partkey"), F.lit("?")).alias("question"), F.to_json(F.array("p_name")).alias("possible_answers"), (F.col("p_size") * 1000).alias("s_pop"), F.lit("").alias("subj"), F.lit("").alias("prop"))
    return prompts.popqa(rows).select("fact_id", "prompt_text", "gold_object")


@query("""SELECT 'zsre-' || n_nationkey AS fact_id, 'Which nation is ' || n_nationkey || '?' || chr(10) || 'The answer is' AS prompt_text, n_name AS gold_object FROM nation""")
def src_zsre(spark, d):
    r = table(spark, d, "nation").select(F.col("n_nationkey").alias("i"), F.concat(F.lit("Which nation is "), F.col("n_nationkey"), F.lit("?")).alias("question"), F.array("n_name").alias("answers"), F.array().cast("array<string>").alias("rephrases"))
    return prompts.zsre(r).select("fact_id", "prompt_text", "gold_object")


@query("""WITH m AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN [] WHEN 4 THEN [CAST(user_id AS VARCHAR)] ELSE list_sort(list_distinct([CAST(user_id AS VARCHAR), event_type])) END AS ids,
 CASE event_id % 5 WHEN 3 THEN [event_type] ELSE [] END AS sources, CASE event_id % 5 WHEN 2 THEN 'closure' ELSE 'oracle-entry' END AS strategy, CASE event_id % 5 WHEN 2 THEN '{"k": ' || (event_id % 9) || ', "note": "a: b, c"}' ELSE '{}' END AS meta FROM events)
SELECT event_id, array_to_string(ids, ',') AS entry_ids, array_to_string(sources, ',') AS source_ids, strategy, substr(sha256('{"entry_ids": [' || array_to_string(list_transform(ids, lambda x: '"' || x || '"'), ', ') || '], "metadata": ' || meta || ', "source_ids": ['
 || array_to_string(list_transform(sources, lambda x: '"' || x || '"'), ', ') || '], "strategy": "' || strategy || '"}'), 1, 16) AS manifest_id FROM m""")
def parse_manifest(spark, d):
    """Manifests of five shapes as JSON, parsed: an empty struct that wins over ids, plain and oracle ids, sources, one with metadata."""
    e = table(spark, d, "events")
    q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"'))
    both = F.concat(F.lit("["), q("user_id"), F.lit(", "), q("event_type"), F.lit(", "), q("user_id"), F.lit("]"))
    kind = F.col("event_id") % 5
    shape = (
        F.when(kind == 0, F.concat(F.lit('{"deletion_manifest": {"entry_ids": []}, "entry_ids": '), both, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"entry_ids": '), both, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"deletion_manifest": {"entry_ids": '), both, F.lit(', "strategy": "closure", "metadata": {"note": "a: b, c", "k": '), (F.col("event_id") % 9).cast("string"), F.lit("}}}")))
        .when(kind == 3, F.concat(F.lit('{"oracle_entry_ids": '), both, F.lit(', "source_ids": '), q("event_type"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"entry_ids": '), q("user_id"), F.lit("}")))
    )
    parsed = prompts.parse_manifests(e.select("event_id", F.parse_json(shape).alias("row")), "event_id")
    return parsed.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("entry_ids", "source_ids")], "strategy", "manifest_id")


# Statistics.


def _labelled(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source"), "doc_id")


SQL_LAB = "l AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, d.lang, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"
SQL_AUROC = """r AS (SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS r FROM {t})
SELECT count(*) FILTER (WHERE {y}) AS positives, count(*) FILTER (WHERE NOT ({y})) AS negatives, round((sum(r) FILTER (WHERE {y}) - count(*) FILTER (WHERE {y}) * (count(*) FILTER (WHERE {y}) + 1) / 2.0)
 / (CAST(count(*) FILTER (WHERE {y}) AS DOUBLE) * count(*) FILTER (WHERE NOT ({y}))), 9) AS auroc FROM r"""


@query(f"WITH {SQL_LAB}, " + SQL_AUROC.format(x="n_chars", y="quality = 1", t="l"))
def auroc(spark, d):
    rows = _labelled(spark, d).withColumn("y", F.col("quality") == 1)
    return stats.auroc(rows, "n_chars", "y").withColumn("auroc", F.round("auroc", 9))


@query(f"""WITH {SQL_LAB}, r AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rx,
 rank() OVER (PARTITION BY lang ORDER BY doc_id % 37) + (count(*) OVER (PARTITION BY lang, doc_id % 37) - 1) / 2.0 AS ry FROM l)
SELECT lang, count(*) AS n, round(corr(rx, ry), 9) AS spearman FROM r GROUP BY lang""")
def spearman(spark, d):
    rows = _labelled(spark, d).withColumn("y", F.col("doc_id") % 37)
    return stats.spearman(rows, "n_chars", "y", ("lang",)).withColumn("spearman", F.round("spearman", 9))


@query(f"""WITH {SQL_LAB}, c AS (SELECT lang, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) a, CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) b,
 CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) c, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS DOUBLE) d, count(*) AS n FROM l GROUP BY lang)
SELECT lang, n, CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) > 0 THEN round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 9) END AS phi FROM c""")
def phi(spark, d):
    rows = _labelled(spark, d).select("lang", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))
    return stats.phi(rows, "x", "y", ("lang",)).withColumn("phi", F.round("phi", 9))


@query("""WITH c AS (SELECT user_id % 7 AS g, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT g, count(*) AS answers, round(max(n) / CAST(sum(n) AS DOUBLE), 9) AS majority_share,
 round(CASE WHEN count(*) > 1 THEN (ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)) ELSE 0.0 END, 9) AS entropy FROM c GROUP BY g""")
def answer_entropy(spark, d):
    e = table(spark, d, "events").withColumn("g", F.col("user_id") % 7)
    return stats.answer_entropy(e, "event_type", ("g",)).withColumns({"majority_share": F.round("majority_share", 9), "entropy": F.round("entropy", 9)})


@query("""WITH t AS (SELECT event_id, event_type AS a, user_id % 10 AS rel, event_id % 5 AS fold FROM events),
inside AS (SELECT a, fold, count(*) n FROM t GROUP BY 1, 2), tot AS (SELECT a, count(*) n FROM t GROUP BY 1),
g AS (SELECT fold, a AS mode FROM (SELECT f.fold, tot.a, row_number() OVER (PARTITION BY f.fold ORDER BY tot.n - coalesce(inside.n, 0) DESC, tot.a) r FROM tot CROSS JOIN (SELECT DISTINCT fold FROM t) f LEFT JOIN inside ON inside.a = tot.a AND inside.fold = f.fold) WHERE r = 1),
ri AS (SELECT rel, a, fold, count(*) n FROM t GROUP BY 1, 2, 3), rt AS (SELECT rel, a, count(*) n FROM t GROUP BY 1, 2),
rg AS (SELECT rel, fold, a AS mode FROM (SELECT rt.rel, f.fold, rt.a, row_number() OVER (PARTITION BY rt.rel, f.fold ORDER BY rt.n - coalesce(ri.n, 0) DESC, rt.a) r FROM rt CROSS JOIN (SELECT DISTINCT fold FROM t) f LEFT JOIN ri ON ri.rel = rt.rel AND ri.a = rt.a AND ri.fold = f.fold WHERE rt.n - coalesce(ri.n, 0) > 0) WHERE r = 1)
SELECT count(*) AS facts, round(avg(CASE WHEN g.mode = t.a THEN 1.0 ELSE 0.0 END), 9) AS global_prior, round(avg(CASE WHEN rg.mode = t.a THEN 1.0 ELSE 0.0 END), 9) AS relation_prior,
 round(avg(CASE WHEN tot.n > inside.n THEN 1.0 ELSE 0.0 END), 9) AS answer_seen
FROM t LEFT JOIN g ON g.fold = t.fold LEFT JOIN rg ON rg.rel = t.rel AND rg.fold = t.fold JOIN inside ON inside.a = t.a AND inside.fold = t.fold JOIN tot ON tot.a = t.a""")
def majority_priors(spark, d):
    t = table(spark, d, "events").select("event_id", F.col("event_type").alias("answer"), (F.col("user_id") % 10).alias("relation"), (F.col("event_id") % 5).alias("fold"))
    out = followups.majority_priors(t)
    return out.select("facts", *[F.round(c, 9).alias(c) for c in ("global_prior", "relation_prior", "answer_seen")])


@query(f"""WITH {SQL_LAB}, o AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS r, count(*) OVER () AS n FROM l),
q AS (SELECT max(CASE WHEN r = CAST(floor(0.25 * n) AS BIGINT) + 1 THEN n_chars END) a, max(CASE WHEN r = CAST(floor(0.5 * n) AS BIGINT) + 1 THEN n_chars END) b, max(CASE WHEN r = CAST(floor(0.75 * n) AS BIGINT) + 1 THEN n_chars END) c FROM o)
SELECT CAST((CASE WHEN a < n_chars THEN 1 ELSE 0 END) + (CASE WHEN b < n_chars THEN 1 ELSE 0 END) + (CASE WHEN c < n_chars THEN 1 ELSE 0 END) AS INTEGER) AS bin, count(*) AS facts, round(avg(quality), 9) AS mean_quality, round(avg(CASE WHEN n_chars >= 450 THEN 1.0 ELSE 0.0 END), 9) AS near_cap_share FROM l, q GROUP BY 1""")
def quartile_bins(spark, d):
    out = stats.quartile_bins(_labelled(spark, d), "n_chars", ["quality"])
    return out.withColumns({"mean_quality": F.round("mean_quality", 9), "near_cap_share": F.round("near_cap_share", 9)})


@query()
def logit_per_doubling(spark, d):
    rows = _labelled(spark, d).withColumn("y", F.col("toxic") == 1)
    out = stats.logit_per_doubling(rows, "n_chars", "y")
    return spark.createDataFrame([(out["n"], out["slope"], out["odds_ratio"], out["low"], out["high"])], "n long, slope double, odds_ratio double, low double, high double")


@query(f"""WITH {SQL_LAB}, c AS (SELECT *, 'answer_mention' AS cohort FROM l UNION ALL SELECT *, 'full_correct' FROM l WHERE quality = 1),
b AS (SELECT cohort, toxic, doc_id % 130 AS k FROM c)
SELECT cohort, CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' WHEN k <= 4 THEN '2-4' WHEN k <= 9 THEN '5-9' WHEN k <= 24 THEN '10-24' WHEN k <= 49 THEN '25-49' WHEN k <= 99 THEN '50-99' ELSE '100+' END AS bin,
count(*) AS facts, round(avg(toxic), 9) AS toxic_rate FROM b GROUP BY 1, 2""")
def frequency_bin_summary(spark, d):
    rows = _labelled(spark, d).select((F.col("doc_id") % 130).alias("k"), (F.col("quality") == 1).alias("full_correct"), "toxic")
    return followups.frequency_bin_summary(rows, "k", ["toxic"]).withColumn("toxic_rate", F.round("toxic_rate", 9))


@query("""SELECT count(*) AS facts, count(DISTINCT o_orderstatus) AS relations, count(DISTINCT o_orderpriority) AS answers,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1)) AS canonical_groups, (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS duplicate_groups,
 (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey HAVING count(*) > 1)) AS facts_in_duplicate_groups, (SELECT max(n) FROM (SELECT count(*) n FROM orders GROUP BY o_custkey)) AS largest_canonical_group,
 (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT o_orderkey % 5) > 1)) AS duplicate_groups_split_by_legacy_folds FROM orders""")
def probe_diagnostics(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("group"), (F.col("o_orderkey") % 5).alias("fold"), F.col("o_orderpriority").alias("answer"), F.col("o_orderstatus").alias("relation"))
    return followups.probe_diagnostics(o).select("facts", "relations", "answers", "canonical_groups", "duplicate_groups", "facts_in_duplicate_groups", "largest_canonical_group", "duplicate_groups_split_by_legacy_folds")


# Joins and set operations.


@query("""SELECT c.c_custkey AS fact_id, a.correct AS standard_correct, b.correct AS small_correct FROM customer c
LEFT JOIN (SELECT o_custkey, max(o_totalprice) > 200000 AS correct FROM orders GROUP BY 1) a ON a.o_custkey = c.c_custkey
LEFT JOIN (SELECT o_custkey, min(o_totalprice) > 5000 AS correct FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c.c_custkey""")
def join_models(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "fact_id")
    a = o.groupBy("fact_id").agg((F.max("o_totalprice") > 200000).alias("correct"))
    b = o.where("o_orderstatus = 'F'").groupBy("fact_id").agg((F.min("o_totalprice") > 5000).alias("correct"))
    return followups.matched_models(table(spark, d, "customer").select(F.col("c_custkey").alias("fact_id")), ("standard", a), ("small", b))


@query("SELECT doc_id AS fact_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en' INTERSECT SELECT doc_id FROM documents WHERE n_chars > 500")
def intersect_cohort(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "fact_id")
    return followups.intersect_cohort(table(spark, d, "labels").where("quality = 1").withColumnRenamed("doc_id", "fact_id"), docs.where("lang = 'en'"), docs.where("n_chars > 500"))


@query("SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents WHERE lang = 'de' EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents WHERE lang = 'de')")
def except_labels(spark, d):
    return followups.label_coverage(table(spark, d, "documents").where("lang = 'de'"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT toxic AS label, count(*) AS n, CAST(sum(quality) AS BIGINT) AS borderline FROM labels GROUP BY 1")
def survivor_split(spark, d):
    return followups.survivor_split(table(spark, d, "labels").select(F.col("toxic").alias("label"), F.col("quality").alias("borderline")))


@query("SELECT n_regionkey AS source_id, list_sort(list(n_name)) AS names FROM nation GROUP BY 1")
def string_tuple(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("source_id")).agg(T.string_tuple(F.collect_list(F.concat(F.lit(" "), F.col("n_name")))).alias("names"))


@query(f"WITH {SQL_TURNS} SELECT conv_id, turn, (len(pt) > 0 AND len(gt) > 0 AND (len(list_filter(pt, lambda x: NOT list_contains(gt, x))) = 0 OR len(list_filter(gt, lambda x: NOT list_contains(pt, x))) = 0)) AS subset FROM s")
def subset_tokens(spark, d):
    return _turn_pairs(spark, d).select("conv_id", "turn", T.token_subset(F.col("prediction"), F.col("gold")).alias("subset"))


# Incremental execution.


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0 OR event_type <> 'click'")
def resume_antijoin(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return incremental.remaining(e, e.where("event_id % 3 = 0 and event_type = 'click'"), ["event_id"]).select("event_id", "user_id")


@query("""WITH j AS (SELECT event_id, user_id, CAST(event_id % 4 AS VARCHAR) AS fp FROM events), s AS (SELECT user_id, CAST(event_id % 4 AS VARCHAR) AS fp, event_id AS pos, value FROM events WHERE event_id % 5 = 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, fp ORDER BY pos) r FROM s) WHERE r = 1)
SELECT CASE WHEN f.user_id IS NULL THEN 'generated' ELSE 'reused' END AS provenance, count(*) AS n, round(sum(coalesce(f.value, 0)), 4) AS value FROM j LEFT JOIN f ON f.user_id = j.user_id AND f.fp = j.fp GROUP BY 1""")
def reuse_serve(spark, d):
    e = table(spark, d, "events").withColumn("fingerprint", (F.col("event_id") % 4).cast("string"))
    stored = e.where("event_id % 5 = 0").select("user_id", "fingerprint", F.col("event_id").alias("source_pos"), "value")
    served, rest = incremental.reuse(e.select("event_id", "user_id", "fingerprint"), stored, ["user_id"])
    both = served.select("provenance", "value").unionByName(rest.select("provenance", F.lit(0.0).alias("value")))
    return both.groupBy("provenance").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query()
def crc_canary(spark, d):
    return table(spark, d, "events").where(T.crc_sample(F.col("event_id").cast("string"), 0.05)).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE event_id % 7 = 3")
def stripe_fact(spark, d):
    return incremental.stripe(table(spark, d, "events"), 3, 7, "event_id").select("event_id")


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id % 2, event_id) r FROM events) WHERE r = 1")
def union_partials(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", "event_id", F.col("event_id").alias("row_index"))
    return incremental.union_first_wins([e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")], ["event_type", "user_id"]).select("event_type", "user_id", "event_id")


# Features and controls.


@query(f"""WITH a AS (SELECT item_id, '##' || {sql_norm("text")} || '##' AS s FROM benchmark), g AS (SELECT item_id, substr(s, CAST(i AS INTEGER), 3) AS g FROM a, (SELECT unnest(range(1, (SELECT max(length(s)) FROM a))) AS i) WHERE i <= length(s) - 2),
c AS (SELECT item_id, CAST(('0x' || right(md5(g), 8)) AS BIGINT) % 2048 AS feature, count(*) AS n FROM g GROUP BY 1, 2)
SELECT item_id, feature, round(n / sqrt(sum(n * n) OVER (PARTITION BY item_id)), 9) AS weight FROM c""")
def answer_features(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", T.norm(F.col("text")).alias("a"))
    return rows.select("item_id", F.explode(T.answer_features(F.col("a"))).alias("f")).select("item_id", "f.feature", F.round("f.weight", 9).alias("weight"))


@query()
def seq_ratio_signal(spark, d):
    s = _turn_pairs(spark, d).select("conv_id", "turn", F.col("prediction").alias("v"), F.array("gold").alias("answers"), "pn", F.array(F.array_join("gt", " ")).alias("norms"))
    s = s.withColumn("ratio", followups.seq_ratio("pn", "norms"))
    return s.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), followups.variant_signal(F.col("v"), F.col("answers"), F.col("ratio")).alias("signal"))


@query()
def hashed_prompt(spark, d):
    from memaudit.operators.probe import hashed_prompt_vectors

    rows = hashed_prompt_vectors(table(spark, d, "benchmark"), 64, "item_id", "text")
    return rows.select("item_id", F.transform("vector", lambda x: F.round(x, 9)).alias("vector"))
