"""The operators as queries over the tables of a directory, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table
from .byte_bpe import Tokenizer, encode_decode
from .chat import chat_windows, read_back
from .decontaminate import contamination
from .exact_topk import exact_topk
from .language_id import identify_languages
from .line_dedup import apply_bitmaps, keep_bitmaps
from .ngram_join import jaccard_components
from .packing import pack
from .pii import pseudonymize
from .prefix_trie import conversation_trie
from .quality import classify
from .retention import retention
from .warc import derivatives, responses


def tokenizer(spark: SparkSession) -> Tokenizer:
    import public_tokenizers

    return Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


def encoded(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = encode_decode(docs, tokenizer(spark))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(encode_decode(table(spark, sf_dir, "documents"), tokenizer(spark), decode=False))


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(chat_windows(rows, tokenizer(spark)))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), key="memaudit")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = apply_bitmaps(docs, keep_bitmaps(docs, min_docs=10))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derivatives(responses(table(spark, sf_dir, "pages")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    nodes = conversation_trie(table(spark, sf_dir, "conversations"), base=c - c % 20, shared=F.crc32(c.cast("string")) % 4)
    return nodes.drop("first", "last")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op13_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("click_id").cast("string"))
    late = F.coalesce(F.when(h % 3 == 0, h % 100), F.lit(0)).cast("int")
    arrival = F.col("arrived_at") + F.make_dt_interval(days=late)
    return retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"), known_by="2024-02-15 00:00:00", arrival=arrival)


QUERIES = {
    "op1_exact_topk": op1_exact_topk,
    "op2_ngram_join": op2_ngram_join,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_token_packing": op4_token_packing,
    "op5_chat_windows": op5_chat_windows,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_quality": op9_quality,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_cohort_retention": op13_cohort_retention,
}

#: crc(i, crc) for the distinct ids i of a table ids(i): CRC-32 of their decimal text, byte by byte with the usual table.
_CRC = """r AS (
  SELECT i AS b, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) t(i)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM r WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM r WHERE k = 8
), crc AS (
  SELECT i, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(i AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295) AS crc
  FROM ids, crc_table
)"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), t AS (
  SELECT vec_id, unnest(c) AS w, unnest(range(len(c))) AS term FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM t q JOIN t c ON q.term = c.term AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d
), m AS (
  SELECT d, min(c) AS c FROM r GROUP BY d
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id FROM s JOIN m ON m.d = s.doc_id
""",
    "op7_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), hot AS (
  SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), m AS (
  SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op11_prefix_trie": f"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT conv_id AS i FROM conversations WHERE conv_id IS NOT NULL
), {_CRC}, t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (
  SELECT *, dense_rank() OVER (ORDER BY role, text) AS tok, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM t
), c AS (
  SELECT i AS conv_id, crc % 4 AS h, i - i % 20 AS base FROM crc
), x AS (
  SELECT c.conv_id, 0 AS own, p, tok FROM c JOIN k ON k.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, 1, p, tok FROM c JOIN k ON k.conv_id = c.conv_id AND p > h
), l AS (
  SELECT c.conv_id, coalesce(list(tok ORDER BY own, p) FILTER (WHERE tok IS NOT NULL), []) AS path FROM c LEFT JOIN x ON x.conv_id = c.conv_id GROUP BY 1
), pre AS (
  SELECT conv_id, path[1:d] AS path FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM l)
), n AS (
  SELECT path, min(conv_id) AS conv_id, count(*) AS n_convs FROM pre GROUP BY path
), ch AS (
  SELECT path[1:len(path) - 1] AS path, count(*) AS n_children FROM n WHERE len(path) > 0 GROUP BY 1
), w AS (
  SELECT tok, any_value(words) AS words FROM k GROUP BY tok
), f AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN len(n.path) = 0 THEN 0 ELSE (n_convs - 1) * words END AS saved
  FROM n LEFT JOIN ch ON ch.path = n.path LEFT JOIN w ON w.tok = n.path[-1]
), a AS (
  SELECT path[1:d] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM f) GROUP BY 1
), e AS (
  SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM l GROUP BY path
)
SELECT f.conv_id, CAST(len(f.path) AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, a.n_leaves,
       CAST(a.saved_tokens AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM f JOIN a ON a.path = f.path LEFT JOIN e ON e.path = f.path LEFT JOIN n u ON len(f.path) > 0 AND u.path = f.path[1:len(f.path) - 1]
""",
    "op13_cohort_retention": f"""
WITH RECURSIVE ids AS (
  SELECT DISTINCT click_id AS i FROM clicks WHERE click_id IS NOT NULL UNION SELECT DISTINCT client_id FROM clicks WHERE client_id IS NOT NULL
), {_CRC}, e AS (
  SELECT client_id, ts, kind, CASE WHEN value IS NOT NULL AND isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents,
         arrived_at + to_days(CAST(CASE WHEN crc % 3 = 0 THEN crc % 100 ELSE 0 END AS INTEGER)) AS arrives
  FROM (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL) LEFT JOIN crc ON i = click_id
), k AS (
  SELECT 0 AS state, * FROM e WHERE arrives < TIMESTAMP '2024-02-15 00:00:00' UNION ALL SELECT 1, * FROM e
), s AS (
  SELECT state, client_id, min(ts) AS start, CAST(floor(epoch_us(date_trunc('day', min(ts))) / 86400000000) AS BIGINT) AS cohort FROM k WHERE kind = 'signup' GROUP BY 1, 2
), m AS (
  SELECT a.client_id FROM s a JOIN s b ON a.client_id = b.client_id AND a.state = 0 AND b.state = 1 AND a.cohort <> b.cohort
), g AS (
  SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1
), u AS (
  SELECT k.state, coalesce(g.segment, '') AS segment, s.cohort, CAST((epoch_us(k.ts) - epoch_us(s.start)) // 86400000000 AS BIGINT) AS period, k.client_id, sum(k.cents) AS cents
  FROM k JOIN s ON k.state = s.state AND k.client_id = s.client_id AND k.ts >= s.start LEFT JOIN g ON g.client_id = k.client_id GROUP BY 1, 2, 3, 4, 5
)
SELECT CAST(state AS INTEGER) AS state, segment, cohort, period, count(*) AS users, CAST(sum(crc) AS BIGINT) AS users_crc32,
       count(m.client_id) AS moved, CAST(sum(cents) AS BIGINT) AS cents
FROM u JOIN crc ON i = u.client_id LEFT JOIN m ON m.client_id = u.client_id GROUP BY 1, 2, 3, 4
""",
}
