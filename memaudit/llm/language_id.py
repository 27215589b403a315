"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, everything that is no letter becomes a single space, and its n-grams of one to three characters
are hashed into a fixed number of buckets. Training sums the bucket counts of each language where the texts are: a task
sends one row per language and bucket that it met, however many texts it read. The matrix of log probabilities (languages
x buckets, at most MAX_LANGUAGES rows) is broadcast; a batch of texts is scored as one sparse product in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import batches, free_name, small_batches

BITS = 16
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Added to each bucket's count.
SMOOTHING = 0.5
#: Languages up to which the matrix is broadcast (8 bytes x BUCKETS each: 128 MB at the most); more are an error.
MAX_LANGUAGES = 256
#: A text is cut into pieces of so many characters while its n-grams are counted; the pieces overlap, so none is lost.
PIECE = 1 << 18
UNKNOWN = "und"

_LETTER: np.ndarray | None = None
#: Odd multipliers of the hash.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _letters() -> np.ndarray:
    """True at each code point that is a letter (Unicode category L); built once in each worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of one text, piece by piece."""
    letter, tail, order = _letters(), np.array([32], np.uint32), max(ORDERS)
    for at in range(0, len(text), PIECE):
        points = np.frombuffer(text[at : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = [np.array([32], np.uint32)] if at + PIECE >= len(text) else []
        points = np.concatenate([tail, np.where(letter[points], points, np.uint32(32)), *ends])
        points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
        old = len(tail) if at else 0  # n-grams that end in the piece before were counted there
        h = np.zeros(len(points), np.uint64)
        for n in ORDERS:
            h = (h if n == 1 else h[:-1]) * _STEP + points[n - 1 :].astype(np.uint64) + np.uint64(n)
            fresh = h[max(old - n + 1, 0) :]
            yield ((fresh ^ (fresh >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
        tail = points[-(order - 1) :]


def buckets(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's n-grams, ascending, and how often each occurs; empty if it has no letter."""
    parts = list(_hashes(text)) if text and any(map(str.isalpha, text)) else []
    if sum(map(len, parts)) < BUCKETS:
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    counts = sum(np.bincount(p, minlength=BUCKETS) for p in parts)
    at = np.flatnonzero(counts)
    return at, counts[at]


def held_out(id_col: str = "doc_id", folds: int = 5):
    """True where crc32 of the id as text is divisible by folds: these rows are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


@dataclass
class NaiveBayes:
    """Languages in ascending order, log prior of each, and log probability of each bucket by language (buckets x languages)."""

    languages: list[str]
    prior: np.ndarray
    weight: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability for each text: UNKNOWN and 0 without a letter, or without a model."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        rows = [(i, *b) for i, b in enumerate(map(buckets, texts)) if len(b[0])]
        if not rows:
            return names, scores
        at, count = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
        starts = np.cumsum([0, *(len(r[1]) for r in rows[:-1])])
        log = np.add.reduceat(self.weight[at] * count[:, None], starts, axis=0) + self.prior
        odds = np.exp(log - log.max(1, keepdims=True))
        best = log.argmax(1)
        for (i, *_), k in zip(rows, best):
            names[i] = self.languages[k]
        scores[[r[0] for r in rows]] = 1 / odds.sum(1)
        return names, scores


def _counted(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, bucket, n: each task's counts; bucket -1 counts texts."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(counts[at])], schema=schema)

        held: dict[str, np.ndarray] = {}
        for batch in stream:
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = buckets(text)
                if len(at):
                    if lang not in held and len(held) == MAX_LANGUAGES:
                        yield from flush(held)
                        held = {}
                    counts = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    counts[at + 1] += n
                    counts[0] += 1
        yield from flush(held)

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    return small_batches(known).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, "lang string, bucket int, n long")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> NaiveBayes:
    """The model of all rows of docs with a text that has a letter and a language; no sample is drawn.

    What reaches the driver is one sum per language and bucket: at most MAX_LANGUAGES x BUCKETS numbers.
    """
    sums = _counted(docs, text_col, lang_col).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # one row a language, of BUCKETS + 1 pairs at most
    found = per.select("lang", F.col("counts.bucket").alias("bucket"), F.col("counts.n").alias("n")).limit(MAX_LANGUAGES + 1).toArrow().sort_by("lang")
    if found.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: raise MAX_LANGUAGES if executors have room for the matrix")
    languages, counts = found["lang"].to_pylist(), np.zeros((found.num_rows, BUCKETS + 1))
    for k in range(found.num_rows):
        counts[k, np.array(found["bucket"][k].values) + 1] = np.array(found["n"][k].values)
    texts, grams = counts[:, 0], counts[:, 1:] + SMOOTHING
    weight = np.log(grams) - np.log(grams.sum(1, keepdims=True))
    return NaiveBayes(languages, np.log(texts) - np.log(max(texts.sum(), 1)), np.ascontiguousarray(weight.T))


def identify(docs: DataFrame, model: NaiveBayes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, lang_pred, score: one row per row of docs; the model is broadcast."""
    kind, shared = docs.schema[id_col].dataType, docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([(id_col, to_arrow_type(kind)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in stream:
            texts = b.column(2).to_pylist()
            for names, scores, at in ((*shared.value.predict(texts[i : i + 256]), i) for i in range(0, len(texts), 256)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), b.column(1).slice(at, 256), pa.array(names, pa.string()), pa.array(scores)], schema=schema)

    flag = free_name(docs, "held_out")
    rows = small_batches(docs).select(F.col(id_col), held_out(id_col).alias(flag), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{id_col} {kind.simpleString()}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score for every row of docs, by a model of the rows that aren't held out.

    A prediction's only input is the whole text. lang_pred is a learnt language, ties going to the lesser name; a text
    that is null, empty or without a letter is `und` with score 0, and so is every text if nothing could be learnt. Null
    ids are predicted and learnt from; null languages are never learnt; repeated rows are predicted (and learnt) each;
    other columns aren't read, whatever they are called; an empty table gives no rows.
    """
    return identify(docs, fit(docs.where(~held_out(id_col)), text_col, lang_col), id_col, text_col)
