"""Mentions between many texts and many phrases: each phrase is looked up by the rarest of its word grams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memaudit.functions.text import holds
from memaudit.functions.vectors import let

from .joins import hot_join, small
from .scratch import stored

#: Words of the longest gram; longer phrases have several.
GRAM = 3


def _grams(words: Column, k: int) -> Column:
    """Distinct hashes of the runs of k words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    runs = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, F.array_distinct(runs)).otherwise(F.array().cast("array<bigint>"))


def held(holders: DataFrame, needles: DataFrame) -> DataFrame:
    """(holder, needle, n, m) for all needles that a holder has as whole words; holders: holder, n. needles: needle, m.

    n and m are normal forms; empty ones and null ids take no part, ids must be unique. A needle of up to GRAM words is
    one gram, a longer one has several, of which the one in the fewest holders is looked up; one that is nowhere ends
    the search for that needle. So a needle meets as many holders as its rarest gram has, each of which is then checked
    by its text. Shuffled are hashes and ids of the grams that needles have, and the candidates.
    """
    words = F.split("m", " ")
    sizes = needles.where("m <> ''").agg(F.collect_set(F.least(F.size(words), F.lit(GRAM)))).first()[0]
    if not sizes:
        return holders.join(needles, F.lit(False)).select("holder", "needle", "n", "m")
    own_grams = let(words, lambda w: reduce(lambda rest, k: F.when(F.size(w) >= k, _grams(w, k)).otherwise(rest), range(2, GRAM + 1), _grams(w, 1)))
    own = stored(needles.where("m <> '' AND needle IS NOT NULL").select("needle", F.explode(own_grams).alias("h")), "needle-grams")
    sought = stored(own.groupBy("h").agg(F.count("*").alias("needles")), "grams")
    grams = let(F.split("n", " "), lambda w: F.concat(*[_grams(w, k) for k in sorted(sizes)]))
    there = holders.where("n <> '' AND holder IS NOT NULL").select("holder", F.explode(grams).alias("h"))
    only = sought.select("h")
    there = stored(there.join(F.broadcast(only) if small(only) else only, "h", "left_semi"), "holder-grams")
    known = sought.join(there.groupBy("h").agg(F.count("*").alias("holders")), "h", "left").fillna(0, ["holders"])
    known = stored(known, "gram-counts")
    placed = hot_join(own, known.withColumn("one", F.lit(1)), "h", ("needles", "one"), ("needle", "h"))
    best = placed.groupBy("needle").agg(F.min(F.struct("holders", "h", "needles")).alias("k")).where("k.holders > 0").select("needle", "k.*")
    best = stored(best.join(needles, "needle"), "rarest-grams")
    pairs = hot_join(there, best, "h", ("holders", "needles"), ("holder", "needle"), "m")
    return pairs.select("holder", "needle", "m").join(holders, "holder").where(holds(F.col("n"), F.col("m"))).select("holder", "needle", "n", "m")


def mention_pairs(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase_id) where a text mentions a phrase, or, from three characters on, the phrase holds the text.

    texts: id, n. phrases: phrase_id, m; n and m are normal forms. Only texts of no more words than the longest phrase
    are looked for in phrases. Pairs are unique; whatever is empty or has no id takes no part.
    """
    texts, phrases = stored(texts.where("n <> ''"), "mention-texts"), stored(phrases.where("m <> ''"), "mention-phrases")
    ahead = held(texts.withColumnRenamed("id", "holder"), phrases.withColumnRenamed("phrase_id", "needle"))
    longest = phrases.agg(F.coalesce(F.max(F.size(F.split("m", " "))), F.lit(0))).first()[0]
    short = texts.where((F.length("n") >= 3) & (F.size(F.split("n", " ")) <= longest))
    back = held(phrases.select(F.col("phrase_id").alias("holder"), F.col("m").alias("n")), short.select(F.col("id").alias("needle"), F.col("n").alias("m")))
    back = back.where("n <> m")  # equal ones were found ahead
    return ahead.select(F.col("holder").alias("id"), F.col("needle").alias("phrase_id")).unionByName(back.select(F.col("needle").alias("id"), F.col("holder").alias("phrase_id")))
