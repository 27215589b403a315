"""Text equivalence as Column expressions: fold, tokens, phrases, answer scores.

Everything stays in the JVM. Functions take and give Columns; arrays of aliases may be null. An expression that a lambda
holds is evaluated anew for each element, so callers that use a normal form often should put it in a column first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import let

#: A decimal number, or a word with inner hyphens and apostrophes, over letters, numbers and underscore.
TOKEN = r"\p{Nd}+\.\p{Nd}+|[\p{L}\p{N}_]+(?:[-'][\p{L}\p{N}_]+)*"
#: Normal forms of answers that say nothing.
UNKNOWN = ("", "unknown", "n a", "na", "none", "no answer", "i don't know", "i do not know", "i don t know")
#: Lead-ins that a completion may open with.
PREFIXES = ("answer:", "the answer is", "it is", "it's")


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(c: Column) -> Column:
    """Case folding: lower case, with the folds of sharp s, final sigma, long s and micro sign."""
    return F.replace(F.translate(F.lower(text(c)), "ςſµ", "σsμ"), F.lit("ß"), F.lit("ss"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def norm(c: Column) -> Column:
    """Tokens joined by a space; null and empty text give ''."""
    return F.array_join(tokens(c), " ")


def pad(n: Column) -> Column:
    return F.concat(F.lit(" "), n, F.lit(" "))


def holds(n: Column, phrase: Column) -> Column:
    """True if the normal form n holds the non-empty normal form phrase as whole words."""
    return (phrase != "") & pad(n).contains(pad(phrase))


def aliases(*columns: Column) -> Column:
    """One array of the given scalars and arrays, in order, nulls dropped."""
    return F.filter(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns])), lambda a: a.isNotNull())


def flatten_aliases(nested: Column, depth: int = 2) -> Column:
    """Arrays of arrays (of arrays, ...) of strings to one array, nulls dropped at every depth."""
    for _ in range(depth - 1):
        nested = F.flatten(F.filter(nested, lambda a: a.isNotNull()))
    return F.filter(nested, lambda a: a.isNotNull())


def alias_set(canonical: Column, more: Column | None = None) -> Column:
    """The canonical value and its aliases, the first of each normal form, empty ones dropped."""
    return unique_by_norm(aliases(F.array(canonical), more) if more is not None else aliases(F.array(canonical)))


def norms(values: Column) -> Column:
    return F.transform(values, norm)


def unique_by_norm(values: Column) -> Column:
    """Values in order, each normal form once, those with an empty one dropped."""
    paired = F.transform(values, lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    empty = F.array().cast("array<struct<v:string,n:string>>")
    kept = F.aggregate(
        paired,
        empty,
        lambda acc, x: F.when((x["n"] == "") | F.exists(acc, lambda y: y["n"] == x["n"]), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return F.transform(kept, lambda x: x["v"])


def norm_set(canonical: Column, more: Column | None = None) -> Column:
    """Distinct non-empty normal forms of a value and its aliases."""
    values = aliases(F.array(canonical), more) if more is not None else aliases(F.array(canonical))
    return F.array_distinct(F.filter(norms(values), lambda n: n != ""))


def values_equivalent(left: Column, right: Column, left_aliases: Column | None = None, right_aliases: Column | None = None) -> Column:
    """True if a normal form is common; two empty texts have none."""
    return F.coalesce(F.arrays_overlap(norm_set(left, left_aliases), norm_set(right, right_aliases)), F.lit(False))


def exact_match(prediction: Column, gold: Column, more: Column | None = None) -> Column:
    return values_equivalent(prediction, gold, None, more).cast("double")


def contains_norms(n: Column, gold_norms: Column) -> Column:
    """Directed containment on normal forms: the prediction holds one of the golds as whole words."""
    return let(n, lambda m: (m != "") & F.coalesce(F.exists(gold_norms, lambda g: holds(m, g)), F.lit(False)))


def contains_match(prediction: Column, gold: Column, more: Column | None = None) -> Column:
    return contains_norms(norm(prediction), norm_set(gold, more)).cast("double")


def is_unknown(prediction: Column) -> Column:
    return norm(prediction).isin(*UNKNOWN).cast("double")


def bag_overlap(one: Column, two: Column) -> Column:
    """Size of the intersection of two bags of tokens."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(F.array_intersect(one, two), F.lit(0), lambda acc, x: acc + F.least(count(one, x), count(two, x)))


def prf1(pred: Column, gold: Column, exact: Column) -> Column:
    """Struct of precision, recall and f1 from token arrays; exact (boolean) or two empty bags give 1, no overlap 0."""
    shared = bag_overlap(pred, gold).cast("double")
    ones = exact | ((F.size(pred) == 0) & (F.size(gold) == 0))
    one, zero = F.lit(1.0), F.lit(0.0)
    p = F.when(ones, one).when(shared > 0, shared / F.size(pred)).otherwise(zero)
    r = F.when(ones, one).when(shared > 0, shared / F.size(gold)).otherwise(zero)
    f = F.when(ones, one).when(shared > 0, 2 * shared / (F.size(pred) + F.size(gold))).otherwise(zero)
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


def score_prediction(prediction: Column, gold: Column, more: Column | None = None) -> Column:
    """Struct of exact_match, contains_match, unknown, precision, recall and f1."""
    exact = values_equivalent(prediction, gold, None, more)
    bags = prf1(tokens(prediction), tokens(gold), exact)
    contains = F.greatest(exact.cast("double"), contains_match(prediction, gold, more))
    return F.struct(
        exact.cast("double").alias("exact_match"), contains.alias("contains_match"), is_unknown(prediction).alias("unknown"),
        bags["precision"].alias("precision"), bags["recall"].alias("recall"), bags["f1"].alias("f1"),
    )


def judge_norms(n: Column, answer_norms: Column) -> Column:
    """A candidate's normal form mentions an answer, or, from three characters on, an answer mentions it."""
    return let(n, lambda m: F.coalesce(F.exists(answer_norms, lambda a: holds(m, a) | ((F.length(m) >= 3) & holds(a, m))), F.lit(False)))


def judged(n: str | None, answer_norms: tuple[str, ...] | None) -> bool:
    """judge_norms() of one value, for tasks that look at pairs in Python."""
    if n is None or answer_norms is None:
        return False
    found = lambda whole, phrase: phrase != "" and f" {phrase} " in f" {whole} "
    return any(a is not None and (found(n, a) or (len(n) >= 3 and found(a, n))) for a in answer_norms)


def judge_mentions(value: Column, answer: Column, more: Column | None = None) -> Column:
    return judge_norms(norm(value), norm_set(answer, more))


def fact_key(prompt_id: Column, fact_id: Column) -> Column:
    return F.coalesce(prompt_id.cast("string"), fact_id.cast("string"), F.lit(""))


def result_key(prompt_id: Column, fact_id: Column, row_index: Column) -> Column:
    return F.coalesce(prompt_id.cast("string"), fact_id.cast("string"), F.concat(F.lit("row"), row_index.cast("string")))


def safe_filename(key: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(key.cast("string"), "[^A-Za-z0-9._-]", "_"), F.lit("")), F.lit("fact"))


def proposition_group(fact_id: Column, subject: Column, relation: Column, gold: Column, separator: str = "\x1f") -> Column:
    """One key for facts that say the same: the normal triple, or the fact's own id if it has no subject."""
    triple = F.concat_ws(separator, norm(subject), norm(relation), norm(gold))
    return F.when(norm(subject) == "", F.concat(F.lit("fact:"), fact_id.cast("string"))).otherwise(triple)


def alias_correct(prediction: Column, answer_norms: Column) -> Column:
    n = norm(prediction)
    return (n != "") & F.coalesce(F.array_contains(answer_norms, n), F.lit(False))


def clean_completion(completion: Column) -> Column:
    """A completion without fact blocks, tags and lead-ins: its first sentence, bare of marks at its ends."""
    s = F.regexp_replace(text(completion), r"(?s)<FACT>.*?</FACT>", " ")
    s = F.btrim(F.regexp_replace(F.regexp_replace(s, r"</?[A-Z_]+>", " "), r"\s+", " "))
    s = F.btrim(F.regexp_replace(s, "^(?i)(?:" + "|".join(PREFIXES) + ")", ""))
    return F.btrim(F.get(F.split(s, r"(?<=[.!?])\s+", 2), F.lit(0)), F.lit(" \t\n\r\"'`,;:."))


def first_line(completion: Column) -> Column:
    """The first line of a completion, trimmed: the form of readers without fact blocks."""
    return F.trim(F.substring_index(F.trim(text(completion)), "\n", 1))


def acronym(c: Column) -> Column:
    """First characters of the tokens."""
    return F.array_join(F.transform(tokens(c), lambda t: F.substring(t, 1, 1)), "")


def token_subset(one: Column, two: Column) -> Column:
    """True if the tokens of either text are all among the other's and neither is empty."""
    a, b = F.array_distinct(tokens(one)), F.array_distinct(tokens(two))
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def string_tuple(values: Column) -> Column:
    """An array as sorted distinct trimmed strings, empty ones dropped."""
    trimmed = F.transform(values, lambda v: F.trim(v.cast("string")))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda v: v != "")))


#: The frequency bins by their upper ends; beyond the last it is 100+.
BINS = ((0, "0"), (1, "1"), (4, "2-4"), (9, "5-9"), (24, "10-24"), (49, "25-49"), (99, "50-99"))


def frequency_bin(count: Column) -> Column:
    out = F.when(count.isNull(), F.lit(None).cast("string"))
    for top, name in BINS:
        out = out.when(count <= top, name)
    return out.otherwise("100+")


def format_rate(rate: Column) -> Column:
    return F.when(rate.isNull(), "n/a").otherwise(F.format_string("%.1f%%", rate * 100))


def crc_sample(key: Column, rate: float) -> Column:
    """Deterministic sample: crc32 of the key modulo 10000 is below int(rate x 10000), so rates under 1e-4 mean never."""
    return F.crc32(F.encode(key, "utf-8")) % 10_000 < int(rate * 10_000)


def md5_modulo(digest: Column, dim: int) -> Column:
    """The number that 32 hexadecimal digits write, modulo dim (below 2^31); of a power of two the last eight decide."""
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    if dim & (dim - 1) == 0:
        return part(25) % dim
    out = part(1) % dim
    for at in (9, 17, 25):
        out = (out * (1 << 32) + part(at)) % dim
    return out


def answer_features(answer: Column, dim: int = 2048) -> Column:
    """Hashed character trigrams of ##norm##: (feature, weight) structs, L2-normalised, as a sparse vector.

    A trigram's feature is its md5, as a number of 128 bits, modulo dim.
    """
    if not 0 < dim < 1 << 31:
        raise ValueError("dim must be from 1 to 2^31 - 1")

    def weighed(places: Column) -> Column:
        counts = F.transform(F.array_distinct(places), lambda p: F.struct(p.alias("feature"), F.size(F.filter(places, lambda q: q == p)).cast("double").alias("weight")))
        return let(counts, normed)

    def normed(counts: Column) -> Column:
        length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c["weight"] * c["weight"]))
        return let(length, lambda n: F.transform(counts, lambda c: F.struct(c["feature"].alias("feature"), (c["weight"] / n).alias("weight"))))

    def grams(padded: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: md5_modulo(F.md5(F.substr(padded, i, F.lit(3))), dim))

    return let(F.concat(F.lit("##"), norm(answer), F.lit("##")), lambda padded: let(grams(padded), weighed))
