"""Text equivalence on literal strings."""

import math

from pyspark.sql import functions as F

from memaudit.functions import stats
from memaudit.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normal_forms(spark):
    cases = {
        "Spice Girls!": "spice girls", "$69.7 million": "69.7 million", "ß STRASSE": "ss strasse", "O'Brien-Smith's": "o'brien-smith's", "1.5.2": "1.5 2",
        "snake_case": "snake_case", "Jørgensen": "jørgensen", "ΑΣ": "ασ", "": "", "!?": "", None: "",
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, s string")
    got = {r.i: r.n for r in rows.select("i", T.norm(F.col("s")).alias("n")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def score(spark, prediction, gold, aliases=None):
    more = F.array(*map(F.lit, aliases)) if aliases else None
    return one(spark, T.score_prediction(F.lit(prediction), F.lit(gold), more)).asDict()


def test_scores(spark):
    assert score(spark, "Paris.", "paris")["exact_match"] == 1
    assert score(spark, "It is Paris, France", "Paris")["contains_match"] == 1
    assert score(spark, "Blackpool", "Black")["contains_match"] == 0
    assert score(spark, "Shuri", "Shuri Castle")["contains_match"] == 0
    assert score(spark, "the Fab Four", "Beatles", ["fab four"])["contains_match"] == 1
    both_empty = score(spark, "", "!!")
    assert both_empty["exact_match"] == 0 and both_empty["f1"] == 1 and both_empty["unknown"] == 1
    part = score(spark, "the red red house", "red house")
    assert (part["precision"], part["recall"]) == (0.5, 1.0) and math.isclose(part["f1"], 2 / 3)
    for u in ("I don't know", "I don’t know", "N/A", "unknown!", "None", ""):
        assert score(spark, u, "x")["unknown"] == 1


def test_judge_takes_both_directions(spark):
    judge = lambda v, a: one(spark, T.judge_mentions(F.lit(v), F.lit(a)))
    assert judge("The capital is Paris", "Paris") and judge("Shuri", "Shuri Castle")
    assert not judge("of", "Lord of War") and not judge("Lyon", "Paris") and not judge("", "") and not judge("P-aris", "Paris")


def test_alias_helpers(spark):
    assert one(spark, T.alias_set(F.lit("Paris"), F.array(F.lit("PARIS!"), F.lit(""), F.lit("Lutetia"), F.lit(None)))) == ["Paris", "Lutetia"]
    assert not one(spark, T.values_equivalent(F.lit(""), F.lit("")))
    assert one(spark, T.values_equivalent(F.lit("NYC"), F.lit("New York"), None, F.array(F.lit("nyc"))))
    assert one(spark, T.string_tuple(F.array(F.lit(" b"), F.lit("a"), F.lit(""), F.lit("b ")))) == ["a", "b"]
    assert one(spark, T.acronym(F.lit("United Nations Children"))) == "unc"
    assert one(spark, T.token_subset(F.lit("New York City"), F.lit("york new"))) and not one(spark, T.token_subset(F.lit(""), F.lit("a")))


def test_completions_and_keys(spark):
    clean = lambda s: one(spark, T.clean_completion(F.lit(s)))
    assert clean("<FACT>a\nb</FACT> The answer is  Paris. It is big.") == "Paris"
    assert clean("Answer: \"Rome\"") == "Rome" and clean("<ANS>it's 3.5 km!</ANS>") == "3.5 km!" and clean(None) == ""
    assert one(spark, T.fact_key(F.lit(None), F.lit(7))) == "7" and one(spark, T.fact_key(F.lit(None), F.lit(None))) == ""
    assert one(spark, T.safe_filename(F.lit("a/b c"))) == "a_b_c"
    assert one(spark, T.proposition_group(F.lit("f1"), F.lit(""), F.lit("r"), F.lit("g"))) == "fact:f1"
    assert [one(spark, T.frequency_bin(F.lit(n))) for n in (0, 1, 4, 5, 24, 49, 99, 120)] == ["0", "1", "2-4", "5-9", "10-24", "25-49", "50-99", "100+"]


def auc(spark, scores, labels):
    rows = spark.createDataFrame(list(zip(scores, labels)), "s double, y boolean")
    return stats.auroc(rows, "s", "y").first().auroc


def test_statistics(spark):
    assert auc(spark, [0.9, 0.8, 0.2, 0.1], [True, True, False, False]) == 1.0
    assert auc(spark, [0.1, 0.2, 0.8, 0.9], [True, True, False, False]) == 0.0
    assert auc(spark, [0.5] * 4, [True, False, True, False]) == 0.5 and auc(spark, [1.0, 2.0], [True, True]) is None
    rows = spark.createDataFrame([(i, i * i, i > 3) for i in range(8)], "a long, b long, c boolean")
    assert math.isclose(stats.spearman(rows, "a", "b").first().spearman, 1.0)
    assert stats.spearman(rows.withColumn("b", F.lit(1)), "a", "b").first().spearman is None
    assert stats.quartile_edges(rows, "a") == [2, 4, 6] and stats.quartile_edges(rows.limit(0), "a") == []
    fit = stats.logit_per_doubling(spark.createDataFrame([(i, (i * 7) % 5 < (1 + i / 20)) for i in range(80)], "f long, y boolean"), "f", "y")
    assert fit["odds_ratio"] > 1 and fit["low"] < fit["odds_ratio"] < fit["high"]
    assert stats.logit_per_doubling(rows.limit(2), "a", "c")["odds_ratio"] is None


def test_seq_ratio_signal_reads_whole_normal_forms(spark, tmp_path):
    from difflib import SequenceMatcher

    from memaudit.plans import registry

    gold, said = "The  Same " * 8 + "one end, here", "the same " * 8 + "quite another tail of it"
    turns = [(1, 0, "user", gold), (1, 1, "assistant", said), (2, 0, "user", "A b!"), (2, 1, "assistant", "a  B")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {x.conv_id: x for x in registry.QUERIES["seq_ratio_signal"](spark, str(tmp_path)).collect()}
    want = SequenceMatcher(None, "the same " * 8 + "quite another tail of it", "the same " * 8 + "one end here").ratio()
    assert got[1].ratio == round(want, 6) and got[2].ratio == 1.0 and got[2].signal == "similar"
