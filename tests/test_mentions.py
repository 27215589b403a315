"""Mentions by rarest grams against trial of every pair."""

import random

import pytest

from memaudit.operators import joins, mentions


def by_trial(texts, phrases):
    holds = lambda a, b: bool(b) and f" {b} " in f" {a} "
    return {(i, j) for i, a in texts for j, b in phrases if a and (holds(a, b) or (len(a) >= 3 and holds(b, a)))}


def found(spark, texts, phrases):
    t = spark.createDataFrame(texts, "id int, n string")
    p = spark.createDataFrame(phrases, "phrase_id int, m string")
    rows = [(x.id, x.phrase_id) for x in mentions.mention_pairs(t, p).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_small_cases_and_empty_tables(spark):
    texts = list(enumerate(["the capital of france is paris", "paris", "is", "new york city", "x", "", "york", "of france is", "a b c d e", None, "a a a a"]))
    phrases = list(enumerate(["paris", "capital of france", "new york", "the new york city hall", "b c d", "zzz", "france is paris now", "e", "", None, "a a", "paris"]))
    assert found(spark, texts, phrases) == by_trial(texts, phrases)
    assert found(spark, texts, []) == found(spark, [], phrases) == set()


@pytest.mark.parametrize("heavy, rows", [(10_000, 400_000), (5, 400_000), (5, 3)])
def test_hot_words_phrases_and_texts(spark, monkeypatch, heavy, rows):
    """A third of the texts are one word that most phrases hold, and a third of the phrases share a passage; every way of
    the hot join gives what trial gives."""
    monkeypatch.setattr(joins, "HEAVY", heavy)
    monkeypatch.setattr(joins, "BROADCAST_ROWS", rows)
    r = random.Random(3)
    words = ["the", "the", "the", *(f"w{i}" for i in range(25))]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    texts = list(enumerate(["the"] * 50 + [line(r.randint(1, 30)) for _ in range(60)] + [f"{line(9)} one shared passage of words {line(3)}" for _ in range(40)]))
    phrases = list(enumerate([line(r.randint(1, 5)) for _ in range(60)] + ["one shared passage of words"] * 20 + [f"one shared passage of words {line(1)}" for _ in range(10)]))
    want = by_trial(texts, phrases)
    assert len(want) > 2_000 and found(spark, texts, phrases) == want
