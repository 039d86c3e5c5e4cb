"""Runs of words against all periods at all places, suffix order against sorting."""

import random

import numpy as np
from pyspark.sql import functions as F

from linespark.llm import periodic
from linespark.llm.suffixes import SuffixOrder


def plain_runs(words, min_length):
    found = {}
    for period in range(1, len(words) // 2 + 1):
        start = 0
        while start + period < len(words):
            end = start
            while end + period < len(words) and words[end] == words[end + period]:
                end += 1
            if end > start and end - start + period >= max(min_length, 2 * period):
                found.setdefault((start, end - start + period), period)
            start = max(end, start + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng, most=60):
    words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, most))]
    if words and rng.random() < 0.5:
        a, p = rng.randrange(len(words)), rng.randint(1, 8)
        words = [words[a + (i - a) % p] if i >= a and a + (i - a) % p < len(words) else w for i, w in enumerate(words)]
    return words


def test_runs_equal_plain_search():
    rng = random.Random(1)
    for _ in range(400):
        least = rng.choice([2, 3, 5, 8, 12])
        docs = [some_words(rng) for _ in range(rng.randint(1, 4))]
        assert periodic.runs_of([np.array(d, np.int64) for d in docs], least) == [plain_runs(d, least) for d in docs]


def test_suffix_order_equals_sorting():
    rng = random.Random(2)
    for _ in range(200):
        words = some_words(rng)
        for keep in (False, True):
            assert SuffixOrder(np.array(words, np.int64), keep).order.tolist() == sorted(range(len(words)), key=lambda i: words[i:])


def test_one_word_throughout_a_very_long_text():
    assert periodic.runs_of([np.zeros(150_000, np.int64)]) == [[(0, 150_000, 1)]]
    assert periodic.runs_of([np.arange(90_000) % 1000]) == [[(0, 90_000, 1000)]]
    blocks = np.array(([0] * 200 + [1]) * 100)
    assert periodic.runs_of([blocks])[0] == sorted([(0, len(blocks), 201), *((201 * i, 200, 1) for i in range(100))], key=lambda r: (r[0], r[2]))


def test_odd_rows_and_clashing_columns(spark):
    again = "a b c " * 6
    rows = [(1, None, "x"), (2, "", "x"), (3, again, "x"), (3, again, "x"), (None, " \n one\ttwo ", None), (5, "é " * 12, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumn("key", F.lit(1)).withColumn("n_words", F.lit(2))
    found = periodic.find_runs(docs).select("key.*", F.col("runs").alias("found"), F.col("text").alias("kept"), F.col("n_words").alias("n")).collect()
    by_id = {r["doc_id"]: r for r in found}
    assert len(found) == 6 and all(r["key"] == 1 and r["n_words"] == 2 for r in found)
    assert (by_id[1]["n"], by_id[1]["found"], by_id[1]["kept"]) == (0, [], "")
    assert by_id[2]["n"] == 0 and by_id[None]["kept"] == "one two"
    assert [tuple(r) for r in by_id[3]["found"]] == [(0, 18, 3)] and by_id[3]["kept"] == "a b c"
    assert [tuple(r) for r in by_id[5]["found"]] == [(0, 12, 1)] and by_id[5]["kept"] == "é"
    assert periodic.find_runs(docs.limit(0)).count() == 0
