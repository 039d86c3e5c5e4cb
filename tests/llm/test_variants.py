"""Spelling variants against comparing all pairs of words."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linespark.llm import variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words):
    found = {}
    for w, n in words.items():
        others = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        form = others[0] if others and words[others[0]] >= 2 * n else None
        found[w] = [form, None, n, len(others), words[form] if form else None]
    for w, row in found.items():
        end = w
        while found[end][0]:
            end = found[end][0]
        row[1] = end
    return {w: tuple(r) for w, r in found.items()}


def some_words(rng, n):
    words = {}
    while len(words) < n:
        word = "".join(rng.choice("abeité") for _ in range(rng.randint(1, 7)))
        words[word] = rng.randint(1, 40)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            words[word[:i] + rng.choice(["", "e", "z"]) + word[i + rng.randint(0, 1) :]] = rng.randint(1, 40)
    words.pop("", None)
    return words


@pytest.mark.parametrize("cell_words", [3, 40, 10_000])
def test_forms_equal_all_pairs(spark, cell_words):
    words = some_words(random.Random(cell_words), 350)
    words["e" * 3000], words["e" * 2999], words["e" * 1500 + "a" + "e" * 1500] = 3, 9, 20
    table = spark.createDataFrame([*words.items(), *words.items(), (None, 5)], "word string, n long").withColumn("n_near", F.lit("x"))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in variants.group_variants(table, cell_words=cell_words).collect()}
    assert got == plain({w: 2 * n for w, n in words.items()})


def test_words_of_one_vector_are_told_apart():
    rng = random.Random(3)
    words = sorted({"".join(rng.sample("aabbee", 6)) for _ in range(80)} | {"aabbe", "aabbeee"})
    codes, sizes = variants.letters(words)
    begins = np.cumsum(sizes) - sizes
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    close = np.abs(sizes[a] - sizes[b]) <= 1
    got = variants.one_edit(codes, begins, sizes, a[close], b[close])
    assert got.tolist() == [near(words[i], words[j]) for i, j in zip(a[close], b[close], strict=True)]


def test_search_reaches_every_near_cell():
    rng = random.Random(4)
    words = list(some_words(rng, 200))
    vectors = [tuple(v) for v in variants.vectors(words).tolist()]
    upper = frozenset(v[:d] for v in vectors[::2] for d in range(5))
    reached = [variants.cells_of(v, upper) for v in vectors]
    for a, (_, cells) in zip(words, reached, strict=True):
        assert len(cells) == len(set(cells))
        for b, (own, _) in zip(words, reached, strict=True):
            assert not near(a, b) or own in cells


def test_vocabulary_and_words(spark):
    texts = spark.createDataFrame([("ABCde-éÉx Abcde abcde",), ("",), (None,), ("×÷ abcd abcdé Abcdé ABCDé",)], "text string")
    words = texts.select(F.explode(variants.words_of(F.col("text"))).alias("word"))
    assert sorted(r[0] for r in words.collect()) == sorted(["abcde", "éÉx", "abcde", "abcde", "×÷", "abcd", "abcdé", "abcdé", "abcdé"])
    assert {tuple(r) for r in variants.vocabulary(words).collect()} == {("abcde", 3), ("abcdé", 3)}
    assert variants.group_variants(variants.vocabulary(words.limit(0))).count() == 0
