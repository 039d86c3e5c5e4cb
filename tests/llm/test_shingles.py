"""The pipeline's near duplicates against brute-force overlap of five-word shingles."""

import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from linespark.llm import shingles


def brute_force(rows):
    sets = [set(shingles.shingle_set(text).tolist()) for _, text in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if label[i] != label[j] and both >= 0.8 * len(sets[i] | sets[j]):
            label = [label[i] if x == label[j] else x for x in label]
    return {min(r[0] for r, x in zip(rows, label, strict=True) if x == y) for y in set(label)}


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(shingles, "BLOCK_NODES", block)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(25):
        base = rng.choices(words, k=rng.choice((30, 120, 400)))
        for changed in (0, 0, 1, 1, 2, 3, 5, 8):
            copy = list(base)
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    expected = brute_force(rows)
    assert len(expected) < len(rows) - 60 and kept == expected


def test_candidate_keys_miss_no_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    for _ in range(300):
        own = rng.integers(0, 1 << 63, 110, np.uint64)
        a, b = np.unique(own[:100]), np.unique(np.r_[own[:90], own[100:110]])
        assert (shingles.band_keys(a) == shingles.band_keys(b)).any()


def test_odd_rows(spark):
    rows = [(None, "one two"), (7, "One  two"), (9, None), (8, ""), (None, "x"), (7, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id or -1, r.component_id or -1) for r in shingles.near_duplicates(df).collect())
    assert out == [(-1, -1), (-1, 7), (7, 7), (7, 7), (8, 8), (9, 8)]
    assert shingles.near_duplicates(df.limit(0)).count() == 0


def test_a_text_without_an_id_is_looked_up_once(spark, monkeypatch):
    """Rows that share an id, or have none, don't multiply with the nodes of that id."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(200)] = f"x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([(None if i % 2 else 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    read = spark.sparkContext.accumulator(0)
    inner = shingles._sets

    def counted(batches):
        for batch in inner(batches):
            read.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(shingles, "_sets", counted)
    out = shingles.near_duplicates(docs).collect()
    assert len(out) == 60 and {r.component for r in out} == {out[0].component} and {r.component_id for r in out} == {4}
    assert read.value == 60


def test_chains_of_keys_are_linear(spark, monkeypatch):
    """Nodes chained by keys: each meets those that share a key, and keys with equal nodes count once."""
    monkeypatch.setattr(shingles, "BLOCK_NODES", 16)
    n = 3000
    keys = spark.range(n).selectExpr("id node", "explode(array(id, id + 1, id + 100000, id + 100001)) band").selectExpr("node", "band")
    pairs = spark.range(n - 1).selectExpr("id a", "id + 1 b").filter("a % 10 = 0")
    wide = spark.range(n).selectExpr("id node", "cast(0 as long) component")
    apart = shingles.taken_apart(wide, keys, pairs)
    assert apart.count() == 2 * (n - 1) + 2 * pairs.count()
    assert apart.groupBy("grp").count().agg({"count": "max"}).first()[0] == 2
    # Nodes that share many keys are cheaper as one group.
    tight = spark.range(n).selectExpr("id node", "explode(sequence(0, 39)) band").filter("(node * 31 + band) % 7 <> 0").selectExpr("node", "cast(band as long) band")
    assert shingles.taken_apart(wide, tight, pairs).groupBy("grp").count().collect()[0]["count"] == n


def test_sets_of_many_shingles_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK_SHINGLES", 300)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words * 40)
    rows = [(1, " ".join(words)), (2, " ".join(words[:398])), (3, " ".join(words[4:])), (4, long), (5, long + " end"), (6, "other " * 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
