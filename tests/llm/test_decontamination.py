"""The index against plain search, and benchmark phrases against all places of all texts."""

import random

import numpy as np
from pyspark.sql import functions as F

from linespark.llm import decontamination as d
from linespark.llm.fmindex import Index, build


def test_index_counts_and_locates():
    rng = random.Random(5)
    for _ in range(60):
        kinds, n = rng.randint(1, 9), rng.randint(0, 300)
        sequence = [rng.randint(1, kinds) for _ in range(n)] + [0]
        index = Index(build(np.array(sequence), kinds + 1))
        phrases = [[rng.randint(1, kinds) for _ in range(rng.randint(1, 4))] for _ in range(20)]
        low, high = index.search(np.array([[-1] * (5 - len(p)) + p for p in phrases]))
        for phrase, a, b in zip(phrases, low, high, strict=True):
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == [i for i in range(n) if sequence[i : i + len(phrase)] == phrase]


def plain(texts, items, window):
    words = [d.words_of(t) for t in texts]
    wanted = {}
    for item, text in items:
        own = d.words_of(text)
        if item is not None and own:
            for i in range(max(1, len(own) - window + 1)):
                wanted.setdefault(tuple(own[i : i + window]), set()).add(item)
    rows = []
    for own in words:
        hit, found = set(), set()
        for size in {len(p) for p in wanted}:
            for i in range(len(own) - size + 1):
                if (p := tuple(own[i : i + size])) in wanted:
                    hit |= set(range(i, i + size))
                    found |= wanted[p]
        rows.append((len(own), sorted(hit), sorted(found)))
    return rows


def covered(row):
    return [i for s in row["spans"] for i in range(s["start"], s["start"] + s["length"])]


def test_occurrences_equal_plain_search(spark):
    rng = random.Random(6)
    words = ["Ab", "ba", "éa", "c1", "D", "e", "Éa"]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i % 25, sentence(rng.randint(1, 14))) for i in range(30)] + [(None, sentence(6)), (90, None), (91, " .,-"), (92, "")]
    texts = [sentence(rng.randint(0, 90)) for _ in range(60)] + [None, "", items[0][1], (items[3][1] + " . ") * 400, sentence(20_000)]
    texts += texts[:5]
    docs = spark.createDataFrame([(i if i % 7 else None, i, t) for i, t in enumerate(texts)], "doc_id long, shard long, text string").withColumn("key", F.lit("k")).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("items", F.lit(1))
    expected = plain(texts, items, 5)
    index = d.written(d.index_shards(docs, shard_bytes=900), "shards")
    assert index.count() > 10
    for block_bytes in (d.BLOCK_BYTES, 700):
        got = {r["key"]["shard"]: r for r in d.occurrences(index, bench, window=5, block_bytes=block_bytes).collect()}
        assert len(got) == len(texts)
        for i, (n, hit, found) in enumerate(expected):
            assert (got[i]["n_words"], covered(got[i]), got[i]["items"]) == (n, hit, found)
            spans = got[i]["spans"]
            assert all(a["start"] + a["length"] < b["start"] for a, b in zip(spans, spans[1:], strict=False))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id string, text string")
    rows = d.occurrences(d.written(d.index_shards(docs), "shards"), bench).collect()
    assert sorted((r["key"]["doc_id"], r["n_words"], r["spans"], r["items"]) for r in rows) == [(1, 2, [], []), (2, 0, [], [])]
    assert d.occurrences(d.written(d.index_shards(docs.limit(0)), "shards"), bench).count() == 0


def test_spans_are_cut_from_the_text(spark):
    rows = [("One, two (three) four.", [(1, 2)]), ("a b", []), (None, [(0, 1)]), ("x y z", [(0, 1), (2, 1)])]
    found = spark.createDataFrame(rows, f"text string, spans {d.SPANS}").select(d.cut_spans(F.col("text"), F.col("spans"))).collect()
    assert [r[0] for r in found] == ["One, ) four.", "a b", None, " y "]
