"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Three things are learned, all from a bounded sample of about ``TRAIN_ROWS`` labelled rows:

1. a lexicon: words and word beginnings found far oftener in toxic than in clean texts;
2. boosted trees over the features below, where the features of a training row use a lexicon
   learned without the row's own fold;
3. an isotonic map from the trees' output to a probability, fitted on outputs for all rows, each by trees that
   have seen the other half only.

Features: densities and log counts of lexicon words and of lexicon beginnings, how many of the
hits stand near a word of the second person, shares of capitals and of words in capitals,
density of ``!`` and ``?``, rate of obfuscated words (letters mixed with digits or symbols),
hits among these once they are read plainly, the number of words, and the largest and the summed
evidence of the hits, so that a term seen thrice weighs less than one seen hundreds of times.

Defined cases: null, empty and wordless texts get the score of a text whose counts are all
zero, very long texts are read whole; without labelled rows of both classes every text gets the share of toxic rows (0 if
there are none); rows labelled more than once count as toxic if one label says so; a null id
is never held out, yet never learned from; an empty table gives an empty table; further
columns are carried in ``key``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, written

TRAIN_ROWS = 12_000
FOLDS = 4
#: The lexicon: terms in at least so many toxic texts of the sample, and so many times likelier there.
MIN_TOXIC, MIN_LIFT = 3, 15.0
BEGINNINGS = (4, 5, 6)
NEAR_WORDS = 5
TREES, DEPTH = 20, 3
PIECE_BYTES = 8 << 20
CACHE_WORDS = 300_000

# Words of the second person in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen deinem deiner euch euer ihr tú ti usted ustedes vosotros vuestro tus".split()
)
# Signs that stand for letters in obfuscated words.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

WORD_HIT, BEGINNING_HIT, SECOND, OBFUSCATED, CAPITALS = 1, 2, 4, 8, 16
EVIDENCE_SHIFT = 5


def plain(word: str) -> tuple[str, bool]:
    """The word without outer signs, in lower case and read plainly; whether it was obfuscated."""
    core = word.strip("\"'`.,;:?!()[]{}<>#%&*_-~…«»“”‘’/\\+=^$@|")
    if core.isalpha():
        return core.lower(), False
    letters = sum(map(str.isalpha, core))
    if letters < 2 or "'" in core or "-" in core or "’" in core:
        return core.lower(), False
    return "".join(c for c in core.lower().translate(LOOKALIKES) if c.isalpha()), True


@dataclass(frozen=True)
class Lexicon:
    """Terms with their evidence: the smoothed log ratio of their shares of toxic and of clean texts."""

    words: dict[str, float]
    beginnings: dict[str, float]


class _Flags(dict):
    """What is known of each word, kept while the task runs: flags, and above them its evidence in eighths."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, raw: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        base, obfuscated = plain(raw)
        word = self.lexicon.words.get(base, 0.0)
        begin = max([0.0, *(self.lexicon.beginnings.get(base[:n], 0.0) for n in BEGINNINGS if len(base) >= n)])
        flags = WORD_HIT * (word > 0) | BEGINNING_HIT * (begin > 0) | min(255, round(8 * max(word, begin))) << EVIDENCE_SHIFT
        flags |= SECOND * (base in SECOND_PERSON) | OBFUSCATED * obfuscated | CAPITALS * (len(raw) > 1 and raw.isupper())
        self[raw] = flags
        return flags


def features(text: str | None, flags: _Flags) -> list[float]:
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    found = np.fromiter(map(flags.__getitem__, words), np.uint16, len(words))
    evidence = (found >> EVIDENCE_SHIFT) / 8
    word_hits, beginning_hits = int(np.count_nonzero(found & WORD_HIT)), int(np.count_nonzero(found & BEGINNING_HIT))
    hits = np.flatnonzero(found & (WORD_HIT | BEGINNING_HIT))
    near = 0
    if len(hits):
        second = np.flatnonzero(found & SECOND)
        if len(second):
            right = np.searchsorted(second, hits)
            gap = np.minimum(np.abs(hits - second[np.minimum(right, len(second) - 1)]), np.abs(hits - second[np.maximum(right - 1, 0)]))
            near = int((gap <= NEAR_WORDS).sum())
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    capitals = int(((raw >= 65) & (raw <= 90)).sum())
    letters = max(1, int((((raw | 32) >= 97) & ((raw | 32) <= 122)).sum()))
    marks = int(((raw == 33) | (raw == 63)).sum())
    odd = found & OBFUSCATED > 0
    return [
        word_hits / n, np.log1p(word_hits), beginning_hits / n, np.log1p(beginning_hits), np.log1p(near),
        capitals / letters, np.count_nonzero(found & CAPITALS) / n, marks / max(1, len(raw)),
        np.count_nonzero(odd) / n, np.log1p(np.count_nonzero(odd & (found & (WORD_HIT | BEGINNING_HIT) > 0))), np.log1p(len(words)), float(evidence.max(initial=0.0)), np.log1p(evidence.sum()),
    ]


@lean
def _feature_rows(batches: Iterable[pa.RecordBatch], lexicons: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, text, number of the lexicon)."""
    flags = [_Flags(x) for x in lexicons]
    for batch in pieces(batches, 1, PIECE_BYTES):
        rows = [features(t, flags[k]) for t, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["key", "features"])


def with_features(rows: DataFrame, lexicons: list[Lexicon]) -> DataFrame:
    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "text", "lexicon").mapInArrow(lambda batches: _feature_rows(batches, lexicons), f"key {kind}, features array<double>")


@lean
def _term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, label, fold): in how many texts each word and beginning is found."""
    for batch in pieces(batches, 0, PIECE_BYTES):
        counts: Counter = Counter()
        for text, label, fold in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = {plain(w)[0] for w in set(text.split())}
            terms = {"=" + w for w in words if len(w) > 1} | {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}
            counts.update((term, label, fold) for term in terms)
        keys = list(zip(*counts, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(keys[0]), pa.string()), pa.array(list(keys[1]), pa.int32()), pa.array(list(keys[2]), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["term", "label", "fold", "n"])


def lexicons_of(train: DataFrame) -> list[Lexicon]:
    """A lexicon for each fold, learned without it, and last one of all folds.

    The counts stay in Spark; only terms that can pass come to the driver. They are as few as the sample is bounded: a term has
    to stand in MIN_TOXIC of its toxic texts at least.
    """
    totals = np.zeros((2, FOLDS))
    for label, fold, n in train.groupBy("label", "fold").count().collect():
        totals[label, fold] = n
    counts = train.select("text", "label", "fold").mapInArrow(_term_counts, "term string, label int, fold int, n long")
    cells = [F.sum(F.when((F.col("label") == x) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"n{x}{k}") for x in (0, 1) for k in range(FOLDS)]
    toxic, clean = (sum((F.col(f"n{x}{k}") for k in range(1, FOLDS)), F.col(f"n{x}0")) for x in (1, 0))
    passed = counts.groupBy("term").agg(*cells).filter(toxic >= MIN_TOXIC).filter(toxic / float(totals[1].sum()) >= MIN_LIFT / 3 * (clean + 0.5) / float(totals[0].sum()))
    rows = passed.collect()
    out = []
    for left in [*range(FOLDS), None]:
        use = [k for k in range(FOLDS) if k != left]
        terms, bad, good = {}, max(1.0, totals[1][use].sum()), max(1.0, totals[0][use].sum())
        for r in rows:
            t, c = sum(r[f"n1{k}"] for k in use), sum(r[f"n0{k}"] for k in use)
            if t >= MIN_TOXIC * len(use) / FOLDS and t / bad >= MIN_LIFT * (c + 0.5) / good:
                terms[r["term"]] = float(np.log((t + 0.5) / bad * good / (c + 0.5)))
        out.append(Lexicon({t[1:]: w for t, w in terms.items() if t[0] == "="}, {t: w for t, w in terms.items() if t[0] != "="}))
    return out


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    base_rate: float


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on about ``train_rows`` labelled rows, chosen by a hash of the id.

    The chosen ids are few whatever the input's size, so they are broadcast to the texts.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    total = known.count()
    spread = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 40))
    chosen = known.filter(spread < int((1 << 40) * min(1.0, train_rows / max(1, total))) + 1)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    train = written(texts.join(F.broadcast(chosen), "id").withColumn("fold", F.pmod(F.xxhash64("id", F.lit("fold")), F.lit(FOLDS)).cast("int")).repartition(12), "toxicity-sample")
    share = {r[0]: r[1] for r in train.groupBy("label").count().collect()}
    rate = share.get(1, 0) / max(1, sum(share.values()))
    if len(share) < 2:
        return Model(Lexicon({}, {}), None, None, rate)
    lexicons = lexicons_of(train)
    rows = with_features(train.select(F.struct("label", "fold").alias("key"), "text", F.col("fold").alias("lexicon")), lexicons)
    rows = written(rows.select("key.label", "key.fold", "features").coalesce(2), "toxicity-features").withColumn("features", array_to_vector("features"))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, cacheNodeIds=False)
    halves = [F.col("fold") < FOLDS // 2, F.col("fold") >= FOLDS // 2]
    final = trees.fit(rows)
    if any(rows.filter(half).select("label").distinct().count() < 2 for half in halves):
        return Model(lexicons[-1], final, None, rate)
    outputs = [trees.fit(rows.filter(~half)).transform(rows.filter(half)) for half in halves]
    outputs = outputs[0].unionByName(outputs[1]).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"))
    return Model(lexicons[-1], final, IsotonicRegression(featuresCol="raw", labelCol="label").fit(outputs), rate)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """(key, score) of every row; ``key`` holds all other columns."""
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"), F.lit(0).alias("lexicon"))
    if model.trees is None:
        return rows.select("key", F.lit(model.base_rate).alias("score"))
    found = with_features(rows, [model.lexicon]).withColumn("features", array_to_vector("features"))
    raw = model.trees.transform(found).select("key", vector_to_array("probability")[1].alias("raw"))
    if model.calibration is None:
        return raw.select("key", F.col("raw").alias("score"))
    # A little of the trees' own output keeps texts in order that the steps make equal.
    steps = model.calibration.transform(raw)
    return steps.select("key", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction") * 0.999 + F.col("raw") * 0.001)).alias("score"))
