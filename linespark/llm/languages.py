"""Language identification: scripts narrow the candidates, Viterbi labels spans of words.

A model holds, for each learned language, log probabilities of hashed letter 3-grams and
4-grams (word borders included) and the scripts in which it is written. It is learned from a
bounded sample of labelled rows, ``SAMPLE_PER_LANGUAGE`` of each language.

To label a text, its letters are split into words. A word's script range leaves the languages
written in it; each of these gets the word's log probability, cut at ``FLOOR`` below the best.
The most probable sequence of labels is found with a ``SWITCH`` penalty for each change of
language, which gives spans. The text's language is that with most letters; its score is its
share of letters times its probability over its own words.

Defined cases: a null text or one without letters is ``und`` with score 0; if nothing was
learned, every text is; words in a script that no learned language uses favour none; ties go to
the first language by name; a null id is never held out, yet never learned from; an empty table
gives an empty table; further columns are ignored. A text is never cut: a task holds the longest one with a row of
scores for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

UNKNOWN = "und"
SAMPLE_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SWITCH = 12.0
FLOOR = 8.0
#: A language is written in a script that holds this share of its letters.
SCRIPT_SHARE = 0.01
PIECE_BYTES = 1 << 19

# First and last code points of the main Unicode script blocks.
SCRIPT_RANGES = [
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
]
SCRIPTS = ["other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES)]


@lru_cache(maxsize=1)
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and the number of its script."""
    letters = np.array([chr(c).isalpha() for c in range(0x110000)])
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return letters, script


@dataclass(frozen=True)
class Words:
    """Words of several texts: letter runs of one script."""

    text: np.ndarray  # number of the word's text
    begin: np.ndarray  # place in the joined code points
    size: np.ndarray
    script: np.ndarray
    grams3: np.ndarray  # a bucket for each letter, in word order
    grams4: np.ndarray
    first: np.ndarray  # the word's first letter among the letters
    bases: np.ndarray  # where each text begins in the joined code points


def split_words(texts: list[str | None]) -> Words:
    is_letter, script_of = letter_tables()
    # Two spaces part the texts; lower-casing may change a text's length, so it's done for the grams alone.
    codes = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    sizes = np.array([len(c) + 2 for c in codes])
    bases = np.cumsum(sizes) - sizes + 2
    joined = np.zeros(int(sizes.sum()) + 4, np.uint32)
    for base, c in zip(bases, codes, strict=True):
        joined[base : base + len(c)] = c
    letters = is_letter[joined]
    script = script_of[joined]
    at = np.flatnonzero(letters)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none, none, none, none, bases)
    low = np.where(letters, _lower(joined), 0).astype(np.uint32)
    # A letter begins a word if no letter of its script stands before it.
    start = ~letters[at - 1] | (script[at - 1] != script[at])
    first = np.flatnonzero(start)
    begin = at[first]
    a, b, c, d = low[at - 2], low[at - 1], low[at], low[at + 1]
    a = np.where(b == 0, 0, a)
    h3 = b * np.uint32(0x9E3779B1) ^ c * np.uint32(0x85EBCA77) ^ d * np.uint32(0xC2B2AE3D)
    h4 = h3 ^ (a * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1))
    shrink = lambda h: ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)
    text = np.searchsorted(bases, begin, side="right") - 1
    return Words(text, begin, np.diff(np.r_[first, len(at)]), script[begin].astype(np.int64), shrink(h3), shrink(h4), first, bases)


@lru_cache(maxsize=1)
def _lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


def _lower(codes: np.ndarray) -> np.ndarray:
    return _lower_table()[codes]


@dataclass(frozen=True)
class Model:
    names: list[str]
    grams3: np.ndarray  # BUCKETS x languages, log probabilities
    grams4: np.ndarray
    scripts: np.ndarray  # scripts x languages, whether written so


def _learn_group(key: tuple, rows: pa.Table) -> pa.Table:
    counts = np.zeros(2 * BUCKETS + len(SCRIPTS), np.int64)
    for batch in pieces(rows.select(["text"]).to_batches(), 0, PIECE_BYTES):
        words = split_words(batch.column(0).to_pylist())
        counts[:BUCKETS] += np.bincount(words.grams3, minlength=BUCKETS)
        counts[BUCKETS : 2 * BUCKETS] += np.bincount(words.grams4, minlength=BUCKETS)
        counts[2 * BUCKETS :] += np.bincount(words.script, weights=words.size, minlength=len(SCRIPTS)).astype(np.int64)
    return pa.table({"lang": pa.array([key[0].as_py()]), "counts": pa.array([counts.tobytes()], pa.binary())})


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit the model on about ``per_language`` rows of each language, chosen by a hash of the id.

    One row of counts for each language comes back to the driver.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null and id is not null")
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not totals:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    share = F.create_map(*(F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, min(1.0, per_language / n))))
    chosen = rows.filter(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * (1 << 40))
    found = sorted((r[0], np.frombuffer(r[1], np.int64)) for r in chosen.select("lang", "text").groupBy("lang").applyInArrow(_learn_group, "lang string, counts binary").collect())
    counts = np.stack([c for _, c in found], axis=1).astype(np.float64)
    log = lambda x: np.log((x + 0.5) / (x.sum(axis=0) + 0.5 * BUCKETS)).astype(np.float32)
    script = counts[2 * BUCKETS :]
    return Model([name for name, _ in found], log(counts[:BUCKETS]), log(counts[BUCKETS : 2 * BUCKETS]), script / np.maximum(1, script.sum(axis=0)) >= SCRIPT_SHARE)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Words x languages: how far each language falls behind the best, FLOOR at most."""
    letters = model.grams3[words.grams3] + model.grams4[words.grams4]
    scores = np.add.reduceat(letters, words.first, axis=0).astype(np.float64)
    fits = model.scripts[words.script]
    scores = np.where(fits, scores, -np.inf)
    best = scores.max(axis=1, keepdims=True)
    none = ~fits.any(axis=1, keepdims=True)
    return np.where(none, 0.0, np.maximum(scores - np.where(none, 0.0, best), -FLOOR))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word, if each change of label costs ``switch``."""
    total = scores.sum(axis=0)
    single = int(total.argmax())
    # Each run of words labelled otherwise costs one switch at least, even if it is the whole text with labels of its own.
    # So no change pays if no run gains more, not even with the best other label for each word.
    others = np.delete(scores, single, axis=1).max(axis=1, initial=-np.inf) - scores[:, single]
    ahead = np.cumsum(np.maximum(others, -1e9))
    lowest = np.minimum.accumulate(np.r_[0.0, ahead[:-1]])
    if (ahead - lowest).max() <= switch:
        return np.full(len(scores), single)
    value, back = scores[0].copy(), np.zeros(scores.shape, np.int32)
    labels = np.arange(scores.shape[1], dtype=np.int32)
    for t in range(1, len(scores)):
        top = int(value.argmax())
        changed = value[top] - switch
        move = value < changed
        back[t] = np.where(move, top, labels)
        value = np.where(move, changed, value) + scores[t]
    path = np.empty(len(scores), np.int64)
    path[-1] = int(value.argmax())
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


@lean
def _label(batches: Iterable[pa.RecordBatch], model: Model, with_spans: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    for batch in pieces(batches, 1, PIECE_BYTES):
        n = batch.num_rows
        names, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)] if with_spans else [None] * n
        words = split_words(batch.column(1).to_pylist())
        if len(words.text) and model.names:
            scores = word_scores(words, model)
            cuts = np.r_[np.flatnonzero(np.r_[True, words.text[1:] != words.text[:-1]]), len(words.text)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                text, own = int(words.text[lo]), scores[lo:hi]
                path = viterbi(own)
                letters = np.bincount(path, weights=words.size[lo:hi], minlength=len(model.names))
                pick = int(letters.argmax())
                odds = own[path == pick].sum(axis=0)
                names[text] = model.names[pick]
                score[text] = letters[pick] / letters.sum() / np.exp(odds - odds[pick]).sum()
                if with_spans:
                    runs = np.r_[np.flatnonzero(np.r_[True, path[1:] != path[:-1]]), len(path)] + lo
                    ends = words.begin + words.size - words.bases[text]
                    spans[text] = [{"begin": int(words.begin[i] - words.bases[text]), "end": int(ends[j - 1]), "lang": model.names[path[i - lo]]} for i, j in zip(runs[:-1], runs[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(spans, span_type), batch.column(1) if with_text else pa.nulls(n, pa.string())], ["key", "lang_pred", "score", "spans", "text"])


def identify(docs: DataFrame, model: Model, text_col: str = "text", with_spans: bool = True, with_text: bool = False) -> DataFrame:
    """(key, lang_pred, score, spans, text) of every row; ``key`` holds all other columns.

    Spans have the code points [begin, end) from a run's first word to its last. Without
    ``with_spans`` and ``with_text`` those columns are null.
    """
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _label(batches, model, with_spans, with_text), f"key {kind}, lang_pred string, score double, spans array<struct<begin:int,end:int,lang:string>>, text string")


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves the remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
