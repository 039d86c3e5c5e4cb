"""Benchmark phrases in training texts, found in an index of each shard.

1. ``index_shards``: a task joins texts to shards of about ``SHARD_BYTES``, numbers a shard's words and indexes
   their sequence (``fmindex``): one row a shard, with its documents' further columns. Written once, the index serves
   any number of benchmarks.
2. ``phrases``: each run of ``window`` words of a benchmark item, or all its words where it has fewer, with the items that hold it.
3. ``occurrences``: phrases are counted first and sent to the tasks in blocks of at most ``BLOCK_BYTES`` each, one block for a
   usual benchmark. Each shard searches a block's phrases backwards, all at once, locates what it found and merges the spans.
   Several blocks are several passes over the index, whose spans are merged for each document.

The words are the letters A-Z in lower case, a-z, digits and everything above ASCII; all else divides them.

Defined cases: a null or empty text has no words and is not contaminated; an item without words, or with a null id or text, has
no phrase; items that share an id are one item; a null ``doc_id`` and repeated rows are documents like any other; empty
tables give no rows or no hits. A text is never cut: one longer than a shard is a shard of its own (about 150 bytes a
word while it is indexed). Further columns of the documents are carried in the struct ``key``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from .common import Numbers, joined, lean, written
from .fmindex import Index, Stored, build

WINDOW = 10
#: Bytes of text of a shard.
SHARD_BYTES = 6 << 20
#: Bytes of phrases and of their items' ids that are sent to the tasks at once.
BLOCK_BYTES = 32 << 20
#: Rows of the transform that are located at once.
LOCATED = 1 << 18

_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Symbols of the end of a sequence and of the end of a text; words follow.
END, BORDER, FIRST_WORD = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_WORD_BYTES).split()


@lean
def _index(batches: Iterable[pa.RecordBatch], shard_bytes: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId() << 32
    for nth, batch in enumerate(joined(batches, 1, shard_bytes)):
        numbers = Numbers(FIRST_WORD)
        sizes, symbols = [], []
        for text in batch.column(1).to_pylist():
            words = words_of(text)
            sizes.append(len(words))
            symbols.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            symbols.append(np.array([BORDER]))
        index = build(np.concatenate([*symbols, [END]]), len(numbers) + FIRST_WORD)
        blobs = [b" ".join(numbers), index.firsts.tobytes(), index.wavelet.tobytes(), index.marked.tobytes(), index.samples.tobytes()]
        keys = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array([part + nth], pa.int64()), keys, pa.array([sizes], pa.list_(pa.int32())), *(pa.array([b], pa.binary()) for b in blobs)], INDEX_COLUMNS)


INDEX_COLUMNS = ["shard", "keys", "sizes", "words", "firsts", "wavelet", "marked", "samples"]


def index_shards(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each shard: its documents' other columns and word counts, and the index of its words."""
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    blobs = ", ".join(f"{c} binary" for c in INDEX_COLUMNS[3:])
    return rows.mapInArrow(lambda batches: _index(batches, shard_bytes), f"shard long, keys array<{kind}>, sizes array<int>, {blobs}")


@lean
def _phrases(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(i, b" ".join(w[k : k + window])) for i, w in enumerate(map(words_of, batch.column(1).to_pylist())) if w for k in range(max(1, len(w) - window + 1))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([p.decode("utf-8") for _, p in found], pa.string())], ["item", "phrase"])


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, items): the distinct phrases of the items' texts, and the distinct ids of those that hold them."""
    rows = items.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("item is not null")
    kind = rows.schema["item"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _phrases(batches, window), f"item {kind}, phrase string").groupBy("phrase").agg(F.collect_set("item").alias("items"))


class PhraseBlock:
    """Phrases as rows of word numbers, aligned to the right, and the items of each."""

    def __init__(self, rows: list, window: int):
        self.items = [r["items"] for r in rows]
        self.numbers = Numbers()
        self.words = np.full((len(rows), window), -1, np.int64)
        for i, r in enumerate(rows):
            own = [self.numbers[w] for w in r["phrase"].encode("utf-8").split(b" ")]
            self.words[i, window - len(own) :] = own
        self.lengths = (self.words >= 0).sum(axis=1)

    def in_words(self, vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the phrases all of whose words the shard has, and their words by the shard's symbols."""
        local = np.full(len(self.numbers) + 1, -1, np.int64)
        for symbol, word in enumerate(vocabulary, FIRST_WORD):
            if (number := self.numbers.get(word)) is not None:
                local[number] = symbol
        own = local[self.words]  # -1 leads to the last, which stays -1
        whole = np.flatnonzero(((own >= 0) == (self.words >= 0)).all(axis=1))
        return whole, own[whole]


def _occurrences(index: Index, block: PhraseBlock, vocabulary: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase numbers, places) of all occurrences, some at a time."""
    which, own = block.in_words(vocabulary)
    if not len(which):
        return
    low, high = index.search(own)
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    for begin in range(0, int(ends[-1]), LOCATED):
        nth = np.arange(begin, min(begin + LOCATED, int(ends[-1])))
        at = np.searchsorted(ends, nth, side="right")
        yield which[at], index.locate(low[at] + nth - (ends - counts)[at])


def _spans(change: np.ndarray, begin: int, size: int) -> list[dict]:
    hit = np.r_[0, (np.cumsum(change[begin : begin + size]) > 0).astype(np.int8), 0]
    edges = np.flatnonzero(np.diff(hit))
    return [{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)]


@lean
def _search(batches: Iterable[pa.RecordBatch], sent, kind: pa.DataType, first: bool) -> Iterator[pa.RecordBatch]:
    """(shard, nth, key, n_words, spans, items): of all documents in the first pass, of those with hits in later ones."""
    block: PhraseBlock = sent.value
    for batch in batches:
        for i in range(batch.num_rows):
            keys, sizes = batch.column("keys")[i].values, batch.column("sizes")[i].values.to_numpy().astype(np.int64)
            words, firsts, wavelet, marked, samples = (batch.column(c)[i].as_buffer() for c in INDEX_COLUMNS[3:])
            begins = np.cumsum(sizes + 1) - sizes - 1
            total = int(begins[-1] + sizes[-1] + 2)
            bits = np.frombuffer(wavelet, np.uint64)
            stored = Stored(total, np.frombuffer(firsts, np.int32), bits.reshape(-1, total // 64 + 1), np.frombuffer(marked, np.uint64), np.frombuffer(samples, np.int32))
            change = np.zeros(total + 1, np.int32)
            hits: list[np.ndarray] = []
            for which, at in _occurrences(Index(stored), block, words.to_pybytes().split()):
                np.add.at(change, at, 1)
                np.add.at(change, at + block.lengths[which], -1)
                hits.append(np.unique((np.searchsorted(begins, at, side="right") - 1) * len(block.items) + which))
            pairs = np.unique(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
            doc, which = np.divmod(pairs, len(block.items)) if len(pairs) else (pairs, pairs)
            items: dict[int, set] = {}
            for d, w in zip(doc.tolist(), which.tolist(), strict=True):
                items.setdefault(d, set()).update(block.items[w])
            rows = np.arange(len(sizes)) if first else np.array(sorted(items), np.int64)
            spans = [_spans(change, begins[d], sizes[d]) if d in items else [] for d in rows.tolist()]
            span_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
            shard = pa.array(np.full(len(rows), batch.column("shard")[i].as_py()), pa.int64())
            found = pa.array([sorted(items.get(d, ())) for d in rows.tolist()], pa.list_(kind))
            yield pa.RecordBatch.from_arrays([shard, pa.array(rows), keys.take(pa.array(rows)), pa.array(sizes[rows]), pa.array(spans, span_kind), found], ["shard", "nth", "key", "n_words", "spans", "items"])


SPANS = "array<struct<start:bigint,length:bigint>>"


def merged_spans(spans: Column) -> Column:
    """Spans by start, those that meet or overlap as one."""
    last = lambda done: F.element_at(done, -1)
    end = lambda x: x["start"] + x["length"]
    joined_ = lambda done, x: F.struct(last(done)["start"].alias("start"), (F.greatest(end(last(done)), end(x)) - last(done)["start"]).alias("length"))
    apart = lambda done, x: (F.size(done) == 0) | (end(F.try_element_at(done, F.lit(-1))) < x["start"])
    step = lambda done, x: F.when(apart(done, x), F.concat(done, F.array(x))).otherwise(F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined_(done, x))))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), step)


def occurrences(index: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_words, spans, items) of every indexed document.

    ``spans`` are its (start, length) in words that occurrences of phrases cover, merged and in order; ``items`` are
    the ids of the items whose phrases occur, in order. ``index`` is read once for each block of phrases.
    """
    spark = index.sparkSession
    found = written(phrases(benchmark, id_col, text_col, window), "phrases")
    size = found.agg(F.sum(F.octet_length("phrase") + 16 * F.size("items"))).first()[0] or 0
    blocks = max(1, ceil(size / block_bytes))
    kinds = {f.name: f.dataType for f in index.schema}
    item_kind = found.schema["items"].dataType.elementType
    out = f"shard long, nth long, key {kinds['keys'].elementType.simpleString()}, n_words long, spans {SPANS}, items array<{item_kind.simpleString()}>"
    arrow_kind = to_arrow_type(item_kind)
    passes = []
    for k in range(blocks):
        rows = found.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast(PhraseBlock(rows, window))
        passes.append(index.mapInArrow(lambda batches, sent=sent, first=k == 0: _search(batches, sent, arrow_kind, first), out))
    if blocks == 1:
        return passes[0].select("key", "n_words", "spans", "items")
    rows = passes[0]
    for more in passes[1:]:
        rows = rows.unionByName(more)
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]
    one = rows.groupBy("shard", "nth").agg(F.first(F.when(F.col("nth").isNotNull(), F.col("key"))).alias("key"), F.first("n_words").alias("n_words"), *lists)
    return one.select("key", "n_words", merged_spans(F.col("spans")).alias("spans"), F.array_sort(F.array_distinct("items")).alias("items"))


def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(one: str | None, own) -> str | None:
        if one is None or own is None or not len(own):
            return one
        at = [m.span() for m in _WORD.finditer(one)]
        kept, done = [], 0
        for span in own:
            kept.append(one[done : at[span["start"]][0]])
            done = at[span["start"] + span["length"] - 1][1]
        return "".join([*kept, one[done:]])

    return pd.Series([cut(t, s) for t, s in zip(text, spans, strict=True)])


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without its spans: from the first letter of a span's first word to the last of its last word."""
    return pandas_udf(_cut, "string")(text, spans)
