"""Removal of word passages that repeat, by prefix-partitioned suffix groups.

A window is ``window`` consecutive words of one document. A window is a repeat if the same
words also start earlier: in a document with a smaller id, or earlier in the same one. The
only nodes of the corpus's suffix tree that matter are those at depth ``window``: all
suffixes below one such node share a window, and its earliest leaf is the one that is kept.

The tree is never built as a whole. Its suffixes are split into groups by a prefix, and a
group's subtree (its suffixes in sorted order, cut at depth ``window``) is searched on its
own. Two means keep this small:

* Sparse suffixes. Among the ``PREFIX_WORDS``-word prefixes inside a window, the least by
  hash is its anchor. Equal windows have equal anchors at equal places, so windows are grouped
  by their anchor, and neighbouring windows with one anchor form one row (about one row for
  eight windows). This loses no repeat.
* Variable-length prefixes. A prefix whose group would outgrow ``GROUP_BYTES``, or a good part of a
  partition, is lengthened to all ``window`` words, which splits its group by what surrounds it
  (found in a sample; this steers the balance only, never the result). Of equal rows in one
  block of text, only the earliest leaves the task, so a passage that a third of all documents
  share reaches its group once for each block.

A group's rows arrive in the order of their documents and are searched batch by batch; all that
is held of a group are its nodes met so far, with their earliest leaves. So a group of any number
of rows takes the memory of its different windows, which is one for a lengthened prefix.

A suffix in a group is known by a 64-bit hash of its prefix and a 48-bit hash of its window.

Defined cases: a null, empty or short text has no window and loses nothing; a null id counts
as the largest; rows repeated with equal id and text are one document and get equal results;
rows with equal ids and other texts are ordered by a hash of the text; an empty table gives an
empty table; further columns are carried in the struct ``row`` under their own names. A text is never cut: one longer
than ``BLOCK_BYTES`` is a block of its own (about 120 bytes a word).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

WINDOW = 20
PREFIX_WORDS = 6
WINDOW_HASH_BYTES = 6
#: Bytes of text that a task looks at together.
BLOCK_BYTES = 6 << 20
#: Words whose hash a task keeps at hand.
CACHE_WORDS = 400_000
#: Documents sampled for each shuffle partition to find prefixes to lengthen, and how many of them must hold one.
SAMPLE_DOCS, SAMPLE_HITS = 64, 16
#: Bytes of a group above which its prefix is lengthened, and of one of its rows.
GROUP_BYTES, ROW_BYTES = 32 << 20, 112
#: An odd constant, the base of the rolling hash.
BASE = 0x9E3779B97F4A7C15

NULL_ID = (1 << 63) - 1


class WordHashes(dict):
    """Hash of each word, kept while the task runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of rolling hashes."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def rolling(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` word hashes, by doubling; one value for each start that fits."""
    size, part = 1, words
    total, covered = None, 0
    while True:
        if length & size:
            if total is None:
                total = part
            else:
                n = len(words) - covered - size + 1
                total = total[:n] + np.uint64(pow(BASE, covered, 1 << 64)) * part[covered : covered + n]
            covered += size
        if covered == length:
            return total
        n = len(part) - size
        part = part[:n] + np.uint64(pow(BASE, size, 1 << 64)) * part[size : size + n]
        size *= 2


def first_minimum(values: np.ndarray, length: int) -> np.ndarray:
    """For each run of ``length`` values, the place of its first minimum."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < length:
        step = min(size, length - size)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[left] <= values[right], left, right)
        size += step
    return at


class Block:
    """The windows of several texts: word hashes, valid window starts and their anchors."""

    def __init__(self, texts: list[str | None], window: int, hashes: WordHashes):
        # Text by text, so that the words of only one are held at once.
        own = [np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)) for w in ((t or "").encode("utf-8").split() for t in texts)]
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *own])
        self.begins = np.cumsum(self.sizes) - self.sizes
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.maximum(self.sizes - window + 1, 0))
        place = np.arange(len(doc), dtype=np.int64) - np.repeat(np.r_[0, np.cumsum(np.maximum(self.sizes - window + 1, 0))[:-1]], np.maximum(self.sizes - window + 1, 0)) if len(doc) else np.zeros(0, np.int64)
        self.rows = len(doc)
        if not self.rows:
            return
        at = self.begins[doc] + place
        prefix = min(PREFIX_WORDS, window)
        grams = mix(rolling(self.words, prefix))
        anchor = first_minimum(grams, window - prefix + 1)[at]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
        #: Of each run of windows with one anchor: its document, first start, number, and the hash of its prefix.
        self.doc, self.start, self.count = doc[new], place[new], np.diff(np.r_[new, len(doc)])
        self.prefix = grams[anchor[new]]
        self.first = new
        self.windows = mix(rolling(self.words, window)[at])


def _key(doc_id: pa.Array) -> np.ndarray:
    return doc_id.fill_null(NULL_ID).to_numpy(zero_copy_only=False)


@lean
def _suffixes(batches: Iterable[pa.RecordBatch], window: int, long_prefixes: np.ndarray) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in _blocks(batches, 2):
        ids, versions = _key(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
        block = Block(batch.column(2).to_pylist(), window, hashes)
        if not block.rows:
            continue
        doc, start, count, first, key = block.doc, block.start, block.count, block.first, block.prefix
        if len(long_prefixes) and (long := np.isin(key, long_prefixes)).any():
            # A lengthened prefix: each window goes by all of its words.
            runs, single = np.flatnonzero(~long), np.flatnonzero(long)
            each = np.concatenate([first[i] + np.arange(count[i]) for i in single])
            owner = np.repeat(single, count[single])
            doc = np.r_[doc[runs], doc[owner]]
            start = np.r_[start[runs], start[owner] + each - first[owner]]
            key = np.r_[key[runs], mix(block.windows[each] ^ key[owner])]
            first, count = np.r_[first[runs], each], np.r_[count[runs], np.ones(len(each), np.int64)]
        # Equal rows of the block: only the earliest goes on, the others are repeats at once.
        content = mix(block.windows[first] ^ mix(block.windows[first + count - 1] + count.astype(np.uint64)))
        order = np.lexsort((start, versions[doc], ids[doc], content))
        sorted_content = content[order]
        head = np.r_[True, sorted_content[1:] != sorted_content[:-1]]
        leader = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        same = (ids[doc[order]] == ids[doc[leader]]) & (versions[doc[order]] == versions[doc[leader]]) & (start[order] == start[leader])
        keep, again = order[head], order[~head & ~same]
        keep.sort()
        raw = np.ascontiguousarray(block.windows).view(np.uint8).reshape(-1, 8)[:, :WINDOW_HASH_BYTES]
        each = np.repeat(first[keep] - np.r_[0, np.cumsum(count[keep])[:-1]], count[keep]) + np.arange(int(count[keep].sum()))
        ends = np.r_[0, np.cumsum(count[keep] * WINDOW_HASH_BYTES)].astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(keep), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw[each]))])
        yield _suffix_rows(key[keep], ids[doc[keep]], versions[doc[keep]], start[keep], np.zeros(len(keep), np.int32), packed)
        if len(again):
            spread = mix(content[again] + start[again].astype(np.uint64) + ids[doc[again]].view(np.uint64))
            yield _suffix_rows(spread, ids[doc[again]], versions[doc[again]], start[again], ((1 << count[again]) - 1).astype(np.int32), pa.nulls(len(again), pa.binary()))


ROW_KIND = "prefix long, doc_id long, tag long, start int, windows binary"


def _suffix_rows(key, ids, versions, start, mask, packed) -> pa.RecordBatch:
    """``tag`` has the version above, and below it the mask of windows that are repeats already."""
    tag = (versions.astype(np.int64) << 32) | mask
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(tag), pa.array(start.astype(np.int32)), packed], ["prefix", "doc_id", "tag", "start", "windows"])


def _blocks(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches joined or cut to about BLOCK_BYTES of text."""
    held, size = [], 0
    for piece in pieces(batches, column, BLOCK_BYTES // 2):
        held.append(piece)
        size += piece.nbytes
        if size >= BLOCK_BYTES // 2:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and (whole := pa.Table.from_batches(held).combine_chunks().to_batches()):
        yield whole[0]


@lean
def _prefixes(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Distinct prefixes of the anchors of each text."""
    hashes = WordHashes()
    for batch in _blocks(batches, 2):
        block = Block(batch.column(2).to_pylist(), window, hashes)
        if block.rows:
            pair = np.unique(np.stack([block.doc.astype(np.uint64), block.prefix]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[1].view(np.int64))], ["prefix"])


@lean
def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by prefix, document and start, the windows that start earlier too, as a bit mask for each row."""
    nodes = Nodes(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64)))
    for batch in batches:
        if batch.num_rows:
            found, nodes = _repeats_of(batch, nodes)
            yield found


@dataclass(frozen=True)
class Nodes:
    """Nodes at the window's depth, each with its earliest leaf."""

    prefix: np.ndarray
    window: np.ndarray
    doc: np.ndarray
    version: np.ndarray
    at: np.ndarray


def _repeats_of(rows: pa.RecordBatch, nodes: Nodes) -> tuple[pa.RecordBatch, Nodes]:
    """The repeats among the rows and after ``nodes``, which earlier rows have left; the nodes of the last group."""
    prefix, ids, tag, start = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(4))
    versions, out = tag >> 32, (tag & 0xFFFFFFFF).astype(np.int32)
    last = prefix[-1]
    held = len(nodes.prefix)
    live = np.flatnonzero(~np.asarray(rows.column(4).is_null()))
    # Groups of one row have no repeats, unless an earlier batch or the next one has more of theirs.
    group = np.cumsum(np.r_[0, prefix[live][1:] != prefix[live][:-1]]) if len(live) else live
    if len(live):
        open_ = (prefix[live] == last) | (prefix[live] == nodes.prefix[0] if held else False)
        live = live[(np.bincount(group)[group] > 1) | open_]
    row, offset, window = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(live):
        packed = rows.column(4).take(pa.array(live))
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
        raw = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, WINDOW_HASH_BYTES)
        count = np.diff(ends) // WINDOW_HASH_BYTES
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :WINDOW_HASH_BYTES] = raw
        window = wide.view(np.uint64)[:, 0]
        row = np.repeat(live, count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    # The suffixes of each group in sorted order: by prefix, window, then document and place; held nodes have row -1.
    row = np.r_[np.full(held, -1), row]
    of = lambda own, column: np.r_[own, column[row[held:]]]
    all_prefix, doc, version, at = of(nodes.prefix, prefix), of(nodes.doc, ids), of(nodes.version, versions), of(nodes.at, start.astype(np.int64))
    at[held:] += offset
    window = np.r_[nodes.window, window]
    order = np.lexsort((at, version, doc, window, all_prefix))
    row, all_prefix, doc, version, at, window, offset = (x[order] for x in (row, all_prefix, doc, version, at, window, np.r_[np.zeros(held, np.int64), offset]))
    if len(row):
        head = np.r_[True, (window[1:] != window[:-1]) | (all_prefix[1:] != all_prefix[:-1])]
        leader = np.maximum.accumulate(np.where(head, np.arange(len(row)), 0))
        again = ~head & ~((doc == doc[leader]) & (version == version[leader]) & (at == at[leader]))
        np.bitwise_or.at(out, row[again], (1 << offset[again]).astype(np.int32))
        keep = head & (all_prefix == last)
        nodes = Nodes(*(x[keep] for x in (all_prefix, window, doc, version, at)))
    hit = np.flatnonzero(out)
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(versions[hit].astype(np.int32)), pa.array(start[hit]), pa.array(out[hit])], ["doc_id", "version", "start", "mask"]), nodes


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, a hash of the text that tells rows with one id apart, and the text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("version"), text.alias("text"), row.alias("row"))


def long_prefixes(keyed: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Prefixes that so many documents hold that their group would outgrow a shuffle partition.

    The sample has SAMPLE_DOCS documents for each shuffle partition, or more, so that SAMPLE_HITS of them stand
    for GROUP_BYTES; a prefix counts if at least SAMPLE_HITS sampled documents hold it.
    """
    spark = keyed.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = keyed.count()
    sample = keyed.select("doc_id", "version", "text")
    wanted = max(SAMPLE_DOCS * partitions, SAMPLE_HITS * ROW_BYTES / GROUP_BYTES * total)
    if total > wanted:
        sample = sample.sample(wanted / total, seed=1)
    counts = sample.mapInArrow(lambda batches: _prefixes(batches, window), "prefix long").groupBy("prefix").count()
    return np.array([r[0] for r in counts.filter(F.col("count") >= SAMPLE_HITS).select("prefix").collect()], np.int64).view(np.uint64)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, version, start, mask): bit i of mask is set if the window at word start + i is a repeat."""
    if not PREFIX_WORDS <= window <= 30 + PREFIX_WORDS:
        raise ValueError(f"window must have {PREFIX_WORDS} to {30 + PREFIX_WORDS} words")
    keyed = _keyed(docs, id_col, text_col).select("doc_id", "version", "text")
    long = long_prefixes(keyed, window)
    rows = keyed.mapInArrow(lambda batches: _suffixes(batches, window, long), ROW_KIND)
    dealt = rows.repartition("prefix").sortWithinPartitions("prefix", "doc_id", "tag", "start")
    return dealt.mapInArrow(_repeats, "doc_id long, version int, start int, mask int")


@lean
def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in pieces(batches, 2, BLOCK_BYTES):
        packed = pa.array([packer.compress(t.encode("utf-8")) for t in batch.column(2).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0).fill_null(NULL_ID), batch.column(1), packed, batch.column(3)], ["doc_id", "version", "packed", "row"])


def covered(n_words: int, starts: np.ndarray, masks: np.ndarray, window: int) -> np.ndarray:
    """Which words the marked windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    for i in range(31):
        at = starts[(masks >> i) & 1 == 1] + i
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


@lean
def _remove(batches: Iterable[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in pieces(batches, 0, BLOCK_BYTES // 4):
        texts, totals, removed, digests = [], [], [], []
        for packed, marks in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = unpack.decompress(packed)
            words = kept = raw.split()
            if marks.is_valid:
                gone = covered(len(words), marks.values.field(0).to_numpy().astype(np.int64), marks.values.field(1).to_numpy().astype(np.int64), window)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            totals.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(joined).hexdigest())
            texts.append((raw if len(kept) == len(words) else joined).decode("utf-8") if with_text else None)
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], ["row", "text", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(row, text, n_words, n_removed, kept_sha256) of every row of ``docs``.

    ``row`` holds all other columns. ``text`` is the text itself if nothing was removed, else the
    kept words joined by one space; ``kept_sha256`` is always of the kept words joined so.
    Texts travel compressed to meet the marks of their document.
    """
    keyed = _keyed(docs, id_col, text_col)
    kind = keyed.schema["row"].dataType.simpleString()
    packed = keyed.mapInArrow(_pack, f"doc_id long, version int, packed binary, row {kind}")
    marks = repeats(docs, id_col, text_col, window).groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    met = packed.join(marks, ["doc_id", "version"], "left").select("packed", "marks", "row")
    return met.mapInArrow(lambda batches: _remove(batches, window, with_text), f"row {kind}, text string, n_words long, n_removed long, kept_sha256 string")
