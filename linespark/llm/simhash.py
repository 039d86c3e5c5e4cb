"""Near duplicates by SimHash fingerprints and anchor points of a covering code.

Fingerprints link if they differ in at most three of 64 bits. Then one of the two 31-bit
halves (bits 0-30 and 31-61) differs in at most one bit. The anchors of a half are the
codewords of the binary Hamming code [31, 26]: a perfect code, so every half has exactly one
anchor within the covering radius 1. The threshold in a half is 1, so each fingerprint goes
to every anchor within radius 1 + 1 = 2 (16 of them, or 1 for a codeword), and two linked
fingerprints meet at least at the nearest anchor of either. Fuzzy joins of this kind are
described by Afrati et al., "Fuzzy Joins Using MapReduce" (ICDE 2012).

Equal fingerprints are collapsed first. There are 2^26 anchors for each half, so a fingerprint
meets few others unless they are near copies; replicas grow in proportion to the input.
Where an anchor holds many fingerprints, they are compared in blocks of bounded size and only
a spanning forest of the links is passed on, never all pairs.

Defined cases: a null, empty or wordless text has fingerprint zero and links like any other;
a null id gets the component of its fingerprint but never names one; rows repeated with one
id count as documents of their own; an empty table gives an empty table. A text is never cut: its shingles are
hashed some at a time, so a task holds the longest text and its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, written
from .components import components

SHINGLE_WORDS = 3
SEED = 42
THRESHOLD = 3
CODE_BITS = 31
HALF_SHIFTS = (0, CODE_BITS)
#: Shingles turned to bits at once, and bytes of text held at once.
CHUNK = 1 << 16
PIECE_BYTES = 8 << 20
#: Rows of one anchor compared at once; a larger group is compared in blocks of this size.
BLOCK_ROWS = 2048
#: Groups of so many rows at most are compared together, step by step.
SMALL_GROUP = 8


# -------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, words_in: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each word shingle of the text, A-Z lower-cased, repeats included."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= words_in:
        shingles: Iterable[bytes] = (b" ".join(words),)
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(words_in)), strict=False))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


@lean
def _fingerprints(batches: Iterable[pa.RecordBatch], words_in: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, PIECE_BYTES):
        prints = np.array([fingerprint(shingle_hashes(t, words_in)) for t in batch.column(1).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "bits"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, bits): the fingerprint of each row as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _fingerprints(batches, words_in), "doc_id long, bits long")


# ------------------------------------------------------------------- anchors


def syndromes(halves: np.ndarray) -> np.ndarray:
    """Hamming syndrome of each 31-bit half: the XOR of the places (from 1) of its set bits."""
    out = np.zeros(len(halves), np.int64)
    for place in range(1, CODE_BITS + 1):
        out ^= np.where((halves >> np.uint64(place - 1)) & np.uint64(1), place, 0)
    return out


def _flips() -> np.ndarray:
    """For each syndrome the 16 masks that lead to the codewords within distance 2.

    Column 0 leads to the nearest codeword. For syndrome 0 the half is a codeword itself and
    all columns are 0.
    """
    masks = np.zeros((CODE_BITS + 1, 1 + CODE_BITS // 2), np.uint64)
    for s in range(1, CODE_BITS + 1):
        pairs = [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, CODE_BITS + 1) if i < i ^ s]
        masks[s] = [1 << (s - 1), *pairs]
    return masks


FLIPS = _flips()


def anchor_rows(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, bits, home) of every anchor within radius 2 in either half; home marks the nearest one."""
    anchors, prints, home = [], [], []
    for half, shift in enumerate(HALF_SHIFTS):
        part = (bits >> np.uint64(shift)) & np.uint64((1 << CODE_BITS) - 1)
        s = syndromes(part)
        at = (part[:, None] ^ FLIPS[s]) | np.uint64(half << CODE_BITS)
        keep = np.ones(at.shape, bool)
        keep[s == 0, 1:] = False
        nearest = np.zeros(at.shape, bool)
        nearest[:, 0] = True
        anchors.append(at[keep])
        prints.append(np.broadcast_to(bits[:, None], at.shape)[keep])
        home.append(nearest[keep])
    return np.concatenate(anchors), np.concatenate(prints), np.concatenate(home)


@lean
def _replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        anchors, prints, home = anchor_rows(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(home)], ["anchor", "bits", "home"])


def spanning_links(bits: np.ndarray, threshold: int = THRESHOLD, block: int = BLOCK_ROWS) -> list[tuple[int, int]]:
    """Index pairs that join all rows linked, directly or not, within the group: a spanning forest.

    Rows already joined are never compared again, so a dense group of near copies costs about one
    pass a row, whatever its number of pairs.
    """
    n, found = len(bits), []
    label = np.arange(n)
    for i in range(0, n, block):
        for j in range(i, n, block):
            other = slice(j, j + block)
            if (label[i : i + block] == label[i]).all() and (label[other] == label[i]).all():
                continue
            for x in range(i, min(i + block, n)):
                apart = np.flatnonzero(label[other] != label[x]) + j
                near = apart[np.bitwise_count(bits[apart] ^ bits[x]) <= threshold]
                if len(near):
                    joined, first = np.unique(label[near], return_index=True)
                    found += [(x, int(y)) for y in near[first]]
                    label[np.isin(label, joined)] = label[x]
    return found


def _links_of(anchors: np.ndarray, bits: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal anchors; the rows are sorted by anchor."""
    starts = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    sizes = np.diff(np.r_[starts, len(anchors)])
    near_home = np.logical_or.reduceat(home, starts)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    # Small groups, the most by far, are compared all together: each row with the next, the one after it, and so on.
    few = (sizes <= SMALL_GROUP) & near_home
    last = np.repeat(np.where(few, starts + sizes, 0), sizes)
    for step in range(1, int(sizes[few].max(initial=1))):
        rows = np.flatnonzero(np.arange(len(bits)) + step < last)
        hit = rows[np.bitwise_count(bits[rows] ^ bits[rows + step]) <= threshold]
        a.append(bits[hit])
        b.append(bits[hit + step])
    large = (sizes > SMALL_GROUP) & near_home
    for s, n in zip(starts[large], sizes[large], strict=True):
        own = bits[s : s + n]
        if found := spanning_links(own, threshold):
            x, y = np.array(found).T
            a.append(own[x])
            b.append(own[y])
    a, b = np.concatenate(a), np.concatenate(b)
    pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


@lean
def _compare(batches: Iterable[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Links from sorted rows; the last anchor of a batch is carried to the next."""
    held = [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)]
    for batch in _then_none(batches):
        if batch is not None:
            new = [batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        cut = len(held[0]) if batch is None else int(np.searchsorted(held[0].view(np.int64), held[0].view(np.int64)[-1]))
        if cut:
            a, b = _links_of(*(x[:cut] for x in held), threshold)
            held = [x[cut:] for x in held]
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _then_none(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints within the threshold of each other."""
    replicas = prints.select("bits").distinct().mapInArrow(_replicate, "anchor long, bits long, home boolean")
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor", "bits")
    return dealt.mapInArrow(lambda batches: _compare(batches, threshold), "a long, b long")


# ----------------------------------------------------------------- documents


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in: int = SHINGLE_WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id reachable."""
    prints = written(fingerprints(docs, id_col, text_col, words_in), "simhash")
    classes = components(links(prints, threshold))
    firsts = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    rows = firsts.join(classes.select(F.col("node").alias("bits"), "component"), "bits", "left")
    rows = rows.withColumn("component", F.coalesce("component", "bits"))
    smallest = rows.groupBy("component").agg(F.min("first").alias("component_id"))
    named = rows.select("bits", "component").join(smallest, "component").select("bits", "component_id")
    return prints.join(named, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
