"""Near duplicates whose five-word shingles overlap by 0.8 or more (Jaccard of the distinct shingles).

1. Texts with equal shingle sets are one node, named by a hash of the set.
2. Candidates: SimHash fingerprints of the sets that differ in few bits, found by the anchor points of
   ``simhash``; and, as those catch only the closest texts, ``BANDS`` keys of ``BAND_ROWS`` least hashes
   each. Two sets at the threshold share no key with a chance of 5e-6, at higher overlaps with a
   smaller one. Nodes that are linked by a fingerprint or share a key, directly or not, are a
   candidate group; only links to a key's first node are passed on.
3. Check: the shingle sets of a group meet in one task, those of a group of over ``BLOCK_NODES`` nodes or ``BLOCK_SHINGLES``
   shingles in pairs of blocks, so that each pair of nodes meets. A large group may be a long chain of keys with little in common.
   If that copies fewer sets, it is taken apart again: then the nodes of each key (keys with the same nodes count
   once) and of each link between fingerprints are groups, so a chain costs what its keys do. The exact overlap of each pair not
   yet joined is counted; links of ``THRESHOLD`` or more make the classes.

Defined cases: as in ``simhash``; texts without words have one node. A text is found again by its id and a hash of it, so rows that
share an id, or have none, are looked up once each. A text is never cut: a task holds one of any length, and its set (8 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, written
from .components import components
from .simhash import fingerprint, links, shingle_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 40, 6
#: Shingles hashed at once, and bytes of text held at once.
CHUNK = 1 << 11
PIECE_BYTES = 4 << 20
BLOCK_NODES = 512
BLOCK_SHINGLES = 4 << 20

_RANDOM = np.random.default_rng(42)
_FACTORS = _RANDOM.integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RANDOM.integers(0, 1 << 63, (1, BAND_ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of the text, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE_WORDS))


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes())


def band_keys(own: np.ndarray) -> np.ndarray:
    """The candidate keys of a shingle set."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), CHUNK):
        least = np.minimum(least, (_FACTORS * own[i : i + CHUNK]).min(axis=1))
    return (least.reshape(BANDS, BAND_ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.uint64), *rows]).view(np.int64))


@lean
def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, 1, PIECE_BYTES):
        sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
        nodes = np.array([node_of(s) for s in sets], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(nodes.view(np.int64)), pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64)), _lists([band_keys(s) for s in sets]), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "version", "node", "bits", "bands", "size"])


@lean
def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles) of (text)."""
    for batch in pieces(batches, 0, PIECE_BYTES):
        sets = [shingle_set(t) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(s) for s in sets], np.uint64).view(np.int64)), _lists(sets)], ["node", "shingles"])


def spanning_links(sets: list[np.ndarray], side: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Index pairs of overlap ``threshold`` or more that join all rows linked, directly or not.

    With two sides only pairs across them are looked at, and only rows of the other side count as joined.
    """
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2 or not sizes.all():
        return []
    vocabulary, columns = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    marked = np.zeros(len(vocabulary), np.int64)
    across = len(set(side.tolist())) > 1
    label, found = np.arange(len(sets)), []
    for x in np.flatnonzero(side == side.min()) if across else range(len(sets)):
        open_ = (label != label[x]) & (np.minimum(sizes, sizes[x]) >= threshold * np.maximum(sizes, sizes[x]))
        open_ &= side != side[x] if across else np.arange(len(sets)) > x
        rows = np.flatnonzero(open_)
        if not len(rows):
            continue
        own = columns[starts[x] : starts[x] + sizes[x]]
        marked[own] = 1
        at = np.concatenate([columns[starts[r] : starts[r] + sizes[r]] for r in rows])
        common = np.add.reduceat(marked[at], np.cumsum(sizes[rows]) - sizes[rows])
        marked[own] = 0
        for y in rows[common >= threshold * (sizes[rows] + sizes[x] - common)]:
            if label[y] != label[x]:
                found.append((int(x), int(y)))
                label[label == label[y]] = label[x]
    return found


def _check(rows: pa.Table) -> pa.Table:
    nodes = rows["node"].to_numpy()
    sets = [np.array(s, np.int64) for s in rows["shingles"].to_numpy()]
    pairs = spanning_links(sets, rows["side"].to_numpy())
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    return pa.table({"a": nodes[a], "b": nodes[b]})


def checked_links(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links that connect the nodes of each group; ``sets`` holds (node, shingles), ``members`` (node, grp, size)."""
    n, total = F.count("*"), F.sum("size")
    blocks = F.greatest(F.ceil(n / BLOCK_NODES), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")
    sized = members.join(members.groupBy("grp").agg(n.alias("n"), blocks.alias("blocks")).filter("n > 1"), "grp")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")
    placed = sized.withColumn("own", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.col("own").alias("side"))
    rows = sets.join(placed, "node").select("node", "shingles", "grp", "low", "high", "side")
    return rows.groupBy("grp", "low", "high").applyInArrow(_check, "a long, b long")


def _copies(n: Column) -> Column:
    """How many sets a group of n nodes takes in pairs of blocks."""
    return n * F.ceil(n / BLOCK_NODES)


def taken_apart(wide: DataFrame, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, grp) of nodes in large groups: the group itself, or its keys' and pairs' nodes if that copies fewer sets.

    ``wide`` has (node, component), ``keys`` (node, band), ``pairs`` (a, b) of fingerprints' nodes.
    """
    own = written(keys.join(wide, "node"), "shingle-wide")
    alike = own.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.min("component").alias("component")).filter("n > 1")
    named = alike.groupBy("n", "all").agg(F.min("band").alias("band"), F.min("component").alias("component"))
    linked = pairs.filter("a <> b").join(wide.withColumnRenamed("node", "a"), "a")
    costs = named.select("component", _copies(F.col("n")).alias("apart")).unionByName(linked.select("component", F.lit(2).cast("long").alias("apart")))
    whole = wide.groupBy("component").agg(_copies(F.count("*")).alias("whole"))
    cheaper = costs.groupBy("component").agg(F.sum("apart").alias("apart")).join(whole, "component").filter("apart < whole").select("component")
    kept = wide.join(cheaper, "component", "left_anti").select("node", F.col("component").alias("grp"))
    of_keys = own.join(named.join(cheaper, "component", "left_semi").select("band"), "band").select("node", F.xxhash64("band", F.lit("key")).alias("grp"))
    of_pairs = linked.join(cheaper, "component", "left_semi").select(F.explode(F.array("a", "b")).alias("node"), F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("grp"))
    return kept.unionByName(of_keys).unionByName(of_pairs).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, version, component_id, component) of every row.

    ``component_id`` is the smallest id reachable, ``component`` names the class itself, and ``version`` is
    Spark's hash of the text, which tells rows of one id apart.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = written(rows.withColumn("version", F.xxhash64("text")).mapInArrow(_sketch, "doc_id long, version long, node long, bits long, bands array<long>, size long"), "shingles")
    keys = sketch.select("node", F.explode("bands").alias("band")).distinct()
    # Each key's nodes are linked to its first one.
    first = keys.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    near = keys.join(first, "band").select("a", F.col("node").alias("b")).distinct()
    # Fingerprints are linked by anchor points; each fingerprint's nodes are linked to its first one.
    prints = sketch.select("bits", "node").distinct()
    firsts = prints.groupBy("bits").agg(F.min("node").alias("a"))
    alike = prints.join(firsts, "bits").select("a", F.col("node").alias("b")).filter("a <> b")
    linked = links(prints).select(F.col("a").alias("bits"), F.col("b").alias("other")).join(firsts, "bits")
    linked = linked.select("a", F.col("other").alias("bits")).join(firsts.withColumnRenamed("a", "b"), "bits").select("a", "b")
    pairs = written(alike.unionByName(linked), "shingle-pairs")
    groups = written(components(near.unionByName(pairs)), "shingle-groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    sized = groups.join(sizes, "component")
    apart = taken_apart(sized.filter(F.col("n") > BLOCK_NODES).select("node", "component"), keys, pairs)
    grouped = sized.filter(F.col("n") <= BLOCK_NODES).select("node", F.col("component").alias("grp")).unionByName(apart)
    # Of each node one text, found by its id and version.
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("one")
    known = sketch.groupBy("node").agg(F.min("doc_id").alias("id"), one, F.max("size").alias("size"))
    members = written(grouped.join(known.select("node", "size"), "node"), "shingle-members")
    wanted = known.join(members.select("node").distinct(), "node", "left_semi").select(F.col("one.doc_id").alias("own_id"), F.col("one.version").alias("own_version"))
    texts = rows.withColumn("version", F.xxhash64("text")).join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("version") == F.col("own_version")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"])
    classes = components(checked_links(sets, members))
    named = known.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "component").select("node", "component_id", "component")
    return sketch.select("doc_id", "version", "node").join(named, "node").select("doc_id", "version", "component_id", "component")
