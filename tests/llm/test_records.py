"""WARC archives, SimHash classes, repeated passages and exact neighbours against brute force, with odd rows."""

import hashlib
import io
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linespark.llm import components, neighbours, simhash, substrings, warc

WORDS = [f"w{i}" for i in range(60)]


# ---------------------------------------------------------------------- WARC


def round_trip(spark, rows, path, archive_bytes=1 << 20):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, payload int").drop("payload")
    warc.write_archives(warc.with_revisits(df), path, archive_bytes)
    return warc.read_archives(spark, path).collect()


def test_archives_round_trip(spark, tmp_path):
    long, other = "é" * 600, "x" * 999
    rows = [(1, "http://a/ b", long, "d", 0), (5, None, long, "d", 0), (3, "u", long, "d", 0), (2, "u", other, None, 0), (4, "u", other, None, 0), (6, "u", None, None, 0), (7, "u", "", None, 0), (None, "u", long, None, 0), (5, None, long, "d", 0), (8, "u", "<p>\r\n\r\n\n" * 300, None, 0)]
    out = round_trip(spark, rows, str(tmp_path / "w"), 2000)
    assert len(out) == len(rows) and all(r.digest_ok for r in out)
    found = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes) for r in out)
    assert found == [(-1, "response", None, 1200), (1, "revisit", 5, 1200), (2, "response", None, 999), (3, "revisit", 5, 1200), (4, "response", None, 999), (5, "response", None, 1200), (5, "response", None, 1200), (6, "response", None, 0), (7, "response", None, 0), (8, "response", None, 2400)]
    for r in out:
        if r.record_type == "response":
            assert r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest()
    assert {r.payload_digest for r in out if r.page_id in (1, 3)} == {hashlib.sha1(long.encode()).hexdigest()}
    assert len(list((tmp_path / "w").glob("part-*"))) > 1


def test_empty_table_of_pages(spark, tmp_path):
    assert round_trip(spark, [], str(tmp_path / "w")) == []


def test_packages_are_plain_zip_files_with_stored_members(spark, tmp_path):
    round_trip(spark, [(1, "u", "text", None, 0)], str(tmp_path / "w"))
    with zipfile.ZipFile(next((tmp_path / "w").glob("part-*"))) as package:
        assert package.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())


def test_zip64_directory_and_offsets():
    """A directory whose 32-bit fields are all full, with the true values in the ZIP64 parts."""
    import struct

    name, body = b"archive/data.warc.gz", b"stored bytes"
    local = struct.pack(warc.LOCAL_LAYOUT, warc.LOCAL_SIGNATURE, 45, 0, 0, 0, 0, 0, len(body), len(body), len(name), 0) + name + body
    extra = struct.pack("<2H3Q", warc.ZIP64_EXTRA, 24, len(body), len(body), 7)
    entry = struct.pack(warc.ENTRY_LAYOUT, warc.ENTRY_SIGNATURE, 45, 45, 0, 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra
    at = 7 + len(local)
    end64 = struct.pack(warc.END64_LAYOUT, warc.END64_SIGNATURE, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack(warc.END64_LOCATOR_LAYOUT, warc.END64_LOCATOR_SIGNATURE, 0, at + len(entry), 1)
    end = struct.pack(warc.END_LAYOUT, warc.END_SIGNATURE, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 4) + b"PK\x05\x06"
    source = io.BytesIO(b"prefix " + local + entry + end64 + locator + end)
    ranges = warc.ByteRanges(source)
    (member,) = warc.read_directory(ranges)
    assert member.stored and ranges.read(warc.data_offset(ranges, member), member.size) == body
    with pytest.raises(ValueError):
        warc.read_directory(warc.ByteRanges(b"no archive at all, but long enough"))


def packed_records(ids):
    return [zlib.compress(warc.warc_record(i, f"u{i}", b"text %d" % i, hashlib.sha1(b"text %d" % i).hexdigest(), None), wbits=31) for i in ids]


def test_ranges_of_a_large_archive_are_read_alone(spark, tmp_path):
    """A sparse package of five gigabytes: far above what can be loaded, with its records behind a hole."""
    import struct

    records, hole = packed_records(range(40)), 5 << 30
    data = b"".join(records)
    index = "\n".join(f'{i} 1970 {{"offset": {sum(map(len, records[:i]))}, "length": {len(records[i])}, "filename": "data.warc.gz"}}' for i in range(40)).encode()
    (tmp_path / "w").mkdir()
    with open(tmp_path / "w" / "part-0", "wb") as file:
        places = []
        for name, body in ((b"archive/other.bin", None), (b"archive/data.warc.gz", data), (b"indexes/index.cdxj.gz", zlib.compress(index, wbits=31))):
            size = hole if body is None else len(body)
            places.append((name, size, file.tell()))
            file.write(struct.pack(warc.LOCAL_LAYOUT, warc.LOCAL_SIGNATURE, 45, 0, 8 if body is None else 0, 0, 0, 0, 0, 0, len(name), 0) + name)
            file.seek(size, 1) if body is None else file.write(body)
        at = file.tell()
        for name, size, offset in places:
            extra = struct.pack("<2H3Q", warc.ZIP64_EXTRA, 24, size, size, offset)
            file.write(struct.pack(warc.ENTRY_LAYOUT, warc.ENTRY_SIGNATURE, 45, 45, 0, 8 if size == hole else 0, 0, 0, 0, warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra)
        size = file.tell() - at
        file.write(struct.pack(warc.END64_LAYOUT, warc.END64_SIGNATURE, 44, 45, 45, 0, 0, 3, 3, size, at))
        file.write(struct.pack(warc.END64_LOCATOR_LAYOUT, warc.END64_LOCATOR_SIGNATURE, 0, at + size, 1))
        file.write(struct.pack(warc.END_LAYOUT, warc.END_SIGNATURE, 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0))
    rows = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.page_id, bytes(r.payload), r.digest_ok) for r in rows) == [(i, b"text %d" % i, True) for i in range(40)]


def test_members_without_an_index_are_scanned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    (tmp_path / "w x").mkdir()
    with zipfile.ZipFile(tmp_path / "w x" / "part 1", "w", zipfile.ZIP_STORED) as package:
        package.writestr("archive/a.warc.gz", b"".join(packed_records(range(30))))
        package.writestr("archive/b.warc.gz", b"".join(packed_records(range(100, 103))))
        package.writestr("indexes/index.cdxj", '101 1970 {"offset": %d, "length": %d, "filename": "b.warc.gz"}' % tuple(len(x) for x in packed_records([100, 101])))
    assert sorted(r.page_id for r in warc.read_archives(spark, f"file://{tmp_path}/w x").collect()) == [*range(30), 101]
    package = (tmp_path / "w x" / "part 1").read_bytes()
    assert sorted(warc._page_of(h["WARC-Record-ID"]) for h, _ in warc.iter_records(package)) == [*range(30), 101]
    assert list(warc.scan_member(warc.ByteRanges(b"".join(packed_records([7, 8]))), 0, sum(map(len, packed_records([7, 8]))), 3)) == [(0, len(packed_records([7])[0])), (len(packed_records([7])[0]), len(packed_records([8])[0]))]


def test_a_very_long_page(spark, tmp_path):
    long = "<p>word é " * 400_000
    (row,) = round_trip(spark, [(1, "u", long, None, 0)], str(tmp_path / "w"))
    assert bytes(row.payload).decode() == long and row.payload_bytes == len(long.encode())


# ------------------------------------------------------------------- SimHash


def brute_classes(texts):
    prints = np.array([simhash.fingerprint(simhash.shingle_hashes(t)) for _, t in texts], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array([i for i, _ in texts])
    while True:
        new = np.array([label[near[i]].min() for i in range(len(texts))])
        if (new == label).all():
            return {i: int(c) for (i, _), c in zip(texts, label, strict=True)}, {i: f"{int(p):016x}" for (i, _), p in zip(texts, prints, strict=True)}
        label = new


def near_texts(seed, n=250):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.6:
            words = texts[rng.randrange(len(texts))][1].split()
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append((i, " ".join(words)))
        else:
            texts.append((i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 400)))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_brute_force(spark, seed):
    texts = near_texts(seed)
    rows = simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    classes, prints = brute_classes(texts)
    assert {r.doc_id: r.component_id for r in rows} == classes and {r.doc_id: r.fingerprint for r in rows} == prints
    assert len(set(classes.values())) < len(classes)


def test_every_pair_within_the_threshold_shares_an_anchor():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(400):
        for bit in rng.choice(64, 3, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    anchors, prints, home = simhash.anchor_rows(np.r_[a, b])
    at: dict[int, set[int]] = {}
    homes: dict[int, set[int]] = {}
    for x, p, h in zip(anchors.tolist(), prints.tolist(), home.tolist(), strict=True):
        at.setdefault(p, set()).add(x)
        if h:
            homes.setdefault(p, set()).add(x)
    assert all(homes[x] & at[y] and homes[y] & at[x] for x, y in zip(a.tolist(), b.tolist(), strict=True))


def test_spanning_links_in_blocks():
    bits = np.array([0, 1, 3, 7, 15, 31, 1 << 40, 63, (1 << 40) | 1], np.uint64)
    found = simhash.spanning_links(bits, 1, 2)
    # All nine hang together, so a forest has eight links, each within the threshold.
    assert len(found) == 8 and all(np.bitwise_count(bits[a] ^ bits[b]) <= 1 for a, b in found)


def test_near_duplicates_odd_rows(spark):
    rows = [(3, None, "x"), (1, "", "x"), (7, " \t\n", "x"), (None, "a b c d", "x"), (9, "A b c d", "x"), (9, "a b c d", "x"), (None, "only here now", "x"), (2, "word " * 50_000, "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    assert len(out) == len(rows)
    found = {(r.doc_id, r.fingerprint): r.component_id for r in out}
    zero = "0" * 16
    assert found[3, zero] == found[1, zero] == found[7, zero] == 1
    assert sorted(str(r.component_id) for r in out if r.doc_id is None) == ["9", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_chains(spark):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1) if i != 150] + [(order[0], order[0])] * 3
    out = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: min(part) for part in (order[:151], order[151:]) for x in part}


# ------------------------------------------------------------------ passages


def brute_passages(rows, n=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = np.zeros(len(words), bool)
        for s in range(len(words) - n + 1):
            key = tuple(words[s : s + n])
            if key in seen:
                gone[s : s + n] = True
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[i] = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest())
    return out


def passage_rows(seed):
    rng = random.Random(seed)
    shared = [" ".join(rng.choices(WORDS, k=k)) for k in (19, 20, 21, 45, 120)]
    rows = []
    for i in rng.sample(range(1000), 120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(WORDS, k=rng.randrange(0, 60))))
        rows.append((i, rng.choice([" ", "\n", "\x0b "]).join(parts)))
    rows += [(2001, "same word " * 200), (2002, "same " * 25), (2003, None), (2004, ""), (2005, "é x " * 30)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_passages_equal_brute_force(spark, seed, monkeypatch):
    rows = passage_rows(seed)
    if seed == 2:
        monkeypatch.setattr(substrings, "SAMPLE_HITS", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substrings.remove_repeats(df).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_passages(rows)
    for r in out:
        text = dict(rows)[r.row.doc_id] or ""
        assert r.text == text if not r.n_removed else hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256


def test_lengthened_prefixes_give_the_same(spark, monkeypatch):
    rows = passage_rows(4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substrings, "long_prefixes", lambda keyed, window=20: np.unique(substrings.Block([t for _, t in rows], 20, substrings.WordHashes()).prefix))
    out = substrings.remove_repeats(df, with_text=False).collect()
    assert {r.row.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute_passages(rows)


@pytest.mark.parametrize("size", [1, 7, 100])
def test_groups_are_searched_in_batches_of_any_size(size):
    """The marks don't depend on where batches end, and of a group only its different windows are held."""
    rows = [(i, " ".join(WORDS[:40])) for i in range(300)] + [(1000 + i, " ".join(WORDS[i % 3 : 30])) for i in range(50)]
    texts = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows), pa.int32()), pa.array([t for _, t in rows])], ["doc_id", "version", "text"])
    parts = [p for i in range(0, len(rows), 5) for p in substrings._suffixes([texts.slice(i, 5)], 20, np.zeros(0, np.uint64))]
    table = pa.Table.from_batches(parts).sort_by([(c, "ascending") for c in ("prefix", "doc_id", "tag", "start")]).combine_chunks()
    marks = lambda n: sorted(tuple(r.values()) for b in substrings._repeats(table.to_batches(n)) for r in b.to_pylist())
    assert marks(size) == marks(10_000) and len(marks(size)) > 300
    nodes, most = substrings.Nodes(*(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))), 0
    for batch in table.to_batches(size):
        _, nodes = substrings._repeats_of(batch, nodes)
        most = max(most, len(nodes.prefix))
    assert most <= 21


def test_prefixes_are_lengthened_by_bytes(spark, monkeypatch):
    text = " ".join(WORDS[:25])
    keyed = substrings._keyed(spark.createDataFrame([(i, f"{text} x{i}") for i in range(200)], "doc_id long, text string"), "doc_id", "text")
    monkeypatch.setattr(substrings, "SAMPLE_DOCS", 0)
    monkeypatch.setattr(substrings, "GROUP_BYTES", 200 * substrings.ROW_BYTES)
    assert not len(substrings.long_prefixes(keyed))
    monkeypatch.setattr(substrings, "GROUP_BYTES", 20 * substrings.ROW_BYTES)
    assert len(substrings.long_prefixes(keyed))


def test_passages_of_repeated_and_null_rows(spark):
    text = " ".join(WORDS[:30])
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (9, text, 3)]
    out = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()
    assert sorted((str(r.row.doc_id), r.n_removed, r.row.n_words) for r in out) == [("5", 0, 1), ("5", 0, 1), ("9", 30, 3), ("None", 30, 2)]
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("length", [1, 2, 6, 7, 20, 31])
def test_rolling_hashes(length):
    words = np.random.default_rng(length).integers(0, 1 << 63, 50, dtype=np.uint64)
    expected = [sum(int(words[i + j]) * pow(substrings.BASE, j, 1 << 64) for j in range(length)) % (1 << 64) for i in range(51 - length)]
    assert substrings.rolling(words, length).tolist() == expected
    values = np.array([3, 1, 1, 5, 0, 0, 2, 2] * 6)
    if length <= len(values):
        assert substrings.first_minimum(values, length).tolist() == [i + int(values[i : i + length].argmin()) for i in range(len(values) - length + 1)]


# ---------------------------------------------------------------- neighbours


def brute_neighbours(rows, k, every):
    vectors = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows}
    out = set()
    for q in vectors:
        if q % every == 0:
            scored = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_neighbours_equal_brute_force(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(int(i), [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.05 if seed == 1 else 1.0, 8)]) for i in rng.permutation(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, [0.5] * 3), (2001, [0.25] * 3)]
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbours, "MIN_BLOCK_ROWS", 10)
    out = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10)
    assert {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()} == brute_neighbours(rows, 5, 10)


def test_neighbours_with_rows_of_one_id(spark):
    rng = np.random.default_rng(9)
    rows = [(i // 4 * 10 if i < 40 else 1000 + i, [float(np.float32(x)) for x in rng.normal(0, 1, 4)]) for i in range(300)]
    out = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=10).collect()
    whole = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows]
    for q in {i for i, _ in rows if i % 10 == 0}:
        best = sorted({(-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q})[:5]
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q] == [(j, -s) for s, j in best]


def test_bounds_prune_clustered_vectors(spark):
    """Each query reaches few blocks; no cell that holds one of its best is left out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 40] + rng.normal(0, 0.03, 16)]) for i in range(8000)]
    df = neighbours.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding").withColumn("nth", F.lit(1))
    cells = neighbours.cells_of(df, 64, 8000, 16)
    queries = df.filter("vec_id % 50 = 0")
    own, asking = neighbours.dealt(df, queries, cells, 6)
    assert own.count() == 8000 and asking.count() < 0.15 * 160 * cells.blocks.sum()
    whole = np.floor(256 * np.array([v for _, v in rows]).astype(np.float64))
    where = cells.nearest(whole)
    asked = cells.asked(whole[::50], 6)
    for q, row in zip(range(0, 8000, 50), asked, strict=True):
        scores = whole @ whole[q]
        scores[q] = -np.inf
        assert row[where[scores >= np.sort(scores)[-5]]].all()


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 2.0], 9), (0, [1.0, 2.0], 9), (1, [float("nan"), 1.0], 9), (2, [None, 1.0], 9), (3, None, 9), (4, [-1.0, 1.0], 9), (None, [1.0, 1.0], 9), (5, [float("inf"), 1.0], 9), (10, [], 9), (11, [], 9)]
    out = neighbours.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int"), every=5).collect()
    assert sorted(tuple(r) for r in out) == [(0, 1, 4, 65536), (10, 1, 11, 0)]
    assert neighbours.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_best_of_uses_exact_integers_beyond_floats():
    big = (1 << 31) - 1
    q, d = np.array([[big, 1]]), np.array([[big, 1], [big, 2]])
    assert neighbours.best_of(q, np.array([0]), d, np.array([1, 2]), 1)[2].tolist() == [big * big + 2]


def test_pieces_bound_the_bytes():
    from linespark.llm.common import pieces

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 50, "c", "d" * 10]})
    assert [p.num_rows for p in pieces([batch], 0, 12)] == [2, 1, 2]


def test_scores_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(50, [1e8, 1e8]), (1, [2e8, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        neighbours.top_k(df)
    small = spark.createDataFrame([(50, [1e6, 1e6]), (1, [1e6, -1e6]), (2, [2e6, 0.0])], df.schema)
    assert [(r.vec_id, r.score) for r in neighbours.top_k(small).collect()] == [(2, 256_000_000 * 512_000_000), (1, 0)]


def test_passages_of_a_very_long_text(spark):
    """A text longer than a block, with passages that come again within it and in others."""
    rng = random.Random(21)
    say = lambda n: [rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n)]
    passage, long = say(60), say(150_000)
    long[90_000:90_060] = passage
    long[140_000:140_060] = passage
    rows = [(3, " ".join(long)), (2, " ".join(say(5) + passage + say(5))), (None, " ".join(passage)), (9, None)]
    out = {r.row.doc_id: (r.n_words, r.n_removed) for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {2: (70, 0), 3: (150_000, 120), None: (60, 60), 9: (0, 0)}
