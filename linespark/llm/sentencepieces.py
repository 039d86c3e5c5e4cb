"""SentencePiece encoding and decoding with the tokenizers library as the engine.

A SentencePiece model is a protobuf message. ``read_model`` parses it, ``build`` makes the
same tokenizer of library parts: the normaliser (character map, white space rules, dummy
prefix), the metaspace marker, the pieces with their scores (as unigram scores, or as merges
by score for models of the pair-merging kind) and byte fallback. Rows are encoded in batches
on several threads, and parity with the original library is verified for every row.

Where no piece has a marker behind another character and no white space is rewritten, a text
can be cut before each run of markers without a change of its tokens; spaces and literal
markers are the same there, so a run may hold both. Then each distinct word of a task is
encoded once, in batches, and texts are put together from their words' ids. Other models encode
whole texts. The original library always encodes whole texts.

Defined cases: a null text has null results; an empty text has no tokens; further columns are
carried in ``key``; an empty table gives an empty table. A text is never cut: a task holds the longest one with its tokens, twice
while both libraries are compared; null ids and repeated rows are encoded one by one.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

MARKER = "▁"
#: Where the public model lies on every machine; a parameter of all functions here.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
THREADS = 2
PIECE_BYTES = 2 << 20
CACHE_WORDS = 400_000
WORDS_TOGETHER = 256

# Fixed values of the model message: piece kinds and model kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, PAIRS = 1, 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if kind == 2:
                size, at = _varint(data, at)
            if size is None or at + size > len(data):
                raise ValueError("not a SentencePiece model")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def read_model(data: bytes) -> Model:
    """The parts of a serialised model that encoding needs."""
    model = Model()
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            model.pieces.append((own[1].decode("utf-8"), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
        elif number == 2:
            own = dict(fields(value))
            model.kind, model.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(own.get(n, 1)) for n in (3, 4, 5))
    if model.kind not in (UNIGRAM, PAIRS):
        raise ValueError(f"model kind {model.kind} is not supported")
    return model


def merges_of(model: Model) -> list[tuple[str, str]]:
    """All pairs that make a piece, best score first; of equal scores, the longest left part first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, value in score.items():
        for cut in range(1, len(piece)):
            if piece[:cut] in score and piece[cut:] in score:
                found.append((-value, -cut, piece[:cut], piece[cut:]))
    return [(a, b) for _, _, a, b in sorted(found)]


def build(model: Model, whole: bool = True):
    """The tokenizer of library parts; without ``whole``, one for words that adds no prefix."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next((p for p, _, kind in model.pieces if kind == UNKNOWN), None)
    if model.kind == UNIGRAM:
        engine = models.Unigram([(p, s) for p, s, _ in model.pieces], None if unknown is None else ids[unknown], model.byte_fallback)
    else:
        engine = models.BPE(ids, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(engine)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix and whole:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARKER))
    tokenizer.normalizer = normalizers.Sequence(steps)
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])])
    return tokenizer


def texts_of(words: list[str]) -> bytes:
    """What the ids of words, parted by line feeds, should decode to."""
    return "\n".join(words).replace(MARKER, " ").encode("utf-8", "surrogatepass")


class Codec:
    """Encodes and decodes batches of texts, with the ids of known words at hand."""

    def __init__(self, data: bytes, threads: int, verify: bool):
        # The library reads these when it first starts its threads.
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.threads = threads
        self.model = model = read_model(data)
        self.by_word = model.byte_fallback and model.escape_whitespaces and not model.charsmap and not model.remove_extra_whitespaces and not any(
            MARKER in p.lstrip(MARKER) or "\n" in p or kind == USER_DEFINED for p, _, kind in model.pieces
        )
        self.tokenizer = build(model, whole=not self.by_word)
        self.cut = re.compile(f"\n|[ {MARKER}]+[^ {MARKER}\n]*|[^ {MARKER}\n]+").findall
        self.line = next((i for i, (p, _, kind) in enumerate(model.pieces) if kind == BYTE and p == "<0x0A>"), -1)
        self.known: dict[str, bytes] = {"\n": array("i", [self.line]).tobytes()}
        self.lossy: set[str] = set()
        self.bytes = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode("utf-8") for p, _, kind in model.pieces]
        self.original = None
        if verify:
            import sentencepiece

            self.original = sentencepiece.SentencePieceProcessor(model_proto=data)

    def learn(self, words: list[str]) -> None:
        """Encode new words, WORDS_TOGETHER in a text: a line feed, which no piece holds, parts them."""
        groups = [words[i : i + WORDS_TOGETHER] for i in range(0, len(words), WORDS_TOGETHER)]
        texts = ["\n".join(g) for g in groups]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        for group, ids in zip(groups, found, strict=True):
            row = np.array(ids, np.int32)
            ends = [*np.flatnonzero(row == self.line).tolist(), len(row)]
            raw, at = row.tobytes(), 0
            for word, end in zip(group, ends, strict=True):
                self.known[word] = raw[4 * at : 4 * end]
                at = end + 1
            if self.original is not None and b"".join(map(self.bytes.__getitem__, ids)) != texts_of(group):
                self.lossy |= {w for w in group if b"".join(map(self.bytes.__getitem__, np.frombuffer(self.known[w], np.int32).tolist())) != texts_of([w])}

    def round_trips(self, texts: list[str], ids: list[bytes]) -> list[bool]:
        """Whether each text's ids decode to it, where a marker reads as a space.

        Where texts are put together from words and pieces are joined byte by byte, a text's ids decode to it
        just if those of its words do, which is looked at when a word is first met.
        """
        if self.by_word and self.model.kind == PAIRS:
            return [True] * len(texts) if not self.lossy else [self.lossy.isdisjoint(self.words_of(t)) for t in texts]
        return [d == t.replace(MARKER, " ") for d, t in zip(self.decode([np.frombuffer(i, np.int32).tolist() for i in ids]), texts, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """The ids of each text as 32-bit numbers, and whether the original library gives the same."""
        found = self.encode_words(texts) if self.by_word else [array("i", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.original is None:
            return found, [True] * len(texts)
        return found, [a == array("i", b).tobytes() for a, b in zip(found, self.original.encode(texts, num_threads=self.threads), strict=True)]

    def words_of(self, text: str) -> list[str]:
        return self.cut((" " if self.model.add_dummy_prefix else "") + text) if text else []

    def encode_words(self, texts: list[str]) -> list[bytes]:
        cut = [*map(self.words_of, texts)]
        if len(self.known) > CACHE_WORDS:
            self.known = {"\n": self.known["\n"]}
        self.learn([*set().union(*cut).difference(self.known)])
        return [b"".join(map(self.known.__getitem__, words)) for words in cut]

    def decode(self, ids: list[list[int]]) -> list[str]:
        if self.by_word and self.model.kind == PAIRS:
            try:
                out = [b"".join(map(self.bytes.__getitem__, i)).decode("utf-8") for i in ids]
                return [t[1:] if self.model.add_dummy_prefix and t[:1] == " " else t for t in out]
            except UnicodeDecodeError:
                pass
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(data: bytes, threads: int, verify: bool) -> Codec:
    """The codec that all tasks of a worker share."""
    return Codec(data, threads, verify)


@lean
def _encode(batches: Iterable[pa.RecordBatch], data: bytes, threads: int, verify: bool) -> Iterator[pa.RecordBatch]:
    own = codec(data, threads, verify)
    for batch in pieces(batches, 1, PIECE_BYTES):
        texts = batch.column(1).to_pylist()
        null = np.array([t is None for t in texts], bool)
        found, same = own.encode([t or "" for t in texts])
        sizes = np.array([len(i) // 4 for i in found], np.int64)
        ids = pa.ListArray.from_arrays(np.r_[0, np.cumsum(sizes)].astype(np.int32), np.frombuffer(b"".join(found), np.int32), mask=pa.array(null))
        parity = pa.array(same, pa.bool_(), mask=null) if verify else pa.nulls(len(texts), pa.bool_())
        back = pa.nulls(len(texts), pa.bool_())
        if verify:
            back = pa.array(own.round_trips([t or "" for t in texts], found), mask=null)
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(sizes, mask=null), parity, back], ["key", "token_ids", "n_tokens", "parity", "round_trip"])


def encode(docs: DataFrame, model_path: str = MODEL_PATH, text_col: str = "text", threads: int = THREADS, verify: bool = True) -> DataFrame:
    """(key, token_ids, n_tokens, parity, round_trip) of every row; ``key`` holds all other columns.

    ``parity`` says whether the original library gives the same ids, ``round_trip`` whether the ids
    decode to the text, where a marker reads as a space (both null without ``verify``).
    The model (a file of bounded size) is read once and sent along with the tasks.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encode(batches, data, threads, verify), f"key {kind}, token_ids array<int>, n_tokens long, parity boolean, round_trip boolean")


@lean
def _decode(batches: Iterable[pa.RecordBatch], data: bytes, threads: int) -> Iterator[pa.RecordBatch]:
    own = codec(data, threads, False)
    for batch in pieces_of_lists(batches):
        ids = batch.column(1).to_pylist()
        texts = own.decode([i or [] for i in ids])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if i is None else t for i, t in zip(ids, texts, strict=True)], pa.string())], ["key", "text"])


def pieces_of_lists(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def decode(rows: DataFrame, model_path: str = MODEL_PATH, ids_col: str = "token_ids", threads: int = THREADS) -> DataFrame:
    """(key, text) of every row; ``key`` holds all other columns."""
    with open(model_path, "rb") as file:
        data = file.read()
    key = F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != ids_col))
    rows = rows.select(key.alias("key"), F.col(ids_col).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _decode(batches, data, threads), f"key {kind}, text string")
