"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives each document a posterior over domains.
Document rates r (expected copies, zero or more) are then fitted so that the expected tokens
of each domain, sum of r * tokens * posterior, come near their targets. The fit is projected
gradient descent on least squares with momentum::

    r <- max(0, z - step * (posterior . gap + pull * (z - budget)))

where ``gap`` is the vector of (expected - target) tokens of the domains, each as a share of the domain's
own tokens (so a rare domain counts like any other), and a weak ``pull`` to the overall budget makes the
solution unique; it moves a domain's total by about a thousandth of its own tokens. A document's rate
depends on its posterior alone, so the gap is summed over distinct posteriors (kept to
``1 / GRID``); each step is one distributed sum of which a number for each domain comes back.

The classifier is naive Bayes on hashed words, learned from a bounded sample of
``SAMPLE_PER_DOMAIN`` labelled rows of each domain; a text's evidence counts like
``EVIDENCE_WORDS`` words at most, which keeps memberships soft.

Defined cases: null, empty and wordless texts have no tokens and the labelled shares as
posterior; without labelled rows all rates are the budget; targets of unknown domains are left
out, domains without a target get 0; an empty table gives an empty table; rows with equal or
null ids are treated one by one; further columns are carried in ``key``. A text is never cut: a task holds the longest
one with its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces, written
from .substrings import WordHashes

SAMPLE_PER_DOMAIN = 1500
BUCKETS = 1 << 16
EVIDENCE_WORDS = 12.0
GRID = 100
STEPS = 60
PULL = 1e-3
#: The fit ends once no domain's gap changes by more than this share of its tokens.
TOLERANCE = 1e-6
PIECE_BYTES = 2 << 20


@dataclass(frozen=True)
class Domains:
    names: list[str]
    prior: np.ndarray  # share of each domain among the labelled rows
    words: np.ndarray  # BUCKETS x domains, log probabilities


def _buckets(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all words and the number of words of each text."""
    words = [(t or "").encode("utf-8").lower().split() for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    found = np.fromiter((h for w in words for h in map(hashes.__getitem__, w)), np.uint64, int(sizes.sum()))
    return (found & np.uint64(BUCKETS - 1)).astype(np.int64), sizes


def _learn_group(key: tuple, rows: pa.Table) -> pa.Table:
    counts, hashes = np.zeros(BUCKETS, np.int64), WordHashes()
    for batch in pieces(rows.select(["text"]).to_batches(), 0, PIECE_BYTES):
        counts += np.bincount(_buckets(batch.column(0).to_pylist(), hashes)[0], minlength=BUCKETS)
    return pa.table({"domain": pa.array([key[0].as_py()]), "counts": pa.array([counts.tobytes()], pa.binary())})


def learn(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_domain: int = SAMPLE_PER_DOMAIN) -> Domains:
    """Fit the classifier; ``labelled`` has (id_col, domain).

    About ``per_domain`` rows of each domain are chosen by a hash of the id. The chosen ids are
    few whatever the input's size, so they are broadcast to the texts.
    """
    known = labelled.filter(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("domain").alias("domain"))
    totals = {r[0]: r[1] for r in known.groupBy("domain").count().collect()}
    if not totals:
        return Domains([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*(F.lit(x) for name, n in sorted(totals.items()) for x in (name, min(1.0, per_domain / n))))
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit("domain")), F.lit(1 << 40)) < F.element_at(share, F.col("domain")) * (1 << 40))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").select("domain", "text").groupBy("domain").applyInArrow(_learn_group, "domain string, counts binary").collect()
    found = sorted((r[0], np.frombuffer(r[1], np.int64)) for r in rows)
    counts = np.stack([c for _, c in found], axis=1).astype(np.float64)
    names = [n for n, _ in found]
    prior = np.array([totals[n] for n in names], np.float64)
    return Domains(names, prior / prior.sum(), np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * BUCKETS)).astype(np.float32))


def posteriors(texts: list[str | None], domains: Domains, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(words, posterior) of each text; posteriors are kept to 1 / GRID and sum to 1."""
    buckets, sizes = _buckets(texts, hashes)
    if not domains.names:
        return sizes, np.zeros((len(texts), 0))
    mean = np.zeros((len(texts), len(domains.names)))
    full = np.flatnonzero(sizes)
    if len(full):
        begins = (np.cumsum(sizes) - sizes)[full]
        mean[full] = np.add.reduceat(domains.words[buckets], begins, axis=0, dtype=np.float64) / sizes[full, None]
    logs = np.log(domains.prior) + mean * np.minimum(sizes, EVIDENCE_WORDS)[:, None]
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    exact = odds / odds.sum(axis=1, keepdims=True) * GRID
    # Whole grid steps; the largest remainders get what rounding down has left.
    whole = np.floor(exact)
    rank = np.argsort(np.argsort(-(exact - whole), axis=1, kind="stable"), axis=1, kind="stable")
    whole += rank < np.round(GRID - whole.sum(axis=1, keepdims=True))
    return sizes, whole / GRID


@lean
def _members(batches: Iterable[pa.RecordBatch], domains: Domains, fit: Fit | None) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in pieces(batches, 1, PIECE_BYTES):
        sizes, found = posteriors(batch.column(1).to_pylist(), domains, hashes)
        flat = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(domains.names), found.ravel())
        columns = {"key": batch.column(0), "n_tokens": pa.array(sizes), "posterior": flat}
        if fit is not None:
            columns |= {"rate": pa.array(fit.rates(found)), "text": batch.column(1)}
        yield pa.RecordBatch.from_pydict(columns)


def memberships(docs: DataFrame, domains: Domains, text_col: str = "text") -> DataFrame:
    """(key, n_tokens, posterior) of every row; ``key`` holds all other columns."""
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _members(batches, domains, None), f"key {kind}, n_tokens long, posterior array<double>")


def rated(docs: DataFrame, domains: Domains, fit: Fit, text_col: str = "text") -> DataFrame:
    """(key, n_tokens, posterior, rate, text) of every row, in one pass over the texts."""
    key = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col))
    rows = docs.select(key.alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _members(batches, domains, fit), f"key {kind}, n_tokens long, posterior array<double>, rate double, text string")


@dataclass(frozen=True)
class Fit:
    """All that a document's rate needs: the gaps met on the way, as shares of the domains' tokens."""

    budget: float
    step: float
    momentum: float
    gaps: list[np.ndarray]

    def rates(self, posterior: np.ndarray, ahead: bool = False) -> np.ndarray:
        """The rate for each row of posteriors; with ``ahead`` the point of the next gradient."""
        rate = z = np.full(len(posterior), self.budget)
        for gap in self.gaps:
            after = np.maximum(0.0, z - self.step * (posterior @ gap + PULL * (z - self.budget)))
            z, rate = after + self.momentum * (after - rate), after
        return z if ahead else rate


def _flat(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _sums(batches: Iterable[pa.RecordBatch], fit: Fit | None, width: int) -> Iterator[pa.RecordBatch]:
    """Sums over (posterior, n_tokens): expected tokens at the next gradient's point, or the matrix of second moments."""
    total = np.zeros((width, 1 if fit else width))
    for batch in batches:
        own, tokens = _flat(batch.column(0), width), batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
        total += own.T @ (tokens * fit.rates(own, ahead=True))[:, None] if fit else own.T @ (tokens[:, None] * own)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])


def fit_rates(members: DataFrame, domains: Domains, targets: dict[str, float], budget: float = 1.0, steps: int = STEPS) -> Fit:
    """Fit rates to ``targets`` (weights of the domains); ``budget`` is wanted tokens over present ones."""
    width = len(domains.names)
    points = written(members.groupBy("posterior").agg(F.sum("n_tokens").alias("n_tokens")), "mixing-points")
    total = points.agg(F.sum("n_tokens")).first()[0] or 0
    if not width or not total:
        return Fit(budget, 0.0, 0.0, [])

    def gathered(fit: Fit | None) -> np.ndarray:
        cells = points.mapInArrow(lambda batches: _sums(batches, fit, width), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(width if fit else width * width)
        for r in cells:
            out[r[0]] = r[1] / total
        return out

    moments = gathered(None).reshape(width, width)
    # Posteriors sum to 1, so the rows of the second moments sum to the domains' shares of the tokens.
    share = moments.sum(axis=1)
    weight = np.where(share > 0, 1 / np.where(share > 0, share, 1), 0.0)
    curve = np.linalg.eigvalsh(np.sqrt(np.outer(weight, weight)) * moments)
    smallest, step = max(curve[0], 0.0) + PULL, 1.0 / (curve[-1] + PULL)
    ratio = np.sqrt(smallest * step)
    fit = Fit(budget, step, (1 - ratio) / (1 + ratio), [])
    weights = np.array([targets.get(n, 0.0) for n in domains.names])
    wanted = budget * weights / max(sum(targets.values()), 1e-12)
    for _ in range(steps):
        gap = (gathered(fit) - wanted) * weight
        if fit.gaps and np.abs(gap - fit.gaps[-1]).max() < TOLERANCE:
            break
        fit.gaps.append(gap)
    return fit


def _with_rates(batches: Iterable[pa.RecordBatch], fit: Fit, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rate = fit.rates(_flat(batch.column(2), width))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], ["key", "n_tokens", "posterior", "rate"])


def with_rates(members: DataFrame, fit: Fit, domains: Domains) -> DataFrame:
    """(key, n_tokens, posterior, rate) of every membership row."""
    kind = members.schema["key"].dataType.simpleString()
    width = len(domains.names)
    return members.mapInArrow(lambda batches: _with_rates(batches, fit, width), f"key {kind}, n_tokens long, posterior array<double>, rate double")


def copies(rate, *by):
    """Whole copies of a document: the rate rounded up or down by a hash, so that the mean is the rate."""
    spread = F.pmod(F.xxhash64(*by, F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (spread < rate - F.floor(rate)).cast("int")).cast("long")
