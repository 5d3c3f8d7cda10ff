"""Hashed byte n-gram features and small linear models, in numpy.

Scoring is linear in counts: a text's score is the mean of its n-grams' weights,
so whole texts are scored batch-wise by table lookups. Models are fitted on the
driver from a bounded sample, whose features executors compute.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.textkernel import LOWER, Texts

#: Buckets of hashed n-grams, and n.
BITS, GRAM = 13, 3
BUCKETS = 1 << BITS
SCALE = 50.0


def gram_buckets(texts: Texts, lower: bool = True) -> np.ndarray:
    """A bucket for the n-gram that begins at each byte; ``BUCKETS`` where it would leave its text."""
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    out = np.full(n, BUCKETS, np.int32)
    if n >= GRAM:
        code = np.zeros(n - GRAM + 1, np.uint32)
        for j in range(GRAM):
            code = code * np.uint32(257) + data[j : n - GRAM + 1 + j]
        out[: len(code)] = (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        for j in range(1, GRAM):
            cut = texts.at[1:-1] - j
            out[cut[cut >= 0]] = BUCKETS
    return out


def histograms(texts: Texts, lower: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text, its buckets (uint16) and their relative frequencies (float32)."""
    buckets, out = gram_buckets(texts, lower), []
    for i in range(texts.n):
        x = buckets[texts.at[i] : texts.at[i + 1]]
        got, n = np.unique(x[x < BUCKETS], return_counts=True)
        out.append((got.astype(np.uint16), (n / max(1, n.sum())).astype(np.float32)))
    return out


def score(texts: Texts, weights: np.ndarray, bias: np.ndarray, lower: bool = True) -> np.ndarray:
    """(texts, models): bias plus SCALE times the mean weight of a text's n-grams."""
    out = np.repeat(bias[None, :].astype(np.float64), texts.n, 0)
    full = np.flatnonzero(np.diff(texts.at) >= GRAM)
    if len(full):
        rows = np.vstack([weights, np.zeros((1, weights.shape[1]))]).astype(np.float32)
        sums = np.add.reduceat(rows[gram_buckets(texts, lower)], texts.at[:-1][full], axis=0)
        # a reduceat span may reach past short texts that stand between, so their bytes are taken off again
        for a, b in zip(full, [*full[1:], texts.n]):
            if b > a + 1:
                sums[np.searchsorted(full, a)] = rows[gram_buckets(Texts(texts.data[texts.at[a] : texts.at[a + 1]], np.array([0, texts.at[a + 1] - texts.at[a]])), lower)].sum(0)
        out[full] += SCALE * sums / (np.diff(texts.at)[full] - GRAM + 1)[:, None]
    return out


def dense(hists: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    x = np.zeros((len(hists), BUCKETS), np.float32)
    for i, (at, v) in enumerate(hists):
        x[i, at] = v
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 80, rate: float = 0.2, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic models, one per column of ``y`` (probabilities of 1), by full-batch Adam."""
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, b)]
    weight = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    weight = (weight / max(weight.sum(), 1e-9))[:, None]
    for t in range(1, rounds + 1):
        g = ((sigmoid(SCALE * (x @ w) + b) - y) * weight).astype(np.float32)
        for p, m, d in ((w, moments[0], SCALE * (x.T @ g) + decay * w), (b, moments[1], g.sum(0))):
            m[0] += 0.1 * (d - m[0])
            m[1] += 0.001 * (d * d - m[1])
            p -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    return w, b


def bounded_sample(rows: DataFrame, by: str, each: int, salt: str) -> DataFrame:
    """About ``each`` rows or fewer of every value of ``by``: a hash of doc_id against each / count.

    One short row per value reaches the driver. Independent of partitioning, so reruns agree.
    """
    counts = rows.groupBy(by).count().collect()
    if not counts:
        return rows.limit(0).withColumn("sample_weight", F.lit(1.0))
    rate = {r[by]: min(1.0, each / r["count"]) for r in counts}
    keep = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for k, r in rate.items() for v in (k, r)]), F.col(by)), F.lit(0.0))
    place = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    return rows.withColumn("sample_weight", 1.0 / keep).where(place < keep)


def packed(hists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array]:
    return pa.array([a.tobytes() for a, _ in hists], pa.binary()), pa.array([v.tobytes() for _, v in hists], pa.binary())
