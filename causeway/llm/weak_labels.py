"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Only
the counts of vote patterns matter to expectation-maximisation, which finds each
labeller's rates of every vote given the hidden class, and the classes' shares:
at most ``3 ** labellers`` short rows reach the driver. The posterior of a pattern
is the soft label of its documents. On a bounded sample (``PER_SIDE`` documents
leaning either way) these labels train a linear scorer over hashed byte n-grams and
hashed bins of the text's shape, which then judges every whole text; a document is
kept if its score is at least ``KEEP``.

Null and empty texts score 0 and aren't kept. Texts are read whole, 2 MB of them at a
time or the one that is longer. Repeated rows are judged alike. Empty
tables give no rows. If all sampled labels lean one way, the posteriors themselves
are the scores. Extra columns are ignored by :func:`classify` and carried by
:func:`keep_good`. Gold labels are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm import linear, quality_rules
from causeway.llm.rows import column, map_rows, quoted, unused
from causeway.llm.textkernel import Texts, batches, mix
from causeway.shared import cut

PER_SIDE, KEEP = 1500, 0.5
GOOD, BAD, NONE = 1, 0, 2
_END = np.isin(np.arange(256), list(b".!?"))


def shape(texts: Texts) -> dict[str, np.ndarray]:
    """Ratios that describe a text's form."""
    m = quality_rules.measure(texts)
    start, end, first = texts.words()
    words = np.maximum(m["n_words"], 1)
    distinct, same, symbolic, shouted = (np.zeros(texts.n) for _ in range(4))
    if len(start):
        owner = np.repeat(np.arange(texts.n), np.diff(first))
        for out, flags in ((symbolic, quality_rules.IS_SYMBOL), (shouted, quality_rules.IS_CAPITAL)):
            total = np.concatenate([[0], np.cumsum(flags[texts.data])])
            n = total[end] - total[start]
            out[:] = np.bincount(owner[(n > 1) if out is shouted else (n > 0)], minlength=texts.n)
        codes = texts.spans(texts.prefix(), start, end)
        for i in range(texts.n):
            x = codes[first[i] : first[i + 1]]
            s = np.sort(x)
            distinct[i] = np.count_nonzero(s[1:] != s[:-1]) + 1 if len(s) else 0
            same[i] = np.count_nonzero(x[1:] == x[:-1])
    return {
        "words": m["n_words"].astype(float),
        "word_length": m["word_chars"] / words,
        "symbols": m["n_symbols"] / words,
        "symbol_words": symbolic / words,
        "symbol_share": m["n_symbols"] / np.maximum(m["word_chars"], 1),
        "capital_words": shouted / words,
        "dup_lines": m["n_dup_lines"] / np.maximum(m["n_lines"], 1),
        "repeats": m["n_repeat_words"] / words,
        "capitals": m["n_capitals"] / np.maximum(m["word_chars"], 1),
        "distinct": distinct / np.sqrt(words),
        "same_next": same / words,
        "ends": texts.sums(_END[texts.data]) / words if len(texts.data) else np.zeros(texts.n),
    }


#: name: (shape, bad if, good if). Several look at the same kind of junk, as the method wants them to overlap.
LABELLERS = {
    "length": ("words", lambda x: x < 1, lambda x: x >= 60),
    "word_length": ("word_length", lambda x: (x < 2.5) | (x > 11), lambda x: (x >= 3) & (x <= 9)),
    "symbols": ("symbols", lambda x: x > 0.25, lambda x: x < 0.08),
    "symbol_words": ("symbol_words", lambda x: x > 0.15, lambda x: x < 0.05),
    "symbol_share": ("symbol_share", lambda x: x > 0.04, lambda x: x < 0.015),
    "dup_lines": ("dup_lines", lambda x: x > 0.5, lambda x: x < 0.1),
    "repeats": ("repeats", lambda x: x > 0.65, lambda x: x < 0.1),
    "same_next": ("same_next", lambda x: x > 0.2, lambda x: x < 0.02),
    "distinct": ("distinct", lambda x: x < 1.5, lambda x: x > 3),
    "capitals": ("capitals", lambda x: x > 0.4, lambda x: x < 0.12),
    "capital_words": ("capital_words", lambda x: x > 0.5, lambda x: x < 0.2),
    "ends": ("ends", lambda x: (x < 0.005) | (x > 0.6), lambda x: (x >= 0.03) & (x <= 0.4)),
}
#: Below so many words the ratios say nothing, and only the length votes.
LEAST_WORDS = 8
#: What is believed of a labeller before any vote: the share of good documents that it calls bad, and how many documents that belief counts for, as a share of all.
PRIOR_WRONG, PRIOR_WEIGHT = 0.02, 0.02
#: Edges of the bins whose indices are hashed as features.
BINS = {"words": (5, 20, 60, 200), "word_length": (2.5, 3, 4, 6, 9, 11), "symbols": (0.01, 0.08, 0.25, 0.6), "symbol_words": (0.01, 0.05, 0.15, 0.4), "symbol_share": (0.005, 0.015, 0.04, 0.15), "capital_words": (0.05, 0.2, 0.5, 0.8), "dup_lines": (0.01, 0.05, 0.15, 0.3, 0.6), "repeats": (0.01, 0.1, 0.3, 0.65, 0.85), "capitals": (0.005, 0.12, 0.4, 0.8), "distinct": (1, 2, 4, 8), "same_next": (0.005, 0.02, 0.1, 0.2, 0.5), "ends": (0.005, 0.03, 0.15, 0.4, 0.6)}
SHAPE_BITS = 10


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, labellers) of GOOD, BAD, NONE."""
    out = np.stack([np.where(bad(s[x]), BAD, np.where(good(s[x]), GOOD, NONE)) for x, bad, good in LABELLERS.values()], 1)
    return np.where((s["words"] < LEAST_WORDS)[:, None] & (np.arange(out.shape[1]) > 0), NONE, out)


def shape_buckets(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, shapes): hashed buckets of (shape, bin)."""
    code = [mix(np.uint64(1000 * (i + 1)) + np.searchsorted(edges, s[x], "right").astype(np.uint64)) for i, (x, edges) in enumerate(BINS.items())]
    return (np.stack(code, 1) >> np.uint64(64 - SHAPE_BITS)).astype(np.int64)


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation over vote patterns: (posterior of good by pattern, share of good, rates[class, labeller] of a vote for bad).

    An abstention tells nothing. The prior says which class is the good one; votes of
    more than ``PRIOR_WEIGHT`` of all documents overrule it.
    """
    v = (patterns[:, None] // 3 ** np.arange(labellers)) % 3
    says = np.stack([v == BAD, v == GOOD], 2).astype(float)
    good, bad = says[:, :, 1].sum(1) + 1.0, says[:, :, 0].sum(1) + 0.25
    post = good / (good + 4 * bad)  # to begin with, a vote for bad is the rarer and surer one
    share, rates = 0.5, np.zeros((2, labellers))
    for _ in range(rounds):
        for c, q in ((0, 1 - post), (1, post)):
            n = (says * (q * counts)[:, None, None]).sum(0)
            wrong, total = (1.0, 2.0) if c == 0 else (1 + PRIOR_WRONG * PRIOR_WEIGHT * counts.sum(), 2 + PRIOR_WEIGHT * counts.sum())
            rates[c] = (n[:, 0] + wrong) / (n.sum(1) + total)
        share = float(np.clip((post * counts).sum() / counts.sum(), 1e-4, 1 - 1e-4))
        logs = [says[:, :, 0] @ np.log(r) + says[:, :, 1] @ np.log1p(-r) for r in rates]
        new = linear.sigmoid(logs[1] - logs[0] + np.log(share / (1 - share)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        if done:
            break
    return post, share, rates


class Model:
    """Posteriors by pattern, and the linear scorer where one could be trained."""

    def __init__(self, posterior: dict[int, float], grams=None, shapes=None, bias=None):
        self.posterior, self.grams, self.shapes, self.bias = posterior, grams, shapes, bias

    def score(self, texts: Texts) -> np.ndarray:
        s = shape(texts)
        if self.grams is None:
            out = np.array([self.posterior.get(int(p), 0.5) for p in pattern(votes(s))])
        else:
            out = linear.sigmoid(linear.score(texts, self.grams, self.bias, lower=False)[:, 0] + linear.SCALE * self.shapes[shape_buckets(s)].sum(1) / len(BINS))
        return np.where(s["words"] > 0, out, 0.0)


def train(docs: DataFrame, per_side: int = PER_SIDE) -> tuple[Model, dict]:
    """Votes of all documents, then features of at most about ``2 * per_side``."""

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [pattern(votes(shape(t))) for t in batches(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0, np.int64), pa.int64())], ["doc_id", "pattern"])

    cast = cut(docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, pattern long"))
    seen = cast.groupBy("pattern").count().orderBy("pattern").toPandas()
    if not len(seen):
        return Model({}), {}
    patterns = seen["pattern"].to_numpy()
    post, share, rates = estimate(patterns, seen["count"].to_numpy(float), len(LABELLERS))
    posterior = dict(zip(patterns.tolist(), post.tolist()))
    report = {"share_good": share, "bad_votes": {name: rates[:, i].round(4).tolist() for i, name in enumerate(LABELLERS)}}
    if (post >= 0.5).all() or (post < 0.5).all():
        return Model(posterior), report
    bad_patterns = [p for p, q in posterior.items() if q < 0.5]
    leaning = cast.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("pattern").alias("pattern")).withColumn("side", F.when(F.col("pattern").isin(bad_patterns), 0).otherwise(1))
    sample = linear.bounded_sample(leaning, "side", per_side, "weak-labels")

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hists, shapes = [], []
            for t in batches(column(batch, "text")):
                hists += linear.histograms(t, lower=False)
                shapes += [x.tobytes() for x in shape_buckets(shape(t))]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "pattern", "sample_weight")), *linear.packed(hists), pa.array(shapes, pa.binary())], ["doc_id", "pattern", "sample_weight", "at", "freq", "shapes"])

    got = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "pattern", "sample_weight", "text").mapInArrow(features, "doc_id long, pattern long, sample_weight double, at binary, freq binary, shapes binary").toPandas()
    got = got.sort_values(["doc_id", "at"]).drop_duplicates("doc_id")
    x = np.zeros((len(got), linear.BUCKETS + (1 << SHAPE_BITS)), np.float32)
    for i, (a, f, s) in enumerate(zip(got["at"], got["freq"], got["shapes"])):
        x[i, np.frombuffer(a, np.uint16)] = np.frombuffer(f, np.float32)
        np.add.at(x[i], linear.BUCKETS + np.frombuffer(s, np.int64), 1 / len(BINS))
    y = np.array([posterior[p] for p in got["pattern"]], np.float32)[:, None]
    weights, bias = linear.fit(x, y, got["sample_weight"].to_numpy(), rate=0.05)
    return Model(posterior, weights[: linear.BUCKETS], weights[linear.BUCKETS :, 0], bias), report


def _scored(docs: DataFrame, model: Model, score: str) -> DataFrame:
    """``docs`` (any columns, text among them) and a column ``score``."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [ship.value.score(t) for t in batches(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], [*batch.schema.names, score])

    return map_rows(docs, run, T.StructField(score, T.DoubleType()))


def classify(docs: DataFrame, text="text", doc_id="doc_id", **bounds) -> DataFrame:
    """(doc_id, score, kept) of every document."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model, _ = train(docs, **bounds)
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [ship.value.score(t) for t in batches(column(batch, "text"))]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double").withColumn("kept", F.col("score") >= KEEP)


def keep_good(docs: DataFrame, **bounds) -> DataFrame:
    """The documents that are kept, all columns as given."""
    model, _ = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), **bounds)
    (score,) = unused(docs.columns, "quality_score")
    return _scored(docs, model, score).where(F.col(score) >= KEEP).select(*map(quoted, docs.columns))
