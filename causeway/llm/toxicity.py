"""Toxicity by multiple-instance learning.

A document is a bag of sentences (cut at ``.``, ``!``, ``?`` and line ends). A
sentence's score is a logistic model over its hashed lower-cased words and their
beginnings (``STEMS`` bytes, for inflected words); the document's is their
noisy-or, 1 - prod(1 - p). Only document labels are known: their likelihood is
raised by gradient steps through the noisy-or, on a bounded sample (``PER_LABEL``
documents of each label, weighed back to the true shares). Features whose presence
isn't associated with the label beyond chance (G-test below ``MIN_G``, set for
hundreds of thousands of features) or that are seen in fewer than ``MIN_DOCS``
sampled documents stay neutral. Scored documents also tell their most offending
sentence (byte span) and the number of sentences at or above one half.

Null and empty texts have no sentence: score 0. Without labels of both kinds all
scores are 0. A document labelled more than once is toxic if any label says so.
Repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import linear
from causeway.llm.rows import column, held_out
from causeway.llm.textkernel import LOWER, Texts, batches, mix
from causeway.shared import cut

PER_LABEL, MIN_DOCS, MIN_G, BITS = 2500, 4, 24.0, 20
STEMS = (3, 4, 5, 6)
ENDS = b".!?\n\r"

_END = np.isin(np.arange(256), list(ENDS))
_NOT_WORD = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def bag(texts: Texts, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of words and stems, their sentences, text of each sentence, each sentence's first word).

    Sentences without words don't count. ``use``: the buckets that matter.
    """
    if not len(texts.data):
        return (np.zeros(0, np.int64),) * 4
    data = LOWER[texts.data]
    start, end, first = texts.runs(_NOT_WORD[data])
    prefix = texts.prefix(data)
    ends = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_END[data], out=ends[1:])
    owner = np.repeat(np.arange(texts.n), np.diff(first))
    new = np.ones(len(start), bool)
    new[1:] = (np.diff(ends[start]) > 0) | (np.diff(owner) > 0)
    sentence, buckets, of = np.cumsum(new) - 1, [], []
    for k in (0, *STEMS):
        some = np.flatnonzero(end - start > k)
        code = texts.spans(prefix, start[some], start[some] + k if k else end[some])
        bucket = (mix(code + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        if use is not None:
            kept = use[bucket]
            bucket, some = bucket[kept], some[kept]
        buckets.append(bucket)
        of.append(sentence[some])
    return np.concatenate(buckets), np.concatenate(of), owner[new], np.flatnonzero(new)


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: Texts) -> dict[str, np.ndarray]:
        n = texts.n
        out = {"score": np.zeros(n), "n_sentences": np.zeros(n, np.int64), "n_offending": np.zeros(n, np.int64), "worst": np.full(n, -1), "worst_score": np.zeros(n), "worst_start": np.full(n, -1), "worst_end": np.full(n, -1)}
        bucket, sentence, owner, first = bag(texts, None if self.weights is None else self.weights != 0)
        if self.weights is None or not len(owner):
            return out
        p = linear.sigmoid(np.bincount(sentence, self.weights[bucket], len(owner)) + self.bias)
        out["score"] = -np.expm1(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
        out["n_sentences"] = np.bincount(owner, minlength=n)
        out["n_offending"] = np.bincount(owner[p >= 0.5], minlength=n)
        order = np.lexsort((np.arange(len(owner)), -p, owner))
        top = order[np.concatenate([[True], np.diff(owner[order]) > 0])]
        begins, ends, _ = texts.runs(_NOT_WORD[texts.data])
        last = np.append(first[1:], len(begins)) - 1
        who = owner[top]
        out["worst"][who] = top - np.searchsorted(owner, who)
        out["worst_score"][who] = p[top]
        out["worst_start"][who] = begins[first[top]] - texts.at[who]
        out["worst_end"][who] = ends[last[top]] - texts.at[who]
        return out


def associated(docs_of: np.ndarray, toxic_of: np.ndarray, share: float, min_docs: int = MIN_DOCS, min_g: float = MIN_G) -> np.ndarray:
    """Which features' document counts differ between the labels beyond chance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(k > 0, k * np.log(k / (docs_of * q)), 0.0) for k, q in ((toxic_of, share), (docs_of - toxic_of, 1 - share)))
    return (docs_of >= min_docs) & (g >= min_g)


def fit(bucket: np.ndarray, sentence: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> Model:
    """Gradient steps (Adam) on the noisy-or likelihood of bags."""
    n_docs, n_s = len(y), len(owner)
    names, word = np.unique(bucket, return_inverse=True)
    w, b = np.zeros(len(names)), -5.0
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        p = np.clip(linear.sigmoid(np.bincount(sentence, w[word], n_s) + b), 1e-9, 1 - 1e-9)
        whole = np.clip(-np.expm1(np.bincount(owner, np.log1p(-p), n_docs)), 1e-9, 1 - 1e-9)
        pull = np.where(y > 0, -(1 - whole) / whole, 1.0) * weight
        g = pull[owner] * p
        d, db = np.bincount(word, g[sentence], len(names)) + decay * w / n_docs, g.sum()
        m += 0.1 * (d - m)
        v += 0.001 * (d * d - v)
        mb += 0.1 * (db - mb)
        vb += 0.001 * (db * db - vb)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-7)
    weights = np.zeros(1 << BITS)
    weights[names] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """At most about ``per_label`` documents of each label are used.

    Executors count features (one number per bucket and label comes back), then
    send the sampled bags, reduced to the associated buckets.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = linear.bounded_sample(known, "toxic", per_label, "toxicity")
    rows = cut(docs.select("doc_id", "text").join(sample, "doc_id").groupBy("doc_id", "toxic", "sample_weight").agg(F.min("text").alias("text")))
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model(None, 0.0)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in it:
            toxic = (column(batch, "toxic").to_numpy() > 0).astype(int)
            for t in batches(column(batch, "text")):
                bucket, sentence, owner, _ = bag(t)
                pairs = np.unique(owner[sentence] * (1 << BITS) + bucket)
                np.add.at(total, (toxic[t.first + (pairs >> BITS)], pairs & ((1 << BITS) - 1)), 1)
        seen = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0, seen]), pa.array(total[1, seen])], ["bucket", "clean", "toxic"])

    counts = rows.select("toxic", "text").mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= MIN_DOCS).toPandas()
    use = np.zeros(1 << BITS, bool)
    use[counts["bucket"].to_numpy()] = associated((counts["clean"] + counts["toxic"]).to_numpy(float), counts["toxic"].to_numpy(float), totals[1] / (totals[0] + totals[1]))

    def bags(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = []
            for t in batches(column(batch, "text")):
                bucket, sentence, owner, _ = bag(t, use)
                first = np.searchsorted(owner, np.arange(t.n + 1))
                order = np.argsort(sentence, kind="stable")
                bucket, sentence = bucket[order], sentence[order]
                cuts = np.searchsorted(sentence, first)
                found += [(bucket[a:b].astype(np.int32).tobytes(), (sentence[a:b] - first[i]).astype(np.int32).tobytes(), int(first[i + 1] - first[i])) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("doc_id", "toxic", "sample_weight")), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int64())))], ["doc_id", "toxic", "sample_weight", "words", "sentences", "n"])

    got = rows.mapInArrow(bags, "doc_id long, toxic int, sample_weight double, words binary, sentences binary, n long").toPandas().sort_values("doc_id")
    n = got["n"].to_numpy()
    at = np.cumsum(n) - n
    words = np.frombuffer(b"".join(got["words"]), np.int32).astype(np.int64)
    sentences = np.concatenate([np.frombuffer(s, np.int32) + a for s, a in zip(got["sentences"], at)]).astype(np.int64)
    return fit(words, sentences, np.repeat(np.arange(len(n)), n), got["toxic"].to_numpy(), got["sample_weight"].to_numpy())


_OUT = {"score": "double", "predicted": "int", "n_sentences": "long", "n_offending": "long", "worst": "long", "worst_score": "double", "worst_start": "long", "worst_end": "long"}


def apply(docs: DataFrame, model: Model) -> DataFrame:
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [ship.value.score(t) for t in batches(column(batch, "text"))]
            cols = {c: np.concatenate([f[c] for f in found]) if found else np.zeros(0) for c in _OUT if c != "predicted"}
            cols["predicted"] = cols["score"] >= 0.5
            types = {"double": pa.float64(), "int": pa.int32(), "long": pa.int64()}
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), *(pa.array(cols[c]).cast(types[t]) for c, t in _OUT.items())], ["doc_id", "held_out", *_OUT])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{c} {t}" for c, t in _OUT.items()))


def detect(docs: DataFrame, labels: DataFrame, text="text", doc_id="doc_id", **bounds) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return apply(docs, train(docs, labels, **bounds))
