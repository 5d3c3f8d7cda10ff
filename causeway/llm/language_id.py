"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary n-gram classifier per bit is fitted on
a bounded sample of training documents (``PER_LANGUAGE`` of each language). A text
gets the language whose codeword has the least total logistic loss against the
bits' margins, each bit weighed by its training accuracy. The score is the softmax
of the negative losses; a text whose best two languages are closer than ``MARGIN``
is flagged as ambiguous.

Null texts and texts without a letter are ``und`` with score 0. Training uses only
non-null languages of documents outside the held-out fifth; without any, all texts
are ``und``. Rows repeat in the result as often as in the table; extra columns are
ignored; a null doc_id is predicted but never trained on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm import linear
from causeway.llm.rows import column, held_out
from causeway.llm.textkernel import Texts, batches

PER_LANGUAGE, MAX_TRAIN = 700, 4000
MARGIN = 0.2
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def codewords(k: int) -> np.ndarray:
    """(k, bits) of +-1: all distinct splits for up to five languages, else rows of a Sylvester-Hadamard matrix."""
    if k <= 1:
        return np.ones((k, 1), int)
    if k <= 5:
        return np.array([[1] * (2 ** (k - 1) - 1)] + [[1 if (s >> j) & 1 else -1 for s in range(2 ** (k - 1) - 1)] for j in range(k - 1)])
    h = np.ones((1, 1), int)
    while len(h) <= k:
        h = np.block([[h, h], [h, -h]])
    return h[1 : k + 1, 1:]  # every two rows differ in half of the bits


def has_letter(texts: Texts) -> np.ndarray:
    out = texts.sums(_ASCII_LETTER[texts.data]) > 0
    for i in np.flatnonzero(~out & (texts.sums(texts.data >= 128) > 0)):
        out[i] = any(map(str.isalpha, texts.text(i).decode("utf-8", "replace")))
    return out


class Model:
    def __init__(self, languages: list[str], codes: np.ndarray, trust: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.languages, self.codes, self.trust, self.weights, self.bias = languages, codes, trust, weights, bias

    def predict(self, texts: Texts) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each text."""
        known = has_letter(texts)
        if not self.languages:
            return [UNKNOWN] * texts.n, np.zeros(texts.n), np.zeros(texts.n, bool)
        margins = linear.score(texts, self.weights, self.bias)
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.trust).sum(1) for c in self.codes], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, 1)
        close = known & (top[:, -1] - top[:, -2] < MARGIN) if len(self.languages) > 1 else np.zeros(texts.n, bool)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)], np.where(known, p.max(1), 0.0), close


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN) -> Model:
    """``docs`` has doc_id, text, lang. At most about ``max_train`` documents' n-gram counts reach the driver."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = max(1, rows.select("lang").distinct().count())
    sample = linear.bounded_sample(rows, "lang", min(per_language, max(1, max_train // n)), "language-id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            hists = [h for t in batches(column(batch, "text")) for h in linear.histograms(t)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "lang"), *linear.packed(hists)], ["doc_id", "lang", "at", "freq"])

    got = sample.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, at binary, freq binary").toPandas().sort_values(["doc_id", "lang", "at"])
    languages = sorted(set(got["lang"]))
    codes = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, codes, np.ones(1), np.zeros((linear.BUCKETS, 1)), np.ones(1))
    x = linear.dense([(np.frombuffer(a, np.uint16), np.frombuffer(f, np.float32)) for a, f in zip(got["at"], got["freq"])])
    y = (codes[np.array([languages.index(v) for v in got["lang"]])] > 0).astype(np.float32)
    weights, bias = linear.fit(x, y)
    right = (((linear.SCALE * (x @ weights) + bias) > 0) == (y > 0)).mean(0)
    return Model(languages, codes, np.maximum(right - 0.5, 0.01) * 2, weights, bias)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous); the model's size is fixed by its parameters."""
    ship = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [ship.value.predict(t) for t in batches(column(batch, "text"), 1 << 19)]
            lang = [x for f in found for x in f[0]]
            score, close = (np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(close.astype(bool))], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, text="text", doc_id="doc_id", lang="lang", **bounds) -> DataFrame:
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    return predict(docs, train(docs, **bounds))
