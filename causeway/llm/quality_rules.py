"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

Every text gets counts (words, symbols, repeated lines and passages). A rule
compares one ratio of them with a cutoff. Each cutoff of a fixed grid is tested
per stratum on labelled documents: the null hypothesis is that it rejects more
than ``risk / rules`` of the good ones, its p-value the exact binomial tail
P(Bin(n_good, risk / rules) <= good ones rejected). Holm's correction over all
strata, rules and cutoffs bounds the chance that any accepted cutoff breaks its
limit by ``delta``; a union bound over the rules then limits the false
rejections of a stratum to ``risk``. Among accepted cutoffs the one is used that
rejects the most bad documents, a good one weighing ``price`` bad ones, and the
loosest on ties; a rule with no accepted, useful cutoff rejects nothing.

Null and empty texts have zero counts and fail the base rule. Texts are read whole, 2 MB
of them at a time or the one that is longer. A null stratum is a
stratum of its own. Repeated rows are judged alike, each row once. A document
labelled more than once counts as bad if any label says so. Empty tables and
tables without labels give the base rule alone. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.rows import column
from causeway.llm.textkernel import LEADS, SPACE, Texts, batches, windows
from causeway.shared import cut

#: Fixed values of the contract.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

RISK, DELTA, PRICE, MIN_GOOD = 0.02, 0.05, 5.0, 100
GRID = (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9, 1.0)
#: Ratios that rise with bad quality, as SQL over the counts.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")

IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
IS_CAPITAL = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))


def _repeats(texts: Texts, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: words, and words inside 8-word windows found twice or more."""
    start, end, first = texts.words()
    n_words, out = np.diff(first), np.zeros(texts.n, np.int64)
    codes, at = windows(texts.spans(prefix, start, end), first, WINDOW)
    for i in np.flatnonzero(n_words > WINDOW):
        x = codes[at[i] : at[i + 1]]
        order = np.argsort(x)
        same = x[order][1:] == x[order][:-1]
        if same.any():
            twice = np.zeros(len(x), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n_words[i] + 1, np.int64)
            edge[:-WINDOW][twice] += 1
            edge[WINDOW:][twice] -= 1
            out[i] = np.count_nonzero(np.cumsum(edge[:-1]))
    return n_words, out


def _lines(texts: Texts, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and those equal to an earlier line."""
    start, end, first = texts.runs(texts.data == 0x0A)
    words = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(~SPACE[texts.data], out=words[1:])
    owner = np.repeat(np.arange(texts.n), np.diff(first))
    full = words[end] > words[start]
    owner, codes = owner[full], texts.spans(prefix, start[full], end[full])
    order = np.lexsort((codes, owner))
    same = (codes[order][1:] == codes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner, minlength=texts.n), np.bincount(owner[order][1:][same], minlength=texts.n)


def measure(texts: Texts) -> dict[str, np.ndarray]:
    if not len(texts.data):
        return {c: np.zeros(texts.n, np.int64) for c in COUNTS}
    prefix, data = texts.prefix(), texts.data
    n_words, repeated = _repeats(texts, prefix)
    n_lines, dup = _lines(texts, prefix)
    chars = texts.sums(LEADS[data] & ~SPACE[data])
    return {"n_words": n_words, "word_chars": chars, "n_symbols": texts.sums(IS_SYMBOL[data]), "n_dup_lines": dup, "n_repeat_words": repeated, "n_lines": n_lines, "n_capitals": texts.sums(IS_CAPITAL[data])}


def statistics(docs: DataFrame, text="text", doc_id="doc_id", stratum="lang") -> DataFrame:
    """Counts per document, in one pass over the texts, without a shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [measure(t) for t in batches(column(batch, "text"))]
            cols = [np.concatenate([f[c] for f in found]).astype(np.int64) if found else np.zeros(0, np.int64) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "stratum"), *map(pa.array, cols)], ["doc_id", "stratum", *COUNTS])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed from k downwards until the terms, which fall there if k < n p, no longer count."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = term = 1.0
    for x in range(k, 0, -1):
        term *= x * (1 - p) / ((n - x + 1) * p)
        total += term
        if term < 1e-17 * total and x < (n + 1) * p:
            break
    return min(1.0, math.exp(log + math.log(total)))


def choose(counts: dict, risk=RISK, delta=DELTA, price=PRICE) -> dict:
    """{(stratum, rule): cutoff} from {(stratum, rule, cutoff): (good, good rejected, bad rejected)}."""
    limit, tests = risk / len(RULES), []
    for key, (n, k, bad) in counts.items():
        p = 1.0 if k >= limit * n else binomial_tail(k, n, limit)
        tests.append((p, key, k, bad))
    tests.sort(key=lambda t: (t[0], str(t[1])))
    best: dict = {}
    for i, (p, (stratum, rule, cutoff), k, bad) in enumerate(tests):
        if p > delta / (len(tests) - i):  # Holm: here and below nothing is accepted
            break
        gain = bad - price * k
        if gain > 0 and (gain, cutoff) > best.get((stratum, rule), (0, 0)):
            best[stratum, rule] = (gain, cutoff)
    return {key: cutoff for key, (_, cutoff) in best.items()}


def calibrate(stats: DataFrame, labels: DataFrame, risk=RISK, delta=DELTA, price=PRICE, min_good=MIN_GOOD) -> dict:
    """Cutoffs from all labelled documents that pass the base rule.

    One row per stratum with ``min_good`` good labels or more reaches the driver,
    so at most (labels / min_good) short rows; other strata get no cutoffs.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known, "doc_id")
    good, sums = F.col("quality") == 1, []
    for rule, ratio in RULES.items():
        for i, c in enumerate(GRID):
            over = F.expr(ratio) > c
            sums += [F.count_if(over & good).alias(f"{rule}_{i}_good"), F.count_if(over & ~good).alias(f"{rule}_{i}_bad")]
    per = rows.groupBy("stratum").agg(F.count_if(good).alias("good"), *sums).where(F.col("good") >= min_good).collect()
    counts = {(r["stratum"], rule, c): (r["good"], r[f"{rule}_{i}_good"], r[f"{rule}_{i}_bad"]) for r in per for rule in RULES for i, c in enumerate(GRID)}
    return choose(counts, risk, delta, price)


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(stats: DataFrame, cutoffs: dict) -> DataFrame:
    """base_failed, kept and the rules that a document breaks."""
    strata = sorted({s for s, _ in cutoffs}, key=lambda s: (s is None, s or ""))
    spark = stats.sparkSession
    table = spark.createDataFrame([(s, *(float(cutoffs[s, r]) if (s, r) in cutoffs else None for r in RULES)) for s in strata], "cut_of string, " + ", ".join(f"cut_{r} double" for r in RULES))
    rows = stats.join(table, stats["stratum"].eqNullSafe(table["cut_of"]), "left")
    broken = F.filter(F.array(*[F.when(F.expr(ratio) > F.col(f"cut_{r}"), F.lit(r)) for r, ratio in RULES.items()]), lambda x: x.isNotNull())
    rows = rows.withColumn("base_failed", base_failed()).withColumn("broken_rules", F.array_join(broken, ","))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("broken_rules") == ""))


def apply_rules(docs: DataFrame, labels: DataFrame, **risks) -> DataFrame:
    stats = cut(statistics(docs))
    return judge(stats, calibrate(stats, labels, **risks)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken_rules")
