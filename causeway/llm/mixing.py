"""Mixing sources to target weights (DataFrame functions only).

Tokens are summed per source, target totals are filled up by weight under a cap
of ``cap`` times a source's size, and each document is emitted ``floor(rate)``
times plus one more with probability ``rate - floor(rate)``, drawn from a hash of
the seed and its id, so that reruns and retried tasks agree.

One row per source and task is shuffled, documents aren't: the table of sources is
made first and broadcast if its measured size allows. With too many sources for that,
documents and sources meet in shares of each source, so a hot one is not one task's.

Null or empty texts have size 0 and take nothing. A null source is a source of
its own, last in order. Repeated rows with one id share their draw. Extra columns
are ignored by :func:`plan_mix` and carried by :func:`emit_mix`, whatever their names. Empty tables give
empty results. If all sizes are 0, so are all targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.rows import quoted, unused
from causeway.shared import cut

#: Fixed values of the contract: weights in turn, and how often a source is used at most.
WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-1"
#: The table of sources is broadcast up to this many bytes; beyond, rows and sources meet in this many shares of each source.
BROADCAST_BYTES, SALTS = 8 << 20, 32

SPACES = "[\\x20\\x09-\\x0D]"
WORDS = "[^\\x20\\x09-\\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs outside ``[\\x20\\x09-\\x0D]``: each run and the space behind it becomes one letter."""
    bare = F.regexp_replace(text, f"^{SPACES}++", "")
    return F.coalesce(F.length(F.regexp_replace(bare, f"{WORDS}++{SPACES}*+", "x")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(mix_source, source_size, target): capped water filling over one row per source.

    Taken in ascending order of ``cap * size / weight``, a source stops at its cap
    as long as what remains, shared by the weights that remain, would exceed it.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    turn = Window.orderBy(F.col("mix_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")).cast("long")
    per = per.withColumn("w", weight).withColumn("most", cap * F.col("source_size"))
    rising = Window.orderBy((F.col("most") / F.col("w")).asc(), F.col("mix_source").asc_nulls_last())
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0))
    rest_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("full", F.col("w") * rest > F.col("most") * rest_w)
    free = F.sum("source_size").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(whole), F.lit(0))
    free_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(whole)
    share = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("w") * free / free_w)
    return per.select("mix_source", "source_size", F.coalesce(share, F.lit(0.0)).alias("target"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 48 bits of md5(seed:id)."""
    code = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(code, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def _with_targets(docs: DataFrame, targets: DataFrame, text: str, source: str, doc_id: str, broadcast_bytes: int) -> DataFrame:
    """``docs`` left-joined to their source's row of ``targets`` (its first column).

    Left to the planner, whole documents are shuffled by source before it sees that the
    other side is small. So that side is measured: within ``broadcast_bytes`` no document
    moves, beyond that a source's documents are dealt to ``SALTS`` shares by id and text.
    """
    of = targets.columns[0]
    width = targets.agg(F.sum(F.coalesce(F.octet_length(F.col(of).cast("string")), F.lit(0)) + 64)).first()[0] or 0
    same = quoted(source).eqNullSafe(F.col(of))
    if width <= broadcast_bytes:
        return docs.join(F.broadcast(targets), same, "left")
    salt, of_salt = unused([*docs.columns, *targets.columns], "mix_salt", "mix_of_salt")
    shares = targets.withColumn(of_salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = docs.withColumn(salt, F.pmod(F.xxhash64(quoted(doc_id), quoted(text)), F.lit(SALTS)).cast("int"))
    return dealt.join(shares, same & (F.col(salt) == F.col(of_salt)), "left").drop(salt, of_salt)


def _with_copies(docs: DataFrame, text: str, source: str, doc_id: str, weights, cap, seed, broadcast_bytes) -> tuple[DataFrame, list[str]]:
    """``docs`` and columns (names given back) for size, source_size, target and copies."""
    size, of, total, target, copies = names = unused(docs.columns, "mix_size", "mix_of", "mix_source_size", "mix_target", "mix_copies")
    rows = docs.select(quoted(source).alias("mix_source"), word_count(quoted(text)).alias("mix_size"))
    targets = cut(source_targets(rows, weights, cap)).toDF(of, total, target)
    joined = _with_targets(docs.withColumn(size, word_count(quoted(text))), targets, text, source, doc_id, broadcast_bytes)
    rate = F.when(F.col(total) > 0, F.least(F.col(target) / F.col(total), F.lit(float(cap)))).otherwise(0.0)
    times = F.floor(rate) + (draw(quoted(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(copies, F.when(F.col(size) > 0, times).otherwise(F.lit(0)).cast("long")), [size, total, target, copies]


def plan_mix(docs: DataFrame, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, cap=CAP, seed=SEED, broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    docs = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), quoted(source).alias("source"))
    out, (size, total, target, copies) = _with_copies(docs, "text", "source", "doc_id", weights, cap, seed, broadcast_bytes)
    return out.select("doc_id", F.col(size).alias("size"), F.col(total).alias("source_size"), F.col(target).alias("target"), (F.col(size) * F.col(copies)).alias("taken"), F.col(copies).alias("copies"))


def emit_mix(docs: DataFrame, text="text", source="source", doc_id="doc_id", weights=WEIGHTS, cap=CAP, seed=SEED, broadcast_bytes=BROADCAST_BYTES) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; columns as given."""
    out, (*_, copies) = _with_copies(docs, text, source, doc_id, weights, cap, seed, broadcast_bytes)
    names = [quoted(c) for c in docs.columns]
    (turn,) = unused(docs.columns, "mix_turn")
    return out.where(F.col(copies) > 0).select(*names, F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int"))).alias(turn)).select(*names)


def oracle(weights=WEIGHTS, cap=CAP, seed=SEED) -> str:
    case = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return f"""
WITH d AS (SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (SELECT source, CAST(SUM(size) AS BIGINT) AS s, CAST({cap} * SUM(size) AS BIGINT) AS most FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(weights)} {case} END AS BIGINT) AS w FROM p),
r AS (SELECT *, SUM(s) OVER () AS total, SUM(w) OVER () AS total_w,
  COALESCE(SUM(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
  COALESCE(SUM(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bw FROM w),
f AS (SELECT *, w * (total - b) > most * (total_w - bw) AS is_full FROM r),
t AS (SELECT source, s, COALESCE(CASE WHEN is_full THEN CAST(most AS DOUBLE)
  ELSE CAST(w * (total - COALESCE(SUM(most) FILTER (WHERE is_full) OVER (), 0)) AS DOUBLE) / CAST(SUM(w) FILTER (WHERE NOT is_full) OVER () AS DOUBLE) END, 0.0) AS target FROM f),
j AS (SELECT d.doc_id, d.size, t.s AS source_size, t.target, CASE WHEN t.s > 0 THEN LEAST(t.target / t.s, {float(cap)}) ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('{seed}:' || COALESCE(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) / {float(1 << 48)} AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * c AS BIGINT) AS taken, c AS copies FROM (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END AS c FROM j) AS x
"""
