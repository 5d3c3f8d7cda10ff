"""Cone sizes and costs, structural deltas, correlation and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import paths
from causeway.operators import recurse
from causeway.shared import cut


def cone_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, forward, reverse): how many nodes each reaches and is reached by; no pairs are made of islands that fit a task."""
    n = recurse.reach_counts(edges)
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("forward", F.lit(0)).cast("long").alias("forward"), F.coalesce("reverse", F.lit(0)).cast("long").alias("reverse"))


def upper_median(column: str, rows: DataFrame) -> DataFrame:
    """(median): the value at floor(n / 2) in ascending order, from a histogram of values."""
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    below = F.sum("c").over(Window.orderBy("v"))
    return counts.withColumn("b", below).crossJoin(F.broadcast(total)).where(F.col("b") > F.floor(F.col("t") / 2)).agg(F.min("v").alias("median"))


def cone_stats(sizes: DataFrame, column: str = "forward") -> DataFrame:
    """One row (mean to two places, median, max); zeros for no rows."""
    stats = sizes.agg(F.round(F.coalesce(F.avg(column), F.lit(0.0)), 2).alias("mean"), F.coalesce(F.max(column), F.lit(0)).alias("max"))
    return stats.crossJoin(F.broadcast(upper_median(column, sizes))).select("mean", F.coalesce("median", F.lit(0)).alias("median"), "max")


def cone_cost(nodes: DataFrame, closed: DataFrame) -> DataFrame:
    """(id, cone_loc, cone_bytes, est_tokens): a node's own size and that of its forward cone; ``nodes`` has loc and bytes."""
    size = nodes.select(F.col("id").alias("dst"), "loc", "bytes")
    below = closed.join(size, "dst").groupBy(F.col("src").alias("id")).agg(F.sum("loc").alias("l"), F.sum("bytes").alias("b"))
    out = nodes.select("id", "loc", "bytes").join(below, "id", "left")
    out = out.select("id", (F.col("loc") + F.coalesce("l", F.lit(0))).cast("long").alias("cone_loc"), (F.col("bytes") + F.coalesce("b", F.lit(0))).cast("long").alias("cone_bytes"))
    return out.withColumn("est_tokens", paths.tokens_of_bytes("cone_bytes"))


def economics(nodes: DataFrame, closed: DataFrame, contract_tokens: str = "contract", default_tokens: int = 126) -> DataFrame:
    """One row of means per file: tokens of a cone's source, of its ids, of its contracts; ``nodes`` has id, tokens and contract tokens or null."""
    rows = nodes.select(F.col("id").alias("dst"), "tokens", F.coalesce(F.col(contract_tokens), F.lit(default_tokens)).alias("contract"), paths.tokens_of_text(F.col("id").cast("string")).alias("name"))
    per = closed.join(rows, "dst").groupBy("src").agg(F.sum("tokens").alias("source"), F.sum("name").alias("ids"), F.sum("contract").alias("contracts"))
    all_ = nodes.select(F.col("id").alias("src")).join(per, "src", "left")
    return all_.agg(*[F.round(F.avg(F.coalesce(c, F.lit(0))), 4).alias(c) for c in ("source", "ids", "contracts")])


def structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: files, edges, file cycles and forward cone statistics."""
    counts = nodes.agg(F.count("*").alias("files")).crossJoin(F.broadcast(edges.agg(F.count("*").alias("edges"))))
    loops = recurse.cycles(edges).agg(F.count("*").alias("cycles"))
    return counts.crossJoin(F.broadcast(loops)).crossJoin(F.broadcast(cone_stats(cone_sizes(nodes, edges))))


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two one-row structures; a cycle was introduced if their number rose."""
    names = before.columns
    both = before.select(*[F.col(c).alias(f"b_{c}") for c in names]).crossJoin(F.broadcast(after))
    return both.select(*[F.round(F.col(c) - F.col(f"b_{c}"), 2).alias(f"d_{c}") for c in names], (F.col("cycles") > F.col("b_cycles")).alias("introduced_cycle"))


def average_ranks(rows: DataFrame, column: str, by: str, to: str) -> DataFrame:
    """``rows`` and their rank within ``by``, ties sharing their mean.

    Ranks are those of distinct values: counted per value before anything is moved,
    numbered range by range (``edges.positions``' way), and joined back by value.
    """
    counts = cut(rows.groupBy(by, column).agg(F.count("*").alias("c")).repartitionByRange(by, column).sortWithinPartitions(by, column).withColumn("range", F.spark_partition_id()))
    per = counts.groupBy(by, "range").agg(F.sum("c").alias("n"))
    before = per.select(F.col(by).alias("before_by"), F.col("range").alias("before_range"), (F.sum("n").over(Window.partitionBy(by).orderBy("range")) - F.col("n")).alias("before"))
    inside = F.sum("c").over(Window.partitionBy(by, "range").orderBy(column)) - F.col("c")
    ranks = counts.withColumn("below", inside).join(before, F.col(by).eqNullSafe(F.col("before_by")) & (F.col("range") == F.col("before_range"))).select(F.col(by).alias("rank_by"), F.col(column).alias("rank_of"), (F.col("before") + F.col("below") + 1 + (F.col("c") - 1) / 2.0).alias(to))
    return rows.join(ranks, F.col(by).eqNullSafe(F.col("rank_by")) & (F.col(column) == F.col("rank_of"))).drop("rank_by", "rank_of")


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns; null where one doesn't vary (``corr`` itself fails there under ANSI rules)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """(by, n, pearson, r2, spearman, slope, intercept); null where a side doesn't vary."""
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_ranks(average_ranks(ranked, x, by, "rx"), y, by, "ry")
    out = ranked.groupBy(by).agg(F.count("*").alias("n"), pearson(x, y).alias("pearson"), pearson("rx", "ry").alias("spearman"), F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"))
    return out.withColumn("r2", F.col("pearson") * F.col("pearson"))


def stratified_pick(rows: DataFrame, order: str, key: str, n: int) -> DataFrame:
    """Rows at floor((i + 0.5) * count / n) in ascending order, i = 0 .. n - 1.

    Places come from counts per value (small) and a rank within a value, so no
    single task sorts all rows.
    """
    counts = rows.groupBy(F.col(order).alias("v")).agg(F.count("*").alias("c"))
    before = counts.select("v", (F.sum("c").over(Window.orderBy("v")) - F.col("c")).alias("before"))
    total = counts.agg(F.sum("c").alias("t"))
    placed = rows.join(before, rows[order] == before["v"]).withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("v").orderBy(key)) - 1)
    wanted = total.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"), "t").select(F.floor((F.col("i") + 0.5) * F.col("t") / n).alias("place")).where("t > 0").distinct()
    return placed.join(F.broadcast(wanted), "place").select(*rows.columns, "place")


def cone_table(nodes: DataFrame, sizes: DataFrame, costs: DataFrame) -> DataFrame:
    """(file, loc, bytes, forwardCone, reverseCone, coneLoc, coneBytes, estTokens), cheapest first: what ``trees.write_cones`` writes."""
    rows = nodes.select("id", "loc", "bytes").join(sizes, "id").join(costs, "id")
    names = {"id": "file", "loc": "loc", "bytes": "bytes", "forward": "forwardCone", "reverse": "reverseCone", "cone_loc": "coneLoc", "cone_bytes": "coneBytes", "est_tokens": "estTokens"}
    return rows.select(*[F.col(a).alias(b) for a, b in names.items()]).orderBy("estTokens", "file")


def savings(pivoted: DataFrame, conditions: tuple[str, str] = ("without", "with")) -> DataFrame:
    """(task, percent, saved) of complete tasks and of their sum (task null): the second condition in percent of the first, and how much less it is."""
    a, b = conditions
    rows = pivoted.where("complete").select("task", a, b)
    every = rows.unionByName(rows.agg(F.sum(a).alias(a), F.sum(b).alias(b)).select(F.lit(None).cast(rows.schema["task"].dataType).alias("task"), a, b))
    return every.select("task", paths.percent(b, a).alias("percent"), paths.saving(b, a).alias("saved"))


def costliest(rows: DataFrame, k: int = 5) -> DataFrame:
    return rows.orderBy(F.desc("est_tokens"), "id").limit(k)


def pivot_conditions(runs: DataFrame, value: str, conditions: tuple[str, str] = ("without", "with")) -> DataFrame:
    """(task, without, with, ratio): the last row of each task and condition by ``ord``; incomplete tasks are flagged."""
    a, b = conditions
    out = runs.groupBy("task").pivot("cond", list(conditions)).agg(F.max_by(value, "ord"))
    return out.withColumn("complete", F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("ratio", F.when(F.col("complete") & (F.col(a) != 0), F.col(b) / F.col(a)))


def totals(pivoted: DataFrame, conditions: tuple[str, str] = ("without", "with")) -> DataFrame:
    """One row: sums over complete tasks, their ratio, and how many were left out."""
    a, b = conditions
    full = pivoted.agg(F.sum(F.when(F.col("complete"), F.col(a))).alias(a), F.sum(F.when(F.col("complete"), F.col(b))).alias(b), F.count_if(~F.col("complete")).alias("incomplete"))
    return full.withColumn("ratio", F.col(b) / F.col(a))


def join_runs(runs: DataFrame, cones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with their file's cone metrics, runs without any)."""
    return runs.join(cones, "file"), runs.join(cones, "file", "left_anti")


def level_summary(graphs: dict[str, tuple[DataFrame, DataFrame, DataFrame]]) -> DataFrame:
    """(level, nodes, edges, cycles) for each named (nodes, edges, cycles)."""
    out = None
    for level, frames in graphs.items():
        row = None
        for name, f in zip(("nodes", "edges", "cycles"), frames):
            n = f.agg(F.count("*").alias(name))
            row = n if row is None else row.crossJoin(F.broadcast(n))
        row = row.select(F.lit(level).alias("level"), "nodes", "edges", "cycles")
        out = row if out is None else out.union(row)
    return out
