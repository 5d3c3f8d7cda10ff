"""Accumulation and projection of edges, neighbour and fan counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import paths
from causeway.shared import cut


def accumulate(raw: DataFrame) -> DataFrame:
    """One edge per (src, dst, kind): weights summed, the first line. Partial sums are made before the shuffle."""
    weight = F.coalesce(F.col("weight"), F.lit(1)) if "weight" in raw.columns else F.lit(1)
    line = F.min("line") if "line" in raw.columns else F.lit(None)
    return raw.groupBy("src", "dst", "kind").agg(F.sum(weight).cast("long").alias("weight"), line.cast("int").alias("line"))


def rekey(edges: DataFrame, src: Column, dst: Column, kind: Column | None = None) -> DataFrame:
    """Edges between containers: ends replaced, edges inside one dropped, weights summed; lines are lost."""
    moved = edges.select(src.alias("src"), dst.alias("dst"), (F.col("kind") if kind is None else kind).alias("kind"), "weight")
    return accumulate(moved.where("src <> dst")).drop("line")


def folder_edges(edges: DataFrame) -> DataFrame:
    return rekey(edges, paths.folder_of("src"), paths.folder_of("dst"), paths.folded_kind("kind"))


def folder_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(paths.folder_of("id").alias("id")).agg(F.count("*").cast("int").alias("fileCount"))


def unified(file_nodes: DataFrame, file_edges: DataFrame, fn_nodes: DataFrame, fn_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files and functions in one graph; top-level code becomes its file, self-edges that this makes are dropped."""
    real = fn_nodes.where(paths.module_of("id") == F.col("id"))
    nodes = file_nodes.unionByName(real, allowMissingColumns=True)
    calls = fn_edges.select(paths.module_of("src").alias("src"), paths.module_of("dst").alias("dst"), "kind", "weight", "line").where("src <> dst")
    return nodes, accumulate(file_edges.select("src", "dst", "kind", "weight", "line").unionByName(calls))


def frontier_edges(edges: DataFrame, expanded: list[str]) -> DataFrame:
    return rekey(edges, paths.display_node("src", expanded), paths.display_node("dst", expanded))


def frontier_nodes(nodes: DataFrame, expanded: list[str]) -> DataFrame:
    """Display nodes with kind, hidden children, file and function counts, and the side most voted for.

    A node that shows itself votes with a weight of 1000; on equal votes the side
    seen first (by id) wins, of one id's sides the least. Every node has one side, so
    votes are few per group.
    """
    side = F.col("annotation.side") if "annotation" in nodes.columns else F.lit(None).cast("string")
    rows = nodes.select("id", paths.display_node("id", expanded).alias("display"), side.alias("side"))
    is_fn, own = F.instr("id", "#") > 0, F.col("id") == F.col("display")
    groups = rows.groupBy("display").agg(F.count_if(~is_fn).alias("fileCount"), F.count_if(is_fn).alias("fnCount"), F.bool_or(own).alias("shown"))
    votes = rows.where("side IS NOT NULL").groupBy("display", "side").agg(F.sum(F.when(own, 1000).otherwise(1)).alias("votes"), F.min("id").alias("first"))
    best = votes.groupBy("display").agg(F.max(F.col("votes")).alias("top")).join(votes, "display").where("votes = top").groupBy("display").agg(F.min_by("side", F.struct("first", "side")).alias("side"))
    kind = F.when(F.instr("display", "#") > 0, "function").when(F.col("shown"), "file").otherwise("folder")
    out = groups.join(best, "display", "left").withColumn("kind", kind)
    hidden = F.when(F.col("kind") == "folder", F.col("fileCount")).when(F.col("kind") == "file", F.col("fnCount")).otherwise(0)
    return out.select(F.col("display").alias("id"), "kind", hidden.cast("long").alias("hidden"), "fileCount", "fnCount", "side")


def initial_expanded(nodes: DataFrame) -> DataFrame:
    """``.`` and the top-level folders with two sub-folders or more."""
    folders = nodes.where(F.instr("id", "#") == 0).select(F.explode(paths.containers("id")).alias("folder")).distinct()
    parents = folders.select(paths.folder_of("folder").alias("id")).where((F.instr("id", "/") == 0) & (F.col("id") != "."))
    branching = parents.groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    return branching.union(nodes.sparkSession.createDataFrame([(".",)], "id string")).distinct()


def drill(expanded: list[str], container: str) -> list[str]:
    return sorted({*expanded, container})


def collapse(expanded: list[str], container: str) -> list[str]:
    """Without the container and what lies in it."""
    return sorted(e for e in expanded if e != container and not e.startswith(container + "/"))


def cycle_realness(shown: DataFrame, true_cycles: DataFrame, expanded: list[str] | Column) -> DataFrame:
    """(scc, real): a shown component is real if some true cycle projects to two or more nodes, all of them in it.

    ``shown`` has (scc, id), ``true_cycles`` (cycle, id). ``expanded`` lists containers or
    is a column that gives an id's display node.
    """
    display = expanded if isinstance(expanded, Column) else paths.display_node("id", expanded)
    projected = true_cycles.select("cycle", display.alias("id")).distinct()
    sizes = projected.groupBy("cycle").agg(F.count("*").alias("n")).where("n > 1")
    inside = projected.join(shown, "id").groupBy("cycle", "scc").agg(F.count("*").alias("k"))
    real = inside.join(sizes, "cycle").where("k = n").select("scc").distinct().withColumn("real", F.lit(True))
    return shown.select("scc").distinct().join(real, "scc", "left").select("scc", F.coalesce("real", F.lit(False)).alias("real"))


def fan_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out) of every node, counting edges of each kind."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def hubs(nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    return fan_counts(nodes, edges).where("fan_in > 0").orderBy(F.desc("fan_in"), "id").limit(k)


def heaviest(edges: DataFrame, k: int = 10) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "src", "dst", "kind").limit(k)


def type_only_pairs(edges: DataFrame, k: int | None = None) -> DataFrame:
    pairs = edges.groupBy("src", "dst").agg(F.bool_and(F.col("kind") == "type").alias("only")).where("only").select("src", "dst")
    return pairs if k is None else pairs.orderBy("src", "dst").limit(k)


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, imports, imported_by): distinct neighbours, sorted."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("imports"))
    back = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("imported_by"))
    none = F.array().cast(out.schema["imports"].dataType)
    return out.join(back, "id", "full").select("id", F.coalesce("imports", none).alias("imports"), F.coalesce("imported_by", none).alias("imported_by"))


def query_node(nodes: DataFrame, edges: DataFrame, node) -> DataFrame:
    """One row for a known id, none for an unknown one; the edges are filtered before they are grouped."""
    near = neighbours(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("id") == node)
    none = F.array().cast(near.schema["imports"].dataType)
    return nodes.where(F.col("id") == node).join(near, "id", "left").withColumn("imports", F.coalesce("imports", none)).withColumn("imported_by", F.coalesce("imported_by", none))


def positions(rows: DataFrame, key: str) -> DataFrame:
    """(key, i): 0-based positions in ascending order of a unique key.

    Rows are dealt to ranges and numbered there; the ranges' counts (a row each) give
    each one its first number, so no task sees all rows.
    """
    placed = cut(rows.select(key).repartitionByRange(F.col(key)).sortWithinPartitions(key).select(key, F.spark_partition_id().alias("range")))
    counts = placed.groupBy("range").agg(F.count("*").alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(key)) - 1
    return placed.withColumn("i", inside).join(F.broadcast(before), "range").select(key, (F.col("before") + F.col("i")).alias("i"))


def highlighted(edges: DataFrame, node) -> DataFrame:
    """(id): a node and all that it shares an edge with."""
    near = edges.where((F.col("src") == node) | (F.col("dst") == node))
    return near.select(F.explode(F.array("src", "dst")).alias("id")).union(edges.sparkSession.range(1).select(F.lit(node).alias("id"))).distinct()


def view_hubs(nodes: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` nodes by fan-in, those without any left out afterwards."""
    return fan_counts(nodes, edges).orderBy(F.desc("fan_in"), "id").limit(k).where("fan_in > 0")


def legend(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...], lanes: tuple[str, ...] = ("frontend", "shared", "backend", "tooling")) -> DataFrame:
    """(what, name, n) of the edge kinds and lanes that occur, in their fixed order; a node without a known side is in ``shared``."""
    order = lambda names, c: F.array_position(F.array(*[F.lit(x) for x in names]), F.col(c))
    shown = edges.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")).select(F.lit("kind").alias("what"), "name", "n", order(kinds, "name").alias("ord"))
    side = F.when(F.col("side").isin(*lanes), F.col("side")).otherwise("shared")
    used = nodes.groupBy(side.alias("name")).agg(F.count("*").alias("n")).select(F.lit("lane").alias("what"), "name", "n", order(lanes, "name").alias("ord"))
    return shown.where("ord > 0").union(used).orderBy("what", "ord").select("what", "name", "n")


def dictionary_encode(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(f, t, k, w): ends as 0-based positions in id order, kinds as positions in ``kinds``."""
    index = positions(nodes, "id")
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind")) - 1
    ends = edges.join(index.select(F.col("id").alias("src"), F.col("i").alias("f")), "src").join(index.select(F.col("id").alias("dst"), F.col("i").alias("t")), "dst")
    return ends.select("f", "t", code.cast("int").alias("k"), F.col("weight").alias("w"))


def carry_annotations(previous: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node keeps its annotation, or takes over the one that its id had before."""
    old = previous.select("id", F.col("annotation").alias("old"))
    return nodes.join(old, "id", "left").withColumn("annotation", F.coalesce("annotation", "old")).drop("old")


def bake_annotations(nodes: DataFrame, authored: DataFrame) -> DataFrame:
    """Authored annotations win over present ones."""
    new = authored.select("id", F.col("annotation").alias("new"))
    return nodes.join(new, "id", "left").withColumn("baked", F.col("new").isNotNull()).withColumn("annotation", F.coalesce("new", "annotation")).drop("new")


def inherit_annotations(functions: DataFrame, files: DataFrame, how: str = "left") -> DataFrame:
    """A function without an annotation has its file's; ``inner`` leaves out functions of unknown files."""
    up = files.select(F.col("id").alias("of"), F.col("annotation").alias("up"))
    return functions.join(up, paths.file_of("id") == F.col("of"), how).withColumn("annotation", F.coalesce("annotation", "up")).drop("of", "up")


def cycle_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in one cycle (cycle, id), self-edges left out."""
    a, b = (cycles.select("cycle", F.col("id").alias(c)) for c in ("src", "dst"))
    return edges.where("src <> dst").join(a, "src").join(b, ["cycle", "dst"])
