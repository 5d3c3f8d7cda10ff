"""Source trees to graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import paths
from causeway.model import Graph
from causeway.operators import edges as E
from causeway.operators import recurse, resolve
from causeway.shared import cut
from causeway.sources import python_source, trees, typescript_source


@dataclass
class Built:
    files: Graph
    functions: Graph | None
    skipped_dynamic: int
    unused: DataFrame | None


def _file_nodes(files: DataFrame, sized: bool) -> DataFrame:
    ids = files.select(F.col("path").alias("id"), paths.lines_of("text").cast("int").alias("loc"), paths.byte_size("text").alias("bytes"))
    return ids if sized else ids.select("id")


def _graph(nodes: DataFrame, raw: DataFrame, level: str, root: str) -> Graph:
    merged = cut(E.accumulate(raw))
    return Graph(nodes, merged, cut(recurse.cycles(merged)), level, root)


def python_project(files: DataFrame, root: str = ".") -> Built:
    """``files`` has (path, text)."""
    files = trees.python_files(files)
    nodes = _file_nodes(files, sized=False)
    found = cut(python_source.extract(files))
    skipped = found.agg(F.sum("skipped")).first()[0] or 0
    return Built(_graph(nodes, resolve.python_edges(found, nodes), "file", root), None, skipped, None)


def typescript_project(files: DataFrame, root: str = ".", aliases: list[tuple[str, str]] = (), functions: bool = False) -> Built:
    files = trees.typescript_files(files)
    nodes = _file_nodes(files, sized=True)
    found = cut(typescript_source.extract_imports(files))
    skipped = found.agg(F.sum("skipped")).first()[0] or 0
    graph = _graph(nodes, resolve.typescript_edges(found, nodes, aliases), "file", root)
    facts = cut(typescript_source.extract_facts(files))
    fn = None
    if functions:
        fn_nodes, raw = resolve.function_graph(facts, nodes, aliases)
        fn = _graph(cut(fn_nodes), raw, "function", root)
    return Built(graph, fn, skipped, resolve.unused_imports(facts))


def folder_graph(files: Graph) -> Graph:
    merged = cut(E.folder_edges(files.edges))
    return Graph(E.folder_nodes(files.nodes), merged, cut(recurse.cycles(merged)), "folder", files.root)


def unified_graph(files: Graph, functions: Graph) -> Graph:
    """Cycles are left empty: they belong to the levels that the graph was made from."""
    nodes, merged = E.unified(files.nodes, files.edges, functions.nodes, functions.edges)
    return Graph(nodes, merged, files.cycles.limit(0) if files.cycles is not None else None, "unified", files.root)
