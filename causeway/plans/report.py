"""The structure of a project in Markdown, from small summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.model import Graph
from causeway.operators import edges as E
from causeway.operators import recurse
from causeway.operators.metrics import level_summary

#: Rows of a list: of edges, hubs and pairs; of unused imports; of function cycles.
TOP, UNUSED, FUNCTION_CYCLES = 10, 30, 20


def table(rows: list, *columns: tuple[str, str, str]) -> Iterator[str]:
    """A Markdown table of rows by (title, alignment, field); ``code`` fields are quoted."""
    yield "".join(f"| {title} " for title, *_ in columns) + "|"
    yield "".join({"n": "| ---: ", "code": "| --- ", "text": "| --- "}[kind] for _, kind, _ in columns) + "|"
    for r in rows:
        yield "".join(f"| `{r[f]}` " if kind == "code" else f"| {r[f]} " for _, kind, f in columns) + "|"
    yield ""


def and_more(shown: int, total: int, where: str) -> Iterator[str]:
    if total > shown:
        yield f"- and {total - shown} further ones in {where}"


def sizes(graphs: list[Graph]) -> Iterator[str]:
    counts = level_summary({g.level: (g.nodes, g.edges, g.cycles) for g in graphs}).collect()
    order = [g.level for g in graphs]
    yield from table(sorted(counts, key=lambda r: order.index(r["level"])), ("Graph", "text", "level"), ("Nodes", "n", "nodes"), ("Edges", "n", "edges"), ("Cycles", "n", "cycles"))


def folder_layers(folders: Graph) -> DataFrame:
    """(layer, id, fileCount, fan_in, fan_out), the order of the report."""
    fans = E.fan_counts(folders.nodes, folders.edges)
    return recurse.layers(folders.nodes, folders.edges).join(fans, "id").join(folders.nodes.select("id", "fileCount"), "id").orderBy("layer", "id")


def cycle_list(graph: Graph, most: int | None = None) -> Iterator[str]:
    total = graph.cycles.count()
    if not total:
        return
    shown = graph.cycles.orderBy("id").limit(most or total).collect()
    yield from (f"### {graph.level.capitalize()} level: {total}", "")
    edges: dict[int, list] = {}
    if graph.level == "file":
        members = graph.cycles.select(F.col("id").alias("cycle"), F.explode("nodes").alias("id"))
        for e in E.cycle_edges(members, graph.edges).orderBy("src", "dst", "kind").collect():
            edges.setdefault(e["cycle"], []).append(e)
    for c in shown:
        yield f"{c['id'] + 1}. {len(c['nodes'])} members: " + ", ".join(f"`{n}`" for n in c["nodes"])
        for e in edges.get(c["id"], ()):
            yield f"   - `{e['src']}` line {e['line'] if e['line'] is not None else 'unknown'} uses `{e['dst']}` as {e['kind']}"
    yield from and_more(len(shown), total, "the graph document")
    yield ""


def render(folders: Graph, files: Graph, functions: Graph | None = None, unused: DataFrame | None = None, skipped: int = 0) -> str:
    """Markdown; lists are cut to their tops, the rest is counted."""
    graphs = [g for g in (folders, files, functions) if g is not None]
    out = [f"# Structure of `{folders.root}`", "", *sizes(graphs)]
    out += ["## Folders from the bottom up", "", "A folder needs folders of smaller numbers only, or of its own number if they form a cycle.", ""]
    out += table(folder_layers(folders).collect(), ("Layer", "n", "layer"), ("Folder", "code", "id"), ("Files", "n", "fileCount"), ("Used by", "n", "fan_in"), ("Uses", "n", "fan_out"))
    loops = [line for g, most in ((folders, None), (files, None), (functions, FUNCTION_CYCLES)) if g is not None for line in cycle_list(g, most)]
    out += ["## Cycles", "", *(loops or ["No graph has one.", ""])]
    heavy = E.heaviest(folders.edges, TOP).collect()
    if heavy:
        out += ["## Strongest ties between folders", "", *table(heavy, ("Folder", "code", "src"), ("Needs", "code", "dst"), ("As", "text", "kind"), ("Imports", "n", "weight"))]
    hubs = E.hubs(files.nodes, files.edges, TOP).collect()
    if hubs:
        out += ["## Files that most others need", "", *table(hubs, ("File", "code", "id"), ("Used by", "n", "fan_in"), ("Uses", "n", "fan_out"))]
    only = E.type_only_pairs(folders.edges)
    if total := only.count():
        shown = only.orderBy("src", "dst").limit(TOP).collect()
        out += [f"## Folders tied by types alone: {total}", "", *(f"- `{r['src']}` to `{r['dst']}`" for r in shown), *and_more(len(shown), total, "the graph document"), ""]
    if unused is not None and (total := unused.count()):
        shown = unused.orderBy("file", "line", "name").limit(UNUSED).collect()
        out += [f"## Imported and never used: {total}", "", *(f"- {r['name']} in `{r['file']}`, line {r['line']}" for r in shown), *and_more(len(shown), total, "the sources"), ""]
    if skipped:
        out += [f"{skipped} dynamic imports name their module only at run time and are missing from all graphs.", ""]
    return "\n".join(out)
