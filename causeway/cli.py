"""Command line: init, check, query, affects, viz, and graph lookups."""

from __future__ import annotations

import argparse
import html
import json
import sys
import time
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from causeway.model import KINDS, ConfigError, Graph
from causeway.operators import edges as E
from causeway.operators import recurse, rules
from causeway.plans import build, report
from causeway.sources import trees

OK, VIOLATIONS, BAD = 0, 1, 2
FILES, FUNCTIONS, RULES = "graph.files.json", "graph.functions.json", "causeway.yml"
STARTER = """version: 1
rules:
  - id: no-folder-cycles
    type: no-cycles
    level: folder
    rationale: folders in a cycle can't be understood or changed alone
  - id: no-file-cycles
    type: no-cycles
    level: file
    rationale: files that import each other load in an order that nobody chose
"""


@contextmanager
def timed(label: str):
    began = time.time()
    yield
    print(f"{label}: {time.time() - began:.1f} s", file=sys.stderr)


def session() -> SparkSession:
    return SparkSession.builder.appName("causeway").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def extract(spark: SparkSession, folder: str, project: str | None, functions: bool) -> build.Built:
    root = Path(folder)
    if not root.is_dir():
        raise ConfigError(f"no folder {folder}")
    if trees.is_python_project(folder, project):
        return build.python_project(trees.read_tree(spark, str(root.resolve()), "*.py"), folder)
    config = Path(project) if project else trees.find_config(folder)
    return build.typescript_project(trees.read_tree(spark, str(config.parent.resolve()), "*.ts*"), folder, trees.path_aliases(config.read_text(encoding="utf-8")), functions)


def _carry(spark: SparkSession, graph: Graph, path: Path) -> Graph:
    """Annotations of the document that is about to be replaced."""
    try:
        before = trees.read_graph(spark, str(path)).nodes if path.exists() else None
    except ConfigError:
        before = None
    if before is not None:
        graph.nodes = E.carry_annotations(before, graph.nodes.withColumn("annotation", F.lit(None).cast(before.schema["annotation"].dataType)) if "annotation" not in graph.nodes.columns else graph.nodes)
    return graph


def run_init(spark: SparkSession, args) -> int:
    out = Path(args.out or args.dir)
    out.mkdir(parents=True, exist_ok=True)
    with timed("extract"):
        built = extract(spark, args.dir, args.project, args.functions)
    for graph, name in ((built.files, FILES), (built.functions, FUNCTIONS)):
        if graph is not None:
            text = trees.graph_document(_carry(spark, graph, out / name))
            (out / name).write_text(text, encoding="utf-8")
    folders = build.folder_graph(built.files)
    (out / "ARCHITECTURE.md").write_text(report.render(folders, built.files, built.functions, built.unused, built.skipped_dynamic), encoding="utf-8")
    if not (Path(args.dir) / RULES).exists():
        (Path(args.dir) / RULES).write_text(STARTER, encoding="utf-8")
    return OK


def violation(row) -> dict:
    """One finding as it is printed: its edge as an object, absent fields left out."""
    edge = {"from": row["src"], "to": row["dst"], "kind": row["kind"], "line": row["line"]}
    out = {"rule": row["rule"], "severity": row["severity"], "message": row["message"], "edge": {k: v for k, v in edge.items() if v is not None} or None, "cycle": row["cycle"] and list(row["cycle"]), "rationale": row["rationale"], "fix": row["fix"]}
    return {k: v for k, v in out.items() if v is not None}


def run_check(spark: SparkSession, args) -> int:
    found = rules.load_rule_set(str(Path(args.dir) / RULES))
    built = extract(spark, args.dir, args.project, False)
    folders = build.folder_graph(built.files)
    result = rules.check(found, built.files.nodes, built.files.edges, {"folder": folders.cycles, "file": built.files.cycles})
    for e in result.unused_exemptions:
        print(f"warning: unused exemption {e.rule}: {e.src} -> {e.dst}", file=sys.stderr)
    for owner, glob in result.dead_patterns:
        print(f"warning: {owner}: pattern matches no file: {glob}", file=sys.stderr)
    rows = [violation(r) for r in result.violations.orderBy("ord", "src", "dst", "kind").collect()]
    print(json.dumps({"violations": rows}, indent=2, ensure_ascii=False))
    return VIOLATIONS if rows else OK


def _stored(spark: SparkSession, args) -> Graph:
    return trees.read_graph(spark, str(Path(args.dir) / FILES))


def run_query(spark: SparkSession, args) -> int:
    g = _stored(spark, args)
    row = E.query_node(g.nodes.select("id", "annotation"), g.edges, args.file).first()
    if row is None:
        print(f"unknown file {args.file}", file=sys.stderr)
        return BAD
    print(json.dumps({k: v for k, v in (("id", row["id"]), ("imports", row["imports"]), ("importedBy", row["imported_by"]), ("annotation", row["annotation"] and row["annotation"].asDict())) if v is not None}, indent=2, ensure_ascii=False))
    return OK


def run_affects(spark: SparkSession, args) -> int:
    g = _stored(spark, args)
    print(json.dumps({"id": args.file, "affects": [r["id"] for r in recurse.affects(g.edges, args.file).orderBy("id").collect()]}, indent=2, ensure_ascii=False))
    return OK


def run_lookup(spark: SparkSession, args) -> int:
    """Lines of: deps, importers, cone, affects, annotate, conedoc, cycles, hubs."""
    g, verb = _stored(spark, args), args.verb
    if verb == "cycles":
        lines = [" ".join(r["nodes"]) for r in g.cycles.orderBy("id").collect()]
    elif verb == "hubs":
        lines = [f"{r['fan_in']}\t{r['id']}" for r in E.hubs(g.nodes, g.edges).collect()]
    else:
        if not args.file:
            return BAD
        if g.nodes.where(F.col("id") == args.file).isEmpty():
            print(f"unknown file {args.file}", file=sys.stderr)
            return VIOLATIONS
        if verb in ("deps", "importers"):
            lines = E.query_node(g.nodes.select("id"), g.edges, args.file).first()["imports" if verb == "deps" else "imported_by"]
        elif verb == "annotate":
            note = g.nodes.where(F.col("id") == args.file).first()["annotation"]
            lines = [json.dumps(note.asDict(), ensure_ascii=False) if note else "(no annotation)"]
        elif verb == "conedoc":
            rows = recurse.cone(g.edges, args.file).join(g.nodes, "id", "left").orderBy("id").collect()
            lines = [json.dumps({"id": r["id"], **{k: r["annotation"][k] for k in ("summary", "should", "shouldNot", "side", "pure")}} if r["annotation"] else {"id": r["id"]}, ensure_ascii=False) for r in rows]
        else:
            lines = [r["id"] for r in (recurse.cone if verb == "cone" else recurse.affects)(g.edges, args.file).orderBy("id").collect()]
    print("\n".join(lines))
    return OK


def run_viz(spark: SparkSession, args) -> int:
    """A self-contained page with the encoded graph; no layout, a list of layers."""
    g = _stored(spark, args)
    clean = lambda x: {k: v for k, v in x.items() if v is not None}
    nodes = [clean({"id": r["id"], "ln": r["line"], "ann": r["annotation"] and clean(r["annotation"].asDict())}) for r in g.nodes.orderBy("id").collect()]
    encoded = [[r["f"], r["t"], r["k"], r["w"]] for r in E.dictionary_encode(g.nodes, g.edges, KINDS).orderBy("f", "t", "k").collect()]
    folders = build.folder_graph(g)
    true_cycles = [list(r["nodes"]) for c in (folders.cycles, g.cycles) for r in c.orderBy("id").collect()]
    data = json.dumps({"root": g.root, "kinds": KINDS, "nodes": nodes, "edges": encoded, "trueCycles": true_cycles}, ensure_ascii=False).replace("<", "\\u003c")
    layers: dict[int, list[str]] = {}
    for r in recurse.view_layers(folders.nodes, folders.edges).orderBy("layer", "id").collect():
        layers.setdefault(r["layer"], []).append(r["id"])
    body = "".join(f"<h2>Layer {k}</h2><ul>{''.join(f'<li>{html.escape(x)}</li>' for x in v)}</ul>" for k, v in layers.items())
    (Path(args.dir) / "viz.html").write_text(f"<!doctype html><meta charset=utf-8><title>{html.escape(g.root)}</title><h1>{html.escape(g.root)}</h1>{body}<script>const graph = {data};</script>\n", encoding="utf-8")
    return OK


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="causeway")
    sub = p.add_subparsers(dest="command")
    for name, run, extra in (("init", run_init, ("out", "functions", "project")), ("check", run_check, ("project",)), ("viz", run_viz, ()), ("query", run_query, ("file",)), ("affects", run_affects, ("file",)), ("lookup", run_lookup, ("verb", "file?"))):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        if "verb" in extra:
            c.add_argument("verb", choices=["deps", "importers", "cone", "affects", "annotate", "conedoc", "cycles", "hubs"])
        if "file" in extra or "file?" in extra:
            c.add_argument("file", **({"nargs": "?"} if "file?" in extra else {}))
            c.add_argument("--dir", default=".")
        else:
            c.add_argument("dir", nargs="?", default=".")
        for flag in ("out", "project"):
            if flag in extra:
                c.add_argument(f"--{flag}")
        if name == "viz":
            c.add_argument("--no-open", action="store_true", help="the page is never opened; taken for compatibility")
        if "functions" in extra:
            c.add_argument("--functions", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    try:
        args = p.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    if not args.command:
        p.print_help()
        return OK
    try:
        return args.run(spark or session(), args)
    except ConfigError as e:
        print(f"error: {e}", file=sys.stderr)
        return BAD


if __name__ == "__main__":
    sys.exit(main())
