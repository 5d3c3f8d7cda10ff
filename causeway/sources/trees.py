"""Source trees, graph documents and measurement files as DataFrames."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.model import ANNOTATION, CYCLES, ConfigError, Graph

# Folders that hold no sources of a Python project, and the files that mark one.
SKIPPED = ("__pycache__", "node_modules", "build", "dist", ".tox", ".mypy_cache", ".pytest_cache", ".eggs", "site-packages", ".venv", "venv", "env")
MARKERS = ("pyproject.toml", "setup.py", "setup.cfg")

_EDGE = T.StructType([T.StructField("from", T.StringType()), T.StructField("to", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("weight", T.LongType()), T.StructField("line", T.IntegerType())])
_NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("fileCount", T.IntegerType()), T.StructField("loc", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("annotation", ANNOTATION)])
DOCUMENT = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("level", T.StringType()), T.StructField("root", T.StringType()), T.StructField("nodes", T.ArrayType(_NODE)), T.StructField("edges", T.ArrayType(_EDGE)), T.StructField("cycles", T.ArrayType(CYCLES))])


def read_tree(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, text) of files below ``root`` whose name matches a glob; read whole, in parallel."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(F.substr(path, F.instr(path, F.lit(base)) + len(base)).alias("path"), F.col("content").cast("string").alias("text"))


def python_files(files: DataFrame) -> DataFrame:
    """Without skipped and dotted folders."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.where(F.endswith("path", F.lit(".py")) & ~F.exists(folders, lambda d: F.startswith(d, F.lit(".")) | d.isin(*SKIPPED)))


def typescript_files(files: DataFrame) -> DataFrame:
    return files.where(F.rlike("path", F.lit(r"\.(ts|tsx|mts|cts)\z")) & ~F.rlike("path", F.lit(r"\.d\.[cm]?ts\z|(^|/)node_modules/")))


def find_config(start: str, name: str = "tsconfig.json") -> Path:
    """The nearest configuration at or above a folder."""
    at = Path(start).resolve()
    for folder in (at, *at.parents):
        if (folder / name).is_file():
            return folder / name
    raise ConfigError(f"no {name} in {start} or above")


def path_aliases(config: str) -> list[tuple[str, str]]:
    """(prefix, target prefix) of ``compilerOptions.paths``; comments and trailing commas are allowed."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", config, flags=re.S)
    try:
        options = json.loads(re.sub(r",(\s*[}\]])", r"\1", text)).get("compilerOptions", {})
    except (ValueError, AttributeError) as e:
        raise ConfigError(f"bad configuration: {e}") from e
    base = options.get("baseUrl", ".").strip("./")
    out = []
    for pattern, targets in options.get("paths", {}).items():
        out += [(pattern.removesuffix("*"), "/".join(p for p in (base, t.removesuffix("*").removeprefix("./")) if p)) for t in targets]
    return out


def is_python_project(root: str, project: str | None = None) -> bool:
    """An explicit or present TypeScript project wins; then marker files or any Python file."""
    if project or (Path(root) / "tsconfig.json").is_file():
        return False
    return any((Path(root) / m).is_file() for m in MARKERS) or next(Path(root).rglob("*.py"), None) is not None


def read_graph(spark: SparkSession, path: str) -> Graph:
    """A graph document; missing or malformed ones are configuration errors."""
    try:
        docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("mode", "FAILFAST").json(path)
        head = docs.select("level", "root", "version").first()
    except Exception as e:
        raise ConfigError(f"can't read graph {path}: {str(e).splitlines()[0]}") from e
    if head is None or head["level"] is None:
        raise ConfigError(f"{path} holds no graph")
    nodes = docs.select(F.explode("nodes").alias("n")).select("n.*")
    edges = docs.select(F.explode("edges").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), "e.kind", "e.weight", "e.line")
    return Graph(nodes, edges, docs.select(F.explode("cycles").alias("c")).select("c.*"), head["level"], head["root"])


def graph_document(graph: Graph) -> str:
    """Canonical text: nodes by id, edges by (from, to, kind), cycles by id; absent fields left out; two spaces, a line end.

    A document is one object, so its rows come to the driver; large graphs go to
    :func:`write_tables`.
    """
    clean = lambda x: {k: clean(v) for k, v in x.items() if v is not None} if isinstance(x, dict) else x
    nodes = [clean(r.asDict(True)) for r in graph.nodes.orderBy("id").collect()]
    edges = [clean({"from": r["src"], "to": r["dst"], **{k: v for k, v in r.asDict().items() if k not in ("src", "dst")}}) for r in graph.edges.orderBy("src", "dst", "kind").collect()]
    cycles = [{"id": r["id"], "nodes": list(r["nodes"])} for r in graph.cycles.orderBy("id").collect()] if graph.cycles is not None else []
    return json.dumps({"version": 1, "level": graph.level, "root": graph.root, "nodes": nodes, "edges": edges, "cycles": cycles}, indent=2, ensure_ascii=False) + "\n"


def write_tables(graph: Graph, folder: str) -> None:
    """The graph as Parquet tables, for sizes that no single document should have."""
    for name in ("nodes", "edges", "cycles"):
        frame = getattr(graph, name)
        if frame is not None:
            frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, level: str = "file", root: str = ".") -> Graph:
    return Graph(*(spark.read.parquet(f"{folder}/{n}") for n in ("nodes", "edges", "cycles")), level, root)


def read_runs_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per benchmark run, from a document with a list ``runs`` or a bare list."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("runs").alias("r")).select("r.*") if "runs" in raw.columns else raw


def read_measurements(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Delimited measurements with a header: the first column is text, the others numbers where they can be; surplus fields are ignored."""
    rows = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    first, *rest = rows.columns
    numeric = rows.select(*[F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` AS double)").isNotNull()).alias(c) for c in rest]).first() if rest else {}
    return rows.select(first, *[F.expr(f"try_cast(`{c}` AS double)").alias(c) if numeric[c] else F.col(c) for c in rest])


def import_lines(files: DataFrame) -> DataFrame:
    """(path, lines): the lines of a text that import or re-export."""
    kept = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"^\s*(import\b|export .* from\b)")))
    return files.select("path", F.array_join(kept, "\n").alias("lines"))


def sources_of(ids: DataFrame, files: DataFrame) -> DataFrame:
    """One row (text, missing): the texts of ids in id order, and how many have none."""
    rows = ids.select("id").join(files, ids["id"] == files["path"], "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("id", "text"))))
    return rows.agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n").alias("text"), F.count_if(F.col("text").isNull()).alias("missing"))


def write_cones(table: DataFrame, folder: str, picked: DataFrame | None = None) -> None:
    """``metrics.cone_table`` as CSV with a header, and picked rows as JSON lines, each a folder of part files."""
    table.write.mode("overwrite").option("header", True).csv(f"{folder}/cones.csv")
    if picked is not None:
        picked.write.mode("overwrite").json(f"{folder}/candidates.json")
