"""The graph model: schemas, edge kinds, and a graph as three DataFrames.

Any DataFrame with the columns of ``EDGES`` (``src``, ``dst``, ``kind``, ``weight``,
``line``) or ``NODES`` (``id`` and nullable rest) is a valid source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the model.
KINDS = ("value", "type", "dynamic", "call", "reference")
LEVELS = ("folder", "file", "function", "unified")
MODULE = "<module>"

ANNOTATION = T.StructType([*(T.StructField(n, T.StringType()) for n in ("summary", "inputs", "outputs", "should", "shouldNot", "side")), T.StructField("pure", T.BooleanType())])
NODES = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("file", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("fileCount", T.IntegerType()),
    T.StructField("loc", T.IntegerType()), T.StructField("bytes", T.LongType()), T.StructField("annotation", ANNOTATION),
])
EDGES = T.StructType([T.StructField("src", T.StringType(), False), T.StructField("dst", T.StringType(), False), T.StructField("kind", T.StringType(), False), T.StructField("weight", T.LongType(), False), T.StructField("line", T.IntegerType())])
CYCLES = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("nodes", T.ArrayType(T.StringType(), False), False)])


class ConfigError(ValueError):
    """A rule file, glob or project that can't be used (exit code 2)."""


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    cycles: DataFrame | None = None
    level: str = "file"
    root: str = "."
