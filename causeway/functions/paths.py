"""Columns over node ids: ``folder/sub/file.ext`` and ``file#function``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.model import MODULE


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def relative_id(path, root: str) -> Column:
    """Forward-slashed path below ``root``."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    base = root.replace("\\", "/").rstrip("/") + "/"
    return F.when(F.startswith(p, F.lit(base)), F.substr(p, F.lit(len(base) + 1))).otherwise(p)


def folder_of(x) -> Column:
    """Directory of an id, ``.`` at the root."""
    x = _c(x)
    return F.when(F.instr(x, "/") == 0, ".").otherwise(F.regexp_extract(x, "^(.*)/[^/]*$", 1))


def file_of(x) -> Column:
    return F.substring_index(_c(x), "#", 1)


def module_of(x) -> Column:
    """Top-level code counts as its file."""
    return F.regexp_replace(_c(x), f"#{MODULE}\\z", "")


def label_of(x, kind, hidden, files, functions) -> Column:
    """A node's caption: a function's own name, a folder with its number of files if it hides some, a file with its number of functions."""
    x = _c(x)
    last = F.substring_index(x, "/", -1)
    folder = F.concat(last, F.when(_c(hidden) > 0, F.concat(F.lit(" +"), _c(files).cast("string"))).otherwise(""))
    file = F.concat(last, F.when(_c(functions) > 0, F.concat(F.lit(" {"), _c(functions).cast("string"), F.lit("}"))).otherwise(""))
    return F.when(_c(kind) == "function", F.substr(x, F.instr(x, F.lit("#")) + 1)).when(_c(kind) == "folder", folder).otherwise(file)


# Areas of a web project in order, by what a file's path begins with; anything else is "other".
AREAS = (("components", ("src/components",)), ("lib", ("src/lib",)), ("pages", ("src/pages",)))
TOOL_FOLDERS = ("scripts", "prisma", "data")


def area_of(x, areas: tuple[tuple[str, tuple[str, ...]], ...] = AREAS, tools: tuple[str, ...] = TOOL_FOLDERS) -> Column:
    """The first area that a node's file belongs to."""
    path = file_of(x)
    out = F.when(F.substring_index(path, "/", 1).isin(*tools), "tooling").otherwise("other")
    for key, prefixes in reversed(areas):
        out = F.when(reduce(lambda a, b: a | b, (F.startswith(path, F.lit(p)) for p in prefixes)), key).otherwise(out)
    return out


def radius(kind, files, degree) -> Column:
    """Size of a drawn node, by its files (folders) or its edges; 16 at most."""
    n = F.when(_c(kind) == "folder", _c(files)).otherwise(_c(degree))
    return F.least(F.lit(16.0), 3.5 + 2.2 * F.sqrt(F.greatest(n, F.lit(1))))


def percent(part, whole) -> Column:
    """Whole percent of one number in another; null where that is 0."""
    return F.round(100.0 * _c(part) / F.nullif(_c(whole), F.lit(0)), 0)


def saving(now, before) -> Column:
    """Whole percent by which a number fell."""
    return F.round(100.0 * (_c(before) - _c(now)) / F.nullif(_c(before), F.lit(0)), 0)


def folded_kind(kind) -> Column:
    """Type imports stay apart, everything else is a value."""
    return F.when(_c(kind) == "type", "type").otherwise("value")


def containers(x) -> Column:
    """Folders above an id from the root down (``.`` for root files), then a function's file."""
    x = _c(x)
    path = file_of(x)
    parts = F.split(path, "/")
    folders = F.when(F.size(parts) == 1, F.array(F.lit("."))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    return F.when(F.instr(x, "#") > 0, F.concat(folders, F.array(path))).otherwise(folders)


def display_node(x, expanded: list[str]) -> Column:
    """The first container that isn't expanded, or the id itself."""
    known = F.array(*[F.lit(e) for e in expanded]) if expanded else F.array().cast("array<string>")
    return F.coalesce(F.get(F.filter(containers(x), lambda c: ~F.array_contains(known, c)), F.lit(0)), _c(x))


def tokens_of_text(text) -> Column:
    """ceil(characters / 4)."""
    return F.ceil(F.length(_c(text)) / 4)


def tokens_of_bytes(n) -> Column:
    """bytes / 3.7, halves up."""
    return F.floor(_c(n) / F.lit(3.7) + F.lit(0.5)).cast("long")


def lines_of(text) -> Column:
    """Line starts: one more than line breaks, of any kind."""
    return F.size(F.split(_c(text), "\r\n|[\n\r  ]", -1))


def byte_size(text) -> Column:
    return F.octet_length(_c(text)).cast("long")


def matches_search(query: str, *columns) -> Column:
    """Case-blind containment in any of the columns, joined by spaces."""
    return F.contains(F.lower(F.concat_ws(" ", *map(_c, columns))), F.lit(query.lower()))
