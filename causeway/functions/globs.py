"""Path globs as Java regular expressions and column predicates.

A glob is read into a tree of literal text, stars and choices, and the tree is written
as a regex. ``**`` crosses folders, ``*`` stays in one, ``{a,b}`` gives choices and
nests; a comma or closing brace outside of choices is literal, as is everything else.
A choice without its closing brace is a configuration error.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from causeway.model import ConfigError


@dataclass(frozen=True)
class Literal:
    text: str

    def regex(self) -> str:
        quoted = self.text.replace("\\E", "\\E\\\\E\\Q")
        return f"\\Q{quoted}\\E"


@dataclass(frozen=True)
class Star:
    folders: bool

    def regex(self) -> str:
        return ".*" if self.folders else "[^/]*"


@dataclass(frozen=True)
class Choice:
    options: tuple[tuple, ...]

    def regex(self) -> str:
        return "(?:" + "|".join(map(_regex, self.options)) + ")"


def _regex(nodes: tuple) -> str:
    return "".join(n.regex() for n in nodes)


class _Reader:
    def __init__(self, glob: str):
        self.glob, self.at = glob, 0

    def sequence(self, ends: str) -> tuple:
        """Nodes up to a character of ``ends`` or the end of the glob."""
        nodes, text = [], ""
        while self.at < len(self.glob) and self.glob[self.at] not in ends:
            sign = self.glob[self.at]
            if sign not in "*{":
                text, self.at = text + sign, self.at + 1
                continue
            if text:
                nodes.append(Literal(text))
                text = ""
            nodes.append(self.star() if sign == "*" else self.choice())
        return (*nodes, Literal(text)) if text else tuple(nodes)

    def star(self) -> Star:
        double = self.glob.startswith("**", self.at)
        self.at += 2 if double else 1
        return Star(double)

    def choice(self) -> Choice:
        begin, options = self.at, []
        while self.at == begin or self.glob[self.at : self.at + 1] == ",":
            self.at += 1
            options.append(self.sequence(",}"))
        if self.at == len(self.glob):
            raise ConfigError(f"the choice at character {begin + 1} of glob {self.glob!r} has no closing brace")
        self.at += 1
        return Choice(tuple(options))


def parse(glob: str) -> tuple:
    return _Reader(glob).sequence("")


def to_regex(glob: str) -> str:
    """Matches the whole string, a trailing line break included (``\\z``, not ``$``)."""
    return f"^{_regex(parse(glob))}\\z"


def literal_prefix(glob: str) -> str:
    """What every match begins with; lets the optimizer push a cheap test below the regex."""
    nodes = parse(glob)
    return nodes[0].text if nodes and isinstance(nodes[0], Literal) else ""


def matches(column: Column, glob: str) -> Column:
    prefix, regex = literal_prefix(glob), F.rlike(column, F.lit(to_regex(glob)))
    if prefix == glob:
        return column == glob
    if glob == "**":
        return F.instr(column, "\n") == 0
    return F.startswith(column, F.lit(prefix)) & regex if prefix else regex


def matches_any(column: Column, globs: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (matches(column, g) for g in globs), F.lit(False))
