"""Facts of TypeScript sources from a token scan, without a type checker.

Module facts: static, re-exported and dynamic imports. Function facts:
declarations, calls, references, imported names, identifier uses. What needs types
(interface dispatch, calls on values of inferred classes) gives no fact, so function
graphs lack those edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_LEX = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\[\s\S]|[^"\\\n])*"?|'(?:\\[\s\S]|[^'\\\n])*'?)
    |(?P<tick>`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[\s\S])""",
    re.X,
)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_CHUNK = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")
#: Words behind which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of do else instanceof new void delete yield await throw".split())
_WORDS = frozenset("if for while switch catch return function new typeof await import super this else do case in of instanceof void delete yield throw class extends implements interface type enum const let var export default from as async static get set public private protected readonly abstract declare true false null undefined".split())

MODULE_SCHEMA = "path string, specifier string, kind string, line int, skipped int"
FACT_SCHEMA = "path string, fact string, name string, owner string, target string, line int, start int, stop int"


class Tokens:
    """Tokens without comments. A template without substitutions is one token; in others the text between
    them is of kind ``part`` and each substitution stands in brackets."""

    def __init__(self, text: str):
        self.kind, self.text, self.line = [], [], []
        at, line, open_ = 0, 1, []  # open_: for each template that is being read, how many braces are open in its substitution

        def put(kind: str, value: str) -> None:
            self.kind.append(kind)
            self.text.append(value)
            self.line.append(line)

        while at < len(text):
            m = _LEX.match(text, at)
            kind, value = m.lastgroup, m[0]
            if value == "}" and open_ and not open_[-1]:
                put("op", ")")
                open_.pop()
                kind, value = "chunk", "}"
            elif value == "/" and self._regex_may_begin() and (r := _REGEX.match(text, at)):
                kind, value = "regex", r[0]
            if kind in ("tick", "chunk"):
                inner = _CHUNK.match(text, at + 1)[0]
                end = at + 1 + len(inner)
                more = text.startswith("${", end)
                value = text[at : end + (2 if more else 1)]
                put("template" if kind == "tick" and not more else "part", value)
                if more:
                    put("op", "(")
                    open_.append(0)
            elif kind != "skip":
                put(kind, value)
                if open_ and kind == "op" and value in "{}":
                    open_[-1] += 1 if value == "{" else -1
            line += value.count("\n")
            at += len(value)
        self.close = {}
        stack = []
        for i, t in enumerate(self.text):
            if self.kind[i] == "op" and t in "([{":
                stack.append(i)
            elif self.kind[i] == "op" and t in ")]}" and stack:
                self.close[stack.pop()] = i

    def _regex_may_begin(self) -> bool:
        """Whether a slash can't be a division: behind no value."""
        if not self.text:
            return True
        kind, last = self.kind[-1], self.text[-1]
        return last in _BEFORE_REGEX if kind == "name" else kind == "op" and last not in (")", "]")

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def literal(self, i: int) -> str | None:
        """The text of a string or of a template without substitutions."""
        if 0 <= i < len(self.text) and (self.kind[i] == "string" or self.kind[i] == "template"):
            return self.text[i][1:-1]
        return None

    def top_level(self) -> Iterator[int]:
        """Places where no bracket is open."""
        i = 0
        while i < len(self.text):
            yield i
            i = self.close.get(i, i) + 1


def _named(t: Tokens, i: int) -> tuple[list[tuple[str, str, bool]], int]:
    """((exported name, local name, type only), place behind) of a brace list."""
    end, out, part = t.close.get(i, len(t)), [], []
    for k in range(i + 1, end + 1):
        if k == end or t.at(k) == ",":
            if part:
                only = len(part) > 1 and part[0] == "type" and part[1] != "as"
                part = part[1:] if only else part
                out.append((part[0], part[-1], only))
            part = []
        else:
            part.append(t.at(k))
    return out, end + 1


def _clause(t: Tokens, i: int) -> tuple[list[tuple[str, str]], bool, int]:
    """((imported, local) names, whether all of them are types, place of ``from`` or the specifier)."""
    names, only, bare = [], t.at(i) == "type" and t.at(i + 1) not in ("from", ","), True
    i += only
    types: list[bool] = []
    while i < len(t) and t.at(i) != "from" and t.literal(i) is None:
        if t.at(i) == "{":
            part, i = _named(t, i)
            names += [(a, b) for a, b, _ in part]
            types += [x for *_, x in part]
        elif t.at(i) == "*":
            types.append(False)
            i += 3 if t.at(i + 1) == "as" else 1
        else:
            if t.kind[i] == "name":
                names.append(("default", t.at(i)))
                types.append(False)
            i += 1
        bare = False
    return names, only or (not bare and bool(types) and all(types)), i


def in_markup(t: Tokens, i: int) -> bool:
    """Whether a token stands behind a tag on its line: text of JSX, not a statement."""
    return t.at(i - 1) == ">" and i > 0 and t.line[i - 1] == t.line[i]


def module_imports(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(specifier, kind, line, skipped); static forms at the top level only, dynamic ones anywhere."""
    t, found = Tokens(text), []
    for i in t.top_level():
        word, before = t.at(i), t.at(i - 1)
        if word not in ("import", "export") or before == "." or in_markup(t, i):
            continue
        if word == "import" and t.at(i + 1) not in ("(", "."):
            if t.at(i + 2) == "=" and t.at(i + 3) == "require":
                found.append((i, t.literal(i + 5), "value"))
                continue
            _, only, k = _clause(t, i + 1)
            found.append((i, t.literal(k + (t.at(k) == "from")), "type" if only else "value"))
        elif word == "export" and t.at(i + 1) in ("{", "*", "type"):
            k = i + 1 + (t.at(i + 1) == "type")
            only, types = t.at(i + 1) == "type", [False]
            if t.at(k) == "{":
                part, k = _named(t, k)
                types = [x for *_, x in part]
            elif t.at(k) == "*":
                k += 3 if t.at(k + 1) == "as" else 1
            else:
                continue
            if t.at(k) == "from":
                found.append((i, t.literal(k + 1), "type" if only or (types and all(types)) else "value"))
    for i in range(len(t)):
        if t.at(i) == "import" and t.kind[i] == "name" and t.at(i + 1) == "(" and t.at(i - 1) != ".":
            target = t.literal(i + 2) if t.at(i + 3) in (")", ",") else None
            found.append((i, target, "dynamic"))
    for i, target, kind in sorted(found, key=lambda x: x[0]):
        if target is not None:
            yield target, kind, t.line[i], 0
        elif kind == "dynamic":
            yield "", kind, t.line[i], 1


def _functions(t: Tokens) -> list[tuple[str, int, int, int]]:
    """(name, first token, last token, token that names it) of declarations with a body."""
    out = []
    classes = []
    for i in range(len(t)):
        if t.at(i) == "class" and t.kind[i] == "name" and t.at(i - 1) != "." and t.kind[min(i + 1, len(t) - 1)] == "name" and t.at(i + 1) not in ("extends", "implements"):
            k = i + 2
            while k < len(t) and t.at(k) != "{":
                k += 1
            classes.append((t.at(i + 1), k, t.close.get(k, len(t))))

    def body(k: int) -> int | None:
        """End of the block behind a parameter list that closes at ``k``; None for a mere signature."""
        k += 1
        while k < len(t) and t.at(k) not in ("{", ";", "}", "=>"):
            k = t.close.get(k, k) + 1
        return t.close.get(k) if t.at(k) == "{" else None

    for i in range(len(t)):
        if t.at(i) == "function" and t.kind[i] == "name":
            k = i + 1 + (t.at(i + 1) == "*")
            named = k < len(t) and t.kind[k] == "name"
            if not named and "default" not in (t.at(i - 1), t.at(i - 2)):
                continue
            p = k + named
            while p < len(t) and t.at(p) != "(":
                p += 1
            end = body(t.close.get(p, len(t)))
            if end is not None and t.at(i - 1) != "=":
                out.append((t.at(k) if named else "default", i, end, k if named else i))
        elif t.at(i) in ("const", "let", "var") and t.kind[i] == "name" and i + 1 < len(t) and t.kind[i + 1] == "name":
            k = i + 2
            while k < len(t) and t.at(k) not in ("=", ";", ",", "=>") and t.line[k] == t.line[i]:
                k = t.close.get(k, k) + 1
            if t.at(k) == "=":
                k += 1 + (t.at(k + 1) == "async")
                end = None
                if t.at(k) == "function":
                    p = k
                    while p < len(t) and t.at(p) != "(":
                        p += 1
                    end = body(t.close.get(p, len(t)))
                elif t.at(k) == "(" or (k < len(t) and t.kind[k] == "name" and t.at(k + 1) == "=>"):
                    p = (t.close.get(k, len(t)) if t.at(k) == "(" else k) + 1
                    while p < len(t) and t.at(p) not in ("=>", ";", "{", ",", ")"):
                        p = t.close.get(p, p) + 1
                    if t.at(p) == "=>":
                        end = p + 1
                        if t.at(end) == "{":
                            end = t.close.get(end, len(t))
                        else:
                            while end < len(t) and t.at(end) not in (";", ",") and (end == p + 1 or t.line[end] == t.line[end - 1] or t.at(end) == "."):
                                end = t.close.get(end, end) + 1
                            end -= 1
                if end is not None:
                    out.append((t.at(i + 1), i + 1, end, i + 1))
    for name, a, b in classes:
        i = a + 1
        while i < b:
            if t.at(i) == "(" and t.kind[i - 1] in ("name", "string") and t.at(i - 1) not in ("if", "for", "while", "switch"):
                end = body(t.close.get(i, len(t)))
                if end is not None:
                    out.append((f"{name}.{t.at(i - 1).strip(chr(34) + chr(39))}", i - 1, end, i - 1))
                    i = end
                else:
                    i = t.close.get(i, i)
            elif t.at(i) in ("[", "{"):
                i = t.close.get(i, i)
            i += 1
    return out


def facts(text: str) -> Iterator[tuple[str, str, str | None, str | None, int, int, int]]:
    """(fact, name, owner, target, line, start, stop).

    ``function``: a declaration; ``import``: local name, imported name as owner,
    specifier as target; ``call``, ``method`` (on ``this``), ``new``, ``reference``:
    a use at token ``start``; ``binding`` and ``use``: for unused imports.
    """
    t = Tokens(text)
    declared = _functions(t)
    for name, a, b, _ in declared:
        yield "function", name, None, None, t.line[a], a, b
    skip = {k for *_, k in declared}
    for i in t.top_level():
        if t.at(i) == "import" and t.at(i + 1) not in ("(", ".") and t.at(i - 1) != "." and not in_markup(t, i):
            names, _, k = _clause(t, i + 1)
            end = k + (t.at(k) == "from")
            for imported, local in names:
                yield "import", local, imported, t.literal(end), t.line[i], i, end
            for k in range(i, end):
                if t.kind[k] == "name":
                    skip.add(k)
            for local in {b for _, b in names} | {t.at(k + 2) for k in range(i, end) if t.at(k) == "*" and t.at(k + 1) == "as"}:
                yield "binding", local, None, None, next((t.line[k] for k in range(i, end) if t.at(k) == local), t.line[i]), i, end
    for i in range(len(t)):
        if t.kind[i] != "name" or i in skip:
            continue
        name, before, after = t.at(i), t.at(i - 1), t.at(i + 1)
        if before not in (".", "?."):
            yield "use", name, None, None, t.line[i], i, i
        if name in _WORDS:
            continue
        if before == "." and t.at(i - 2) == "this":
            yield ("method" if after == "(" else "member"), name, None, None, t.line[i], i, i
        elif before in (".", "?.") or after == ":" and before in ("{", ",", "(", "?"):
            continue
        elif before == "new":
            yield "new", name, None, None, t.line[i], i, i
        elif after == "(":
            if before != "function":
                yield "call", name, None, None, t.line[i], i, i
        elif before not in (":", "interface", "type", "enum", "class", "extends", "implements", "as", "const", "let", "var", "function", "<", "|") and after not in ("=>",):
            yield "reference", name, None, None, t.line[i], i, i


def extract_imports(files: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield pd.DataFrame([(p, *row) for p, x in zip(batch["path"], batch["text"]) if x is not None for row in module_imports(x)], columns=["path", "specifier", "kind", "line", "skipped"])

    return files.select("path", "text").mapInPandas(run, MODULE_SCHEMA)


def extract_facts(files: DataFrame) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in it:
            yield pd.DataFrame([(p, *row) for p, x in zip(batch["path"], batch["text"]) if x is not None for row in facts(x)], columns=["path", "fact", "name", "owner", "target", "line", "start", "stop"])

    return files.select("path", "text").mapInPandas(run, FACT_SCHEMA)
