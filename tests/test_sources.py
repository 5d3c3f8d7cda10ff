"""Source trees to graphs: small trees and the edges that they must give."""

import json

import pytest

from causeway import cli
from causeway.model import ConfigError
from causeway.operators import resolve
from causeway.plans import build, report
from causeway.sources import python_source, trees, typescript_source

HARBOUR = {
    "docks/crane.ts": 'import { weigh } from "../scale";\nimport * as log from "./journal";\nexport function lift(kilos: number) {\n  log.note(kilos);\n  return weigh(kilos) > 10 ? import("./tug") : null;\n}\nexport const call = (place: string) => import(place);\n',
    "docks/journal.ts": "export function note(x: number) {}\n",
    "docks/tug.ts": 'import "./journal";\n',
    "scale/index.ts": 'export { weigh } from "./beam";\n',
    "scale/beam.ts": "export const weigh = (k: number) => k / 1000;\n",
}
TIDES = {
    "moon.ts": 'import type { Sea } from "./sea";\nexport type Phase = "new" | "full";\nexport const pull = (s: Sea) => s.depth;\n',
    "sea.ts": 'import { type Phase } from "./moon";\nimport { type Wind, blow } from "./wind";\nexport type Sea = { depth: number; phase: Phase };\nexport const swell = () => blow(3);\n',
    "wind.ts": 'export type { Phase } from "./moon";\nexport type Wind = number;\nexport const blow = (x: Wind) => x;\n',
}
CLOCK = {
    "face.ts": 'import { tick, tock as after } from "./gear";\nimport { Spring } from "./spring";\n\nexport function show(hours: number[]) {\n  tick();\n  tick();\n  return hours.map(after);\n}\n\nconst wound = new Spring(3);\n',
    "gear.ts": "export function tick(): number {\n  return tock() + 1;\n}\n\nexport const tock = (): number => tick() - 1;\n",
    "spring.ts": "export class Spring {\n  constructor(private turns: number) {}\n  release() {\n    this.turns = this.next();\n  }\n  next() {\n    return this.turns - 1;\n  }\n}\n\nexport function repair(): Spring {\n  return new Spring(0);\n}\n",
    "shape.ts": "export interface Hand {\n  turn(): void;\n}\nexport function turnAll(hands: Hand[]) {\n  hands.forEach((h) => h.turn());\n}\n",
}
ORCHARD = {
    "orchard/__init__.py": "", "orchard/tree.py": "from . import soil\nfrom .fruit import apple, pear\n", "orchard/soil.py": "import os\n", "orchard/fruit.py": "import orchard.soil as ground\n", "press.py": "import orchard.tree\nfrom orchard import fruit\n",
}
MILL = {
    "mill/__init__.py": "", "mill/wheel.py": "grain = 1\n", "mill/sieve.py": "name = input()\nmesh = __import__(name)\n",
    "mill/stone.py": 'import typing as t\nimport importlib\nif t.TYPE_CHECKING:\n    from mill.wheel import grain\nflour = importlib.import_module("mill.sieve")\n',
}


def tree(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def edges(graph):
    return [tuple(r) for r in graph.edges.orderBy("src", "dst", "kind").select("src", "dst", "kind").collect()]


def members(graph):
    return [r["nodes"] for r in graph.cycles.orderBy("id").collect()]


def test_typescript_modules(spark):
    got = build.typescript_project(tree(spark, HARBOUR))
    assert edges(got.files) == [
        ("docks/crane.ts", "docks/journal.ts", "value"), ("docks/crane.ts", "docks/tug.ts", "dynamic"), ("docks/crane.ts", "scale/index.ts", "value"), ("docks/tug.ts", "docks/journal.ts", "value"), ("scale/index.ts", "scale/beam.ts", "value"),
    ]
    assert got.skipped_dynamic == 1 and members(got.files) == []
    assert got.files.edges.where("dst = 'docks/journal.ts' AND src = 'docks/crane.ts'").first()["line"] == 2
    size = got.files.nodes.where("id = 'docks/tug.ts'").first()
    assert (size["bytes"], size["loc"]) == (len(HARBOUR["docks/tug.ts"]), 2)


def test_types_and_reexports(spark):
    got = build.typescript_project(tree(spark, TIDES))
    assert edges(got.files) == [("moon.ts", "sea.ts", "type"), ("sea.ts", "moon.ts", "type"), ("sea.ts", "wind.ts", "value"), ("wind.ts", "moon.ts", "type")]
    assert members(got.files) == [["moon.ts", "sea.ts", "wind.ts"]]


def test_aliases(spark):
    config = '{ /* short names */ "compilerOptions": {"baseUrl": "./", "paths": {"~tools/*": ["kit/*"], "rope": ["kit/rope.ts"],},}}'
    files = {"boat.ts": 'import knot from "~tools/knot.mjs";\nimport rope from "rope";\nimport sail from "sailcloth";\n', "kit/knot.mts": "export default 1;\n", "kit/rope.ts": "export default 2;\n"}
    assert edges(build.typescript_project(tree(spark, files), aliases=trees.path_aliases(config)).files) == [("boat.ts", "kit/knot.mts", "value"), ("boat.ts", "kit/rope.ts", "value")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("import 'side';", [("side", "value", 1, 0)]),
        ("import old = require('cjs');", [("cjs", "value", 1, 0)]),
        ("import {} from 'bare';", [("bare", "value", 1, 0)]),
        ("import * as all from 'space';", [("space", "value", 1, 0)]),
        ("import one, { type Two } from 'both';", [("both", "value", 1, 0)]),
        ("export * from 'whole';\nexport * as part from 'named';", [("whole", "value", 1, 0), ("named", "value", 2, 0)]),
        ("/* import a from 'block'; */ // import b from 'line'\nlet t = \"import c from 'text'\";", []),
        ("const f = () => import(`tpl`);", [("tpl", "dynamic", 1, 0)]),
        ("import(`a/${b}`);", [("", "dynamic", 1, 1)]),
        ("if (import.meta.env) { }", []),
        ("const q = /['\"]/; import a from './behind';", [("./behind", "value", 1, 0)]),
        ("x = a / b; import c from 'd'; y = e / 'f';", [("d", "value", 1, 0)]),
        ("`${ `${import('deep')}` } ${ {k: import('brace')} }`;\nimport z from 'after';", [("deep", "dynamic", 1, 0), ("brace", "dynamic", 1, 0), ("after", "value", 2, 0)]),
        ("export const T = <b>import x from 'markup'</b>;", []),
    ],
)
def test_import_forms(text, want):
    assert list(typescript_source.module_imports(text)) == want


def test_functions(spark):
    got = build.typescript_project(tree(spark, CLOCK), functions=True)
    found = edges(got.functions)
    wanted = [
        ("face.ts#<module>", "spring.ts#Spring.constructor", "call"), ("face.ts#show", "gear.ts#tick", "call"), ("face.ts#show", "gear.ts#tock", "reference"), ("gear.ts#tick", "gear.ts#tock", "call"), ("gear.ts#tock", "gear.ts#tick", "call"),
        ("spring.ts#Spring.release", "spring.ts#Spring.next", "call"), ("spring.ts#repair", "spring.ts#Spring.constructor", "call"),
    ]
    assert [e for e in wanted if e not in found] == [] and not [e for e in found if e[0] == "shape.ts#turnAll"]
    assert got.functions.edges.where("src = 'face.ts#show' AND kind = 'call'").first()["weight"] == 2
    assert members(got.functions) == [["gear.ts#tick", "gear.ts#tock"]]
    unified = build.unified_graph(got.files, got.functions)
    assert ("face.ts", "spring.ts#Spring.constructor", "call") in edges(unified) and unified.cycles.isEmpty()


def test_two_imports_on_a_line_stay_apart(spark):
    files = {"a.ts": "import { f } from './b'; import { g } from './c';\nexport const h = () => f() + g();\n", "b.ts": "export function f() { return 1; }\nexport function g() { return 0; }\n", "c.ts": "export function g() { return 2; }\n"}
    got = build.typescript_project(tree(spark, files), functions=True)
    assert [e for e in edges(got.functions) if e[0] == "a.ts#h"] == [("a.ts#h", "b.ts#f", "call"), ("a.ts#h", "c.ts#g", "call")]


def test_unused_imports(spark):
    files = {"cook.ts": "import { salt, pepper } from './spice';\nimport type { Dish } from './menu';\nimport * as pans from './pans';\nimport './stove';\nexport const serve = (d: Dish) => `${salt(d)}`;\n", "menu.ts": ""}
    found = build.typescript_project(tree(spark, files)).unused.orderBy("line").collect()
    assert [tuple(r) for r in found] == [("cook.ts", 1, "pepper"), ("cook.ts", 3, "pans")]


def test_python_packages(spark):
    got = build.python_project(tree(spark, ORCHARD))
    assert edges(got.files) == [
        ("orchard/fruit.py", "orchard/soil.py", "value"), ("orchard/tree.py", "orchard/__init__.py", "value"), ("orchard/tree.py", "orchard/fruit.py", "value"), ("orchard/tree.py", "orchard/soil.py", "value"),
        ("press.py", "orchard/__init__.py", "value"), ("press.py", "orchard/fruit.py", "value"), ("press.py", "orchard/tree.py", "value"),
    ]
    assert got.files.edges.where("src = 'press.py' AND dst = 'orchard/fruit.py'").first()["line"] == 2


def test_python_kinds(spark):
    got = build.python_project(tree(spark, MILL))
    assert edges(got.files) == [("mill/stone.py", "mill/sieve.py", "dynamic"), ("mill/stone.py", "mill/wheel.py", "type")]
    assert got.skipped_dynamic == 1


def test_python_cycle_and_skipped_folders(spark):
    files = {"a.py": "import b\n", "b.py": "import a\n", ".x/c.py": "import a\n", "venv/d.py": "import a\n"}
    got = build.python_project(tree(spark, files))
    assert members(got.files) == [["a.py", "b.py"]] and got.files.nodes.count() == 2


def test_source_root_keys(spark):
    ids = spark.createDataFrame([(x,) for x in ("src/p/__init__.py", "src/p/q/__init__.py", "src/p/q/m.py", "top.py")], "id string")
    assert {tuple(r) for r in resolve.python_keys(ids).collect()} == {("src.p", "src/p/__init__.py"), ("p", "src/p/__init__.py"), ("src.p.q", "src/p/q/__init__.py"), ("p.q", "src/p/q/__init__.py"), ("src.p.q.m", "src/p/q/m.py"), ("p.q.m", "src/p/q/m.py"), ("top", "top.py")}


def test_python_statements():
    text = "from ...high.up import (north,\n  south as down,)  # both\nimport wind.west as w, rain\nsay = 'from quoted import no' + \"import neither\"\nfrom . import here"
    assert [r[:6] for r in python_source.imports(text)] == [(True, "high.up", ["north", "south"], 3, "value", 1), (False, "wind.west", [], 0, "value", 3), (False, "rain", [], 0, "value", 3), (True, "", ["here"], 1, "value", 5)]
    assert [r[1] for r in python_source.imports("r\"\"\"\nimport inside\n\"\"\"; y\nimport outside")] == ["outside"]
    guarded = "if TYPE_CHECKING:\n  import a\n  for x in y:\n    from b import c\nelif z:\n  import d\nif not TYPE_CHECKING:\n  import e\nif TYPE_CHECKING: import f\nimport g"
    assert [(r[1], r[4]) for r in python_source.imports(guarded)] == [("a", "type"), ("b", "type"), ("d", "value"), ("e", "value"), ("g", "value")]
    dynamic = "__import__('one.two')\nimportlib . import_module( \"three\" , 'pkg')\nmod = importlib.import_module(f'{x}')\nmy_import_module('no')\nprint('__import__(4)')"
    assert [(r[1], r[6]) for r in python_source.imports(dynamic)] == [("one.two", 0), ("three", 0), ("", 1), ("", 1)]
    assert [r[1:3] for r in python_source.imports("from a import b; import c\nfrom x import\nimport\nfromage = 1\nimport é, ok")] == [("a", ["b; import c"]), ("ok", [])]
    assert [(t, n) for t, n, _ in python_source.logical_lines("total = (1 +\n  2)\nleft \\\n right # note\n")] == [("total = (1 +   2)", 1), ("left  right", 3)]


def test_report(spark):
    got = build.typescript_project(tree(spark, HARBOUR), functions=True)
    text = report.render(build.folder_graph(got.files), got.files, got.functions, got.unused, got.skipped_dynamic)
    for line in ("| folder | 2 | 1 | 0 |", "| file | 5 | 5 | 0 |", "| 0 | `scale` | 2 | 1 | 0 |", "| 1 | `docks` | 3 | 0 | 1 |", "| `docks` | `scale` | value | 1 |", "| `docks/journal.ts` | 2 | 0 |", "No graph has one.", "1 dynamic imports"):
        assert line in text, line
    got = build.typescript_project(tree(spark, {f"{'low' if k == 'wind.ts' else 'high'}/{k}": v.replace("./wind", "../low/wind").replace("./moon", "../high/moon") for k, v in TIDES.items()}))
    text = report.render(build.folder_graph(got.files), got.files)
    for line in ("### File level: 1", "1. 3 members: `high/moon.ts`, `high/sea.ts`, `low/wind.ts`", "   - `high/moon.ts` line 1 uses `high/sea.ts` as type", "## Folders tied by types alone: 1", "- `low` to `high`", "### Folder level: 1"):
        assert line in text, line


def test_command_line(spark, tmp_path, capsys):
    for path, text in {**ORCHARD, "orchard/soil.py": "import orchard.tree\n"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    at = str(tmp_path)
    assert cli.main(["init", at], spark) == 0
    doc = json.loads((tmp_path / cli.FILES).read_text())
    assert doc["level"] == "file" and doc["cycles"] and "line" in doc["edges"][0] and "loc" not in doc["nodes"][0]
    doc["nodes"][0]["annotation"] = {"summary": "kept", "pure": True}
    (tmp_path / cli.FILES).write_text(json.dumps(doc))
    assert cli.main(["init", at], spark) == 0
    assert json.loads((tmp_path / cli.FILES).read_text())["nodes"][0]["annotation"] == {"summary": "kept", "pure": True}
    assert (tmp_path / "ARCHITECTURE.md").exists()
    capsys.readouterr()
    assert cli.main(["affects", "orchard/tree.py", "--dir", at], spark) == 0
    assert json.loads(capsys.readouterr().out)["affects"] == ["orchard/fruit.py", "orchard/soil.py", "press.py"]
    assert cli.main(["affects", "none.py", "--dir", at], spark) == 0
    assert json.loads(capsys.readouterr().out)["affects"] == []
    assert cli.main(["query", "none.py", "--dir", at], spark) == 2
    assert cli.main(["check", at], spark) == 1  # the starter's rules: no cycles of folders or files
    (cycle,) = json.loads(capsys.readouterr().out)["violations"]
    assert (cycle["rule"], cycle["severity"], cycle["message"]) == ("no-file-cycles", "error", "file cycle: orchard/fruit.py <-> orchard/soil.py <-> orchard/tree.py")
    (tmp_path / cli.RULES).write_text("version: 1\nrules:\n  - {id: r, type: forbidden-edge, rationale: x, from: press.py, to: 'orchard/f*', fix: y}\n")
    assert cli.main(["check", at], spark) == 1
    want = {"rule": "r", "severity": "error", "message": "forbidden edge: press.py -> orchard/fruit.py", "edge": {"from": "press.py", "to": "orchard/fruit.py", "kind": "value", "line": 2}, "rationale": "x", "fix": "y"}
    assert json.loads(capsys.readouterr().out)["violations"] == [want]
    (tmp_path / cli.RULES).write_text("version: 1\nrules:\n  - {id: r, type: forbidden-edge, rationale: x, from: press.py, to: 'orchard/s*'}\n")
    assert cli.main(["check", at], spark) == 0
    (tmp_path / cli.RULES).write_text("version: 2\n")
    assert cli.main(["check", at], spark) == 2
    assert cli.main(["lookup", "hubs", "--dir", at], spark) == 0
    assert cli.main(["viz", at, "--no-open"], spark) == 0 and {"trueCycles", '"ann": {"summary": "kept"'} <= {x for x in ("trueCycles", '"ann": {"summary": "kept"') if x in (tmp_path / "viz.html").read_text()}
    assert cli.main(["nothing"], spark) == 2 and cli.main([], spark) == 0
    with pytest.raises(ConfigError):
        trees.read_graph(spark, str(tmp_path / "missing.json"))


def test_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("repo\tarm\ttokens\tms\na\tx\t12\t3.5\nb\ty\t7\t1\tsurplus\n")
    rows = trees.read_measurements(spark, str(tmp_path / "m.tsv")).collect()
    assert [tuple(r) for r in rows] == [("a", "x", 12.0, 3.5), ("b", "y", 7.0, 1.0)]
    (tmp_path / "r.json").write_text('{"runs": [{"task": "t", "tokens": 5}, {"task": "u", "tokens": 6}]}')
    assert trees.read_runs_json(spark, str(tmp_path / "r.json")).count() == 2
    files = tree(spark, {"a": "import x\ny\n  export { z } from 'q'", "b": "no"})
    assert trees.import_lines(files).where("path = 'a'").first()["lines"] == "import x\n  export { z } from 'q'"
    got = trees.sources_of(spark.createDataFrame([("a",), ("c",), ("b",)], "id string"), files).first()
    assert got["missing"] == 1 and got["text"].endswith("no")
