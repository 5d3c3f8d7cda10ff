"""Graph operators on small graphs, and on random ones against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import globs, paths
from causeway.model import KINDS, ConfigError
from causeway.operators import edges as E
from causeway.operators import metrics as M
from causeway.operators import recurse as R
from causeway.operators import rules as C
from causeway.operators.components import connected_components


def frame(spark, rows, kind="value"):
    rows = [(*r, kind, 1, None)[:5] if len(r) == 2 else (r[0], r[1], r[2], r[3] if len(r) > 3 else 1, r[4] if len(r) > 4 else None) for r in rows]
    return spark.createDataFrame(rows, "src string, dst string, kind string, weight long, line int")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def plain_reach(pairs, a):
    seen, todo = set(), [a]
    while todo:
        for x, y in pairs:
            if x == todo[0] and y not in seen:
                seen.add(y)
                todo.append(y)
        todo.pop(0)
    return seen - {a}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("local", [True, False])
def test_random_graphs(spark, seed, local, monkeypatch):
    if not local:
        monkeypatch.setattr(R, "LOCAL_EDGES", 0)
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(14):02d}", f"n{rng.randrange(14):02d}") for _ in range(18)}
    e = frame(spark, sorted(pairs))
    names = sorted({x for p in pairs for x in p})
    down = {a: plain_reach(pairs, a) for a in names}
    assert {tuple(r) for r in R.closure(e).collect()} == {(a, b) for a in names for b in down[a]}
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    got = {r["id"]: (r["forward"], r["reverse"]) for r in R.reach_counts(e).collect()}
    assert {a: got.get(a, (0, 0)) for a in linked} == {a: (len(down[a]), sum(a in down[b] for b in names)) for a in linked}
    label = {a: min([a, *(b for b in down[a] if a in down[b])]) for a in names}
    assert dict(rows(R.strong_components(e))) == label
    groups = {}
    for a in names:
        groups.setdefault(label[a], []).append(a)
    want = sorted((g for g in groups.values() if len(g) > 1 or (g[0], g[0]) in pairs), key=lambda g: (-len(g), g[0]))
    assert [r[1] for r in rows(R.cycles(e), "id")] == want

    def depth(c, seen=()):
        return max((depth(label[b], (*seen, c)) + 1 for a, b in pairs if label[a] == c != label[b]), default=0)

    assert dict(rows(R.layers(ids(spark, [*names, "zz"]), e))) == {**{a: depth(label[a]) for a in names}, "zz": 0}
    if local:
        assert {r[0] for r in rows(R.affects(e, names[0]))} == {a for a in names if names[0] in down[a]}
        assert {r[0] for r in rows(R.cone(e, names[0], include_start=True))} == down[names[0]] | {names[0]}
        assert R.reaches(e, names[0], names[-1]) == (names[-1] in down[names[0]] or len(names) == 1)


def test_rounds_that_run_out_are_an_error(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(4)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 0)], "seed long, id long")
    assert R.reach(edges, seeds).count() == 4 and R.reaches(edges, 0, 4)
    with pytest.raises(RuntimeError):
        R.reach(edges, seeds, max_rounds=2)
    with pytest.raises(RuntimeError):
        R.reaches(edges, 0, 4, max_rounds=2)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    got = dict(rows(connected_components(e)))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert connected_components(e.limit(0)).count() == 0


def test_accumulate(spark):
    e = frame(spark, [("a", "b", "value", 1, 5), ("a", "b", "value", None, 2), ("a", "b", "type", 3, None)])
    assert rows(E.accumulate(e)) == [("a", "b", "type", 3, None), ("a", "b", "value", 2, 2)]


def test_folders(spark):
    e = frame(spark, [("src/a.ts", "src/b/index.ts", "value"), ("src/a.ts", "src/b/c.ts", "dynamic"), ("src/b/index.ts", "src/b/c.ts", "value"), ("root.ts", "src/a.ts", "type")])
    assert rows(E.folder_edges(e)) == [(".", "src", "type", 1), ("src", "src/b", "value", 2)]
    assert rows(E.folder_nodes(ids(spark, ["src/a.ts", "src/b/index.ts", "src/b/c.ts", "root.ts"]))) == [(".", 1), ("src", 1), ("src/b", 2)]


def test_unified(spark):
    nodes, edges = E.unified(ids(spark, ["a.ts", "b.ts"]), frame(spark, [("a.ts", "b.ts")]), ids(spark, ["a.ts#f", "b.ts#g", "a.ts#<module>"]), frame(spark, [("a.ts#f", "b.ts#g"), ("a.ts#<module>", "b.ts#g")], "call"))
    assert nodes.count() == 4
    assert rows(edges.select("src", "dst", "kind")) == [("a.ts", "b.ts", "value"), ("a.ts", "b.ts#g", "call"), ("a.ts#f", "b.ts#g", "call")]


def test_queries(spark):
    e, n = frame(spark, [("a", "b"), ("b", "c")]), ids(spark, ["a", "b", "c", "lonely"])
    row = E.query_node(n, e, "b").first()
    assert (row["imports"], row["imported_by"]) == (["c"], ["a"])
    assert E.query_node(n, e, "lonely").first()["imports"] == [] and E.query_node(n, e, "no").first() is None
    assert rows(R.affects(e, "c")) == [("a",), ("b",)] and rows(R.affects(e, "a")) == [] and rows(R.affects(e, "no")) == []
    assert rows(R.affects(frame(spark, [("a", "b"), ("b", "a")]), "a")) == [("b",)]


def test_annotations(spark):
    old = spark.createDataFrame([("a", "x"), ("gone", "y"), ("c", "o")], "id string, annotation string")
    new = spark.createDataFrame([("a", None), ("b", None), ("c", "n")], "id string, annotation string")
    assert rows(E.carry_annotations(old, new)) == [("a", "x"), ("b", None), ("c", "n")]
    assert rows(E.bake_annotations(new, old).select("id", "annotation", "baked")) == [("a", "x", True), ("b", None, False), ("c", "o", True)]


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [
        ("farm/barn/**", ["farm/barn/hay.py", "farm/barn/loft/x/y"], ["farm/barn", "farm/barns/x"]),
        ("field/*.row", ["field/a.row", "field/.row"], ["field/n/a.row", "field/a.row\n", "field/a_row"]),
        ("plough.py", ["plough.py"], ["ploughxpy", "plough.py\n", "a/plough.py"]),
        ("{hen,duck}s/**", ["hens/egg", "ducks/a/b"], ["geese/egg", "hen,ducks/a", "hens"]),
        ("x{1,2{a,b},}y", ["x1y", "x2ay", "x2by", "xy"], ["x2y", "xay"]),
        ("**/gate", ["n/gate", "/gate", "a/b/gate"], ["gate", "agate"]),
        ("***", ["", "a/b"], []),
        ("{*,**/deep}.c", ["a.c", "x/y/deep.c"], ["x/a.c"]),
        ("odd}name,(1)+[2]?.\\Q\\E$^|", ["odd}name,(1)+[2]?.\\Q\\E$^|"], ["odd}name,(1)+[2]"]),
        ("**", ["", "m/n"], []),
    ],
)
def test_globs(spark, glob, yes, no):
    df = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "id string, want boolean")
    assert df.where(globs.matches(F.col("id"), glob) != F.col("want")).collect() == []
    assert df.where(F.rlike("id", F.lit(globs.to_regex(glob))) != F.col("want")).collect() == []


@pytest.mark.parametrize("glob", ["{", "a/{b", "{x,{y}", "p{q,r/**"])
def test_open_brace(glob):
    with pytest.raises(ConfigError, match="no closing brace"):
        globs.to_regex(glob)


def rule(**k):
    return C.parse_rule({"id": "r", "rationale": "x", **k})


def test_check(spark):
    files = ids(spark, ["cellar/jam.py", "kitchen/pot.py", "kitchen/pan.py", "hall/door.py"])
    e = frame(spark, [
        ("cellar/jam.py", "kitchen/pot.py", "value", 2, 7), ("cellar/jam.py", "kitchen/pan.py", "type", 1, 9), ("kitchen/pot.py", "cellar/jam.py", "dynamic"), ("hall/door.py", "cellar/jam.py", "value", 1, 4),
        ("hall/door.py", "kitchen/pot.py", "value", 1, 5), ("hall/door.py", "kitchen/pot.py", "type", 1, 6),
    ])
    cycles = {"file": spark.createDataFrame([(0, ["kitchen/pot.py", "cellar/jam.py"])], "id int, nodes array<string>")}
    layers = (C.Layer("stores", ("cellar/*", "attic/*")), C.Layer("rooms", ("kitchen/*", "cellar/**")))
    no_door = {"type": "forbidden-edge", "from": ["hall/**", "porch"], "to": "{kitchen,pantry}/*", "fix": "ask the cook"}
    free = {"ignore-type-imports": True}

    def run(exemptions=(), **k):
        return C.check(C.RuleSet(layers, (rule(**k),), exemptions), files, e, cycles)

    def found(result, *columns):
        return sorted(tuple(r[c] for c in columns) for r in result.violations.collect())

    assert found(run(**no_door), "src", "kind", "line", "fix") == [("hall/door.py", "type", 6, "ask the cook"), ("hall/door.py", "value", 5, "ask the cook")]
    assert found(run(**no_door, **free), "kind", "severity", "rationale") == [("value", "error", "x")]
    assert run(**no_door).dead_patterns == [("layer stores", "attic/*"), ("rule r", "porch")]
    # the first layer that matches counts; files of none are free
    assert found(run(type="layer-order"), "dst", "line") == [("kitchen/pan.py", 9), ("kitchen/pot.py", 7)]
    assert found(run(type="layer-order", **free), "message") == [('layer "stores" may not depend on layer "rooms": cellar/jam.py -> kitchen/pot.py',)]
    listed = (C.Exemption("r", "hall/*", "kitchen/*", "for now"), C.Exemption("r", "**", "**", "hidden by the one before"), C.Exemption("other", "hall/*", "**", "another rule's"))
    result = run(listed, **no_door)
    assert result.clean and result.unused_exemptions == list(listed[1:])
    assert found(run((C.Exemption("r", "**", "**", "cycles have no edge"),), type="no-cycles", level="file"), "message", "src") == [("file cycle: kitchen/pot.py <-> cellar/jam.py", None)]


@pytest.mark.parametrize(
    "text",
    [
        "[", "- a", "version: 2\nrules: [{id: r, type: no-cycles, level: file, rationale: x}]", "version: 1", "version: 1\nrules: [{id: r, type: other, rationale: x}]", "version: 1\nrules: [{type: no-cycles, level: file, rationale: x}]",
        "version: 1\nrules: [{id: r, type: no-cycles, level: file}]", "version: 1\nrules: [{id: r, type: layer-order, rationale: x}]", "version: 1\nrules: [{id: r, type: no-cycles, level: file, rationale: x}]\nexemptions: [{rule: q, reason: x}]",
        "version: 1\nrules: [{id: r, type: no-cycles, level: file, rationale: x}]\nexemptions: [{rule: r}]", "version: 1\nrules: [{id: r, type: forbidden-edge, rationale: x, from: [], to: a}]", "version: 1\nrules: [{id: r, type: forbidden-edge, rationale: x, from: 'a{b', to: a}]",
    ],
)
def test_bad_rules(text):
    with pytest.raises(ConfigError):
        C.parse_rule_set(text)


def test_good_rules():
    got = C.parse_rule_set("version: 1\nlayers: [{name: a, match: 'a/**'}]\nrules: [{id: r, type: no-cycles, level: package, rationale: x}, {id: s, type: layer-order, rationale: y}]\nexemptions: [{rule: s, from: a, reason: z}]")
    assert got.rules[0].level == "folder" and got.exemptions[0].dst == "**"


def test_containers(spark):
    df = ids(spark, ["a.ts", "a/b.ts", "a/b/c.ts#f"])
    assert [r[1] for r in rows(df.select("id", paths.containers("id")), "id")] == [["."], ["a"], ["a", "a/b", "a/b/c.ts"]]
    assert [r[1] for r in rows(df.select("id", paths.display_node("id", [".", "a"])), "id")] == ["a.ts", "a/b.ts", "a/b"]
    assert E.drill(["."], "a") == [".", "a"] and E.collapse([".", "a", "a/b"], "a") == ["."]


def test_encode_fans_and_layers(spark):
    n, e = ids(spark, ["a.ts", "b.ts", "c.ts", "d.ts"]), frame(spark, [("a.ts", "b.ts"), ("b.ts", "c.ts"), ("b.ts", "b.ts")])
    assert rows(E.dictionary_encode(n, e, KINDS))[0] == (0, 1, 0, 1)
    many = spark.range(1000).select(F.format_string("k%05d", "id").alias("id")).repartition(7)
    assert rows(E.positions(many, "id")) == [(f"k{i:05d}", i) for i in range(1000)]
    assert rows(E.view_hubs(n, e, 3)) == [("b.ts", 2, 2), ("c.ts", 1, 0)]
    assert rows(E.highlighted(e, "c.ts")) == [("b.ts",), ("c.ts",)] and rows(E.highlighted(e, "d.ts")) == [("d.ts",)]
    assert rows(E.fan_counts(n, e)) == [("a.ts", 0, 1), ("b.ts", 2, 2), ("c.ts", 1, 0), ("d.ts", 0, 0)]
    assert rows(R.view_layers(n, e)) == [("a.ts", 0), ("b.ts", 1), ("c.ts", 2), ("d.ts", -1)]


def test_labels_and_areas(spark):
    shown = spark.createDataFrame([("a/b.ts", "file", 0, 1, 3), ("a/b.ts#C.d", "function", 0, 0, 1), ("a/c", "folder", 4, 4, 0), ("top", "folder", 0, 2, 0), ("e.ts", "file", 0, 1, 0)], "id string, kind string, hidden int, files int, fns int")
    assert [r[0] for r in shown.select(paths.label_of("id", "kind", "hidden", "files", "fns")).collect()] == ["b.ts {3}", "C.d", "c +4", "top", "e.ts"]
    places = ids(spark, ["src/library/x.ts#f", "src/pages/p.tsx", "scripts", "prisma/s.ts", "scripted/a", "src/componentsX"])
    assert [r[0] for r in places.select(paths.area_of("id")).collect()] == ["lib", "pages", "tooling", "tooling", "other", "components"]
    assert places.select(paths.percent(F.lit(1), F.lit(0)), paths.saving(F.lit(30), F.lit(120)), paths.radius(F.lit("file"), F.lit(0), F.lit(0))).first() == (None, 75.0, 5.7)


def test_ranks_share_ties(spark):
    df = spark.createDataFrame([(k, float(x)) for k, xs in (("a", [3, 1, 3, 2, 3]), (None, [1, 1]), ("b", [])) for x in xs], "k string, x double")
    assert sorted((r["k"] or "", r["x"], r["r"]) for r in M.average_ranks(df, "x", "k", "r").collect()) == [("", 1.0, 1.5), ("", 1.0, 1.5), ("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 3.0, 4.0), ("a", 3.0, 4.0), ("a", 3.0, 4.0)]


def test_statistics(spark):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in ((1, 2), (2, 4), (2, 5), (3, 9))] + [("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "k string, x double, y double")
    got = {r["k"]: r for r in M.correlations(df, "x", "y", "k").collect()}
    assert got["flat"]["pearson"] is None or got["flat"]["pearson"] != got["flat"]["pearson"]
    assert abs(got["g"]["slope"] - 3.5) < 1e-9 and abs(got["g"]["spearman"] - 0.9486833) < 1e-6
    sizes = spark.createDataFrame([(x,) for x in (1, 2, 3, 4)], "forward long")
    assert tuple(M.cone_stats(sizes).first()) == (2.5, 3, 4) and tuple(M.cone_stats(sizes.limit(0)).first()) == (0.0, 0, 0)


@pytest.fixture(scope="module")
def high_keys(tmp_path_factory):
    """The smallest tables, part keys moved so that names of packages, modules and parts pass their printed widths."""
    import duckdb

    out = tmp_path_factory.mktemp("high")
    for name, keys in (("part", ["p_partkey"]), ("lineitem", ["l_partkey", "l_orderkey"])):
        moved = ", ".join(f"{k} + far AS {k}" for k in keys)
        duckdb.sql(f"COPY (SELECT t.* REPLACE ({moved}) FROM '/root/testdata/sf0.001/{name}.parquet' AS t, (VALUES (99920), (999920)) AS v(far)) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


PRINTED = ["display_node", "check_layer_order", "folder_nodes", "unified_graph", "folder_graph", "annotations_inherited", "cycles_folder", "check_no_cycles", "check_exempted", "folder_layers", "folder_layers_rounds", "initial_expanded", "folder_type_only", "frontier_nodes", "viz_layers", "cycle_realness", "level_summary", "frontier_aggregate", "node_areas", "unified_nodes", "check_forbidden"]


@pytest.mark.parametrize("name", PRINTED)
def test_names_beyond_their_printed_width(spark, high_keys, name):
    """Against the query's own SQL, which cuts long numbers."""
    import duckdb

    from causeway.plans import queries as Q

    db = duckdb.connect()
    for t in ("part", "lineitem"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{high_keys}/{t}.parquet'")
    want = db.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, high_keys).select(*[f"`{c}`" for c in want.columns])
    text = lambda found: sorted(repr(tuple(r)) for r in found)
    assert text(got.collect()) == text(want.fetchall())


def test_a_tie_of_one_ids_sides_goes_to_the_least(spark):
    nodes = spark.createDataFrame([("a/x.ts", (side,)) for side in ("shared", "backend", "tooling")], "id string, annotation struct<side: string>")
    for order in (F.asc("annotation.side"), F.desc("annotation.side")):
        assert E.frontier_nodes(nodes.orderBy(order).coalesce(1), ["."]).first()["side"] == "backend"


def test_functions_of_missing_parts_inherit_nothing(spark, tmp_path):
    """Against the query's own SQL, on lines of parts that the table of parts lacks."""
    import duckdb

    from causeway.plans import queries as Q

    db = duckdb.connect()
    for t, kept in (("part", "p_partkey % 3 <> 0"), ("lineitem", "true")):
        db.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/{t}.parquet' WHERE {kept}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = db.sql(Q.oracle_sql()["annotations_inherited"]).fetchall()
    assert want and sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in Q.queries()["annotations_inherited"](spark, str(tmp_path)).select("id", "annotation").collect())
