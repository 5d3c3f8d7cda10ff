"""Recursive operators: reachability, closure, strong components, layers.

A graph falls apart into weakly connected islands, and no recursive answer crosses
one. Islands of up to ``LOCAL_EDGES`` edges are dealt to tasks by a hash of their
least id and solved there in linear passes; larger ones go through rounds of joins
over all executors (frontier steps, path doubling, colouring, relaxation), cut in
the shared folder. Which way an island goes changes nothing in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.components import connected_components
from causeway.shared import cut

LOCAL_EDGES = 2_000_000
#: Bit sets of all nodes' cones take a bit per pair of nodes, so islands of pairs are smaller.
CLOSURE_EDGES = 20_000
#: Rows that a task hands on at once.
ROWS = 50_000


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without self-edges: all that reachability needs."""
    return edges.select("src", "dst").where("src <> dst").distinct()


def reach(edges: DataFrame, seeds: DataFrame, include_start: bool = False, max_rounds: int | None = None) -> DataFrame:
    """(seed, id): what each row of ``seeds`` (seed, id) reaches, by frontier rounds.

    A start isn't in its own answer, even on a cycle, unless ``include_start``. Rounds
    go on until the frontier is empty; with ``max_rounds``, more of them are an error.
    """
    step = cut(pairs(edges))
    seen = frontier = cut(seeds.select("seed", "id").distinct())
    for n in count():
        if n == max_rounds:
            raise RuntimeError(f"the frontier isn't empty after {max_rounds} rounds")
        ahead = frontier.join(step, frontier["id"] == step["src"]).select("seed", F.col("dst").alias("id")).distinct()
        frontier = cut(ahead.join(seen, ["seed", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    return seen if include_start else seen.join(seeds.select("seed", "id"), ["seed", "id"], "left_anti")


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*[F.col({"src": "dst", "dst": "src"}.get(c, c)).alias(c) for c in edges.columns])


def affects(edges: DataFrame, node) -> DataFrame:
    """(id): everything that depends on ``node``, directly or not; the node itself left out."""
    start = edges.sparkSession.range(1).select(F.lit(node).alias("seed"), F.lit(node).alias("id"))
    return reach(reverse(edges), start).select("id")


def cone(edges: DataFrame, node, include_start: bool = False) -> DataFrame:
    """(id): everything that ``node`` depends on."""
    start = edges.sparkSession.range(1).select(F.lit(node).alias("seed"), F.lit(node).alias("id"))
    return reach(edges, start, include_start).select("id")


def reaches(edges: DataFrame, a, b, max_rounds: int | None = None) -> bool:
    """Whether ``b`` can be reached from ``a`` (always from itself); stops at the first hit."""
    if a == b:
        return True
    step, start = cut(pairs(edges)), edges.sparkSession.range(1).select(F.lit(a).alias("id"))
    seen = frontier = start
    for n in count():
        if n == max_rounds:
            raise RuntimeError(f"the frontier isn't empty after {max_rounds} rounds")
        ahead = frontier.join(step, frontier["id"] == step["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = cut(ahead.join(seen, "id", "left_anti"))
        if not frontier.where(F.col("id") == b).isEmpty():
            return True
        if frontier.isEmpty():
            return False
        seen = cut(seen.union(frontier))


class Local:
    """Adjacency of an island's or a task's edges; nodes in id order."""

    def __init__(self, src: list, dst: list):
        self.ids = sorted({*src, *dst})
        place = {x: i for i, x in enumerate(self.ids)}
        self.out: list[list[int]] = [[] for _ in self.ids]
        self.into: list[list[int]] = [[] for _ in self.ids]
        for a, b in {(place[s], place[d]) for s, d in zip(src, dst) if s != d}:
            self.out[a].append(b)
            self.into[b].append(a)

    def finished(self) -> list[int]:
        """Nodes in the order in which a depth-first walk leaves them."""
        order, seen = [], bytearray(len(self.ids))
        for root in range(len(self.ids)):
            if seen[root]:
                continue
            seen[root] = 1
            walk = [(root, iter(self.out[root]))]
            while walk:
                for w in walk[-1][1]:
                    if not seen[w]:
                        seen[w] = 1
                        walk.append((w, iter(self.out[w])))
                        break
                else:
                    order.append(walk.pop()[0])
        return order

    def strong(self) -> list[int]:
        """The least member of every node's strong component: the walk's order, then the reversed graph."""
        label = [-1] * len(self.ids)
        for root in reversed(self.finished()):
            if label[root] < 0:
                members, todo = [], [root]
                label[root] = root
                while todo:
                    v = todo.pop()
                    members.append(v)
                    for w in self.into[v]:
                        if label[w] < 0:
                            label[w] = root
                            todo.append(w)
                least = min(members)
                for v in members:
                    label[v] = least
        return label

    def depths(self, label: list[int]) -> dict[int, int]:
        """Longest path below each strong component: 0 depends on nothing."""
        needs: dict[int, set] = {c: set() for c in label}
        for v, ws in enumerate(self.out):
            needs[label[v]].update(label[w] for w in ws)
        users: dict[int, list] = {c: [] for c in needs}
        open_ = {}
        for c, n in needs.items():
            n.discard(c)
            open_[c] = len(n)
            for d in n:
                users[d].append(c)
        depth = dict.fromkeys(needs, 0)
        ready = [c for c, n in open_.items() if not n]
        for c in ready:
            for u in users[c]:
                depth[u] = max(depth[u], depth[c] + 1)
                open_[u] -= 1
                if not open_[u]:
                    ready.append(u)
        return depth

    def cones(self, ahead: list[list[int]], up: bool = True) -> tuple[list[int], dict[int, int]]:
        """(strong component of every node, bit set of what each component reaches along ``ahead``, itself included); ``up`` if ``ahead`` leads to lesser depths."""
        label = self.strong()
        members: dict[int, int] = {}
        for v, c in enumerate(label):
            members[c] = members.get(c, 0) | 1 << v
        found: dict[int, int] = {}
        depth = self.depths(label)
        near: dict[int, set] = {c: set() for c in members}
        for v, ws in enumerate(ahead):
            near[label[v]].update(label[w] for w in ws)
        for c in sorted(members, key=depth.__getitem__, reverse=not up):
            bits = members[c]
            for d in near[c]:
                if d != c:
                    bits |= found[d]
            found[c] = bits
        return label, found

    def counts(self) -> Iterator[tuple[int, int, int]]:
        """(node, nodes that it reaches, nodes that reach it), itself left out."""
        forward, reverse = ({c: x.bit_count() - 1 for c, x in self.cones(*way)[1].items()} for way in ((self.out,), (self.into, False)))
        for v, c in enumerate(self.strong()):
            yield v, forward[c], reverse[c]

    def closure(self) -> Iterator[tuple[int, int]]:
        """(a, b) for every b that a reaches, a itself left out."""
        label, below = self.cones(self.out)
        for v, c in enumerate(label):
            bits = below[c] & ~(1 << v)
            while bits:
                low = bits & -bits
                yield v, low.bit_length() - 1
                bits ^= low


def islands(edges: DataFrame) -> DataFrame:
    """Edges with the least id of their weakly connected component."""
    found = connected_components(edges).select(F.col("id").alias("src"), F.col("component").alias("island"))
    return edges.join(found, "src", "left").withColumn("island", F.coalesce("island", "src"))


def _split(edges: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(edges of islands of at most so many, which fit a task; the others or None)."""
    parts = cut(islands(edges))
    most = LOCAL_EDGES if most is None else most
    big = cut(parts.groupBy("island").agg(F.count("*").alias("n")).where(F.col("n") > most).select("island"))
    if big.isEmpty():
        return parts, None
    return parts.join(big, "island", "left_anti"), parts.join(big, "island", "left_semi")


def _solve(small: DataFrame, solve: Callable[[Local], Iterator[tuple]], types: list[str], names: list[str]) -> DataFrame:
    kind = small.schema["src"].dataType

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, src, dst = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            found = iter(solve(Local(src, dst)))
            while rows := list(islice(found, ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow[t]) for i, t in enumerate(types)], names)

        id_type = None
        for batch in it:
            id_type = id_type or batch.schema.field("src").type
            arrow = {"id": id_type, "int": pa.int32()}
            for k, s, d in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("island", "src", "dst"))):
                if k != island and src:
                    yield from done()
                    src, dst = [], []
                island = k
                src.append(s)
                dst.append(d)
        if src:
            yield from done()

    schema = ", ".join(f"{n} {kind.simpleString() if t == 'id' else t}" for n, t in zip(names, types))
    return small.select("island", "src", "dst").distinct().repartition("island").sortWithinPartitions("island").mapInArrow(run, schema)


def closure(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(src, dst): all pairs with a path, a start paired with itself left out."""
    small, big = _split(pairs(edges), min(CLOSURE_EDGES, LOCAL_EDGES) if local_edges is None else local_edges)
    out = _solve(small, lambda g: ((g.ids[a], g.ids[b]) for a, b in g.closure()), ["id", "id"], ["src", "dst"])
    return out if big is None else out.union(_doubling(big))


def reach_counts(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(id, forward, reverse) of every node of an edge to another: how many nodes it reaches and is reached by."""
    small, big = _split(pairs(edges), min(CLOSURE_EDGES, LOCAL_EDGES) if local_edges is None else local_edges)
    out = _solve(small, lambda g: ((g.ids[v], f, r) for v, f, r in g.counts()), ["id", "int", "int"], ["id", "forward", "reverse"])
    if big is None:
        return out
    ends = _doubling(big).select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("f"), F.lit(0).alias("r")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("f"), F.lit(1).alias("r")))).alias("e")).select("e.*")
    return out.unionByName(ends.groupBy("id").agg(F.sum("f").cast("int").alias("forward"), F.sum("r").cast("int").alias("reverse")))


def _doubling(edges: DataFrame) -> DataFrame:
    """Paths of up to 2**k steps after k rounds."""
    paths, before = cut(pairs(edges)), -1
    while (now := paths.count()) != before:
        before = now
        ahead = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").where("src <> dst")
        paths = cut(paths.union(ahead).distinct())
    return paths


def strong_components(edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(id, scc): every node of an edge, and the least id of its strong component."""
    small, big = _split(edges.select("src", "dst").distinct(), local_edges)
    out = _solve(small, lambda g: ((g.ids[v], g.ids[c]) for v, c in enumerate(g.strong())), ["id", "id"], ["id", "scc"])
    return out if big is None else out.union(_colouring(big))


def _colouring(edges: DataFrame) -> DataFrame:
    """Forward least-label spreading, then backward confirmation within a colour; confirmed nodes leave."""
    left, found = cut(edges.select("src", "dst").distinct()), None
    nodes = cut(left.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    while not nodes.isEmpty():
        colour = cut(nodes.select("id", F.col("id").alias("c")))
        changed = True
        while changed:
            ahead = left.join(colour, left["src"] == colour["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("n"))
            new = cut(colour.join(ahead, "id", "left").select("id", F.least("c", F.coalesce("n", "c")).alias("c"), (F.coalesce("n", "c") < F.col("c")).alias("moved")))
            changed = not new.where("moved").isEmpty()
            colour = new.select("id", "c")
        inner = cut(left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst"))
        roots = colour.where("id = c").select(F.col("id").alias("seed"), "id")
        done = cut(reach(reverse(inner), roots, include_start=True).select("id", F.col("seed").alias("scc")))
        found = done if found is None else cut(found.union(done))
        nodes = cut(nodes.join(done, "id", "left_anti"))
        left = cut(left.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi"))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """(id, nodes): strong components of two or more, or with a self-edge, sorted members; ids by (size desc, first member).

    Only cycles are numbered in one partition: one row each, of all graph rows the fewest.
    """
    members = strong_components(edges)
    looped = edges.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("loop", F.lit(True))
    groups = members.join(looped, "id", "left").groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("nodes"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    kept = groups.where("size(nodes) > 1 OR loop")
    order = Window.orderBy(F.desc(F.size("nodes")), F.col("nodes")[0])
    return kept.select((F.row_number().over(order) - 1).cast("int").alias("id"), "nodes")


def layers(nodes: DataFrame, edges: DataFrame, local_edges: int | None = None) -> DataFrame:
    """(id, layer): 0 depends on nothing, a strong component shares a layer, each is one above its highest need."""
    small, big = _split(edges.select("src", "dst").distinct(), local_edges)

    def solve(g: Local) -> Iterator[tuple]:
        label = g.strong()
        depth = g.depths(label)
        return ((g.ids[v], depth[c]) for v, c in enumerate(label))

    found = _solve(small, solve, ["id", "int"], ["id", "layer"])
    found = found if big is None else found.union(_relaxation(big))
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("layer", F.lit(0)).alias("layer"))


def _relaxation(edges: DataFrame) -> DataFrame:
    label = cut(_colouring(edges))
    a, b = (label.select(F.col("id").alias(e), F.col("scc").alias(c)) for e, c in (("src", "cs"), ("dst", "cd")))
    needs = cut(edges.join(a, "src").join(b, "dst").where("cs <> cd").select("cs", "cd").distinct())
    depth, moved = cut(label.select(F.col("scc").alias("c")).distinct().withColumn("layer", F.lit(0))), True
    while moved:
        up = needs.join(depth, needs["cd"] == depth["c"]).groupBy(F.col("cs").alias("c")).agg((F.max("layer") + 1).alias("n"))
        new = cut(depth.join(up, "c", "left").select("c", F.greatest("layer", F.coalesce("n", F.lit(0))).alias("layer"), (F.coalesce("n", F.lit(0)) > F.col("layer")).alias("moved")))
        moved = not new.where("moved").isEmpty()
        depth = new.select("c", "layer")
    return label.join(depth, label["scc"] == depth["c"]).select("id", F.col("layer").cast("int").alias("layer"))


def view_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, layer) for drawing: 0 has nothing above it, nodes without outgoing edges lie lowest, isolated ones at -1, empty layers closed up.

    Self-edges count for whether a node has edges, not for its depth.
    """
    depth = layers(nodes, reverse(edges)).withColumnRenamed("layer", "depth")
    degree = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*").groupBy("id").agg(F.sum("o").alias("o"))
    rows = cut(depth.join(degree, "id", "left"))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    layer = F.when(F.col("o").isNull(), -1).when(F.col("o") == 0, deepest).otherwise(F.col("depth"))
    rows = rows.select("id", layer.alias("raw"))
    used = rows.where("raw >= 0").select("raw").distinct()
    dense = used.select("raw", (F.row_number().over(Window.orderBy("raw")) - 1).alias("layer"))
    return rows.join(dense, "raw", "left").select("id", F.coalesce("layer", F.lit(-1)).cast("int").alias("layer"))
