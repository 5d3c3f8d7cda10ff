"""Exact Jaccard join of word 5-gram sets by signature trees.

1. Documents with equal sets form a class; only classes go on.
2. Candidates: sets with similarity >= t share one of their first
   ``n - ceil(t n) + 1`` shingles in any common order. In ours, shingles of rare words
   come first, those of frequent words later, shingles that turned up often last
   (bounded lists of both, which change speed but not results), and the rest goes by
   hash; so few shingles are shared by chance. Shingles travel packed per batch and
   bucket. Lists of sets that share one are dealt anew by their least member; the sets
   send a parity signature (a bit per shingle hash, at least as many bits as shingles,
   XORed) to the buckets of their lists; the
   bits in which two signatures differ are no more than the shingles in which the
   sets differ, so pairs beyond the greatest allowed difference are dropped there,
   in memory. What is left are edges, reduced to a forest per bucket; every pair that
   may link stays in one connected component of edges.
3. Join: each candidate's set is sent once, to its component. There a signature
   tree holds OR-combined token bitmaps, size ranges and the most by which a set
   exceeds its bits; a dual traversal drops node pairs whose greatest possible
   overlap is too small, or whose sets are already connected, and compares the rest
   exactly. Components of over ``CHUNK`` sets are dealt to several tasks: first each
   part, then one set of every class of links found so far; what is still apart is
   compared, the lesser classes against all parts.
4. Links' components get their least doc_id.

Nothing is dropped or capped: each class of a component is either connected or was
compared with all others. Null, empty and wordless texts have size 0 and are their
own component (null for a null doc_id). Rows that share a set share a component; a
null doc_id never names one. Rows that share a doc_id but not a text are judged by
their texts. Empty tables give no rows. Extra columns are ignored by :func:`link`
and carried by :func:`keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.rows import by_number, column, may_have, parts, quoted, unused
from causeway.llm.textkernel import LOWER, Texts, batches, mix, shingle_sets, windows
from causeway.operators.components import connected_components
from causeway.shared import cut, drop, table

#: Similarity as a fraction, words of a shingle.
T_NUM, T_DEN, K = 3, 4, 5
#: Sets of a component that one task compares; shingles packed before they are sent; length of the list of frequent shingles.
CHUNK, PACK, FREQUENT, COMMON = 3000, 1 << 20, 100_000, 50_000
#: Shares that the rows of one label are dealt to.
SALTS = 16


def prefix_size(n: np.ndarray) -> np.ndarray:
    """How many of a set's first shingles a similar set must share one of."""
    return n - -(-n * T_NUM // T_DEN) + 1


def similar(overlap: int, a: int, b: int) -> bool:
    return overlap * (T_NUM + T_DEN) >= T_NUM * (a + b)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(int(x) for x in np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)]).view(np.int64))


def named(f: tuple[int, int], clashing: frozenset[int]) -> int:
    """A class's 64-bit name: the first half of its 128 bits, or the second where different classes share the first."""
    return f[1] if f[0] in clashing else f[0]


class Order:
    """Ranks of shingles: the levels of common words, and shingles that go last."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, late: np.ndarray):
        order = np.argsort(words)
        self.words, self.late = words[order], np.sort(late)
        per_million = counts[order] * 1e6 / max(1, total)
        self.level = np.clip(np.round(1.7 * np.log2(np.maximum(per_million, 1))), 0, 25).astype(np.int64)

    def sets(self, texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text, its sorted distinct shingles and their ranks (uint8), the same in every text."""
        start, end, first = texts.words()
        if not len(start):
            return [(np.zeros(0, np.uint64), np.zeros(0, np.uint8))] * texts.n
        codes = texts.spans(texts.prefix(LOWER[texts.data]), start, end)
        rows, at = windows(codes, first, K)
        level = np.zeros(len(codes) + 1, np.int64)
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
            np.cumsum(np.where(self.words[place] == codes, self.level[place], 0), out=level[1:])
        size = np.diff(at)
        begin = np.repeat(first[:-1], size) + np.arange(len(rows)) - np.repeat(at[:-1], size)
        rank = (level[begin + K] - level[begin]).astype(np.uint8)
        if len(self.late):
            rank[self.late[np.minimum(np.searchsorted(self.late, rows), len(self.late) - 1)] == rows] = 255
        out = []
        for i in range(texts.n):
            n = int(first[i + 1] - first[i])
            if n >= K:
                x = rows[at[i] : at[i + 1]]
                order = np.argsort(x)
                x = x[order]
                new = np.concatenate([[True], x[1:] != x[:-1]])
                out.append((x[new], rank[at[i] : at[i + 1]][order][new]))
            else:
                x = windows(codes[first[i] : first[i + 1]], np.array([0, n]), n)[0] if n else np.zeros(0, np.uint64)
                out.append((x, np.zeros(len(x), np.uint8)))
        return out


def measure(docs: DataFrame) -> DataFrame:
    """Rows of kind 0 (doc_id, n, f1, f2, signature) for documents, 1 and 2 (null, count, hash) for shingles in several sets of a batch and for words frequent in it, 3 for its number of words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "f1", "f2", "sig", "kind"]

        def counts(code: np.ndarray, n: np.ndarray, kind: int) -> pa.RecordBatch:
            k = len(code)
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(n.astype(np.int64)), pa.array(code.view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(np.full(k, kind, np.int32))], names)

        for batch in it:
            sets, words = [], []
            for t in batches(column(batch, "text")):
                sets += shingle_sets(t, K)
                start, end, _ = t.words()
                words.append(t.spans(t.prefix(LOWER[t.data]), start, end) if len(start) else np.zeros(0, np.uint64))
            f = [fingerprint(s) for s in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in f], pa.int64()), pa.array([x for _, x in f], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array(np.zeros(len(sets), np.int32))], names)
            once = list({x: s for x, s in zip(f, sets)}.values())
            for kind, data, least in ((1, np.concatenate(once) if once else np.zeros(0, np.uint64), 4), (2, np.concatenate(words) if words else np.zeros(0, np.uint64), 8)):
                code, n = np.unique(data, return_counts=True)
                yield counts(code[n >= least], n[n >= least], kind)
            yield counts(np.zeros(1, np.uint64), np.array([sum(map(len, words))]), 3)

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, sig binary, kind int")


def order_of(seen: DataFrame) -> Order:
    """At most ``COMMON`` words and ``FREQUENT`` shingles reach the driver.

    A histogram of counts (four steps to a doubling) says from which step on there are
    no more than that; so nothing is sorted and no task sees the counts of the others.
    """
    code, number = {}, {}
    for kind, most in ((1, FREQUENT), (2, COMMON)):
        counts = cut(seen.where(F.col("kind") == kind).groupBy("f1").agg(F.sum("n").alias("n")).withColumn("step", F.floor(4 * F.log2("n"))))
        least, left = 1 << 30, most
        for r in sorted(counts.groupBy("step").agg(F.count("*").alias("rows")).collect(), key=lambda r: -r["step"]):
            left -= r["rows"]
            if left < 0:
                break
            least = r["step"]
        top = counts.where(F.col("step") >= least).select("f1", "n").toPandas()
        code[kind], number[kind] = top["f1"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(float)
    total = seen.where("kind = 3").agg(F.sum("n")).first()[0] or 0
    return Order(code[2], number[2], total, code[1])


def _least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each of ``n`` nodes' components, by hooking and pointer jumping over arrays."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def _distinct_lists(members: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each different list once (by 128 bits of its members), in the order given."""
    if not len(size):
        return members, size
    begin = np.cumsum(size) - size
    code = members.view(np.uint64)
    sums = np.stack([np.add.reduceat(mix(code ^ np.uint64(salt)), begin) for salt in (0, 0xA5A5A5A55A5A5A5A)], 1)
    _, first = np.unique(sums, axis=0, return_index=True)
    if len(first) == len(size):
        return members, size
    keep = np.zeros(len(size), bool)
    keep[first] = True
    return members[np.repeat(keep, size)], size[keep]


def shared_lists(docs: DataFrame, order: Order, clashing: frozenset[int] = frozenset()) -> DataFrame:
    """One row per bucket: lists of classes of like size that share a prefix shingle.

    Lists are found by shingle and then dealt by their least member, equal ones once: what
    is alike shares most of its lists, so a class is in few buckets, however many there are.
    """
    spark = docs.sparkSession
    buckets, ship = parts(spark), spark.sparkContext.broadcast(order)

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            cid = np.array(list(held), np.int64)
            n = np.array([x for x, _ in held.values()], np.uint32)
            token = np.concatenate([x for _, x in held.values()]) if held else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(cid)), [len(x) for _, x in held.values()]) if held else np.zeros(0, np.int64)
            to = (mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            edges, out = np.searchsorted(to[order], np.arange(buckets + 1)), []
            for k in range(buckets):
                at = order[edges[k] : edges[k + 1]]
                if len(at):
                    who, local = np.unique(owner[at], return_inverse=True)
                    out.append((k, token[at].tobytes(), local.astype(np.uint32 if len(who) > 65535 else np.uint16).tobytes(), cid[who].tobytes(), n[who].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int32() if j == 0 else pa.binary()) for j in range(5)], ["bucket", "token", "local", "cid", "n"])

        for batch in it:
            for t in batches(column(batch, "text")):
                for s, rank in ship.value.sets(t):
                    if len(s) and (key := named(fingerprint(s), clashing)) not in held:
                        first = int(prefix_size(np.array(len(s))))
                        held[key] = (len(s), s[np.argsort(rank, kind="stable")[:first]])
                        size += first
                if size > PACK:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    def keep_shared(rows: pa.Table) -> pa.Table:
        token, cid, n = [], [], []
        for tk, lo, ci, nn in zip(*(rows.column(c).to_pylist() for c in ("token", "local", "cid", "n"))):
            tk = np.frombuffer(tk, np.uint64)
            local = np.frombuffer(lo, np.uint16 if len(lo) == 2 * len(tk) else np.uint32)
            token.append(tk)
            cid.append(np.frombuffer(ci, np.int64)[local])
            n.append(np.frombuffer(nn, np.uint32)[local])
        token, cid, n = np.concatenate(token), np.concatenate(cid), np.concatenate(n).astype(np.int64)
        order = np.lexsort((cid, n, token))
        token, cid, n = token[order], cid[order], n[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])
        token, cid, n = token[new], cid[new], n[new]
        near = (token[1:] == token[:-1]) & (n[:-1] * T_DEN >= n[1:] * T_NUM)
        used = np.zeros(len(token), bool)
        used[1:] |= near
        used[:-1] |= near
        cut_at = np.ones(len(token), bool)  # a list ends where the next size is too far
        cut_at[1:] = ~near
        members, group = cid[used], np.cumsum(cut_at)[used]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        members, size = _distinct_lists(members, np.diff(np.append(begin, len(members))))
        begin = np.cumsum(size) - size
        to = (mix(np.minimum.reduceat(members, begin).view(np.uint64)) % np.uint64(buckets)).astype(np.int64) if len(size) else np.zeros(0, np.int64)
        out = []
        for k in np.unique(to):
            some = np.flatnonzero(to == k)
            out.append((int(k), np.concatenate([members[begin[i] : begin[i] + size[i]] for i in some]).tobytes(), size[some].astype(np.int32).tobytes()))
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate((("bucket", pa.int32()), ("members", pa.binary()), ("sizes", pa.binary())))})

    def gather(rows: pa.Table) -> pa.Table:
        members, size = (np.concatenate([np.frombuffer(x, kind) for x in rows.column(c).to_pylist()]) for c, kind in (("members", np.int64), ("sizes", np.int32)))
        members, size = _distinct_lists(members, size.astype(np.int64))
        names, who = np.unique(members, return_inverse=True)
        first = np.zeros(len(members), bool)
        first[(np.cumsum(size) - size)[1:]] = True
        return pa.table({"bucket": rows.column("bucket").slice(0, 1), "cids": pa.array([names.tobytes()], pa.binary()), "who": pa.array([who.astype(np.int32).tobytes()], pa.binary()), "list": pa.array([first.tobytes()], pa.binary())})

    packed = docs.select("text").mapInArrow(pack, "bucket int, token binary, local binary, cid binary, n binary")
    met = by_number(by_number(packed, "bucket").groupBy("bucket").applyInArrow(keep_shared, "bucket int, members binary, sizes binary"), "bucket")
    return met.groupBy("bucket").applyInArrow(gather, "bucket int, cids binary, who binary, list binary")


def signature(s: np.ndarray) -> np.ndarray:
    """Parities of shingles by the low bits of their hashes; as many bits as the next power of two, 64 at least."""
    bits = max(64, 1 << int(len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class Signatures:
    """Signatures of many sets, by their number of bits; the longer of two is folded."""

    def __init__(self, sizes: np.ndarray, data: list[np.ndarray]):
        self.size, self.words = sizes, np.array([len(d) for d in data])
        self.rows, self.at = {}, np.zeros(len(data), np.int64)
        for w in np.unique(self.words):
            some = np.flatnonzero(self.words == w)
            self.at[some] = np.arange(len(some))
            self.rows[int(w)] = np.stack([data[i] for i in some])

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, out = self.size[i] + self.size[j], np.zeros(len(i), bool)
        fits = (self.size[i] * T_DEN >= self.size[j] * T_NUM) & (self.size[j] * T_DEN >= self.size[i] * T_NUM)
        for w in self.rows:
            for v in (x for x in self.rows if x >= w):
                for k in np.array_split(p := np.flatnonzero(fits & (np.minimum(self.words[i], self.words[j]) == w) & (np.maximum(self.words[i], self.words[j]) == v)), 1 + len(p) * v // (1 << 20)):
                    if len(k):
                        swap = self.words[i[k]] > self.words[j[k]]
                        a, b = np.where(swap, j[k], i[k]), np.where(swap, i[k], j[k])
                        long = self.rows[v][self.at[b]]
                        if v > w:
                            long = np.bitwise_xor.reduce(long.reshape(len(k), v // w, w), axis=1)
                        differ = np.bitwise_count(self.rows[w][self.at[a]] ^ long).sum(1, dtype=np.int64)
                        # |a xor b| = a + b - 2 overlap, and overlap >= T_NUM (a + b) / (T_NUM + T_DEN)
                        out[k] = differ * (T_NUM + T_DEN) <= n[k] * (T_DEN - T_NUM)
        return out


def list_edges(lists: np.ndarray, who: np.ndarray, known: Signatures) -> np.ndarray:
    """Least-member labels of sets after uniting all that may link within a list; ``lists`` ascends."""
    label = np.arange(len(known.size))

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        differ = label[i] != label[j]
        pair = np.unique(np.minimum(i, j)[differ] * len(label) + np.maximum(i, j)[differ])
        i, j = pair // len(label), pair % len(label)
        ok = known.may_link(i, j)
        label = _least_label(len(label), np.concatenate([label, i[ok]]), np.concatenate([np.arange(len(label)), j[ok]]))

    edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    size = np.diff(np.append(edge, len(lists)))
    first = np.repeat(edge, size)
    unite(who[first], who)
    later = np.flatnonzero(first < np.arange(len(who)))
    unite(who[later - 1], who[later])
    # what is apart after that: every list once for each set of sets, the lesser labels against all
    seen = set()
    pending, count = [], 0
    for a, k in zip(edge.tolist(), size.tolist()):
        members = who[a : a + k]
        mine = label[members]
        if k < 3 or (mine == mine[0]).all() or (key := members.tobytes()) in seen:
            continue
        seen.add(key)
        values, n = np.unique(mine, return_counts=True)
        lesser = members[mine != values[n.argmax()]]
        for part in np.array_split(lesser, 1 + len(lesser) * k // (1 << 20)):
            pending.append((np.repeat(part, k), np.tile(members, len(part))))
            count += len(part) * k
            if count > 1 << 20:
                unite(*map(np.concatenate, zip(*pending)))
                pending, count = [], 0
    if pending:
        unite(*map(np.concatenate, zip(*pending)))
    return label


def candidate_edges(reps: DataFrame, lists: DataFrame) -> DataFrame:
    """(src, dst) between classes (cid, n, sig) whose signatures allow a link."""

    groups = parts(reps.sparkSession)

    def where(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for bucket, cids in zip(column(batch, "bucket").to_pylist(), column(batch, "cids").to_pylist()):
                cid = np.frombuffer(cids, np.int64)
                to = (mix(cid.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                some = np.unique(to)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), bucket, np.int32)), pa.array([cid[to == g].tobytes() for g in some], pa.binary())], ["part", "bucket", "cids"])

    def gather(rows: pa.Table) -> pa.Table:
        cids = [np.frombuffer(c, np.int64) for c in rows.column("cids").to_pylist()]
        bucket = np.repeat(np.array(rows.column("bucket").to_pylist(), np.int32), [len(c) for c in cids])
        cid = np.concatenate(cids)
        order = np.lexsort((bucket, cid))
        names, edge = np.unique(cid[order], return_index=True)
        return pa.table({"cid": names, "buckets": pa.ListArray.from_arrays(pa.array(np.append(edge, len(cid)).astype(np.int32)), pa.array(bucket[order]))})

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: dict[int, list] = {}
            for cid, n, sig, buckets in zip(*(column(batch, c).to_pylist() for c in ("cid", "n", "sig", "buckets"))):
                for b in buckets:
                    rows.setdefault(b, []).append((cid, n, sig))
            out = [(b, np.array([r[:2] for r in x], np.int64).tobytes(), b"".join(r[2] for r in x)) for b, x in rows.items()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "head", "bits"])

    def meet(rows: pa.Table, signed: pa.Table) -> pa.Table:
        if not rows.num_rows or not signed.num_rows:
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        names = np.frombuffer(rows.column("cids")[0].as_py(), np.int64)
        who, lists = np.frombuffer(rows.column("who")[0].as_py(), np.int32).astype(np.int64), np.cumsum(np.frombuffer(rows.column("list")[0].as_py(), bool))
        sizes, data = np.zeros(len(names), np.int64), [np.zeros(1, np.uint64)] * len(names)
        for head, bits in zip(signed.column("head").to_pylist(), signed.column("bits").to_pylist()):
            bits, at = np.frombuffer(bits, np.uint64), 0
            for cid, n in np.frombuffer(head, np.int64).reshape(-1, 2).tolist():
                w, i = max(64, 1 << (n - 1).bit_length()) // 64, np.searchsorted(names, cid)
                sizes[i], data[i] = n, bits[at : at + w]
                at += w
        label = list_edges(lists, who, Signatures(sizes, data))
        moved = label != np.arange(len(names))
        return pa.table({"src": names[moved], "dst": names[label[moved]]})

    buckets = by_number(lists.mapInArrow(where, "part int, bucket int, cids binary"), "part").groupBy("part").applyInArrow(gather, "cid long, buckets array<int>")
    signed = reps.select("cid", "n", "sig").join(buckets, "cid").mapInArrow(sign, "bucket int, head binary, bits binary")
    return by_number(lists, "bucket").groupBy("bucket").cogroup(by_number(signed, "bucket").groupBy("bucket")).applyInArrow(meet, "src long, dst long")


class SignatureTree:
    """Sets in order of size and least shingle; ``FAN`` sets to a leaf, ``FAN`` nodes to a node."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.levels = []
        n = len(sets)
        maps = np.zeros((n, bits // 8), np.uint8)
        for i, s in enumerate(sets):
            flag = np.zeros(bits, bool)
            flag[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[i] = np.packbits(flag)
        maps = maps.view(np.uint64)
        size = np.array([len(s) for s in sets])
        over = size - np.bitwise_count(maps).sum(1, dtype=np.int64)
        level = (maps, size, size, over)
        while True:
            self.levels.append(level)
            if len(level[0]) == 1:
                break
            at = np.arange(0, len(level[0]), self.FAN)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))

    def span(self, level: int, node: int) -> tuple[int, int]:
        """The sets under a node."""
        w = self.FAN**level
        return node * w, min((node + 1) * w, len(self.levels[0][0]))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * self.FAN, min((node + 1) * self.FAN, len(self.levels[level - 1][0])))


def may_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Whether any sets under nodes ``i`` and ``j`` may be similar: sizes, then the greatest possible overlap."""
    fits = (a[2][i] * T_DEN >= b[1][j] * T_NUM) & (b[2][j] * T_DEN >= a[1][i] * T_NUM)
    most = np.zeros(len(i), np.int64)
    k = np.flatnonzero(fits)
    most[k] = np.bitwise_count(a[0][i[k]] & b[0][j[k]]).sum(1, dtype=np.int64) + np.minimum(a[3][i[k]], b[3][j[k]])
    return fits & (most * (T_NUM + T_DEN) >= T_NUM * (a[1][i] + b[1][j]))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a))


def join_sets(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None = None) -> np.ndarray:
    """Labels (least first) after linking similar sets; sets of one label count as connected already.

    With ``side`` (0 or 1), only sets of different sides are compared.
    """
    n = len(sets)
    order = np.array(sorted(range(n), key=lambda i: (len(sets[i]), int(sets[i][0]))))
    sets = [sets[i] for i in order]
    label, side = label[order].copy(), None if side is None else side[order]

    def compare(i: int, j: int) -> None:
        if label[i] != label[j] and (side is None or side[i] != side[j]) and similar(overlap(sets[i], sets[j]), len(sets[i]), len(sets[j])):
            label[label == max(label[i], label[j])] = min(label[i], label[j])

    for i in range(1, n):  # neighbours and the first come first, so that large classes grow early
        compare(i - 1, i)
        compare(0, i)
    if n > 2 and label.min() != label.max():
        typical = int(np.median([len(s) for s in sets]))
        tree = SignatureTree(sets, min(1 << 15, max(1 << 9, 1 << (8 * typical).bit_length())))
        stack = [(len(tree.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            a, b = tree.span(level, i), tree.span(level, j)
            low, high = min(label[slice(*a)].min(), label[slice(*b)].min()), max(label[slice(*a)].max(), label[slice(*b)].max())
            if low == high:
                continue
            if level == 0:
                compare(i, j)
                continue
            x, y = (g.ravel() for g in np.meshgrid(tree.children(level, i), tree.children(level, j), indexing="ij"))
            if i == j:
                x, y = x[x <= y], y[x <= y]
            if level == 1:
                differ = (x != y) & (label[x] != label[y])
                x, y = x[differ], y[differ]
            ok = may_link(tree.levels[level - 1], x, tree.levels[level - 1], y)
            stack += [(level - 1, p, q) for p, q in zip(x[ok].tolist(), y[ok].tolist())]
    out = np.empty(n, label.dtype)
    out[order] = label
    return out


def _local(rows: DataFrame) -> DataFrame:
    """(cid, old, label) after joining the sets of each (comp, part); rows have comp, part, cid, label, side (or null), set."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def done() -> pa.RecordBatch:
            cid, old, side, sets = (np.array([h[i] for h in held]) if i < 3 else [h[i] for h in held] for i in range(4))
            new = join_sets(sets, old, None if side[0] < 0 else side)
            return pa.RecordBatch.from_arrays([pa.array(cid), pa.array(old), pa.array(new)], ["cid", "old", "label"])

        for batch in it:
            for comp, part, cid, label, side, data in zip(*(column(batch, c).to_pylist() for c in ("comp", "part", "cid", "label", "side", "set"))):
                if (comp, part) != key and held:
                    yield done()
                    held = []
                key = (comp, part)
                held.append((cid, label, side, np.frombuffer(data, np.uint64)))
        if held:
            yield done()

    rows = rows.select("comp", "part", "cid", "label", "side", "set").repartition(parts(rows.sparkSession), "comp", "part").sortWithinPartitions("comp", "part", "cid")
    return rows.mapInArrow(run, "cid long, old long, label long")


def _salted(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` with label left-joined to ``new`` (label, to): rows of one label go to ``SALTS`` shares, so that a large class isn't one task's."""
    spread = new.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).join(spread, ["label", "salt"], "left").drop("salt")


def _relabel(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """``rows`` with labels replaced by the component of what ``merges`` (old, label) unites."""
    edges = merges.where("old <> label").select(F.col("old").alias("src"), F.col("label").alias("dst")).distinct()
    new = connected_components(edges).select(F.col("id").alias("label"), F.col("component").alias("to"))
    return _salted(rows, new).withColumn("label", F.coalesce("to", "label")).drop("to")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, n_shingles, cid) of every row, (cid, doc_id) of every class with a named document, (cid, label) of every class that may link).

    ``docs`` has doc_id and text.
    """
    seen = table(measure(docs), "shingle-sets")
    sized = seen.where("kind = 0 AND n > 0")
    # classes by all 128 bits; those that share the first half (about n * n / 2**65 pairs) go by the second
    clashing = frozenset(r[0] for r in sized.groupBy("f1", "f2").agg(F.lit(1)).groupBy("f1").count().where("count > 1").select("f1").collect())
    cid = F.when(F.col("f1").isin(list(clashing)), F.col("f2")).otherwise(F.col("f1")) if clashing else F.col("f1")
    rows = seen.where("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, cid).alias("cid"))
    firsts = table(sized.where("doc_id IS NOT NULL").groupBy(cid.alias("cid")).agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig")), "classes")
    lists = table(shared_lists(docs, order_of(seen), clashing), "shared-shingles")
    comps = cut(connected_components(candidate_edges(firsts, lists)).select(F.col("id").alias("cid"), F.col("component").alias("comp")))
    drop(lists)
    sizes = comps.groupBy("comp").agg(F.count("*").alias("size"))
    reps = firsts.select("cid", "doc_id").join(comps, "cid").join(sizes, "comp").withColumn("parts", F.ceil(F.col("size") / CHUNK).cast("int"))

    def sets_of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [s for t in batches(column(batch, "text")) for s in shingle_sets(t, K)]
            right = pa.array([len(s) > 0 and named(fingerprint(s), clashing) == c for s, c in zip(sets, column(batch, "cid").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("comp", "parts", "cid")), pa.array([s.tobytes() for s in sets], pa.binary())], ["comp", "parts", "cid", "set"]).filter(right)

    reps = cut(reps)
    wanted, _ = may_have(docs.select("doc_id", "text"), "doc_id", reps.select("doc_id"))
    found = wanted.join(reps, "doc_id").select("comp", "parts", "cid", "text").mapInArrow(sets_of, "comp long, parts int, cid long, set binary")
    found = found.withColumn("label", F.col("cid")).withColumn("side", F.lit(-1))
    pick = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    known = firsts.select("cid", "doc_id")
    if not sizes.where(F.col("size") > CHUNK).limit(1).count():
        local = _local(found.withColumn("part", F.lit(0)))
        return rows, known, cut(local.groupBy("cid").agg(F.min("label").alias("label")))
    sets = table(found.withColumn("part", pick), "candidate-sets")
    found = table(sets.drop("label").join(cut(_local(sets)).groupBy("cid").agg(F.min("label").alias("label")), "cid").dropDuplicates(["cid"]), "linked-sets")
    drop(sets)
    big = found.where("parts > 1")
    # one set of every class of links, dealt anew
    heads = big.where("cid = label")
    count = heads.groupBy("comp").agg(F.count("*").alias("heads"))
    heads = heads.join(count, "comp").withColumn("part", F.pmod(F.xxhash64("cid", F.lit(1)), F.ceil(F.col("heads") / CHUNK)).cast("int"))
    labels = cut(_relabel(found.select("comp", "cid", "label"), cut(_local(heads))))
    # what is still apart: sets outside their component's largest class, against all parts of it
    per = labels.groupBy("comp", "label").agg(F.count("*").alias("k"))
    most = per.groupBy("comp").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("n_labels")).where("n_labels > 1")
    apart = found.drop("label").join(labels.select("cid", "label"), "cid").where("parts > 1").join(most, "comp")
    lesser = apart.where("label <> main")
    blocks = lesser.groupBy("comp").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("blocks"))
    lesser = lesser.join(blocks, "comp").withColumn("block", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("blocks")).cast("int"))
    left = lesser.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    right = apart.join(blocks, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("p", F.col("part")).withColumn("side", F.lit(1))
    cols = ["comp", (F.col("block") * F.col("parts") + F.col("p")).alias("part"), "cid", "label", "side", "set"]
    merges = cut(_local(left.select(*cols).unionByName(right.select(*cols))))
    drop(found)
    return rows, known, cut(_relabel(labels, merges).select("cid", "label"))


def link(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return _linked(docs, text, doc_id).drop("cid", "label")


def _linked(docs: DataFrame, text="text", doc_id="doc_id") -> DataFrame:
    docs = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    rows, firsts, labels = classes(docs)
    tied = cut(firsts.join(labels, "cid"))
    least = tied.groupBy("label").agg(F.min("doc_id").alias("to"))
    tied = _salted(tied, least).select("cid", "label", F.col("to").alias("component_id"))
    alone = firsts.join(labels, "cid", "left_anti").select("cid", F.col("cid").alias("label"), F.col("doc_id").alias("component_id"))
    rows = rows.join(tied.unionByName(alone), "cid", "left")
    return rows.select("doc_id", "n_shingles", "cid", F.coalesce("label", "cid").alias("label"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component (the one with the least doc_id, then text), columns as given.

    Of repeated rows (doc_id and text alike) one stays. Texts without shingles and rows without a doc_id all stay.
    Texts are moved only where their doc_id may be one that doesn't stay.
    """
    found = table(_linked(docs.select("doc_id", "text")), "components").where("doc_id IS NOT NULL")
    ids = found.groupBy("doc_id").agg(F.max((F.col("doc_id") != F.col("component_id")).cast("int")).alias("gone"), F.count("*").alias("rows"))
    gone_id, many_id, stay_id, stay_text = unused(docs.columns, "gone_id", "many_id", "stay_id", "stay_text")
    names = [quoted(c) for c in docs.columns]
    gone = cut(ids.where("gone = 1 OR rows > 1").select(F.col("doc_id").alias(gone_id), "rows"))
    maybe, others = may_have(docs, "doc_id", gone.select(gone_id))
    kept = maybe.join(gone.select(gone_id), F.col(gone_id) == F.col("doc_id"), "left_anti").select(*names).unionByName(others)
    many = gone.where("rows > 1").select(F.col(gone_id).alias(many_id))
    if not many.limit(1).count():
        return kept
    again = may_have(docs, "doc_id", many)[0].join(many, F.col(many_id) == F.col("doc_id"), "left_semi")

    def cids(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [s for t in batches(column(batch, "text")) for s in shingle_sets(t, K)]
            both = [fingerprint(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), *(pa.array([f[i] for f in both], pa.int64()) for i in (0, 1))], ["doc_id", "text", "f1", "f2"])

    # a class goes by either half of its bits (``named``)
    texts = again.select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct().mapInArrow(cids, "doc_id long, text string, f1 long, f2 long")
    first = found.where("cid IS NOT NULL AND doc_id = component_id").select("doc_id", "cid", "label").distinct()
    either = texts.select("doc_id", "text", F.explode(F.array("f1", "f2")).alias("cid")).where("cid IS NOT NULL")
    stay = texts.where("f1 IS NULL").select("doc_id", "text").union(either.join(first, ["doc_id", "cid"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text"))
    stay = stay.select(F.col("doc_id").alias(stay_id), F.col("text").alias(stay_text))
    same = (F.col(stay_id) == F.col("doc_id")) & F.col(stay_text).eqNullSafe(F.col("text"))
    return kept.unionByName(again.join(stay, same, "left_semi").dropDuplicates(["doc_id", "text"]).select(*names))
