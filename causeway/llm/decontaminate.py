"""Benchmark decontamination: BM25 with block-max WAND, then overlap checks.

Test items are indexed by word; an item's BM25 impacts are divided by its score
against itself, so 1 means that a passage has all its words. Word frequencies, their
number of items and mean length are those of the whole benchmark. Every document is cut
into overlapping passages (for each item twice the power of two that holds its words,
half a passage apart, so each item fits into one whole); so an item's score in a
document depends on neither the other items' lengths nor on how the items are dealt to
indices. Every passage is a query: block
maxima of its rarer words' impacts, summed for all passages of a batch at once,
discard most (the bound counts what frequent words could add to an item);
block-max WAND then retrieves all items at or above ``THRESHOLD``. A retrieved item
counts if the passage has at least ``OVERLAP`` of the 5-grams of its question (all
but its last sentence) and of its answer (the last sentence, or the last quarter of
a single one).

An index holds items of like length. Indices of about ``SHARD`` items and
``SHARD_WORDS`` words at most are broadcast together and searched in one pass over the
documents; a larger benchmark takes several passes. Documents are read where they lie
and never shuffled; of a long text all passages are made, 2 MB of texts at a time or
the one text that is longer. Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.

Null and empty texts match nothing; a null doc_id is reported as null; items without a word are never found; repeated
items count once per item_id and text; repeated documents are judged alike. Empty
tables on either side give no hits. Extra columns are ignored by :func:`search` and
carried by :func:`drop_contaminated`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.rows import column, map_rows
from causeway.llm.textkernel import LOWER, Texts, batches, windows
from causeway.shared import cut

THRESHOLD, OVERLAP, GRAM = 0.6, 0.5, 5
K1, B = 1.2, 0.75
SHARD, SHARD_WORDS, POSTINGS, GROUP = 20_000, 2_000_000, 32, 4
#: Half a passage has so many words at least.
LEAST_STRIDE = 32

_NOT_WORD = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])
_END = np.isin(np.arange(256), list(b".!?\n"))


def words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its first byte, where each text's words begin)."""
    if not len(texts.data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(texts.n + 1, np.int64)
    data = LOWER[texts.data]
    start, end, first = texts.runs(_NOT_WORD[data])
    return texts.spans(texts.prefix(data), start, end), start, first


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    return np.unique(windows(codes, np.array([0, len(codes)]), k)[0])


def stride_of(n_words: int) -> int:
    """Half a passage for items of so many words."""
    return max(LEAST_STRIDE, 1 << max(0, n_words - 1).bit_length())


class Index:
    """Items of like length, with their words' impacts.

    ``known`` has (sorted word hashes, items with each, number of items, mean words) of
    the whole benchmark; without it these items are all. No item may have more than
    ``stride`` words.
    """

    def __init__(self, item_ids: list, texts: list[str], known: tuple[np.ndarray, np.ndarray, int, float] | None = None, stride: int | None = None):
        t = next(iter(batches(pa.array(texts, pa.string()), limit=1 << 40)))
        codes, start, first = words(t)
        sentence = np.concatenate([[0], np.cumsum(_END[t.data])])[start] if len(start) else np.zeros(0, np.int64)
        self.item_ids, self.n = item_ids, len(item_ids)
        sizes = np.diff(first)
        self.stride = stride or stride_of(int(sizes.max(initial=1)))
        owner = np.repeat(np.arange(self.n), sizes)
        self.question, self.answer = [], []
        for i in range(self.n):
            c, s = codes[first[i] : first[i + 1]], sentence[first[i] : first[i + 1]]
            n = len(c)
            cut = int(np.searchsorted(s, s[-1])) if n and s[0] != s[-1] else n - max(1, n // 4)
            for into, part in ((self.question, c[:cut]), (self.answer, c[cut:])):
                k = min(GRAM, len(part))
                into.append((k, grams(part, k) if k else np.zeros(0, np.uint64)))
        # postings by term, items ascending
        self.vocabulary, term = np.unique(codes, return_inverse=True)
        pairs, tf = np.unique(term.astype(np.int64) * self.n + owner, return_counts=True)
        term, item = pairs // max(1, self.n), pairs % max(1, self.n)
        here = np.bincount(term, minlength=len(self.vocabulary))
        df, n, average = (here, self.n, sizes.mean() if self.n else 1.0) if known is None else (known[1][np.searchsorted(known[0], self.vocabulary)], *known[2:])
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        raw = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / max(average, 1e-9)))
        own = np.bincount(item, raw, self.n)
        self.impact, self.item = raw / own[item], item
        self.at = np.concatenate([[0], np.cumsum(here)])
        self.most = np.maximum.reduceat(self.impact, self.at[:-1]) if len(term) else np.zeros(0)
        self.lasting: dict[float, tuple] = {}
        self.blocks = -(-self.n // GROUP)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def terms(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that the index knows, and their terms."""
        at = np.flatnonzero(self.filter[(codes & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(at) or not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.vocabulary, codes[at]), len(self.vocabulary) - 1)
        hit = self.vocabulary[term] == codes[at]
        return at[hit], term[hit]

    def values(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per term, blocks of ``GROUP`` items and worths: a passage with an item of at least ``least`` has terms worth 1 or more in its block.

        Frequent terms are worth nothing as long as no item gets more than half of
        ``least`` from them; what an item still needs then, ``rest``, must come
        from its other terms, each worth its largest impact / rest in the block.
        """
        if least not in self.lasting:
            common, free = np.zeros(self.n), np.zeros(len(self.vocabulary), bool)
            for t in np.argsort(-np.diff(self.at), kind="stable"):
                span = slice(self.at[t], self.at[t + 1])
                if (common[self.item[span]] + self.impact[span] <= least / 2).all():
                    common[self.item[span]] += self.impact[span]
                    free[t] = True
            term = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.at))
            worth, kept = self.impact / (least - 1e-9 - common[self.item]), ~free[term]
            block, edge = np.unique(term[kept] * self.blocks + self.item[kept] // GROUP, return_index=True)
            most = np.maximum.reduceat(worth[kept], edge) if len(edge) else np.zeros(0)
            self.lasting[least] = (np.searchsorted(block // self.blocks, np.arange(len(self.vocabulary) + 1)), block % self.blocks, most)
        return self.lasting[least]

    def candidates(self, passage: np.ndarray, term: np.ndarray, least: float) -> np.ndarray:
        """Passages that may have an item of at least ``least``, by block maxima summed for all passages at once."""
        at, block, most = self.values(least)
        pairs = np.unique(passage * len(self.vocabulary) + term)
        passage, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        n = at[term + 1] - at[term]
        entry = np.repeat(at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(passage, n) * self.blocks + block[entry]
        order = np.argsort(key, kind="stable")
        key, edge = np.unique(key[order], return_index=True)
        total = np.add.reduceat(most[entry][order], edge) if len(edge) else np.zeros(0)
        return np.unique(key[total >= 1 - 1e-6] // self.blocks)

    def wand(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All (item, score) of at least ``least`` for a query of distinct terms, by block-max WAND."""
        least -= 1e-9
        lists = []
        for t in terms.tolist():
            items = self.item[self.at[t] : self.at[t + 1]].tolist()
            impacts = self.impact[self.at[t] : self.at[t + 1]].tolist()
            blocks = [(items[min(b + POSTINGS, len(items)) - 1], max(impacts[b : b + POSTINGS])) for b in range(0, len(items), POSTINGS)]
            lists.append([items[0], 0, items, impacts, blocks, self.most[t]])
        end, found = self.n, []

        def move(x: list, to: int) -> None:
            i = x[1]
            while i < len(x[2]) and x[2][i] < to:
                block = i // POSTINGS
                i = (block + 1) * POSTINGS if x[4][block][0] < to else i + 1
            x[1], x[0] = i, x[2][i] if i < len(x[2]) else end

        while True:
            lists = sorted((x for x in lists if x[0] < end), key=lambda x: x[0])
            total, pivot = 0.0, -1
            for j, x in enumerate(lists):
                total += x[5]
                if total >= least:
                    pivot = j
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, until = 0.0, end
            for x in lists[: pivot + 1]:
                b = x[1] // POSTINGS
                while b < len(x[4]) and x[4][b][0] < item:
                    b += 1
                if b < len(x[4]):
                    bound += x[4][b][1]
                    until = min(until, x[4][b][0] + 1)
            if bound < least:  # no item before the nearest block's end can reach it
                if pivot + 1 < len(lists):
                    until = min(until, lists[pivot + 1][0])
                for x in lists[: pivot + 1]:
                    move(x, max(until, item + 1))
            elif lists[0][0] == item:
                score = sum(x[3][x[1]] for x in lists[: pivot + 1])
                if score >= least:
                    found.append((item, score))
                for x in lists[: pivot + 1]:
                    move(x, item + 1)
            else:
                for x in lists[:pivot]:
                    move(x, item)

    def hits(self, texts: Texts, threshold: float, overlap: float, parsed: tuple | None = None) -> list[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first byte of the passage), the best of each text and item."""
        codes, start, first = words(texts) if parsed is None else parsed
        at, term = self.terms(codes)
        if not len(at):
            return []
        size, step = 2 * self.stride, self.stride
        counts = np.maximum(1, -(-np.diff(first) // step) - 1)  # passages of each text; the last one reaches its end
        base = np.concatenate([[0], np.cumsum(counts)])
        rare = np.diff(self.values(threshold)[0])[term] > 0
        text = np.searchsorted(first, at[rare], "right") - 1
        step_no = (at[rare] - first[text]) // step
        late, early = np.minimum(step_no, counts[text] - 1), step_no - 1
        twice = (early >= 0) & (early != late)
        passages = np.concatenate([base[text] + late, (base[text] + early)[twice]])
        best: dict = {}
        for p in self.candidates(passages, np.concatenate([term[rare], term[rare][twice]]), threshold).tolist():
            i = int(np.searchsorted(base, p, "right")) - 1
            lo = int(first[i]) + (p - int(base[i])) * step
            hi = min(lo + size, int(first[i + 1]))
            a, b = np.searchsorted(at, [lo, hi])
            distinct = np.unique(term[a:b])
            made: dict = {}
            for item, score in self.wand(distinct, threshold):
                shares = []
                for k, want in (self.question[item], self.answer[item]):
                    if k and k not in made:
                        made[k] = grams(codes[lo:hi], k)
                    shares.append(np.isin(want, made[k], assume_unique=True).mean() if k else 1.0)
                if min(shares) >= overlap and score > best.get((i, item), (0,))[0]:
                    best[i, item] = (score, *shares, int(start[lo] - texts.at[i]))
        return [(i, item, *v) for (i, item), v in sorted(best.items())]


def _parsed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        n, codes = [], []
        for t in batches(column(batch, "text")):
            code, _, first = words(t)
            n += np.diff(first).tolist()
            codes += [np.unique(code[a:b]).view(np.int64) for a, b in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays([column(batch, "item_id"), column(batch, "text"), pa.array(n, pa.int32()), pa.array([stride_of(x) for x in n], pa.int32()), pa.array(codes, pa.list_(pa.int64()))], ["item_id", "text", "n", "stride", "codes"])


def indices(benchmark: DataFrame, item_id="item_id", text="text", shard: int = SHARD, shard_words: int = SHARD_WORDS) -> Iterator[list[Index]]:
    """Indices of items of like length, those of one pass together; sizes are bounded as ``shard`` says, give or take a hash's luck."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    rows = cut(rows.mapInArrow(_parsed, "item_id long, text string, n int, stride int, codes array<long>").where("n > 0"))
    n, average = rows.agg(F.count("*"), F.avg("n")).first()
    if not n:
        return
    df = cut(rows.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("df")))
    held, items, size = [], 0, 0
    for r in rows.groupBy("stride").agg(F.count("*").alias("items"), F.sum("n").alias("size")).orderBy("stride").collect():
        shards = max(-(-r["items"] // shard), -(-r["size"] // shard_words))
        for k in range(shards):
            some = rows.where((F.col("stride") == r["stride"]) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k))
            part = sorted(some.select("item_id", "text").collect(), key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["text"]))
            if not part:
                continue
            if held and (items + len(part) > shard or size + r["size"] // shards > shard_words):
                yield held
                held, items, size = [], 0, 0
            seen = df.join(some.select(F.explode("codes").alias("code")).distinct(), "code").toArrow()
            code, count = seen["code"].to_numpy().view(np.uint64), seen["df"].to_numpy()
            order = np.argsort(code)
            held.append(Index([x["item_id"] for x in part], [x["text"] for x in part], (code[order], count[order], n, average), r["stride"]))
            items, size = items + len(part), size + r["size"] // shards
    yield held


def _passes(docs: DataFrame, benchmark: DataFrame, threshold: float, **sizes) -> Iterator:
    for held in indices(benchmark, **sizes):
        for index in held:
            index.values(threshold)  # made once, sent along
        yield docs.sparkSession.sparkContext.broadcast(held)


def search(docs: DataFrame, benchmark: DataFrame, text="text", doc_id="doc_id", threshold=THRESHOLD, overlap=OVERLAP, **sizes) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, passage_start) of every contaminated document and item."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema, out = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long", None
    for ship in _passes(docs, benchmark, threshold, **sizes):

        def run(it: Iterator[pa.RecordBatch], ship=ship) -> Iterator[pa.RecordBatch]:
            for batch in it:
                ids, rows = column(batch, "doc_id"), []
                for t in batches(column(batch, "text")):
                    parsed = words(t)
                    rows += [(ids[t.first + i].as_py(), index.item_ids[item], *rest) for index in ship.value for i, item, *rest in index.hits(t, threshold, overlap, parsed)]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "passage_start"])

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold=THRESHOLD, overlap=OVERLAP, **sizes) -> DataFrame:
    """The documents without a hit, all columns as given."""
    for ship in _passes(docs, benchmark, threshold, **sizes):

        def run(it: Iterator[pa.RecordBatch], ship=ship) -> Iterator[pa.RecordBatch]:
            for batch in it:
                bad = set()
                for t in batches(column(batch, "text")):
                    parsed = words(t)
                    bad.update(t.first + h[0] for index in ship.value for h in index.hits(t, threshold, overlap, parsed))
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = map_rows(docs, run)
    return docs
