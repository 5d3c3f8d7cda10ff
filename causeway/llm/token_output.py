"""Token ids of all documents, written with a static rANS code and read back.

Texts are encoded with the tokenizers library on the executors. A text is cut into
pieces at ASCII spaces and between an ASCII letter or digit and what can't go on its
pre-token (``BREAKS``); every such place is a border of the vocabulary's own splitting,
so pieces encoded on their own give the ids of the whole text (a test holds this
against the library). Each worker remembers pieces: up to ``WIDTH`` bytes as numbers in
an open-addressed table, found for a whole batch at once and compared byte for byte;
longer ones in a dictionary; ``MEMO`` of them at most. That holds for vocabularies
whose normalizer and splitting are ``SPLITTING``; any other encodes whole texts, as do
texts with ``<|``, which may hold special tokens.

Counts of all ids give one table of frequencies, whose size is the vocabulary's.
Documents are range-partitioned by id, encoded block by block and written by Spark
with the table beside them; ``read`` decodes the files and needs nothing else.

Null texts count as empty and have the end id alone. A null doc_id sorts first and
reads back as null. Repeated ids stand side by side, ordered by their token ids, so
equal rows can't be told apart and ties change nothing. Empty tables give no blocks.
Extra columns are ignored. A block holds whole documents; one longer than ``BLOCK``
ids has a block to itself. A text of any length is cut into pieces as it is; memory of
a task grows with its longest text.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.rans import Table, decode_block, encode_block
from causeway.llm.rows import column, parts
from causeway.llm.textkernel import LOWER, SPACE, Texts, batches
from causeway.shared import drop, place
from causeway.shared import table as stored

END = 1
BLOCK = 1 << 18
MEMO, WIDTH, SLOT_BITS = 1_000_000, 24, 22
U64 = np.uint64
BLOCKS = "range_no int, block_no int, n_null int, n_ids long, block binary"

#: The suffix of a pre-token's last id; the normalizer and the splitting, as the vocabulary's file states them, that the pieces rely on.
SUFFIX = "</w>"
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}

_LETTER, _DIGIT, _SIGN, _QUOTE, _LATIN, _OTHER = range(6)
#: Class of a byte: ASCII letters, digits, other ASCII, the apostrophe (which may begin a contraction), bytes of longer characters.
CLASS = np.array([_OTHER if b >= 128 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _QUOTE if b == 0x27 else _SIGN for b in range(256)], np.uint8)
#: Whether a pre-token always ends between two bytes: letters end before what isn't one, digits stand alone, other signs end before letters and digits.
BREAKS = np.zeros((6, 6), bool)
BREAKS[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = BREAKS[_LATIN, [_DIGIT, _SIGN, _QUOTE]] = True
BREAKS[_DIGIT, [_LETTER, _DIGIT, _SIGN, _QUOTE]] = BREAKS[_SIGN, [_LETTER, _DIGIT]] = True


def cut_pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte and end of every piece, where each text's pieces begin); A-Z lowered where that commutes with NFC.

    The library lowers behind its NFC, which joins a letter with a mark of U+0300-036F (bytes CC and CD), perhaps a
    capital only: texts with such marks keep their case.
    """
    data = LOWER[texts.data]
    marked = np.flatnonzero((data == 0xCC) | (data == 0xCD))
    for i in np.unique(np.searchsorted(texts.at, marked, "right") - 1) if len(marked) else ():
        data[texts.at[i] : texts.at[i + 1]] = texts.data[texts.at[i] : texts.at[i + 1]]
    kind = CLASS[data]
    # last bytes of letters U+00C0-023F; lowering gives U+0130 a mark, and U+00D7, U+00F7 aren't letters
    at = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8))
    lead, tail = data[at], data[at + 1]
    kind[at[~((lead == 0xC3) & ((tail == 0x97) | (tail == 0xB7)) | (lead == 0xC4) & (tail == 0xB0))] + 1] = _LATIN
    space, n = SPACE[data], len(data)
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    new[1:n] = space[:-1] | space[1:] | BREAKS.ravel()[kind[:-1] * 6 + kind[1:]]
    new[texts.at] = True
    edge = np.flatnonzero(new)
    start, end = edge[:-1], edge[1:]
    word = ~space[start]
    start, end = start[word], end[word]
    return data, start, end, np.searchsorted(start, texts.at)


def keys_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(WIDTH / 8, pieces): the bytes of each piece as numbers, filled up with zeros."""
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    words = np.ndarray((len(data) + WIDTH - 7,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    out = np.zeros((WIDTH // 8, len(start)), U64)
    out[0] = words[start] & masks[np.minimum(size, 8)]
    for j in range(1, WIDTH // 8):
        some = np.flatnonzero(size > 8 * j)
        out[j, some] = words[start[some] + 8 * j] & masks[np.minimum(size[some] - 8 * j, 8)]
    return out


class Pieces:
    """piece -> its ids, encoded by the library once; entry 0 has the end id, if there is one."""

    def __init__(self, path: str, end: int | None = END):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = self.library.get_vocab_size(True)
        self.kind, self.end = id_type(self.size), end
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec.get("added_tokens", []))
        self.last = np.zeros(self.size, bool)
        self.last[[i for w, i in self.library.get_vocab(True).items() if w.endswith(SUFFIX)]] = True
        self.splits = special and spec["model"].get("end_of_word_suffix") == SUFFIX and all(spec.get(k) == v for k, v in SPLITTING.items())
        self.forget()

    def forget(self) -> None:
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)
        self.keys, self.long = np.zeros((WIDTH // 8, 1 << 12), U64), {}
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used, self.n = np.zeros(1 << 14, self.kind), 0, 0
        self._add([b"" if self.end is None else np.array([self.end], self.kind).tobytes()])

    def _add(self, ids: list[bytes]) -> np.ndarray:
        """New entries with these ids."""
        flat, size = np.frombuffer(b"".join(ids), self.kind), np.array([len(x) for x in ids]) // self.kind.itemsize
        grown = lambda x, n: x if n <= x.shape[-1] else np.concatenate([x, np.zeros((*x.shape[:-1], max(n, x.shape[-1])), x.dtype)], -1)
        entry = np.arange(self.n, self.n + len(ids))
        self.n += len(ids)
        self.pool, self.first, self.count, self.keys = grown(self.pool, self.used + len(flat)), grown(self.first, self.n), grown(self.count, self.n), grown(self.keys, self.n)
        self.pool[self.used : self.used + len(flat)] = flat
        self.first[entry], self.count[entry] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        return entry

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        h = keys[0] * U64(0x9E3779B97F4A7C15)
        for j in range(1, len(keys)):
            h ^= keys[j] * U64(0xC2B2AE3D27D4EB4F + 2 * j)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        return (h >> U64(64 - SLOT_BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of pieces by their bytes, -1 for new ones."""
        slot = self._slot(keys)
        out = self.slots[slot].astype(np.int64)
        todo = np.flatnonzero(out >= 0)
        todo = todo[(self.keys[:, out[todo]] != keys[:, todo]).any(0)] if len(todo) else todo
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)
            out[todo] = self.slots[slot[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[(self.keys[:, out[todo]] != keys[:, todo]).any(0)]
        return out

    def _put(self, keys: np.ndarray, entry: np.ndarray) -> None:
        """Different pieces, not found before."""
        self.keys[:, entry] = keys
        slot, todo = self._slot(keys), np.arange(len(entry))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            taken, who = np.unique(slot[free], return_index=True)
            self.slots[taken] = entry[free[who]]
            todo = todo[self.slots[slot[todo]] != entry[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.slots) - 1)

    def learn(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, which go to the library joined by spaces; what it says of each id's place gives each piece its own.

        Pieces of letters are one pre-token each, unless NFC takes a letter apart, and a pre-token's last id, no other, has
        the vocabulary's suffix: as many of those as pieces mean that none was taken apart. The normalizer and the
        splitting leave pieces of a-z as they are, so those go to the library's model past both.
        """
        out: dict[bytes, bytes] = {}
        ascii_, letters, others = [], [], []
        for w in pieces:
            (ascii_ if w.isalpha() else letters if w[-1] >= 128 and w.decode("utf-8", "replace").lower().isalpha() else others).append(w)
        for some in (ascii_, letters, others):
            for lo in range(0, len(some), 256):
                part = some[lo : lo + 256]
                text = [w.decode("utf-8", "replace") for w in part]
                if some is ascii_:
                    got = self.model.encode_batch_fast([" ".join(text).lower()], add_special_tokens=False)[0]
                else:
                    got = self.library.encode(" ".join(text), add_special_tokens=False)
                flat = np.array(got.ids, self.kind)
                edges = np.concatenate([[0], np.flatnonzero(self.last[flat]) + 1])
                if some is others or len(edges) != len(part) + 1:
                    begin = np.cumsum([0, *(len(w) + 1 for w in text)])
                    edges = np.searchsorted(np.searchsorted(begin, [a for a, _ in got.offsets], "right") - 1, np.arange(len(part) + 1))
                edges, ids = (self.kind.itemsize * edges).tolist(), flat.tobytes()
                out.update(zip(part, map(ids.__getitem__, map(slice, edges, edges[1:]))))
        return [out[w] for w in pieces]

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        size, raw = end - start, data.data
        zeros = np.flatnonzero(data == 0)  # would be taken for filling
        wide = size > WIDTH
        if len(zeros):
            wide[np.maximum(np.searchsorted(start, zeros, "right") - 1, 0)] = True
        out = np.zeros(len(start), np.int64)
        short, wide = np.flatnonzero(~wide), np.flatnonzero(wide)
        keys = keys_of(data, start[short], size[short])
        out[short] = self.find(keys)
        while len(new := np.flatnonzero(out[short] < 0)):
            _, once = np.unique(self._slot(keys[:, new]), return_index=True)  # one piece of a slot at a time
            once = new[once]
            some = short[once]
            self._put(keys[:, once], self._add(self.learn([raw[a:b].tobytes() for a, b in zip(start[some].tolist(), end[some].tolist())])))
            out[short[new]] = self.find(keys[:, new])
        if len(wide):
            names = [raw[a:b].tobytes() for a, b in zip(start[wide].tolist(), end[wide].tolist())]
            unknown = list({x for x in names if x not in self.long})
            if unknown:
                self.long.update(zip(unknown, self._add(self.learn(unknown)).tolist()))
            out[wide] = list(map(self.long.__getitem__, names))
        return out

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each one's begin), each with the end id last."""
        if self.n > MEMO:
            self.forget()
        if not self.splits:
            return self._whole(texts, np.arange(texts.n))
        n = len(texts.data)
        odd = np.flatnonzero((texts.data[:-1] == 0x3C) & (texts.data[1:] == 0x7C)) if n else np.zeros(0, np.int64)
        if len(odd):
            which = np.unique(np.searchsorted(texts.at, odd, "right") - 1)
            some = np.ones(texts.n, bool)
            some[which] = False
            return self._mixed(texts, np.flatnonzero(some), which)
        data, start, end, first = cut_pieces(texts) if n else (texts.data, *(np.zeros(0, np.int64),) * 2, np.zeros(texts.n + 1, np.int64))
        entry = self.entries(data, start, end) if len(start) else np.zeros(0, np.int64)
        entry = np.insert(entry, first[1:], 0)
        count = self.count[entry]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.pool[np.repeat(self.first[entry] - total[:-1], count) + np.arange(total[-1])]
        return ids, total[first + np.arange(texts.n + 1)]

    def _whole(self, texts: Texts, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last = [] if self.end is None else [self.end]
        got = [[*e.ids, *last] for e in self.library.encode_batch([texts.text(i).decode("utf-8", "replace") for i in which], add_special_tokens=False)]
        return np.array([x for ids in got for x in ids], self.kind), np.cumsum([0, *map(len, got)])

    def _mixed(self, texts: Texts, plain: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows: dict[int, np.ndarray] = {}
        for which, some in ((odd, None), (plain, 1)):
            if some:
                size = texts.at[which + 1] - texts.at[which]
                at = np.concatenate([[0], np.cumsum(size)])
                ids, edge = self.encode(Texts(texts.data[np.repeat(texts.at[which] - at[:-1], size) + np.arange(at[-1])], at))
            else:
                ids, edge = self._whole(texts, which)
            rows.update((int(i), ids[a:b]) for i, a, b in zip(which, edge, edge[1:]))
        return np.concatenate([rows[i] for i in range(texts.n)]), np.cumsum([0, *(len(rows[i]) for i in range(texts.n))])


def id_type(size: int) -> np.dtype:
    """How ids of a vocabulary are kept between the steps."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


@lru_cache(2)
def pieces_of(path: str, end: int | None = END) -> Pieces:
    return Pieces(path, end)


def encode_texts(texts: list[bytes], path: str, end: int | None = None) -> list[bytes]:
    """Ids of each UTF-8 text, of the type that :func:`id_type` gives."""
    out, known = [], pieces_of(path, end)
    for t in batches(pa.array(texts, pa.large_binary())):
        ids, edge = known.encode(t)
        out += [ids[a:b].tobytes() for a, b in zip(edge, edge[1:])]
    return out


def tokenize(docs: DataFrame, path: str, text="text", doc_id="doc_id", end: int | None = END) -> DataFrame:
    """(doc_id, ids, counts): ids little-endian, of the vocabulary's type, the end id last; a last row of each task has but its counts of all ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = ["doc_id", "ids", "counts"], pieces_of(path, end)
        total = np.zeros(known.size, np.int64)
        for batch in it:
            doc = column(batch, "doc_id")
            for t in batches(column(batch, "text")):
                ids, edge = known.encode(t)
                total += np.bincount(ids, minlength=len(total))
                rows = pa.LargeBinaryArray.from_buffers(pa.large_binary(), t.n, [None, pa.py_buffer((edge * known.kind.itemsize).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([doc.slice(t.first, t.n), rows, pa.nulls(t.n, pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids binary, counts binary")


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Counts by id over all documents: tasks' counts are summed on executors, a vocabulary's worth comes back from each of a few."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for x in column(batch, "counts"):
                got = np.frombuffer(x.as_buffer(), np.int64)
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    rows = tokens.where("counts IS NOT NULL").select("counts").mapInArrow(run, "counts binary").repartition(8).mapInArrow(run, "counts binary").collect()
    return np.sum([np.frombuffer(r["counts"], np.int64) for r in rows], axis=0) if rows else np.zeros(1, np.int64)


def encode(tokens: DataFrame, freq: Table, kind: np.dtype) -> DataFrame:
    """(range_no, block_no, n_null, n_ids, block), blocks in ascending doc_id order; the first ``n_null`` documents of a block have no id."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs, rows, size, no = ["range_no", "block_no", "n_null", "n_ids", "block"], [], [], 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(rows), kind)
            data = encode_block(np.array([d or 0 for d in docs], np.int64), np.array([len(r) // kind.itemsize for r in rows]), ids, freq)
            return pa.RecordBatch.from_arrays([pa.array([range_no], pa.int32()), pa.array([no], pa.int32()), pa.array([docs.count(None)], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], names)

        for batch in it:
            range_no = batch.column(0)[0].as_py() if batch.num_rows else 0
            for doc, ids in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids")):
                ids = ids.as_buffer().to_pybytes()
                if rows and size + len(ids) // kind.itemsize > BLOCK:
                    yield block()
                    docs, rows, size, no = [], [], 0, no + 1
                docs.append(doc)
                rows.append(ids)
                size += len(ids) // kind.itemsize
        if rows:
            yield block()

    ranged = tokens.repartitionByRange(parts(tokens.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    return ranged.select(F.spark_partition_id().alias("range_no"), "doc_id", "ids").mapInArrow(run, BLOCKS)


def write(docs: DataFrame, path: str, to: str | None = None, **columns) -> tuple[SparkSession, str]:
    """(session, folder) of the files: ``blocks``, and ``frequencies``, the table that all blocks share.

    Without ``to`` the folder is one of the shared folder's tables, which end with the process.
    """
    spark = docs.sparkSession
    folder = to or place(spark, "token-files")
    tokens = stored(tokenize(docs, path, **columns), "token-ids")
    freq = Table.of(count_ids(tokens))
    spark.createDataFrame([(bytearray(freq.freq.astype("<u4").tobytes()),)], "frequencies binary").coalesce(1).write.parquet(f"{folder}/frequencies")
    blocks = encode(tokens.where("counts IS NULL").select("doc_id", "ids"), freq, id_type(len(freq.freq)))
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    drop(tokens)
    return spark, folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files of :func:`write`.

    Sums of ids by range (a few rows: one per range) and by block within a range
    give each block its start; no document is shuffled.
    """
    freq = Table(np.frombuffer(spark.read.parquet(f"{folder}/frequencies").first()[0], "<u4").astype(np.int64))
    ship = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    order = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = blocks.groupBy("range_no").agg(F.sum("n_ids").alias("n")).select("range_no", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("range_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("range_no", "block_no", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_range")).join(ranges, "range_no")
    starts = starts.select("range_no", "block_no", (F.col("range_start") + F.col("in_range")).alias("start"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for range_no, block_no, n_null, data in zip(*(column(batch, c) for c in ("range_no", "block_no", "n_null", "block"))):
                docs, sizes, ids = decode_block(data.as_buffer().to_pybytes(), ship.value)
                raw, end = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes, dtype=np.int64)
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end.tolist(), sizes.tolist())]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, range_no.as_py(), np.int32)), pa.array(np.full(k, block_no.as_py(), np.int32)), pa.array(docs, mask=np.arange(k) < n_null.as_py()), pa.array(end - sizes), pa.array(sizes.astype(np.int64)), pa.array(crc, pa.int64())], ["range_no", "block_no", "doc_id", "in_block", "n_tokens", "ids_crc32"])

    found = blocks.select("range_no", "block_no", "n_null", "block").mapInArrow(run, "range_no int, block_no int, doc_id long, in_block long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["range_no", "block_no"]).select("doc_id", (F.col("start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
