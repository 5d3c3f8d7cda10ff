"""What the corpus operators share around Spark: inputs, batches, sizes."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch: bounds what a Python worker holds of long texts.
ARROW_ROWS = 1000


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table of the input folder, read by Spark only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where the unsigned crc32 of the id, as text, is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def unused(taken: list[str], *names: str) -> list[str]:
    """Each name with as many underscores behind it as make it differ from all columns of ``taken``, whatever the case."""
    have = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out


#: Bits of the filter that says which rows may have one of some ids: 4 MB, whatever their number.
FILTER_BITS = 1 << 25


def may_have(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among ``ids``, all others): columns as given, nothing but the bits of hashed ids is moved.

    ``ids`` has one column. Few ids spare nearly all other rows a later join; with as
    many ids as bits the filter lets most rows pass, and that join does all the work.
    """
    h = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(FILTER_BITS))
    place, bits, bit = unused(rows.columns, "filter_place", "filter_bits", "filter_bit")
    some = ids.select(h(F.col(ids.columns[0])).alias("h"))
    table = some.groupBy(F.bitmap_bucket_number("h").alias(place)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias(bits))
    at = h(F.col(key))
    marked = rows.withColumn(place, F.bitmap_bucket_number(at)).withColumn(bit, F.bitmap_bit_position(at)).join(F.broadcast(table), place, "left")
    found = F.coalesce(F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast({bit} div 8 as int) + 1, 1)), 16, 10) as int), cast({bit} % 8 as int)) & 1 = 1"), F.lit(False))
    return marked.where(found).select(*map(quoted, rows.columns)), marked.where(~found).select(*map(quoted, rows.columns))


def quoted(name: str) -> F.Column:
    """A column whose name may hold dots or backquotes."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(docs: DataFrame, run, *more: T.StructField) -> DataFrame:
    """``docs.mapInArrow`` for columns of any name, ``more`` behind them; Spark itself takes none with a dot."""
    names = docs.columns
    plain = unused(names, *(f"column_{i}" for i in range(len(names))))
    plain = [p if set(n) & set(".`") else n for n, p in zip(names, plain)]
    fields = [T.StructField(p, f.dataType, f.nullable) for p, f in zip(plain, docs.schema.fields)]
    return docs.toDF(*plain).mapInArrow(run, T.StructType([*fields, *more])).toDF(*names, *(f.name for f in more))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_number(rows: DataFrame, column: str) -> DataFrame:
    """Rows dealt to partitions by ``column`` modulo their number: numbered blocks or buckets spread evenly, while their hashes leave a third of the partitions empty."""
    return rows.repartitionById(parts(rows.sparkSession), F.col(column))
