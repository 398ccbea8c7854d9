"""Sharding by global prefix sums of byte sizes, with DataFrame functions only.

Documents stand in ascending doc_id order. Each range partition sums its sizes; those totals, one
row per partition, become offsets, so every document knows how many bytes come before it without
any task seeing more than its own range. The total is cut at equal targets: a document belongs to
the shard in which its middle byte lies. Shards are contiguous in the order and differ from the
target by less than one document at either end.

Defined results: a null text has no bytes (size 1, crc32 0); a null doc_id sorts first; repeated
rows are rows like any other and stay adjacent; an empty table gives no rows; other columns of the
input are not read. A document larger than a shard's target fills its shard alone, and shards it
covers wholly stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import positions, table

SHARDS = 16


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slot counts from 0 in each shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    placed = positions(sized, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "size")
    total = placed.agg(F.sum("size").alias("_total"))
    placed = placed.join(F.broadcast(total)).withColumn(  # one row
        "shard",
        F.expr(f"cast((2 * cast(_before as decimal(20)) + size) * {shards} div (2 * _total) as int)"),
    )
    first = placed.groupBy("shard").agg(F.min("_pos").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_pos") - F.col("_first")).alias("slot")
    )


def op6_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# DuckDB has no crc32: the SQL makes the table of its polynomial and folds the UTF-8 bytes.
ORACLE = {
    "op6_balanced_shards": f"""
with t as materialized (select list(c order by n) as crcs from (select n, list_reduce(list_prepend(n, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end) as c from range(0, 256) r(n))),
d as (select doc_id, coalesce(text, '') as x from documents),
h as (select doc_id, x, hex(encode(x)) as hx from d),
c as (select doc_id, octet_length(encode(x)) + 1 as size,
    case when x = '' then 0 else xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hx) // 2), lambda i: cast(concat('0x', substr(hx, 2 * i + 1, 2)) as bigint))),
        lambda a, b: xor(a >> 8, crcs[(xor(a, b) & 255) + 1])), 4294967295) end as text_crc32 from h, t),
p as (select *, coalesce(sum(size) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as before, sum(size) over () as total from c),
s as (select *, cast((2 * before + size) * {SHARDS} // (2 * total) as int) as shard from p)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by doc_id) - 1 as slot, cast(null as int) as grown_shard from s
"""
}
QUERIES = {"op6_balanced_shards": op6_balanced_shards}
