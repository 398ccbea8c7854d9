"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

A source of weight w gets the right to one block in every window [floor((j-1)/w), ceil(j/w)):
its j-th block is released at the left end and due at the right end. Earliest deadline first over
released blocks meets every deadline when the weights sum to 1, so at any slot each source has had
within one block of its weight's share.

Weights are exact rationals (a double stands for its own value), brought to coprime integers c with
the sum C: w = c / C. The schedule follows every block of the corpus with releases and deadlines in
whole numbers. It is made on the driver, one heap operation a block, and goes to the shared folder
CHUNK blocks at a time, so the driver's memory follows the sources and its time the blocks. A block
is block_rows consecutive documents of a source in doc_id order: BLOCK_ROWS, or as many more as keep
the corpus at about BLOCKS blocks, so the driver's work is bounded whatever the corpus. A source that has run out has no
further blocks; a slot for which no block is released stays empty. Until the first source has run
out no slot is empty and the deviation bound holds for all sources; later the others keep their
windows, and so their mutual shares, and every document is placed.

Defined results: null sources are one source of their own; repeated rows take adjacent places;
null or empty texts are documents like any other; an empty table gives no rows; every source has
its own entry of the schedule, however many there are; extra columns of the input are not read.
Sources without a stated weight, or with one of 0, are taken last.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import positions, scratch, table

CHUNK = 1 << 19
BLOCK_ROWS, BLOCKS = 8, 1 << 22
ALPHA = 0.5
#: Tables with one row a source are broadcast up to so many sources.
BROADCAST_SOURCES = 1 << 16
NULL, REST = "n", "r"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Positive integers in proportion to the weights with the sum period, by largest remainder:
    rounded, for plans of one short period. mix doesn't round."""
    live = {k: Fraction(v) for k, v in weights.items() if v > 0}
    total = sum(live.values())
    exact = {k: v * period / total for k, v in live.items()}
    out = {k: max(1, int(v)) for k, v in exact.items()}
    left = period - sum(out.values())
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k))[: max(left, 0)]:
        out[k] += 1
    while sum(out.values()) > period:  # many tiny sources were raised to 1
        out[max(out, key=lambda k: (out[k], k))] -= 1
    return out


def exact(weights: dict[str, float | Fraction]) -> dict[str, int]:
    """Coprime positive integers in the very proportion of the weights over 0."""
    live = {k: Fraction(v) for k, v in weights.items() if v > 0}
    scale = math.lcm(*(v.denominator for v in live.values()))
    whole = {k: v.numerator * (scale // v.denominator) for k, v in live.items()}
    common = math.gcd(*whole.values())
    return {k: v // common for k, v in whole.items()}


def edf(counts: dict[str, int], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, j, release, deadline, slot) of the sources' blocks by slot; j counts from 0."""
    total = sum(counts.values())
    waiting = [(0, k, 0) for k in counts if blocks.get(k, 0)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // counts[k]), k, j, release))
        deadline, k, j, release = heapq.heappop(ready)
        yield k, j, release, deadline, slot
        if j + 1 < blocks[k]:
            heapq.heappush(waiting, ((j + 1) * total // counts[k], k, j + 1))
        slot += 1


def schedule(counts: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """One period of sum(counts) slots."""
    return list(edf(counts, counts))


def _plan(spark: SparkSession, counts: dict[str, int], blocks: dict[str, int]) -> DataFrame:
    """The schedule of all blocks as (_key, block, release, deadline, slot)."""
    schema = pa.schema([("_key", pa.string())] + [(c, pa.int64()) for c in ("block", "release", "deadline", "slot")])
    path, steps = scratch(spark, "schedule"), edf(counts, blocks)
    while True:
        chunk = list(islice(steps, CHUNK))
        columns = zip(*chunk) if chunk else [[]] * len(schema)
        part = pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema)
        spark.createDataFrame(part).write.mode("append").parquet(path)
        if len(chunk) < CHUNK:
            return spark.read.parquet(path)


def tempered(counts: dict[str, int], alpha: float = ALPHA) -> dict[str, float]:
    """Target weights in proportion to (rows of a source) ** alpha."""
    return {k: float(n) ** alpha for k, n in counts.items()}


def source_rows(docs: DataFrame) -> dict[str, int]:
    """Rows of every source, keyed like _key below: one row a source comes to the driver."""
    got = docs.groupBy(_key("source").alias("k")).agg(F.count("*").alias("n")).toArrow()
    return dict(zip(got["k"].to_pylist(), got["n"].to_pylist()))


def _key(c: str):
    """A source's key in the schedule: s and its name, or n for null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit(NULL))


def mix(docs: DataFrame, weights: dict[str | None, float | Fraction] | None = None, period: int | None = None, block_rows: int | None = None, max_sources: int | None = None) -> DataFrame:
    """(doc_id, source, _hash, _copies, weight, block, release, deadline, slot, position) of every
    distinct (doc_id, source, text); it takes the places position to position + _copies - 1.

    period and max_sources are accepted for older callers: nothing is rounded to a period, and no
    sources are pooled.
    """
    spark = docs.sparkSession
    rows = docs.groupBy("doc_id", "source", F.xxhash64("text").alias("_hash")).agg(F.count("*").alias("_copies"))
    sizes = source_rows(docs)
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(sizes.values()) // BLOCKS))
    target = tempered(sizes) if weights is None else {NULL if k is None else f"s{k}": w for k, w in weights.items()}
    counts = exact(target) if any(w > 0 for w in target.values()) else {}
    total = sum(counts.values())
    plan = _plan(spark, counts, {k: -(-n // block_rows) for k, n in sizes.items()})
    schema = pa.schema([("_key", pa.string()), ("weight", pa.float64())])
    known = spark.createDataFrame(pa.table([pa.array(counts, pa.string()), pa.array([c / total for c in counts.values()], pa.float64())], schema))
    small = F.broadcast if max(len(counts), len(sizes)) <= BROADCAST_SOURCES else lambda df: df
    keyed = rows.withColumn("_key", _key("source"))
    keyed = keyed.join(small(known.select("_key", F.lit(True).alias("_known"))), "_key", "left")
    keyed = keyed.withColumn("_key", F.when(F.col("_known"), F.col("_key")).otherwise(F.lit(REST))).drop("_known")
    placed = positions(keyed, [F.col(c) for c in ("_key", "source", "doc_id", "_hash")], "_copies")
    first = placed.groupBy("_key").agg(F.min("_before").alias("_first")).join(small(known), "_key", "left")
    placed = (
        placed.join(small(first), "_key")  # a row for each source
        .withColumn("_at", F.col("_before") - F.col("_first"))
        .withColumn("block", F.expr(f"_at div {block_rows}"))
        .join(plan, ["_key", "block"], "left")
    )
    late = F.col("slot").isNull()  # no weight: after all others
    placed = placed.select(
        "doc_id", "source", "_hash", "_copies", F.coalesce("weight", F.lit(0.0)).alias("weight"), "block", "_at",
        "release", "deadline", "slot",
        F.when(late, 1).otherwise(0).alias("_late"),
    )
    order = ["_late", "slot", "_at"]
    return positions(placed, [F.col(c) for c in order], "_copies").withColumnRenamed("_before", "position").drop("_pos", "_late", "_at")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in the mix; weights are the sources' row counts to the power ALPHA,
    shown to 12 places."""
    mixed = mix(table(spark, sf_dir, "documents"))
    each = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return each.select("doc_id", "source", F.round("weight", 12).alias("weight"), "block", "release", "deadline", "slot", (F.col("position") + F.col("_copy")).alias("position"))


ORACLE = {
    "op3_mix_sources": """
with recursive d as (select doc_id, source, coalesce('s' || source, 'n') as k, row_number() over (partition by coalesce('s' || source, 'n') order by doc_id) - 1 as nth from documents),
s as (select k, cast(pow(count(*), 0.5) * 4503599627370496 as hugeint) as c, (count(*) + 7) // 8 as blocks from d group by k),
t as (select list(k order by k) as ks, list(c order by k) as cs, list(blocks order by k) as bs, sum(c) as total, count(*) as n from s),
e as (
    select cast(-1 as hugeint) as slot, list_transform(range(n), lambda x: cast(0 as hugeint)) as nxt, cast(null as struct(d hugeint, i bigint, j hugeint, r hugeint)) as best from t where n > 0
    union all
    select slot, list_transform(range(1, len(nxt) + 1), lambda i: case when i = best.i then nxt[i] + 1 else nxt[i] end), best from (
        select slot, nxt, list_sort(list_filter(open, lambda x: x.r <= slot))[1] as best from (
            select greatest(slot + 1, list_min(list_transform(open, lambda x: x.r))) as slot, nxt, open from (
                select slot, nxt, list_filter(list_transform(range(1, n + 1), lambda i: {'d': ((nxt[i] + 1) * total + cs[i] - 1) // cs[i], 'i': i, 'j': nxt[i], 'r': nxt[i] * total // cs[i]}), lambda x: x.j < bs[x.i]) as open
                from e, t) where len(open) > 0))),
p as (select ks[best.i] as k, cs[best.i] / total as weight, cast(best.j as bigint) as block, cast(best.r as bigint) as release, cast(best.d as bigint) as deadline, cast(slot as bigint) as slot from e, t where best is not null)
select doc_id, source, round(cast(weight as double), 12) as weight, block, release, deadline, slot, row_number() over (order by slot, nth) - 1 as position from d join p on p.k = d.k and p.block = nth // 8
"""
}
QUERIES = {"op3_mix_sources": op3_mix_sources}
