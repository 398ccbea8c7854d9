"""Shared folders, table access and distributed positions."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset (tests on local[*]), a temporary folder takes its place; on any other
    master that would be a machine-local folder, so it is an error.
    """
    importable(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veritab-")
        context.setCheckpointDir(_local_dirs[context.applicationId])
    return _local_dirs[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder: lost executors lose nothing of it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def importable(spark: SparkSession) -> None:
    """Lets Python workers of local masters import this package from where the driver has it; a
    cluster's executors have it by installation, PYTHONPATH or --py-files."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if spark.sparkContext.master.startswith("local") and HOME not in known:
        environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, known)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(df: DataFrame, order: list[Column], size: str | None = None) -> DataFrame:
    """df with _pos, the row's place (from 0) in the order, and with size also _before, the sum
    of that column over all rows before.

    Rows are dealt by range, and only one row per range partition meets in one place to turn
    per-partition totals into offsets. Pass narrow rows: they are checkpointed once, so that
    totals and running sums see the same ranges whatever is recomputed. Equal rows of the order
    get adjacent places; which of them comes first is not defined.
    """
    spark = df.sparkSession
    ranged = checkpoint(
        df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    )
    weight = F.col(size) if size else F.lit(0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_part")
        .agg(F.count("*").alias("_n"), F.sum(weight).cast("long").alias("_s"))
        .select(
            "_part",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_pos0"),
            F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before0"),
        )
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        ranged.join(F.broadcast(offsets), "_part")  # one row per range partition
        .withColumn("_pos", F.col("_pos0") + F.row_number().over(inside) - 1)
        .withColumn("_before", F.col("_before0") + F.coalesce(F.sum(weight).over(running), F.lit(0)))
        .drop("_part", "_pos0", "_before0")
    )
    return out if size else out.drop("_before")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def own_columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever characters their names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all of df's columns but maps, which have none."""
    return F.xxhash64(*[c for c, f in zip(own_columns(df), df.schema) if "map<" not in f.dataType.simpleString()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def once(c: Column) -> Column:
    """c, computed once a row: a generated column isn't copied into the expressions that use it, as
    the optimizer does with a projected one. Stands alone in a select."""
    return F.explode(F.array(c))
