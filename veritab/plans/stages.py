"""Where a plan is cut: results that several others read are computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a table that is sent to every task may have: rows, and bytes of text.
SMALL_ROWS, SMALL_BYTES = 1 << 18, 1 << 26

_local_dirs: dict[str, str] = {}


def compilable(df: DataFrame) -> DataFrame:
    """df, in a session whose generated methods the JVM compiles: it never compiles those of more than
    8000 bytes, and Spark's own limit lets whole stages run interpreted. A limit set by others stays."""
    name = "spark.sql.codegen.hugeMethodLimit"
    conf = df.sparkSession.conf
    if conf.get(name, "65535") == "65535":
        conf.set(name, "8000")
    return df


def keep(df: DataFrame) -> DataFrame:
    """df, kept by the executors; what a lost executor held is computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; on a local master without one, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if context.applicationId not in _local_dirs:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _local_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="veritab-")
        context.setCheckpointDir(_local_dirs[context.applicationId])
    return _local_dirs[context.applicationId]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed now and kept in the session's checkpoint folder: for tables of distinct keys and
    catalogs, which many joins read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame, name: str) -> DataFrame:
    """df, computed now and written by columns to the session's checkpoint folder: for tables of as
    many rows as the input, of which each reader takes few columns."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table of the driver's own rows; Spark starts no Python workers for it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ddl)
    fields = to_arrow_schema(schema)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=fields), schema)


def lookup(df: DataFrame) -> DataFrame:
    """cut(df), to be sent to every task that joins it where it is measured to be small; the rows of
    such a join stay where they are."""
    held = cut(df)
    texts = [F.coalesce(F.octet_length(F.to_json(c) if kind.startswith("struct") else F.col(c)), F.lit(0)) for c, kind in held.dtypes if kind == "string" or kind.startswith("struct")]
    n, size = held.agg(F.count("*"), F.sum(sum(texts, F.lit(0)).cast("long"))).first()
    return F.broadcast(held) if n <= SMALL_ROWS and (size or 0) <= SMALL_BYTES else held
