"""Tables of what was learned, as Parquet folders, with upserts by key.

A write goes to a new version folder, and a small file names the current one. That file is written
under another name and renamed over the old one in a single step, so readers see the old or the new
state, and a crash in between leaves the old one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import alias_key, normalize_id, normalize_text
from ..operators.catalog import delete, upsert

#: Of the tables below.
VERSION = 4
#: name -> (schema, key); pos orders entries.
TABLES: dict[str, tuple[str, Column]] = {}


def tables() -> dict[str, tuple[str, Column]]:
    """The stores; made on first use, as keys are expressions of a running session."""
    if not TABLES:
        variant = "variant string, category string, category_group string, code string, method string, active boolean, pos long"
        alias = "source string, client_code string, entity_id string, client_name string, region string, active boolean, pos long"
        TABLES.update({
            "category_dict": (variant, normalize_text(F.col("variant"))),
            "region_dict": ("variant string, region string, active boolean, pos long", normalize_text(F.col("variant"))),
            "cities": ("city string, region string, active boolean, pos long", normalize_text(F.col("city"))),
            "aliases": (alias, alias_key(F.col("source"), F.col("client_code"))),
            "manual": ("entity_id string, client_name string, category string, category_group string, region string, pos long", normalize_id(F.col("entity_id"))),
            "meta": ("name string, value string, pos long", F.col("name")),
        })
    return TABLES


class Store:
    """The learned tables under a folder; absent ones are empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.tables = tables()

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _version(self, name: str) -> str | None:
        fs, p = self._hadoop(f"{self.folder}/{name}/CURRENT")
        return self.spark.read.text(f"{self.folder}/{name}/CURRENT").first()[0] if fs.exists(p) else None

    def _switch(self, name: str, version: str) -> None:
        """Makes a version the current one."""
        jvm = self.spark.sparkContext._jvm
        fs, new = self._hadoop(f"{self.folder}/{name}/{version}.next")
        out = fs.create(new, True)
        out.write(bytearray(version.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, self._hadoop(f"{self.folder}/{name}/CURRENT")[1], options)

    def read(self, name: str) -> DataFrame:
        version = self._version(name)
        schema = self.tables[name][0]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def replace(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        columns = [c.strip().split(" ")[0] for c in self.tables[name][0].split(",")]
        df.select(*columns).write.parquet(f"{self.folder}/{name}/{version}")
        self._switch(name, version)

    def upsert(self, name: str, entries: DataFrame) -> None:
        stored = self.read(name)
        last = stored.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("_last"))
        moved = entries.join(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last")  # one row
        self.replace(name, upsert(stored, moved.select(*stored.columns), self.tables[name][1]))

    def delete(self, name: str, keys: DataFrame) -> None:
        self.replace(name, delete(self.read(name), keys, self.tables[name][1]))

    def wipe(self) -> None:
        """Empties all but meta."""
        for name in self.tables:
            if name != "meta":
                self.replace(name, self.spark.createDataFrame([], self.tables[name][0]))

    def upgrade(self) -> int:
        """Makes the tables that an older store lacks, notes the version, and returns the one before."""
        row = self.read("meta").where("name = 'version'").first()
        for name in self.tables:
            if self._version(name) is None:
                self.replace(name, self.spark.createDataFrame([], self.tables[name][0]))
        self.upsert("meta", self.spark.createDataFrame([("version", str(VERSION), 0)], self.tables["meta"][0]))
        return int(row.value) if row else 0

    def counts(self) -> DataFrame:
        parts = [self.read(n).agg(F.lit(n).alias("name"), F.count("*").alias("entries")) for n in self.tables]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def import_dictionary(df: DataFrame, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, counts) from a file's columns variant and category, found without case; entries
    whose category isn't in the catalog are skipped. counts: added, skipped."""
    names = {c.strip().lower(): c for c in df.columns}
    rows = df.select(F.trim(F.col(f"`{names['variant']}`")).alias("variant"), F.trim(F.col(f"`{names['category']}`")).alias("category"), F.monotonically_increasing_id().alias("pos"))
    known = categories.select("category", "category_group", F.lit(True).alias("_known"))
    joined = rows.where("variant <> ''").join(known, "category", "left")
    counts = joined.agg(F.count_if(F.col("_known").isNotNull()).alias("added"), F.count_if(F.col("_known").isNull()).alias("skipped"))
    return joined.where("_known").select("variant", "category", "category_group", F.lit("").alias("code"), F.lit("MANUAL").alias("method"), F.lit(True).alias("active"), "pos"), counts


def import_regions(df: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As import_dictionary, for columns variant and region, matched in normal form."""
    rows = df.select(F.trim("variant").alias("variant"), normalize_text(F.col("region")).alias("_k"), F.monotonically_increasing_id().alias("pos"))
    joined = rows.where("variant <> ''").join(regions.select(normalize_text(F.col("region")).alias("_k"), F.col("region")), "_k", "left")
    counts = joined.agg(F.count_if(F.col("region").isNotNull()).alias("added"), F.count_if(F.col("region").isNull()).alias("skipped"))
    return joined.where("region is not null").select("variant", "region", F.lit(True).alias("active"), "pos"), counts


def import_aliases(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Aliases from source, client_code, entity_id, client_name, region; an unknown region becomes null."""
    known = regions.select(normalize_text(F.col("region")).alias("_k"), F.col("region").alias("_r"))
    rows = df.withColumn("_k", normalize_text(F.col("region"))).withColumn("pos", F.monotonically_increasing_id()).drop("region")
    rows = rows.where((F.trim("client_code") != "") & (normalize_id(F.col("entity_id")) != ""))
    return rows.join(known, "_k", "left").select("source", "client_code", "entity_id", "client_name", F.col("_r").alias("region"), F.lit(True).alias("active"), "pos")


#: Kinds of review items and the store that a decision goes to.
ROUTES = {
    "VARIANTE_NUEVA": "category_dict", "ALTO_VOLUMEN_SIN_CLASIFICAR": "category_dict", "CONFLICTO_MAYOR": "manual", "ESTADO_VARIANTE_NUEVA": "region_dict",
    "ESTADO_SIN_RESOLVER": "region_dict", "CIUDAD_SIN_MAPEAR": "cities",
}


def decide(store: Store, kind: str, value: str, decision: str, categories: DataFrame, regions: DataFrame) -> None:
    """Stores what a person decided about a review item; the decision must be in the catalog."""
    spark, name = store.spark, ROUTES[kind]
    if name in ("region_dict", "cities"):
        if regions.where(F.col("region") == decision).isEmpty():
            raise ValueError(f"no region {decision}")
        row = {"variant" if name == "region_dict" else "city": value, "region": decision, "active": True, "pos": 0}
    else:
        found = categories.where(F.col("category") == decision).first()
        if found is None:
            raise ValueError(f"no category {decision}")
        row = {"variant": value, "entity_id": value, "client_name": None, "category": decision, "category_group": found.category_group, "code": "", "method": "MANUAL", "region": None, "active": True, "pos": 0}
    schema = store.tables[name][0]
    columns = [c.strip().split(" ")[0] for c in schema.split(",")]
    store.upsert(name, spark.createDataFrame([tuple(row[c] for c in columns)], schema))
