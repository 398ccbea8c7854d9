"""The client template: pending clients out, completed ones back in."""

from __future__ import annotations

import re
import uuid
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import missing_label, normalize_id, normalize_text, safe_file_name
from . import xlsx
from .headers import normal
from .store import Store

# The template's columns, and what may name them in a filled-in file.
COLUMNS = ["Distribuidor", "RIF", "Razón Social", "Falta", "Tipo de Tienda", "Estado"]
FIELDS = {
    "source": ["DISTRIBUIDOR"],
    "entity_id": ["RIF", "NUMERO DE RIF", "N RIF", "CEDULA", "RIF CLIENTE"],
    "client_name": ["RAZON SOCIAL", "NOMBRE", "NOMBRE CLIENTE", "CLIENTE", "RAZON"],
    "category": ["TIPO DE TIENDA", "SEGMENTO DE TIENDA", "TIPO", "SEGMENTO", "SEGMENTO N3", "CANAL"],
    "region": ["ESTADO", "ESTADO FEDERAL", "ESTADO STD", "EDO"],
}
SCAN = 15
#: The sheet that is tried first.
SHEET = "Clasificación de Tiendas"


def template(pending: DataFrame, more: list[str] | None = None) -> DataFrame:
    """A row per pending client, with what is known filled in; more: further columns to keep."""
    known = lambda missing, c: F.when(F.col(missing), F.lit("")).otherwise(F.col(c))
    return pending.select(
        *(more or []), F.col("source").alias(COLUMNS[0]), F.col("entity_id").alias(COLUMNS[1]), F.col("client_name").alias(COLUMNS[2]), missing_label(F.col("no_category"), F.col("no_region")).alias(COLUMNS[3]),
        known("no_category", "category").alias(COLUMNS[4]), known("no_region", "region").alias(COLUMNS[5]))


def find_header(rows: list[list[str]]) -> tuple[int, dict[str, int]] | None:
    """The first of SCAN rows with an id column, and the columns of the fields."""
    known = {f: {n.replace(" ", "") for n in names} for f, names in FIELDS.items()}
    for i, row in enumerate(rows[:SCAN]):
        told = [re.sub(" ", "", normal(c)) for c in row]
        first = {f: next((at for at, n in enumerate(told) if n in names), None) for f, names in known.items()}
        found = {f: at for f, at in first.items() if at is not None}
        if "entity_id" in found:
            return i, found
    return None


def parse(cells: DataFrame, found: tuple[int, dict[str, int]]) -> DataFrame:
    """(entity_id, client_name, category, region) of rows (line, cells) below the header with an id."""
    row, at = found
    get = lambda f: F.trim(F.coalesce(F.get("cells", F.lit(at[f])), F.lit(""))) if f in at else F.lit("")
    out = cells.where(F.col("line") > row).select("line", *[get(f).alias(f) for f in FIELDS])
    return out.where(normalize_id(F.col("entity_id")) != "")


def _known(parsed: DataFrame, categories: DataFrame, regions: DataFrame) -> DataFrame:
    """The parsed rows with the catalogs' category, group and region of what they say, or nulls."""
    cats = categories.select(normalize_text(F.col("category")).alias("_ck"), F.col("category").alias("_c"), F.col("category_group").alias("_g"))
    regs = regions.select(normalize_text(F.col("region")).alias("_rk"), F.col("region").alias("_r"))
    rows = parsed.select("line", "client_name", normalize_id(F.col("entity_id")).alias("entity_id"), normalize_text(F.col("category")).alias("_ck"), normalize_text(F.col("region")).alias("_rk"))
    return rows.join(cats, "_ck", "left").join(regs, "_rk", "left").drop("_ck", "_rk")


def merge(parsed: DataFrame, manual: DataFrame, categories: DataFrame, regions: DataFrame) -> DataFrame:
    """Entries for the manual store, one an id: the last new value of each field, else the earlier
    one; rows that give neither a known category nor a known region are skipped."""
    rows = _known(parsed, categories, regions).where("_c is not null or _r is not null")
    last = lambda value, given: F.max_by(value, F.when(given, F.col("line")))
    named = F.coalesce(F.col("client_name"), F.lit("")) != ""
    new = rows.groupBy("entity_id").agg(
        last("client_name", named).alias("_n"), last("_c", F.col("_c").isNotNull()).alias("_c"), last("_g", F.col("_c").isNotNull()).alias("_g"), last("_r", F.col("_r").isNotNull()).alias("_r"), F.max("line").alias("line")
    )
    old = manual.select(normalize_id(F.col("entity_id")).alias("entity_id"), F.col("client_name").alias("_on"), F.col("category").alias("_oc"), F.col("category_group").alias("_og"), F.col("region").alias("_or"))
    return new.join(old, "entity_id", "left").select(
        "entity_id", F.coalesce("_n", "_on").alias("client_name"), F.coalesce("_c", "_oc").alias("category"),
        F.when(F.col("_c").isNotNull(), F.col("_g")).otherwise(F.col("_og")).alias("category_group"), F.coalesce("_r", "_or").alias("region"), F.col("line").cast("long").alias("pos"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a filled-in workbook's first sheet that has an id column; SHEET goes before the others."""
    top = xlsx.read_cells(spark, path, limit=SCAN).orderBy(F.col("name") != SHEET, "sheet", "line").collect()
    for number in dict.fromkeys(r.sheet for r in top):
        found = find_header([r.cells for r in top if r.sheet == number])
        if found:
            return parse(xlsx.read_cells(spark, path, sheet=number).select("line", "cells"), found)
    raise ValueError("no sheet has a header row with an id column")


def import_file(store: Store, path: str, categories: DataFrame, regions: DataFrame) -> tuple[int, int]:
    """Takes a filled-in workbook into the manual store; rows added and rows skipped."""
    rows = _known(read(store.spark, path), categories, regions)
    counts = rows.agg(F.count_if(F.col("_c").isNotNull() | F.col("_r").isNotNull()).alias("added"), F.count("*").alias("rows")).first()
    if counts.added:
        store.upsert("manual", merge(read(store.spark, path), store.read("manual"), categories, regions))
    return counts.added, counts.rows - counts.added


def file_name(source: Column) -> Column:
    """The template file of a source."""
    blank = F.upper(F.trim(source)).isin("", "SIN_DISTRIBUIDOR") | source.isNull()
    name = F.coalesce(F.nullif(safe_file_name(source), F.lit("")), F.lit("DISTRIBUIDOR"))
    return F.concat(F.lit("Plantilla_Clientes_"), F.when(blank, "SIN_DISTRIBUIDOR").otherwise(name))


def write_all(pending: DataFrame, folder: str) -> DataFrame:
    """One workbook a source in a folder that driver and executors share; (source, file, rows).

    Sources whose names make one file name get numbers behind it, in the order of their names.
    Workbooks are streamed, one at a time in a task, clients of the largest measure first; a file
    gets its name when it is whole.
    """
    names = pending.select("source").distinct().withColumn("_name", file_name(F.col("source")))
    turn = F.row_number().over(Window.partitionBy("_name").orderBy("source"))
    names = names.withColumn("_turn", turn).select("source", F.concat("_name", F.when(F.col("_turn") > 1, F.concat(F.lit("_"), F.col("_turn"))).otherwise(""), F.lit(".xlsx")).alias("_file"))
    filled = template(pending.join(names, "source").withColumn("_order", -F.col("measure")), ["_file", "_order", "entity_key"])
    dealt = filled.repartition("_file").sortWithinPartitions("_file", "_order", "entity_key")

    def run(batches):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        fs.create_dir(root, recursive=True)
        every = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ["_file", *COLUMNS])))
        for file, lines in groupby(every, key=lambda r: r[0]):
            seen = [0, None]

            def told():
                for line in lines:
                    seen[0] += 1
                    seen[1] = line[1]
                    yield line[1:]

            own = f"{root}/{file}.{uuid.uuid4().hex}.attempt"
            with fs.open_output_stream(own) as out:
                xlsx.write_rows(out, COLUMNS, told(), base=SHEET)
            fs.move(own, f"{root}/{file}")
            yield pa.RecordBatch.from_pydict({"source": [seen[1]], "file": [file], "rows": [seen[0]]})

    return dealt.mapInArrow(run, "source string, file string, rows long")
