"""CSV files of unknown layout.

Cells are read as text. Letterhead, the header row and column roles are found on the driver in the
first rows; all else stays distributed. Summary and blank rows go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from . import headers

# What a summary row's id starts with, and what its first cell is.
FOOTER_START = r"^(TOTAL|TOTALES|TOTAL GENERAL|SUMA|SUMATORIA|SUBTOTAL|RESUMEN|PROMEDIO)"
FOOTER_CELL = r"^(TOTAL|TOTALES|TOTAL GENERAL|SUMA|SUMATORIA|SUBTOTAL|GRAND TOTAL)$"


def is_footer(columns: list[str], id_column: str | None) -> Column:
    """Whether a row has no content or is a summary of others."""
    filled = F.filter(F.array(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in columns]), lambda x: x != "")
    first = normalize_text(F.get(filled, F.lit(0)))
    out = (F.size(filled) == 0) | first.rlike(FOOTER_CELL)
    return out | normalize_text(F.col(f"`{id_column}`")).rlike(FOOTER_START) if id_column else out


def quoted_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell may hold a line break: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def lines(spark: SparkSession, path: str, width: int, sep: str = ",", whole: bool = True) -> DataFrame:
    """(_file, _block, _line, c0, c1, ...): the cells of each record, trimmed, '' for none. In a file,
    (_block, _line) orders them. whole: files aren't split, as quoted cells may hold line breaks."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    raw = spark.read.csv(path, schema=schema, sep=sep, quote='"', escape='"', multiLine=whole, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    cells = [F.trim(F.coalesce(F.col(f"c{i}"), F.lit(""))).alias(f"c{i}") for i in range(width)]
    return raw.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"), *cells)


def _top(spark: SparkSession, path: str, sep: str, rows: int, whole: bool) -> list[list[str]]:
    """The first records' cells of the first file, by the same reader; the width follows from the
    first lines."""
    first = [r.value for r in spark.read.text(path).limit(rows).collect()]
    width = max((line.count(sep) + 1 for line in first), default=1)
    found = lines(spark, path, width, sep, whole).orderBy("_file", "_block", "_line").limit(rows).collect()
    return [list(r)[3:] for r in found if r._file == found[0]._file]


def read(spark: SparkSession, path: str, sep: str = ",", scan: int = headers.SCAN_ROWS) -> tuple[DataFrame, headers.Layout]:
    """The data rows, with row_id and the header's columns, and the layout.

    path: a file, or a folder of files with one header; each file's rows up to its header go, and a
    file without it is an error. Files are split among tasks unless quoted cells hold line breaks.
    Of columns with one name the last counts. Raises ValueError where no row looks like a header."""
    whole = quoted_breaks(spark, path)
    top = _top(spark, path, sep, scan, whole)
    layout = headers.find(top)
    if layout is None:
        raise ValueError("BAD_SCHEMA: no header with an id, a category or a region")
    cells = lines(spark, path, max(map(len, top)), sep, whole)
    head = reduce(Column.__and__, [F.col(f"c{i}") == h for i, h in enumerate(layout.headers)])
    files = cells.where("_block = 0").groupBy("_file").agg(F.min("_line").alias("_start"), F.min(F.when(head, F.col("_line"))).alias("_limit"))
    files = files.withColumn("_limit", F.when(F.col("_limit") - F.col("_start") < scan, F.col("_limit")))
    lost = files.where("_limit is null").limit(1).collect()
    if lost:
        raise ValueError(f"BAD_SCHEMA: {lost[0]._file} has no header like the first file's")
    files = files.withColumn("_number", F.row_number().over(Window.orderBy("_file")))  # one row a file
    out = cells.join(files, "_file").where((F.col("_block") > 0) | (F.col("_line") > F.col("_limit")))
    row_id = F.concat(*[F.lpad(F.col(c).cast("string"), n, "0") for c, n in (("_number", 7), ("_block", 15), ("_line", 19))])
    names = {name: i for i, name in enumerate(layout.headers) if name}
    out = out.select(row_id.alias("row_id"), *[F.col(f"c{i}").alias(n) for n, i in names.items()])
    return out.where(~is_footer(list(names), layout.roles.get("entity_raw"))), layout


def roles(df: DataFrame, layout: headers.Layout) -> DataFrame:
    """The columns by role, '' for absent ones; all original columns stay."""
    held = {role: F.coalesce(F.col(f"`{layout.roles[role]}`"), F.lit("")) if layout.roles.get(role) else F.lit("") for role in headers.ROLES}
    return df.withColumns(held)


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    """Later sheets under the first one's columns: what it lacks goes, what they lack is ''."""
    base = sheets[0].columns
    fitted = [s.select(*[F.col(f"`{c}`") if c in s.columns else F.lit("").alias(c) for c in base]) for s in sheets]
    return reduce(DataFrame.unionByName, fitted)


def write(df: DataFrame, path: str) -> None:
    """RFC 4180: quotes doubled, CRLF between records."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', lineSep="\r\n", emptyValue="")
