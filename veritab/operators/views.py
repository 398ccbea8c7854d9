"""What screens and reports show of a run: ordered pages, counts by domain, mixes, presentation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTER_ROWS = 500
PAGE = 250


def _order(df: DataFrame, key: str, descending: bool) -> list[Column]:
    """By a column, texts in the collation of their letters; ties by all other columns."""
    text = df.schema[key].dataType.simpleString() == "string"
    first = F.collate(F.col(key), "UNICODE") if text else F.col(key)
    return [first.desc() if descending else first.asc(), *[F.col(c) for c in df.columns if c != key]]


def sort_by(df: DataFrame, key: str, descending: bool = False) -> DataFrame:
    """All rows in the order that a person chose."""
    return df.orderBy(*_order(df, key, descending))


def page(df: DataFrame, key: str, number: int = 0, size: int = PAGE, descending: bool = False) -> DataFrame:
    """A page of the ordered rows: only as many rows as end with it are brought together."""
    return sort_by(df, key, descending).offset(number * size).limit(size)


def master_listing(master: DataFrame, rows: int = MASTER_ROWS) -> DataFrame:
    """The first entries of the master by id: the size is that of the list shown."""
    return page(master, "entity_key", 0, rows)


def pending_listing(pending: DataFrame) -> DataFrame:
    """Pending clients, those of the largest measure first."""
    return sort_by(pending, "measure", descending=True)


def domain_counts(queue: DataFrame) -> DataFrame:
    """(domain, items) of a review queue, all of it as TODOS."""
    return queue.rollup("domain").agg(F.count("*").alias("items")).select(F.coalesce("domain", F.lit("TODOS")).alias("domain"), "items")


def of_domain(queue: DataFrame, domain: str = "TODOS") -> DataFrame:
    return queue if domain == "TODOS" else queue.where(F.col("domain") == domain)


def missing_region_only(pending: DataFrame) -> DataFrame:
    """One row: clients that lack a region alone."""
    return pending.agg(F.count_if(F.col("no_region") & ~F.col("no_category")).alias("clients"))


def mix_of_100(summary: DataFrame) -> DataFrame:
    """Whole percentages of three parts each that sum to 100, the last by difference: categories by
    text, by the master and open; regions as sent, recovered and open."""
    whole = lambda n, of: F.floor(n / of * 100 + 0.5)
    col = F.col
    said, known, open_ = col("category_exacto") + col("category_fuzzy"), col("category_maestro"), col("category_sin_clasificar")
    sent, rest, none = col("region_exacto"), col("region_diccionario") + col("region_rif") + col("region_ciudad") + col("region_fuzzy"), col("region_sin_estado")
    out = summary.select(
        whole(said, said + known + open_).alias("category_text"), whole(known, said + known + open_).alias("category_master"),
        whole(sent, sent + rest + none).alias("region_sent"), whole(rest, sent + rest + none).alias("region_recovered"),
    )
    return out.select("*", (100 - col("category_text") - col("category_master")).alias("category_open"), (100 - col("region_sent") - col("region_recovered")).alias("region_open"))


def percent_text(c: Column) -> Column:
    """'92,4%': no trailing zeros, a comma before decimals."""
    plain = F.regexp_replace(c.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")
    return F.concat(F.translate(plain, ".", ","), F.lit("%"))


def count_text(c: Column) -> Column:
    """'740.009': dots between thousands."""
    return F.translate(F.format_number(c, 0), ",", ".")


def manifest_name(run_id: str) -> str:
    """The file name of a run's manifest."""
    return f"manifiesto_corrida_{re.sub('[^A-Za-z0-9_-]', '_', run_id)}.json"
