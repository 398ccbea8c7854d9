"""Regions out of addresses.

The catalogs are data: `explicit` maps names that may follow a title ("EDO X") to regions, `phrases`
maps places to regions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_text

TITLE = r"(?:ESTADOS?|EDOS?)\s*(?:DEL?\s+)?"
GLUED = 6
SHORTEST = 3


def geo_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(c), "[^A-Z0-9]+", " "))


def explicit_region(text: Column, explicit: dict[str, str], bare: dict[str, str] | None = None) -> Column:
    """The region that the last title in the text declares; bare names need no title. text: geo_text."""
    titled = sorted(explicit, key=len, reverse=True)
    alone = sorted(bare or {}, key=len, reverse=True)
    options = [TITLE + f"(?:{'|'.join(map(re.escape, titled))})"] if titled else []
    options += [f"(?:{'|'.join(map(re.escape, alone))})"] if alone else []
    if not options:
        return F.lit(None).cast("string")
    found = F.regexp_extract(text, rf"^.*\b({'|'.join(options)})\b", 1)  # greedy: the last one
    name = F.regexp_replace(found, f"^{TITLE}", "") if titled else found
    pairs = F.create_map(*[F.lit(x) for kv in ((bare or {}) | explicit).items() for x in kv])
    return F.try_element_at(pairs, F.when(found != "", name))


def phrase_region(texts: DataFrame, phrases: DataFrame, col: str = "text") -> DataFrame:
    """(text, region) of the distinct texts that hold a phrase of (phrase, region, pos): the longest
    wins, earlier ones among equals. Phrases of GLUED letters or more may be stuck to a word before.

    Texts and phrases meet on the last word of the phrase: an equi-join, whatever the catalog's size.
    """
    p = phrases.select(F.trim(F.regexp_replace("phrase", "[^A-Z0-9]+", " ")).alias("phrase"), "region", "pos")
    p = p.withColumn("last", F.element_at(F.split("phrase", " "), -1)).where("phrase <> ''")
    single = ~F.col("phrase").contains(" ") & (F.length("phrase") >= GLUED)  # glued: any end of a word
    p = p.withColumn("size", F.when(single, F.length("last")).otherwise(0))
    words = texts.select(col).distinct().where(F.length(col) >= SHORTEST).withColumn("word", F.explode(F.array_distinct(F.split(col, " "))))
    ends = words.withColumn("size", F.explode(F.sequence(F.lit(0), F.length("word")))).where(f"size = 0 or size >= {GLUED}")
    ends = ends.withColumn("last", F.when(F.col("size") == 0, F.col("word")).otherwise(F.right("word", F.col("size"))))
    whole = F.concat(F.lit(" "), F.col(col), F.lit(" "))
    hit = whole.contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) | ((F.length("phrase") >= GLUED) & whole.contains(F.concat(F.col("phrase"), F.lit(" "))))
    found = ends.join(p, ["size", "last"]).where(hit)
    return found.groupBy(col).agg(F.min_by("region", F.struct(-F.length("phrase"), F.col("pos"))).alias("region"))
