"""Row resolution: two dirty fields through ordered cascades.

Each cascade runs once per distinct normal form and is joined back to the rows, so the costs of
regular expressions and fuzzy matches follow the distinct texts, not the rows. Rows in: row_id,
source, entity_raw, client_code, client_name, category_raw, region_raw, city_raw, branch,
period_raw, measure_raw; nulls read as ''.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import explicit_region, geo_text, phrase_region
from ..functions.text import clean_region, is_no_city, is_no_region, normalize_text
from ..plans.stages import cut, lookup
from .catalog import Config, indexes
from .fuzzy import best_match

NO_SOURCE = "SIN_DISTRIBUIDOR"


@dataclass
class Texts:
    """What the texts of some rows resolve to, whoever their entities are."""

    rows: DataFrame
    categories: DataFrame  # by category_raw, with category_key
    places: DataFrame  # by region_raw and city_raw, with region_text and city_key


def category_by_text(keys: DataFrame, config: Config) -> DataFrame:
    """(category_key, category, category_group, category_method, category_score, suggested_category,
    suggested_category_score) for distinct keys: exact, then fuzzy, then a suggestion."""
    index = indexes(config).categories
    exact = index.select(F.col("key").alias("category_key"), F.col("category").alias("_c"), F.col("category_group").alias("_g"))
    asked = keys.where("category_key <> ''").join(exact, "category_key", "left")
    candidates = index.select(F.col("key").alias("candidate"), "pos")
    near = best_match(asked.where("_c is null").select(F.col("category_key").alias("key")), candidates, config.suggest)
    named = index.select(F.col("key").alias("candidate"), F.col("category").alias("_fc"), F.col("category_group").alias("_fg"))
    near = near.join(named, "candidate").select(F.col("key").alias("category_key"), "_fc", "_fg", "score")
    taken = F.col("score") >= config.assign
    hinted = F.col("score") < config.assign
    return asked.join(near, "category_key", "left").select(
        "category_key",
        F.when(F.col("_c").isNotNull(), F.col("_c")).when(taken, F.col("_fc")).alias("category"),
        F.when(F.col("_c").isNotNull(), F.col("_g")).when(taken, F.col("_fg")).alias("category_group"),
        F.when(F.col("_c").isNotNull(), "EXACTO").when(taken, "FUZZY").alias("category_method"),
        F.col("score").alias("category_score"),
        F.when(hinted, F.col("_fc")).alias("suggested_category"),
        F.when(hinted, F.col("_fg")).alias("suggested_group"),
        F.when(hinted, F.col("score")).alias("suggested_category_score"),
    )


def parse_geo(texts: DataFrame, config: Config, col: str = "text") -> DataFrame:
    """(text, region) of distinct geo_texts: a declared region, else a known phrase's."""
    named = texts.select(col).distinct().where(F.length(col) >= 3)
    phrases = phrase_region(named, config.phrases, col).withColumnRenamed("region", "_phrase")
    told = F.coalesce(explicit_region(F.col(col), config.explicit, config.bare), "_phrase")
    both = named.join(phrases, col, "left").select(col, normalize_text(told).alias("region"))
    known = indexes(config).regions.select(F.col("key").alias("region"))
    return both.join(known, "region", "left_semi").select(col, "region")


def region_by_text(keys: DataFrame, config: Config) -> DataFrame:
    """For distinct (region_text, city_key): strong_region and strong_method (exact, dictionary),
    which go before an entity's known region, and weak_region, weak_method, region_score,
    suggested_region, suggested_region_score (city, address, fuzzy), which go after it.

    region_text: the normal form of the raw region.
    """
    by = indexes(config)
    catalog, index = by.regions, by.variants
    regions = keys.select("region_text").distinct().withColumn("clean", clean_region(F.col("region_text")))
    usable = (F.col("clean") != "") & ~is_no_region(F.col("clean")) & ~is_no_region(F.col("region_text"))
    regions = regions.withColumn("usable", usable)
    known = catalog.select(F.col("key").alias("clean"), F.col("key").alias("_exact"))
    by_raw = index.select(F.col("key").alias("region_text"), F.col("region").alias("_raw"))
    by_clean = index.select(F.col("key").alias("clean"), F.col("region").alias("_clean"))
    regions = regions.join(known, "clean", "left").join(by_raw, "region_text", "left").join(by_clean, "clean", "left")
    told = F.coalesce("_raw", "_clean")
    regions = regions.select(
        "region_text", "clean", "usable",
        F.when(F.col("usable"), F.coalesce("_exact", told)).alias("strong_region"),
        F.when(F.col("usable") & F.col("_exact").isNotNull(), "EXACTO").when(F.col("usable") & told.isNotNull(), "DICCIONARIO").alias("strong_method"),
        F.when(~is_no_region(F.col("region_text")), geo_text(F.col("region_text"))).alias("text"),
    )
    cities = keys.select("city_key").distinct().where((F.col("city_key") != "") & ~is_no_city(F.col("city_key")))
    cities = cities.join(by.cities.select(F.col("key").alias("city_key"), F.col("region").alias("_city")), "city_key", "left")
    cities = cities.withColumn("text", geo_text(F.col("city_key")))
    # both kinds of texts, each once, that nothing better has resolved
    open_ = regions.where("strong_region is null").select("text").unionByName(cities.where("_city is null").select("text"))
    geo = cut(parse_geo(open_, config))

    found = geo.select("text", F.col("region").alias("_found"))
    regions = regions.join(found, "text", "left").withColumn("_geo", F.when(F.col("strong_region").isNull(), F.col("_found"))).drop("text", "_found")
    # the catalog's keys come before the dictionary's among equal scores
    first = catalog.select(F.col("key").alias("candidate"), F.col("key").alias("to"), F.col("pos").cast("double").alias("pos"))
    top = catalog.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_top"))
    more = index.join(F.broadcast(top)).select(F.col("key").alias("candidate"), F.col("region").alias("to"), (F.col("pos") + F.col("_top") + 1).cast("double").alias("pos"))  # one row
    candidates = first.unionByName(more.join(first.select("candidate"), "candidate", "left_anti"))
    open_ = regions.where("usable and strong_region is null and _geo is null").select(F.col("clean").alias("key")).distinct()
    near = best_match(open_, candidates, config.suggest).join(candidates.select("candidate", "to"), "candidate")
    regions = regions.join(near.select(F.col("key").alias("clean"), "to", "score"), "clean", "left")
    cities = cities.join(found, "text", "left").select("city_key", F.coalesce("_city", "_found").alias("_city"))

    taken = F.col("usable") & (F.col("score") >= config.assign)
    hinted = F.col("usable") & (F.col("score") < config.assign) & F.col("_city").isNull() & F.col("_geo").isNull() & F.col("strong_region").isNull()
    return keys.join(regions, "region_text").join(cities, "city_key", "left").select(
        "region_text", "city_key", "strong_region", "strong_method",
        F.coalesce("_city", "_geo", F.when(taken, F.col("to"))).alias("weak_region"),
        F.when(F.col("_city").isNotNull(), "CIUDAD").when(F.col("_geo").isNotNull(), "DICCIONARIO").when(taken, "FUZZY").alias("weak_method"),
        F.when(F.col("usable"), F.col("score")).alias("region_score"),
        F.when(hinted, F.col("to")).alias("suggested_region"),
        F.when(hinted, F.col("score")).alias("suggested_region_score"),
    )


def resolve_texts(rows: DataFrame, config: Config, told: DataFrame | None = None) -> Texts:
    """The texts of the rows, resolved once for all passes that read them: the distinct texts of both
    kinds come out of one pass over told, by default the rows, which reads nothing but texts."""
    place = F.struct(F.lit(None).cast("string").alias("category_raw"), "region_raw", "city_raw")
    category = F.struct("category_raw", F.lit(None).cast("string").alias("region_raw"), F.lit(None).cast("string").alias("city_raw"))
    raws = (rows if told is None else told).select("category_raw", "region_raw", "city_raw").distinct()
    raws = raws.select(F.inline(F.array(category, place))).distinct()
    raws = cut(raws.withColumns({
        "category_key": normalize_text(F.col("category_raw")), "region_text": normalize_text(F.col("region_raw")), "city_key": normalize_text(F.col("city_raw")),
    }))
    said = raws.where("category_raw is not null").select("category_raw", "category_key")
    where = raws.where("category_raw is null").select("region_raw", "city_raw", "region_text", "city_key")
    categories = category_by_text(said.select("category_key").distinct(), config)
    places = region_by_text(where.select("region_text", "city_key").distinct(), config)
    return Texts(rows, lookup(said.join(categories, "category_key", "left")), lookup(where.join(places, ["region_text", "city_key"], "left")))


def category_texts(told: DataFrame, config: Config) -> DataFrame:
    """The categories of Texts alone."""
    said = cut(told.select("category_raw").distinct().withColumn("category_key", normalize_text(F.col("category_raw"))))
    found = category_by_text(said.select("category_key").distinct(), config)
    return lookup(said.join(found, "category_key", "left"))


def place_texts(told: DataFrame, config: Config) -> DataFrame:
    """The places of Texts alone."""
    where = told.select("region_raw", "city_raw").distinct()
    where = cut(where.withColumns({"region_text": normalize_text(F.col("region_raw")), "city_key": normalize_text(F.col("city_raw"))}))
    found = region_by_text(where.select("region_text", "city_key").distinct(), config)
    return lookup(where.join(found, ["region_text", "city_key"], "left"))


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The rows with the resolved fields of places alone."""
    return _placed(rows.join(places, ["region_raw", "city_raw"], "left"))


def resolve(rows: DataFrame, config: Config, master: DataFrame | None = None, known_regions: DataFrame | None = None, told: DataFrame | None = None) -> DataFrame:
    """rows, which need entity_key, with the resolved fields."""
    return with_texts(resolve_texts(rows, config, told), master, known_regions)


def with_texts(texts: Texts, master: DataFrame | None = None, known_regions: DataFrame | None = None) -> DataFrame:
    """The rows with the resolved fields.

    master: (entity_key, category, category_group) of known entities, which go before the text;
    known_regions: (entity_key, region), which go between the strong and the weak region.
    """
    out = texts.rows.join(texts.categories, "category_raw", "left").join(texts.places, ["region_raw", "city_raw"], "left")
    if master is not None:
        carried = master.where("coalesce(trim(category), '') <> '' or coalesce(trim(category_group), '') <> ''")
        m = carried.select("entity_key", F.col("category").alias("_mc"), F.col("category_group").alias("_mg"), F.lit(True).alias("_known"))
        out = out.join(m, "entity_key", "left")
        mine = F.col("_known").isNotNull()
        out = out.withColumns({
            "category": F.when(mine, F.col("_mc")).otherwise(F.col("category")),
            "category_group": F.when(mine, F.col("_mg")).otherwise(F.col("category_group")),
            "category_method": F.when(mine, F.lit("MAESTRO")).otherwise(F.col("category_method")),
            "category_confidence": F.when(mine & (F.coalesce("_mc", F.lit("")) == ""), "MACRO").when(mine | F.col("category_method").isNotNull(), "N3"),
            "suggested_category": F.when(~mine, F.col("suggested_category")),
            "suggested_group": F.when(~mine, F.col("suggested_group")),
            "suggested_category_score": F.when(~mine, F.col("suggested_category_score")),
        }).drop("_mc", "_mg", "_known")
    else:
        out = out.withColumn("category_confidence", F.when(F.col("category_method").isNotNull(), "N3"))
    if known_regions is not None:
        out = out.join(known_regions.select("entity_key", F.col("region").alias("_known")), "entity_key", "left")
    return _placed(out).withColumn("row_flag", row_flag())


def _placed(out: DataFrame) -> DataFrame:
    """The regions of rows joined with what their places resolve to and, as _known, with known regions."""
    if "_known" not in out.columns:
        out = out.withColumn("_known", F.lit(None).cast("string"))
    out = out.withColumns({
        "region": F.coalesce("strong_region", "_known", "weak_region"),
        "region_method": F.when(F.col("strong_region").isNotNull(), F.col("strong_method")).when(F.col("_known").isNotNull(), "RIF").otherwise(F.col("weak_method")),
        "suggested_region": F.when(F.col("_known").isNull(), F.col("suggested_region")),
        "suggested_region_score": F.when(F.col("_known").isNull(), F.col("suggested_region_score")),
    })
    return out.drop("_known", "strong_region", "strong_method", "weak_region", "weak_method")


def row_flag():
    return F.when(F.col("category_method").isNull(), "SIN_CLASIFICAR").when(F.col("region").isNull(), "SIN_ESTADO").otherwise("OK")
