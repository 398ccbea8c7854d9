"""Indexes over catalogs and dictionaries, and their merges with what was learned.

A catalog row order is its pos column. Dictionaries: (variant, category, category_group, code,
method, active, pos) and (variant, region, active, pos); cities: (city, region, pos); aliases:
(source, client_code, entity_id, client_name, region, active, pos).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, distinctive_code, normalize_id, normalize_text
from ..plans.stages import cut, lookup


@dataclass
class Config:
    """Everything that a run resolves with."""

    categories: DataFrame  # category, category_group, pos
    category_dict: DataFrame
    regions: DataFrame  # region, pos
    region_dict: DataFrame
    cities: DataFrame
    aliases: DataFrame
    manual: DataFrame  # entity_id, client_name, category, category_group, region
    phrases: DataFrame  # phrase, region, pos
    explicit: dict[str, str] = field(default_factory=dict)
    bare: dict[str, str] = field(default_factory=dict)
    assign: int = 92
    suggest: int = 80
    catch_all: str = "OTROS"
    prepared: Indexes | None = field(default=None, repr=False, compare=False)
    named: tuple[DataFrame, DataFrame] | None = field(default=None, repr=False, compare=False)


def check_thresholds(assign: float, suggest: float) -> tuple[int, int]:
    """Both rounded; the floor within 50 to 99, the threshold within the floor and 100."""
    floor = min(99, max(50, int(suggest + 0.5)))
    return min(100, max(floor, int(assign + 0.5))), floor


def _one(df: DataFrame, *order) -> DataFrame:
    lane = Window.partitionBy("key").orderBy(*order)
    return df.where("key <> ''").withColumn("_n", F.row_number().over(lane)).where("_n = 1").drop("_n")


def _entries(df: DataFrame, kind: str, key: str, a: Column, b: Column | None = None, last: bool = False) -> DataFrame:
    """Catalog rows in one form: kind, key (normal), values a and b, pos, and turn, whose least counts."""
    b = F.lit(None).cast("string") if b is None else b
    return df.select(F.lit(kind).alias("kind"), normalize_text(F.col(key)).alias("key"), a.alias("a"), b.alias("b"), "pos", (-F.col("pos") if last else F.col("pos")).alias("turn"))


def _firsts(entries: DataFrame) -> DataFrame:
    found = entries.where("key <> ''").groupBy("kind", "key").agg(F.min_by(F.struct("a", "b", "pos"), F.struct("turn", "a", "b")).alias("f"))
    return found.select("kind", "key", "f.a", "f.b", "f.pos")


def _category_entries(dictionary: DataFrame) -> DataFrame:
    return _entries(dictionary.where("active"), "category", "variant", F.col("category"), F.col("category_group"))


def _variant_entries(dictionary: DataFrame) -> DataFrame:
    return _entries(dictionary.where("active"), "variant", "variant", normalize_text(F.col("region"))).where("a <> ''")


def _region_entries(regions: DataFrame) -> DataFrame:
    return _entries(regions, "region", "region", normalize_text(F.col("region")))


def _city_entries(cities: DataFrame) -> DataFrame:
    rows = cities.where("active") if "active" in cities.columns else cities
    return _entries(rows, "city", "city", normalize_text(F.col("region")), last=True)


def _as_categories(found: DataFrame) -> DataFrame:
    return found.where("kind = 'category'").select("key", F.col("a").alias("category"), F.col("b").alias("category_group"), "pos")


def _as_variants(found: DataFrame) -> DataFrame:
    return found.where("kind = 'variant'").select("key", F.col("a").alias("region"), "pos")


def _as_regions(found: DataFrame) -> DataFrame:
    return found.where("kind = 'region'").select("key", "pos")


def _as_cities(found: DataFrame) -> DataFrame:
    return found.where("kind = 'city'").select("key", F.col("a").alias("region"))


def category_index(dictionary: DataFrame) -> DataFrame:
    """(key, category, category_group, pos): the first active entry of each normal form."""
    return _as_categories(_firsts(_category_entries(dictionary)))


def region_index(dictionary: DataFrame) -> DataFrame:
    """(key, region, pos): the first active entry of each normal form that has a region."""
    return _as_variants(_firsts(_variant_entries(dictionary)))


def region_catalog(regions: DataFrame) -> DataFrame:
    """(key, pos) of the regions' normal forms."""
    return _as_regions(_firsts(_region_entries(regions)))


def city_index(cities: DataFrame) -> DataFrame:
    """(key, region): the last active entry of each normal form."""
    return _as_cities(_firsts(_city_entries(cities)))


@dataclass
class Indexes:
    """The indexes of a configuration, made once a run: one table, computed by one job."""

    categories: DataFrame
    variants: DataFrame
    regions: DataFrame
    cities: DataFrame


def indexes(config: Config) -> Indexes:
    if config.prepared is None:
        parts = [_category_entries(config.category_dict), _variant_entries(config.region_dict), _region_entries(config.regions), _city_entries(config.cities)]
        found = cut(_firsts(reduce(DataFrame.unionByName, parts)))
        config.prepared = Indexes(_as_categories(found), _as_variants(found), _as_regions(found), _as_cities(found))
    return config.prepared


def master_index(entries: DataFrame) -> DataFrame:
    """The last entry of each normal id, by pos."""
    return _one(entries.withColumn("key", normalize_id(F.col("entity_id"))), F.desc("pos"))


def alias_indexes(aliases: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Active aliases by (source, code), and by a code alone that means one entity in all sources.
    regions: the catalog's keys."""
    known = regions.select(F.col("key").alias("_region"))
    a = aliases.where("active").select(
        alias_key(F.col("source"), F.col("client_code")).alias("key"), normalize_text(F.col("client_code")).alias("code"),
        normalize_id(F.col("entity_id")).alias("alias_entity"), F.col("client_name").alias("alias_name"), normalize_text(F.col("region")).alias("_region"), "pos",
    )
    a = a.where("key <> '::' and alias_entity <> ''")
    a = a.join(known.withColumn("alias_region", F.col("_region")), "_region", "left").drop("_region")
    fields = ["alias_entity", "alias_name", "alias_region"]
    exact = _one(a, "pos").select("key", *fields)
    codes = a.where(distinctive_code(F.col("code"))).groupBy("code").agg(
        F.min_by(F.struct(*fields), "pos").alias("_a"), F.min("alias_entity").alias("_x"), F.max("alias_entity").alias("_y")
    )
    return exact, codes.where("_x = _y").select(F.col("code").alias("key"), *[F.col(f"_a.{f}").alias(f) for f in fields])


def alias_lookups(config: Config) -> tuple[DataFrame, DataFrame]:
    """The alias indexes of a configuration, computed once a run: (key, alias), a struct of the fields."""
    if config.named is None:
        fields = F.struct("alias_entity", "alias_name", "alias_region").alias("alias")
        exact, by_code = alias_indexes(config.aliases, indexes(config).regions)
        config.named = lookup(exact.select("key", fields)), lookup(by_code.select("key", fields))
    return config.named


def merge_learned(seed: DataFrame, learned: DataFrame, key) -> DataFrame:
    """Seed entries whose key was not learned, and all learned ones. key: a function of the frame's
    columns. Learned positions follow the seed's."""
    named = lambda df: df.withColumn("_key", key)
    kept = named(seed).join(named(learned).select("_key").distinct(), "_key", "left_anti")
    last = seed.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("_last"))
    moved = learned.join(F.broadcast(last)).withColumn("pos", F.col("pos") + F.col("_last") + 1).drop("_last")  # one row
    return kept.drop("_key").unionByName(moved)


def upsert(stored: DataFrame, entries: DataFrame, key) -> DataFrame:
    """stored with the entries written over it by key; the last entry of a key counts."""
    latest = _one(entries.withColumn("key", key), F.desc("pos")).drop("key")
    kept = stored.withColumn("_key", key).join(latest.select(key.alias("_key")), "_key", "left_anti").drop("_key")
    return kept.unionByName(latest)


def delete(stored: DataFrame, keys: DataFrame, key) -> DataFrame:
    """stored without the rows of the keys (key)."""
    return stored.withColumn("key", key).join(keys.select("key").distinct(), "key", "left_anti").drop("key")


def duplicate_variants(dictionary: DataFrame) -> DataFrame:
    """(key, variants) of variants that collide in normal form."""
    keyed = dictionary.groupBy(normalize_text(F.col("variant")).alias("key")).agg(F.count("*").alias("variants"))
    return keyed.where("variants > 1")


def by_parent(categories: DataFrame) -> DataFrame:
    """(category_group, categories, first_pos) in catalog order."""
    return categories.groupBy("category_group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "category"))), lambda x: x.category), ",").alias("categories"), F.min("pos").alias("first_pos")
    )


def migrate_codes(entries: DataFrame, legacy: DataFrame, categories: DataFrame, col: str = "category") -> DataFrame:
    """Old category names as current ones, by (old, new), compared in normal form; unknown ones become
    null. A category_group column follows."""
    named = categories.select("category", "category_group")
    now = named.select(normalize_text(F.col("category")).alias("_key"), F.struct("category", "category_group").alias("_now"))
    old = legacy.select(normalize_text(F.col("old")).alias("_key"), F.col("new").alias("category")).join(named, "category")
    joined = entries.withColumn("_key", normalize_text(F.col(col))).join(now, "_key", "left")
    joined = joined.join(old.select("_key", F.struct("category", "category_group").alias("_old")), "_key", "left").withColumn("_n", F.coalesce("_now", "_old"))
    values = {col: F.col("_n.category")} | ({"category_group": F.col("_n.category_group")} if "category_group" in entries.columns else {})
    return joined.withColumns(values).select(*entries.columns)
