"""Entities: alias resolution, and the golden record of each entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_period
from ..functions.numeric import guard_measure, parse_numeric
from ..functions.text import alias_key, normalize_id, normalize_text
from .catalog import Config, alias_lookups, indexes
from .resolve import NO_SOURCE, row_flag

#: The period of what people classified by hand: later than any.
MANUAL_PERIOD = (1 << 53) - 1
#: Columns that nothing reads once fields and entities are known.
READ = ["entity_raw", "client_code", "client_name", "alias_name", "period_raw", "measure_raw"]
#: Parts that rows without an alias key are dealt to.
LANES = 4096


def with_fields(rows: DataFrame) -> DataFrame:
    """Roles with defaults: '' for nulls, the source's stand-in, measure and period parsed."""
    texts = ["entity_raw", "client_code", "client_name", "category_raw", "region_raw", "city_raw", "branch", "period_raw", "measure_raw"]
    rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})
    source = F.trim(F.coalesce("source", F.lit("")))
    return rows.withColumns({
        "source": F.when(source == "", NO_SOURCE).otherwise(source),
        "measure": parse_numeric(F.col("measure_raw")),
        "period": parse_period(F.col("period_raw")),
    }).withColumn("measure", guard_measure(F.col("measure")))


def with_entity(rows: DataFrame, config: Config, blank_source: bool = True) -> DataFrame:
    """rows with entity_id (raw, else by alias), entity_key, alias_name and alias_region.

    Without blank_source, rows without a source don't use the (source, code) tier. Rows that need no
    alias have null keys; a lane deals them evenly where the joins deal rows at all.
    """
    exact, by_code = alias_lookups(config)
    rows = rows.withColumn("_own", normalize_id(F.col("entity_raw")))
    lacks = (F.col("_own") == "") & (F.col("client_code") != "")
    source = F.col("source") if blank_source else F.when(F.col("source") != NO_SOURCE, F.col("source"))
    rows = rows.withColumns({"_ek": F.when(lacks, alias_key(source, F.col("client_code"))), "_ck": F.when(lacks, normalize_text(F.col("client_code"))), "_lane": F.when(lacks, F.lit(0)).otherwise(F.pmod(F.xxhash64("row_id"), F.lit(LANES)).cast("int"))})
    a = exact.select(F.col("key").alias("_ek"), F.lit(0).alias("_lane"), F.col("alias").alias("_a"))
    b = by_code.select(F.col("key").alias("_ck"), F.lit(0).alias("_lane"), F.col("alias").alias("_b"))
    out = rows.join(a, ["_ek", "_lane"], "left").join(b, ["_ck", "_lane"], "left").withColumn("_a", F.coalesce("_a", "_b"))
    return out.withColumns({
        "entity_id": F.coalesce("_a.alias_entity", "entity_raw"), "alias_name": F.col("_a.alias_name"), "alias_region": F.col("_a.alias_region"),
        "entity_key": F.coalesce("_a.alias_entity", "_own"),  # an alias's entity is in normal form
        "name": F.coalesce(F.nullif(F.col("client_name"), F.lit("")), F.col("_a.alias_name"), F.lit("")),
    }).drop("_own", "_ek", "_ck", "_lane", "_a", "_b")


def patch_alias_region(resolved: DataFrame) -> DataFrame:
    """Where the text gives no region, the alias's; the method is that of a known entity."""
    patch = F.col("region").isNull() & F.col("alias_region").isNotNull()
    out = resolved.withColumns({"region_method": F.when(patch, "RIF").otherwise(F.col("region_method")), "region": F.coalesce("region", "alias_region")})
    return out.withColumn("row_flag", row_flag()) if "category_method" in out.columns else out


def manual_observations(config: Config) -> DataFrame:
    return config.manual.select(
        F.lit("").alias("row_id"), normalize_id(F.col("entity_id")).alias("entity_key"), "entity_id", F.coalesce("category", F.lit("")).alias("category"), F.coalesce("category_group", F.lit("")).alias("category_group"),
        F.lit("MANUAL").alias("method"), F.lit(MANUAL_PERIOD).cast("long").alias("period"), F.col("client_name").alias("name"), F.col("region"), F.lit("").alias("branch"), F.lit("").alias("city"),
    )


def observations(resolved: DataFrame, config: Config) -> DataFrame:
    """What the rows tell about their entities, and what people told."""
    seen = F.col("category_method").isin("EXACTO", "FUZZY")
    found = resolved.where(seen | F.col("region").isNotNull()).select(
        "row_id", "entity_key", "entity_id", F.when(seen, F.col("category")).otherwise("").alias("category"), F.when(seen, F.col("category_group")).otherwise("").alias("category_group"),
        F.when(seen, F.col("category_method")).alias("method"), F.when(seen, F.col("period")).cast("long").alias("period"), "name", "region", "branch", F.col("city_raw").alias("city"),
    )
    return manual_observations(config).unionByName(found)


def first_seen(value: str, order: str = "row_id"):
    """The value of the first row that has one."""
    has = F.coalesce(F.col(value), F.lit("")) != ""
    return F.min_by(value, F.when(has, F.col(order)))


def _told() -> Column:
    return F.trim(F.coalesce("category", F.lit(""))) != ""


def _placed() -> Column:
    return F.trim(F.coalesce("region", F.lit(""))) != ""


def gather(obs: DataFrame) -> DataFrame:
    """What obs tell about each entity by category and region: rows, latest period, whether by hand,
    and the first id, name and group, each with its row's id. The master is made of this table, so
    that one pass reads the rows."""
    named = F.coalesce(F.col("name"), F.lit("")) != ""
    first = lambda value: F.struct("row_id", F.col(value).alias("value"))
    return obs.where((F.col("entity_key") != "") & (_told() | _placed())).groupBy("entity_key", "category", "region").agg(
        F.min(first("entity_id")).alias("first_id"), F.min(F.when(named, first("name"))).alias("first_name"), F.min(first("category_group")).alias("first_group"), F.count("*").alias("rows"),
        F.max("period").alias("latest"), F.bool_or(F.coalesce(F.col("method") == "MANUAL", F.lit(False))).alias("manual"),
    )


def branches(obs: DataFrame) -> DataFrame:
    """(entity_key, branch, region, city, branch_rows) of the entities' rows that have a region."""
    placed = obs.where((F.col("entity_key") != "") & _placed())
    return placed.groupBy("entity_key", "branch", "region", "city").agg(F.count("*").alias("branch_rows"))


def build_master(seen: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(master, conflicts) of what was seen, as gather gives it.

    master: entity_key, entity_id, client_name, category, category_group, region, rule. The category
    is that of the manual ones if any, then the latest, then the most frequent, then the first in
    order; catch-all categories yield to specific ones. Entities under several groups, none by hand,
    are conflicts: entity_key, entity_id, client_name, groups, categories, rows. Entities with a
    region alone are in the master with null categories.
    """
    base = seen.groupBy("entity_key").agg(F.min("first_id").alias("_i"), F.min("first_name").alias("_n"), F.sum("rows").alias("rows"))
    base = base.select("entity_key", F.col("_i.value").alias("entity_id"), F.col("_n.value").alias("client_name"), "rows")
    regions = seen.where(_placed()).groupBy("entity_key", "region").agg(F.sum("rows").alias("n"))
    usual = regions.groupBy("entity_key").agg(F.min_by("region", F.struct(-F.col("n"), "region")).alias("region"))

    cats = seen.where(_told()).groupBy("entity_key", "category").agg(F.min("first_group").alias("_g"), F.sum("rows").alias("n"), F.max("latest").alias("latest"), F.bool_or("manual").alias("manual"))
    cats = cats.select("entity_key", "category", F.col("_g.value").alias("category_group"), "n", "latest", "manual")
    mine = Window.partitionBy("entity_key")
    specific = F.col("manual") | (normalize_text(F.col("category")) != config.catch_all)
    cats = cats.withColumn("_s", specific).withColumn("_any", F.max("_s").over(mine)).where("_s or not _any")
    cats = cats.withColumns({"_hand": F.max("manual").over(mine), "_groups": F.size(F.collect_set("category_group").over(mine))})
    clash = (~F.col("_hand")) & (F.col("_groups") > 1)
    groups = cats.where(clash).groupBy("entity_key").agg(F.array_sort(F.collect_set("category_group")).alias("groups"), F.array_sort(F.collect_set("category")).alias("categories"))
    conflicts = groups.join(base, "entity_key").select("entity_key", "entity_id", "client_name", "groups", "categories", "rows")

    pool = cats.where(~clash & (F.col("manual") | ~F.col("_hand")))
    order = mine.orderBy(F.desc_nulls_last("latest"), F.desc("n"), F.collate("category", "UNICODE"))
    ranked = pool.withColumns({"_n": F.row_number().over(order), "_same": F.count("*").over(Window.partitionBy("entity_key", "latest"))})
    winner = ranked.where("_n = 1").select(
        "entity_key", "category", "category_group", F.when(F.col("_hand"), "MANUAL").when(F.col("_same") > 1, "MODA").otherwise("RECIENTE").alias("rule")
    )
    master = base.join(usual, "entity_key", "left").join(winner, "entity_key", "left").join(conflicts.select("entity_key"), "entity_key", "left_anti")
    master = master.where("category is not null or region is not null")
    return master.select("entity_key", "entity_id", "client_name", "category", "category_group", "region", "rule"), conflicts


def branch_lists(branches: DataFrame) -> DataFrame:
    """(entity_key, branches): structs, the most frequent first."""
    item = F.struct((-F.col("branch_rows")).alias("order"), "branch", "region", "city", "branch_rows")
    return branches.groupBy("entity_key").agg(F.array_sort(F.collect_list(item)).alias("branches"))


def seed_regions(config: Config) -> DataFrame:
    """(entity_key, region) known before any row: by hand, else by alias (the last of each)."""
    catalog = indexes(config).regions.select(F.col("key").alias("region"))
    told = config.aliases.where("active").select(normalize_id(F.col("entity_id")).alias("entity_key"), normalize_text(F.col("region")).alias("region"), F.lit(0).alias("_by"), "pos")
    hand = config.manual.select(normalize_id(F.col("entity_id")).alias("entity_key"), normalize_text(F.col("region")).alias("region"), F.lit(1).alias("_by"), F.lit(0).alias("pos"))
    both = told.unionByName(hand, allowMissingColumns=True).where("entity_key <> ''").join(catalog, "region", "left_semi")
    return both.groupBy("entity_key").agg(F.max_by("region", F.struct("_by", "pos")).alias("region"))


def overlay_regions(master: DataFrame, seed: DataFrame) -> DataFrame:
    """The master's usual regions over the known ones."""
    m = master.where("region is not null").select("entity_key", F.col("region").alias("_m"))
    return m.join(seed, "entity_key", "full").select("entity_key", F.coalesce("_m", "region").alias("region"))
