"""The configuration of the next run: seed catalogs with what was learned over them, and its exports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import alias_key, normalize_text
from ..operators.catalog import Config, check_thresholds, merge_learned, migrate_codes
from . import csv
from .store import Store

# The exports' columns, by store, each with the store's column.
EXPORTS = {
    "category_dict": {"variante": "variant", "segmento_n3": "category", "macro_canal_n1": "category_group", "codigo": "code"},
    "region_dict": {"variante": "variant", "estado_std": "region"},
    "aliases": {"distribuidor": "source", "codigo_cliente": "client_code", "rif_canonico": "entity_id", "razon_social": "client_name", "estado_std": "region"},
    "manual": {"rif": "entity_id", "segmento_n3": "category", "macro_canal_n1": "category_group"},
}


def merge_cities(seed: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned active cities win over the seed's of the same normal form; inactive ones are ignored."""
    key = normalize_text(F.col("city"))
    return merge_learned(seed.select("city", "region", "pos"), learned.where("active").select("city", "region", "pos"), key)


def save_thresholds(store: Store, assign: float, suggest: float) -> tuple[int, int]:
    """Keeps the thresholds, in their bounds, for later runs."""
    kept = check_thresholds(assign, suggest)
    rows = [("assign", str(kept[0]), 0), ("suggest", str(kept[1]), 1)]
    store.upsert("meta", store.spark.createDataFrame(rows, store.tables["meta"][0]))
    return kept


def thresholds(store: Store, config: Config) -> tuple[int, int]:
    """The kept thresholds, else the configuration's."""
    kept = {r.name: float(r.value) for r in store.read("meta").where(F.col("name").isin("assign", "suggest")).collect()}  # two rows
    return check_thresholds(kept.get("assign", config.assign), kept.get("suggest", config.suggest))


def load(store: Store, seed: Config, legacy: DataFrame | None = None) -> Config:
    """The seed configuration with the stores over it: dictionaries, cities, manual entries, aliases and
    thresholds. legacy: (old, new) names of categories, by which learned entries are brought up to
    date; entries of unknown categories go, manual ones lose the category."""
    learned, manual = store.read("category_dict"), store.read("manual")
    if legacy is not None:
        learned = migrate_codes(learned, legacy, seed.categories).where("category is not null")
        manual = migrate_codes(manual, legacy, seed.categories)
    assign, suggest = thresholds(store, seed)
    variant = normalize_text(F.col("variant"))
    return replace(
        seed,
        category_dict=merge_learned(seed.category_dict, learned, variant),
        region_dict=merge_learned(seed.region_dict, store.read("region_dict"), variant),
        cities=merge_cities(seed.cities, store.read("cities")),
        manual=seed.manual.unionByName(manual.select(*seed.manual.columns)),
        aliases=merge_learned(seed.aliases, store.read("aliases"), alias_key(F.col("source"), F.col("client_code"))),
        assign=assign, suggest=suggest, prepared=None,
    )


def export_rows(store: Store, name: str) -> DataFrame:
    """A learned table as its export has it: '' for nulls; manual entries with their rule."""
    out = store.read(name).select(*[F.coalesce(F.col(c), F.lit("")).alias(title) for title, c in EXPORTS[name].items()])
    return out.withColumn("regla", F.lit("MANUAL")) if name == "manual" else out


def export_learned(store: Store, folder: str) -> None:
    """The four learned tables as folders of CSV files."""
    for name in EXPORTS:
        csv.write(export_rows(store, name), f"{folder.rstrip('/')}/{name}")
