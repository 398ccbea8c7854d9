"""The three runs: counting, pipeline and export. All are lazy frames but for what header detection reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_text
from ..operators import entity, quality
from ..operators.catalog import Config
from ..operators.resolve import Texts, category_texts, place_texts, resolve, resolve_texts, with_places, with_texts
from .stages import compilable, keep, stage

# The columns that an export appends, in their order.
OUTPUT = [
    "segmento_n3_std", "macro_canal_n1_std", "metodo_segmento", "confianza_segmento", "estado_std", "metodo_estado", "flag_registro", "valor_original_segmento",
    "valor_original_estado", "version_diccionario", "run_id",
]


@dataclass
class Run:
    resolved: DataFrame
    master: DataFrame
    conflicts: DataFrame
    branches: DataFrame
    recovered: DataFrame
    region_recovered: DataFrame
    seen: DataFrame

    @property
    def metrics(self) -> DataFrame:
        return quality.source_metrics(self.resolved)

    @property
    def sources(self) -> DataFrame:
        return quality.source_quality(self.metrics, self.recovered)

    @property
    def summary(self) -> DataFrame:
        return quality.coverage(self.resolved, self.recovered, self.region_recovered)

    @property
    def pending(self) -> DataFrame:
        return quality.pending_clients(self.resolved, self.master)

    @property
    def queue(self) -> DataFrame:
        return quality.ranked_queue(quality.queue_groups(self.resolved))

    @property
    def review(self) -> DataFrame:
        return quality.merge_conflicts(self.queue, self.conflicts)

    @property
    def checks(self) -> DataFrame:
        return quality.audit_checks(self.summary, self.pending)

    @property
    def rows(self) -> DataFrame:
        return self.resolved

    @property
    def coded(self) -> DataFrame:
        return self.resolved

    @property
    def placed(self) -> DataFrame:
        return self.resolved

    def release(self) -> None:
        """What the executors hold is let go."""
        self.seen.unpersist()
        self.master.unpersist()


class Direct:
    """The parts of a run from the source: for single results of one pass over the rows, the master
    among them. Readers take those columns of the source that they need, and no rows are written;
    those of one field alone resolve no texts of the other."""

    def __init__(self, rows: DataFrame, config: Config):
        self.rows, self.config = entity.with_fields(compilable(rows)), config

    @cached_property
    def named(self) -> DataFrame:
        return entity.with_entity(self.rows, self.config)

    @cached_property
    def categories(self) -> DataFrame:
        return category_texts(self.rows, self.config)

    @cached_property
    def places(self) -> DataFrame:
        return place_texts(self.rows, self.config)

    @property
    def coded(self) -> DataFrame:
        """The rows with their categories, without entities."""
        return self.rows.join(self.categories, "category_raw", "left")

    @property
    def placed(self) -> DataFrame:
        """The rows with entities and regions, without categories."""
        return entity.patch_alias_region(with_places(self.named, self.places))

    @cached_property
    def resolved(self) -> DataFrame:
        return entity.patch_alias_region(with_texts(resolve_texts(self.named, self.config, told=self.rows)))

    @cached_property
    def observed(self) -> DataFrame:
        return entity.observations(self.resolved, self.config)

    @cached_property
    def seen(self) -> DataFrame:
        return keep(entity.gather(self.observed))

    @cached_property
    def _golden(self) -> tuple[DataFrame, DataFrame]:
        master, conflicts = entity.build_master(self.seen, self.config)
        return keep(master), conflicts

    @property
    def master(self) -> DataFrame:
        return self._golden[0]

    @property
    def conflicts(self) -> DataFrame:
        return self._golden[1]

    @property
    def branches(self) -> DataFrame:
        return entity.branches(self.observed)

    def release(self) -> None:
        """What the executors hold is let go."""
        for held in (self.__dict__.get("seen"), self.__dict__.get("_golden", [None])[0]):
            if held is not None:
                held.unpersist()


def counting(rows: DataFrame) -> DataFrame:
    """One row: rows, sources and clients."""
    source = F.trim(F.coalesce("source", F.lit("")))
    client = F.nullif(normalize_text(F.col("entity_raw")), F.lit(""))
    return rows.agg(F.count("*").alias("rows"), F.countDistinct(F.when(source == "", "SIN_DISTRIBUIDOR").otherwise(source)).alias("sources"), F.countDistinct(client).alias("clients"))


def pipeline(rows: DataFrame, config: Config) -> Run:
    """Resolves by text alone, builds the master from that, and recovers what the master knows.

    The source is read once, for the rows with their fields and entities, which are written by
    columns. What texts resolve to is joined to them by each reader, for the columns that it needs."""
    rows = stage(entity.with_entity(entity.with_fields(compilable(rows)), config).drop(*entity.READ), "rows")
    resolved = entity.patch_alias_region(resolve(rows, config))
    observed = entity.observations(resolved, config)
    seen = keep(entity.gather(observed))
    master, conflicts = entity.build_master(seen, config)
    master = keep(master)
    return Run(resolved, master, conflicts, entity.branches(observed), quality.category_recovery(resolved, master), quality.region_recovery(resolved, master), seen)


def export_master(texts: Texts, config: Config) -> DataFrame:
    """The first pass of an export: the master, with regions known by hand or alias in the cascade."""
    first = with_texts(texts, known_regions=entity.seed_regions(config))
    seen = keep(entity.gather(entity.observations(first, config)))
    return keep(entity.build_master(seen, config)[0])


def export(rows: DataFrame, config: Config, originals: list[str], dictionary_version: str = "v1", run_id: str = "run-0") -> DataFrame:
    """The original columns and the OUTPUT ones, '' for nulls; categories and regions by the master first."""
    rows = entity.with_fields(compilable(rows))
    texts = resolve_texts(entity.with_entity(rows, config, blank_source=False), config, told=rows)
    master = export_master(texts, config)
    regions = entity.overlay_regions(master, entity.seed_regions(config))
    out = with_texts(texts, master.select("entity_key", "category", "category_group"), regions)
    values = ["category", "category_group", "category_method", "category_confidence", "region", "region_method", "row_flag", "category_raw", "region_raw"]
    said = [F.coalesce(F.col(v), F.lit("")).alias(o) for v, o in zip(values, OUTPUT)]
    return out.select("row_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in originals], *said, F.lit(dictionary_version).alias(OUTPUT[9]), F.lit(run_id).alias(OUTPUT[10]))
