"""Recovery, metrics, the review queue, pending clients and audit."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import guard_measure, pct1
from ..functions.text import is_no_category, is_no_city, is_no_region, clean_region, normalize_text, slug_id
from .entity import first_seen

CATEGORY_METHODS = ["MAESTRO", "EXACTO", "FUZZY", "SIN_CLASIFICAR"]
REGION_METHODS = ["EXACTO", "DICCIONARIO", "RIF", "CIUDAD", "FUZZY", "SIN_ESTADO"]
PER_DOMAIN, MERGED = 150, 400


def category_bucket() -> Column:
    return F.when(F.col("category_method").isin(CATEGORY_METHODS[:3]), F.col("category_method")).otherwise("SIN_CLASIFICAR")


def region_bucket() -> Column:
    return F.when(F.col("region_method").isin(REGION_METHODS[:5]), F.col("region_method")).otherwise("SIN_ESTADO")


def _tally() -> list[Column]:
    one = lambda c: F.count_if(c)
    out = [F.count("*").alias("rows"), one(F.col("category_method") == "EXACTO").alias("raw_exact"), one(F.col("row_flag") != "SIN_CLASIFICAR").alias("resolved"),
           one(F.col("region").isNotNull()).alias("region_valid"), one(F.col("region_method") == "EXACTO").alias("region_raw_exact"),
           F.sum("measure").alias("measure"), F.sum(F.when(F.col("row_flag") == "SIN_CLASIFICAR", F.col("measure")).otherwise(0.0)).alias("measure_unclassified")]
    out += [one(category_bucket() == m).alias(f"category_{m.lower()}") for m in CATEGORY_METHODS]
    return out + [one(region_bucket() == m).alias(f"region_{m.lower()}") for m in REGION_METHODS]


def source_metrics(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("source").agg(*_tally())


def totals(resolved: DataFrame) -> DataFrame:
    return resolved.agg(*_tally())


def metrics_rollup(resolved: DataFrame) -> DataFrame:
    """Sources and, with a null source, the totals, in one pass."""
    return resolved.rollup("source").agg(*_tally())


def unresolved_by_entity(resolved: DataFrame) -> DataFrame:
    open_ = resolved.where("row_flag = 'SIN_CLASIFICAR' and entity_key <> ''")
    return open_.groupBy("entity_key").agg(F.count("*").alias("rows"), F.sum("measure").alias("measure"), F.min_by("entity_id", "row_id").alias("entity_id"), first_seen("name").alias("client_name"), F.min_by("source", "row_id").alias("source"))


def category_recovery(resolved: DataFrame, master: DataFrame) -> DataFrame:
    """(source, entity_key, rows, measure) of unclassified rows whose entity the master classifies."""
    known = master.where("coalesce(trim(category), '') <> '' or coalesce(trim(category_group), '') <> ''").select("entity_key")
    open_ = resolved.where("row_flag = 'SIN_CLASIFICAR' and entity_key <> ''")
    return open_.join(known, "entity_key", "left_semi").groupBy("source", "entity_key").agg(F.count("*").alias("rows"), F.sum("measure").alias("measure"))


def region_recovery(resolved: DataFrame, master: DataFrame) -> DataFrame:
    """(entity_key, rows) of rows without a region whose entity has a usual one."""
    open_ = resolved.where("region is null and entity_key <> ''")
    return open_.join(master.where("region is not null").select("entity_key"), "entity_key", "left_semi").groupBy("entity_key").agg(F.count("*").alias("rows"))


def _place() -> Column:
    return F.concat(F.lit("d"), F.row_number().over(Window.orderBy(F.desc("measure"), "source")) - 1).alias("id")


def source_ids(rows: DataFrame) -> DataFrame:
    """(id, source): the sources' ids by measure, as source_quality gives them."""
    return rows.groupBy("source").agg(F.sum("measure").alias("measure")).select(_place(), "source")


def raw_quality(coded: DataFrame) -> DataFrame:
    """(source, raw_quality_pct, rows) of each source before recovery, as source_quality gives them;
    coded needs categories alone."""
    counted = coded.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(F.col("category_method") == "EXACTO").alias("raw_exact"))
    return counted.select("source", pct1(F.col("raw_exact"), F.col("rows")).alias("raw_quality_pct"), "rows")


def source_quality(metrics: DataFrame, recovered: DataFrame) -> DataFrame:
    """Sources by measure: position, raw_quality_pct before and post_quality_pct after recovery."""
    back = recovered.groupBy("source").agg(F.sum("rows").alias("back"))
    out = metrics.join(back, "source", "left").withColumn("post", F.least(F.col("resolved") + F.coalesce("back", F.lit(0)), F.col("rows")))
    return out.select(
        _place(), "source", pct1(F.col("raw_exact"), F.col("rows")).alias("raw_quality_pct"),
        pct1(F.col("post"), F.col("rows")).alias("post_quality_pct"), pct1(F.col("region_raw_exact"), F.col("rows")).alias("region_raw_pct"), "rows", "measure",
    )


def coverage(resolved: DataFrame, recovered: DataFrame, region_recovered: DataFrame) -> DataFrame:
    """One row: tallies after recovery, percentages, measures and distinct counts."""
    t = resolved.agg(*_tally(), F.count_if(F.col("category_key") != "").alias("raw_present"), F.countDistinct("source").alias("sources"),
                     F.countDistinct(F.nullif(normalize_text(F.col("entity_id")), F.lit(""))).alias("clients"))
    r = recovered.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("recovered_rows"), F.coalesce(F.sum("measure"), F.lit(0.0)).alias("recovered_measure"))
    e = region_recovered.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("recovered_regions"))
    out = t.join(F.broadcast(r)).join(F.broadcast(e))  # one row each
    out = out.withColumns({
        "category_maestro": F.col("category_maestro") + F.col("recovered_rows"), "category_sin_clasificar": F.col("category_sin_clasificar") - F.col("recovered_rows"),
        "region_rif": F.col("region_rif") + F.col("recovered_regions"), "region_sin_estado": F.col("region_sin_estado") - F.col("recovered_regions"),
        "measure_unclassified": F.col("measure_unclassified") - F.col("recovered_measure"),
    })
    done = F.col("rows") - F.col("category_sin_clasificar")
    return out.withColumns({
        "classified_pct": pct1(done, F.col("rows")), "raw_classified_pct": F.least(F.lit(100.0), pct1(done, F.col("raw_present"))),
        "valid_region_pct": pct1(F.col("region_valid") + F.col("recovered_regions"), F.col("rows")),
    })


def quality_mix(quality: DataFrame) -> DataFrame:
    """Unweighted means over sources and the gain."""
    return quality.agg(F.avg("raw_quality_pct").alias("_r"), F.avg("post_quality_pct").alias("_p")).select(
        (F.floor(F.col("_r") * 10 + 0.5) / 10).alias("avg_raw"), (F.floor(F.col("_p") * 10 + 0.5) / 10).alias("avg_post"), (F.floor((F.col("_p") - F.col("_r")) * 10 + 0.5) / 10).alias("gain")
    )


def queue_groups(resolved: DataFrame) -> DataFrame:
    """(kind, value, rows, measure, suggestion, suggestion_score): what people could decide."""
    category, region, city = F.col("category_key"), F.col("region_text"), F.col("city_key")
    none = lambda t: F.lit(None).cast(t)
    m = guard_measure(F.col("measure")).alias("measure")
    hinted = F.col("suggested_category").isNotNull()
    cats = resolved.where(~is_no_category(category) & (hinted | (F.col("row_flag") == "SIN_CLASIFICAR"))).select(
        F.when(hinted, "VARIANTE_NUEVA").otherwise("ALTO_VOLUMEN_SIN_CLASIFICAR").alias("kind"), category.alias("value"), m, "row_id", F.col("suggested_category").alias("s"), F.col("suggested_category_score").alias("n"))
    open_ = F.col("region").isNull()
    hinted = F.col("suggested_region").isNotNull()
    regs = resolved.where(open_ & ~is_no_region(region) & ~is_no_region(clean_region(region))).select(
        F.when(hinted, "ESTADO_VARIANTE_NUEVA").otherwise("ESTADO_SIN_RESOLVER").alias("kind"), region.alias("value"), m, "row_id", F.col("suggested_region").alias("s"), F.col("suggested_region_score").alias("n"))
    cities = resolved.where(open_ & ~is_no_city(city)).select(F.lit("CIUDAD_SIN_MAPEAR").alias("kind"), city.alias("value"), m, "row_id", none("string").alias("s"), none("int").alias("n"))
    every = cats.unionByName(regs).unionByName(cities)
    return every.groupBy("kind", "value").agg(F.count("*").alias("rows"), F.sum("measure").alias("measure"), F.min("row_id").alias("first_row"), F.min_by(F.struct("s", "n"), "row_id").alias("_s")).select(
        "kind", "value", "rows", "measure", "first_row", F.col("_s.s").alias("suggestion"), F.col("_s.n").alias("suggestion_score"))


def ranked_queue(groups: DataFrame, per_domain: int = PER_DOMAIN) -> DataFrame:
    """The per_domain most urgent items of each domain: cities by rows, all else by measure."""
    items = groups.withColumns({
        "domain": F.when(F.col("kind").isin("VARIANTE_NUEVA", "ALTO_VOLUMEN_SIN_CLASIFICAR"), "SEGMENTO").otherwise("ESTADO"),
        "priority": F.when(F.col("kind") == "CIUDAD_SIN_MAPEAR", F.col("rows").cast("double")).otherwise(F.col("measure")), "id": slug_id(F.col("kind"), F.col("value")),
    })
    order = Window.partitionBy("domain").orderBy(F.desc("priority"), "first_row", "kind")
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_domain)


def merge_conflicts(queue: DataFrame, conflicts: DataFrame, cap: int = MERGED) -> DataFrame:
    """The queue, then conflicts by rows, cap items in all."""
    none = lambda t: F.lit(None).cast(t)
    told = F.nullif(F.concat_ws(" · ", F.nullif(F.col("client_name"), F.lit("")), F.array_join("categories", " vs ")), F.lit(""))
    q = queue.select("id", "domain", "kind", "value", "rows", "measure", "suggestion", "suggestion_score", none("string").alias("detail"), F.lit(0).alias("section"), (-F.col("priority")).alias("o"), "first_row")
    c = conflicts.select(slug_id(F.lit("CONFLICTO_MAYOR"), F.col("entity_id")).alias("id"), F.lit("SEGMENTO").alias("domain"), F.lit("CONFLICTO_MAYOR").alias("kind"), F.col("entity_id").alias("value"), "rows",
                         F.lit(0.0).alias("measure"), none("string").alias("suggestion"), none("int").alias("suggestion_score"), told.alias("detail"), F.lit(1).alias("section"), (-F.col("rows")).cast("double").alias("o"), F.col("entity_key").alias("first_row"))
    return q.unionByName(c).orderBy("section", "o", "first_row", "kind").limit(cap).drop("section", "o", "first_row")


def pending_clients(resolved: DataFrame, master: DataFrame) -> DataFrame:
    """Entities with rows that lack a category or a region which the master doesn't fill."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_id")))
    seen = resolved.where("entity_key <> ''").groupBy("entity_key").agg(
        F.min_by("source", "row_id").alias("source"), F.min_by("entity_id", "row_id").alias("entity_id"), first_seen("name").alias("name"), F.sum("measure").alias("measure"), F.count("*").alias("rows"),
        F.bool_or(F.col("category").isNull()).alias("no_category"), F.bool_or(F.col("region").isNull()).alias("no_region"), last("category").alias("c"), last("region").alias("r"))
    out = seen.join(master.select("entity_key", F.col("category").alias("mc"), F.col("region").alias("mr")), "entity_key", "left").withColumns({
        "no_category": F.col("no_category") & (F.coalesce("mc", F.lit("")) == ""), "no_region": F.col("no_region") & (F.coalesce("mr", F.lit("")) == "")})
    return out.where("no_category or no_region").select(
        "entity_key", "source", "entity_id", F.when(F.coalesce("name", F.lit("")) == "", "SIN RAZÓN SOCIAL").otherwise(F.col("name")).alias("client_name"), "measure", "rows", "no_category", "no_region",
        F.coalesce("c", "mc", F.lit("")).alias("category"), F.coalesce("r", "mr", F.lit("")).alias("region"))


def audit_checks(summary: DataFrame, pending: DataFrame) -> DataFrame:
    """(check_id, passed, expected, actual) of a run's summary, as coverage gives it."""
    s = summary.join(F.broadcast(pending.agg(F.count("*").alias("reviews"))))  # one row
    cats = sum((F.col(f"category_{m.lower()}") for m in CATEGORY_METHODS[1:]), F.col("category_maestro"))
    regs = sum((F.col(f"region_{m.lower()}") for m in REGION_METHODS[1:]), F.col("region_exacto"))
    pcts = [F.col(c) for c in ("classified_pct", "raw_classified_pct", "valid_region_pct")]
    fine = pcts[0].between(0, 100) & pcts[1].between(0, 100) & pcts[2].between(0, 100)
    row = lambda i, ok, want, got: F.struct(F.lit(i).alias("check_id"), ok.alias("passed"), want.cast("string").alias("expected"), got.cast("string").alias("actual"))
    rows = F.col("rows")
    return s.select(F.inline(F.array(
        row("segment-balance", cats == rows, rows, cats), row("state-balance", regs == rows, rows, regs),
        row("percentage-range", fine, F.lit("0..100"), F.when(fine, "0..100").otherwise(F.concat_ws(", ", *pcts))), row("review-bound", F.col("reviews") <= rows, rows, F.col("reviews")))))


SNAPSHOT = "run_id string, file_name string, bytes long, rows long, classified_pct double, valid_region_pct double, unresolved_clients long, measure_unclassified double"


def manifest(summary: DataFrame, checks: DataFrame, **about) -> DataFrame:
    """One row with the run's manifest as JSON: aggregates only, no rows of the data."""
    held = F.lit(json.dumps(about, sort_keys=True))
    listed = checks.agg(F.sort_array(F.collect_list(F.struct("check_id", "passed", "expected", "actual"))).alias("checks"))
    return summary.join(F.broadcast(listed)).select(F.to_json(F.struct(F.lit(1).alias("schema_version"), held.alias("about"), F.struct(*[c for c in summary.columns]).alias("totals"), "checks")).alias("manifest"))


def read_snapshot(spark: SparkSession, text: str, limit: int = 2_000_000) -> DataFrame:
    """A snapshot from a manifest's JSON: version 1, all fields there and of their types."""
    if len(text.encode()) > limit:
        raise ValueError("the manifest is too large")
    data = json.loads(text)
    if not isinstance(data, dict) or data.get("schema_version") != 1:
        raise ValueError("not a manifest of version 1")
    values = {**json.loads(data.get("about", "{}")), **data.get("totals", {})}
    names = [f.strip().split(" ") for f in SNAPSHOT.split(",")]
    for name, kind in names:
        ok = isinstance(values.get(name), str) if kind == "string" else isinstance(values.get(name), (int, float)) and not isinstance(values.get(name), bool)
        if not ok:
            raise ValueError(f"the manifest has no valid {name}")
    cast = {"string": str, "long": int, "double": float}
    return spark.createDataFrame([tuple(cast[k](values[n]) for n, k in names)], SNAPSHOT)


def compare(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Differences of two snapshots, one row each."""
    c, p = current.alias("c"), previous.alias("p")
    delta = [(F.col(f"c.{x}") - F.col(f"p.{x}")).alias(f"{x}_delta") for x in ("rows", "classified_pct", "valid_region_pct", "unresolved_clients", "measure_unclassified")]
    same = (F.col("c.file_name") == F.col("p.file_name")) & (F.col("c.bytes") == F.col("p.bytes"))
    return c.join(F.broadcast(p)).select(F.col("p.run_id").alias("previous_run_id"), F.col("c.run_id").alias("current_run_id"), same.alias("same_source"), *delta)
