"""Row resolution over a stream of files: stateless, against a fixed configuration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import entity
from ..operators.catalog import Config
from ..operators.resolve import resolve


def resolve_stream(rows: DataFrame, config: Config, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Resolves each micro-batch of the rows and hands it to the sink with its number; the sink must
    be idempotent by that number. The master is rebuilt from what the sink keeps."""

    def one(batch: DataFrame, number: int) -> None:
        named = entity.with_entity(entity.with_fields(batch), config)
        sink(entity.patch_alias_region(resolve(named, config)), number)

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
