"""Structured Streaming into a graph's log: each micro-batch is one committed log part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trigraph.graph import Graph
from trigraph.operators.mutation import DELETE, PUT, REPLACE


def stream_triples(graph: Graph, stream: DataFrame, checkpoint: str, watermark: tuple[str, str] | None = None, **trigger) -> StreamingQuery:
    """Appends a stream of (s, p, o[, op]) to ``graph``.

    Puts are idempotent, so a batch that runs again after a failure changes nothing. With ``watermark`` (column,
    delay) repeated triples are dropped within the delay before they are written.
    """
    if watermark:
        stream = stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(["s", "p", "o"])
    op = F.when(F.col("op").isin(PUT, REPLACE, DELETE), F.col("op")).otherwise(PUT) if "op" in stream.columns else F.lit(PUT)
    rows = stream.select(op.alias("op"), "s", "p", "o").where("s is not null and p is not null and o is not null")

    def write(batch: DataFrame, _: int) -> None:
        graph._stored().append("edges", batch)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
