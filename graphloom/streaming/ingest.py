"""Structured Streaming: trace counts and graph replacement as data arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from graphloom.sources.store import replace_in_store


def new_spans(spans: DataFrame, late: str = "2 days") -> DataFrame:
    """(service, started_at) of each span of a stream (or a table), once.

    ``spans`` has span_id, trace_file, service, started_at. The state holds the spans of the
    last ``late``; a span sent again within that time counts once.
    """
    rows = spans.where("span_id is not null").withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", late)
    return rows.dropDuplicatesWithinWatermark(["trace_file", "span_id", "started_at"]).select("service", "started_at")


def span_counts(rows: DataFrame, window: str = "1 hour") -> DataFrame:
    """(service, window, spans): spans per service and window of event time, of ``new_spans`` or of sums kept before."""
    return rows.groupBy(F.window("started_at", window), "service").agg(F.count("*").alias("spans"))


def counts_on_arrival(root: str, window: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink for ``new_spans``: each batch's counts under its number, so that a replay overwrites them."""

    def sink(batch: DataFrame, number: int) -> None:
        span_counts(batch, window).write.mode("overwrite").parquet(f"{root}/batch={number}")

    return sink


def kept_counts(counts: DataFrame) -> DataFrame:
    """The sums over all batches that ``counts_on_arrival`` wrote."""
    return counts.groupBy("service", "window").agg(F.sum("spans").alias("spans"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(user_id, session, events): session windows of an event stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("session"), "user_id").agg(F.count("*").alias("events"))


def replace_on_arrival(root: str, parse: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: files (repo, path, text) of a batch replace what they owned in the stored graph.

    Replaying a batch gives the same state, so a restart after a failure is safe.
    """

    def sink(batch: DataFrame, _: int) -> None:
        files = batch.persist()
        try:
            new_nodes, new_edges = parse(files)
            replace_in_store(files.sparkSession, root, files, new_nodes, new_edges)
        finally:
            files.unpersist()

    return sink
