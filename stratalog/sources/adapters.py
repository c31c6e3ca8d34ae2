"""Views of the test tables as logs and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def logs_from_events(events: DataFrame) -> DataFrame:
    """One log a row: event_type, user_id and the member k of props as fields."""
    fields = F.create_map(
        F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"),
        F.lit("k"), F.get_json_object("props", "$.k"), F.lit("value"), F.col("value").cast("string"),
    )
    return events.select(
        F.lit("events").alias("index"), F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"), F.concat_ws(" ", "event_type", "props").alias("text"),
    )


def logs_from_documents(documents: DataFrame) -> DataFrame:
    """One log a post: author, lang, source and n_chars as fields."""
    fields = F.create_map(
        F.lit("author"), F.col("author"), F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string")
    )
    return documents.select(
        F.lit("documents").alias("index"), "doc_id", F.col("posted_at").cast("timestamp").alias("ts"),
        F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"), "text",
    )


def logs_from_messages(messages: DataFrame) -> DataFrame:
    """The table of log lines; copies of a line stay."""
    return messages.select(
        F.col("index_name").alias("index"), F.col("log_message_id").alias("doc_id"), F.col("time").cast("timestamp").alias("ts"), "fields", "text"
    )


def logs_from_access(access: DataFrame) -> DataFrame:
    """Entries of an access log: all columns but the date as fields, and joined as text."""
    names = ("ip", "request", "status_code", "response_size", "referrer", "user_agent")
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return access.select(
        F.lit("access").alias("index"), F.col("entry_id").alias("doc_id"), F.col("date").cast("timestamp").alias("ts"),
        F.map_filter(fields, lambda _, v: v.isNotNull()).alias("fields"), F.concat_ws(" ", *names).alias("text"),
    )


def metrics_from_events(events: DataFrame) -> DataFrame:
    """The metric event_value with labels event_type and user_id."""
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"))
    return events.select(F.lit("event_value").alias("name"), labels.alias("labels"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def metrics_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """The metric price with labels returnflag and linestatus."""
    labels = F.create_map(F.lit("returnflag"), F.col("l_returnflag"), F.lit("linestatus"), F.col("l_linestatus"))
    return lineitem.select(F.lit("price").alias("name"), labels.alias("labels"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.col("l_extendedprice").cast("double").alias("value"))


def metrics_from_wal(wal: DataFrame) -> DataFrame:
    """Appended readings; a reading that was sent again stays twice."""
    return wal.select(F.col("metric_name").alias("name"), F.col("name_value_labels").alias("labels"), F.col("time").cast("timestamp").alias("ts"), "value")


def metrics_from_series(stretches: DataFrame) -> DataFrame:
    """Points of stored series; the name is the label ``__name__``."""
    points = stretches.select("labels", F.explode("metric_points").alias("p"))
    return points.select(
        F.col("labels")["__name__"].alias("name"), F.map_filter("labels", lambda k, _: k != "__name__").alias("labels"),
        F.col("p.time").cast("timestamp").alias("ts"), F.col("p.value").alias("value"),
    )
