"""Canonical schemas and the label key.

Spark can group by a map but cannot join, compare or sort one, so every operator that
needs the identity of a label set uses ``label_key``: ``name=value`` of all labels,
sorted by name and joined by commas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGS = T.StructType(
    [
        T.StructField("index", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
    ]
)
METRICS = T.StructType(
    [
        T.StructField("index", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
        T.StructField("ts", T.TimestampType()),
        T.StructField("value", T.DoubleType()),
    ]
)
TOMBSTONES = T.StructType([T.StructField("index", T.StringType()), T.StructField("doc_id", T.LongType())])


def label_key(labels: Column) -> Column:
    """``a=1,b=2`` of a label map, whatever the order of its entries; '' for an empty or null map."""
    entries = F.array_sort(F.map_entries(labels))
    parts = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(parts, ","), F.lit(""))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(ts.cast("timestamp"))
