"""JSON bodies to rows of logs and metrics: single objects, arrays, and bulk requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.functions.analysis import document_terms
from stratalog.session import cut


def json_objects(bodies: DataFrame, body: str = "body") -> DataFrame:
    """One row an object: a body is an object or an array of objects; what is neither goes to ``error``.

    Result: the other columns, ``object`` (text of the object, null for a bad body) and ``error``.
    """
    parsed = F.expr(f"try_parse_json(`{body}`)")
    kind = F.expr("schema_of_variant(__v)")
    items = F.when(kind.startswith("ARRAY"), F.expr("transform(cast(__v as array<variant>), x -> to_json(x))")).when(
        kind.startswith("OBJECT"), F.array(F.expr("to_json(__v)"))
    )
    rest = [c for c in bodies.columns if c != body]
    out = bodies.withColumn("__v", parsed).select(*rest, F.explode_outer(items).alias("object"))
    return out.withColumn("error", F.when(F.col("object").isNull() | ~F.col("object").startswith("{"), F.lit("Invalid entry")))


def timestamp_of(value: Column) -> Column:
    """Milliseconds of a JSON number as a timestamp: whole numbers as they are, fractions cut, anything else null."""
    text = value.cast("string")
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?([eE][+]?[0-9]+)?$"), text.try_cast("double"))
    return F.timestamp_millis(F.floor(number).cast("bigint"))


def _raw() -> Column:
    """Members of ``object`` by name."""
    return F.expr("cast(try_parse_json(object) as map<string, variant>)")


def logs_of(objects: DataFrame, timestamp_key: str = "date", now: Column | None = None) -> DataFrame:
    """Log rows of objects (``object``): ts, fields and text.

    Only members that are texts become fields, and the text is their values joined by a space; the time
    is the number under ``timestamp_key`` in milliseconds, or the time of ingest where there is none.
    """
    raw = objects.filter(F.col("object").isNotNull()).withColumn("__m", _raw())
    rest = [c for c in objects.columns if c not in ("object", "error")]
    texts = F.expr(
        f"map_from_entries(transform(filter(map_entries(__m), e -> schema_of_variant(e.value) = 'STRING' and e.key <> '{timestamp_key}'), "
        "e -> struct(e.key as key, cast(e.value as string) as value)))"
    )
    stamp = F.expr(f"case when schema_of_variant(__m['{timestamp_key}']) <> 'STRING' then cast(__m['{timestamp_key}'] as string) end")
    out = raw.withColumn("fields", texts)
    return out.select(
        *rest, F.coalesce(timestamp_of(stamp), now if now is not None else F.current_timestamp()).alias("ts"),
        "fields", F.array_join(F.map_values("fields"), " ").alias("text"),
    )


def metrics_of(objects: DataFrame, timestamp_key: str = "date", labels_key: str = "labels") -> DataFrame:
    """Metric points of objects: every numeric member other than time and labels is a metric of its name.

    Objects without a numeric time are skipped, and so are members that are no numbers; labels are the
    members of ``labels_key`` that are texts.
    """
    raw = objects.filter(F.col("object").isNotNull()).withColumn("__m", _raw())
    stamp = F.expr(f"case when schema_of_variant(__m['{timestamp_key}']) <> 'STRING' then cast(__m['{timestamp_key}'] as string) end")
    labels = F.expr(
        f"map_from_entries(transform(filter(map_entries(cast(case when schema_of_variant(__m['{labels_key}']) like 'OBJECT%' then __m['{labels_key}'] end as map<string, variant>)), "
        "e -> schema_of_variant(e.value) = 'STRING'), e -> struct(e.key as key, cast(e.value as string) as value)))"
    )
    numbers = F.expr(
        f"filter(map_entries(__m), e -> e.key not in ('{timestamp_key}', '{labels_key}') and "
        "(schema_of_variant(e.value) in ('BIGINT', 'DOUBLE', 'FLOAT') or schema_of_variant(e.value) like 'DECIMAL%'))"
    )
    rest = [c for c in objects.columns if c not in ("object", "error")]
    empty = F.create_map().cast("map<string,string>")
    timed = raw.select(*rest, timestamp_of(stamp).alias("ts"), F.coalesce(labels, empty).alias("labels"), F.explode(numbers).alias("e"))
    return timed.filter("ts is not null").select(*rest, F.col("e.key").alias("name"), "labels", "ts", F.expr("cast(e.value as double)").alias("value"))


def bulk_pairs(lines: DataFrame, body: str = "body", line_no: str = "line_no") -> DataFrame:
    """Actions of bulk requests with their documents.

    ``lines``: request (an identifier), line_no and body, one JSON line a row; lines may end in a comma and
    stand in brackets. ``index`` and ``create`` take the next line as their document, ``update`` takes it and is
    ignored, ``delete`` stands alone and is not supported. Result: request, line_no, action, index_name, object, error.
    """
    clean = F.regexp_replace(F.trim(body), r"^\[\s*|[\s,\]]+$", "")
    parsed = lines.withColumn("object", clean).filter(F.length("object") > 0)
    action = F.regexp_extract("object", r'^\{\s*"(index|create|update|delete)"\s*:\s*\{', 1)
    # a request is one body and small, so its lines may come together
    order = Window.partitionBy("request").orderBy(line_no)
    paired = parsed.withColumns({"action": action, "__next": F.lead("object").over(order), "__then": F.lead(action).over(order)})
    actions = paired.filter(F.col("action") != "")
    document = F.when((F.col("action") != "delete") & (F.col("__then") == ""), F.col("__next"))
    error = F.when(F.col("action") == "delete", "delete is not supported").when(document.isNull(), "a document is missing")
    index = F.coalesce(*[F.get_json_object("object", f"$.{a}._index") for a in ("index", "create", "update", "delete")], F.lit("default"))
    return actions.select("request", line_no, "action", index.alias("index_name"), document.alias("__document"), error.alias("error")).withColumnRenamed("__document", "object")


def bulk_logs(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """Log rows of bulk requests: request, index_name, ts, fields, text, of index and create actions."""
    pairs = bulk_pairs(lines).filter(F.col("action").isin("index", "create") & F.col("error").isNull())
    return logs_of(pairs.select("request", "index_name", "object"), now=now)


def number_rows(logs: DataFrame, first: int = 0) -> tuple[DataFrame, int]:
    """Adds doc_id: numbers from ``first`` on without gaps, in the order of partitions; and the number of rows.

    The rows are kept first, so that a task that is run again gives them the same numbers. One number a partition
    comes to the driver and goes back by broadcast.
    """
    kept = cut(logs).withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright("__id", 33)
    sizes = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = [], first
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = kept.sparkSession.createDataFrame(starts, "__part bigint, __first bigint")
    numbered = kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    within = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn("doc_id", F.col("__first") + within).drop("__id", "__part", "__first"), at - first


def with_terms(logs: DataFrame) -> DataFrame:
    """Adds the stored terms of each document."""
    return logs.withColumn("terms", document_terms(F.col("text"), F.col("fields")))
