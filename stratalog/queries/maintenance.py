"""Queries of ingest, storage and windows, with SQL equivalents."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.api import Engine
from stratalog.plans import dsl
from stratalog.session import application_folder, table
from stratalog.sources import adapters, ingest, store
from stratalog.streaming import ingest as streaming


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def ingest_logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as JSON objects, read again as logs; only members that are texts become fields."""
    events = table(spark, d, "events")
    body = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), "event_type", "value", "props"))
    logs = ingest.logs_of(ingest.json_objects(events.select("event_id", body.alias("body"))))
    return _ntz(logs.select("event_id", "ts", F.col("fields")["event_type"].alias("event_type"), F.size("fields").alias("n_fields"), "text"), "ts")


def ingest_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Wide JSON objects, two metrics each, to points."""
    rows = table(spark, d, "orders")
    labels = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_orderkey").cast("int").alias("number"))
    body = F.to_json(F.struct(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("date"), labels.alias("labels"), F.col("o_totalprice").alias("price"), F.col("o_custkey").alias("customer"), F.lit("x").alias("note")))
    points = ingest.metrics_of(ingest.json_objects(rows.select(body.alias("body"))))
    return points.groupBy("name", F.col("labels")["status"].alias("status"), F.size("labels").alias("n_labels")).agg(
        F.count(F.lit(1)).alias("points"), F.round(F.sum("value"), 2).alias("total"), F.min("ts").cast("timestamp_ntz").alias("first")
    )


def ingest_array(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are arrays of objects: one row an object."""
    events = table(spark, d, "events")
    item = F.to_json(F.struct("event_type", F.col("event_id").cast("string").alias("id")))
    bodies = events.groupBy("user_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list(item), ","), F.lit("]")).alias("body"))
    logs = ingest.logs_of(ingest.json_objects(bodies), now=F.timestamp_millis(F.lit(0)))
    return logs.select("user_id", F.col("fields")["id"].cast("bigint").alias("event_id"), F.unix_millis("ts").alias("ms"))


def bulk_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Action and document lines of one request a user; errors delete and the rest make documents."""
    events = table(spark, d, "events")
    verb = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "update").when(F.col("event_type") == "click", "create").otherwise("index")
    action = F.concat(F.lit('{"'), verb, F.lit('": {"_index": "'), F.col("event_type"), F.lit('"}}'))
    document = F.concat(F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), "props")), F.lit(","))
    lines = events.select(F.col("user_id").alias("request"), F.posexplode(F.when(verb == "delete", F.array(action)).otherwise(F.array(action, document))).alias("i", "body"), "event_id")
    lines = lines.select("request", (F.col("event_id") * 2 + F.col("i")).alias("line_no"), "body")
    logs = ingest.bulk_logs(lines, now=F.timestamp_millis(F.lit(0)))
    return logs.select("request", "index_name", F.col("fields")["id"].cast("bigint").alias("event_id"))


def _catalog(spark: SparkSession) -> store.Catalog:
    """Indices of an application in the checkpoint folder; they go when its driver ends."""
    return store.Catalog(spark, f"{application_folder(spark)}/indices-{uuid.uuid4().hex}")


def _engine(spark: SparkSession, d: str, parts: int = 1) -> Engine:
    """An engine whose index ``events`` holds the events, appended in parts."""
    engine = Engine(spark, _catalog(spark).root)
    logs = adapters.logs_from_events(table(spark, d, "events"))
    for k in range(parts):
        engine.catalog.append_logs("events", logs.filter(F.pmod("doc_id", F.lit(parts)) == k))
    return engine


def _metrics_engine(spark: SparkSession, d: str) -> Engine:
    engine = Engine(spark, _catalog(spark).root)
    rows = table(spark, d, "events").filter("value is not null")
    body = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.struct("event_type", F.col("user_id").cast("string").alias("user_id")).alias("labels"), F.col("value").alias("event_value")))
    engine.append_metric("events", rows.select(body.alias("body")))
    return engine


def retention_filter(spark: SparkSession, d: str) -> DataFrame:
    """What a retention of ten days leaves in an index on 31 January."""
    engine = _engine(spark, d)
    engine.apply_retention("events", 10, dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc))
    return engine.catalog.logs("events").select("doc_id")


def retention_days(spark: SparkSession, d: str) -> DataFrame:
    """The folders that a retention of ten days removes."""
    gone = _engine(spark, d).apply_retention("events", 10, dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc))
    return spark.createDataFrame([(x,) for x in gone], "folder string")


def append_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of two appends: without gaps, those of the second after those of the first."""
    engine = Engine(spark, _catalog(spark).root)
    events = table(spark, d, "events")
    body = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_id").cast("string").alias("id")))
    for k in range(2):
        engine.append_log("events", events.filter(F.col("event_id") % 2 == k).select(body.alias("body")))
    found = engine.catalog.logs("events")
    return found.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"),
        F.max(F.when(F.col("fields")["id"].cast("bigint") % 2 == 0, F.col("doc_id"))).alias("last_of_first"),
    )


def append_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Points as an index holds them after they were appended as JSON."""
    found = _metrics_engine(spark, d).catalog.metrics("events")
    return _ntz(found.select("name", F.col("labels")["event_type"].alias("event_type"), F.col("labels")["user_id"].alias("user_id"), "ts", "value"), "ts")


def compact_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Series of an index after its files were merged."""
    engine = _metrics_engine(spark, d)
    engine.compact("events")
    return engine.catalog.metrics("events").groupBy(F.col("labels")["event_type"].alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


def index_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Indices that are there after some were made, filled and removed."""
    engine = Engine(spark, _catalog(spark).root)
    for name in ("default", "a", "b"):
        engine.create_index(name)
    engine.catalog.append_logs("c", adapters.logs_from_events(table(spark, d, "events")))
    engine.flush("c")
    engine.delete_index("b")
    return spark.createDataFrame([(n,) for n in engine.catalog.indices()], "name string")


def metric_search(spark: SparkSession, d: str) -> DataFrame:
    """Series of a stored index, the newest first, with their place in that order."""
    vector = _metrics_engine(spark, d).search_metrics("events", 'event_value{event_type="purchase"}', eval_ts=dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc))
    rows = vector.groupBy("label_key").agg(F.max("ts").alias("latest"), F.count(F.lit(1)).alias("points"))
    return _ntz(rows, "latest")


def metric_answer(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a metric query as its envelope shows it."""
    answer = _metrics_engine(spark, d).metric_answer("events", "sum by (event_type) (event_value)", eval_ts=dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc))
    rows = [(answer["status"], answer["data"]["resultType"], x["metric"]["event_type"], x["value"][0], round(float(x["value"][1]), 6)) for x in answer["data"]["result"]]
    return spark.createDataFrame(rows, "status string, kind string, event_type string, seconds bigint, total double")


def hits_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a search with a time limit, as its envelope shows it."""
    answer = _engine(spark, d).answer("events", {"query": {"term": {"event_type": "signup"}}, "timeout": "600s"})
    return answer.select("timed_out", "total", "relation", F.col("_id").alias("id"), F.col("_score").alias("score"), F.col("timestamp").alias("ms"), "text", F.col("fields")["user_id"].alias("user_id"))


def engine_aggregations(spark: SparkSession, d: str) -> DataFrame:
    """An aggregation section with buckets inside buckets and a pipeline beside them."""
    out = _engine(spark, d).aggregate(
        "events",
        {
            "query": {"terms": {"event_type": ["click", "view", "purchase"]}},
            "aggs": {
                "kinds": {"terms": {"field": "event_type"}, "aggs": {"days": {"date_histogram": {"calendar_interval": "week"}, "aggs": {"mean": {"avg": {"field": "value"}}}}}},
                "every": {"sum_bucket": {"buckets_path": "kinds>_count"}},
            },
        },
    )
    every = out["every"].first()[0]
    weeks = out["kinds"].select(F.col("key").alias("event_type"), F.col("doc_count").alias("in_kind"), F.explode("days").alias("w"))
    return _ntz(weeks.select("event_type", "in_kind", F.col("w.key").alias("week"), F.col("w.doc_count").alias("in_week"), F.round("w.mean", 6).alias("mean"), F.lit(every).alias("every")), "week")


def summary_newest(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the newest ten hits of a summary."""
    found = _engine(spark, d).summarize("events", "purchase", 10, lambda texts: str(len(texts)))
    return spark.createDataFrame([(found["summary"], x) for x in found["hits"]], "summary string, text string")


def engine_status(spark: SparkSession, d: str) -> DataFrame:
    """The answer of a ping, and the last name of the folder of an index."""
    engine = Engine(spark, _catalog(spark).root)
    return spark.createDataFrame([(engine.ping(), engine.get_index_dir("events").rsplit("/", 1)[-1])], "answer string, folder string")


def _streamed(spark: SparkSession, d: str, again: bool) -> DataFrame:
    """Events through files and a stream into an index; ``again`` runs the last batch a second time, as after a crash before its commit."""
    catalog = _catalog(spark)
    events = table(spark, d, "events")
    body = F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("date"), F.col("event_id").cast("string").alias("id"), "event_type"))
    lines = events.select(body.alias("value"))
    lines.write.text(f"{catalog.root}-lines")
    source = streaming.json_stream(spark, f"{catalog.root}-lines", 1)
    for _ in range(2 if again else 1):
        query = streaming.stream_logs(catalog, "events", source, f"{catalog.root}-checkpoint")
        query.awaitTermination()
        if again:
            home = spark._jvm.org.apache.hadoop.fs.Path(f"{catalog.root}-checkpoint/commits")
            fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
            last = max((s.getPath() for s in fs.listStatus(home) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
            fs.delete(last, False)
            again = False
    return catalog.logs("events").select(F.col("fields")["id"].cast("bigint").alias("event_id"), F.col("fields")["event_type"].alias("event_type"), F.unix_millis("ts").alias("ms"))


def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """What an index holds after a stream was run, its last commit was lost, and it was run again: every document once."""
    return _streamed(spark, d, True)


def postings_search(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a search for terms, over an index of several batches and days whose postings tell where they are."""
    return _engine(spark, d, 3).search_logs("events", {"query": {"bool": {"must": [{"term": {"event_type": "purchase"}}, {"term": {"user_id": "7"}}]}}}).select("doc_id")


def segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    segments = table(spark, d, "segments")
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-02-20 00:00:00", "2024-02-25 00:00:00"))
    return segments.filter(store.overlaps(F.col("start_time"), F.col("end_time"), low, high)).select("segment_no")


def merge_choice(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "segments").select(F.col("segment_no").alias("segment"), "end_time", (F.col("log_message_count") / 100.0).alias("size_mb"))
    return store.segments_to_merge(sizes, 150).select("segment")


def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Logs are appended in two parts, some deleted, and the index is compacted; what it holds then."""
    catalog = _catalog(spark)
    logs = adapters.logs_from_events(table(spark, d, "events"))
    catalog.create("events")
    catalog.append_logs("events", logs.filter("doc_id % 2 = 0"))
    catalog.append_logs("events", logs.filter("doc_id % 2 = 1"))
    catalog.delete("events", dsl.Compiler(terms="terms").compile({"term": {"event_type": "error"}}))
    catalog.compact("events")
    kept = catalog.logs("events", "2024-01-02 00:00:00", "2024-01-20 00:00:00")
    return kept.filter(dsl.Compiler(terms="terms").compile({"bool": {"should": [{"term": {"event_type": "click"}}, {"match": {"text": "view"}}]}})).select("doc_id")


def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.windowed_counts(adapters.logs_from_events(table(spark, d, "events")), "6 hours", key="event_type")
    return _ntz(out, "window_start", "window_end")


def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.windowed_counts(adapters.logs_from_events(table(spark, d, "events")), "2 days", "1 day")
    return _ntz(out, "window_start", "window_end")


def window_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = streaming.sessions(adapters.logs_from_events(table(spark, d, "events")), "user_id", "12 hours")
    return _ntz(out, "session_start", "session_end")


QUERIES = {
    f.__name__: f
    for f in (ingest_logs, ingest_metrics, ingest_array, bulk_ingest, retention_filter, retention_days, append_ids, append_metrics, compact_metrics, index_lifecycle, metric_search, metric_answer, hits_envelope, engine_aggregations, summary_newest, engine_status, wal_replay, postings_search, segment_overlap, merge_choice, store_roundtrip, window_tumbling, window_sliding, window_sessions)
}

ORACLES = {
    "ingest_logs": "select event_id, date_trunc('millisecond', ts)::timestamp as ts, event_type, 2 as n_fields, event_type || ' ' || props as text from events",
    "ingest_metrics": """
with p as (
  select 'price' as name, o_orderstatus as status, o_totalprice::double as value, o_orderdate from orders
  union all select 'customer', o_orderstatus, o_custkey::double, o_orderdate from orders)
select name, status, 1 as n_labels, count(*) as points, round(sum(value), 2) as total, min(o_orderdate)::timestamp as first from p group by name, status""",
    "ingest_array": "select user_id, event_id, 0::bigint as ms from events",
    "bulk_ingest": "select user_id as request, event_type as index_name, event_id from events where event_type not in ('error', 'view')",
    "retention_filter": "select event_id as doc_id from events where ts >= timestamp '2024-01-21'",
    "retention_days": "select distinct 'logs/dt=' || ts::date::varchar as folder from events where ts < timestamp '2024-01-21'",
    "append_ids": "select count(*) as n, count(*) as ids, 0::bigint as lowest, count(*) - 1 as highest, count(*) filter (event_id % 2 = 0) - 1 as last_of_first from events",
    "append_metrics": "select 'event_value' as name, event_type, user_id::varchar as user_id, date_trunc('millisecond', ts)::timestamp as ts, value::double as value from events where value is not null",
    "compact_metrics": "select event_type, count(*) as n, round(sum(value::double), 6) as total from events where value is not null group by event_type",
    "index_lifecycle": "select unnest(['a', 'c', 'default']) as name",
    "metric_search": "select 'event_type=' || event_type || ',user_id=' || user_id as label_key, date_trunc('millisecond', max(ts))::timestamp as latest, count(*) as points from events where value is not null and event_type = 'purchase' group by 1",
    "metric_answer": "select 'success' as status, 'vector' as kind, event_type, epoch(timestamp '2024-01-31')::bigint as seconds, round(sum(value::double), 6) as total from events where value is not null group by event_type",
    "hits_envelope": "select false as timed_out, count(*) over () as total, 'eq' as relation, event_id as id, 1.0::double as score, epoch_us(ts) // 1000 as ms, concat_ws(' ', event_type, props) as text, user_id::varchar as user_id from events where event_type = 'signup'",
    "engine_aggregations": """
with e as (select * from events where event_type in ('click', 'view', 'purchase')),
k as (select event_type, count(*) as in_kind from e group by event_type)
select event_type, any_value(in_kind) as in_kind, date_trunc('week', ts)::timestamp as week, count(*) as in_week, round(avg(value::double), 6) as mean, (select count(*) from e)::double as every
from e join k using (event_type) group by event_type, date_trunc('week', ts)""",
    "summary_newest": "select '10' as summary, text from (select concat_ws(' ', event_type, props) as text from events where event_type = 'purchase' order by ts desc, event_id limit 10)",
    "engine_status": "select 'OK' as answer, 'events' as folder",
    "wal_replay": "select event_id, event_type, epoch_us(ts) // 1000 as ms from events",
    "postings_search": "select event_id as doc_id from events where event_type = 'purchase' and user_id = 7",
    "segment_overlap": "select segment_no from segments where end_time >= timestamp '2024-02-20' and start_time <= timestamp '2024-02-25'",
    "merge_choice": "select segment_no as segment from (select segment_no, sum(log_message_count / 100.0) over (order by end_time, segment_no) as total from segments) where total <= 150",
    "store_roundtrip": "select event_id as doc_id from events where event_type in ('click', 'view') and ts between timestamp '2024-01-02' and timestamp '2024-01-20'",
    "window_tumbling": "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as window_start, time_bucket(interval 6 hours, ts, timestamp '1970-01-01') + interval 6 hours as window_end, event_type, count(*) as count from events group by all",
    "window_sliding": "select w as window_start, w + interval 2 days as window_end, count(*) as count from (select unnest([date_trunc('day', ts)::timestamp, date_trunc('day', ts)::timestamp - interval 1 day]) as w from events) group by w",
    "window_sessions": """
with l as (select user_id::varchar as user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as before from events),
s as (select *, sum(case when before is null or ts >= before + interval 12 hours then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as n from l)
select user_id, min(ts) as session_start, max(ts) + interval 12 hours as session_end, count(*) as count from s group by user_id, n""",
}
