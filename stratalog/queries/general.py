"""Queries of the general data preparation operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import drift, grid, loglines, skew, spikes
from stratalog.session import cut, table


def _metric_keys(spark: SparkSession, d: str) -> tuple:
    wal = table(spark, d, "metric_wal")
    keys = {"metric_name": F.col("metric_name"), "instance": F.col("name_value_labels")["instance"]}
    return wal, keys, F.col("time"), F.col("entry_id")


def _service_keys(spark: SparkSession, d: str) -> tuple:
    logs = table(spark, d, "log_messages")
    return logs, {"service": F.col("fields")["service"]}, F.col("time"), F.col("log_message_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.dominant_keys(*_metric_keys(spark, d)).unionByName(skew.dominant_keys(*_service_keys(spark, d)))


def p1_key_stats(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_statistics(*_metric_keys(spark, d)).unionByName(skew.key_statistics(*_service_keys(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).filter("readings = 0").select("series_key", "period_start")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "query_time_series"), table(spark, d, "scrape_config"))


def p3_periods(spark: SparkSession, d: str) -> DataFrame:
    return p3_grid(spark, d).select("series_key", "period_start", "readings")


def p4_flags(spark: SparkSession, d: str) -> DataFrame:
    return spikes.implausible_readings(table(spark, d, "metric_wal"), table(spark, d, "metric_catalog"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).select("entry_id").distinct()


def p4_impossible(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).filter("kind = 'impossible'").select("entry_id")


def p4_stuck(spark: SparkSession, d: str) -> DataFrame:
    return p4_flags(spark, d).filter("kind = 'stuck'").select("entry_id")


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    wal = drift.schema_profiles(table(spark, d, "log_wal"), "log_wal", "stream", "file_no", "entry", True)
    return wal.unionByName(drift.schema_profiles(table(spark, d, "log_messages"), "log_messages", "stream", "file_no", "fields", False))


def p6_changes(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(_profiles(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.field_changes(p6_changes(spark, d))


def p6_steps(spark: SparkSession, d: str) -> DataFrame:
    """The changes with every rename as the removal and the addition it is made of."""
    found = cut(p6_found(spark, d))
    parts = found.filter("change <> 'renamed'").unionByName(found.filter("change = 'renamed'").withColumns({"change": F.lit("removed"), "new_field": F.col("field")}))
    parts = parts.unionByName(found.filter("change = 'renamed'").withColumns({"change": F.lit("added"), "field": F.col("new_field")}))
    return parts.select("stream", "file_no", "change", "field").distinct()


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Both tables under the final places, names and types of their fields; what is no record in log_wal has null fields."""
    changes = cut(p6_changes(spark, d))
    columns = ["origin", "row_id", "stream", "file_no", "line_no", "consistent", "unfit"]
    logs = table(spark, d, "log_messages").select(F.lit("log_messages").alias("origin"), F.col("log_message_id").alias("row_id"), "stream", "file_no", "line_no", "fields")
    wal = table(spark, d, "log_wal").select(F.lit("log_wal").alias("origin"), F.col("wal_id").alias("row_id"), "stream", "file_no", "line_no", "entry")
    one = lambda df, origin: drift.consistent_table(df, origin, F.col("fields"), changes).select(columns)
    return one(logs, "log_messages").unionByName(one(drift.flat_records(wal, "entry"), "log_wal"))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows, records and records with fields by stream: none is lost on the way to the consistent table."""
    return p6_consistent(spark, d).groupBy("origin", "stream", "file_no").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("consistent").alias("n_records"), F.count_if(F.size("consistent") > 0).alias("n_filled")
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return loglines.log_entries(table(spark, d, "log_messages"), table(spark, d, "apache_log_entries"))


def p7_templates(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "log_messages").filter("text is not null").select("text")
    return loglines.line_templates(lines, "text", loglines.learn_layouts(lines))


def p7_entries(spark: SparkSession, d: str) -> DataFrame:
    return loglines.log_entries(table(spark, d, "log_messages"), table(spark, d, "apache_log_entries"), with_text=True)


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_key_stats, p3_found, p3_grid, p3_periods, p4_found, p4_flags, p4_impossible, p4_stuck, p6_found, p6_changes, p6_steps, p6_consistent, p6_kept, p7_found, p7_templates, p7_entries)
}

_KEYS = """
with k as (
  select 'metric_name' as key_kind, metric_name as key_value, time from metric_wal
  union all select 'instance', name_value_labels['instance'], time from metric_wal
  union all select 'service', fields['service'], time from log_messages),
s as (
  select key_kind, key_value, count(*) as "rows", min(time) as first_time, max(time) as last_time
  from k where key_value is not null group by key_kind, key_value)
"""

_PERIODS = """
with c as (select job, any_value(interval_s)::bigint as s from scrape_config where interval_s > 0 group by job),
p as (
  select array_to_string(list_sort(list_transform(map_entries(labels), lambda e: e.key || '=' || coalesce(e.value, ''))), ',') as series_key,
         labels['job'] as job, unnest(metric_points) as p
  from query_time_series),
r as (
  select series_key, s, (epoch_us(p.time) // (s * 1000000))::bigint as k, epoch_us(p.time) as t
  from p join c using (job) where p.time is not null and p.value is not null and not isnan(p.value)),
n as (select series_key, k, count(distinct t) as readings from r group by series_key, k),
g as (select series_key, any_value(s) as s, unnest(generate_series(min(k), max(k))) as k from r group by series_key)
"""

_RECORDS = """
with r as (
  select 'log_wal' as origin, stream, file_no, case when json_type(entry, '$.Log') = 'OBJECT' then coalesce(case when json_type(entry, '$.Log.fields') = 'OBJECT' then json_extract(entry, '$.Log.fields') end, '{}'::json) end as fields
  from (select stream, file_no, case when json_valid(entry) then entry end as entry from log_wal)
  union all
  select 'log_messages', stream, file_no, case when fields is not null then to_json(fields) end from log_messages)
"""
_FIELDS = (
    _RECORDS
    + """, k as (
  select origin, stream, file_no, k, json_extract(fields, '$."' || k || '"') as v
  from (select origin, stream, file_no, fields, unnest(json_keys(fields)) as k from r where fields is not null)),
t as (
  select origin, stream, file_no, k,
         case json_type(v) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'HUGEINT' then 'integer' when 'DOUBLE' then 'decimal'
                           when 'VARCHAR' then 'text' when 'BOOLEAN' then 'boolean' when 'OBJECT' then 'object' when 'ARRAY' then 'array' end as type
  from k),
n as (select origin, stream, file_no, count(*) as n from r where fields is not null group by all),
p as (select origin, stream, file_no, lead(file_no) over (partition by origin, stream order by file_no) as later from n),
c as (select origin, stream, file_no, k, type, count(*) as m from t group by origin, stream, file_no, k, type),
e as (select origin, stream, file_no, k, sum(m) as every, arg_max(type, (m, type)) filter (type is not null) as type from c group by origin, stream, file_no, k),
f as (select e.* from e join n using (origin, stream, file_no) where e.every * 20 >= n.n)
"""
)

ORACLES = {
    "p6_kept": _RECORDS
    + """select origin, stream, file_no, count(*)::bigint as n_rows, count(fields)::bigint as n_records, count(*) filter (fields is not null and len(json_keys(fields)) > 0)::bigint as n_filled
from r group by origin, stream, file_no""",
    "p6_steps": _FIELDS
    + """select distinct stream, file_no, change, field from (
  select p.stream, p.later as file_no, 'removed' as change, f.k as field from f join p using (origin, stream, file_no) where p.later is not null
    and not exists (select 1 from f g where g.origin = p.origin and g.stream = p.stream and g.file_no = p.later and g.k = f.k)
  union all
  select p.stream, p.later, 'added', g.k from f g join p on g.origin = p.origin and g.stream = p.stream and g.file_no = p.later
    where not exists (select 1 from f where f.origin = p.origin and f.stream = p.stream and f.file_no = p.file_no and f.k = g.k)
  union all
  select p.stream, p.later, 'retyped', f.k from f join p using (origin, stream, file_no)
    join f g on g.origin = p.origin and g.stream = p.stream and g.file_no = p.later and g.k = f.k where f.type <> g.type)""",
    "p1_found": _KEYS
    + """select key_kind, key_value from s
where "rows" * 100 >= 8 * (select count(*) from metric_wal) and key_kind <> 'service'
   or "rows" * 100 >= 8 * (select count(*) from log_messages) and key_kind = 'service'""",
    "p1_key_stats": _KEYS + 'select key_kind, key_value, "rows", first_time, last_time from s',
    "p3_found": _PERIODS + "select series_key, k * s as period_start from g anti join n using (series_key, k)",
    "p3_periods": _PERIODS
    + "select g.series_key, g.k * s as period_start, coalesce(n.readings, 0)::bigint as readings from g left join n using (series_key, k)",
    "p4_stuck": """
with l as (select metric_name, min_value, max_value from metric_catalog),
b as (
  select w.entry_id, w.time, w.value, isnan(value) or isinf(value) or coalesce(value < min_value, false) or coalesce(value > max_value, false) as bad,
         coalesce(w.metric_name, '?') || '|' || coalesce(array_to_string(list_sort(list_transform(map_entries(name_value_labels), lambda e: e.key || '=' || coalesce(e.value, ''))), ','), '') as source
  from metric_wal w left join l using (metric_name) where value is not null and time is not null),
r as (select source, time, arg_min(value, entry_id) as v from b group by source, time having not bool_or(bad)),
c as (select *, coalesce((v <> lag(v) over w)::int, 0) as change, lag(v) over w is not null as paired from r window w as (partition by source order by time)),
g as (select *, sum(change) over (partition by source order by time rows unbounded preceding) as run from c),
n as (select *, count(*) over (partition by source, run) as size from g),
p as (select *, size < 10 and coalesce(lag(size) over (partition by source order by time), 10) < 10 as free from n),
s as (select source from p group by source having count(*) filter (free) >= 5 and 2 * sum(change) filter (free) > count(*) filter (free))
select b.entry_id from n join s using (source) join b on b.source = n.source and b.time = n.time where n.size >= 10""",
    "p4_impossible": """
with l as (select metric_name, min_value, max_value from metric_catalog),
b as (
  select w.*, isnan(value) or isinf(value) or coalesce(value < min_value, false) or coalesce(value > max_value, false) as bad,
         array_to_string(list_sort(list_transform(map_entries(name_value_labels), lambda e: e.key || '=' || coalesce(e.value, ''))), ',') as labels
  from metric_wal w left join l using (metric_name) where value is not null and time is not null)
select a.entry_id from b a where exists (
  select 1 from b where b.bad and b.metric_name is not distinct from a.metric_name and b.labels = a.labels and b.time = a.time)""",
}
