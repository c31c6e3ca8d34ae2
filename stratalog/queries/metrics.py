"""Queries of metric expressions, with SQL equivalents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans import metrics
from stratalog.plans.metrics import MetricEngine
from stratalog.session import table
from stratalog.sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: a fixed evaluation time, so that results don't depend on the clock
NOW = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)
_NOW = "timestamp '2024-01-31 00:00:00'"
_EVENTS = """m as (
  select 'event_type=' || event_type || ',user_id=' || user_id as label_key, event_type, user_id::varchar as user_id, ts, value::double as value
  from events where value is not null)"""
_WAL = """m as (
  select metric_name as name, name_value_labels as labels, time as ts, value,
         array_to_string(list_sort(list_transform(map_entries(name_value_labels), lambda e: e.key || '=' || coalesce(e.value, ''))), ',') as label_key
  from metric_wal where value is not null)"""


def _events(spark: SparkSession, d: str, **more: object) -> MetricEngine:
    return MetricEngine(adapters.metrics_from_events(table(spark, d, "events")), NOW, **more)


def _wal(spark: SparkSession, d: str, **more: object) -> MetricEngine:
    return MetricEngine(adapters.metrics_from_wal(table(spark, d, "metric_wal")), NOW, **more)


def shown(vector: DataFrame) -> DataFrame:
    """A vector without its label map, times without a zone and values to seven places."""
    return vector.select("label_key", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("value", 7).alias("value"))


def _query(name: str, expression: str, sql: str | None, engine: Callable[..., MetricEngine] = _events, base: str = _EVENTS, **more: object) -> None:
    QUERIES[name] = lambda spark, d: shown(engine(spark, d, **more).query(expression))
    if sql is not None:
        ORACLES[name] = f"with {base} {sql}" if sql.startswith(("select", ",")) else sql  # ready made


def _each(name: str, expression: str, value: str, where: str = "true", **more: object) -> None:
    """An expression that keeps the points and changes their values."""
    _query(name, expression, f"select label_key, ts, round({value}, 7) as value from m where {where}", **more)


def _series(name: str, expression: str, value: str, ts: str = _NOW, where: str = "true", **more: object) -> None:
    """An expression that gives one point a series."""
    _query(name, expression, f"select label_key, {ts} as ts, round({value}, 7) as value from m where {where} group by label_key", **more)


def _whole(name: str, expression: str, value: str, where: str = "true") -> None:
    """An aggregation over all points."""
    _query(name, expression, f"select '' as label_key, {_NOW} as ts, round({value}, 7) as value from m where {where}")


V = "event_value"

# selectors
_each("pq_selector", f'{V}{{event_type="purchase"}}', "value", "event_type = 'purchase'")
_each("pq_not_equal", f'{V}{{event_type!="purchase"}}', "value", "event_type <> 'purchase'")
_each("pq_regex", f'{V}{{event_type=~"p.*|err.."}}', "value", "regexp_full_match(event_type, 'p.*|err..')")
_each("pq_not_regex", f'{V}{{event_type!~"p.*|click",user_id!=""}}', "value", "not regexp_full_match(event_type, 'p.*|click')")
_each("pq_name_matcher", '{__name__="event_value",user_id="3"}', "value", "user_id = '3'")
_each("pq_missing_label", f'{V}{{nothing=""}}', "value")
_each("pq_range", f"{V}[7d]", "value", f"ts > {_NOW} - interval 7 days and ts <= {_NOW}")
_query("pq_offset", f"{V}[3d] offset 2d", f"select label_key, ts + interval 2 days as ts, round(value, 7) as value from m where ts + interval 2 days > {_NOW} - interval 3 days and ts + interval 2 days <= {_NOW}")
_each("pq_at", f"{V} @ 1704844800", "value", "ts <= timestamp '2024-01-10 00:00:00'")
_query("pq_time_range", V, "select label_key, ts, round(value, 7) as value from m where ts between timestamp '2024-01-03' and timestamp '2024-01-04'",
       start=dt.datetime(2024, 1, 3, tzinfo=dt.timezone.utc), end=dt.datetime(2024, 1, 4, tzinfo=dt.timezone.utc))
_query("pq_wal_selector", 'cpu_usage_percent{job="storage",shard=~"[01]"}',
       "select label_key, ts, round(value, 7) as value from m where name = 'cpu_usage_percent' and labels['job'] = 'storage' and labels['shard'] in ('0', '1')", _wal, _WAL)

# aggregations
for _op, _sql in {"sum": "sum(value)", "min": "min(value)", "max": "max(value)", "avg": "avg(value)", "count": "count(*)::double", "group": "max(1.0)::double", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)"}.items():
    _whole(f"pq_{_op}", f"{_op}({V})", _sql)
_query("pq_sum_by", f"sum by (event_type) ({V})", f"select 'event_type=' || event_type as label_key, {_NOW} as ts, round(sum(value), 7) as value from m group by event_type")
_query("pq_avg_without", f"avg without (event_type) ({V})", f"select 'user_id=' || user_id as label_key, {_NOW} as ts, round(avg(value), 7) as value from m group by user_id")
_query("pq_sum_by_after", f"sum({V}) by (user_id)", f"select 'user_id=' || user_id as label_key, {_NOW} as ts, round(sum(value), 7) as value from m group by user_id")
_query("pq_count_values", f'count_values("event_type", {V})', f"select 'event_type=' || event_type as label_key, {_NOW} as ts, count(*)::double as value from m group by event_type")
_RANKED = "select label_key, ts, round(value, 7) as value from (select *, row_number() over (partition by label_key order by value {o}, ts) as r from m) where r <= {k}"
_query("pq_topk", f"topk(3, {V})", _RANKED.format(o="desc", k=3))
_query("pq_bottomk", f"bottomk(2, {V})", _RANKED.format(o="asc", k=2))
_query("pq_quantile", f"quantile(0.9, {V})", "select '' as label_key, min(ts) as ts, round(value, 7) as value from m where value = (select quantile_disc(value, 0.9) from m) group by value")
_query("pq_quantile_by", f"quantile by (event_type) (0.25, {V})", ", q as (select event_type, quantile_disc(value, 0.25) as q from m group by 1) select 'event_type=' || event_type as label_key, min(ts) as ts, round(any_value(value), 7) as value from m join q using (event_type) where value = q group by event_type")
_query("pq_wal_avg_by", 'avg by (job, region) (cpu_usage_percent)', f"select array_to_string(list_filter([case when labels['job'] is not null then 'job=' || labels['job'] end, case when labels['region'] is not null then 'region=' || labels['region'] end], lambda x: x is not null), ',') as label_key, {_NOW} as ts, round(avg(value), 7) as value from m where name = 'cpu_usage_percent' group by 1", _wal, _WAL)

# values

_NUM = {
    "abs": (f"abs({V} - 50)", "abs(value - 50)"), "ceil": (f"ceil({V})", "ceil(value)"), "floor": (f"floor({V})", "floor(value)"),
    "exp": (f"exp({V} / 50)", "exp(value / 50)"), "sqrt": (f"sqrt({V})", "sqrt(value)"), "ln": (f"ln({V} + 1)", "ln(value + 1)"),
    "log2": (f"log2({V} + 1)", "log2(value + 1)"), "log10": (f"log10({V} + 1)", "log10(value + 1)"), "deg": (f"deg({V})", "degrees(value)"),
    "rad": (f"rad({V})", "radians(value)"), "sgn": (f"sgn({V} - 50)", "sign(value - 50)::double"),
    "acos": (f"acos({V} / 1000)", "acos(value / 1000)"), "asin": (f"asin({V} / 1000)", "asin(value / 1000)"), "atan": (f"atan({V})", "atan(value)"),
    "acosh": (f"acosh({V} + 1)", "acosh(value + 1)"), "asinh": (f"asinh({V})", "asinh(value)"), "atanh": (f"atanh({V} / 1000)", "atanh(value / 1000)"),
    "cos": (f"cos({V})", "cos(value)"), "sin": (f"sin({V})", "sin(value)"), "tan": (f"tan({V} / 1000)", "tan(value / 1000)"),
    "cosh": (f"cosh({V} / 100)", "cosh(value / 100)"), "sinh": (f"sinh({V} / 100)", "sinh(value / 100)"), "tanh": (f"tanh({V} / 100)", "tanh(value / 100)"),
    "clamp": (f"clamp({V}, 20, 60)", "greatest(least(value, 60), 20)"), "clamp_min": (f"clamp_min({V}, 30)", "greatest(value, 30)"),
    "clamp_max": (f"clamp_max({V}, 30)", "least(value, 30)"), "round": (f"round({V})", "round(value)"), "round_to": (f"round({V}, 8)", "round(value / 8) * 8"),
    "timestamp": (f"timestamp({V})", "epoch_us(ts) / 1e6"), "minute": (f"minute({V})", "minute(ts)::double"), "hour": (f"hour({V})", "hour(ts)::double"),
    "day_of_week": (f"day_of_week({V})", "dayofweek(ts)::double"), "day_of_month": (f"day_of_month({V})", "day(ts)::double"),
    "day_of_year": (f"day_of_year({V})", "dayofyear(ts)::double"), "days_in_month": (f"days_in_month({V})", "day(last_day(ts))::double"),
    "month": (f"month({V})", "month(ts)::double"), "year": (f"year({V})", "year(ts)::double"),
}
for _name, (_expression, _sql) in _NUM.items():
    _each(f"fn_{_name}", _expression, _sql)
_query("fn_pi", "pi()", f"select '' as label_key, {_NOW} as ts, round(pi(), 7) as value")
_query("fn_vector", "vector(3) + 4", f"select '' as label_key, {_NOW} as ts, 7.0::double as value")
_query("fn_time", "time()", f"select '' as label_key, {_NOW} as ts, epoch({_NOW}) as value")
_query("fn_scalar", f"scalar({V})", f"select '' as label_key, {_NOW} as ts, case when count(distinct label_key) = 1 then min(value) else 'nan'::double end as value from m")
_query("fn_absent", 'absent(event_value{event_type="nothing"})', f"select 'absent=true' as label_key, {_NOW} as ts, 1.0::double as value")
_query("fn_absent_present", f"absent({V})", f"select 'absent=true' as label_key, {_NOW} as ts, 1.0::double as value where false")
_query("fn_absent_over_time", f"absent_over_time({V}[1m])", f"select 'absent=true' as label_key, {_NOW} as ts, 1.0::double as value from (select count(*) as n from m where ts > {_NOW} - interval 1 minute and ts <= {_NOW}) where n = 0")
_each("fn_sort", f"sort({V})", "value")
_each("fn_sort_desc", f"sort_desc({V})", "value")
_query("fn_label_join", f'label_join({V}, "both", "-", "event_type", "none", "user_id")', "select 'both=' || event_type || '--' || user_id || ',event_type=' || event_type || ',user_id=' || user_id as label_key, ts, round(value, 7) as value from m")
_query("fn_label_replace", f'label_replace({V}, "event_type", "${{1}}x", "event_type", "^(.)(.*)")', "select 'event_type=' || left(event_type, 1) || 'x,user_id=' || user_id as label_key, ts, round(value, 7) as value from m")
_query("fn_label_replace_none", f'label_replace({V}, "kind", "$1", "event_type", "^(p.*)$")', "select 'event_type=' || event_type || case when starts_with(event_type, 'p') then ',kind=' || event_type else '' end || ',user_id=' || user_id as label_key, ts, round(value, 7) as value from m")

# ranges
_LAST, _FIRST = "arg_max(value, (ts, value))", "arg_min(value, (ts, value))"
_LAGGED = ", p as (select *, lag(value) over (partition by label_key order by ts, value) as before from m) select label_key, {ts} as ts, round({value}, 7) as value from p group by label_key"
_query("fn_changes", f"changes({V})", _LAGGED.format(ts=_NOW, value="count(*) filter (value <> before)::double"))
_query("fn_resets", f"resets({V})", _LAGGED.format(ts=_NOW, value="count(*) filter (value < before)::double"))
_query("fn_increase", f"increase({V})", _LAGGED.format(ts="max(ts)", value="case when count(*) < 2 then max(value) else sum(case when before is null then 0 when value >= before then value - before else value end) end"))
_series("fn_increase_compat", f"increase({V})", f"{_LAST} - {_FIRST}", "max(ts)", compat=True)
_series("fn_delta", f"delta({V})", f"{_LAST} - {_FIRST}", "max(ts)")
_SPAN = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6"
_series("fn_rate", f"rate({V} * 100000)", f"case when count(*) < 2 then max(value) * 100000 when max(ts) > min(ts) then ({_LAST} - {_FIRST}) * 100000 / ({_SPAN}) else 'nan'::double end", "max(ts)")
_TWO = ", r as (select *, row_number() over (partition by label_key order by ts desc, value desc) as r from m), t as (select label_key, max(ts) as ts, count(*) as n, max(value) filter (r = 1) as z, max(value) filter (r = 2) as y, max(ts) filter (r = 1) as tz, max(ts) filter (r = 2) as ty from r where r <= 2 group by label_key) select label_key, ts, round({value}, 7) as value from t"
_query("fn_idelta", f"idelta({V})", _TWO.format(value="case when n < 2 then z else z - y end"))
_query("fn_irate", f"irate({V} * 1000)", _TWO.format(value="case when n < 2 or tz <= ty then z * 1000 else (z - y) * 1000 / ((epoch_us(tz) - epoch_us(ty)) / 1e6) end"))
_SLOPE = "regr_slope(value, epoch_us(ts) / 1e6)"
_series("fn_deriv", f"deriv({V} * 1000000)", "case when count(*) < 2 then 'nan'::double else regr_slope(value * 1000000, epoch_us(ts) / 1e6) end", "max(ts)")
_query("fn_predict_linear", f"predict_linear({V}, 1706745600)", f"select label_key, timestamp '2024-02-01 00:00:00' as ts, round(case when count(*) < 2 then max(value) else avg(value) + {_SLOPE} * (1706745600 - avg(epoch_us(ts) / 1e6)) end, 7) as value from m group by label_key")
_query("fn_holt_winters", f"holt_winters({V}, 0.8, 0.2)", f"""with recursive {_EVENTS},
o as (select label_key, ts, value, row_number() over w as r, lead(value) over w as following, count(*) over (partition by label_key) as n from m window w as (partition by label_key order by ts, value)),
h as (
  select label_key, r, value as l, coalesce(following - value, 0) as b from o where r = 1
  union all
  select o.label_key, o.r, 0.8::double * o.value + 0.2::double * (h.l + h.b),
         0.2::double * (0.8::double * o.value + 0.2::double * (h.l + h.b) - h.l) + 0.8::double * h.b
  from h join o on o.label_key = h.label_key and o.r = h.r + 1)
select label_key, ts, round(case when r = n then value + b else l + b end, 7) as value from h join o using (label_key, r)""")
_series("fn_avg_over_time", f"avg_over_time({V}[20d])", "avg(value)", where=f"ts > {_NOW} - interval 20 days and ts <= {_NOW}")
for _name, _sql in {"min": "min(value)", "max": "max(value)", "sum": "sum(value)", "count": "count(*)::double", "stddev": "stddev_pop(value)", "stdvar": "var_pop(value)", "present": "max(1.0)::double"}.items():
    _series(f"fn_{_name}_over_time", f"{_name}_over_time({V})", _sql)
_series("fn_last_over_time", f"last_over_time({V})", _LAST, "max(ts)")
_series("fn_quantile_over_time", f"quantile_over_time({V}, 0.4)", "list_sort(list(value))[greatest(round(0.4::double * count(*)), 1)::bigint]")
_query("fn_mad_over_time", f"mad_over_time({V})", f", q as (select label_key, quantile_cont(value, 0.5) as c from m group by 1) select label_key, {_NOW} as ts, round(quantile_cont(abs(value - c), 0.5), 7) as value from m join q using (label_key) group by label_key")

# operators
_ARITHMETIC = {"add": ("+", "value + 7"), "sub": ("-", "value - 7"), "mul": ("*", "value * 7"), "div": ("/", "value / 7"), "mod": ("%", "value % 7"), "power": ("^", "value ^ 2")}
for _name, (_op, _sql) in _ARITHMETIC.items():
    _each(f"bin_{_name}", f"{V} {_op} {2 if _op == '^' else 7}", _sql)
_COMPARISONS = {"eq": "==", "neq": "!=", "gt": ">", "lt": "<", "gte": ">=", "lte": "<="}
for _name, _op in _COMPARISONS.items():
    _each(f"bin_{_name}", f"floor({V}) {_op} 42", f"(floor(value) {'=' if _op == '==' else _op} 42)::int::double")
_each("bin_scalar_left", f"100 - {V}", "100 - value")
_each("bin_unary", f"-{V}", "-value")
_each("bin_precedence", f"-{V} + 2 * 3 ^ 2 % 7", "-value + ((2 * 9) % 7)")
_query("bin_div_zero", f"vector(1) / 0 > 1", f"select '' as label_key, {_NOW} as ts, 0.0::double as value")
_query("bin_vector", f"{V} / ({V} + 1)", "select label_key, ts, round(value / (value + 1), 7) as value from m")
_query("bin_vector_time", f"{V} - {V} * 2", "select label_key, a.ts, round(a.value - b.value * 2, 7) as value from m a join m b using (label_key) where a.ts = b.ts", pairing="time")
_query("bin_on", f'sum by (event_type, user_id) ({V}) / on (event_type) sum by (event_type) ({V})',
       f", a as (select label_key, event_type, sum(value) as v from m group by 1, 2), p as (select *, row_number() over (partition by event_type order by v) as r from a), b as (select event_type, sum(value) as w from m group by 1) select label_key, {_NOW} as ts, round(v / w, 7) as value from p join b using (event_type) where r = 1")
_query("bin_ignoring", f'sum by (event_type) ({V}) / ignoring (event_type) sum({V})',
       f", a as (select event_type, sum(value) as v from m group by 1), p as (select *, row_number() over (order by v) as r from a) select 'event_type=' || event_type as label_key, {_NOW} as ts, round(v / (select sum(value) from m), 7) as value from p where r = 1")
_query("bin_group_left", f"sum by (event_type, user_id) ({V}) / on (event_type) group_left sum by (event_type) ({V})",
       f", b as (select event_type, sum(value) as w from m group by 1) select label_key, {_NOW} as ts, round(sum(value) / any_value(w), 7) as value from m join b using (event_type) group by label_key")
_query("bin_group_right", f'label_replace(sum by (user_id) ({V}), "kind", "all", "user_id", "^.+$") - on (user_id) group_right (kind) sum by (event_type, user_id) ({V})',
       f", b as (select user_id, sum(value) as w from m group by 1) select 'event_type=' || any_value(event_type) || ',kind=all,user_id=' || any_value(user_id) as label_key, {_NOW} as ts, round(any_value(w) - sum(value), 7) as value from m join b using (user_id) group by m.label_key")
_STEPS = f", t as (select unnest(generate_series({_NOW} - interval {{days}} days + interval 1 day, {_NOW}, interval 1 day)) as t)"
_query("pq_subquery", f"max_over_time(sum_over_time({V}[36h])[10d:1d])",
       _STEPS.format(days=10) + f", s as (select label_key, t, sum(value) as v from m join t on ts > t - interval 36 hours and ts <= t group by all) select label_key, {_NOW} as ts, round(max(v), 7) as value from s group by label_key")
_query("pq_subquery_points", f"sum by (event_type) (count_over_time({V}[2d]))[6d:1d]",
       _STEPS.format(days=6) + "select 'event_type=' || event_type as label_key, t as ts, count(*)::double as value from m join t on m.ts > t - interval 2 days and m.ts <= t group by event_type, t")
_query("set_and", f'{V} and sum_over_time({V}[2d])', f"select label_key, ts, round(value, 7) as value from m where label_key in (select label_key from m where ts > {_NOW} - interval 2 days and ts <= {_NOW})")
_query("set_unless", f'{V} unless sum_over_time({V}[2d])', f"select label_key, ts, round(value, 7) as value from m where label_key not in (select label_key from m where ts > {_NOW} - interval 2 days and ts <= {_NOW})")
_query("set_or", f'sum_over_time({V}{{event_type="click"}}) or count_over_time({V})', f"select label_key, {_NOW} as ts, round(case when event_type = 'click' then sum(value) else count(*) end, 7) as value from m group by label_key, event_type")
_query("nested_sum_rate", f"sum by (event_type) (rate({V} * 100000))", f", r as (select event_type, label_key, case when count(*) < 2 then max(value) * 100000 when max(ts) > min(ts) then ({_LAST} - {_FIRST}) * 100000 / ({_SPAN}) end as r from m group by 1, 2) select 'event_type=' || event_type as label_key, {_NOW} as ts, round(sum(r), 7) as value from r group by event_type")
_query("nested_max_sum", f"max(sum by (event_type) ({V}))", f"select '' as label_key, {_NOW} as ts, round(max(s), 7) as value from (select sum(value) as s from m group by event_type)")


def pq_label_names(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_names(adapters.metrics_from_wal(table(spark, d, "metric_wal")))


def pq_label_values(spark: SparkSession, d: str) -> DataFrame:
    return metrics.label_values(adapters.metrics_from_wal(table(spark, d, "metric_wal")), "job")


def pq_series_points(spark: SparkSession, d: str) -> DataFrame:
    """Points of stored series, counted by name."""
    points = adapters.metrics_from_series(table(spark, d, "query_time_series"))
    return points.groupBy("name").agg(F.count(F.lit(1)).alias("points"))


QUERIES |= {f.__name__: f for f in (pq_label_names, pq_label_values, pq_series_points)}
ORACLES |= {
    "pq_label_names": "select distinct unnest(map_keys(name_value_labels)) as label from metric_wal union select '__name__'",
    "pq_label_values": "select distinct name_value_labels['job'] as value from metric_wal where name_value_labels['job'] is not null",
    "pq_series_points": "select labels['__name__'] as name, sum(len(metric_points))::bigint as points from query_time_series group by 1 having sum(len(metric_points)) > 0",
}
