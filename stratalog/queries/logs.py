"""Queries of the search language and of its aggregations, with SQL equivalents."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans import aggs, dsl
from stratalog.session import table
from stratalog.sources import adapters

NAMES = dsl.Compiler()
STRICT = dsl.Compiler(strict=True)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TERM = r"[\p{L}\p{N}_]+(?:[.''][\p{L}\p{N}_]+)*"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return adapters.logs_from_documents(table(spark, d, "documents"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.logs_from_events(table(spark, d, "events"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return adapters.logs_from_messages(table(spark, d, "log_messages"))


def _access(spark: SparkSession, d: str) -> DataFrame:
    return adapters.logs_from_access(table(spark, d, "apache_log_entries"))


#: SQL that gives doc_id, ts, text and the fields of each kind of log as columns
_SQL = {
    _documents: "(select doc_id, posted_at as ts, text, author, lang, source, n_chars from documents)",
    _events: "(select event_id as doc_id, ts, concat_ws(' ', event_type, props) as text, event_type, user_id::varchar as user_id, json_extract_string(props, '$.k') as k, value from events)",
    _messages: "(select log_message_id as doc_id, time as ts, text, fields from log_messages)",
    _access: "(select entry_id as doc_id, date as ts, concat_ws(' ', ip, request, status_code, response_size, referrer, user_agent) as text, ip, request, status_code, response_size, referrer, user_agent from apache_log_entries)",
}


def _tok(column: str, lower: bool = True) -> str:
    return f"regexp_extract_all({f'lower({column})' if lower else column}, '{_TERM}')"


def _has(column: str, token: str, lower: bool = True) -> str:
    return f"coalesce(list_contains({_tok(column, lower)}, '{token}'), false)"


def _search(name: str, logs: Query, body: dict, where: str, tail: str = "", compiler: dsl.Compiler = NAMES) -> None:
    """Registers a search that gives the ids of its hits, and its SQL."""
    QUERIES[name] = lambda spark, d: dsl.search(logs(spark, d), body, compiler).select("doc_id")
    ORACLES[name] = f"select doc_id from {_SQL[logs]} where {where} {tail}"


def _q(query: dict, **more: object) -> dict:
    return {"query": query, **more}


_search("log_term", _events, _q({"term": {"event_type": {"value": "purchase"}}}), "event_type = 'purchase'")
_search("log_term_ci", _events, _q({"term": {"event_type": {"value": "PURCHASE", "case_insensitive": True}}}), "lower(event_type) = 'purchase'")
_search("log_terms", _events, _q({"terms": {"event_type": ["click", "error"]}}), "event_type in ('click', 'error')")
_search("log_match_or", _documents, _q({"match": {"_all": {"query": "kiln sprocket"}}}), f"{_has('text', 'kiln')} or {_has('text', 'sprocket')}")
_search("log_match_and", _documents, _q({"match": {"_all": {"query": "Kiln oven", "operator": "AND"}}}), f"{_has('text', 'kiln')} and {_has('text', 'oven')}")
_search("log_match_field", _documents, _q({"match": {"author": {"query": "[Deleted] user", "operator": "AND"}}}), f"{_has('author', 'deleted')} and {_has('author', 'user')}")
_search("log_match_phrase", _documents, _q({"match_phrase": {"text": "weak point"}}), f"contains(text, 'weak point') and {_has('text', 'weak')} and {_has('text', 'point')}")
_search("log_prefix", _documents, _q({"prefix": {"source": "forum/w"}}), "starts_with(source, 'forum/w')")
_search("log_prefix_ci", _documents, _q({"prefix": {"source": {"value": "FORUM/W", "case_insensitive": True}}}), "starts_with(lower(source), 'forum/w')")
_search("log_regexp_whole", _documents, _q({"regexp": {"source": {"value": "m/w.*s?", "whole_value": True}}}), "regexp_matches(source, 'm/w.*s?')")
_search("log_wildcard_whole", _documents, _q({"wildcard": {"author": {"value": "t_?*r", "whole_value": True}}}), "regexp_matches(author, 't_..*r')")
_search("log_match_phrase_prefix", _documents, _q({"match_phrase_prefix": {"text": "There is a good way"}}), "contains(text, 'There is a good way')")
_search("log_match_phrase_prefix_one", _documents, _q({"match_phrase_prefix": {"text": "Thank"}}), "starts_with(text, 'Thank')")
_search("log_regexp", _documents, _q({"regexp": {"source": "(work|boat).*d?"}}), f"len(list_filter({_tok('source', False)}, lambda t: regexp_matches(t, '^(?:(work|boat).*d?)'))) > 0")
_search("log_wildcard", _documents, _q({"wildcard": {"author": {"value": "q?iet_*n"}}}), f"len(list_filter({_tok('author', False)}, lambda t: regexp_matches(t, '^(?:q.iet_.*n)'))) > 0")
_search("log_multi_match", _access, _q({"multi_match": {"query": "cart", "fields": ["request", "referrer"]}}), "coalesce(contains(request, 'cart'), false) or coalesce(contains(referrer, 'cart'), false)")
_search("log_range", _events, _q({"range": {"value": {"gte": 20, "lt": 40.5}}}), "value >= 20 and value < 40.5")
_search("log_range_text", _access, _q({"range": {"response_size": {"gt": 50000}}}), "try_cast(response_size as double) > 50000")
_search("log_exists", _documents, _q({"exists": {"field": "lang"}}), "lang is not null")
_search("log_ids", _events, _q({"ids": {"values": [1, 5, 77, 10**9]}}), "doc_id in (1, 5, 77, 1000000000)")
_search("log_bool_must", _events, _q({"bool": {"must": [{"term": {"event_type": {"value": "click"}}}, {"range": {"value": {"gte": 50}}}]}}), "event_type = 'click' and value >= 50")
_search("log_bool_should", _events, _q({"bool": {"should": [{"term": {"event_type": {"value": "signup"}}}, {"term": {"k": "87"}}]}}), "event_type = 'signup' or coalesce(k = '87', false)")
_search("log_bool_must_not", _events, _q({"bool": {"must": [{"term": {"event_type": "view"}}], "must_not": [{"range": {"value": {"lt": 30}}}]}}), "event_type = 'view' and not value < 30")
_search("log_bool_must_should", _events, _q({"bool": {"must": [{"term": {"event_type": "view"}}], "should": [{"term": {"k": "12"}}]}}), "event_type = 'view' or coalesce(k = '12', false)")
_search("log_bool_strict", _events, _q({"bool": {"must": [{"term": {"event_type": "view"}}], "should": [{"term": {"k": "12"}}]}}), "event_type = 'view'", compiler=STRICT)
_search("log_bool_filter", _events, _q({"bool": {"filter": [{"term": {"event_type": "error"}}], "must": [{"exists": {"field": "k"}}]}}), "event_type = 'error' and k is not null")
_search(
    "log_bool_nested", _events,
    _q({"bool": {"must": [{"bool": {"should": [{"term": {"event_type": "click"}}, {"term": {"event_type": "error"}}]}}, {"bool": {"must_not": [{"term": {"k": "1"}}], "must": [{"exists": {"field": "k"}}]}}]}}),
    "event_type in ('click', 'error') and k is not null and k <> '1'",
)
_search("log_bool_only_must_not", _events, _q({"bool": {"must_not": [{"term": {"event_type": "view"}}]}}), "false")
_search("log_minimum_should_match", _events, _q({"bool": {"should": [{"term": {"event_type": "view"}}, {"range": {"value": {"gt": 50}}}, {"range": {"value": {"lt": 80}}}], "minimum_should_match": 2}}), "(event_type = 'view')::int + (value > 50)::int + (value < 80)::int >= 2")
_search("log_fuzzy", _documents, _q({"fuzzy": {"author": {"value": "quiet_bobbin7", "fuzziness": 1}}}), f"len(list_filter({_tok('author', False)}, lambda t: levenshtein(t, 'quiet_bobbin7') <= 1)) > 0")
_search("log_terms_set", _documents, _q({"terms_set": {"text": {"terms": ["kiln", "oven", "sprocket", "gearbox"], "minimum_should_match": 2}}}), " + ".join(f"({_has('text', t)})::int" for t in ("kiln", "oven", "sprocket", "gearbox")) + " >= 2")
_search("log_match_bool_prefix", _documents, _q({"match_bool_prefix": {"text": "beehive gearb"}}), f"{_has('text', 'beehive')} or len(list_filter({_tok('text')}, lambda t: starts_with(t, 'gearb'))) > 0")
_search("log_query_string", _documents, _q({"query_string": {"query": '(kiln AND NOT oven) OR source:workb* OR "weak point"'}}),
        f"({_has('text', 'kiln')} and not {_has('text', 'oven')}) or coalesce(len(list_filter({_tok('source', False)}, lambda t: regexp_matches(t, '(?i)^workb'))) > 0, false) or coalesce(contains(text, 'weak point'), false)")
_search("log_simple_query_string", _documents, _q({"simple_query_string": {"query": "kiln + oven | router", "fields": ["text"]}}), f"({_has('text', 'kiln')} and {_has('text', 'oven')}) or {_has('text', 'router')}")
_search("log_constant_score", _events, _q({"constant_score": {"filter": {"term": {"event_type": "signup"}}}}), "event_type = 'signup'")
_search("log_dis_max", _events, _q({"dis_max": {"queries": [{"term": {"event_type": "signup"}}, {"term": {"event_type": "error"}}]}}), "event_type in ('signup', 'error')")
_search("log_boosting", _events, _q({"boosting": {"positive": {"term": {"event_type": "click"}}, "negative": {"term": {"k": "1"}}, "negative_boost": 0.5}}), "event_type = 'click'")
_search("log_wrapper", _events, _q({"wrapper": {"query": base64.b64encode(json.dumps({"term": {"event_type": "error"}}).encode()).decode()}}), "event_type = 'error'")
_search("log_more_like_this", _documents, _q({"more_like_this": {"fields": ["text"], "like": "the kiln and the oven are both noisy", "minimum_should_match": "60%"}}),
        f"len(list_filter(['and', 'are', 'both', 'kiln', 'noisy', 'oven', 'the'], lambda t: list_contains({_tok('text')}, t))) >= 5")
_search("log_span_term", _documents, _q({"span_term": {"text": "Greenhouse"}}), _has("text", "greenhouse"))
_search("log_span_or", _documents, _q({"span_or": {"clauses": [{"span_term": {"text": "kiln"}}, {"span_term": {"text": "jig"}}]}}), f"{_has('text', 'kiln')} or {_has('text', 'jig')}")
_search("log_span_not", _documents, _q({"span_not": {"include": {"span_term": {"text": "kiln"}}, "exclude": {"span_term": {"text": "the"}}}}), f"{_has('text', 'kiln')} and not {_has('text', 'the')}")
_search("log_span_first", _documents, _q({"span_first": {"match": {"span_term": {"text": "my"}}, "end": 4}}), f"list_position({_tok('text')}, 'my') between 1 and 4")
_NEAR = "list_filter(generate_series(1, len({t})), lambda i: {t}[i] = 'weak' and len(list_filter(generate_series(i + 1, i + 1 + {gaps}), lambda j: {t}[j] = 'point')) > 0)"
_search("log_span_near", _documents, _q({"span_near": {"clauses": [{"span_term": {"text": "weak"}}, {"span_term": {"text": "point"}}], "slop": 2}}), f"len({_NEAR.format(t=_tok('text'), gaps=2)}) > 0")
_search("log_intervals", _documents, _q({"intervals": {"text": {"match": {"query": "weak point", "max_gaps": 0, "ordered": True}}}}), f"len({_NEAR.format(t=_tok('text'), gaps=0)}) > 0")
_search("log_geo_box", _messages, _q({"geo_bounding_box": {"coords": {"top_left": {"lat": 60, "lon": -90}, "bottom_right": {"lat": -30, "lon": 90}}}}),
        "try_cast(string_split(fields['coords'], ',')[1] as double) between -30 and 60 and try_cast(string_split(fields['coords'], ',')[2] as double) between -90 and 90")
_search("log_geo_distance", _messages, _q({"geo_distance": {"distance": "4000km", "coords": {"lat": 10.0, "lon": 20.0}}}),
        "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(try_cast(string_split(fields['coords'], ',')[1] as double) - 10) / 2), 2) + cos(radians(try_cast(string_split(fields['coords'], ',')[1] as double))) * cos(radians(10)) * pow(sin(radians(try_cast(string_split(fields['coords'], ',')[2] as double) - 20) / 2), 2)))) <= 4000000")
_search("log_sort_topk", _events, _q({"term": {"event_type": "purchase"}}, sort=[{"value": {"order": "desc", "type": "number"}}], size=25), "event_type = 'purchase'", "order by value desc, doc_id limit 25")
_search("log_page", _events, _q({"exists": {"field": "event_type"}}, size=40, **{"from": 20}), "event_type is not null", "order by ts desc, doc_id limit 40 offset 20")
_search("log_post_filter", _events, _q({"term": {"event_type": "click"}}, post_filter={"range": {"value": {"gt": 10}}}), "event_type = 'click' and value > 10")
_search("log_url_query", _documents, dsl.url_query("kiln OVEN"), f"{_has('text', 'kiln')} and {_has('text', 'oven')}")


def log_time_range(spark: SparkSession, d: str) -> DataFrame:
    return dsl.search(_events(spark, d), {}, NAMES, "2024-01-05 00:00:00", "2024-01-09 12:00:00").select("doc_id")


def log_delete_by_query(spark: SparkSession, d: str) -> DataFrame:
    """What is left after the hits of a query are marked as deleted."""
    logs = _events(spark, d)
    dead = dsl.search(logs, {"query": {"term": {"event_type": "error"}}}, NAMES).select("doc_id")
    return logs.join(dead, "doc_id", "left_anti").select("doc_id")


def log_highlight(spark: SparkSession, d: str) -> DataFrame:
    body = {"query": {"match": {"_all": {"query": "kiln oven", "operator": "AND"}}}, "highlight": {}}
    return dsl.search(_documents(spark, d), body, NAMES).select("doc_id", "highlight")


def log_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits as JSON rows."""
    hits = dsl.search(_events(spark, d), {"query": {"term": {"event_type": "signup"}}}, NAMES)
    source = F.struct(F.unix_millis("ts").alias("timestamp"), "text", "fields")
    return hits.select(F.to_json(F.struct(F.col("doc_id").alias("_id"), F.lit(1.0).alias("_score"), source.alias("_source"))).alias("hit"))


QUERIES |= {f.__name__: f for f in (log_time_range, log_delete_by_query, log_highlight, log_hits)}
ORACLES |= {
    "log_time_range": "select event_id as doc_id from events where ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-09 12:00:00'",
    "log_delete_by_query": "select event_id as doc_id from events where event_type <> 'error'",
    "log_highlight": f"""select doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),
  lambda x: case when lower(x) in ('kiln', 'oven') then '<em>' || x || '</em>' else x end), '') as highlight
from documents where {_has('text', 'kiln')} and {_has('text', 'oven')}""",
    "log_hits": """select '{"_id":' || event_id || ',"_score":1.0,"_source":{"timestamp":' || epoch_us(ts) // 1000 || ',"text":' || to_json(concat_ws(' ', event_type, props))
  || ',"fields":{"event_type":"' || event_type || '","user_id":"' || user_id || '"' || coalesce(',"k":"' || json_extract_string(props, '$.k') || '"', '') || coalesce(',"value":"' || value::varchar || '"', '') || '}}}' as hit
from events where event_type = 'signup'""",
}


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to four places, so that the order of sums doesn't show."""
    return df.select(*[F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _agg(name: str, spec: dict, sql: str, query: dict | None = None, change: Callable[[DataFrame], DataFrame] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        hits = _events(spark, d)
        hits = hits.filter(NAMES.compile(query)) if query else hits
        out = aggs.aggregate(hits, spec, NAMES)
        return _rounded(change(out) if change else out)

    QUERIES[name], ORACLES[name] = run, sql


_V = {"field": "value"}
_agg("agg_avg", {"avg": _V}, "select round(avg(value), 4) as value from events")
_agg("agg_min", {"min": _V}, "select round(min(value), 4) as value from events")
_agg("agg_max", {"max": _V}, "select round(max(value), 4) as value from events")
_agg("agg_sum", {"sum": _V}, "select round(sum(value), 4) as value from events")
_agg("agg_value_count", {"value_count": {"field": "k"}}, "select count(json_extract_string(props, '$.k')) as value from events")
_agg("agg_cardinality", {"cardinality": {"field": "user_id"}}, "select count(distinct user_id) as value from events")
_STATS = "count(value) as value_count, round(sum(value), 4) as value_sum, round(min(value), 4) as value_min, round(max(value), 4) as value_max, round(avg(value), 4) as value_avg"
_agg("agg_stats", {"stats": _V}, f"select {_STATS} from events where event_type = 'view'", {"term": {"event_type": "view"}})
_agg("agg_extended_stats", {"extended_stats": _V}, f"select {_STATS}, round(var_pop(value), 4) as value_variance, round(stddev_pop(value), 4) as value_std_deviation from events")
_agg("agg_percentiles", {"percentiles": {"field": "value", "percents": [25, 50, 99]}}, "select round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as p50, round(quantile_cont(value, 0.99), 4) as p99 from events",
     change=lambda df: df.select(*[F.get("value", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p99"))]))
_agg("agg_missing", {"avg": {"field": "k", "missing": 0}}, "select round(avg(coalesce(try_cast(json_extract_string(props, '$.k') as double), 0)), 4) as value from events")
_agg("agg_terms", {"terms": {"field": "event_type", "size": 3}, "aggs": {"mean": {"avg": _V}}}, "select event_type as key, count(*) as doc_count, round(avg(value), 4) as mean from events group by 1 order by 2 desc, 1 limit 3")
_agg("agg_terms_filtered", {"terms": {"field": "event_type", "include": ["click", "view", "error"], "exclude": ["error"], "min_doc_count": 2}}, "select event_type as key, count(*) as doc_count from events where event_type in ('click', 'view') group by 1 having count(*) >= 2")
_agg("agg_set_of_terms", {"set_of_terms": {"field": "user_id", "min_doc_count": 3}}, "select user_id::varchar as key, count(*) as doc_count from events group by 1 having count(*) >= 3")
_agg("agg_histogram", {"histogram": {"field": "value", "interval": 10}}, "select floor(value / 10) * 10.0::double as key, count(*) as doc_count from events where value is not null group by 1")
_agg("agg_histogram_zeros", {"histogram": {"field": "value", "interval": 7, "gap_policy": "insert_zeros"}}, "with b as (select floor(value / 7) * 7.0::double as key, count(*) as n from events where value is not null group by 1), g as (select unnest(generate_series(0, (((select max(key) from b) - (select min(key) from b)) / 7)::bigint)) * 7.0::double + (select min(key) from b) as key) select g.key, coalesce(b.n, 0) as doc_count from g left join b using (key)")
_agg("agg_date_histogram", {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"total": {"sum": _V}}}, "select date_trunc('day', ts)::timestamp as key, count(*) as doc_count, round(sum(value), 4) as total from events group by 1",
     change=lambda df: df.withColumn("key", F.col("key").cast("timestamp_ntz")))
_agg("agg_date_histogram_fixed", {"date_histogram": {"field": "ts", "fixed_interval": "6h"}}, "select time_bucket(interval 6 hours, ts, timestamp '1970-01-01') as key, count(*) as doc_count from events group by 1",
     change=lambda df: df.withColumn("key", F.col("key").cast("timestamp_ntz")))
_agg("agg_range", {"range": {"field": "value", "ranges": [{"to": 30}, {"from": 20, "to": 60}, {"from": 60, "key": "high"}]}}, "select key, count(*) as doc_count from (select unnest(list_filter([case when value < 30 then '*-30.0' end, case when value >= 20 and value < 60 then '20.0-60.0' end, case when value >= 60 then 'high' end], lambda x: x is not null)) as key from events) group by 1")
_agg("agg_filter", {"filter": {"term": {"event_type": "click"}}, "aggs": {"top": {"max": _V}}}, "select 'filter' as key, count(*) as doc_count, round(max(value), 4) as top from events where event_type = 'click' having count(*) > 0")
_DAILY = "select date_trunc('day', ts)::timestamp as key, count(*) as doc_count, avg(value) as mean from events group by 1"
_BY_DAY = {"date_histogram": {"field": "ts", "calendar_interval": "day"}}
_agg("agg_avg_bucket", {**_BY_DAY, "aggs": {"mean": {"avg": _V}}}, f"select round(avg(mean), 4) as value from ({_DAILY})", change=lambda df: aggs.pipeline(df, "avg_bucket", "days>mean"))
_agg("agg_sum_bucket", {**_BY_DAY, "aggs": {"mean": {"avg": _V}}}, f"select round(sum(mean), 4) as value from ({_DAILY})", change=lambda df: aggs.pipeline(df, "sum_bucket", "days>mean"))
_agg("agg_cumulative_sum", {**_BY_DAY, "aggs": {"upto": {"cumulative_sum": {"buckets_path": "_count"}}}}, f"select key, doc_count, sum(doc_count) over (order by key)::double as upto from ({_DAILY})", change=lambda df: df.withColumn("key", F.col("key").cast("timestamp_ntz")))
_agg("agg_moving_avg", {**_BY_DAY, "aggs": {"mean": {"avg": _V}, "smooth": {"moving_avg": {"buckets_path": "mean", "window": 3}}}}, f"select key, doc_count, round(mean, 4) as mean, round(avg(mean) over (order by key rows between 2 preceding and current row), 4) as smooth from ({_DAILY})",
     change=lambda df: df.withColumn("key", F.col("key").cast("timestamp_ntz")))


