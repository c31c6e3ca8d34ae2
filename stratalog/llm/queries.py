"""Queries of the operators for training text, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import digests, encode, pack, quality, terms
from stratalog.session import cut, table

#: the rank error that percentiles of 400 cells are certified to stay within
RANK_ERROR = 0.01


def _log_terms() -> dict:
    return {"text": terms.text_terms(F.col("text")), "field": terms.field_terms(F.col("fields"))}


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.marked_terms(table(spark, d, "log_messages"), "log_message_id", _log_terms())


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).filter("mark <> ''").select("origin", "term", "mark")


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    wal = table(spark, d, "metric_wal")
    found = cut(digests.estimate(digests.merge_digests(digests.build_digests(wal))))
    names = ("p50", "p90", "p95", "p99", "p999")
    return digests.certify(wal, found).select(*digests.GROUP, "n", *[F.col("estimates")[i].alias(n) for i, n in enumerate(names)], "rank_error")


def p5_certified(spark: SparkSession, d: str) -> DataFrame:
    return p5_percentiles(spark, d).select(*digests.GROUP, "n", (F.col("rank_error") <= RANK_ERROR).alias("within"))


def p5_small(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of the groups that are small enough for their digests to hold every value."""
    return p5_percentiles(spark, d).filter("n <= 250")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "text", ["doc_id"])


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents"), "text", ["doc_id"], lengths=True)


def p9_bound(spark: SparkSession, d: str) -> DataFrame:
    return pack.packing_report(_sizes(spark, d))


def _packing(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(_sizes(spark, d))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d)


def p9_check(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the packing, containers that are too full, documents cut though they would fit, and whether there is at most one percent more than volume asks for, or one container."""
    packing = cut(_packing(spark, d))
    fill = pack.container_fill(packing)
    full = fill.agg(F.count_if(F.col("tokens") > 2048).alias("n")).scalar()
    tight = fill.agg((F.count(F.lit(1)) <= F.ceil(F.sum("tokens") / 2048 * 1.01)).alias("tight")).scalar()
    per = packing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count(F.lit(1)).alias("documents"), full.cast("bigint").alias("too_full"),
        F.count_if(F.col("pieces") > F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048))).alias("cut_needlessly"), tight.alias("tight"),
    )


def p10_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_quality(spark, d).filter("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    f.__name__: f for f in (p2_found, p2_terms, p5_percentiles, p5_certified, p5_small, p8_ids, p9_packing, p9_bound, p9_check, p10_found, p10_quality)
}

_TERMS = r"""
with one as (select log_message_id as id, any_value(text) as text, any_value(fields) as fields from log_messages group by log_message_id),
t as (
  select 'text' as origin, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+(?:[.''][\p{L}\p{N}_]+)*')) as term from one
  union all
  select 'field', id, e.key || '~' || e.value from (select id, unnest(map_entries(fields)) as e from one) where e.value is not null),
c as (select origin, term, count(*)::bigint as occurrences, count(distinct id)::bigint as records from t group by origin, term),
m as (
  select *, case when records <= 2 then 'rare' when records * 10 > (select count(*) from one) then 'common' else '' end as mark from c)
"""

_VALUES = """
with v as (select metric_name, name_value_labels as labels, value from metric_wal where value is not null and not isnan(value) and not isinf(value)),
k as (
  select metric_name, null as label, null as label_value, value from v
  union all select metric_name, e.key, e.value, value from (select metric_name, value, unnest(map_entries(labels)) as e from v))
"""

ORACLES = {
    "p2_terms": _TERMS + "select * from m",
    "p2_found": _TERMS + "select origin, term, mark from m where mark <> ''",
    "p5_certified": _VALUES + "select metric_name, label, label_value, count(*)::bigint as n, true as within from k group by metric_name, label, label_value",
    "p5_small": _VALUES
    + """select metric_name, label, label_value, n, x[ceil(0.5 * n - 1e-9)::int] as p50, x[ceil(0.9 * n - 1e-9)::int] as p90, x[ceil(0.95 * n - 1e-9)::int] as p95,
       x[ceil(0.99 * n - 1e-9)::int] as p99, x[ceil(0.999 * n - 1e-9)::int] as p999, 0.0::double as rank_error
from (select metric_name, label, label_value, count(*)::bigint as n, list_sort(list(value)) as x from k group by metric_name, label, label_value) where n <= 250""",
    "p9_check": "select count(distinct doc_id)::bigint as documents, 0::bigint as too_full, 0::bigint as cut_needlessly, true as tight from documents",
}
