"""Aggregations over logs: metrics, buckets and pipelines over buckets.

Field values are texts; numbers are read with ``try_cast`` and what is no number is skipped. Every
aggregation is one ``groupBy``; metrics inside buckets are computed in the same pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.plans.dsl import Compiler, QueryError

METRICS = ("avg", "min", "max", "sum", "stats", "extended_stats", "value_count", "cardinality", "percentiles")
BUCKETS = ("terms", "histogram", "date_histogram", "range", "filter", "set_of_terms")
PIPELINES = ("avg_bucket", "sum_bucket", "cumulative_sum", "moving_avg")


def metric(compiler: Compiler, kind: str, body: dict, name: str) -> list[Column]:
    """Columns of one metric, named after it."""
    value = compiler.value(body["field"])
    number = value.try_cast("double")
    if "missing" in body:
        number = F.coalesce(number, F.lit(float(body["missing"])))
    if kind in ("avg", "min", "max"):
        return [getattr(F, kind)(number).alias(name)]
    if kind == "sum":
        return [F.coalesce(F.sum(number), F.lit(0.0)).alias(name)]
    if kind == "value_count":
        return [F.count(value).alias(name)]
    if kind == "cardinality":
        return [(F.approx_count_distinct(value) if body.get("approximate") else F.count_distinct(value)).alias(name)]
    if kind == "percentiles":
        shares = [float(p) / 100 for p in body.get("percents", [50, 90, 95, 99])]
        if body.get("approximate"):
            return [F.percentile_approx(number, shares, 10_000).alias(name)]
        return [F.percentile(number, F.array(*[F.lit(p) for p in shares])).alias(name)]
    basic = [
        F.count(number).alias(f"{name}_count"), F.coalesce(F.sum(number), F.lit(0.0)).alias(f"{name}_sum"),
        F.min(number).alias(f"{name}_min"), F.max(number).alias(f"{name}_max"), F.avg(number).alias(f"{name}_avg"),
    ]
    if kind == "stats":
        return basic
    if kind == "extended_stats":
        return [*basic, F.var_pop(number).alias(f"{name}_variance"), F.stddev_pop(number).alias(f"{name}_std_deviation")]
    raise QueryError(f"no such metric: {kind}")


_UNITS = {"second": "1 second", "minute": "1 minute", "hour": "1 hour", "day": "1 day", "week": "7 days", "month": None, "quarter": None, "year": None}
_SHORT = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days", "w": "weeks"}


def _date_key(body: dict) -> Column:
    unit = body.get("calendar_interval", body.get("interval", body.get("fixed_interval", "day")))
    if unit in _UNITS:
        return F.date_trunc(unit, F.col("ts"))
    n, short = unit[:-1], unit[-1:]
    if not n.isdigit() or short not in _SHORT:
        raise QueryError(f"no interval: {unit}")
    return F.window("ts", f"{n} {_SHORT[short]}")["start"]


def _bucket_key(compiler: Compiler, kind: str, body: dict) -> Column:
    if kind in ("terms", "set_of_terms"):
        return compiler.value(body["field"])
    if kind == "histogram":
        step = float(body["interval"])
        return F.floor(compiler.value(body["field"]).try_cast("double") / step) * F.lit(step)
    if kind == "date_histogram":
        return _date_key(body)
    if kind == "filter":
        return F.when(compiler.compile(body), F.lit("filter"))
    if kind == "range":
        value = compiler.value(body["field"]).try_cast("double")
        keys = []
        for r in body["ranges"]:
            low, high = r.get("from"), r.get("to")
            name = r.get("key", f"{'*' if low is None else float(low)}-{'*' if high is None else float(high)}")
            inside = value.isNotNull()
            inside = inside & (value >= float(low)) if low is not None else inside
            inside = inside & (value < float(high)) if high is not None else inside
            keys.append(F.when(inside, F.lit(name)))
        # a value may be in several ranges
        return F.explode(F.array_compact(F.array(*keys)))
    raise QueryError(f"no such bucket: {kind}")


def _split(spec: dict) -> tuple[str, dict, dict]:
    inner = spec.get("aggs", spec.get("aggregations", {}))
    kind = next(k for k in spec if k not in ("aggs", "aggregations"))
    return kind, spec[kind], inner


def _inner(compiler: Compiler, inner: dict) -> tuple[list[Column], dict, dict]:
    """Metrics, pipelines and buckets among the aggregations inside a bucket."""
    columns, later, nested = [], {}, {}
    for n, s in inner.items():
        k, b, _ = _split(s)
        if k in METRICS:
            columns += metric(compiler, k, b, n)
        elif k in PIPELINES:
            later[n] = (k, b)
        else:
            nested[n] = s
    return columns, later, nested


def _chosen(df: DataFrame, column: str, body: dict) -> DataFrame:
    df = df.filter(F.col(column).isNotNull())
    if "include" in body:
        df = df.filter(F.col(column).isin(list(body["include"])))
    return df.filter(~F.col(column).isin(list(body["exclude"]))) if "exclude" in body else df


def _within(rows: DataFrame, parents: list[str], name: str, spec: dict, compiler: Compiler) -> DataFrame:
    """The buckets of ``spec`` inside those of ``parents``: one row a parent, with an array of structs called ``name``.

    Arrays hold buckets, never rows.
    """
    kind, body, inner = _split(spec)
    columns, later, nested = _inner(compiler, inner)
    if later:
        raise QueryError("pipelines belong to the outermost buckets")
    key = f"__key{len(parents)}"
    keyed = _chosen(rows.withColumn(key, _bucket_key(compiler, kind, body)), key, body)
    group = [*parents, key]
    out = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("doc_count"), *columns)
    for n, s in nested.items():
        out = out.join(_within(keyed, group, n, s, compiler), group, "left")
    if body.get("min_doc_count"):
        out = out.filter(F.col("doc_count") >= int(body["min_doc_count"]))
    values = [c for c in out.columns if c not in group]
    by, how = next(iter(body.get("order", {"_count": "desc"}).items())) if kind == "terms" else ("_key", "asc")
    first = {"_count": "doc_count", "_key": key}.get(by, by)
    bucket = F.struct(F.col(first).alias("o"), F.col(key).alias("key"), *values)
    less = lambda a, b: F.when(a < b, -1).when(a > b, 1)
    order = (lambda a, b: F.coalesce(less(a["o"], b["o"]), less(a["key"], b["key"]), F.lit(0))) if how == "asc" else (lambda a, b: F.coalesce(less(b["o"], a["o"]), less(a["key"], b["key"]), F.lit(0)))
    every = F.transform(F.array_sort(F.collect_list(bucket), order), lambda x: x.dropFields("o"))
    return out.groupBy(*parents).agg((F.slice(every, 1, int(body["size"])) if "size" in body else every).alias(name))


def aggregate(hits: DataFrame, spec: dict, compiler: Compiler | None = None, name: str = "value") -> DataFrame:
    """One aggregation over hits.

    Metrics give one row. Buckets give key and doc_count with the metrics inside as columns, buckets inside as
    arrays of structs (key, doc_count and what is inside them, in their order), then pipelines over them: ``cumulative_sum`` and ``moving_avg`` add a column, in order of key. ``avg_bucket`` and ``sum_bucket``
    beside them are given by ``pipeline``. An empty metric is null, except sums and counts.
    """
    compiler = compiler or Compiler()
    kind, body, inner = _split(spec)
    if kind in METRICS:
        return hits.agg(*metric(compiler, kind, body, name))
    keyed = _chosen(hits.withColumn("key", _bucket_key(compiler, kind, body)), "key", body)
    columns, later, nested = _inner(compiler, inner)
    out = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"), *columns)
    for n, s in nested.items():
        out = out.join(_within(keyed, ["key"], n, s, compiler), "key", "left")
    least = int(body.get("min_doc_count", 0))
    if least:
        out = out.filter(F.col("doc_count") >= least)
    if kind == "histogram" and body.get("gap_policy") == "insert_zeros":
        out = fill_gaps(out, float(body["interval"]))
    for n, (k, b) in later.items():
        out = out.withColumn(n, rolling(k, _path(b), int(b.get("window", 5))))
    if kind == "terms":
        by, how = next(iter(body.get("order", {"_count": "desc"}).items()))
        column = F.col({"_count": "doc_count", "_key": "key"}.get(by, by))
        out = out.orderBy(column.asc() if how == "asc" else column.desc(), F.col("key").asc())
        return out.limit(int(body["size"])) if "size" in body else out
    return out.orderBy("key") if kind != "set_of_terms" or "size" not in body else out.orderBy("key").limit(int(body["size"]))


def _path(body: dict) -> str:
    """The column that a path over buckets ends at: ``bucket>metric`` or ``_count``."""
    last = str(body["buckets_path"]).split(">")[-1].split(".")[0]
    return "doc_count" if last == "_count" else last


def rolling(kind: str, column: str, window: int = 5) -> Column:
    """Running sum, or mean of the last ``window`` buckets, in order of key; a missing value counts as zero.

    Buckets are few (one a key), so one ordered window over them is bounded by their number, not by rows.
    """
    value = F.coalesce(F.col(column).cast("double"), F.lit(0.0))
    order = Window.partitionBy(F.lit(1)).orderBy("key")
    if kind == "cumulative_sum":
        return F.sum(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if kind == "moving_avg":
        return F.avg(value).over(order.rowsBetween(-(window - 1), Window.currentRow))
    raise QueryError(f"no rolling pipeline: {kind}")


def pipeline(buckets: DataFrame, kind: str, path: str, name: str = "value") -> DataFrame:
    """``avg_bucket`` or ``sum_bucket`` of a column of buckets: one row; without buckets 0."""
    column = F.col(_path({"buckets_path": path})).cast("double")
    fold = {"avg_bucket": F.avg, "sum_bucket": F.sum}[kind]
    return buckets.agg(F.coalesce(fold(column), F.lit(0.0)).alias(name))


def fill_gaps(buckets: DataFrame, step: float) -> DataFrame:
    """Adds the empty buckets between the first and the last key, with a count of zero."""
    span = buckets.agg(F.min("key").alias("a"), F.max("key").alias("b")).filter("a is not null")
    grid = span.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.round((F.col("b") - F.col("a")) / step).cast("bigint"))).alias("i"), "a")
    keys = grid.select((F.col("a") + F.col("i") * step).alias("key"))
    return keys.join(buckets, "key", "left").fillna(0, subset=["doc_count"])
