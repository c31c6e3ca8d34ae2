"""Metric expressions compiled to DataFrames.

A vector is a frame of points: label_key, labels, ts, value. Aggregations fold all points of a group
(all of them without ``by`` or ``without``), range functions those of a series; the time of what they
give is the evaluation time. Binary operators between vectors pair the points of equal label sets by
position in time, or by equal time with ``pairing='time'``; comparisons give 1 or 0. A subquery gives every
point to all steps it serves, under a label of its own, and computes all steps at once.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.functions.catalog import DATES, INF, LIMITS, NAN, VALUES, arithmetic, compare
from stratalog.plans import promql as ast
from stratalog.plans.promql import ExpressionError
from stratalog.schema import label_key

#: the label that holds the step of a subquery while it is computed
STEP = "\u0001step"
#: how long a point stands for the value of its series
LOOKBACK_S = 300.0
COLUMNS = ["label_key", "labels", "ts", "value"]


@dataclass
class Scalar:
    """A number that is the same everywhere."""

    value: Column


def _no_labels() -> Column:
    return F.create_map().cast("map<string,string>")


def _point() -> Column:
    return F.struct("ts", "value")


def _seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / 1e6


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Adds the position of each point in its series, counted within days and then over days, so that no task sorts a whole series."""
    day = F.to_date("ts")
    sized = df.groupBy("label_key", day.alias("__day")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("label_key").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.select("label_key", "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("label_key", "__day").orderBy("ts", "value")
    rows = df.withColumn("__day", day).withColumn("__i", F.row_number().over(within))
    return rows.join(offsets, ["label_key", "__day"]).withColumn(name, F.col("__i") + F.col("__before")).drop("__day", "__i", "__before")


def neighbours(df: DataFrame, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Sum of ``step(previous, current)`` over successive points of each series: label_key, labels, total, n, last_ts.

    Days are folded by themselves; then the last point of a day meets the first of the next, over one row a day.
    """
    within = Window.partitionBy("label_key", "__day").orderBy("ts", "value")
    rows = df.withColumn("__day", F.to_date("ts"))
    rows = rows.withColumn("__previous", F.lag("value").over(within))
    days = rows.groupBy("label_key", "__day").agg(
        F.first("labels").alias("labels"), F.count(F.lit(1)).alias("n"), F.min(_point()).alias("__first"), F.max(_point()).alias("__last"),
        F.sum(F.when(F.col("__previous").isNotNull(), step(F.col("__previous"), F.col("value"))).otherwise(0.0)).alias("total"),
    )
    earlier = F.lag("__last").over(Window.partitionBy("label_key").orderBy("__day"))
    days = days.withColumn("__earlier", earlier)
    seam = F.when(F.col("__earlier").isNotNull(), step(F.col("__earlier.value"), F.col("__first.value"))).otherwise(0.0)
    return days.groupBy("label_key").agg(
        F.first("labels").alias("labels"), F.sum(F.col("total") + seam).alias("total"), F.sum("n").alias("n"), F.max("__last").alias("last")
    )


def _differs(a: Column, b: Column) -> Column:
    return F.when(a != b, 1.0).otherwise(0.0)


def _falls(a: Column, b: Column) -> Column:
    return F.when(b < a, 1.0).otherwise(0.0)


def _rises(a: Column, b: Column) -> Column:
    """What a counter gained: after a reset, all it shows."""
    return F.when(b >= a, b - a).otherwise(b)


def at_ranks(df: DataFrame, share: Column | float, ranks: Callable[[Column], list[Column]], small: int = 100_000) -> DataFrame:
    """Values of stated ranks (from 1) of every series: label_key, labels, n, found (null beyond the last).

    ``ranks`` gives them from the number of points; they lie near ``share``, a constant. A first pass brackets
    them by a mergeable sketch, a second counts what is below the bracket and keeps what is inside: a
    thousandth of the points of a series of more than ``small``, and all of a smaller one.
    """
    share = share if isinstance(share, Column) else F.lit(share)
    near = F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - 5e-4)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share + 5e-4)))
    sketch = df.groupBy("label_key").agg(F.first("labels").alias("__labels"), F.count(F.lit(1)).alias("__n"), F.percentile_approx("value", near, 10_000).alias("__near"))
    value, large = F.col("value"), F.col("__n") > small
    under = large & (value < F.get("__near", F.lit(0)))
    inside = ~large | ((value >= F.get("__near", F.lit(0))) & (value <= F.get("__near", F.lit(1))))
    kept = df.select("label_key", "value").join(sketch, "label_key").groupBy("label_key").agg(
        F.first("__labels").alias("labels"), F.first("__n").alias("n"), F.count_if(under).alias("__under"), F.array_sort(F.collect_list(F.when(inside, value))).alias("__kept")
    )
    at = [F.when(r <= F.col("n"), F.get("__kept", (r - F.col("__under") - 1).cast("int"))) for r in (x.cast("bigint") for x in ranks(F.col("n")))]
    return kept.select("label_key", "labels", "n", F.array(*at).alias("found"))


def _smoothed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forecasts of whole days, in one walk over the points of each, from the state the day begins with."""
    for b in batches:
        values, level, trend, first, last, alpha, beta = (b.column(i).to_pylist() for i in range(3, 10))
        out = []
        for v, l, t, is_first, is_last, x, y in zip(values, level, trend, first, last, alpha, beta):
            done = [l + t] if is_first else []
            for p in v[1:] if is_first else v:
                before, l = l, x * p + (1 - x) * (l + t)
                t = y * (l - before) + (1 - y) * t
                done.append(l + t)
            if is_last:
                done[-1] = v[-1] + t
            out.append(done)
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.float64()))], ["label_key", "labels", "ts", "value"])


def _keeping_steps(tree: object) -> object:
    """A tree whose clauses keep the label of a subquery's step."""
    if isinstance(tree, ast.Aggregation):
        by = tree.by if tree.by is not None or tree.without is not None else ()
        return replace(tree, of=_keeping_steps(tree.of), by=(*by, STEP) if by is not None else None)
    if isinstance(tree, ast.Binary):
        return replace(tree, left=_keeping_steps(tree.left), right=_keeping_steps(tree.right), on=(*tree.on, STEP) if tree.on is not None else None)
    if isinstance(tree, ast.Negative):
        return replace(tree, of=_keeping_steps(tree.of))
    if isinstance(tree, ast.Call):
        if tree.name in ("time", "scalar", "absent", "absent_over_time", "vector", "predict_linear"):
            raise ExpressionError(f"{tree.name} within a subquery")
        return replace(tree, args=tuple(_keeping_steps(a) for a in tree.args))
    return tree


@dataclass
class MetricEngine:
    """Compiles expressions over ``metrics`` (name, labels, ts, value).

    ``start`` and ``end`` bound the points of selectors, both included; ``eval_ts`` is the time that ranges
    end at and that folded results carry (now, unless given). ``compat`` gives the reading of ``deriv`` that
    divides by the time span once more, and ``increase`` as last minus first. ``approximate`` takes quantiles
    from mergeable sketches (rank error 1 in 10,000) where a group is too large for exact ones.
    """

    metrics: DataFrame
    eval_ts: dt.datetime | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    pairing: str = "position"
    compat: bool = False
    approximate: bool = False
    #: step, range and end in seconds of the subquery that is being computed
    grid: tuple[float, float, float] | None = None
    _now: dt.datetime = field(init=False)

    def __post_init__(self) -> None:
        self._now = self.eval_ts or dt.datetime.now(dt.timezone.utc)

    @property
    def now(self) -> Column:
        return F.lit(self._now).cast("timestamp")

    def query(self, expression: str) -> DataFrame:
        """The vector of an expression; a number gives one point without labels."""
        out = self.compile(ast.parse(expression))
        if isinstance(out, Scalar):
            return self._one(out.value)
        return out.select(*COLUMNS)

    def compile(self, tree: object) -> DataFrame | Scalar:
        if isinstance(tree, ast.Number):
            return Scalar(F.lit(tree.value))
        if isinstance(tree, ast.Selector):
            return self.select(tree)
        if isinstance(tree, ast.Negative):
            inner = self.compile(tree.of)
            return Scalar(-inner.value) if isinstance(inner, Scalar) else inner.withColumn("value", -F.col("value"))
        if isinstance(tree, ast.Binary):
            return self._binary(tree)
        if isinstance(tree, ast.Aggregation):
            return self._aggregate(tree)
        if isinstance(tree, ast.Call):
            return self._call(tree)
        if isinstance(tree, ast.Subquery):
            return self._subquery(tree)
        raise ExpressionError(f"cannot compute {tree!r}")

    def _one(self, value: Column) -> DataFrame:
        spark = self.metrics.sparkSession
        return spark.range(1).select(F.lit("").alias("label_key"), _no_labels().alias("labels"), self.now.alias("ts"), value.cast("double").alias("value"))

    def _vector(self, tree: object) -> DataFrame:
        out = self.compile(tree)
        if isinstance(out, Scalar):
            raise ExpressionError("a vector expected, not a number")
        return out

    def _scalar(self, tree: object) -> Column:
        if isinstance(tree, ast.Text):
            raise ExpressionError("a number expected, not a text")
        out = self.compile(tree)
        if not isinstance(out, Scalar):
            raise ExpressionError("a number expected, not a vector")
        return out.value

    # selectors

    def select(self, s: ast.Selector) -> DataFrame:
        """Points of a selector. Regular expressions match whole values; a missing label counts as ''."""
        df = self.metrics
        if s.name is not None:
            df = df.filter(F.col("name") == s.name)
        for m in s.matchers:
            value = F.coalesce(F.col("name") if m.label == "__name__" else F.col("labels")[m.label], F.lit(""))
            if m.op in ("=~", "!~"):
                test = value.rlike(f"^(?:{m.value})$")
            else:
                test = value == m.value
            df = df.filter(~test if m.op.startswith("!") else test)
        ts = F.col("ts")
        if s.offset_s:
            ts = ts + F.expr(f"make_dt_interval(0, 0, 0, {s.offset_s})")
        df = df.select("labels", ts.alias("ts"), "value").filter(F.col("value").isNotNull())
        if self.start is not None:
            df = df.filter(F.col("ts") >= F.lit(self.start).cast("timestamp"))
        if self.end is not None:
            df = df.filter(F.col("ts") <= F.lit(self.end).cast("timestamp"))
        at = F.timestamp_seconds(F.lit(s.at_s)) if s.at_s is not None else self.now
        if self.grid is not None:
            return self._at_steps(df, s)
        if s.range_s is not None:
            df = df.filter((F.col("ts") > at - F.expr(f"make_dt_interval(0, 0, 0, {s.range_s})")) & (F.col("ts") <= at))
        elif s.at_s is not None:
            df = df.filter(F.col("ts") <= at)
        return df.withColumn("label_key", label_key(F.col("labels"))).select(*COLUMNS)

    # subqueries

    def _at_steps(self, df: DataFrame, s: ast.Selector) -> DataFrame:
        """Every point at all steps whose range it is in; without a range the last point of each series within LOOKBACK_S of a step.

        A point is repeated range / step times; steps outside those of the subquery are never made.
        """
        if s.at_s is not None:
            raise ExpressionError("@ within a subquery belongs to the subquery")
        step, width, end = self.grid
        low, high = int((end - width) // step) + 1, int(end // step)
        reach = s.range_s if s.range_s is not None else LOOKBACK_S
        t = _seconds(F.col("ts"))
        first = F.greatest(F.ceil(t / step), F.lit(low))
        last = F.least(F.ceil((t + reach) / step) - 1, F.lit(high))  # ranges are open at their start
        df = df.filter((t > (end - width) - reach) & (t <= end))
        steps = F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint")))
        rows = df.select("*", F.explode(steps).alias("__k")).withColumn("labels", F.map_concat("labels", F.create_map(F.lit(STEP), F.col("__k").cast("string"))))
        rows = rows.withColumn("label_key", label_key(F.col("labels")))
        if s.range_s is not None:
            return rows.select(*COLUMNS)
        return rows.groupBy("label_key").agg(F.first("labels").alias("labels"), F.max(_point()).alias("p")).select("label_key", "labels", "p.ts", "p.value")

    def _subquery(self, q: ast.Subquery) -> DataFrame:
        """Points of an expression at the multiples of the step in (end - range, end], each with the time of its step."""
        if self.grid is not None:
            raise ExpressionError("a subquery within a subquery")
        end = (q.at_s if q.at_s is not None else self._now.timestamp()) - q.offset_s
        inner = replace(self, grid=(q.step_s, q.range_s, end), eval_ts=self._now)
        out = inner.compile(_keeping_steps(q.of))
        if isinstance(out, Scalar):
            raise ExpressionError("a subquery of a number")
        time = F.timestamp_micros((F.col("labels")[STEP].cast("bigint") * F.lit(q.step_s * 1e6) + F.lit(q.offset_s * 1e6)).cast("bigint"))
        # of a step's points, where there are several, the last counts
        last = out.withColumn("__ts", time).groupBy("label_key").agg(F.first("labels").alias("labels"), F.first("__ts").alias("ts"), F.max_by("value", F.struct("ts", "value")).alias("value"))
        last = last.withColumn("labels", F.map_filter("labels", lambda k, _: k != STEP))
        return last.withColumn("label_key", label_key(F.col("labels"))).select(*COLUMNS)

    # operators

    def _binary(self, b: ast.Binary) -> DataFrame | Scalar:
        left, right = self.compile(b.left), self.compile(b.right)
        if b.op in ("and", "or", "unless"):
            if isinstance(left, Scalar) or isinstance(right, Scalar):
                raise ExpressionError(f"{b.op} needs vectors")
            return self._set(b, left, right)
        fn = compare if b.op in ("=", "!=", "<", ">", "<=", ">=") else arithmetic
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            return Scalar(fn(b.op, left.value.cast("double"), right.value.cast("double")))
        if isinstance(right, Scalar):
            return left.withColumn("value", fn(b.op, F.col("value"), right.value.cast("double")))
        if isinstance(left, Scalar):
            return right.withColumn("value", fn(b.op, left.value.cast("double"), F.col("value")))
        if b.many is not None:
            return self._many_to_one(b, left, right, fn)
        keyed_l, keyed_r = self._matching(b, left), self._matching(b, right)
        if self.pairing == "time":
            # points of one time, where a match has several, are paired in order
            on = ["__match", "ts", "__n"]
            order = Window.partitionBy("__match", "ts").orderBy("label_key", "value")
            keyed_l, keyed_r = (x.withColumn("__n", F.row_number().over(order)) for x in (keyed_l, keyed_r))
        else:
            on = ["__match", "__n"]
            keyed_l, keyed_r = self._number(keyed_l), self._number(keyed_r)
        joined = keyed_l.join(keyed_r.select(*on, F.col("value").alias("__right")), on)
        return joined.select("label_key", "labels", "ts", fn(b.op, F.col("value"), F.col("__right")).alias("value"))

    def _many_to_one(self, b: ast.Binary, left: DataFrame, right: DataFrame, fn: Callable) -> DataFrame:
        """Every series of the many side with the one series that matches it, of which it takes the labels in ``include``.

        Two series of the other side with one match are an error when the rows are computed.
        """
        many, one = (left, right) if b.many == "left" else (right, left)
        many, one = self._matching(b, many), self._matching(b, one)
        if self.pairing == "time":
            on = ["__match", "ts"]
        else:
            on = ["__match", "__n"]
            many, one = numbered(many, "__n"), numbered(one, "__n")
        one = one.groupBy(*on).agg(F.count(F.lit(1)).alias("__series"), F.first("value").alias("__other"), F.first("labels").alias("__labels"))
        joined = many.join(one, on)
        ours, other = F.col("value"), F.when(F.col("__series") == 1, F.col("__other")).otherwise(F.raise_error(F.lit("many series match on the side of one")).cast("double"))
        value = fn(b.op, ours, other) if b.many == "left" else fn(b.op, other, ours)
        labels = F.col("labels")
        if b.include:
            named = list(b.include)
            taken = F.map_filter("__labels", lambda k, _: k.isin(named))
            labels = F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(named)), taken)
        out = joined.select(labels.alias("labels"), "ts", value.alias("value"))
        return out.withColumn("label_key", label_key(F.col("labels"))).select(*COLUMNS)

    @staticmethod
    def _number(df: DataFrame) -> DataFrame:
        own = df.withColumnsRenamed({"label_key": "__own"}).withColumnsRenamed({"__match": "label_key"})
        return numbered(own, "__n").withColumnsRenamed({"label_key": "__match"}).withColumnsRenamed({"__own": "label_key"})

    @staticmethod
    def _matching(b: ast.Binary, df: DataFrame) -> DataFrame:
        """Adds the key that operands are matched on: all labels, those named by ``on``, or all but those of ``ignoring``."""
        if b.on is None and b.ignoring is None:
            return df.withColumn("__match", F.col("label_key"))
        named = list(b.on if b.on is not None else b.ignoring)
        keep = F.map_filter("labels", lambda k, _: k.isin(named) if b.on is not None else ~k.isin(named))
        return df.withColumn("__match", label_key(keep))

    def _set(self, b: ast.Binary, left: DataFrame, right: DataFrame) -> DataFrame:
        l, r = self._matching(b, left), self._matching(b, right)
        keys = r.select("__match").distinct()
        if b.op == "and":
            return l.join(keys, "__match", "left_semi").select(*COLUMNS)
        if b.op == "unless":
            return l.join(keys, "__match", "left_anti").select(*COLUMNS)
        return left.select(*COLUMNS).unionByName(r.join(l.select("__match").distinct(), "__match", "left_anti").select(*COLUMNS))

    # aggregations

    def _aggregate(self, a: ast.Aggregation) -> DataFrame:
        df = self._vector(a.of)
        if a.op in ("topk", "bottomk"):
            return self._ranked(df, a)
        if a.op == "count_values":
            if not isinstance(a.parameter, ast.Text):
                raise ExpressionError("count_values needs a label")
            label = a.parameter.value
            kept = F.map_filter("labels", lambda k, _: k == label)
            df = df.withColumn("labels", kept)
        elif a.by is not None:
            df = df.withColumn("labels", F.map_filter("labels", lambda k, _: k.isin(list(a.by))))
        elif a.without is not None:
            df = df.withColumn("labels", F.map_filter("labels", lambda k, _: ~k.isin(list(a.without))))
        else:
            df = df.withColumn("labels", _no_labels())
        df = df.withColumn("label_key", label_key(F.col("labels")))
        value = F.col("value")
        n = F.count(F.lit(1))
        folds = {
            "sum": F.sum(value), "min": F.min(value), "max": F.max(value), "avg": F.avg(value), "group": F.max(F.lit(1.0)),
            "stddev": F.stddev_pop(value), "stdvar": F.var_pop(value), "count": n.cast("double"), "count_values": n.cast("double"),
        }
        if a.op == "quantile":
            if not isinstance(a.parameter, ast.Number):
                raise ExpressionError("quantile needs a number")
            share = a.parameter.value
            if not 0 <= share <= 1:
                return df.groupBy("label_key").agg(F.first("labels").alias("labels"), F.lit(-INF if share < 0 else INF).alias("value")).withColumn("ts", self.now)
            # nearest rank; the point of that value that comes first gives the time
            if self.approximate:
                ranked = df.groupBy("label_key").agg(self._sketch(value, share).alias("__q"))
            else:
                ranked = at_ranks(df, share, lambda n: [F.greatest(F.ceil(F.lit(share) * n - 1e-9), F.lit(1))]).select("label_key", F.get("found", F.lit(0)).alias("__q"))
            found = df.join(ranked, "label_key").filter(value == F.col("__q"))
            return found.groupBy("label_key").agg(F.first("labels").alias("labels"), F.min("ts").alias("ts"), F.first("value").alias("value"))
        if a.op not in folds:
            raise ExpressionError(f"no such aggregation: {a.op}")
        out = df.groupBy("label_key").agg(F.first("labels").alias("labels"), folds[a.op].alias("value"))
        return out.withColumn("ts", self.now)

    def _ranked(self, df: DataFrame, a: ast.Aggregation) -> DataFrame:
        """The k largest or smallest points within each series (or group of ``by``); earlier points first among equals."""
        if not isinstance(a.parameter, ast.Number):
            raise ExpressionError(f"{a.op} needs a number")
        key = "label_key"
        if a.by is not None or a.without is not None:
            named, by = list(a.by if a.by is not None else a.without), a.by is not None
            df = df.withColumn("__group", label_key(F.map_filter("labels", lambda k, _: k.isin(named) if by else ~k.isin(named))))
            key = "__group"
        order = F.col("value").desc() if a.op == "topk" else F.col("value").asc()
        rank = F.row_number().over(Window.partitionBy(key).orderBy(order, "ts", "label_key"))
        return df.withColumn("__rank", rank).filter(F.col("__rank") <= int(a.parameter.value)).select(*COLUMNS)

    # functions

    def _call(self, c: ast.Call) -> DataFrame | Scalar:
        name, args = c.name, c.args
        if name == "pi":
            return Scalar(F.pi())
        if name == "time":
            return Scalar(_seconds(self.now))
        if name == "vector":
            return self._one(self._scalar(args[0]))
        if name in VALUES:
            return self._vector(args[0]).withColumn("value", VALUES[name](F.col("value")))
        if name in DATES:
            df = self._vector(args[0]) if args else self._one(F.lit(0.0))
            return df.withColumn("value", DATES[name](F.col("ts")).cast("double"))
        if name in LIMITS:
            least, fn = LIMITS[name]
            if len(args) - 1 < least:
                raise ExpressionError(f"{name} with {len(args)} arguments")
            limits = [self._scalar(a).cast("double") for a in args[1:]]
            return self._vector(args[0]).withColumn("value", fn(F.col("value"), *limits))
        if name in ("quantile_over_time", "holt_winters", "predict_linear"):
            first = isinstance(args[0], ast.Number)  # both orders of arguments are read
            series, numbers = (args[-1], args[:-1]) if first else (args[0], args[1:])
            return getattr(self, f"_f_{name}")(self._vector(series), *[self._scalar(x).cast("double") for x in numbers])
        method = getattr(self, f"_f_{name}", None)
        if method is None:
            raise ExpressionError(f"no such function: {name}")
        texts = [a.value for a in args[1:] if isinstance(a, ast.Text)]
        return method(self._vector(args[0]), *texts)

    def _fold(self, df: DataFrame, *columns: Column) -> DataFrame:
        return df.groupBy("label_key").agg(F.first("labels").alias("labels"), *columns)

    def _over_time(self, df: DataFrame, value: Column) -> DataFrame:
        return self._fold(df, value.cast("double").alias("value")).withColumn("ts", self.now)

    @staticmethod
    def _sketch(value: Column, share: Column | float) -> Column:
        return F.percentile_approx(value, share, 10_000)

    def _f_avg_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.avg("value"))

    def _f_min_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.min("value"))

    def _f_max_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.max("value"))

    def _f_sum_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.sum("value"))

    def _f_count_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.count(F.lit(1)))

    def _f_stddev_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.stddev_pop("value"))

    def _f_stdvar_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.var_pop("value"))

    def _f_present_over_time(self, df: DataFrame) -> DataFrame:
        return self._over_time(df, F.max(F.lit(1.0)))

    def _f_last_over_time(self, df: DataFrame) -> DataFrame:
        return self._fold(df, F.max(_point()).alias("p")).select("label_key", "labels", "p.ts", "p.value")

    def _f_quantile_over_time(self, df: DataFrame, share: Column) -> DataFrame:
        """The value of rank round(share * n), the lowest where that is 0; NaN beyond the last."""
        if self.approximate:
            return self._over_time(df, self._sketch(F.col("value"), share))
        rank = lambda n: [F.greatest(F.round(share * n), F.lit(1))]
        return at_ranks(df, share, rank).select("label_key", "labels", F.coalesce(F.get("found", F.lit(0)), F.lit(NAN)).alias("value"), self.now.alias("ts"))

    def _f_mad_over_time(self, df: DataFrame) -> DataFrame:
        def median(df: DataFrame) -> DataFrame:
            if self.approximate:
                return self._fold(df, self._sketch(F.col("value"), 0.5).alias("__m"))
            found = at_ranks(df, F.lit(0.5), lambda n: [F.ceil(n / 2), F.floor(n / 2) + 1])
            return found.select("label_key", "labels", ((F.get("found", F.lit(0)) + F.get("found", F.lit(1))) / 2).alias("__m"))

        away = df.join(median(df).select("label_key", "__m"), "label_key").withColumn("value", F.abs(F.col("value") - F.col("__m"))).drop("__m")
        return median(away).select("label_key", "labels", self.now.alias("ts"), F.col("__m").alias("value"))

    def _f_changes(self, df: DataFrame) -> DataFrame:
        return neighbours(df, _differs).select("label_key", "labels", self.now.alias("ts"), F.col("total").alias("value"))

    def _f_resets(self, df: DataFrame) -> DataFrame:
        return neighbours(df, _falls).select("label_key", "labels", self.now.alias("ts"), F.col("total").alias("value"))

    def _ends(self, df: DataFrame) -> DataFrame:
        return self._fold(df, F.min(_point()).alias("a"), F.max(_point()).alias("z"), F.count(F.lit(1)).alias("n"))

    def _f_delta(self, df: DataFrame) -> DataFrame:
        return self._ends(df).select("label_key", "labels", F.col("z.ts").alias("ts"), (F.col("z.value") - F.col("a.value")).alias("value"))

    def _f_increase(self, df: DataFrame) -> DataFrame:
        if self.compat:
            return self._f_delta(df)
        gained = F.when(F.col("n") < 2, F.col("last.value")).otherwise(F.col("total"))
        return neighbours(df, _rises).select("label_key", "labels", F.col("last.ts").alias("ts"), gained.alias("value"))

    def _f_rate(self, df: DataFrame) -> DataFrame:
        """(last - first) / seconds between them; a single point stays as it is, points at one time give NaN."""
        span = _seconds(F.col("z.ts")) - _seconds(F.col("a.ts"))
        slope = F.when(span > 0, (F.col("z.value") - F.col("a.value")) / span).otherwise(NAN)
        value = F.when(F.col("n") < 2, F.col("z.value")).otherwise(slope)
        return self._ends(df).select("label_key", "labels", F.col("z.ts").alias("ts"), value.alias("value"))

    def _last_two(self, df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("label_key").orderBy(F.col("ts").desc(), F.col("value").desc()))
        last = df.withColumn("__rank", rank).filter(F.col("__rank") <= 2)
        return last.groupBy("label_key").agg(
            F.first("labels").alias("labels"), F.max_by(_point(), F.lit(0) - F.col("__rank")).alias("z"),
            F.max_by(_point(), "__rank").alias("y"), F.count(F.lit(1)).alias("n"),
        )

    def _f_idelta(self, df: DataFrame) -> DataFrame:
        value = F.when(F.col("n") < 2, F.col("z.value")).otherwise(F.col("z.value") - F.col("y.value"))
        return self._last_two(df).select("label_key", "labels", F.col("z.ts").alias("ts"), value.alias("value"))

    def _f_irate(self, df: DataFrame) -> DataFrame:
        """Slope of the last two points; the last value where there is one point, or both have one time."""
        span = _seconds(F.col("z.ts")) - _seconds(F.col("y.ts"))
        value = F.when((F.col("n") < 2) | (span <= 0), F.col("z.value")).otherwise((F.col("z.value") - F.col("y.value")) / F.when(span > 0, span))
        return self._last_two(df).select("label_key", "labels", F.col("z.ts").alias("ts"), value.alias("value"))

    def _line(self, df: DataFrame) -> DataFrame:
        t = _seconds(F.col("ts"))
        return self._fold(
            df, F.regr_slope("value", t).alias("slope"), F.avg("value").alias("v"), F.avg(t).alias("t"), F.min(t).alias("t0"),
            F.max(t).alias("t1"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"),
        )

    def _f_deriv(self, df: DataFrame) -> DataFrame:
        slope = F.coalesce("slope", F.lit(NAN))
        if self.compat:
            slope = F.when(F.col("t1") > F.col("t0"), slope / F.when(F.col("t1") > F.col("t0"), F.col("t1") - F.col("t0"))).otherwise(NAN)
        return self._line(df).select("label_key", "labels", "ts", F.when(F.col("n") < 2, NAN).otherwise(slope).alias("value"))

    def _f_predict_linear(self, df: DataFrame, at: Column) -> DataFrame:
        """The fitted line at the absolute time ``at`` (seconds); a single point stays as it is."""
        value = F.when(F.col("n") < 2, F.col("v")).otherwise(F.col("v") + F.col("slope") * (at - F.col("t")))
        return self._line(df).select("label_key", "labels", F.timestamp_seconds(at).alias("ts"), F.coalesce(value, F.lit(NAN)).alias("value"))

    def _f_holt_winters(self, df: DataFrame, alpha: Column, beta: Column) -> DataFrame:
        """Every point gives the forecast for the next one, the last its value plus the trend.

        A step is linear in level and trend, so the steps of a day are one matrix and one vector. Days are
        summed up so, their start states follow from a fold over days, and then each day is smoothed by itself.
        """
        days = df.groupBy("label_key", F.to_date("ts").alias("__day")).agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(_point())).alias("__p"))

        def step(s: Column, v: Column) -> tuple[Column, Column]:
            level = alpha * v + (1 - alpha) * (s["l"] + s["b"])
            return level, beta * (level - s["l"]) + (1 - beta) * s["b"]

        def state(level: Column, trend: Column) -> Column:
            return F.struct(level.cast("double").alias("l"), trend.cast("double").alias("b"))

        def run(points: Column, start: Column, zero: bool = False) -> Column:
            return F.aggregate(points, start, lambda s, p: state(*step(s, F.lit(0.0) if zero else p["value"])))

        def whole(points: Column) -> Column:
            one, none = F.lit(1.0), F.lit(0.0)
            return F.struct(run(points, state(one, none), True).alias("x"), run(points, state(none, one), True).alias("y"), run(points, state(none, none)).alias("w"))

        rest = lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
        sums = days.select(
            "label_key", F.struct(F.col("__day").alias("day"), F.get("__p", F.lit(0))["value"].alias("v0"), F.get("__p", F.lit(1))["value"].alias("v1"), whole(F.col("__p")).alias("all"), whole(rest("__p")).alias("tail")).alias("d")
        )
        folded = sums.groupBy("label_key").agg(F.array_sort(F.collect_list("d")).alias("d"))
        first = F.get("d", F.lit(0))
        second = F.coalesce(first["v1"], F.get("d", F.lit(1))["v0"], first["v0"])
        spot = "array<struct<day:date,l:double,b:double,first:boolean>>"
        begin = F.struct(first["v0"].alias("l"), (second - first["v0"]).alias("b"), F.array().cast(spot).alias("out"))

        def over(s: Column, d: Column) -> Column:
            is_first = F.size(s["out"]) == 0
            m = F.when(is_first, d["tail"]).otherwise(d["all"])
            move = lambda k: m["x"][k] * s["l"] + m["y"][k] * s["b"] + m["w"][k]
            here = F.struct(d["day"].alias("day"), s["l"].alias("l"), s["b"].alias("b"), is_first.alias("first"))
            return F.struct(move("l").alias("l"), move("b").alias("b"), F.concat(s["out"], F.array(here)).alias("out"))

        starts = folded.select("label_key", F.element_at("d", -1)["day"].alias("__end"), F.inline(F.aggregate("d", begin, over)["out"]).alias("__day", "__l", "__b", "__first"))
        joined = days.join(starts, ["label_key", "__day"])
        levels = joined.select("label_key", "labels", F.col("__p.ts").alias("ts"), F.col("__p.value").alias("value"), "__l", "__b", "__first", (F.col("__day") == F.col("__end")).alias("__last"), alpha.alias("__alpha"), beta.alias("__beta"))
        smoothed = levels.mapInArrow(_smoothed, "label_key string, labels map<string,string>, ts array<timestamp>, value array<double>")
        return smoothed.select("label_key", "labels", F.inline(F.arrays_zip("ts", "value")).alias("ts", "value"))

    def _f_sort(self, df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("value").asc(), "label_key", "ts")

    def _f_sort_desc(self, df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("value").desc(), "label_key", "ts")

    def _absent(self, df: DataFrame) -> DataFrame:
        labels = F.create_map(F.lit("absent"), F.lit("true"))
        some = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
        return some.select(F.lit("absent=true").alias("label_key"), labels.alias("labels"), self.now.alias("ts"), F.lit(1.0).alias("value"))

    _f_absent = _f_absent_over_time = _absent

    def _f_scalar(self, df: DataFrame) -> DataFrame:
        """The first value of a single series, else NaN, as a point without labels."""
        two = df.groupBy("label_key").agg(F.min(_point()).alias("p")).limit(2)
        value = F.when(F.col("n") == 1, F.col("v")).otherwise(NAN)
        out = two.agg(F.count(F.lit(1)).alias("n"), F.max("p.value").alias("v"))
        return out.select(F.lit("").alias("label_key"), _no_labels().alias("labels"), self.now.alias("ts"), value.alias("value"))

    def _relabel(self, df: DataFrame, label: str, value: Column, when: Column | None = None) -> DataFrame:
        rest = F.map_filter("labels", lambda k, _: k != label)
        new = F.map_concat(rest, F.create_map(F.lit(label), value))
        labels = new if when is None else F.when(when, new).otherwise(F.col("labels"))
        return df.withColumn("labels", labels).withColumn("label_key", label_key(F.col("labels"))).select(*COLUMNS)

    def _f_label_join(self, df: DataFrame, label: str, separator: str, *sources: str) -> DataFrame:
        parts = [F.coalesce(F.col("labels")[s], F.lit("")) for s in sources]
        return self._relabel(df, label, F.concat_ws(separator, *parts) if parts else F.lit(""))

    def _f_label_replace(self, df: DataFrame, label: str, replacement: str, source: str, pattern: str) -> DataFrame:
        """Every match of the pattern in the source is replaced; where it has none, or there is no source, labels stay."""
        value = F.col("labels")[source]
        to = re.sub(r"\$\{(\w+)\}", r"$\1", replacement)
        matches = F.coalesce(value.rlike(pattern), F.lit(False))
        return self._relabel(df, label, F.regexp_replace(value, pattern, to), matches)


def label_names(metrics: DataFrame) -> DataFrame:
    """Names of all labels, with ``__name__``."""
    names = metrics.select(F.explode(F.map_keys("labels")).alias("label")).distinct()
    return names.unionByName(metrics.filter("name is not null").limit(1).select(F.lit("__name__").alias("label")))


def label_values(metrics: DataFrame, label: str) -> DataFrame:
    """Values of one label."""
    value = F.col("name") if label == "__name__" else F.col("labels")[label]
    return metrics.select(value.alias("value")).filter("value is not null").distinct()


def newest_first(vector: DataFrame) -> DataFrame:
    """Series in the order of their latest point, newest first, points in order of time."""
    latest = vector.groupBy("label_key").agg(F.max("ts").alias("__latest"))
    return vector.join(latest, "label_key").orderBy(F.col("__latest").desc(), "label_key", "ts", "value").select(*vector.columns)


def unite(vectors: list[DataFrame]) -> DataFrame:
    """All points of several vectors."""
    return reduce(DataFrame.unionByName, vectors)
