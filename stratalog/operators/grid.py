"""Irregular readings onto a regular grid, by local polynomial regression with a compact kernel.

A period of a series is evaluated at its middle from the readings within a bandwidth, found by
binary search in the sorted readings and weighted by the Epanechnikov kernel; a straight line is
fitted to them and its value at the middle is the period's value. The effective support is
``(sum w)^2 / sum w^2``. A period without readings of its own is filled where the support suffices
and marked missing where it doesn't.

The grid is cut into blocks of periods and readings near an edge go to both sides, so a series may
be of any length: no task gets more than a block of it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.sortedgroups import map_sorted_groups
from stratalog.schema import label_key, micros

GRID = "series_key string, period_start bigint, readings bigint, value double, support double, mark string"


def local_fit(x: np.ndarray, v: np.ndarray, at: np.ndarray, bandwidth: float) -> tuple[np.ndarray, np.ndarray]:
    """Local linear fits at ``at`` from sorted ``x``: values (NaN without support) and effective supports."""
    low, high = np.searchsorted(x, at - bandwidth, "right"), np.searchsorted(x, at + bandwidth, "left")
    n = len(at)
    s0, s1, s2, r0, r1, w2 = (np.zeros(n) for _ in range(6))
    left = np.arange(n)
    for k in range(int((high - low).max()) if n else 0):
        left = left[low[left] + k < high[left]]
        i = low[left] + k
        d = x[i] - at[left]
        w = 1.0 - (d / bandwidth) ** 2
        s0[left] += w
        s1[left] += w * d
        s2[left] += w * d * d
        r0[left] += w * v[i]
        r1[left] += w * d * v[i]
        w2[left] += w * w
    with np.errstate(all="ignore"):
        det = s0 * s2 - s1 * s1
        line = (s2 * r0 - s1 * r1) / det
        value = np.where(det > 1e-9 * s0 * s0 * bandwidth * bandwidth, line, r0 / s0)
        support = np.where(w2 > 0, s0 * s0 / w2, 0.0)
    return np.where(s0 > 0, value, np.nan), support


def _evaluate(table: pa.Table, starts: np.ndarray, block: int, bandwidth: float, least: float) -> pa.Table:
    """Grid rows of whole blocks. The first row of a group is its summary, the rest are readings in order of time."""
    kind = table.column("kind").to_numpy()
    n = table.num_rows
    group = np.zeros(n, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    heads = starts
    low, high = table.column("low").to_numpy()[heads], table.column("high").to_numpy()[heads]
    step = table.column("step").to_numpy()[heads]
    first = table.column("block").to_numpy()[heads] * block
    keys = table.column("series_key").take(pa.array(heads))
    size = (high - low + 1).astype(np.int64)
    of = np.repeat(np.arange(len(heads)), size)
    period = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
    # readings: one a time, in periods since the start of the block
    rows = np.flatnonzero(kind == 1)
    t, v, g = table.column("t").to_numpy()[rows], table.column("v").to_numpy()[rows], group[rows]
    new = np.ones(len(rows), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    t, v, g = t[new], v[new], g[new]
    x = (t - first[g] * step[g]) / step[g]
    width = 2.0 * block + 4 * bandwidth + 4
    own = np.floor_divide(t, step[g])
    at = np.searchsorted(g * width + (own - first[g]), of * width + (period - first[of]), "left")
    beyond = np.searchsorted(g * width + (own - first[g]), of * width + (period - first[of]), "right")
    readings = beyond - at
    finite = np.isfinite(v)
    value, support = local_fit((g * width + x)[finite], v[finite], of * width + (period - first[of]) + 0.5, bandwidth)
    enough = (support >= least) & np.isfinite(value)
    mark = np.where(readings > 0, "observed", np.where(enough, "filled", "missing"))
    shown = np.isfinite(value) & ((readings > 0) | enough)
    return pa.table(
        {
            "series_key": keys.take(pa.array(of)),
            "period_start": pa.array(period * (step[of] // 1_000_000), pa.int64()),
            "readings": pa.array(readings, pa.int64()),
            "value": pa.array(np.where(shown, value, 0.0), pa.float64(), mask=~shown),
            "support": pa.array(support, pa.float64()),
            "mark": pa.array(mark, pa.string()),
        }
    )


def regular_grid(
    stretches: DataFrame,
    intervals: DataFrame,
    bandwidth: float = 3.0,
    least_support: float = 2.0,
    block: int = 512,
) -> DataFrame:
    """One row for every period of every series between its first and its last period with a reading.

    ``stretches``: labels and metric_points (time, value); stretches of a series come in any number and
    order. ``intervals``: job, interval_s; joined by broadcast up to 10,000 rows. Result: GRID; ``mark`` is
    observed, filled or missing, ``value`` is null where missing, ``bandwidth`` counts periods.

    Null and NaN values and null times are no readings; infinite values are readings that no fit uses;
    of readings of one series at one time one counts. Series without readings, with a job that has no
    interval or an interval below one second give no rows, empty tables none either.
    """
    known = intervals.filter(F.col("interval_s") > 0).select(F.col("job").alias("__job"), F.col("interval_s").cast("bigint").alias("__s")).dropDuplicates(["__job"])
    known = F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known
    series = (
        stretches.select(label_key(F.col("labels")).alias("series_key"), F.col("labels")["job"].alias("__job"), "metric_points")
        .join(known, "__job")
        .select("series_key", (F.col("__s") * 1_000_000).alias("step"), F.explode("metric_points").alias("p"))
        .filter(F.col("p.time").isNotNull() & F.col("p.value").isNotNull() & ~F.isnan("p.value"))
        .select(
            F.xxhash64("series_key").alias("h1"), F.hash("series_key").alias("h2"), "series_key", "step",
            micros(F.col("p.time")).alias("t"), F.col("p.value").cast("double").alias("v"),
        )
        .withColumn("period", F.floor(F.col("t") / F.col("step")).cast("bigint"))
    )
    spans = series.groupBy("h1", "h2").agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.min("series_key").alias("series_key"), F.min("step").alias("step")
    )
    of_block = lambda c: F.floor(c / F.lit(block)).cast("bigint")
    heads = spans.withColumn("block", F.explode(F.sequence(of_block(F.col("first")), of_block(F.col("last"))))).select(
        "h1", "h2", "block", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("t"), F.lit(0.0).alias("v"), "step",
        F.greatest("first", F.col("block") * block).alias("low"), F.least("last", F.col("block") * block + (block - 1)).alias("high"), "series_key",
    )
    reach = int(np.ceil(bandwidth))
    near = F.array_distinct(F.array(*[of_block(F.col("period") + d) for d in (-reach, 0, reach)]))
    readings = series.select("h1", "h2", F.explode(near).alias("block"), F.lit(1).alias("kind"), "t", "v", "step")
    nothing = F.lit(0).cast("bigint")
    readings = readings.select("*", nothing.alias("low"), nothing.alias("high"), F.lit("").alias("series_key"))
    both = heads.unionByName(readings)
    # a reading near the end of a series may be sent to a block beyond it, which has no head and is dropped there
    return map_sorted_groups(
        both, ["h1", "h2", "block"], ["kind", "t", "v"],
        lambda table, starts: _evaluate(*_with_heads(table, starts), block, bandwidth, least_support), GRID,
    )


def _with_heads(table: pa.Table, starts: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Leaves out groups that have no summary row."""
    kind = table.column("kind").to_numpy()
    good = kind[starts] == 0
    if good.all():
        return table, starts
    size = np.diff(np.concatenate([starts, [table.num_rows]]))
    keep = np.repeat(good, size)
    rest = size[good]
    return table.filter(pa.array(keep)), np.cumsum(rest) - rest
