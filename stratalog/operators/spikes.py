"""Implausible readings of many sources: a Kalman filter per source, then an exact check.

Each source is followed by a state-space model of level and slope. A reading whose standardised
innovation is above a threshold is flagged and withheld from the update; after four in a row the
level has moved for good and the filter starts again there. Where the variance of the innovations
vanishes, the source is stuck. Flags are candidates: the exact check keeps short departures that
return to their level and runs of equal values in sources that otherwise change.

The filters of many sources run side by side: readings are laid out as one column a source and the
recursion goes over time with vectors over sources.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.operators.sortedgroups import map_sorted_groups
from stratalog.schema import label_key, micros
from stratalog.session import cut

FLAGS = "entry_id bigint, kind string, score double"
#: equal values in a row that make a source stuck
STUCK = 10


def kalman(
    times: np.ndarray, values: np.ndarray, lengths: np.ndarray, scale: np.ndarray, counter: np.ndarray,
    threshold: float = 5.0, patience: int = 3,
) -> tuple[np.ndarray, np.ndarray]:
    """Scores of standardised innovations and marks of vanished innovation variance.

    ``times`` (in steps) and ``values`` are matrices of time by source, filled up to ``lengths``.
    ``scale`` is the usual change between readings. Counters have a slope, gauges none. The score is
    the standardised innovation where the reading was withheld, or is a candidate for the exact check
    all the same: its innovation is over ``threshold`` times ``scale``, which the variance of a long
    gap would hide, or a counter's course is too uncertain after a gap to tell. Else it is 0.
    """
    steps, n = values.shape
    r = np.maximum(scale, 1e-300) ** 2
    level, slope = values[0].copy(), np.zeros(n)
    p11, p12, p22 = r * 1.0, np.zeros(n), np.where(counter, 4 * r, 0.0)
    q_level, q_slope = 0.3 * r, np.where(counter, 0.05 * r, 0.0)
    scores, still = np.zeros((steps, n)), np.zeros((steps, n), bool)
    withheld = np.zeros(n, np.int64)
    fast, variance = values[0].copy(), 4 * r
    if steps > 1:
        # a slope to begin with: the median of the first changes, so a restart or spike there does no harm
        k = min(8, steps)
        dt = np.maximum(times[1:k] - times[: k - 1], 1e-9)
        first = np.where(np.arange(1, k)[:, None] < lengths, (values[1:k] - values[: k - 1]) / dt, np.nan)
        with np.errstate(all="ignore"):
            begin = np.nanmedian(first, axis=0)
            start = np.nanmedian(np.where(np.arange(k)[:, None] < np.minimum(lengths, 5), values[:k], np.nan), axis=0)
        slope = np.where(counter & np.isfinite(begin), begin, 0.0)
        level = np.where(counter, level, start)
        far = ~counter & (np.abs(values[0] - start) > 8 * scale)
        scores[0] = np.where(far, threshold + 1, 0.0)
    for t in range(1, steps):
        live = t < lengths
        dt = np.where(live, np.clip(times[t] - times[t - 1], 0.0, 1e6), 0.0)
        # predict
        level_p = level + slope * dt
        a11 = p11 + dt * (2 * p12 + dt * p22) + q_level * np.minimum(dt, 50.0)
        a12 = p12 + dt * p22
        a22 = p22 + q_slope * np.minimum(dt, 50.0)
        e = values[t] - level_p
        s = a11 + r
        z = np.abs(e) / np.sqrt(s)
        bad = live & (z > threshold)
        withheld = np.where(bad, withheld + 1, np.where(live, 0, withheld))
        moved = bad & (withheld > patience)
        use = live & ~bad
        g1, g2 = a11 / s, a12 / s
        level = np.where(moved, values[t], np.where(use, level_p + g1 * e, level_p))
        slope = np.where(use, slope + g2 * e, slope)
        p11 = np.where(moved, r, np.where(use, (1 - g1) * a11, a11))
        p12 = np.where(moved, 0.0, np.where(use, (1 - g1) * a12, a12))
        p22 = np.where(moved & counter, r, np.where(use, a22 - g2 * a12, a22))
        near = live & ((np.abs(e) > threshold * scale) | (counter & (a11 > 2 * r)))
        scores[t] = np.where(bad | near, np.maximum(z, 1e-9), 0.0)
        withheld = np.where(moved, 0, withheld)
        # a quick filter of the level alone, whose innovations die out when nothing moves
        d = values[t] - fast
        fast = np.where(live, fast + 0.9 * d, fast)
        variance = np.where(live, 0.5 * variance + 0.5 * d * d, variance)
        still[t] = live & (variance < 0.02 * r)
    return scores, still


def _equal_runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(v[1:] != v[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(v)]])


def _free_pairs(v: np.ndarray, stuck: int) -> tuple[np.ndarray, np.ndarray]:
    """Successive readings that are both outside runs of ``stuck`` equal values, and those of them that differ."""
    starts, ends = _equal_runs(v)
    size = ends - starts
    free = np.repeat(size < stuck, size)
    pairs = free[1:] & free[:-1]
    return pairs, pairs & (v[1:] != v[:-1])


def _is_lively(pairs: int, changes: int) -> bool:
    """Whether a source's value otherwise changes at most readings."""
    return pairs >= 5 and changes * 2 > pairs


def check_source(
    t: np.ndarray, v: np.ndarray, scores: np.ndarray, still: np.ndarray, counter: bool, usual: float,
    factor: float = 10.0, longest: int = 3, stuck: int = STUCK, around: int = 5, lively: bool | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """The exact check of one source's candidates: masks of spikes and of stuck readings.

    A spike is a run of at most ``longest`` readings, each further than ``factor`` times ``usual``
    from the level of the readings around it (a counter's rising course), where the readings after
    come back to that level. A stuck run has at least ``stuck`` equal values, in a source where most
    other successive readings differ; ``lively`` says so for a part of a source, None means to count.
    """
    n = len(v)
    spike, frozen = np.zeros(n, bool), np.zeros(n, bool)
    if n < 3:
        return spike, frozen
    limit = factor * usual
    marked = scores > 0
    candidates = np.flatnonzero(marked)
    at = 0
    while at < len(candidates):
        i = int(candidates[at])
        at += 1
        if spike[i]:
            continue
        before = np.arange(max(0, i - around), i)
        before = before[~spike[before]]
        if len(before) == 0:
            continue
        for width in range(1, longest + 1):
            j = i + width
            if j >= n:
                break
            run, after = slice(i, j), np.arange(j, min(n, j + around))
            if counter:
                tb, vb, ta, va = t[before[-1]], v[before[-1]], t[after], v[after]
                rate = _rate(t, v, before, after)
                back = va - (vb + rate * (ta - tb))
                slack = limit + 0.5 * rate * (ta[0] - tb)
                returned = va[0] >= vb and abs(back[0]) <= slack
                course = vb + (va[0] - vb) * (t[run] - tb) / max(ta[0] - tb, 1e-9)
                away = (np.abs(v[run] - course) > limit) & ((v[run] > va[0]) | (v[run] < vb))
            else:
                low = float(np.median(v[before]))
                near = np.abs(v[after] - low) <= limit
                # back means nearer to where it was than to where it went, else the level has moved
                drift = abs(float(np.median(v[after])) - low)
                returned = bool(near[0]) and drift <= 0.5 * float(np.abs(v[run] - low).min())
                level = float(np.median(v[np.concatenate([before, after[near]])])) if near.any() else low
                away = np.abs(v[run] - level) > limit
            if returned and away.all():
                spike[run] = True
                break
    if still.any():
        starts, ends = _equal_runs(v)
        size = ends - starts
        long = size >= stuck
        if long.any():
            if lively is None:
                lively = _is_lively(*(int(x.sum()) for x in _free_pairs(v, stuck)))
            if lively:
                for a, b in zip(starts[long], ends[long]):
                    if still[a:b].any():
                        frozen[a:b] = True
    return spike, frozen


def _rate(t: np.ndarray, v: np.ndarray, before: np.ndarray, after: np.ndarray) -> float:
    """A counter's usual rise per unit of time near a run: the median over successive readings at either side."""
    rates = []
    for side in (before, after):
        if len(side) > 1:
            dt = np.diff(t[side])
            rates.extend(np.diff(v[side])[dt > 0] / dt[dt > 0])
    rates = [x for x in rates if x >= 0]
    return float(np.median(rates)) if rates else 0.0


def _flag(table: pa.Table, starts: np.ndarray, threshold: float) -> pa.Table:
    """Flags of whole sources: see FLAGS. Rows come sorted by source, part, time and entry."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # medians of sources with a single reading
        return _flag_sources(table, starts, threshold)


def _flag_sources(table: pa.Table, starts: np.ndarray, threshold: float) -> pa.Table:
    n = table.num_rows
    time, value = table.column("t").to_numpy(), table.column("v").to_numpy()
    entry, counter = table.column("entry_id").to_numpy(), table.column("counter").to_numpy()
    low, high = table.column("low").to_numpy(), table.column("high").to_numpy()
    own = table.column("own").to_numpy()
    # of sources that are cut into parts, figures of the whole source: NaN and -1 where they are to be taken from the rows
    usual_given, moving_given, pace_given = (table.column(c).to_numpy() for c in ("usual", "moving", "pace"))
    lively_given = table.column("lively").to_numpy()
    group = np.zeros(n, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    impossible = ~np.isfinite(value) | (value < low) | (value > high)
    # rows of one reading: same source and time
    new = np.ones(n, bool)
    new[1:] = (group[1:] != group[:-1]) | (time[1:] != time[:-1])
    reading = np.cumsum(new) - 1
    n_readings = int(reading[-1]) + 1 if n else 0
    bad = np.zeros(n_readings, bool)
    np.logical_or.at(bad, reading, impossible)
    at = np.flatnonzero(new)
    good = np.flatnonzero(~bad)
    g, t, v = group[at][good], time[at][good] / 1e6, value[at][good]
    kind = np.zeros(n_readings, np.int8)
    kind[bad] = 1
    score = np.zeros(n_readings)
    if len(good):
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        length = np.diff(np.concatenate([first, [len(g)]]))
        order = np.argsort(length, kind="stable")
        # sources of like length side by side, at most a few million cells at a time
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and length[order[j]] <= max(16, 1.3 * length[order[i]]) and (j - i) * length[order[j]] < 2_000_000:
                j += 1
            block = order[i:j]
            i = j
            size = length[block]
            most = int(size.max())
            if most < 3:
                continue
            row = np.minimum(np.arange(most)[:, None], size - 1) + first[block]
            tm, vm = t[row], v[row]
            inside = np.arange(1, most)[:, None] < size
            change = np.where(inside, np.abs(np.diff(vm, axis=0)), np.nan)
            step = np.where(inside, np.diff(tm, axis=0), np.nan)
            with np.errstate(all="ignore"):
                usual = np.nanmedian(change, axis=0)
                moving = np.nanmedian(np.where(change > 0, change, np.nan), axis=0)
                pace = np.nanmedian(step, axis=0)
            head = at[good[first[block]]]
            usual = np.where(np.isfinite(usual_given[head]), usual_given[head], usual)
            moving = np.where(np.isfinite(moving_given[head]), moving_given[head], moving)
            pace = np.where(np.isfinite(pace_given[head]), pace_given[head], pace)
            scale = np.where(usual > 0, usual, np.where(np.isfinite(moving), moving, 1.0))
            pace = np.where(np.isfinite(pace) & (pace > 0), pace, 1.0)
            rising = counter[head].astype(bool)
            scores, still = kalman((tm - tm[0]) / pace, vm, size, scale, rising, threshold)
            # where the usual change is 0 the scale may be the spike's own, so every change is a candidate
            rare = inside & (usual == 0) & (change > 0)
            scores[1:] = np.where(rare, np.maximum(scores[1:], 1e-9), scores[1:])
            hit = np.flatnonzero(((scores > 0).any(axis=0)) | still.any(axis=0))
            for c in hit:
                k = int(size[c])
                where = slice(first[block[c]], first[block[c]] + k)
                lively = None if lively_given[head[c]] < 0 else bool(lively_given[head[c]])
                spike, frozen = check_source(t[where], v[where], scores[:k, c], still[:k, c], bool(rising[c]), float(usual[c]), lively=lively)
                target = good[where]
                kind[target[spike]], score[target[spike]] = 2, scores[:k, c][spike]
                kind[target[frozen]] = np.where(kind[target[frozen]] == 0, 3, kind[target[frozen]])
    out = np.flatnonzero((kind[reading] > 0) & own)
    names = np.array(["", "impossible", "spike", "stuck"], object)
    return pa.table(
        {
            "entry_id": pa.array(entry[out], pa.int64()),
            "kind": pa.array(names[kind[reading[out]]], pa.string()),
            "score": pa.array(score[reading[out]], pa.float64()),
        }
    )


def _long_sources(rows: DataFrame, part_rows: int) -> DataFrame:
    """Sources of more than ``part_rows`` rows: their number of parts, and slices of time to number their readings in."""
    span = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    many = span.filter(F.col("n") > part_rows).select(
        "h1", "h2", "t0", F.ceil(F.col("n") / part_rows).alias("parts"),
        F.greatest(F.lit(1), F.ceil((F.col("t1") - F.col("t0") + 1) / F.ceil(F.col("n") / part_rows))).cast("bigint").alias("width"),
    )
    return cut(many)


def _number_readings(rows: DataFrame, many: DataFrame) -> DataFrame:
    """Rows of the sources in ``many`` with ``place``, the number of their reading among the plausible ones
    of the source from 0, and its ``total``; ``first`` marks one row of a plausible reading, ``bad`` the
    rows of the others.

    Readings are numbered within slices of time and slices over one row each, so no task sorts a whole source.
    """
    own = rows.join(many, ["h1", "h2"]).withColumn("slice", F.floor((F.col("t") - F.col("t0")) / F.col("width"))).repartition("h1", "h2", "slice")
    reading = Window.partitionBy("h1", "h2", "slice", "t")
    wrong = F.isnan("v") | (F.abs("v") == float("inf")) | (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))
    own = own.withColumns({"bad": F.max(wrong).over(reading), "__nth": F.row_number().over(reading.orderBy("entry_id"))})
    own = own.withColumn("first", ~F.col("bad") & (F.col("__nth") == 1))
    # rows of one time are peers in the order of time, so all rows of a reading get one number
    own = own.withColumn("__in", F.sum(F.col("first").cast("bigint")).over(Window.partitionBy("h1", "h2", "slice").orderBy("t")))
    source = Window.partitionBy("h1", "h2")
    slices = own.groupBy("h1", "h2", "slice").agg(F.max("__in").alias("__n"))
    slices = slices.select(
        "h1", "h2", "slice", F.sum("__n").over(source).alias("total"),
        F.coalesce(F.sum("__n").over(source.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
    )
    return own.join(slices, ["h1", "h2", "slice"]).withColumn("place", F.greatest(F.lit(0), F.col("__before") + F.col("__in") - 1))


def _cut_sources(numbered: DataFrame, halo: int) -> DataFrame:
    """Numbered rows by parts of like numbers of readings, each with ``halo`` readings more at either end.

    Rows of implausible readings serve no other and are dealt out by their time.
    """
    size = F.greatest(F.lit(1), F.ceil(F.col("total") / F.col("parts"))).cast("bigint")
    of = lambda place: F.floor(place / size).cast("bigint")
    dealt = F.pmod(F.xxhash64("t"), F.col("parts")).cast("bigint")
    near = F.sequence(of(F.greatest(F.lit(0), F.col("place") - halo)), of(F.least(F.col("total") - 1, F.col("place") + halo)))
    split = numbered.withColumn("home", F.when(F.col("bad"), dealt).otherwise(of(F.col("place"))))
    split = split.withColumn("part", F.explode(F.when(F.col("bad"), F.array(dealt)).otherwise(near)))
    return split.withColumn("own", F.col("part") == F.col("home"))


def _usual_changes(numbered: DataFrame) -> DataFrame:
    """The usual change of whole sources, the usual of those that are none, and the usual time between readings.

    Approximate medians within slices of time.
    """
    before = Window.partitionBy("h1", "h2", "slice").orderBy("t")
    change, step = F.abs(F.col("v") - F.lag("v").over(before)), (F.col("t") - F.lag("t").over(before)) / 1e6
    median = lambda c: F.percentile_approx(c, 0.5, 10_000)
    return numbered.filter("first").select("h1", "h2", change.alias("change"), step.alias("step")).groupBy("h1", "h2").agg(
        median("change").alias("usual"), median(F.when(F.col("change") > 0, F.col("change"))).alias("moving"), median("step").alias("pace")
    )


def _count_pairs(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Pairs of a part's own readings outside long runs, and the changes among them."""
    v, own = table.column("v").to_numpy(), table.column("own").to_numpy()
    counts = []
    for a, b in zip(starts, [*starts[1:], table.num_rows]):
        pairs, changes = _free_pairs(v[a:b], STUCK)
        counts.append((int((pairs & own[a + 1 : b]).sum()), int((changes & own[a + 1 : b]).sum())))
    heads = table.select(["h1", "h2"]).take(pa.array(starts))
    return heads.append_column("pairs", pa.array([c[0] for c in counts], pa.int64())).append_column("changes", pa.array([c[1] for c in counts], pa.int64()))


def _lively_sources(split: DataFrame) -> DataFrame:
    """Whether a source's value otherwise changes at most readings, over partial counts of its parts."""
    rows = split.filter("first").select("h1", "h2", "part", "t", "v", "own")
    counts = map_sorted_groups(rows, ["h1", "h2", "part"], ["t"], _count_pairs, "h1 bigint, h2 int, pairs bigint, changes bigint")
    lively = (F.sum("pairs") >= 5) & (F.sum("changes") * 2 > F.sum("pairs"))
    return counts.groupBy("h1", "h2").agg(lively.cast("int").alias("lively"))


def implausible_readings(
    readings: DataFrame,
    limits: DataFrame,
    threshold: float = 5.0,
    part_rows: int = 100_000,
    halo_rows: int = 200,
) -> DataFrame:
    """Rows of readings that cannot be right: entry_id, kind (impossible, spike, stuck), score.

    ``readings``: entry_id, metric_name, name_value_labels, time, value. ``limits``: metric_name, kind,
    min_value, max_value - one row a metric, joined by broadcast up to 10,000 rows, else by shuffle; a
    metric that is missing there counts as a gauge without limits, a null limit as none.

    A source is a metric and a set of labels in any order (null names and null maps are values of their
    own). Rows of null value or time are skipped; rows with the same source and time are one reading.
    Sources of over ``part_rows`` rows are cut into parts of like numbers of readings that overlap by
    ``halo_rows`` readings (at least 20) at either end; each part flags its own rows only, by the usual
    change of the whole source and by whether the whole source changes at most readings. An empty table
    gives no rows.
    """
    key = F.concat_ws("\u0001", F.coalesce("metric_name", F.lit("\u0002")), label_key(F.col("name_value_labels")))
    known = limits.select(
        F.col("metric_name"), (F.col("kind") == "counter").alias("__counter"), F.col("min_value").alias("__low"), F.col("max_value").alias("__high")
    ).dropDuplicates(["metric_name"])
    known = F.broadcast(known) if known.limit(10_001).count() <= 10_000 else known
    rows = (
        readings.select("entry_id", "metric_name", "name_value_labels", "time", "value")
        .filter(F.col("value").isNotNull() & F.col("time").isNotNull())
        .join(known, "metric_name", "left")
        .select(
            F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"), "entry_id", micros(F.col("time")).alias("t"),
            F.col("value").cast("double").alias("v"), F.coalesce("__counter", F.lit(False)).alias("counter"),
            F.coalesce("__low", F.lit(float("-inf"))).alias("low"), F.coalesce("__high", F.lit(float("inf"))).alias("high"),
        )
    )
    rows = rows.withColumns(
        {c: F.when(F.isnan(c), F.lit(v)).otherwise(F.col(c)) for c, v in (("low", float("-inf")), ("high", float("inf")))}
    )
    many = _long_sources(rows, part_rows)
    n_many = many.limit(10_001).count()
    if n_many:
        small = n_many <= 10_000
        hint = F.broadcast if small else (lambda x: x)
        numbered = _number_readings(rows, hint(many))
        split = _cut_sources(numbered, max(halo_rows, 2 * STUCK))
        figures = _usual_changes(numbered).join(_lively_sources(split), ["h1", "h2"], "full")
        columns = ["h1", "h2", "part", "t", "entry_id", "v", "counter", "low", "high", "own"]
        split = split.select(columns).join(hint(figures), ["h1", "h2"], "left")
        short = rows.join(hint(many), ["h1", "h2"], "left_anti").withColumns({"part": F.lit(0).cast("bigint"), "own": F.lit(True)}).select(columns)
        rows = short.unionByName(split, allowMissingColumns=True)
    else:
        rows = rows.withColumns({"part": F.lit(0).cast("bigint"), "own": F.lit(True), **{c: F.lit(None) for c in ("usual", "moving", "pace", "lively")}})
    rows = rows.select(
        "h1", "h2", "part", "t", "entry_id", "v", "counter", "low", "high", "own",
        *[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in ("usual", "moving", "pace")],
        F.coalesce(F.col("lively").cast("int"), F.lit(-1)).alias("lively"),
    )
    return map_sorted_groups(rows, ["h1", "h2", "part"], ["t", "entry_id"], lambda table, starts: _flag(table, starts, threshold), FLAGS)
