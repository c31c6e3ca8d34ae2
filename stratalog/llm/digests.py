"""Percentiles of very large columns by mergeable centroid digests, with a certified rank error.

Values are sorted and clustered under a size function of their quantile that is small at the tails
(the arcsine scale); a digest is the list of means and weights of the clusters. Digests are merged by
clustering their centroids again, so those of partitions or days can be combined. A second pass over
the rows counts how many lie below and at each estimate of every group, which gives its true error of
rank. The percentile of a share q of n values is the one of rank ceil(q * n).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.sortedgroups import map_sorted_groups

QUANTILES = (0.5, 0.9, 0.95, 0.99, 0.999)
GROUP = ["metric_name", "label", "label_value"]
DIGEST = "metric_name string, label string, label_value string, n bigint, low double, high double, means array<double>, weights array<double>"


def cluster(g: np.ndarray, mean: np.ndarray, weight: np.ndarray, delta: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of many groups at once: (group, mean, weight), sorted by group and mean.

    Neighbours are joined while they lie in one cell of ``delta`` cells of the arcsine scale of the
    quantile. A group of fewer than 2 / pi * ``delta`` values has each in a cell of its own, without loss.
    """
    order = np.lexsort((mean, g))
    g, mean, weight = g[order], mean[order], weight[order]
    if not len(g):
        return g, mean, weight
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(first, len(g)))
    total = np.add.reduceat(weight, first)
    upto = np.cumsum(weight)
    before = np.repeat(upto[first] - weight[first], size)
    q = np.clip((upto - before - weight / 2) / np.repeat(total, size), 0.0, 1.0)
    cell = np.floor(delta * (np.arcsin(2 * q - 1) / np.pi + 0.5)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (cell[1:] != cell[:-1])]))
    w = np.add.reduceat(weight, start)
    # means relative to the cluster's first value, so that equal values keep their exact value
    base = mean[start]
    spread = np.repeat(base, np.diff(np.append(start, len(g))))
    with np.errstate(over="ignore", invalid="ignore"):
        m = base + np.add.reduceat((mean - spread) * weight, start) / w
    m = np.where(np.isfinite(m), m, base)
    return g[start], m, w


def quantiles(mean: np.ndarray, weight: np.ndarray, low: float, high: float, qs: tuple[float, ...]) -> np.ndarray:
    """Estimates of a digest: linear between the middles of its clusters, at the middle of the wanted rank. A value in a cluster of its own is met exactly."""
    n = weight.sum()
    middle = np.cumsum(weight) - weight / 2
    rank = np.clip(np.ceil(np.asarray(qs) * n - 1e-9), 1, n)
    return np.interp(rank - 0.5, np.concatenate([[0], middle, [n]]), np.concatenate([[low], mean, [high]]))


def _digest_batch(names: list[tuple], g: np.ndarray, m: np.ndarray, w: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Digests of groups 0.. as rows; groups without centroids are left out."""
    count = np.bincount(g, minlength=len(names))
    has = np.flatnonzero(count)
    offsets = pa.array(np.concatenate([[0], np.cumsum(count[has])]), pa.int32())
    n = np.bincount(g, w, len(names))[has]
    columns = [pa.array([names[i][j] for i in has], pa.string()) for j in range(3)]
    columns += [pa.array(np.rint(n), pa.int64()), pa.array(low[has], pa.float64()), pa.array(high[has], pa.float64())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.float64())) for x in (m, w)]
    return pa.RecordBatch.from_arrays(columns, [*GROUP, "n", "low", "high", "means", "weights"])


def _build(batches: Iterator[pa.RecordBatch], delta: float, rows: int) -> Iterator[pa.RecordBatch]:
    """Digests of one partition's rows (metric_name, labels, value) by metric and by metric and label."""
    ids: dict[tuple, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def squeeze() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, v, w = (np.concatenate([h[i] for h in held]) for i in range(3))
        return cluster(g, v, w, delta)

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal ids, held, waiting
        if held:
            g, m, w = squeeze()
            low, high = np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            np.minimum.at(low, g, lows[g])
            np.maximum.at(high, g, highs[g])
            yield _digest_batch(list(ids), g, m, w, low, high)
        ids, held, waiting = {}, [], 0

    lows, highs = np.full(1024, np.inf), np.full(1024, -np.inf)
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(2).to_numpy(zero_copy_only=False)
        names = b.column(0).dictionary_encode()
        metric = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        metrics = [*names.dictionary.to_pylist(), None]
        labels = b.column(1)
        sizes = np.diff(labels.offsets.to_numpy())
        sizes[~labels.is_valid().to_numpy(zero_copy_only=False)] = 0
        at = np.repeat(np.arange(b.num_rows), sizes)
        window = slice(int(labels.offsets[0].as_py()), int(labels.offsets[-1].as_py()))
        keys = labels.keys[window].dictionary_encode() if len(at) else None
        own_g, own_v = [], []

        def group(code: np.ndarray, name_of) -> np.ndarray:
            some, back = np.unique(code, return_inverse=True)
            found = np.array([ids.setdefault(name_of(int(c)), len(ids)) for c in some], np.int64)
            return found[back]

        own_g.append(group(metric, lambda c: (metrics[c], None, None)))
        own_v.append(v)
        if len(at):
            items = labels.items[window].dictionary_encode()
            k = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            i = items.indices.fill_null(len(items.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            key_names, item_names = keys.dictionary.to_pylist(), [*items.dictionary.to_pylist(), None]
            nk, ni = len(key_names), len(item_names)
            code = ((metric[at] + 1) * nk + k) * ni + i
            own_g.append(group(code, lambda c: (metrics[c // ni // nk - 1], key_names[c // ni % nk], item_names[c % ni])))
            own_v.append(v[at])
        g, x = np.concatenate(own_g), np.concatenate(own_v)
        if len(ids) > len(lows):
            more = 2 * len(ids)
            lows, highs = (np.concatenate([a, np.full(more - len(a), f)]) for a, f in ((lows, np.inf), (highs, -np.inf)))
        np.minimum.at(lows, g, x)
        np.maximum.at(highs, g, x)
        held.append((g, x, np.ones(len(x))))
        waiting += len(x)
        if waiting > rows:
            held = [squeeze()]
            waiting = len(held[0][0]) // 2
            if len(held[0][0]) > rows:
                yield from flush()
                lows[:], highs[:] = np.inf, -np.inf
    yield from flush()


def build_digests(df: DataFrame, delta: float = 400, rows: int = 1_000_000) -> DataFrame:
    """Digests (DIGEST) of value by metric_name, and by metric_name and every single label, one a group and partition.

    ``df``: metric_name, name_value_labels, value. Null, NaN and infinite values are left out. label and
    label_value are null for a whole metric; a null metric name is a group of its own, so is a null value of
    a label. The result can be stored and combined with others by ``merge_digests``.
    """
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    picked = df.filter(finite).select(F.col("metric_name").cast("string"), "name_value_labels", F.col("value").cast("double"))
    return picked.mapInArrow(lambda batches: _build(batches, delta, rows), DIGEST)


def _merged(table: pa.Table, starts: np.ndarray, delta: float) -> tuple:
    group = np.zeros(table.num_rows, np.int64)
    group[starts] = 1
    group = np.cumsum(group) - 1
    means, weights = (table.column(c).combine_chunks() for c in ("means", "weights"))
    means, weights = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (means, weights))
    sizes = np.diff(means.offsets.to_numpy())
    g, m, w = cluster(np.repeat(group, sizes), means.flatten().to_numpy(), weights.flatten().to_numpy(), delta)
    low = np.minimum.reduceat(table.column("low").to_numpy(), starts)
    high = np.maximum.reduceat(table.column("high").to_numpy(), starts)
    names = list(zip(*(table.column(c).take(pa.array(starts)).to_pylist() for c in GROUP)))
    return names, g, m, w, low, high


def _keyed(digests: DataFrame, part: Column) -> DataFrame:
    names = [F.coalesce(F.col(c), F.lit("\u0002")) for c in GROUP]
    return digests.withColumns({"h1": F.xxhash64(*names), "h2": F.hash(*names), "h3": part})


def merge_digests(digests: DataFrame, delta: float = 400, fan: int = 64) -> DataFrame:
    """One digest a group (DIGEST), from digests of any origin.

    A group has as many digests as there are partitions. They are merged in two rounds: those of ``fan``
    partitions first, then what comes of that, so no task gets those of a group from all partitions.
    """

    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        return pa.Table.from_batches([_digest_batch(*_merged(table, starts, delta))])

    for part in (F.floor(F.spark_partition_id() / fan).cast("int"), F.lit(0)):
        digests = map_sorted_groups(_keyed(digests, part), ["h1", "h2", "h3"], ["low", "n"], work, DIGEST)
    return digests


def _estimates(batches: Iterator[pa.RecordBatch], qs: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        means, weights = b.column(6), b.column(7)
        cuts = means.offsets.to_numpy() - means.offsets[0].as_py()
        m, w = means.flatten().to_numpy(), weights.flatten().to_numpy()
        low, high = b.column(4).to_numpy(), b.column(5).to_numpy()
        values = [quantiles(m[cuts[i] : cuts[i + 1]], w[cuts[i] : cuts[i + 1]], low[i], high[i], qs) for i in range(b.num_rows)]
        flat = np.concatenate(values) if values else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(qs), pa.int32()), pa.array(flat, pa.float64()))
        yield pa.RecordBatch.from_arrays([*b.columns[:4], lists], [*GROUP, "n", "estimates"])


def estimate(digests: DataFrame, qs: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Percentiles of merged digests: GROUP, n, estimates (one a quantile)."""
    return digests.mapInArrow(lambda batches: _estimates(batches, qs), "metric_name string, label string, label_value string, n bigint, estimates array<double>")


def certify(df: DataFrame, estimates: DataFrame, qs: tuple[float, ...] = QUANTILES, broadcast_rows: int = 200_000) -> DataFrame:
    """Adds ``rank_error`` to estimates: the largest distance of an estimate's rank from its quantile, as a share of the group's rows.

    An estimate has ranks from the number of smaller values to the number of those up to it. A pass over all rows counts those below and up to each estimate. Estimates are broadcast up to
    ``broadcast_rows`` groups, else joined by shuffle, where adaptive execution splits hot groups. ``estimates``
    should be a table or checkpoint, as it is read three times.
    """
    named = lambda d: [F.coalesce(F.col(c), F.lit("\u0002")).alias(f"__{c}") for c in d]
    targets = estimates.select(*named(GROUP), "estimates")
    if targets.limit(broadcast_rows + 1).count() <= broadcast_rows:
        targets = F.broadcast(targets)
    finite = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    whole = F.array(F.struct(F.lit("\u0002").alias("key"), F.lit("\u0002").alias("value")))
    pairs = F.concat(whole, F.coalesce(F.transform(F.map_entries("name_value_labels"), lambda e: F.struct(e["key"].alias("key"), F.coalesce(e["value"], F.lit("\u0002")).alias("value"))), F.array().cast("array<struct<key:string,value:string>>")))
    rows = df.filter(finite).select(F.coalesce("metric_name", F.lit("\u0002")).alias("__metric_name"), F.col("value").cast("double").alias("__v"), F.explode(pairs).alias("p"))
    rows = rows.select("__metric_name", "__v", F.col("p.key").alias("__label"), F.col("p.value").alias("__label_value"))
    counts = []
    for i in range(len(qs)):
        x = F.col("estimates")[i]
        counts += [F.count_if(F.col("__v") < x).alias(f"__under{i}"), F.count_if(F.col("__v") <= x).alias(f"__upto{i}")]
    ranks = rows.join(targets, ["__metric_name", "__label", "__label_value"]).groupBy("__metric_name", "__label", "__label_value").agg(F.count(F.lit(1)).alias("__n"), *counts)
    errors = [F.greatest(F.col(f"__under{i}") / F.col("__n") - q, F.lit(q) - F.col(f"__upto{i}") / F.col("__n"), F.lit(0.0)) for i, q in enumerate(qs)]
    ranks = ranks.select("__metric_name", "__label", "__label_value", F.greatest(*errors).alias("__error"))
    keyed = estimates.select("*", *named(GROUP)).join(ranks, ["__metric_name", "__label", "__label_value"], "left")
    return keyed.select(*GROUP, "n", "estimates", F.col("__error").alias("rank_error"))
