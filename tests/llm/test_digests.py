import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stratalog.llm import digests
from stratalog.llm.digests import QUANTILES, build_digests, certify, cluster, estimate, merge_digests, quantiles

SCHEMA = "entry_id long, metric_name string, name_value_labels map<string,string>, value double, n int, label string, h1 long"


def _rank_error(values, x, q):
    s = np.sort(values)
    return max(0.0, np.searchsorted(s, x, "left") / len(s) - q, q - np.searchsorted(s, x, "right") / len(s))


def test_clusters_stay_within_rank_error_after_merges():
    rng = np.random.default_rng(1)
    for values in (rng.normal(0, 1, 50_000), rng.pareto(1.0, 50_000), np.repeat([1.0, 2.0, 3.0], 9_000), rng.integers(0, 20, 40_000) * 1.0, np.full(5_000, 7.5)):
        parts = np.array_split(rng.permutation(values), 23)
        means, weights = [], []
        for p in parts:
            g, m, w = cluster(np.zeros(len(p), int), p, np.ones(len(p)), 200)
            means.append(m)
            weights.append(w)
        g, m, w = cluster(np.zeros(sum(map(len, means)), int), np.concatenate(means), np.concatenate(weights), 200)
        assert len(m) <= 201
        assert w.sum() == len(values)
        for q, x in zip(QUANTILES, quantiles(m, w, values.min(), values.max(), QUANTILES)):
            assert _rank_error(values, x, q) < 0.005


def test_small_groups_are_exact():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 99, 250):
        values = rng.normal(size=n)
        g, m, w = cluster(np.zeros(n, int), values, np.ones(n), 400)
        want = [np.sort(values)[int(np.ceil(q * n - 1e-9)) - 1] for q in QUANTILES]
        assert list(quantiles(m, w, values.min(), values.max(), QUANTILES)) == want


def test_errors_are_counted_at_every_size(spark):
    rng = np.random.default_rng(5)
    sizes = [*range(2, 40), 60, 99, 250, 255, 256, 300, 400, 511, 512, 513, 700, 1000]
    values = {n: rng.lognormal(3, 1, n) if n % 2 else rng.integers(0, 30, n) * 1.0 for n in sizes}
    df = spark.createDataFrame([(f"m{n}", float(v)) for n, x in values.items() for v in x], "metric_name string, value double").withColumn("name_value_labels", F.lit(None).cast("map<string,string>"))
    rows = certify(df, estimate(merge_digests(build_digests(df.repartition(3))))).collect()
    assert len(rows) == len(sizes)
    for r in rows:
        x = values[int(r["metric_name"][1:])]
        true = max(_rank_error(x, e, q) for q, e in zip(QUANTILES, r["estimates"]))
        assert abs(true - r["rank_error"]) < 1e-12 and true < 0.01
        assert true == 0 or len(x) > 250


def _frame(spark, n=6000):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        name = None if i % 97 == 0 else "hot" if i % 3 else f"m{i % 4}"
        labels = None if i % 41 == 0 else {"job": f"j{i % 5}", "instance": f"i{i % 300}", "odd": None}
        value = None if i % 50 == 0 else float("nan") if i % 51 == 0 else float("inf") if i % 53 == 0 else float(rng.lognormal(3, 1))
        rows.append((i, name, labels, value, 1, "clash", 2))
    return spark.createDataFrame(rows, SCHEMA), rows


def _groups(rows):
    out = {}
    for _, name, labels, value, *_ in rows:
        if value is not None and np.isfinite(value):
            for key in [(name, None, None), *((name, k, v) for k, v in (labels or {}).items())]:
                out.setdefault(key, []).append(value)
    return out


def test_groups_counts_and_certified_errors(spark):
    df, rows = _frame(spark)
    want = _groups(rows)
    for fan in (1, 2, 64):
        merged = merge_digests(build_digests(df.repartition(5), 100, 3000), 100, fan)
        found = certify(df, estimate(merged)).collect()
        assert {(r["metric_name"], r["label"], r["label_value"]): r["n"] for r in found} == {k: len(v) for k, v in want.items()}
        for r in found:
            values = np.array(want[r["metric_name"], r["label"], r["label_value"]])
            true = max(_rank_error(values, x, q) for q, x in zip(QUANTILES, r["estimates"]))
            assert abs(true - r["rank_error"]) < 1e-9
            assert r["rank_error"] < 0.03


def test_days_can_be_combined(spark):
    df, rows = _frame(spark)
    days = [merge_digests(build_digests(df.filter(F.col("entry_id") % 3 == k))) for k in range(3)]
    found = {tuple(r)[:3]: r for r in estimate(merge_digests(days[0].unionByName(days[1]).unionByName(days[2]))).collect()}
    values = np.array(_groups(rows)["hot", None, None])
    row = found["hot", None, None]
    assert row["n"] == len(values)
    assert max(_rank_error(values, x, q) for q, x in zip(QUANTILES, row["estimates"])) < 0.005


def test_certify_beyond_the_broadcast_bound(spark):
    df, _ = _frame(spark, 2000)
    found = estimate(merge_digests(build_digests(df, 50), 50))
    a = {tuple(r)[:3]: r["rank_error"] for r in certify(df, found).collect()}
    b = {tuple(r)[:3]: r["rank_error"] for r in certify(df, found, broadcast_rows=0).collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    found = estimate(merge_digests(build_digests(df)))
    assert certify(df, found).count() == 0
    assert list(digests._build(iter([]), 200, 10)) == []
    assert pa.__version__
