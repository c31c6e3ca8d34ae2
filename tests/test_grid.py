import datetime as dt
import random

import numpy as np

from stratalog.operators.grid import local_fit, regular_grid

T0 = dt.datetime(2024, 2, 1)
STRETCH = "result_id long, labels map<string,string>, metric_points array<struct<time:timestamp,value:double>>, step int, low string"


def _at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def _frames(spark, stretches, intervals=(("web", 10),)):
    rows = [(i, labels, points, 1, "x") for i, (labels, points) in enumerate(stretches)]
    return spark.createDataFrame(rows, STRETCH), spark.createDataFrame(list(intervals), "job string, interval_s int")


def _brute_fit(x, v, at, h):
    out = []
    for g in at:
        d = x - g
        w = np.where(np.abs(d) < h, 1 - (d / h) ** 2, 0.0)
        if w.sum() == 0:
            out.append((np.nan, 0.0))
            continue
        m = np.array([[w.sum(), (w * d).sum()], [(w * d).sum(), (w * d * d).sum()]])
        r = np.array([(w * v).sum(), (w * d * v).sum()])
        value = np.linalg.solve(m, r)[0] if np.linalg.det(m) > 1e-9 * w.sum() ** 2 * h * h else r[0] / m[0, 0]
        out.append((value, w.sum() ** 2 / (w * w).sum()))
    return out


def test_local_fit_equals_brute_force():
    rng = np.random.default_rng(1)
    x = np.sort(rng.uniform(0, 50, 120))
    v = np.sin(x) + rng.normal(0, 0.1, 120)
    at = np.arange(-5, 56, 0.7)
    value, support = local_fit(x, v, at, 3.0)
    for a, b, (c, d) in zip(value, support, _brute_fit(x, v, at, 3.0)):
        assert np.isclose(a, c, equal_nan=True, rtol=1e-8)
        assert np.isclose(b, d, rtol=1e-8)


def test_periods_over_many_blocks_and_long_gaps(spark):
    random.seed(3)
    labels = {"job": "web", "a": "1"}
    times = sorted({round(random.uniform(0, 4000), 3) for _ in range(150)} | {9000.0, 20000.5})
    points = [(_at(t), 2.0 * t + 1) for t in times]
    random.shuffle(points)
    # stretches overlap, come twice, and name their labels in another order
    stretches = [(labels, points[:100]), (dict(reversed(labels.items())), points[50:]), (labels, points[:100]), (labels, [])]
    df, config = _frames(spark, stretches)
    start = dt.datetime(1970, 1, 1)
    for block in (7, 512):
        got = {r["period_start"]: r for r in regular_grid(df, config, block=block).collect()}
        ks = [int((_at(t) - start).total_seconds() // 10) for t in times]
        assert sorted(got) == [10 * k for k in range(min(ks), max(ks) + 1)]
        for k in range(min(ks), max(ks) + 1):
            assert got[10 * k]["readings"] == ks.count(k)
            assert (got[10 * k]["mark"] == "observed") == (k in ks)
        x = np.array([(_at(t) - start).total_seconds() / 10 for t in times])
        order = np.argsort(x)
        want = _brute_fit(x[order] - min(ks), np.array([2.0 * t + 1 for t in times])[order], np.array([k + 0.5 - min(ks) for k in range(min(ks), max(ks) + 1)]), 3.0)
        for k, (value, support) in zip(range(min(ks), max(ks) + 1), want):
            row = got[10 * k]
            assert abs(row["support"] - support) < 1e-6
            if row["value"] is not None:
                assert abs(row["value"] - value) < 1e-4 * max(1, abs(value))
            assert (row["value"] is None) == (row["mark"] == "missing")


def test_nulls_nan_infinite_and_ties(spark):
    labels = {"job": "web"}
    nan, inf = float("nan"), float("inf")
    points = [(_at(0), 1.0), (_at(0), 1.0), (None, 2.0), (_at(15), None), (_at(25), nan), (_at(35), inf), (_at(41), 5.0)]
    df, config = _frames(spark, [(labels, points), ({"job": "none"}, [(_at(0), 1.0)]), (None, [(_at(0), 1.0)]), (labels, None)])
    got = {r["period_start"]: (r["readings"], r["mark"]) for r in regular_grid(df, config).collect()}
    base = int((T0 - dt.datetime(1970, 1, 1)).total_seconds())
    assert {k - base: v[0] for k, v in got.items()} == {0: 1, 10: 0, 20: 0, 30: 1, 40: 1}


def test_empty_tables(spark):
    df, config = _frames(spark, [])
    assert regular_grid(df, config).count() == 0
    df, config = _frames(spark, [({"job": "web"}, [])])
    assert regular_grid(df, config).count() == 0
