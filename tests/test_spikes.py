import datetime as dt
import random

import numpy as np

from stratalog.operators.spikes import check_source, implausible_readings, kalman

T0 = dt.datetime(2024, 2, 1)
WAL = "entry_id long, metric_name string, name_value_labels map<string,string>, time timestamp, value double, h1 long, own boolean"
LIMITS = "metric_name string, kind string, unit string, min_value double, max_value double"
CATALOG = [("temp", "gauge", "c", -50.0, 100.0), ("total", "counter", "n", 0.0, None)]


def _frame(spark, series):
    """series: (metric, labels, values), readings a minute apart; every third reading is sent again."""
    rows, i = [], 0
    for metric, labels, values in series:
        for k, v in enumerate(values):
            for _ in range(2 if k % 3 == 0 else 1):
                i += 1
                named = labels if i % 2 or labels is None else dict(reversed(labels.items()))
                rows.append((i, metric, named, T0 + dt.timedelta(seconds=60 * k), float(v), 1, True))
    random.seed(7)
    random.shuffle(rows)
    return spark.createDataFrame(rows, WAL), rows


def _found(spark, series, **more):
    df, rows = _frame(spark, series)
    kinds = {r["entry_id"]: r["kind"] for r in implausible_readings(df, spark.createDataFrame(CATALOG, LIMITS), **more).collect()}
    out = {}
    for entry, metric, labels, time, _, _, _ in rows:
        k = int((time - T0).total_seconds() // 60)
        out.setdefault((f"{metric}{sorted(labels.items())}", k), set()).add(kinds.get(entry))
    assert all(len(v) == 1 for v in out.values()), "all rows of a reading are flagged alike"
    return {key: v.pop() for key, v in out.items() if v != {None}}


def _walk(seed, n=120, level=20.0, noise=1.0):
    rng = np.random.default_rng(seed)
    return list(np.round(level + rng.normal(0, noise, n), 3))


def test_spikes_stuck_values_and_impossible_ones(spark):
    v = _walk(1)
    v[30], v[60], v[61], v[62] = 70.0, -25.0, -26.0, -24.0
    v[90:102] = [v[90]] * 12
    v[10], v[11], v[12] = float("nan"), float("inf"), 140.0
    got = _found(spark, [("temp", {"a": "1", "b": "2"}, v)])
    assert {k for (_, k), kind in got.items() if kind == "spike"} == {30, 60, 61, 62}
    assert {k for (_, k), kind in got.items() if kind == "stuck"} == set(range(90, 102))
    assert {k for (_, k), kind in got.items() if kind == "impossible"} == {10, 11, 12}


def test_lasting_moves_climbs_steps_and_short_runs_are_no_cases(spark):
    shift = _walk(2)[:60] + [x + 40 for x in _walk(3)[:60]]
    climb = [x + 0.5 * i for i, x in enumerate(_walk(4))]
    steps = [3.0] * 50 + [5.0] * 40 + [4.0] * 30
    steppy = [float(i % 5) for i, n in enumerate((23, 8, 18, 13, 9, 17, 6, 14)) for _ in range(n)]
    short = _walk(5)
    short[50:58] = [short[50]] * 8
    series = [("temp", {"s": str(i)}, v) for i, v in enumerate((shift, climb, steps, [7.0] * 100, short, steppy))]
    assert _found(spark, series) == {}


def test_counters(spark):
    rng = np.random.default_rng(6)
    rising = np.cumsum(rng.integers(80, 120, 150)).astype(float)
    restart = rising.copy()
    restart[80:] -= restart[80]
    spike = rising.copy()
    spike[40] += 5000
    spike[90:92] -= 3000
    stuck = rising.copy()
    stuck[100:115] = stuck[100]
    got = _found(spark, [("total", {"r": "1"}, list(restart)), ("total", {"r": "2"}, list(rising))])
    assert got == {}
    got = _found(spark, [("total", {"r": "3"}, list(spike))])
    assert {k for (_, k), kind in got.items()} == {40, 90, 91}
    got = _found(spark, [("total", {"r": "4"}, list(stuck))])
    assert {k for (_, k), kind in got.items() if kind == "stuck"} == set(range(100, 115))


def test_long_sources_are_cut_without_change(spark):
    v = _walk(8, 900)
    for k in (100, 333, 334, 700):
        v[k] += 60
    v[500:515] = [v[500]] * 15
    whole = _found(spark, [("temp", {"a": "1"}, v)])
    parts = _found(spark, [("temp", {"a": "1"}, v)], part_rows=300, halo_rows=60)
    assert whole == parts
    assert {k for (_, k), kind in whole.items() if kind == "spike"} == {100, 333, 334, 700}


def test_stuck_values_are_judged_by_the_whole_source(spark):
    stuck = _walk(11, 1500)
    stuck[400:800] = [stuck[400]] * 400  # fills a part with its halo
    stuck[1003] = float("nan")
    rare = [float(i // 8 % 9) for i in range(1500)]
    rare[700:940] = _walk(12, 240)  # a lively part of a source that rarely changes
    rare[800:812] = [rare[800]] * 12
    series = [("temp", {"a": "1"}, stuck), ("temp", {"a": "2"}, rare)]
    whole = _found(spark, series)
    assert {k for (s, k), kind in whole.items() if kind == "stuck" and "1" in s} == set(range(400, 800))
    assert not any("2" in s and kind == "stuck" for (s, _), kind in whole.items())
    assert _found(spark, series, part_rows=150, halo_rows=30) == whole


def test_halo_holds_readings_in_sparse_stretches(spark):
    v = _walk(13, 612)
    v[604] += 60
    days = [max(0, i - 599) * 30 for i in range(612)]
    rows = [(i, "temp", {}, T0 + dt.timedelta(days=days[i], seconds=i), float(x), 1, True) for i, x in enumerate(v)]
    df, limits = spark.createDataFrame(rows, WAL), spark.createDataFrame(CATALOG, LIMITS)
    for n in (100_000, 100):
        got = implausible_readings(df, limits, part_rows=n, halo_rows=20).collect()
        assert [(r["entry_id"], r["kind"]) for r in got] == [(604, "spike")]


def test_spikes_of_sources_that_rarely_change(spark):
    constant = [7.0] * 100
    constant[40], constant[70:73] = 60.0, [50.0, 51.0, 52.0]
    rare = [float(i // 20) for i in range(100)]
    rare[50] = 30.0
    still = [100.0] * 100
    still[30:32] = [900.0, 900.0]
    got = _found(spark, [("temp", {"r": "1"}, constant), ("temp", {"r": "2"}, rare), ("total", {"r": "3"}, still)])
    assert set(got.values()) == {"spike"}
    assert {(s[-4], k) for s, k in got} == {("1", 40), ("1", 70), ("1", 71), ("1", 72), ("2", 50), ("3", 30), ("3", 31)}


def test_spikes_after_gaps():
    rng = np.random.default_rng(14)
    for gap in (2, 5, 9, 20, 50, 300):
        for rising in (False, True):
            n = 120
            t = np.arange(n) * 1.0
            t[60:] += gap
            v = 100 * t + rng.normal(0, 20, n) if rising else rng.normal(50, 1, n)
            usual = float(np.median(np.abs(np.diff(v))))
            v[60] += 12 * usual + (50 * gap if rising else 0)
            scores, still = kalman(t[:, None], v[:, None], np.array([n]), np.array([usual]), np.array([rising]))
            fast, _ = check_source(t, v, scores[:, 0], still[:, 0], rising, usual)
            full, _ = check_source(t, v, np.ones(n), np.ones(n, bool), rising, usual)
            assert full[60], (gap, rising)
            assert list(np.flatnonzero(fast)) == list(np.flatnonzero(full)), (gap, rising)


def test_candidates_hold_all_that_an_exhaustive_check_finds():
    rng = np.random.default_rng(9)
    for trial in range(40):
        n = int(rng.integers(40, 200))
        v = rng.normal(50, 1, n) + rng.normal(0, 0.2, n).cumsum()
        for k in rng.integers(5, n - 6, 3):
            v[k : k + int(rng.integers(1, 4))] += rng.choice([-1, 1]) * rng.uniform(25, 200)
        t = np.arange(n) * 1.0
        usual = float(np.median(np.abs(np.diff(v))))
        scores, still = kalman(t[:, None], v[:, None], np.array([n]), np.array([usual]), np.array([False]))
        fast, _ = check_source(t, v, scores[:, 0], still[:, 0], False, usual)
        full, _ = check_source(t, v, np.ones(n), np.ones(n, bool), False, usual)
        assert set(np.flatnonzero(fast)) >= set(np.flatnonzero(full)), trial


def test_nulls_and_empty_tables(spark):
    limits = spark.createDataFrame(CATALOG, LIMITS)
    rows = [(1, None, None, T0, 1.0, 1, True), (2, "temp", None, None, 1.0, 1, True), (3, "temp", {"a": None}, T0, None, 1, True), (4, "other", {}, T0, float("nan"), 1, True)]
    got = implausible_readings(spark.createDataFrame(rows, WAL), limits).collect()
    assert [(r["entry_id"], r["kind"]) for r in got] == [(4, "impossible")]
    assert implausible_readings(spark.createDataFrame([], WAL), limits).count() == 0
    assert implausible_readings(spark.createDataFrame(rows, WAL), spark.createDataFrame([], LIMITS)).count() == 1


def test_flags_do_not_depend_on_the_parts(spark):
    """Short and long sources together, a stuck run longer than a part, and a burst that holds nearly all readings."""
    short, middle, long = _walk(21, 50), _walk(22, 900), _walk(23, 5000)
    short[20] += 60
    middle[700] = float("inf")
    for k in (100, 101, 2500, 4990):
        long[k] += 80
    long[1000:1500] = [long[1000]] * 500
    series = {"short": short, "middle": middle, "long": long}
    rows = []
    for name, v in series.items():
        for i, x in enumerate(v):
            at = T0 + dt.timedelta(seconds=i if name != "long" or i < 4900 else 490_000 + (i - 4900) * 1000)
            rows.append((len(rows), "temp", {"s": name}, at, float(x), 1, True))
    df, limits = spark.createDataFrame(rows, WAL), spark.createDataFrame(CATALOG, LIMITS)
    found = [{(r["entry_id"], r["kind"]) for r in implausible_readings(df, limits, part_rows=n).collect()} for n in (100, 300, 100_000)]
    assert found[0] == found[1] == found[2]
    kinds = [k for _, k in found[0]]
    assert kinds.count("stuck") == 500 and kinds.count("spike") >= 4 and kinds.count("impossible") == 1
