import datetime as dt
import math

import pytest

from stratalog.plans import metrics, promql
from stratalog.plans.metrics import MetricEngine
from stratalog.plans.promql import Binary, Call, ExpressionError, Negative, Number, Selector, parse

UTC = dt.timezone.utc
NOW = dt.datetime(1970, 1, 1, 1, tzinfo=UTC)
SCHEMA = "name string, labels map<string,string>, ts timestamp, value double"


def _engine(spark, series, **more):
    """series: {(name, labels): [(second, value), ...]}"""
    rows = [(n, dict(labels), dt.datetime.fromtimestamp(t, UTC), v) for (n, labels), points in series.items() for t, v in points]
    return MetricEngine(spark.createDataFrame(rows, SCHEMA), NOW, **more)


def _one(spark, expression, points, **more):
    rows = _engine(spark, {("m", (("a", "1"),)): points}, **more).query(expression).collect()
    return [(r["ts"].timestamp(), r["value"]) for r in sorted(rows, key=lambda r: (r["ts"], r["value"]))]


TENS = [(1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0), (5, 50.0)]


@pytest.mark.parametrize(
    "expression,points,value",
    [
        ("rate(m)", [(1, 10.0), (2, 20.0), (4, 30.0)], 20 / 3), ("irate(m)", [(1, 10.0), (2, 20.0), (4, 30.0)], 5.0), ("increase(m)", TENS, 40.0), ("increase(m)", [(1, 5.0), (2, 9.0), (3, 2.0), (4, 4.0)], 8.0),
        ("delta(m)", TENS, 40.0), ("idelta(m)", TENS, 10.0), ("changes(m)", [(1, 1.0), (2, 1.0), (3, 2.0), (4, 1.0)], 2.0), ("resets(m)", [(1, 1.0), (2, 5.0), (3, 2.0), (4, 1.0)], 2.0),
        ("deriv(m)", TENS, 10.0), ("predict_linear(m, 10)", TENS, 100.0), ("sum_over_time(m)", TENS, 150.0), ("avg_over_time(m)", TENS, 30.0), ("min_over_time(m)", TENS, 10.0), ("max_over_time(m)", TENS, 50.0),
        ("count_over_time(m)", TENS, 5.0), ("stddev_over_time(m)", TENS, math.sqrt(200)), ("stdvar_over_time(m)", TENS, 200.0), ("mad_over_time(m)", TENS, 10.0), ("last_over_time(m)", TENS, 50.0),
        ("quantile_over_time(m, 0.5)", TENS, 30.0), ("quantile_over_time(0.0, m)", TENS, 10.0), ("present_over_time(m)", TENS, 1.0), ("sum(m)", TENS, 150.0), ("quantile(0.25, m)", TENS, 20.0), ("count(m)", TENS, 5.0),
        ("rate(m)", [(1, 7.0)], 7.0), ("idelta(m)", [(1, 7.0)], 7.0), ("-m", [(1, 7.0)], -7.0), ("m / 0 > 1", [(1, 7.0)], 0.0), ("m ^ 2 ^ 0", [(1, 7.0)], 7.0), ("m % 4 = 3", [(1, 7.0)], 1.0), ("ln(m)", [(1, 0.0)], -math.inf),
        ("round(m)", [(1, 2.5)], 3.0), ("round(m, 4)", [(1, 7.0)], 8.0), ("sgn(m)", [(1, -3.0)], -1.0), ("clamp(m, 1, 5)", [(1, 7.0)], 5.0), ("day_of_week(m)", [(1, 7.0)], 4.0), ("days_in_month(m)", [(1, 7.0)], 31.0),
    ],
)
def test_single_values(spark, expression, points, value):
    got = _one(spark, expression, points)
    assert len(got) == 1 and got[0][1] == pytest.approx(value)


def test_holt_winters_and_compat(spark):
    assert [v for _, v in _one(spark, "holt_winters(m, 0.8, 0.2)", TENS)] == pytest.approx([20, 30, 40, 50, 60])
    assert _one(spark, "deriv(m)", [(1, 10.0), (2, 20.0), (3, 30.0)], compat=True)[0][1] == pytest.approx(5.0)
    assert _one(spark, "holt_winters(m, 0.5, 0.5)", [(1, 3.0)]) == [(1.0, 3.0)]


def test_sketched_quantiles(spark):
    points = [(k, float(k * 37 % 1000)) for k in range(1000)]
    for expression, value in (("quantile(0.9, m)", 899), ("quantile_over_time(m, 0.5)", 499), ("mad_over_time(m)", 250)):
        assert abs(_one(spark, expression, points, approximate=True)[0][1] - value) <= 2


def test_holt_winters_over_days(spark):
    day = 86400
    points = [(day * d + 60 * k, float((7 * d + 3 * k * k) % 11)) for d, n in enumerate((1, 4, 2, 5)) for k in range(n)]
    values = [v for _, v in points]
    level, trend, want = values[0], values[1] - values[0], []
    for v in values[1:]:
        want.append(level + trend)
        new = 0.6 * v + 0.4 * (level + trend)
        level, trend = new, 0.3 * (new - level) + 0.7 * trend
    assert [v for _, v in _one(spark, "holt_winters(m, 0.6, 0.3)", points)] == pytest.approx([*want, values[-1] + trend])


def test_nan_by_ieee(spark):
    nan = math.nan
    assert _one(spark, "m == m", [(1, nan)]) == [(1.0, 0.0)]
    assert _one(spark, "m != 1", [(1, nan)]) == [(1.0, 1.0)]
    assert _one(spark, "m > 1", [(1, nan)]) == [(1.0, 0.0)]


def test_folds_over_days_meet_at_their_seams(spark):
    day = 86400
    points = [(day * d + s, float((d * 3 + s) % 4)) for d in range(4) for s in range(3)]
    values = [v for _, v in points]
    assert _one(spark, "changes(m)", points)[0][1] == sum(a != b for a, b in zip(values, values[1:]))
    assert _one(spark, "resets(m)", points)[0][1] == sum(b < a for a, b in zip(values, values[1:]))
    assert [v for _, v in _one(spark, "m - m", points)] == [0.0] * len(points)


@pytest.fixture(scope="module")
def two(spark):
    return _engine(spark, {("m", (("job", "a"), ("x", "1"))): [(1, 1.0), (2, 3.0)], ("m", (("x", "2"), ("job", "b"))): [(1, 10.0)], ("n", (("job", "a"), ("x", "1"))): [(1, 5.0), (2, 5.0)]})


def _map(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["label_key"], []).append(r["value"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(
    "expression,want",
    [
        ('m{job="a"}', {"job=a,x=1": [1, 3]}), ('m{job!="a"}', {"job=b,x=2": [10]}), ('m{job=~"a|c"}', {"job=a,x=1": [1, 3]}), ('m{job!~"a.*"}', {"job=b,x=2": [10]}), ('{__name__="n"}', {"job=a,x=1": [5, 5]}),
        ("sum by (job) (m)", {"job=a": [4], "job=b": [10]}), ("sum without (x) (m)", {"job=a": [4], "job=b": [10]}), ("topk(1, m)", {"job=a,x=1": [3], "job=b,x=2": [10]}), ("bottomk(9, m)", {"job=a,x=1": [1, 3], "job=b,x=2": [10]}),
        ('count_values("job", m)', {"job=a": [2], "job=b": [1]}), ("m and n", {"job=a,x=1": [1, 3]}), ("m unless n", {"job=b,x=2": [10]}), ("n or m", {"job=a,x=1": [5, 5], "job=b,x=2": [10]}), ("m + n", {"job=a,x=1": [6, 8]}),
        ("m * on (job) n", {"job=a,x=1": [5, 15]}), ("sum(sum by (job) (m))", {"": [14]}), ("max(m) - min(m)", {"": [9]}), ('label_join(m, "j", "-", "job", "x", "no")', {"j=a-1-,job=a,x=1": [1, 3], "j=b-2-,job=b,x=2": [10]}),
        ('label_replace(m, "job", "$1$1", "job", "(a)")', {"job=aa,x=1": [1, 3], "job=b,x=2": [10]}), ("absent(zzz)", {"absent=true": [1]}), ("absent(m)", {}), ("vector(2) * 3", {"": [6]}), ("2 * 3", {"": [6]}), ("m[1h] offset 1s", {"job=a,x=1": [1, 3], "job=b,x=2": [10]}),
    ],
)
def test_vectors(two, expression, want):
    assert _map(two.query(expression)) == want


def test_time_pairing_and_order(spark):
    e = _engine(spark, {("a", ()): [(1, 1.0), (2, 2.0)], ("b", ()): [(2, 10.0), (3, 20.0)]}, pairing="time")
    assert [(r["ts"].timestamp(), r["value"]) for r in e.query("a + b").collect()] == [(2.0, 12.0)]
    frame = _engine(spark, {("m", (("k", "1"),)): [(1, 1.0)], ("m", (("k", "2"),)): [(9, 1.0), (3, 2.0)]}).query("m")
    assert [r["label_key"] for r in metrics.newest_first(frame).collect()] == ["k=2", "k=2", "k=1"]


def test_trees():
    assert parse("-m ^ 2") == Negative(Binary("^", Selector("m"), Number(2.0)))
    assert parse("a + b * c") == Binary("+", Selector("a"), Binary("*", Selector("b"), Selector("c")))
    assert parse("a >= 1e3") == Binary(">=", Selector("a"), Number(1000.0))
    assert parse("sum") == Selector("sum") and parse("rate_total") == Selector("rate_total")
    assert parse("acosh(cosh_x)") == Call("acosh", (Selector("cosh_x"),))
    assert parse('m{a=~"x"}[1h30m] offset 1y') == Selector("m", (promql.Matcher("a", "=~", "x"),), 5400.0, 31536000.0)
    assert parse("a or b and c") == Binary("or", Selector("a"), Binary("and", Selector("b"), Selector("c")))


@pytest.mark.parametrize("bad", ["", "m{", "m)", "m x", "sum(", "sum(m, 1)", "topk(m)", "m[5x]", "rate(m)[1h]", "m[1h:5m][1h:5m]", "nosuch(m)", "rate(1)", "clamp(m, 1)", "m and 1", "m and group_left n", "!", "m{a~1}"])
def test_bad_expressions(two, bad):
    with pytest.raises(ExpressionError):
        two.query(bad)


def test_empty_table(spark):
    e = MetricEngine(spark.createDataFrame([], SCHEMA), NOW)
    for expression in ("m", "sum(m)", "rate(m)", "changes(m)", "topk(2, m)", "quantile(0.5, m)", "holt_winters(m, 0.1, 0.1)", "m + m", "m or m", "predict_linear(m, 1)"):
        assert e.query(expression).count() == 0, expression
    assert e.query("absent(m)").count() == 1


def test_many_to_one(spark):
    series = {
        ("errors", (("host", "a"), ("code", "500"))): [(1, 2.0), (2, 4.0)], ("errors", (("host", "a"), ("code", "404"))): [(1, 6.0), (2, 8.0)],
        ("errors", (("host", "c"), ("code", "404"))): [(1, 6.0)], ("total", (("host", "a"), ("team", "x"))): [(1, 10.0), (2, 20.0)],
    }
    for pairing in ("position", "time"):
        engine = _engine(spark, series, pairing=pairing)
        got = {(r["labels"]["code"], r["labels"].get("team"), r["ts"].timestamp()): r["value"] for r in engine.query("errors / on(host) group_left(team) total").collect()}
        assert got == {("500", "x", 1.0): 0.2, ("500", "x", 2.0): 0.2, ("404", "x", 1.0): 0.6, ("404", "x", 2.0): 0.4}
        back = {(r["labels"]["code"], r["ts"].timestamp()): r["value"] for r in engine.query("total - on(host) group_right errors").collect()}
        assert back == {("500", 1.0): 8.0, ("500", 2.0): 16.0, ("404", 1.0): 4.0, ("404", 2.0): 12.0}
        with pytest.raises(Exception, match="many series match"):
            engine.query("total / on(host) group_left errors").collect()
    with pytest.raises(ExpressionError):
        parse("a and group_left b")


def test_time_pairing_is_one_to_one(spark):
    series = {("a", (("h", "1"), ("k", str(i)))): [(1, float(i))] for i in range(4)} | {("b", (("h", "1"), ("k", str(i)))): [(1, 10.0)] for i in range(3)}
    assert _engine(spark, series, pairing="time").query("a + on(h) b").count() == 3


def test_subqueries(spark):
    points = [(60 * k, float(k * k)) for k in range(60)]
    series = {("m", (("h", "1"),)): points, ("m", (("h", "2"),)): [(30.0, 5.0), (3000.0, 7.0)]}
    engine = _engine(spark, series)
    # NOW is 3,600 s; steps are 3,120, 3,240 ... 3,600, and a point stands for five minutes
    got = [(r["ts"].timestamp(), r["value"]) for r in sorted(engine.query('m{h="1"}[10m:2m]').collect(), key=lambda r: r["ts"])]
    assert got == [(3120.0, 52.0**2), (3240.0, 54.0**2), (3360.0, 56.0**2), (3480.0, 58.0**2), (3600.0, 59.0**2)]
    got = {(r["labels"]["h"], r["ts"].timestamp()): r["value"] for r in engine.query("m[10m:2m]").collect()}
    assert {k: v for k, v in got.items() if k[0] == "2"} == {("2", 3120.0): 7.0, ("2", 3240.0): 7.0}

    def rate(t):  # over the points in (t - 300, t]
        inside = [(x, v) for x, v in points if t - 300 < x <= t]
        return (inside[-1][1] - inside[0][1]) / (inside[-1][0] - inside[0][0])

    got = engine.query('max_over_time(rate(m{h="1"}[5m])[30m:5m])').collect()
    assert [r["value"] for r in got] == pytest.approx([max(rate(t) for t in range(2100, 3601, 300))])
    got = {r["ts"].timestamp(): r["value"] for r in engine.query("sum(m)[10m:5m]").collect()}
    assert got == {3300.0: 55.0**2, 3600.0: 59.0**2}
    late = [r["ts"].timestamp() for r in engine.query('m{h="1"}[4m:2m] offset 1h').collect()]
    assert late == [3600.0]
    assert parse("m[1h:]").step_s == 60 and parse("m[1h:5m]").step_s == 300 and parse("rate(m[5m])[1h:90s] offset 5m").offset_s == 300
    for bad in ("m[1h:0s]", "rate(m)[5m]", "m[5m:1m"):
        with pytest.raises(ExpressionError):
            parse(bad)


def test_ranks_of_long_series_are_exact(spark):
    df = spark.range(30_000).selectExpr("'a' as label_key", "map('a', '1') as labels", "timestamp_seconds(id) as ts", "cast((id * 7919) % 10007 as double) as value")
    values = sorted(r["value"] for r in df.collect())
    for share in (0.0, 0.001, 0.5, 0.9995, 1.0):
        rank = max(1, math.ceil(share * 30_000 - 1e-9))
        got = metrics.at_ranks(df, share, lambda n: [metrics.F.lit(rank)], small=100).first()
        assert got["found"] == [values[rank - 1]]
