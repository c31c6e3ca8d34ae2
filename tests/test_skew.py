import datetime as dt

from pyspark.sql import functions as F

from stratalog.operators import skew
from stratalog.operators.skew import Agg

T = dt.datetime(2024, 1, 1)
SCHEMA = "id long, name string, time timestamp, v double, __salt int, rows string"


def _rows(n=1000):
    # one key holds a third of all rows, one is null, one is empty
    out = []
    for i in range(n):
        name = "hot" if i % 3 == 0 else None if i % 50 == 1 else "" if i % 50 == 2 else f"k{i % 97}"
        out.append((i, name, None if i % 11 == 0 else T + dt.timedelta(seconds=i), float(i % 7), 5, "x"))
    return out


def test_key_statistics_equal_plain_groups(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    got = {(r["key_kind"], r["key_value"]): tuple(r)[2:] for r in skew.key_statistics(df, {"name": F.col("name")}, F.col("time"), F.col("id")).collect()}
    want = {("name", r["name"]): tuple(r)[1:] for r in df.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)), F.min("time"), F.max("time")).collect()}
    assert got == want
    assert ("name", "") in got


def test_heavy_keys_are_found_and_salted(spark):
    df = spark.createDataFrame(_rows(), SCHEMA)
    assert "hot" in skew.heavy_keys(df, F.col("name"), 0.1)
    out = skew.salted_aggregate(df, ["name"], [Agg("n", "count"), Agg("total", "sum", "v"), Agg("low", "min", "v")], ["id"], 0.1, 8)
    assert out._jdf.queryExecution().toString().count("__salt") > 0
    want = {r["name"]: (r["n"], r["t"], r["l"]) for r in df.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("t"), F.min("v").alias("l")).collect()}
    assert {r["name"]: (r["n"], r["total"], r["low"]) for r in out.collect()} == want


def test_share_is_met_exactly_and_repeated_rows_count(spark):
    rows = [(1, "a", T, 0.0, 0, "")] * 8 + [(i, f"b{i}", T, 0.0, 0, "") for i in range(92)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = skew.dominant_keys(df, {"name": F.col("name")}, F.col("time"), F.col("id"), 0.08).collect()
    assert [tuple(r) for r in got] == [("name", "a")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert skew.key_statistics(df, {"name": F.col("name")}, F.col("time"), F.col("id")).count() == 0
    assert skew.dominant_keys(df, {"name": F.col("name")}, F.col("time"), F.col("id")).count() == 0
