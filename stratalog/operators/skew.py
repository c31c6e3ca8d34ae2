"""Per-key aggregation that stays even when a few keys hold most rows.

Heavy keys are found with a mergeable frequent-items sketch over all rows. Their rows get
a salt, partial results are computed per key and salt, and a second aggregation merges the
partials by the original key. Light keys keep salt 0, so nothing is added for them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: partial function and merging function by name
MERGEABLE = {
    "count": (F.count, F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
}


@dataclass(frozen=True)
class Agg:
    """One mergeable aggregate: ``fn`` of ``column`` (None counts rows), named ``name``."""

    name: str
    fn: str
    column: str | None = None


def heavy_keys(df: DataFrame, key: Column, share: float = 0.02) -> list[str]:
    """Keys that may hold at least ``share`` of the rows; never misses one, may add some close to it.

    The sketch keeps 64 items per key that can reach the share, so its error is below a
    tenth of ``share``; at most ``2 / share`` keys come back to the driver.
    """
    most, tracked = int(2 / share), int(64 / share)
    found = df.select(key.cast("string").alias("__key")).agg(
        F.expr(f"approx_top_k(__key, {most}, {tracked})").alias("top"), F.count("__key").alias("rows")
    )
    row = found.first()
    if not row or not row["rows"]:
        return []
    return [x["item"] for x in row["top"] or [] if x["item"] is not None and x["count"] >= 0.8 * share * row["rows"]]


def salted_aggregate(
    df: DataFrame,
    keys: list[str],
    aggs: list[Agg],
    spread: list[str] | None = None,
    share: float = 0.02,
    salts: int = 32,
    heavy: list[str] | None = None,
) -> DataFrame:
    """Aggregates ``df`` by ``keys`` in two stages, with the rows of heavy keys salted.

    The salt is a hash of the columns in ``spread`` (all others by default), so a task that is
    run again after a lost executor sends each row to the same place; rows that are equal in
    all of them fall on one salt and are collapsed before the shuffle. A null key is a group
    of its own, as in ``groupBy``. An empty table gives an empty result.
    """
    key = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0002")) for k in keys])
    if heavy is None:
        heavy = heavy_keys(df, key, share)
    spread = spread or [c for c in df.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)) if spread else F.lit(0)
    salt = F.when(key.isin(*heavy), salt).otherwise(F.lit(0)) if heavy else F.lit(0)
    partial = [MERGEABLE[a.fn][0](F.col(a.column) if a.column else F.lit(1)).alias(f"__{a.name}") for a in aggs]
    merge = [MERGEABLE[a.fn][1](f"__{a.name}").alias(a.name) for a in aggs]
    if not heavy:
        return df.groupBy(*keys).agg(*partial).select(*keys, *[F.col(f"__{a.name}").alias(a.name) for a in aggs])
    return df.withColumn("__salt", salt.cast("int")).groupBy(*keys, "__salt").agg(*partial).groupBy(*keys).agg(*merge)


def key_statistics(
    df: DataFrame,
    keys: dict[str, Column],
    time: Column,
    row_id: Column,
    share: float = 0.02,
    salts: int = 32,
) -> DataFrame:
    """Rows, first and last time of every value of every kind of key, in one pass over ``df``.

    ``keys`` maps a kind to the column that holds its value; a null value is no key, an empty
    string is one. Repeated rows count as often as they come. A null time counts as a row but
    gives no first or last time. Result: key_kind, key_value, rows, first_time, last_time.
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in keys.items()])
    flat = df.select(time.alias("__time"), row_id.alias("__id"), F.explode(pairs).alias("__pair")).select(
        F.col("__pair.kind").alias("key_kind"), F.col("__pair.value").alias("key_value"), "__time", "__id"
    )
    flat = flat.filter(F.col("key_value").isNotNull())
    aggs = [Agg("rows", "count"), Agg("first_time", "min", "__time"), Agg("last_time", "max", "__time")]
    return salted_aggregate(flat, ["key_kind", "key_value"], aggs, ["__time", "__id"], share, salts)


def dominant_keys(df: DataFrame, keys: dict[str, Column], time: Column, row_id: Column, share: float = 0.08) -> DataFrame:
    """Keys with at least ``share`` of all rows of ``df``: key_kind, key_value."""
    stats = key_statistics(df, keys, time, row_id, share / 4)
    every = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    # a hair below, so that a share that is met exactly isn't lost to rounding
    return stats.filter(F.col("rows") >= F.lit(share * (1 - 1e-12)) * every).select("key_kind", "key_value")
