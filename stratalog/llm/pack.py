"""Items of varying length into containers of fixed capacity, with little unused room.

Only the histogram of lengths is solved: at most ``capacity`` numbers whatever the corpus. Its
configuration linear program (a configuration is a set of lengths that fits one container) is solved
by multiplicative weights over classes of like lengths: every class has a price, the most valuable
configuration is found by dynamic programming over the capacity, it is used a bit, and the prices of
what it covers fall with all that has covered them so far. Prices that no configuration exceeds bound
the number of containers from below, and the rounds stop when the rounded solution is within a stated
gap of that bound. Rounding takes whole containers; slots of a class go to its lengths, longest first,
and what is left is solved once more and then goes by best fit into the room there is. The solution is a table
of slots; documents take their slots by their number among those of their length, which is counted in
salted buckets, so neither the documents nor a frequent length ever come together in one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.session import cut

Config = tuple[tuple[int, int], ...]  # (length, times) of one container, longest first


def knapsack(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest total price of lengths (ascending) that fit in every capacity up to ``capacity``, and the last length taken for it, -1 for none."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    known = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(int(lengths[0]), capacity + 1):
        n = known[c]
        value = best[c - lengths[:n]] + prices[:n]
        i = value.argmax()
        if value[i] > best[c - 1]:
            best[c], choice[c] = value[i], i
        else:
            best[c] = best[c - 1]
    return best, choice


def _taken(choice: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while capacity > 0:
        i = int(choice[capacity])
        if i < 0:
            capacity -= 1
        else:
            out[i] = out.get(i, 0) + 1
            capacity -= int(lengths[i])
    return out


@dataclass
class Solution:
    """How often each configuration is used, and a number of containers that no packing can go below."""

    configs: Counter = field(default_factory=Counter)
    bound: float = 0.0

    @property
    def containers(self) -> int:
        return sum(self.configs.values())

    @property
    def gap(self) -> float:
        """By how much more than the bound, as a share; the bound counts up to whole containers."""
        return self.containers / max(1, math.ceil(self.bound - 1e-9)) - 1


@dataclass
class Classes:
    """Lengths in at most ``most`` classes of like volume, each as large as its longest, in units of a part of their mean length.

    Short lengths of up to a tenth of the volume are in none: they fill the room that rounding leaves.
    """

    lengths: np.ndarray
    counts: np.ndarray
    capacity: int
    most: int = 128

    def __post_init__(self) -> None:
        volume = self.lengths * self.counts
        self.volume = float(volume.sum())
        self.short = int(((self.lengths <= self.capacity // 16) & (np.cumsum(volume) <= 0.1 * self.volume)).sum())
        own, n = self.lengths[self.short :], self.counts[self.short :]
        at = np.arange(len(own))
        if len(own) > self.most:
            upto = np.cumsum(own * n)
            at = np.minimum(self.most - 1, self.most * (upto - 1) // upto[-1])
        _, self.of = np.unique(at, return_inverse=True)
        k = int(self.of.max()) + 1 if len(own) else 0
        self.size = np.zeros(k, np.int64)
        np.maximum.at(self.size, self.of, own)
        self.need = np.bincount(self.of, n, k)
        self.price = np.bincount(self.of, own * n, k) / np.maximum(self.need, 1) / self.capacity  # to begin with, by volume
        self.unit = max(1, int((own * n).sum() / max(1, n.sum()) / 200))

    def bound(self, prices: np.ndarray) -> float:
        """What ``prices`` of the classes prove: all lengths at their price, over the price of the dearest configuration."""
        part = self.price * (prices / self.price) ** np.array([[0.1], [0.3], [1.0]])  # nearer to volume, which is often the better proof
        most = 0.0
        for p in part:
            every = np.concatenate([self.lengths[: self.short] / self.capacity * float((p / self.price).mean()), p[self.of]])
            most = max(most, float((every * self.counts).sum() / knapsack(every, self.lengths, self.capacity)[0][self.capacity]))
        return most


def _rounded(classes: Classes, used: dict[tuple, float], covered: np.ndarray) -> tuple[Counter, Counter]:
    """Whole containers of real lengths out of configurations of classes, the most used first, and what they leave."""
    pools: list[list[list[int]]] = [[] for _ in classes.need]
    for length, n, i in zip(classes.lengths[classes.short :].tolist(), classes.counts[classes.short :].tolist(), classes.of.tolist()):
        pools[i].append([length, n])
    left = classes.need.astype(np.int64).tolist()
    ahead = np.maximum(1.0, covered / classes.need)
    out: Counter = Counter()
    for config, x in sorted(used.items(), key=lambda c: -c[1]):
        number = min(int(x / max(ahead[i] for i, _ in config) + 1e-9), *(left[i] // n for i, n in config))
        for i, n in config:
            left[i] -= n * number
        while number > 0:
            # as many containers as have the same lengths; where a length runs out, one with some of the next
            run = min(number, *(pools[i][-1][1] // n for i, n in config))
            parts: Counter = Counter()
            for i, n in config:
                open_ = n
                while open_:
                    top = pools[i][-1]
                    k = open_ if run else min(open_, top[1])
                    parts[top[0]] += k
                    top[1] -= k * max(1, run)
                    open_ -= k
                    if not top[1]:
                        pools[i].pop()
            out[tuple(sorted(parts.items(), reverse=True))] += max(1, run)
            number -= max(1, run)
    rest = Counter({int(x): int(n) for x, n in zip(classes.lengths[: classes.short], classes.counts[: classes.short])})
    for pool in pools:
        for length, n in pool:
            rest[length] += n
    return out, rest


def best_fit(open_: Counter, rest: Counter, capacity: int) -> Counter:
    """What is left, longest first, into the open containers of least sufficient room, like ones at once, else into new ones."""
    rooms: list[list[tuple[Config, int]]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: there is a container with room r

    def put(config: Config, n: int, room: int) -> None:
        nonlocal some
        if n:
            rooms[room].append((config, n))
            some |= 1 << room

    for config, n in open_.items():
        put(config, n, capacity - sum(x * k for x, k in config))
    for length in sorted(rest, reverse=True):
        n = rest[length]
        while n:
            fit = some >> length
            room, config, there = capacity, (), n
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                config, there = rooms[room].pop()
                if not rooms[room]:
                    some &= ~(1 << room)
            each = min(n, room // length)
            number = min(there, n // each)
            if fit:
                put(config, there - number, room)
            inside = dict(config)
            inside[length] = inside.get(length, 0) + each
            put(tuple(sorted(inside.items(), reverse=True)), number, room - each * length)
            n -= each * number
    out: Counter = Counter()
    for group in rooms:
        for config, n in group:
            out[config] += n
    return out


def solve(histogram: dict[int, int], capacity: int, rounds: int = 400, rate: float = 2.0, step: float = 0.1, gap: float = 0.002, again: bool = True) -> Solution:
    """A packing of all lengths up to ``capacity``, each as often as in ``histogram``, and its bound.

    A configuration is used until it covers a share ``step`` of one of its classes, or its share of the
    ``rounds``; a price falls by exp(-``rate``) for every time its class has been covered whole. After 25, 50,
    100... rounds, and at the end, the solution is rounded; the best is kept, and the first within ``gap`` of the bound ends it.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[int(x)] for x in lengths], np.int64)
    best = Solution(best_fit(Counter(), Counter(histogram), capacity), float((lengths * counts).sum()) / capacity)
    classes = Classes(lengths, counts, capacity)
    if not len(classes.need):
        return best
    goal = float((classes.size * classes.need).sum()) / capacity
    units, room = -(-classes.size // classes.unit), capacity // classes.unit
    if units[-1] > room:
        classes.unit, units, room = 1, classes.size, capacity
    covered = np.zeros(len(classes.need))
    used: dict[tuple, float] = {}
    check = min(25, rounds)
    for r in range(1, rounds + 1):
        share = covered / classes.need
        prices = classes.price * np.exp(-rate * (share - share.min()))
        config = _taken(knapsack(prices, units, room)[1], units, room)
        at, times = np.array(list(config)), np.array(list(config.values()), float)
        amount = max(float((step * classes.need[at] / times).min()), goal / rounds)
        key = tuple(sorted(config.items(), reverse=True))
        used[key] = used.get(key, 0.0) + amount
        covered[at] += times * amount
        done = bool((covered >= classes.need).all())
        if r == check or r == rounds or done:
            check *= 2
            best.bound = max(best.bound, classes.bound(prices))
            whole, rest = _rounded(classes, used, covered)
            if again and r >= rounds // 2 and sum(x * n for x, n in rest.items()) > 0.02 * classes.volume:
                found = whole + solve(rest, capacity, rounds // 2, rate, step, gap, False).configs
            else:
                found = best_fit(whole, rest, capacity)
            if sum(found.values()) < best.containers:
                best.configs = found
            if done or best.gap <= gap:
                break
    return best


@dataclass
class Slots:
    """Where the k-th item of a length goes: runs of numbers, each shared evenly by a row of containers."""

    key: np.ndarray  # length * 2**40 + first number of the run, ascending
    first: np.ndarray
    each: np.ndarray
    base: np.ndarray
    containers: int

    @classmethod
    def of(cls, solution: Counter) -> Slots:
        taken: Counter = Counter()
        rows, base = [], 0
        for config, number in sorted(solution.items(), reverse=True):
            for length, n in config:
                rows.append((length, taken[length], n, base))
                taken[length] += n * number
            base += number
        rows.sort()
        length, first, each, start = (np.array([r[i] for r in rows], np.int64) for i in range(4))
        return cls(length * 2**40 + first, first, each, start, base)

    def container(self, length: np.ndarray, number: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, length * 2**40 + number, "right") - 1
        return self.base[at] + (number - self.first[at]) // self.each[at]


PACKING = "doc_id bigint, piece int, first_token bigint, n_tokens bigint, container_id bigint"


def _pieces(sized: DataFrame, capacity: int) -> DataFrame:
    """doc_id, row, piece, first_token, n_tokens of the pieces of all items; ``row`` is the item's own number."""
    last = F.greatest(F.lit(0), F.ceil(F.col("n_tokens") / capacity) - 1)
    pieces = sized.select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("row")).select("*", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("piece"))
    pieces = pieces.withColumn("first_token", (F.col("piece") * F.lit(capacity)).cast("bigint"))
    return pieces.withColumn("n_tokens", F.least(F.lit(capacity), F.col("n_tokens") - F.col("first_token")).cast("bigint"))


def _sized(df: DataFrame) -> DataFrame:
    return cut(df.select(F.col("doc_id").cast("bigint"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens")))


def _histogram(pieces: DataFrame) -> dict[int, int]:
    return {r["n_tokens"]: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows


def packing_report(sized: DataFrame, capacity: int = 2048, rounds: int = 400) -> DataFrame:
    """One row on the packing of ``pack``: containers, volume (in containers), bound (no packing has fewer) and gap."""
    histogram = _histogram(_pieces(_sized(sized), capacity))
    volume = sum(x * n for x, n in histogram.items()) / capacity
    histogram.pop(0, 0)
    found = solve(histogram, capacity, rounds) if histogram else Solution()
    row = (found.containers, float(volume), float(found.bound), float(found.gap) if histogram else 0.0)
    return sized.sparkSession.createDataFrame([row], "containers bigint, volume double, bound double, gap double")


def pack(sized: DataFrame, capacity: int = 2048, rounds: int = 400) -> DataFrame:
    """Assignment of every item to a container (PACKING), from doc_id and n_tokens.

    Items longer than ``capacity`` are cut into full pieces and a rest, in order; no other is split. An
    item without tokens is one piece of length 0 and goes to any container, which it doesn't fill (to 0
    where there is none); a null size counts as 0. Repeated and null doc_ids are items of their own. An
    empty table gives no rows. Containers have numbers from 0 on, without gaps.
    """
    pieces = _pieces(_sized(sized), capacity)
    histogram = _histogram(pieces)
    empty = histogram.pop(0, 0)
    slots = Slots.of(solve(histogram, capacity, rounds).configs) if histogram else None
    containers = slots.containers if slots else 0
    # the number of an item among those of its length: counted within buckets, after the sizes of the buckets before
    buckets = max(16, sum(histogram.values()) // 500_000)
    filled = pieces.filter("n_tokens > 0").withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = filled.groupBy("n_tokens", "bucket").count().select("n_tokens", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("n_tokens", "bucket").orderBy("row", "piece")
    numbered = filled.withColumn("number", F.row_number().over(within) - 1).join(offsets, ["n_tokens", "bucket"])
    numbered = numbered.select("doc_id", "piece", "first_token", "n_tokens", (F.col("number") + F.col("offset")).cast("bigint").alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = slots.container(b.column(3).to_numpy(), b.column(4).to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(found, pa.int64())], ["doc_id", "piece", "first_token", "n_tokens", "container_id"])

    none = pieces.filter("n_tokens = 0").select("doc_id", "piece", "first_token", "n_tokens", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, containers))).alias("container_id"))
    if slots is None:
        return none
    placed = numbered.mapInArrow(place, PACKING)
    return placed.unionByName(none) if empty else placed


def container_fill(packing: DataFrame, capacity: int = 2048) -> DataFrame:
    """Tokens, items and unused room of every container."""
    return packing.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items")).withColumn("unused", F.lit(capacity) - F.col("tokens"))
