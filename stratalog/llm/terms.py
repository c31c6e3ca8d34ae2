"""Occurrences and records of every term, by last-seen counters.

A task walks records in order and keeps three numbers a term: occurrences, records and the identifier
of the last record that had it; a record counts only where it differs from the last one, so no set of
records per term, or of terms per record, is ever kept. Records of a single row are counted where they
are read. Those that come more than once are told by a bitmap of hashes of fixed size, hash-partitioned
and sorted by record, so all their copies are neighbours. As the records of tasks are disjoint, their
counters add up; a term that every record has is counted in all tasks alike and meets once a task, not
once a row, in the merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.functions.analysis import tokens
from stratalog.session import cut

#: the bitmap of records that come more than once has 2 ** BITS bits; where it is full, all rows are partitioned by record
BITS = 26
COUNTS = "origin string, term string, occurrences bigint, records bigint"


def text_terms(text: Column) -> Column:
    """Terms of a text in lower case, by the engine's analyser; none for a null text."""
    return tokens(text, True)


def field_terms(fields: Column) -> Column:
    """``key~value`` of every entry with a value; none for a null map."""
    entries = F.filter(F.map_entries(fields), lambda e: e["value"].isNotNull())
    return F.coalesce(F.transform(entries, lambda e: F.concat(e["key"], F.lit("~"), e["value"])), F.array().cast("array<string>"))


class LastSeen:
    """Counters of terms over records that come in order."""

    def __init__(self) -> None:
        self.counters: dict[str, list[int]] = {}

    def add(self, terms: pa.Array, records: np.ndarray) -> None:
        """``records`` has the record of every term and never goes down, within a call and between calls."""
        if not len(terms):
            return
        coded = terms.dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        codes, records = codes[order], records[order]
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        fresh = first.copy()
        fresh[1:] |= records[1:] != records[:-1]
        starts = np.flatnonzero(first)
        occurrences = np.diff(np.append(starts, len(codes)))
        met = np.add.reduceat(fresh.astype(np.int64), starts)
        last = records[np.append(starts[1:], len(codes)) - 1]
        counters = self.counters
        for term, n, m, a, z in zip(coded.dictionary.to_pylist(), occurrences.tolist(), met.tolist(), records[starts].tolist(), last.tolist()):
            c = counters.get(term)
            if c is None:
                counters[term] = [n, m, z]
            else:
                c[0] += n
                c[1] += m - (c[2] == a)
                c[2] = z

    def take(self, current: int | None) -> tuple[list[str], list[int], list[int]]:
        """Counts so far, which are cleared; what ``current``, the last record, has met stays known."""
        kept = {t: c for t, c in self.counters.items() if c[0]}
        out = list(kept), [c[0] for c in kept.values()], [c[1] for c in kept.values()]
        self.counters = {t: [0, 0, c[2]] for t, c in self.counters.items() if c[2] == current}
        return out


def _count(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches of record, mark of the row's content, and the arrays of terms of each origin."""
    seen: dict[str, LastSeen] = {}
    before: tuple[int, int] | None = None

    def flush() -> Iterator[pa.RecordBatch]:
        for origin, s in seen.items():
            terms, n, m = s.take(before[0] if before else None)
            if terms:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([origin] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())],
                    ["origin", "term", "occurrences", "records"],
                )

    for b in batches:
        if not b.num_rows:
            continue
        records, content = b.column(0).to_numpy(), b.column(1).to_numpy()
        copy = np.zeros(b.num_rows, bool)
        copy[1:] = (records[1:] == records[:-1]) & (content[1:] == content[:-1])
        copy[0] = before == (records[0], content[0])
        keep = np.flatnonzero(~copy)
        before = (int(records[-1]), int(content[-1]))
        if not len(keep):
            continue
        for name, column in zip(b.schema.names[2:], b.columns[2:]):
            lists = column.take(pa.array(keep))
            sizes = np.diff(lists.offsets.to_numpy())
            seen.setdefault(name, LastSeen()).add(lists.flatten(), np.repeat(records[keep], sizes))
        if sum(len(s.counters) for s in seen.values()) > most:
            yield from flush()
    yield from flush()


def term_frequencies(df: DataFrame, record: str, terms: dict[str, Column], most: int = 400_000) -> DataFrame:
    """Occurrences and records of every term of every origin (COUNTS).

    ``terms`` maps an origin to a column with the array of terms of a row. Rows of one record that are
    equal in all terms are copies and count once; rows of one record that differ add their occurrences
    but are one record. A row without an identifier is a record of its own. Null and empty arrays have no
    terms, an empty table gives no rows. A task hands on its counters when it holds over ``most``.
    """
    named = df.withColumn("__record", F.col(record).cast("bigint"))
    place = F.pmod(F.xxhash64("__record"), F.lit(1 << BITS))
    twice = named.filter("__record is not null").groupBy("__record").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    words = twice.select(F.floor(place / 64).cast("bigint").alias("__word"), F.expr("shiftleft(1L, cast(pmod(xxhash64(__record), 64) as int))").alias("bit"))
    bitmap = cut(words.groupBy("__word").agg(F.bit_or("bit").alias("__bits")))  # at most 2 ** BITS / 64 rows, so it is safe to broadcast
    again = (F.coalesce("__bits", F.lit(0)).bitwiseAND(F.expr("shiftleft(1L, cast(pmod(xxhash64(__record), 64) as int))")) != 0) & F.col("__record").isNotNull()
    marked = named.withColumn("__word", F.floor(place / 64).cast("bigint")).join(F.broadcast(bitmap), "__word", "left")

    def count(rows: DataFrame, content: Column) -> DataFrame:
        rows = rows.select("__record", *[c.alias(o) for o, c in terms.items()]).withColumn("__content", content)
        return rows.select("__record", "__content", *terms)

    single = count(marked.filter(~again).withColumn("__record", F.monotonically_increasing_id()), F.lit(0).cast("bigint"))
    copies = count(marked.filter(again).repartition("__record"), F.xxhash64(*terms)).sortWithinPartitions("__record", "__content")
    partial = [rows.mapInArrow(lambda batches: _count(batches, most), COUNTS) for rows in (single, copies)]
    return partial[0].unionByName(partial[1]).groupBy("origin", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked_terms(df: DataFrame, record: str, terms: dict[str, Column], rare: int = 2, common: float = 0.1) -> DataFrame:
    """``term_frequencies`` with a mark: rare for terms of at most ``rare`` records, common for those in more than a share ``common`` of all records, else ''."""
    every = df.agg((F.count_distinct(record) + F.count_if(F.col(record).isNull())).alias("n")).scalar()
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > F.lit(common) * every, "common").otherwise("")
    return term_frequencies(df, record, terms).withColumn("mark", mark)
