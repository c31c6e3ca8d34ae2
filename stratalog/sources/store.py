"""Indices as partitioned Parquet: append, read, delete by query, retention, compaction.

An index is a folder with ``logs`` and ``metrics``, each partitioned by day and batch, ``tombstones``, the ids
of deleted documents, and ``postings``, which tell for every term of a batch the days it is met on. Any file
system that Spark knows may hold it. Reads are lazy and prune days by time and, for searches that need a
term, days and batches without it; deleted documents are left out by an anti join until compaction drops
them for good. Every write is a batch of its own, so one that is repeated takes the place of what it wrote
before. An index has one writer at a time; compaction counts as one.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.schema import LOGS, METRICS, TOMBSTONES
from stratalog.sources.ingest import number_rows, with_terms

DEFAULT_INDEX = "default"
#: folders of the postings, by hash of the term
BUCKETS = 16


class IndexError_(ValueError):
    """An index that is missing, exists already or is protected."""


@dataclass
class Catalog:
    """All indices under one root path (``file:``, ``s3a:``, ``abfs:``, ``gs:``, ``hdfs:``)."""

    spark: SparkSession
    root: str
    compression: str = "zstd"
    rows_per_file: int = 5_000_000

    # paths

    def path(self, index: str) -> str:
        """The folder of an index."""
        if not index or index != index.strip("./") or "/" in index:
            raise IndexError_(f"no name for an index: {index!r}")
        return f"{self.root.rstrip('/')}/{index}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, index: str) -> bool:
        fs, p = self._fs(self.path(index))
        return fs.exists(p)

    def indices(self) -> list[str]:
        """Names of all indices."""
        fs, p = self._fs(self.root)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def flush(self, index: str) -> None:
        """Makes all appended rows readable: writes are committed as they return, so there is only an open compaction to finish."""
        if not self.exists(index):
            raise IndexError_(f"no such index: {index}")
        self._recover(index)
        self.spark.catalog.clearCache()

    def create(self, index: str) -> None:
        """Makes an empty index; one of that name is an error."""
        if self.exists(index):
            raise IndexError_(f"the index {index} exists")
        fs, p = self._fs(self.path(index))
        fs.mkdirs(p)

    def drop(self, index: str) -> list[str]:
        """Removes an index, or all but the default one for ``*`` and ``_all``; gives the names."""
        if index in ("*", "_all"):
            names = [i for i in self.indices() if i != DEFAULT_INDEX]
        elif index == DEFAULT_INDEX:
            raise IndexError_("the default index cannot be removed")
        elif not self.exists(index):
            raise IndexError_(f"no such index: {index}")
        else:
            names = [index]
        for name in names:
            fs, p = self._fs(self.path(name))
            fs.delete(p, True)
        return names

    # writing

    def _append(self, df: DataFrame, path: str, batch: str, mode: str = "append") -> None:
        writer = df.withColumn("batch", F.lit(batch)).write.mode(mode).option("compression", self.compression).option("maxRecordsPerFile", self.rows_per_file)
        writer.partitionBy("dt", "batch").parquet(path)

    def _forget(self, index: str, batch: str, *parts: str) -> None:
        """Removes what an earlier try of a batch may have written."""
        for part in parts:
            fs, p = self._fs(f"{self.path(index)}/{part}/batch={batch}")
            for s in fs.globStatus(p) or []:
                fs.delete(s.getPath(), True)

    def append_logs(self, index: str, logs: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends documents (ts, fields, text; and doc_id, if they have one), with their terms; makes the index where it is missing.

        Documents without ids get the next free ones. A ``batch`` of a name that was written before replaces it.
        Gives the documents as they were written.
        """
        if batch is not None:
            self._forget(index, batch, "logs/dt=*", "postings/bucket=*")
        batch = batch or f"a{uuid.uuid4().hex}"
        if "doc_id" not in logs.columns:
            logs, rows = number_rows(logs.select("ts", "fields", "text"), first := self.next_id(index))
            self._reserve(index, first + rows)
        rows = with_terms(logs.select("doc_id", "ts", "fields", "text")).withColumn("dt", F.to_date("ts"))
        self._append(rows, f"{self.path(index)}/logs", batch)
        written = self.spark.read.schema(rows.schema).option("basePath", f"{self.path(index)}/logs").parquet(f"{self.path(index)}/logs/dt=*/batch={batch}") if self._has(index, batch) else rows.limit(0)
        self._post(index, written, batch)
        return written

    def _has(self, index: str, batch: str) -> bool:
        fs, p = self._fs(f"{self.path(index)}/logs/dt=*/batch={batch}")
        return bool(fs.globStatus(p))

    def _post(self, index: str, logs: DataFrame, batch: str, mode: str = "append") -> None:
        """The days of every term of a batch, in buckets by term."""
        terms = logs.select(F.explode(F.array_distinct("terms")).alias("term"), "dt").distinct()
        rows = terms.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), "batch": F.lit(batch)})
        rows.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode(mode).option("compression", self.compression).partitionBy("bucket", "batch").parquet(f"{self.path(index)}/postings")

    def days_of(self, index: str, terms: list[str], most: int = 10_000) -> list[tuple[str, str]] | None:
        """Days and batches in which all of the terms are met; None where that is unknown or more than ``most``."""
        fs, p = self._fs(f"{self.path(index)}/postings")
        if not terms or not fs.exists(p):
            return None
        wanted = sorted(set(terms))
        postings = self.spark.read.schema("term string, dt date, bucket int, batch string").parquet(f"{self.path(index)}/postings")
        bucket = F.col("bucket").isin([int(r[0]) for r in self.spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).collect()])
        found = postings.filter(bucket & F.col("term").isin(wanted)).groupBy("dt", "batch").agg(F.count_distinct("term").alias("n"))
        rows = found.filter(F.col("n") == len(wanted)).select("dt", "batch").limit(most + 1).collect()
        return None if len(rows) > most else [(str(r["dt"]), r["batch"]) for r in rows]

    def _reserve(self, index: str, free: int) -> None:
        fs, p = self._fs(f"{self.path(index)}/_next_id")
        out = fs.create(p, True)
        out.write(bytearray(str(free).encode()))
        out.close()

    def next_id(self, index: str) -> int:
        """The first free document id, as noted beside the index; one above the highest where nothing is noted."""
        fs, p = self._fs(f"{self.path(index)}/_next_id")
        if fs.exists(p):
            stream = fs.open(p)
            try:
                return int(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        found = self._read(index, "logs", LOGS)
        highest = found.agg(F.max("doc_id")).first()[0] if found is not None else None
        return 0 if highest is None else highest + 1

    def append_metrics(self, index: str, metrics: DataFrame, batch: str | None = None) -> None:
        """Appends points (name, labels, ts, value). A ``batch`` of a name that was written before replaces it."""
        if batch is not None:
            self._forget(index, batch, "metrics/dt=*")
        rows = metrics.select("name", "labels", "ts", "value").withColumn("dt", F.to_date("ts"))
        self._append(rows, f"{self.path(index)}/metrics", batch or f"a{uuid.uuid4().hex}")

    # reading

    def _read(self, index: str, part: str, schema) -> DataFrame | None:
        self._recover(index)
        fs, p = self._fs(f"{self.path(index)}/{part}")
        return self.spark.read.parquet(f"{self.path(index)}/{part}") if fs.exists(p) and (part == "tombstones" or fs.globStatus(self._fs(f"{self.path(index)}/{part}/dt=*/batch=*")[1])) else None

    def _between(self, df: DataFrame, start, end) -> DataFrame:
        if start is not None:
            t = F.lit(start).cast("timestamp")
            df = df.filter((F.col("ts") >= t) & (F.col("dt") >= F.to_date(t)))
        if end is not None:
            t = F.lit(end).cast("timestamp")
            df = df.filter((F.col("ts") <= t) & (F.col("dt") <= F.to_date(t)))
        return df

    def logs(self, index: str, start=None, end=None, having: list[str] | None = None) -> DataFrame:
        """Documents of an index that are not deleted, within a time range (both ends included).

        Days and batches without one of the terms ``having`` are not read.
        """
        found = self._read(index, "logs", LOGS)
        if found is None:
            return self.spark.createDataFrame([], LOGS).drop("index").withColumns({"terms": F.array().cast("array<string>"), "dt": F.to_date("ts"), "batch": F.lit("")})
        found = self._between(found, start, end)
        places = self.days_of(index, having) if having else None
        if places is not None:
            batches: dict[str, list[str]] = {}
            for day, batch in places:
                batches.setdefault(day, []).append(batch)
            tests = [(F.col("dt") == F.lit(day).cast("date") if day != "None" else F.col("dt").isNull()) & F.col("batch").isin(names) for day, names in sorted(batches.items())]
            found = found.filter(reduce(lambda a, b: a | b, tests) if tests else F.lit(False))
        dead = self._read(index, "tombstones", TOMBSTONES)
        return found if dead is None else found.join(dead.select("doc_id").distinct(), "doc_id", "left_anti")

    def metrics(self, index: str, start=None, end=None) -> DataFrame:
        """Points of an index within a time range."""
        found = self._read(index, "metrics", METRICS)
        if found is None:
            return self.spark.createDataFrame([], METRICS).drop("index").withColumn("dt", F.to_date("ts"))
        return self._between(found, start, end)

    # maintenance

    def delete(self, index: str, condition: Column, start=None, end=None) -> int:
        """Marks the documents that match as deleted; gives their number."""
        hits = self.logs(index, start, end).filter(condition).select("doc_id")
        before = self._read(index, "tombstones", TOMBSTONES)
        known = before.count() if before is not None else 0
        hits.write.mode("append").parquet(f"{self.path(index)}/tombstones")
        return self._read(index, "tombstones", TOMBSTONES).count() - known

    def retain(self, index: str, days: int, now: dt.datetime) -> list[str]:
        """Removes the days that end more than ``days`` days before ``now``; gives their folders. No row is read."""
        oldest = (now - dt.timedelta(days=days)).date()
        gone = []
        for part in ("logs", "metrics"):
            fs, p = self._fs(f"{self.path(index)}/{part}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                name = s.getPath().getName()
                if name.startswith("dt=") and name[3:] != "__HIVE_DEFAULT_PARTITION__" and dt.date.fromisoformat(name[3:]) < oldest:
                    fs.delete(s.getPath(), True)
                    gone.append(f"{part}/{name}")
        return sorted(gone)

    def compact(self, index: str, target_mb: int = 512) -> dict[str, int]:
        """Rewrites the days of an index into files of about ``target_mb``, without deleted documents.

        The new files are written beside the index. Then a note of what they replace commits the change: only after it is
        anything removed and are the new files moved in, and whoever finds the note finishes that. Without it they are
        thrown away. Gives the number of files before and after.
        """
        self._recover(index)
        root, jpath = self.path(index), self.spark._jvm.org.apache.hadoop.fs.Path
        fs, staged = self._fs(f"{root}/_compact")
        fs.delete(staged, True)
        counts, old = {"before": 0, "after": 0}, []
        batch = f"c{uuid.uuid4().hex}"
        for part in ("logs", "metrics"):
            p = jpath(f"{root}/{part}")
            rows = (self.logs(index) if part == "logs" else self.metrics(index)) if fs.exists(p) else None
            if rows is None:
                continue
            counts["before"] += self._files(fs, p)
            old += [f"{part}/{x.getPath().getParent().getName()}/{x.getPath().getName()}" for x in fs.globStatus(jpath(f"{root}/{part}/dt=*/batch=*")) or []]
            tasks = max(1, -(-fs.getContentSummary(p).getLength() // (target_mb * 1024 * 1024)))
            rows = rows.drop("batch")
            spread = rows.repartition(int(tasks) * 4, "dt", F.pmod(F.xxhash64("ts"), F.lit(int(tasks)))) if tasks > 1 else rows.repartition("dt")
            self._append(spread.sortWithinPartitions("dt", "ts"), f"{root}/_compact/{part}", batch, "overwrite")
            if part == "logs" and fs.globStatus(jpath(f"{root}/_compact/logs/dt=*")):
                written = self.spark.read.parquet(f"{root}/_compact/logs")
                old += [f"postings/{x.getPath().getParent().getName()}/{x.getPath().getName()}" for x in fs.globStatus(jpath(f"{root}/postings/bucket=*/batch=*")) or []]
                terms = written.select(F.explode(F.array_distinct("terms")).alias("term"), "dt").distinct()
                posted = terms.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"), "batch": F.lit(batch)}).repartition("bucket").sortWithinPartitions("bucket", "term")
                posted.write.mode("overwrite").option("compression", self.compression).partitionBy("bucket", "batch").parquet(f"{root}/_compact/postings")
        if fs.exists(jpath(f"{root}/tombstones")):
            old.append("tombstones")
        draft = jpath(f"{root}/_commit.draft")
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(old).encode()))
        out.close()
        fs.rename(draft, jpath(f"{root}/_commit"))
        self._recover(index)
        for part in ("logs", "metrics"):
            p = jpath(f"{root}/{part}")
            counts["after"] += self._files(fs, p) if fs.exists(p) else 0
        self.spark.catalog.clearCache()
        return counts

    def _recover(self, index: str) -> None:
        """Finishes a compaction that was committed; every step may be repeated."""
        root, jpath = self.path(index), self.spark._jvm.org.apache.hadoop.fs.Path
        fs, note = self._fs(f"{root}/_commit")
        if not fs.exists(note):
            return
        stream = fs.open(note)
        try:
            old = bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()
        for name in filter(None, old):
            fs.delete(jpath(f"{root}/{name}"), True)
        for s in [*(fs.globStatus(jpath(f"{root}/_compact/*/*=*/batch=*")) or [])]:
            at = s.getPath()
            home = jpath(f"{root}/{at.getParent().getParent().getName()}/{at.getParent().getName()}")
            fs.mkdirs(home)
            fs.rename(at, jpath(home, at.getName()))
        fs.delete(jpath(f"{root}/_compact"), True)
        fs.delete(note, False)

    @staticmethod
    def _files(fs, p) -> int:
        n, found = 0, fs.listFiles(p, True)
        while found.hasNext():
            n += found.next().getPath().getName().endswith(".parquet")
        return n


def segments_to_merge(summaries: DataFrame, target_mb: float) -> DataFrame:
    """Greedy choice of segments by end time while their sizes fit the target: the longest such prefix.

    ``summaries``: segment, end_time, size_mb. Segments are file groups, a few thousand at most, so the one
    ordered window over them is small.
    """
    from pyspark.sql.window import Window

    order = Window.partitionBy(F.lit(1)).orderBy("end_time", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return summaries.withColumn("total_mb", F.sum("size_mb").over(order)).filter(F.col("total_mb") <= target_mb)


def overlaps(start: Column, end: Column, low, high) -> Column:
    """Whether two closed ranges of time have a point in common."""
    return (end >= F.lit(low)) & (start <= F.lit(high))
