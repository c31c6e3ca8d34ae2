"""The engine as a user meets it: ingest, search, metric queries, maintenance."""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.plans import aggs, dsl, metrics
from stratalog.session import ship, written
from stratalog.sources import ingest
from stratalog.sources.store import DEFAULT_INDEX, Catalog


class Engine:
    """One catalog of indices and the operations on it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = ship(spark)
        self.catalog = Catalog(spark, root)
        self._names = dsl.Compiler(terms="terms", day="dt")

    def ping(self) -> str:
        return "OK" if self.spark.range(1).count() == 1 else "no session"

    def get_index_dir(self, index: str = DEFAULT_INDEX) -> str:
        return self.catalog.path(index)

    # ingest

    def _bodies(self, bodies: Any) -> DataFrame:
        if isinstance(bodies, DataFrame):
            return bodies
        text = bodies if isinstance(bodies, str) else json.dumps(bodies)
        return self.spark.createDataFrame([(text,)], "body string")

    def append_log(self, index: str, bodies: Any) -> DataFrame:
        """Appends one object, an array of them, or a frame of bodies; gives the new ids."""
        objects = ingest.json_objects(self._bodies(bodies))
        if not isinstance(bodies, DataFrame) and objects.filter("error is not null").limit(1).count():
            raise ValueError("Invalid entry")
        return self.catalog.append_logs(index, ingest.logs_of(objects)).select("doc_id")

    def append_metric(self, index: str, bodies: Any) -> None:
        self.catalog.append_metrics(index, ingest.metrics_of(ingest.json_objects(self._bodies(bodies))))

    def bulk(self, body: str) -> dict:
        """A bulk request; indices are made as needed. Gives whether some actions failed, and the number of items."""
        lines = [(0, i, x) for i, x in enumerate(body.replace("},\n", "}\n").splitlines())]
        frame = self.spark.createDataFrame(lines, "request int, line_no int, body string")
        pairs = ingest.bulk_pairs(frame)
        names = [r["index_name"] for r in pairs.filter("error is null and action in ('index', 'create')").select("index_name").distinct().collect()]
        logs = ingest.bulk_logs(frame)
        for name in names:
            self.catalog.append_logs(name, logs.filter(F.col("index_name") == name))
        counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("bad")).first()
        return {"errors": counts["bad"] > 0, "items": counts["n"]}

    # search

    def search_logs(self, index: str, query: str | dict | None = None, q: str | None = None, start=None, end=None) -> DataFrame:
        """Hits of a JSON body, or of the words ``q`` where there is no body."""
        if not query and not q:
            raise dsl.QueryError("no query")
        body = query or dsl.url_query(q)
        needed = self._names.required(dsl.parse_body(body).query)
        return dsl.search(self.catalog.logs(index, start, end, needed).drop("batch"), body, self._names)

    def answer(self, index: str, query: str | dict | None = None, q: str | None = None, start=None, end=None) -> DataFrame:
        """The answer of a search as rows, in order, one a hit, with what the envelope says of them all; there may be any number of hits.

        They are found within the timeout of the body before this returns, and stay in the checkpoint folder until the driver ends.
        """

        def find() -> tuple[DataFrame, int]:
            found = written(self.search_logs(index, query, q, start, end).select("doc_id", "ts", "fields", "text"))
            return found, found.count()

        parsed = dsl.parse_body(query) if query else None
        found, total = self._within(parsed.timeout_s if parsed else None, find)
        ordered = found.orderBy(*dsl.sorting(self._names, parsed.sort if parsed else []))
        return ordered.select(
            F.lit(False).alias("timed_out"), F.lit(total).cast("bigint").alias("total"), F.lit("eq").alias("relation"),
            F.col("doc_id").alias("_id"), F.lit(1.0).alias("_score"), F.expr("unix_micros(ts) div 1000").alias("timestamp"), "text", "fields",
        )

    def hits(self, index: str, query: str | dict | None = None, q: str | None = None, start=None, end=None, most: int = 100_000) -> dict:
        """The answer of a search as an envelope in the driver; more than ``most`` hits are an error: give a size in the body, or use ``answer``."""
        began = dt.datetime.now()
        limit = dsl.parse_body(query).timeout_s if query else None
        rows = self._within(limit, lambda: self.search_logs(index, query, q, start, end).limit(most + 1).collect())
        if len(rows) > most:
            raise dsl.QueryError(f"more than {most} hits")
        out = [
            {"_id": r["doc_id"], "_score": 1.0, "_source": {"timestamp": int(r["ts"].timestamp() * 1000), "text": r["text"], **(r["fields"] or {})}}
            for r in rows
        ]
        took = int((dt.datetime.now() - began).total_seconds() * 1000)
        return {"took": took, "timed_out": False, "hits": {"total": {"value": len(out), "relation": "eq"}, "max_score": 1.0 if out else None, "hits": out}}

    def _within(self, seconds: float | None, run: Callable[[], Any]) -> Any:
        """Runs jobs in a group of their own and cancels it after a while."""
        if not seconds:
            return run()
        context = self.spark.sparkContext
        group = f"search-{id(run)}-{dt.datetime.now().timestamp()}"
        context.setJobGroup(group, "a search with a timeout", interruptOnCancel=True)
        timer = threading.Timer(seconds, context.cancelJobGroup, [group])
        timer.start()
        try:
            return run()
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)

    def aggregate(self, index: str, query: str | dict, start=None, end=None) -> dict[str, DataFrame]:
        """The aggregations of a body by name; pipelines over buckets refer to a sibling by its path."""
        parsed = dsl.parse_body(query)
        hits = self.catalog.logs(index, start, end)
        hits = hits.filter(self._names.compile(parsed.query)) if parsed.query else hits
        out: dict[str, DataFrame] = {}
        for name, spec in parsed.aggs.items():
            kind = next(iter(spec))
            if kind in ("avg_bucket", "sum_bucket"):
                path = spec[kind]["buckets_path"]
                out[name] = aggs.pipeline(out[path.split(">")[0]], kind, path, name)
            else:
                out[name] = aggs.aggregate(hits, spec, self._names, name)
        return out

    def summarize(self, index: str, q: str, k: int = 100, summarizer: Callable[[list[str]], str] | None = None) -> dict:
        """The newest ``k`` hits and a summary of them: by the given function, else their most frequent texts."""
        rows = self.search_logs(index, q=q).limit(k).collect()
        texts = [r["text"] for r in rows]
        counts: dict[str, int] = {}
        for t in texts:
            counts[t] = counts.get(t, 0) + 1
        top = sorted(counts, key=lambda t: (-counts[t], t))[:5]
        return {"summary": summarizer(texts) if summarizer else "\n".join(top), "hits": texts}

    def search_metrics(self, index: str, query: str, start=None, end=None, eval_ts: dt.datetime | None = None) -> DataFrame:
        """The vector of an expression, newest series first."""
        engine = metrics.MetricEngine(self.catalog.metrics(index, start, end), eval_ts, start, end)
        return metrics.newest_first(engine.query(query))

    def metric_answer(self, index: str, query: str, start=None, end=None, eval_ts: dt.datetime | None = None, most: int = 1_000_000) -> dict:
        """The answer of a metric query: one value for series of one point, all values else; more than ``most`` points are an error."""
        series: dict[str, dict] = {}
        rows = self.search_metrics(index, query, start, end, eval_ts).limit(most + 1).collect()
        if len(rows) > most:
            raise metrics.ExpressionError(f"more than {most} points")
        for r in rows:
            entry = series.setdefault(r["label_key"], {"metric": r["labels"] or {}, "values": []})
            entry["values"].append([int(r["ts"].timestamp()), str(r["value"])])
        single = all(len(s["values"]) == 1 for s in series.values())
        result = [{"metric": s["metric"], "value": s["values"][0]} if single else s for s in series.values()]
        return {"status": "success", "data": {"resultType": "vector" if single else "matrix", "result": result}}

    def label_names(self, index: str) -> DataFrame:
        return metrics.label_names(self.catalog.metrics(index))

    def label_values(self, index: str, label: str) -> DataFrame:
        return metrics.label_values(self.catalog.metrics(index), label)

    # maintenance

    def create_index(self, index: str) -> None:
        self.catalog.create(index)

    def delete_index(self, index: str) -> list[str]:
        return self.catalog.drop(index)

    def delete_by_query(self, index: str, query: str | dict, start=None, end=None) -> int:
        """Marks the hits of a body as deleted; gives their number."""
        parsed = dsl.parse_body(query)
        if not parsed.query:
            raise dsl.QueryError("no query")
        return self.catalog.delete(index, self._names.compile(parsed.query), start, end)

    def flush(self, index: str = DEFAULT_INDEX) -> None:
        self.catalog.flush(index)

    def apply_retention(self, index: str, days: int = 30, now: dt.datetime | None = None) -> list[str]:
        return self.catalog.retain(index, days, now or dt.datetime.now(dt.timezone.utc))

    def compact(self, index: str, target_mb: int = 512) -> dict[str, int]:
        return self.catalog.compact(index, target_mb)
