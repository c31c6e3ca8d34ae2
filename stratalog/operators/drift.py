"""Schemas that drift between files: the changes from file to file, and one consistent table.

Every file's schema is a tree of fields with a type and a histogram of the sorts of their values,
gathered with partial counts over all records. Successive files of a stream are compared by an
edit distance between unordered trees: fields of equal name under one parent are paired, all the rest of
both trees are assigned together, at least cost, to renames (same type, same sort of values), moves to
another parent, removals and additions. The scripts are compiled into one projection a file, which takes
every field, nested ones too, to the place, name and type it has at the end of the stream.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalog.operators.sortedgroups import map_sorted_groups
from stratalog.session import cut

CHANGES = "origin string, stream string, file_no int, change string, field string, new_field string, depth int, old_type string, new_type string, cost double"
PROFILE = "origin string, stream string, file_no int, path string, type string, sort string, n bigint"
#: separates the names of a nested field's path
SEP = "\u0001"
_HEX = re.compile(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{12,}")
_TAGGED = re.compile(r"([A-Za-z]{1,8})([-_])[A-Za-z]?\d+")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_REPEATED = re.compile(r"([;/|])[a9]+(?:\1[a9]+)*")


def sort_of(value: str) -> str:
    """The sort of a text: numbers by length, words as they are, the rest by its shape."""
    if value.isdigit():
        return f"d{len(value)}"
    if value.isalpha() and len(value) <= 12:
        return value.lower()
    if _HEX.fullmatch(value):
        return f"hex{len(value)}"
    if m := _TAGGED.fullmatch(value):
        return f"{m[1]}{m[2]}9"
    shape = _DIGITS.sub("9", _LETTERS.sub("a", value))
    shape = _REPEATED.sub(r"\1a+", shape)
    return shape if len(shape) <= 32 else f"{shape[:16]}~{len(shape).bit_length()}"


def type_and_sort(value: object) -> tuple[str, str]:
    """Type, as JSON writes it, and sort of a value; numbers must be parsed as ``Written``."""
    if value is None:
        return "null", ""
    if isinstance(value, bool):
        return "boolean", "b"
    if isinstance(value, Written):
        whole, dot, _ = value.text.lstrip("-").partition(".")
        decimal = bool(dot) or "e" in whole.lower()
        return "decimal" if decimal else "integer", ("-" if value.text[0] == "-" else "") + f"d{len(whole)}" + dot
    if isinstance(value, str):
        return "text", sort_of(value)
    if isinstance(value, dict):
        return "object", ",".join(sorted(value))[:64]
    return "array", ",".join(sorted({type_and_sort(x)[0] for x in value}))


@dataclass(frozen=True)
class Written:
    """A number as it was written."""

    text: str


def _reject(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=Written, parse_float=Written, parse_constant=_reject)


def log_fields(entry: str | None, under: str = "Log", member: str = "fields") -> dict | None:
    """The fields of a write-ahead entry; None where it is no record, {} where it has no fields."""
    if not entry:
        return None
    try:
        found = _DECODER.decode(entry.strip())
    except (ValueError, RecursionError):
        return None
    record = found.get(under) if isinstance(found, dict) else None
    if not isinstance(record, dict):
        return None
    fields = record.get(member)
    return fields if isinstance(fields, dict) else {}


def _count(found: Counter, place: tuple, fields: dict, prefix: str = "") -> None:
    for name, value in fields.items():
        kind, sort = type_and_sort(value)
        found[(*place, prefix + name, kind, sort)] += 1
        if kind == "object":
            _count(found, place, value, prefix + name + SEP)


def _profile_batches(batches: Iterator[pa.RecordBatch], origin: str, nested: bool, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = list(found.items())
        columns = [pa.array([origin] * len(rows), pa.string())]
        for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())):
            columns.append(pa.array([k[i] for k, _ in rows], t))
        columns.append(pa.array([n for _, n in rows], pa.int64()))
        found.clear()
        return pa.RecordBatch.from_arrays(columns, ["origin", "stream", "file_no", "path", "type", "sort", "n"])

    for b in batches:
        for stream, file_no, value in zip(*(b.column(i).to_pylist() for i in range(3))):
            fields = log_fields(value) if nested else None if value is None else dict(value)
            if fields is None:
                continue
            place = (stream, file_no)
            found[(*place, "", "record", "")] += 1
            _count(found, place, fields)
            if len(found) > most:
                yield flush()
    if found:
        yield flush()


def schema_profiles(df: DataFrame, origin: str, stream: str, file_no: str, fields: str, nested: bool) -> DataFrame:
    """Counts of every field, type and sort of value in every file (PROFILE).

    ``fields`` is a column of JSON entries (``nested``) or a map of texts. Rows that are no records
    (invalid JSON, no object under Log; null maps) are left out. The path '' counts the records.
    """
    picked = df.select(stream, F.col(file_no).cast("int"), fields).filter(F.col(stream).isNotNull() & F.col(file_no).isNotNull())
    partial = picked.mapInArrow(lambda batches: _profile_batches(batches, origin, nested), PROFILE)
    return partial.groupBy("origin", "stream", "file_no", "path", "type", "sort").agg(F.sum("n").alias("n"))


@dataclass
class Node:
    """A field of one file: how often it occurs, its values by type and sort, and its members."""

    name: str = ""
    n: int = 0
    types: Counter = field(default_factory=Counter)
    sorts: dict[str, Counter] = field(default_factory=dict)
    members: dict[str, Node] = field(default_factory=dict)

    @property
    def type(self) -> str:
        known = [(n, t) for t, n in self.types.items() if t != "null"]
        return max(known)[1] if known else ""

    @property
    def size(self) -> int:
        return 1 + sum(m.size for m in self.members.values())


def tree_of(rows: list[tuple[str, str, str, int]], least: float = 0.05) -> Node:
    """The tree of one file's profile rows (path, type, sort, n); fields in under ``least`` of the records are left out."""
    root = Node()
    for path, kind, sort, n in rows:
        if not path:
            root.n += n
            continue
        at = root
        for name in path.split(SEP):
            at = at.members.setdefault(name, Node(name))
        at.n += n
        at.types[kind] += n
        at.sorts.setdefault(kind, Counter())[sort] += n

    def prune(node: Node, records: int) -> None:
        node.members = {k: m for k, m in node.members.items() if m.n >= least * records * (1 - 1e-12)}
        for m in node.members.values():
            prune(m, m.types["object"])

    prune(root, root.n)
    return root


def likeness(a: Node, b: Node) -> float:
    """Overlap of the sorts of values of two fields of one type; 0 where the types differ."""
    if not a.type or a.type != b.type:
        return 0.0
    x, y = a.sorts[a.type], b.sorts[b.type]
    n, m = sum(x.values()), sum(y.values())
    return sum(min(x[k] / n, y[k] / m) for k in x if k in y)


def assign(cost: np.ndarray) -> list[int]:
    """Least-cost assignment of the rows of a square matrix to its columns, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner, way = np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            slack = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[owner[j] - 1] = j - 1
    return out


@dataclass(frozen=True)
class Edit:
    """One step of an edit script; paths are tuples of names."""

    change: str
    old: tuple[str, ...]
    new: tuple[str, ...]
    old_type: str
    new_type: str
    cost: float


def edit_script(a: Node, b: Node, same: float = 0.5, old: tuple = (), new: tuple = ()) -> list[Edit]:
    """The script of least cost from one tree to another, where fields of equal name under one parent are the same field.

    Removing or adding a subtree costs its size, a changed type 1, a rename under one parent between a half
    and 1, a move to another parent under the same name and type 1; renames and moves also what changes inside.
    """
    edits: list[Edit] = []
    left: list[tuple[tuple, Node]] = []
    right: list[tuple[tuple, Node]] = []

    def walk(a: Node, b: Node, at: tuple) -> None:
        for name in sorted(a.members.keys() & b.members.keys()):
            x, y = a.members[name], b.members[name]
            if x.type and y.type and x.type != y.type:
                edits.append(Edit("retyped", (*old, *at, name), (*new, *at, name), x.type, y.type, 1.0))
            else:
                walk(x, y, (*at, name))
        left.extend((at, a.members[k]) for k in sorted(a.members.keys() - b.members.keys()))
        right.extend((at, b.members[k]) for k in sorted(b.members.keys() - a.members.keys()))

    walk(a, b, ())
    n = len(left) + len(right)
    pairs: dict[int, int] = {}
    if left and right:
        cost = np.zeros((n, n))
        cost[: len(left), : len(right)] = 1e6
        for i, (at, x) in enumerate(left):
            cost[i, len(right) :] = x.size
            for j, (to, y) in enumerate(right):
                alike = likeness(x, y)
                if at == to and alike >= same:
                    cost[i, j] = 0.5 + 0.5 * (1 - alike) + sum(e.cost for e in edit_script(x, y, same))
                elif at != to and x.name == y.name and x.type == y.type:
                    cost[i, j] = 1.0 + sum(e.cost for e in edit_script(x, y, same))
        for j, (_, y) in enumerate(right):
            cost[len(left) :, j] = y.size
        for i, j in enumerate(assign(cost)[: len(left)]):
            if j < len(right) and cost[i, j] < 1e6:
                pairs[i] = j
                (at, x), (to, y) = left[i], right[j]
                inner = edit_script(x, y, same, (*old, *at, x.name), (*new, *to, y.name))
                edits.append(Edit("renamed" if at == to else "moved", (*old, *at, x.name), (*new, *to, y.name), x.type, y.type, float(cost[i, j])))
                edits += inner
    edits += [Edit("removed", (*old, *at, x.name), (*old, *at, x.name), x.type, "", x.size) for i, (at, x) in enumerate(left) if i not in pairs]
    edits += [Edit("added", (*new, *to, y.name), (*new, *to, y.name), "", y.type, y.size) for j, (to, y) in enumerate(right) if j not in pairs.values()]
    return edits


def _compare(table: pa.Table, starts: np.ndarray, least: float, same: float) -> pa.Table:
    """Changes of whole pairs of files; side 0 holds the earlier file's profile, side 1 the later one's."""
    ends = [*starts[1:].tolist(), table.num_rows]
    cols = {c: table.column(c).to_pylist() for c in ("origin", "stream", "file_no", "side", "path", "type", "sort", "n")}
    out: list[tuple] = []
    for a, b in zip(starts.tolist(), ends):
        sides: tuple[list, list] = ([], [])
        for i in range(a, b):
            sides[cols["side"][i]].append((cols["path"][i], cols["type"][i], cols["sort"][i], cols["n"][i]))
        if not sides[0] or not sides[1]:
            continue
        for e in edit_script(tree_of(sides[0], least), tree_of(sides[1], least), same):
            where = (cols["origin"][a], cols["stream"][a], cols["file_no"][a])
            out.append((*where, e.change, ".".join(e.old), ".".join(e.new), len(e.old), e.old_type, e.new_type, e.cost))
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64()]
    names = ["origin", "stream", "file_no", "change", "field", "new_field", "depth", "old_type", "new_type", "cost"]
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, types))})


def schema_changes(profiles: DataFrame, least: float = 0.05, same: float = 0.5) -> DataFrame:
    """Changes from each file of a stream to the next one present (CHANGES), from ``schema_profiles``.

    ``field`` and ``new_field`` are dotted paths; they are equal unless renamed or moved. A file without
    records is not present. No group is larger than the profiles of two files. The profiles are used three
    times and cut first, so records are read once.
    """
    profiles = cut(profiles)
    files = profiles.filter("path = ''").select("origin", "stream", "file_no").distinct()
    order = Window.partitionBy("origin", "stream").orderBy("file_no")
    later = files.withColumn("later", F.lead("file_no").over(order)).filter("later is not null")
    earlier = profiles.join(later, ["origin", "stream", "file_no"]).select(
        "origin", "stream", F.col("later").alias("file_no"), F.lit(0).alias("side"), "path", "type", "sort", "n"
    )
    both = earlier.unionByName(profiles.withColumn("side", F.lit(1)))
    key = ["origin", "stream", "file_no"]
    both = both.withColumns({"h1": F.xxhash64(*key), "h2": F.hash(*key)})
    return map_sorted_groups(both, ["h1", "h2"], ["side", "path", "type", "sort"], lambda t, s: _compare(t, s, least, same), CHANGES)


def field_changes(changes: DataFrame) -> DataFrame:
    """Changes of top-level fields: stream, file_no, change, field, new_field. A move out of or into a nested object is a removal or an addition."""
    changes = cut(changes)
    top = lambda c: ~F.col(c).contains(".")
    plain = changes.filter((F.col("change") != "moved") & (F.col("depth") == 1))
    out = changes.filter((F.col("change") == "moved") & (F.col("depth") == 1)).withColumns({"change": F.lit("removed"), "new_field": F.col("field")})
    into = changes.filter((F.col("change") == "moved") & top("new_field")).withColumns({"change": F.lit("added"), "field": F.col("new_field")})
    every = plain.unionByName(out).unionByName(into)
    return every.select("stream", "file_no", "change", "field", "new_field").distinct()


def flat_fields(entry: str | None) -> dict[str, str | None] | None:
    """The fields of a write-ahead entry by dotted path, as texts: members of objects one by one, arrays and empty objects as JSON."""
    fields = log_fields(entry)
    if fields is None:
        return None
    out: dict[str, str | None] = {}

    def walk(members: dict, prefix: str) -> None:
        for name, value in members.items():
            if isinstance(value, dict) and value:
                walk(value, f"{prefix}{name}.")
            elif value is None or isinstance(value, str):
                out[prefix + name] = value
            else:
                out[prefix + name] = _json(value)

    walk(fields, "")
    return out


def _json(value: object) -> str:
    """JSON of a parsed value, numbers as they were written."""
    if isinstance(value, Written):
        return value.text
    if isinstance(value, list):
        return f"[{', '.join(map(_json, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_json(k)}: {_json(v)}" for k, v in value.items()) + "}"
    return json.dumps(value, ensure_ascii=False)


def flat_records(df: DataFrame, entry: str) -> DataFrame:
    """Adds ``fields`` (map of texts, see ``flat_fields``; null for rows that are no records) in place of the column ``entry``."""
    keep = [c for c in df.columns if c != entry]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "fields map<string,string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [flat_fields(x) for x in b.column(len(keep)).to_pylist()]
            maps = pa.array([None if f is None else list(f.items()) for f in found], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], maps], [*keep, "fields"])

    return df.select(*keep, entry).mapInArrow(run, schema)


def projections(changes: DataFrame) -> DataFrame:
    """The steps of every stream that its earlier files must follow: origin, stream, steps.

    ``steps`` (file_no, inner first, change, field, new_field, new_type) are renames, moves and new types, in order. A record
    of a file follows those of later files, at most one rename or move a file for each field.
    """
    step = F.struct("file_no", (-F.col("depth")).alias("order"), "change", "field", "new_field", "new_type")
    return changes.filter(F.col("change").isin("renamed", "moved", "retyped")).groupBy("origin", "stream").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def _brought(value: Column, kind: Column) -> Column:
    """A text as another type is written; null where it can't be."""
    number = value.try_cast("decimal(38,6)")
    return (
        F.when(kind == "integer", F.when(number == F.floor(number), F.floor(number).cast("string")))
        .when(kind == "decimal", F.when(value.try_cast("double").isNotNull(), F.when(value.rlike("[.eE]"), value).otherwise(F.concat(value, F.lit(".0")))))
        .when(kind == "boolean", F.when(F.lower(value).isin("true", "1"), "true").when(F.lower(value).isin("false", "0"), "false"))
        .when(kind == "object", F.when(value.startswith("{"), value))
        .when(kind == "array", F.when(value.startswith("["), value))
        .otherwise(value)
    )


def consistent_table(records: DataFrame, origin: str, fields: Column, changes: DataFrame, broadcast_rows: int = 20_000) -> DataFrame:
    """Every record with its fields at the place, by the name and in the type they have at the end of the stream.

    ``records`` has stream and file_no; ``fields`` is a map of texts by dotted path. The result has all other
    columns of ``records``, ``consistent`` (map of texts; null for null fields) and ``unfit`` (fields whose value
    can't be written in the final type: they keep what they have). Where a file has both a field and another
    that is projected to its name, the one that keeps its name wins. Steps are broadcast up to ``broadcast_rows`` streams.
    """
    maps = cut(projections(changes).filter(F.col("origin") == origin).select("stream", F.col("steps").alias("__steps")))
    if maps.limit(broadcast_rows + 1).count() <= broadcast_rows:
        maps = F.broadcast(maps)
    joined = records.withColumn("__fields", fields).join(maps, "stream", "left")
    later = F.filter(F.coalesce("__steps", F.array()), lambda x: x["file_no"] > F.col("file_no"))

    def follow(at: Column, step: Column) -> Column:
        inside = (at["path"] == step["field"]) | at["path"].startswith(F.concat(step["field"], F.lit(".")))
        path = F.concat(step["new_field"], F.substr(at["path"], F.length(step["field"]) + 1))
        goes = inside & (step["change"] != "retyped") & (at["file_no"] < step["file_no"])
        kind = F.when((step["change"] == "retyped") & (at["path"] == step["field"]), step["new_type"]).otherwise(at["kind"])
        return F.struct(F.when(goes, path).otherwise(at["path"]).alias("path"), F.when(goes, step["file_no"]).otherwise(at["file_no"]).alias("file_no"), kind.alias("kind"))

    start = lambda k: F.struct(k.alias("path"), F.col("file_no").cast("int").alias("file_no"), F.lit("").alias("kind"))
    ends = F.transform(F.map_entries("__fields"), lambda e: F.struct(F.aggregate(F.col("__later"), start(e["key"]), follow).alias("to"), e["key"].alias("was"), e["value"].alias("value")))
    joined = joined.withColumn("__later", later).withColumn("__ends", ends)
    entries = F.transform(
        "__ends",
        lambda e: F.struct(e["to"]["path"].alias("key"), (e["to"]["path"] == e["was"]).alias("kept"), F.coalesce(_brought(e["value"], e["to"]["kind"]), e["value"]).alias("value"),
                           (e["value"].isNotNull() & _brought(e["value"], e["to"]["kind"]).isNull()).alias("unfit")),
    )
    joined = joined.withColumn("__entries", entries)
    keys = F.array_distinct(F.transform("__entries", lambda e: e["key"]))
    best = lambda k: F.array_max(F.transform(F.filter("__entries", lambda e: e["key"] == k), lambda e: F.struct(e["kept"], e["value"])))["value"]
    unfit = F.transform(F.filter("__entries", lambda e: e["unfit"]), lambda e: e["key"])
    return joined.withColumns({"consistent": F.map_from_arrays(keys, F.transform(keys, best)), "unfit": F.array_sort(unfit)}).drop("__steps", "__fields", "__later", "__ends", "__entries")
