import itertools
import json

import numpy as np
from pyspark.sql import functions as F

from stratalog.operators import drift
from stratalog.operators.drift import assign, edit_script, schema_changes, schema_profiles, tree_of

WAL = "wal_id long, stream string, file_no int, line_no int, entry string, path string, n int"


def _entry(fields, **more):
    return json.dumps({"Log": {"time": 1, "fields": fields, **more}})


def _wal(spark, files):
    """files: {(stream, file): [entry, ...]}"""
    rows = [(i, s, f, i, e, "x", 1) for (s, f), entries in files.items() for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, WAL)


def _changes(spark, files):
    profiles = schema_profiles(_wal(spark, files), "log_wal", "stream", "file_no", "entry", True)
    return schema_changes(profiles)


def _found(spark, files):
    return {tuple(r) for r in drift.field_changes(_changes(spark, files)).collect()}


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for n in range(1, 7):
        cost = rng.uniform(0, 10, (n, n))
        got = sum(cost[i, j] for i, j in enumerate(assign(cost)))
        assert abs(got - min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


def test_rename_add_remove_retype(spark):
    one = [_entry({"host": f"box-{i}", "took": 10 + i, "code": "200", "gone": True}) for i in range(40)]
    two = [_entry({"node": f"box-{i}", "took": 10.5 + i, "code": "404", "new": f"org_a{i}"}) for i in range(40)]
    got = _found(spark, {("s", 1): one, ("s", 4): two})
    assert got == {
        ("s", 4, "renamed", "host", "node"), ("s", 4, "retyped", "took", "took"),
        ("s", 4, "removed", "gone", "gone"), ("s", 4, "added", "new", "new"),
    }


def test_rename_needs_type_and_sort(spark):
    one = [_entry({"a": f"box-{i}", "b": 5}) for i in range(40)]
    two = [_entry({"x": f"2024-01-{i:02}", "y": "5"}) for i in range(10, 50)]
    assert {c[2] for c in _found(spark, {("s", 1): one, ("s", 2): two})} == {"removed", "added"}


def test_rare_fields_stray_values_and_bad_lines(spark):
    one = [_entry({"a": i}) for i in range(40)] + ["", None, '{"Log": ', "[]", '{"Log": 5}', '{"Metric": {"a": 1}}', '{"Log": {"fields": {"a": NaN}}}']
    two = [_entry({"a": i if i else "x", **({"aa": 1} if i == 3 else {})}) for i in range(40)]
    three = [_entry({"a": None}) for i in range(38)] + [_entry(None), json.dumps({"Log": {}})]
    assert _found(spark, {("s", 1): one, ("s", 2): two, ("s", 3): three}) == set()


def test_one_in_twenty_is_enough(spark):
    one = [_entry({"a": 1}) for i in range(40)]
    two = [_entry({"a": 1, **({"b": 1} if i < 2 else {})}) for i in range(40)]
    assert _found(spark, {("s", 1): one, ("s", 2): two}) == {("s", 2, "added", "b", "b")}


def test_numbers_as_written(spark):
    one = [json.dumps({"Log": {"fields": {"a": 1}}}) for _ in range(5)]
    two = ['{"Log": {"fields": {"a": 29.0}}}'] * 5
    three = ['{"Log": {"fields": {"a": 1e3}}}'] * 5
    assert _found(spark, {("s", 1): one, ("s", 2): two, ("s", 3): three}) == {("s", 2, "retyped", "a", "a")}


def test_nested_changes_and_moves(spark):
    one = [_entry({"at": {"lat": 1.5, "lon": 2.5}, "unit": "kB"}) for _ in range(9)]
    two = [_entry({"at": {"lat": 1.5, "long": 2.5, "unit": "kB"}}) for _ in range(9)]
    changes = {tuple(r)[3:6] for r in _changes(spark, {("s", 1): one, ("s", 2): two}).collect()}
    assert changes == {("renamed", "at.lon", "at.long"), ("moved", "unit", "at.unit")}
    assert _found(spark, {("s", 1): one, ("s", 2): two}) == {("s", 2, "removed", "unit", "unit")}


def test_script_of_equal_trees_is_empty():
    rows = [("", "record", "", 10), ("a", "text", "x", 10), ("b", "object", "c", 10), ("b\u0001c", "integer", "d1", 10)]
    assert edit_script(tree_of(rows), tree_of(rows)) == []


def test_consistent_table_follows_renames(spark):
    maps = [("s", 1, {"host": "box-1"}), ("s", 2, {"node": "box-2"}), ("s", 3, {"machine": "box-3"}), ("s", 3, None), ("t", 1, {"host": "box-9"})]
    rows = [(s, f, m, f"{i}", "clash") for i, (s, f, m) in enumerate(maps * 20)]
    df = spark.createDataFrame(rows, "stream string, file_no int, fields map<string,string>, id string, old string")
    changes = schema_changes(schema_profiles(df, "m", "stream", "file_no", "fields", False))
    out = drift.consistent_table(df, "m", F.col("fields"), changes)
    assert out.count() == len(rows)
    got = {(r["stream"], r["file_no"], tuple(sorted(r["consistent"].items())) if r["consistent"] is not None else None) for r in out.collect()}
    assert got == {("s", 1, (("machine", "box-1"),)), ("s", 2, (("machine", "box-2"),)), ("s", 3, (("machine", "box-3"),)), ("s", 3, None), ("t", 1, (("host", "box-9"),))}


def test_moves_compete_with_renames():
    base = [("", "record", "", 10), ("at", "object", "x", 10), ("at\u0001x", "integer", "d1", 10)]
    one = [*base, ("unit", "text", "kb", 10), ("size", "text", "kb", 10)]
    two = [*base, ("at\u0001unit", "text", "kb", 10), ("length", "text", "kb", 10)]
    script = {(e.change, e.old, e.new) for e in edit_script(tree_of(one), tree_of(two))}
    # renaming unit to length would cost as much as renaming size, but leave a removal and an addition
    assert script == {("moved", ("unit",), ("at", "unit")), ("renamed", ("size",), ("length",))}


def test_projections_take_nested_names_moves_and_types(spark):
    files = {
        ("s", 1): [_entry({"geo": {"lat": 1.5, "lon": i}, "unit": "kB", "took": i, "tags": ["a", 1.50]}) for i in range(9)],
        ("s", 2): [_entry({"geo": {"lat": 1.5, "lng": i, "unit": "kB"}, "took": i + 0.5, "tags": []}) for i in range(9)],
        ("s", 3): [_entry({"pos": {"lat": 1.5, "lng": i, "unit": "kB"}, "took": str(i), "tags": []}) for i in range(9)],
        ("s", 4): [_entry({"pos": {"lat": 1.5, "lng": i, "unit": "kB"}, "took": i if i else "x", "tags": []}) for i in range(9)],
        ("t", 1): ["torn {", None, _entry({"took": 1})],
    }
    df = _wal(spark, files)
    changes = schema_changes(schema_profiles(df, "w", "stream", "file_no", "entry", True))
    out = drift.consistent_table(drift.flat_records(df, "entry"), "w", F.col("fields"), changes).collect()
    rows = {(r["stream"], r["file_no"], r["wal_id"]): r for r in out}
    assert len(out) == len(rows) == 39
    assert rows["s", 1, 3]["consistent"] == {"pos.lat": "1.5", "pos.lng": "3", "pos.unit": "kB", "took": "3", "tags": '["a", 1.5]'}
    assert rows["s", 2, 3]["consistent"] == {"pos.lat": "1.5", "pos.lng": "3", "pos.unit": "kB", "took": "3.5", "tags": "[]"}
    assert drift.flat_fields('{"Log": {"fields": {"a": [1.50, {"b": null}], "c": {}}}}') == {"a": '[1.50, {"b": null}]', "c": "{}"}
    assert rows["s", 2, 3]["unfit"] == ["took"] and rows["s", 1, 3]["unfit"] == []
    assert rows["s", 3, 3]["consistent"]["took"] == "3" and rows["s", 4, 0]["consistent"]["took"] == "x"
    assert [rows["t", 1, i]["consistent"] for i in range(3)] == [None, None, {"took": "1"}]


def test_empty_tables_and_null_places(spark):
    assert schema_changes(schema_profiles(spark.createDataFrame([], WAL), "w", "stream", "file_no", "entry", True)).count() == 0
    rows = [(1, None, 1, 1, _entry({"a": 1}), "", 0), (2, "s", None, 1, _entry({"a": 1}), "", 0)]
    assert schema_changes(schema_profiles(spark.createDataFrame(rows, WAL), "w", "stream", "file_no", "entry", True)).count() == 0
