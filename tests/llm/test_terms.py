import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")
from stratalog.llm.terms import LastSeen, field_terms, marked_terms, term_frequencies, text_terms  # noqa: E402

SCHEMA = "log_message_id long, text string, fields map<string,string>, term string, origin string, __record int"
TERM = regex.compile(r"[\p{L}\p{N}_]+(?:[.'][\p{L}\p{N}_]+)*")


def _brute(rows):
    seen = {}
    for i, text, fields, *_ in rows:
        seen[i, text, tuple(sorted((fields or {}).items(), key=str))] = 1
    n, records = Counter(), defaultdict(set)
    for i, text, fields in seen:
        for origin, terms in (("text", TERM.findall((text or "").lower())), ("field", [f"{k}~{v}" for k, v in fields if v is not None])):
            for t in terms:
                n[origin, t] += 1
                records[origin, t].add(i)
    return {k: (c, len(records[k])) for k, c in n.items()}


def _terms():
    return {"text": text_terms(F.col("text")), "field": field_terms(F.col("fields"))}


def _rows(n=400):
    random.seed(1)
    words = ["alpha", "Beta", "it's", "v1.2", "x", "über", "naïve", "a.b.c", "under_score", "..", "7"]
    rows = []
    for i in range(n):
        text = None if i % 17 == 0 else "" if i % 19 == 0 else "the " + " ".join(random.choices(words, k=random.randrange(6)))
        fields = None if i % 13 == 0 else {"service": "hot" if i % 3 else f"s{i % 5}", "none": None, "": ""}
        rows.append((i, text, fields, "clash", "clash", 3))
    return [*rows, *random.choices(rows, k=120), (5, "another text of record 5", {}, "", "", 1)]


@pytest.mark.parametrize("most", [3, 400_000])
def test_equals_brute_force_with_copies(spark, most):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {(r["origin"], r["term"]): (r["occurrences"], r["records"]) for r in term_frequencies(df, "log_message_id", _terms(), most).collect()}
    assert got == _brute(rows)


def test_marks_at_their_limits(spark):
    rows = [(i, " ".join(["all"] + (["tenth"] if i < 10 else []) + (["eleven"] if i < 11 else []) + (["two"] if i < 2 else []) + (["three"] if i < 3 else [])), None, "", "", 0) for i in range(100)]
    got = {r["term"]: r["mark"] for r in marked_terms(spark.createDataFrame(rows, SCHEMA), "log_message_id", _terms()).collect()}
    assert got == {"all": "common", "tenth": "", "eleven": "common", "two": "rare", "three": ""}


def test_rows_without_identifier_are_records_of_their_own(spark):
    rows = [(None, "same words", None, "", "", 0)] * 5
    got = {r["term"]: r["records"] for r in term_frequencies(spark.createDataFrame(rows, SCHEMA), "log_message_id", _terms()).collect()}
    assert got == {"same": 5, "words": 5}


def test_very_long_text_and_empty_table(spark):
    rows = [(1, "word " * 300_000 + "x" * 100_000, None, "", "", 0)]
    got = {len(r["term"]): r["occurrences"] for r in term_frequencies(spark.createDataFrame(rows, SCHEMA), "log_message_id", _terms()).collect()}
    assert got == {4: 300_000, 100_000: 1}
    assert marked_terms(spark.createDataFrame([], SCHEMA), "log_message_id", _terms()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from("abcd"), max_size=5)), max_size=25), st.integers(1, 6))
def test_last_seen_over_any_batches(rows, size):
    rows.sort(key=lambda r: r[0])
    seen, total = LastSeen(), Counter()
    records = Counter()
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        terms = [t for _, ts in part for t in ts]
        seen.add(pa.array(terms, pa.string()), np.array([r for r, ts in part for _ in ts], np.int64))
        for t, n, m in zip(*seen.take(part[-1][0])):  # flushed after every batch
            total[t] += n
            records[t] += m
    assert total == Counter(t for _, ts in rows for t in ts)
    assert records == Counter(t for _, t in {(r, t) for r, ts in rows for t in ts})
