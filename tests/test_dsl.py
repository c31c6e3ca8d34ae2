import datetime as dt

import pytest

from stratalog.functions.analysis import document_terms, query_tokens
from stratalog.plans import aggs, dsl
from stratalog.plans.dsl import Compiler, QueryError, UnsupportedQuery, wildcard_regex

T = dt.datetime(2024, 1, 1)
SCHEMA = "doc_id long, ts timestamp, fields map<string,string>, text string"
DOCS = [
    (0, "log 1", "This is log 1, with the word test"), (1, "log 2", "another log message key~value"), (2, "test temp long", "a longer text of this log"),
    (3, None, None), (4, "", ""), (5, "Test", "ERROR: disk 5.2 full, it's bad [mod_jk2]"),
]


@pytest.fixture(scope="module")
def logs(spark):
    rows = [(i, T + dt.timedelta(minutes=i), None if v is None else {"key": v, "size": str(i * 10)}, t) for i, v, t in DOCS]
    return spark.createDataFrame(rows, SCHEMA)


def _ids(logs, query, **more):
    return sorted(r["doc_id"] for r in dsl.search(logs, {"query": query, **more}).collect())


@pytest.mark.parametrize(
    "query,ids",
    [
        ({"term": {"key": {"value": "test"}}}, [2]), ({"term": {"key": {"value": "TEST", "case_insensitive": True}}}, [2, 5]), ({"term": {"key": "log 1"}}, [0]),
        ({"terms": {"key": ["1", "temp"]}}, [0, 2]), ({"match": {"_all": "log disk"}}, [0, 1, 2, 5]), ({"match": {"text": {"query": "log THIS", "operator": "AND"}}}, [0, 2]),
        ({"match": {"key": "test"}}, [2, 5]), ({"match_phrase": {"key": "temp long"}}, [2]), ({"match_phrase": {"key": "long temp"}}, []), ({"prefix": {"key": "log"}}, [0, 1]),
        ({"prefix": {"key": {"value": "TEST", "case_insensitive": True}}}, [2, 5]), ({"match_phrase_prefix": {"key": "tes"}}, [2]), ({"match_phrase_prefix": {"key": "temp lo"}}, [2]),
        ({"regexp": {"key": "te(s|m).*"}}, [2]), ({"wildcard": {"key": {"value": "t*p"}}}, [2]), ({"wildcard": {"key": {"value": "?est"}}}, [2, 5]),
        ({"multi_match": {"query": "test", "fields": ["key", "text"]}}, [0, 2]), ({"range": {"size": {"gte": 10, "lt": 50}}}, [1, 2, 4]), ({"exists": {"field": "key"}}, [0, 1, 2, 4, 5]),
        ({"ids": {"values": [1, 99]}}, [1]), ({"fuzzy": {"key": {"value": "tast", "fuzziness": 1}}}, [2]), ({"bool": {"must_not": [{"term": {"key": "test"}}]}}, []),
        ({"bool": {"must": [{"match": {"text": "log"}}], "must_not": [{"term": {"key": "1"}}]}}, [1, 2]), ({"bool": {"should": [{"term": {"key": "1"}}, {"bool": {"must": [{"term": {"key": "temp"}}]}}]}}, [0, 2]),
        ({"query_string": {"query": "log AND NOT another"}}, [0, 2]), ({"query_string": {"query": 'key:(log OR temp) OR "disk 5.2"'}}, [0, 1, 2, 5]), ({"query_string": {"query": "anoth* OR dis?"}}, [1, 5]),
        ({"span_near": {"clauses": [{"span_term": {"text": "longer"}}, {"span_term": {"text": "of"}}], "slop": 1}}, [2]), ({"intervals": {"text": {"match": {"query": "of longer", "max_gaps": 1}}}}, [2]),
        ({"intervals": {"text": {"match": {"query": "of longer", "max_gaps": 5, "ordered": True}}}}, []), ({"span_first": {"match": {"span_term": {"text": "disk"}}, "end": 2}}, [5]),
        ({"term": {"none": "x"}}, []), ({"match": {"_all": "..."}}, []), ({"span_near": {"clauses": [{"span_term": {"text": "a"}}]}}, [2]),
    ],
)
def test_queries(logs, query, ids):
    assert _ids(logs, query) == ids


def test_stored_terms_give_the_same(spark, logs):
    stored = logs.withColumn("terms", document_terms(logs["text"], logs["fields"]))
    for query in ({"term": {"key": "log 1"}}, {"match": {"_all": "log disk"}}, {"match": {"key": {"query": "test", "case_insensitive": False}}}):
        plain = _ids(logs, query)
        assert sorted(r["doc_id"] for r in stored.filter(Compiler(terms="terms").compile(query)).collect()) == plain


def test_terms_of_the_analyser():
    assert query_tokens("06:07:05 it's 5.2 mod_jk2 [x]. a..b", True) == ["06", "07", "05", "it's", "5.2", "mod_jk2", "x", "a", "b"]
    assert wildcard_regex(r"a*b?\*c.") == r"a.*b.\*c\."


def test_order_pages_and_highlight(logs):
    assert [r["doc_id"] for r in dsl.search(logs, {}).collect()] == [5, 4, 3, 2, 1, 0]
    assert [r["doc_id"] for r in dsl.search(logs, {"size": 2, "from": 1}).collect()] == [4, 3]
    by_size = {"sort": [{"size": {"order": "desc", "type": "number"}}], "size": 2}
    assert [r["doc_id"] for r in dsl.search(logs, by_size).collect()] == [5, 4]
    marked = dsl.search(logs, {"query": {"match": {"text": "LOG"}}, "highlight": {}}).collect()
    assert marked[-1]["highlight"] == "This is <em>log</em> 1, with the word test"
    assert [r["doc_id"] for r in dsl.search(logs, {}, start=T + dt.timedelta(minutes=2), end=T + dt.timedelta(minutes=3)).collect()] == [3, 2]


@pytest.mark.parametrize("bad,error", [("{", QueryError), ("[]", QueryError), ('{"query": {"nothing": 1}}', QueryError), ('{"query": {"script": {}}}', UnsupportedQuery), ('{"query": {"term": {"a": 1, "b": 2}}}', QueryError), ('{"suggest": {}}', UnsupportedQuery), ('{"query": {}} x', QueryError)])
def test_bad_queries(logs, bad, error):
    with pytest.raises(error):
        dsl.search(logs, bad)
        dsl.search(logs, bad.replace("{}", '{"x": 1}'))


def test_aggregations_of_nothing_and_of_no_numbers(spark, logs):
    empty = logs.filter("false")
    assert aggs.aggregate(empty, {"sum": {"field": "size"}}).first()[0] == 0.0
    assert aggs.aggregate(empty, {"avg": {"field": "size"}}).first()[0] is None
    assert aggs.aggregate(logs, {"avg": {"field": "key"}}).first()[0] is None
    assert aggs.aggregate(empty, {"terms": {"field": "key"}}).count() == 0
    assert aggs.aggregate(logs, {"value_count": {"field": "key"}}).first()[0] == 5


def test_search_reads_only_what_it_needs(spark, tmp_path, logs):
    logs.write.parquet(str(tmp_path / "logs"))
    plan = dsl.search(spark.read.parquet(str(tmp_path / "logs")), {"query": {"range": {"ts": {"gte": "2024-01-01 00:02:00"}}}}).select("doc_id", "ts")
    text = plan._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(ts" in text
    assert "ReadSchema: struct<doc_id:bigint,ts:timestamp>" in text


def test_words_in_any_order_without_a_limit(spark):
    texts = ["a b c d e f g", "g f x e d c b a", "g f x y z e d c b a", "a b c d e f", "b a", "a", "", None, "a a b", "c a b a"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")

    def ids(words, gaps, ordered=False):
        query = {"intervals": {"text": {"match": {"query": words, "max_gaps": gaps, "ordered": ordered}}}}
        return [r["doc_id"] for r in df.filter(Compiler().compile(query)).orderBy("doc_id").collect()]

    assert ids("a b c d e f g", 0) == [0] and ids("a b c d e f g", 1) == [0, 1] and ids("g a c b d e f", 3) == [0, 1, 2]
    assert ids("a a b", 0) == [8, 9] and ids("a b", 0) == [0, 1, 2, 3, 4, 8, 9] and ids("a b", 0, True) == [0, 3, 8, 9]
    assert ids("a c", 1, True) == [0, 3] and ids("c a", -1, True) == [1, 2, 9]


def test_needed_terms():
    c = Compiler(terms="terms")
    assert c.required({"bool": {"must": [{"term": {"level": "ERROR x"}}], "filter": {"match": {"_all": {"query": "Disk full", "operator": "AND"}}}}}) == ["disk", "full", "level~ERROR", "level~x"]
    assert c.required({"match": {"_all": "disk full"}}) == [] and c.required({"bool": {"must": [{"term": {"a": "b"}}], "should": [{"term": {"c": "d"}}]}}) == []
    assert Compiler().required({"term": {"a": "b"}}) == []
