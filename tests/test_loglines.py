import datetime as dt

import pytest

from stratalog.operators import loglines
from stratalog.operators.loglines import Layouts, log_entries

MESSAGES = "log_message_id long, index_name string, stream string, file_no int, line_no int, time timestamp, fields map<string,string>, text string, start string"
ACCESS = "entry_id long, ip string, date timestamp, request string, status_code string, user_agent string"
T = dt.datetime(2024, 3, 9, 18, 50)
ISO = 1710010236000

LINES = [
    ("<142>1 2024-03-09T18:50:36.500Z box-22 ledger.Close 2224 - - digest rejected for 40b2", ISO + 500, "INFO", "ledger.Close"),
    ("<131>Mar  9 18:50:36 box-01 sync-agent[12]: parcel parked", ISO, "ERROR", "sync-agent"),
    ("<15>Mar 09 18:50:36 box-40 http: cursor expired", ISO, "DEBUG", "http"),
    ("192.0.2.7 - kestrel [09/Mar/2024:13:50:36 -0500] \"GET / HTTP/1.1\" 200 5 \"-\" \"curlish/7.9\"", ISO, "", ""),
    ("2001:db8::40e7:917 - - [09/Mar/2024:20:50:36 +0200] \"-\" 200 - \"-\" \"a \\\"b\\\"\"", ISO, "", ""),
    ("[1710010236.028] (Notice) queue.reader: voucher merged", ISO + 28, "INFO", "queue.reader"),
    ("2024-03-09T13:50:36.424-05:00 warn  [ledger.Posting] digest skipped", ISO + 424, "WARN", "ledger.Posting"),
    ("time=2024-03-09T20:50:36+02:00 caller=http level=DEBUG2 msg=\"route closed level=info\"", ISO, "DEBUG", "http"),
    ("time=2024-03-09T18:50:36Z level=fatal caller=cart.session msg=\"x y\"", ISO, "FATAL", "cart.session"),
    ('{"ts":1710010236399,"lvl":"ERR","logger":"auth_gate","msg":"replica skipped"}', ISO + 399, "ERROR", "auth_gate"),
    ('{"@timestamp": "2024-03-09T18:50:36.881Z", "message": "thumbnail rejected", "severity": "alert", "component": "store.Compactor"}', ISO + 881, "FATAL", "store.Compactor"),
    ("2024/03/09 18:50:36 [crit] 4290#0: *24 parcel renewed for f8d1", ISO, "FATAL", ""),
    ("2024-03-09 18:50:36,811 [worker-9] INFO  ledger.Close - thumbnail rejected since 2024-01-09 11:02:17", ISO + 811, "INFO", "ledger.Close"),
    ("E0309 18:50:36.745683   2759 ledger_Close.cc:49] shard flushed", ISO + 745, "ERROR", "ledger_Close.cc"),
    ("[Sat Mar 09 18:50:36.399041 2024] [mail:emerg] [pid 8348] token queued", ISO + 399, "FATAL", "mail"),
    ("WARNING:sync-agent:route released", -1, "WARN", "sync-agent"),
]
CONTINUED = [
    "", "   ", "shop.route.VoucherFailure: snapshot was rejected", "\tat shop.a.B.c(B.java:3)", "Caused by: shop.io.Gone: since 2024-01-09 11:02:17",
    "\t... 22 more", "{", '  "a": 1,', "}", "-> ledger 2024 after timeout", "SELECT lease, 8", " WHERE a = 95", "Traceback (most recent call last):",
    '  File "/srv/session.py", line 213, in expired', "SessionError: mailbox closed", '{"a": 1, "b": "two words"}', "  session copied since 2024-01-09 11:02:17",
    "2024 was a year", "x" * 200_000, "error",
]


@pytest.fixture(scope="module")
def layouts(spark):
    lines = [x[0].replace("mail", f"mail{'abc'[i % 3]}") for i in range(30) for x in LINES] + CONTINUED
    return loglines.learn_layouts(spark.createDataFrame([(x,) for x in lines], "text string"))


def test_without_the_dictionaries_nothing_is_found(layouts):
    for line, *_ in LINES:
        assert not Layouts(layouts.constants).parse(line, 2024).start
    swapped = "[Sat Mar 09 18:50:36.399041 2024] [pid 8348] [mail:emerg] token queued"
    loose = Layouts(set(), _trigrams([swapped]))
    assert loose.parse(swapped, 2024).component == "pid"
    assert Layouts({("[", "pid", "number")}, loose.frequent).parse(swapped, 2024).component == "mail"
    named = "2024-03-09 18:50:36 [main] INFO cart.pricing - token queued"
    loose = Layouts(set(), _trigrams([named]))
    assert loose.parse(named, 2024).component == "main"
    assert Layouts({("[", "main", "]")}, loose.frequent).parse(named, 2024).component == "cart.pricing"


def _trigrams(lines):
    return {(a, "word" if word else t, b) for x in lines for a, t, b, word in loglines.ngrams(x)}


def test_rare_heads_start_nothing(spark):
    usual = "2024-03-09 18:50:36,811 [worker-9] INFO  ledger.Close - thumbnail rejected"
    texts = spark.createDataFrame([(usual,)] * 999 + [("2024-01-09 11:02:17 / 2024-01-10 11:02:17: (moved)",)], "text string")
    layouts = loglines.learn_layouts(texts, support=1e-3)
    assert layouts.parse(usual, 2024).start and not layouts.parse("2024-01-09 11:02:17 / 2024-01-10 11:02:17: (moved)", 2024).start
    rows = [(r["template"], r["n"]) for r in loglines.line_templates(texts, "text", layouts).collect()]
    assert rows == [("^<iso> [<numbered>] <level> ledger.Close - thumbnail <*>", 999)]


def test_more_stamps(spark):
    lines = ["09.03.2024 18:50:36,250 WARN cart.session: digest rejected", "20240309T185036Z INFO cart.session: digest rejected", "20240309T205036+0200 INFO cart.session: digest rejected"]
    layouts = loglines.learn_layouts(spark.createDataFrame([(x,) for x in lines], "text string"))
    assert [layouts.parse(x, 1970).ts_ms for x in lines] == [ISO + 250, ISO, ISO]


@pytest.mark.parametrize("line,ts,level,component", LINES)
def test_layouts(layouts, line, ts, level, component):
    p = layouts.parse(line, 2024)
    assert (p.start, p.ts_ms, p.level, p.component) == (True, ts, level, component)


@pytest.mark.parametrize("line", CONTINUED)
def test_lines_that_start_nothing(layouts, line):
    assert not layouts.parse(line, 2024).start


def test_messages(layouts):
    assert layouts.parse(LINES[12][0], 2024).message == "thumbnail rejected since 2024-01-09 11:02:17"
    assert layouts.parse(LINES[7][0], 2024).message == "route closed level=info"
    assert layouts.parse(LINES[9][0], 2024).message == "replica skipped"
    assert layouts.parse(LINES[14][0], 2024).message == "token queued"
    assert layouts.parse(LINES[3][0], 2024).user_agent == "curlish/7.9"


def _messages(spark, lines):
    """lines: (stream, file, line, text); ids rise with stream, file and line; the first line comes twice."""
    rows = [(i, "x", s, f, n, T, {}, t, "clash") for i, (s, f, n, t) in enumerate(sorted(lines, key=lambda x: x[:3]), 1)]
    return spark.createDataFrame([*reversed(rows), rows[0]] if rows else rows, MESSAGES)


def test_entries_over_lines_files_and_streams(spark):
    start = "2024-03-09 18:50:36,811 [worker-9] INFO  http - parcel parked"
    lines = [
        ("a", 1, 1, start), ("a", 1, 2, "\tat x"), ("a", 1, 3, None), ("a", 1, 4, "  more"), ("a", 1, 5, start + "\nSELECT 1"),
        ("a", 3, 1, "}"), ("a", 4, 1, "\tat y"), ("a", 4, 2, start), ("b", 1, 1, "lost"), ("b", 1, 2, start),
    ]
    got = sorted((r["first_id"], r["last_id"]) for r in log_entries(_messages(spark, lines)).collect())
    # 1 with 2 and 4; 5 with the heads of files 3 and 4 (6, 7); 8; 10. The null line 3 and the lost line 9 are in none.
    assert got == [(1, 4), (5, 7), (8, 8), (10, 10)]
    text = {r["first_id"]: r["text"] for r in loglines.assemble_entries(_parsed(spark, lines), True).collect()}
    assert text[1] == f"{start}\n\tat x\n  more"


def test_messages_hold_all_rows_of_their_entries(spark):
    start = "2024-03-09 18:50:36,811 [worker-9] INFO  http - parcel parked"
    lines = [
        ("a", 1, 1, start), ("a", 1, 2, start), ("a", 1, 3, "\tat x\n\tat y"), ("a", 2, 1, "\tat z"), ("a", 2, 2, "}"), ("a", 10, 1, " end"),
        ("a", 10, 2, start), ("b", 1, 1, "lost"), ("b", 1, 2, start + "\nSELECT 1"), ("b", 2, 1, start),
    ]
    got = {(r["first_id"], r["last_id"]): r["message"] for r in log_entries(_messages(spark, lines), with_text=True).collect()}
    assert got == {
        (1, 1): "parcel parked", (2, 6): "parcel parked\n\tat x\n\tat y\n\tat z\n}\n end", (7, 7): "parcel parked",
        (9, 9): "parcel parked\nSELECT 1", (10, 10): "parcel parked",
    }


def _parsed(spark, lines):
    from pyspark.sql import functions as F

    rows = _messages(spark, lines).filter("text is not null").select("log_message_id", "stream", "file_no", "line_no", F.lit(2024).alias("y"), "text", F.col("text").alias("__text"))
    return loglines.parse_lines(rows, "text", "y", Layouts(set(), _trigrams(t for x in lines if x[3] for t in x[3].split("\n")))).withColumnRenamed("__text", "text")


def test_foreign_lines_in_access_entries(spark):
    rows = [
        (1, "", T, "GET / HTTP/1.1", "200", "curlish/7.9\n" + LINES[0][0] + "\n" + LINES[3][0]), (2, "", T, LINES[15][0], "", None), (3, "", None, None, "", ""),
        (4, "", T, LINES[13][0], "", "-"), (5, "", T, "192.0.2.7 - - [09/Mar/2024:13:50:36 -0500] \"GET / HT", "", "x"),
    ]
    access = spark.createDataFrame(rows, ACCESS)
    got = {tuple(r)[:6] for r in log_entries(_messages(spark, []), access).collect()}
    t = "apache_log_entries"
    assert got == {(t, 1, 1, ISO + 500, "INFO", "ledger.Close"), (t, 1, 1, ISO, "", ""), (t, 2, 2, -1, "WARN", "sync-agent"), (t, 4, 4, ISO + 745, "ERROR", "ledger_Close.cc")}


def test_dictionary_finds_constant_words(spark):
    lines = [(f"[Sat Mar 09 18:50:36.399041 2024] [m{i % 9}x:info] [pid {i}] token {'abcdefghij'[i % 10]} queued",) for i in range(300)]
    counts = loglines.ngram_counts(spark.createDataFrame(lines, "text string"))
    found = {(r["before"], r["token"], r["after"]) for r in loglines.layout_constants(counts).collect()}
    assert ("[", "pid", "number") in found
    assert not any(w.startswith("m") for _, w, _ in found)


def test_empty_tables(spark):
    assert log_entries(_messages(spark, []), spark.createDataFrame([], ACCESS)).count() == 0
