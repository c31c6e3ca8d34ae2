import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_dealt_problems_have_queries():
    names = entry.queries()
    for n in (1, 3, 4, 6, 7):
        assert f"p{n}_found" in names
