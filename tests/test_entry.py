import __spark_entry__ as entry


def test_queries_have_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 45
