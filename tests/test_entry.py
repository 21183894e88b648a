import __spark_entry__ as entry


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert "sssp" in queries and set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values()) and all(isinstance(s, str) for s in sql.values())
