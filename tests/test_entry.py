import __spark_entry__ as entry


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 60
    assert all(callable(f) for f in q.values())
