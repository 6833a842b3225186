import __spark_entry__ as entry


def test_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 80
    out = entry.entry(spark)
    assert out.columns == ["lang", "decision", "blocks", "keys_"] and out.count() > 0
