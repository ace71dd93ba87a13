import re

import __spark_entry__ as entry


def test_queries_and_oracles_fit():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 60
    assert all(isinstance(s, str) and re.search(r"\bselect\b", s) for s in oracles.values())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["lang", "type", "n"] and df.count() > 0
