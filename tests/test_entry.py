"""Driver contract: entry() runs; every registered query matches its oracle SQL at sf0.001."""

import __spark_entry__ as entry
from tests.oracle_compare import compare


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["request_id", "producer", "status", "error_code", "message"]
    assert df.count() > 0


def test_every_query_has_oracle():
    from tidewater import scenarios
    assert set(scenarios.REGISTRY) <= set(entry.oracle_sql()) and set(scenarios.REGISTRY) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_match_oracle(spark):
    from tidewater import scenarios
    results = compare(spark, "/root/testdata/sf0.001", list(scenarios.REGISTRY), verbose=False)
    assert {k: v for k, v in results.items() if v is not True} == {}
