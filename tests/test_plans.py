"""Physical-plan shape checks: the properties that matter at scale, pinned per operator."""

import re


from tidewater import scenarios as S

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_gate_is_broadcast_and_pruned(spark):
    df = S.gate_outcomes(spark, SF)
    phys = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in phys and "SortMergeJoin" not in phys and "SinglePartition" not in phys
    scan = re.search(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().simpleString())
    assert scan is None or "value" not in scan.group(1)     # unused events.value is pruned


def test_keyed_last_write_aggregates_partially(spark):
    plan = optimized(S.keyed_lww(spark, SF))
    phys = S.keyed_lww(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "max_by" in plan
    assert "partial_max_by" in phys
    # the partial aggregate runs before the shuffle on the key
    assert phys.index("Exchange hashpartitioning(producer") < phys.index("partial_max_by")


def test_merge_aggregates_partially(spark):
    phys = S.merge_target(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert phys.count("partial_max_by") == 2        # both merge rounds combine map-side
    assert "Window" not in phys


def test_last_n_ranks_salted_groups_first(spark):
    phys = S.last_n(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(conv_id#\d+L?, _salt#\d+", phys)
    assert re.search(r"hashpartitioning\(conv_id#\d+L?, \d+", phys)


def test_pull_prunes_partitions(spark, scratch):
    from tidewater.operators import landing as L
    landed = S.landed_events(spark, SF)
    L.write_landing(landed, f"{scratch}/landing")
    import datetime as dt
    pulled = L.incremental_pull(L.read_landing(spark, f"{scratch}/landing"), "signup", dt.datetime(2024, 1, 15))
    phys = executed(pulled)
    assert "PartitionFilters: [isnotnull(producer" in phys and "(producer" in phys
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in phys


def test_no_query_reevaluates_the_gate_in_a_filter(spark):
    """Filters over the gate's outcome would be pushed below it and re-run the rule chain."""
    for name, fn in S.REGISTRY.items():
        plan = fn(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            node = line.strip().lstrip("+-: ").strip()
            assert not (node.startswith("Filter") and ("schema_validation" in node or "unrouted" in node)), name
