"""What the driver would have to hold."""

from keepsake.llm import near_duplicates


def test_salted_keys_are_not_broadcast(spark):
    """Of the salted keys Spark knows only how few they were before."""
    rows = spark.createDataFrame([(i // 2 if i < 100 else -i, i) for i in range(200)], "h long, node long")
    found = near_duplicates.in_several(rows, "h", "node")
    assert sorted(r.node for r in found.collect()) == list(range(100))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
