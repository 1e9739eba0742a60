"""No plan broadcasts the places of all replicates, whose number Spark's estimates don't know."""

import pytest

from tidemark import queries


def under_broadcasts(df):
    """Lines of the plan that stand below a broadcast."""
    depth, out = None, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            out.append(line)
        else:
            depth = at if "BroadcastExchange" in line else None
    return out


@pytest.mark.parametrize("name", ["block_sum_mean", "tapered_values"])
def test_replicates_are_not_broadcast(name, spark, sf_dir):
    df = queries.QUERIES[name](spark, sf_dir)
    assert "SortMergeJoin" in df._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in under_broadcasts(df) if "Generate explode(" in line]
