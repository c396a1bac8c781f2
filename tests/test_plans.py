"""Plan-shape guards: no registered query pairs rows with rows. The only
nested-loop joins allowed are the documented ones: K1 skill masks (at most
2^skills rows per side) and the Shapley background sample."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL

BOUNDED_PAIRINGS = {"employability"}
SKIP = {"train_and_predict", "model_ranking", "model_persistence", "stream_dedup", "sink_roundtrip",
        "collect_to_target", "collect_counters", "stream_event_time", "prediction_contributions",
        "roadmap_export"}   # MLlib fits / writes happen while the plan is built


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP - BOUNDED_PAIRINGS))
def test_no_row_by_row_pairing(spark, name):
    plan = entry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
