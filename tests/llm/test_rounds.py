from gridflow.llm.components import star


def test_rounds_send_nothing_through_the_driver(spark):
    """Stars of small graphs join without broadcasts, which the driver would hold for every round."""
    edges = spark.createDataFrame([(b, a) for a, b in zip(range(50), range(1, 51))], "a bigint, b bigint")
    for large in (True, False):
        out = star(edges, large)
        assert out.count() == 50 if not large else out.count() > 0
        out.collect()
        assert "BroadcastExchange" not in out._jdf.queryExecution().executedPlan().toString()
