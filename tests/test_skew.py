from trigraph.functions.skew import components


def test_rounds_do_not_carry_on_the_planners_estimates(spark):
    n = 300
    chain = spark.range(n).selectExpr("lpad(id, 4, '0') a", "lpad(id + 1, 4, '0') b")
    other = spark.createDataFrame([("x", "y"), ("z", "y")], "a string, b string")
    found = components(chain.unionByName(other))
    assert {(r.node, r.component) for r in found.collect()} == {(f"{i:04}", "0000") for i in range(n + 1)} | {(x, "x") for x in "xyz"}
    # Its digits doubled with every round, so that a long chain filled the driver's memory.
    estimate = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert len(str(estimate)) < 100
