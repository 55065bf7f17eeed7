import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trigraph.operators.eager import Measure, _carried, chain_breaks, eager_join_aggregate

SCHEMA = "rec_key string, store_position long, value_link long, __k string, note string"


def brute(rows):
    by = defaultdict(set)
    for k, p, _ in rows:
        if k is not None and p is not None:
            by[k].add(p)
    out = set()
    for k, p, v in rows:
        if k is not None and p is not None and v is not None and v != -1:
            lower = [x for x in by[k] if x < p]
            if not lower or max(lower) != v:
                out.add((k, p))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, p, v, "x", None) for k, p, v in rows], SCHEMA)


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("width", [1, 7, 16, 1 << 22])
def test_chain_breaks_against_brute_force(spark, width):
    rng = random.Random(width)
    rows, last = [], {}
    for p in range(0, 900, 3):
        k = rng.choice(["hub"] * 6 + ["a", "b", "", None])
        v = last.get(k, -1) if rng.random() < 0.8 else rng.choice([-1, None, p - 3, 5, 10_000])
        rows.append((k, p, v))
        last[k] = p
    rows += rng.sample(rows, 40)
    rows += [("a", None, 3), (None, 4, 5), ("b", 10, 3)]
    for blocks in (1, 3, 1 << 13):
        assert found(chain_breaks(frame(spark, rows), block_width=width, blocks=blocks)) == brute(rows)


def test_chain_breaks_edge_cases(spark):
    assert found(chain_breaks(frame(spark, []))) == set()
    assert found(chain_breaks(frame(spark, [(None, None, None)]))) == set()
    assert found(chain_breaks(frame(spark, [("a", 5, 3), ("a", 5, 3)]))) == {("a", 5)}
    assert found(chain_breaks(frame(spark, [("a", -10, -1), ("a", 5, -10)]), block_width=4)) == set()


def test_chain_shuffles_rows_once(spark):
    rows = spark.range(1000).select(F.concat(F.lit("k"), F.col("id") % 3).alias("rec_key"), F.col("id").alias("store_position"), (F.col("id") % 5).alias("value_link"))
    df = chain_breaks(rows)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")]
    assert "ReusedExchange" in final and final.count("Range (0, 1000") == 1


def test_eager_join_matches_plain_join(spark):
    rng = random.Random(3)
    left = spark.createDataFrame([(rng.choice(["h", "h", "h", "a", "b", None]), rng.choice([1, 2, None, 7]), "n") for _ in range(200)], "k string, x long, n string")
    right = spark.createDataFrame([(rng.choice(["h", "h", "a", "c", None]), rng.choice([1.5, None, 3.0]), "n") for _ in range(150)], "k string, y double, n string")
    got = eager_join_aggregate(
        left, right, ["k"],
        [Measure("sx", "sum", "x"), Measure("mx", "max", "x"), Measure("cx", "count", "x")],
        [Measure("sy", "sum", "y"), Measure("ay", "avg", "y"), Measure("my", "min", "y")],
    )
    want = left.select("k", "x").join(right.select("k", "y"), "k").groupBy("k").agg(F.count("*").alias("pairs"), F.sum("x").alias("sx"), F.max("x").alias("mx"), F.count("x").alias("cx"), F.sum("y").alias("sy"), F.avg("y").alias("ay"), F.min("y").alias("my"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_products_of_counts_and_sums_outgrow_64_bits(spark):
    big = spark.range(1000).select(F.lit("h").alias("k"), F.lit((1 << 62)).alias("x"))
    r = eager_join_aggregate(big, big.withColumnRenamed("x", "y"), ["k"], [Measure("sx", "sum", "x")], [Measure("ay", "avg", "y")]).first()
    assert r.pairs == 1_000_000 and int(r.sx) == (1 << 62) * 1_000_000 and r.ay == float(1 << 62)


def test_no_window_group_grows_with_the_blocks_of_a_hub(spark):
    def largest(n):
        """Most states that meet in one window group, of a hub with ``n`` blocks."""
        states = spark.range(n).select(F.lit("h").alias("__k"), F.col("id").alias("__b"), F.col("id").alias("__last"), F.lit(1).alias("__links"))
        got = {r["__b"]: r["__carry"] for r in _carried(states, 8).collect()}
        assert got == {b: b - 1 if b else None for b in range(n)}
        return states.groupBy("__k", F.floor(F.col("__b") / 8)).count().agg(F.max("count")).first()[0]

    assert largest(16) == largest(64) == 8


def test_eager_left_join_and_rollup(spark):
    left = spark.createDataFrame([("a/1", 1), ("a/2", 2), ("b/1", 5), ("a/1", 4), (None, 9)], "k string, x long")
    right = spark.createDataFrame([("a/1", 10), ("a/1", 20)], "k string, y long")
    got = eager_join_aggregate(left, right, ["k"], [Measure("sx", "sum", "x")], [Measure("sy", "sum", "y"), Measure("cy", "count", "y")], "left", {"kind": F.substring_index("k", "/", 1)})
    assert {r.kind: (r.pairs, r.sx, r.sy, r.cy) for r in got.collect()} == {"a": (5, 12, 60, 4), "b": (1, 5, None, None)} or {r.kind: (r.pairs, r.sx, r.sy) for r in got.collect()} == {"a": (5, 12, 60), "b": (1, 5, None)}
    empty = eager_join_aggregate(left.limit(0), right, ["k"])
    assert empty.count() == 0
    with pytest.raises(ValueError):
        eager_join_aggregate(left, right, ["k"], [Measure("z", "median", "x")])
