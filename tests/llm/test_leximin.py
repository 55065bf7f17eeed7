import random

from pyspark.sql import functions as F

from trigraph.llm.leximin import MISSING, leximin_rank, rank_books

SCHEMA = "item long, a double, b double, rank string, percentiles string"


def brute(rows):
    best = {}
    for i, *v in rows:
        if i is not None:
            old = best.get(i, [None] * len(v))
            best[i] = [max((x for x in (o, n if n is not None and n == n and abs(n) != float("inf") else None) if x is not None), default=None) for o, n in zip(old, v)]
    cols = list(zip(*best.values())) if best else []
    vec = {i: [] for i in best}
    for k, col in enumerate(cols):
        known = [x for x in col if x is not None]
        for i, v in best.items():
            x = v[k]
            vec[i].append(MISSING if x is None else (2 * sum(y < x for y in known) + known.count(x)) / (2 * len(known)))
    order = sorted(vec, key=lambda i: ([-p for p in sorted(vec[i])], i))
    return {i: n + 1 for n, i in enumerate(order)}


def ranks(df):
    return {r.item: r["rank"] for r in leximin_rank(df, "item", [F.col("a"), F.col("b")]).collect()}


def test_against_brute_force_with_ties_and_missing(spark):
    rng = random.Random(2)
    value = lambda: rng.choice([None, float("nan"), float("inf"), 0.0, -0.0, 1.0, 2.5, rng.random() * 1000])
    rows = [(i, value(), value()) for i in range(150)] + [(7, 5.0, None), (None, 1.0, 1.0)]
    assert ranks(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)) == brute(rows)


def test_range_does_not_matter(spark):
    rows = [(i, float(i % 13), float((i * 7) % 11)) for i in range(60)]
    far = [(i, a, b * 1e9) for i, a, b in rows]
    frame = lambda r: spark.createDataFrame([(*x, "", "") for x in r], SCHEMA)
    assert ranks(frame(rows)) == ranks(frame(far))
    assert ranks(frame([])) == {}
    assert ranks(frame([(1, None, None)])) == {1: 1}


def test_books_use_latest_delivery_and_one_scale(spark):
    rows = [(1, 4.0, 10, 5, "2024-01-01"), (1, 80.0, 30, 5, "2024-01-02"), (2, 4.0, 20, 5, "2024-01-01"), (3, 0.0, -1, None, "2024-01-01"), (4, 500.0, 1, 0, "2024-01-01")]
    df = spark.createDataFrame(rows, "book_id long, average_rating double, ratings_count long, work_text_reviews_count long, loaded_at string")
    got = {r.book_id: (r["rank"], r.percentiles) for r in rank_books(df).collect()}
    assert got[1][0] < got[2][0] and got[3][1] == [0.5, 0.5, 0.5] and len(got) == 4
