"""One ranking from several differently scaled scores, by leximin order of percentiles.

Each score becomes its percentile among all known values of that score, so range and form no longer matter. An item's
percentiles are sorted ascending and items are compared lexicographically from their weakest percentile on: a strong
score can't make up for a weak one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigraph.functions.lineage import cut
from trigraph.functions.ranks import running_total
from trigraph.functions.skew import lookup

#: A missing score neither helps nor harms: it counts as the middle of its score.
MISSING = 0.5
#: A value held by more than this part of the items is hot. There are fewer than 1 / HOT of them per score.
HOT = 1e-3


def percentiles(values: DataFrame) -> DataFrame:
    """(score, value) -> mid-rank percentile, for rows (item, score, value) without nulls."""
    counts = values.groupBy("score", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_total(counts, [F.col("score"), F.col("value")], F.col("n"))
    per_score = placed.groupBy("score").agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    p = (2 * (F.col("before") - F.col("start")) + F.col("n")) / (2.0 * F.col("total"))
    return cut(placed.join(F.broadcast(per_score), "score").select("score", "value", p.alias("p"), (F.col("n") > F.col("total") * HOT).alias("hot")))


def leximin_rank(items: DataFrame, ident: str, scores: Sequence[Column], missing: float = MISSING) -> DataFrame:
    """``ident``, ``rank`` (1 is best) and ``percentiles`` (ascending) of every item.

    Higher scores are better. Equal percentile vectors are put in order of ``ident``, so the ranking is total.

    Values shared by many items are joined from a broadcast whose size the definition of hot bounds, all others by
    a shuffle on (score, value), so no value gathers a large part of the items in one task.

    Defined cases: null, NaN and infinite scores are missing and count as ``missing``; a null ``ident`` isn't
    ranked; rows repeated under one ``ident`` rank once, by their greatest value per score. Without items there are
    no rows. Other columns are never read.
    """
    names = [f"__s{i}" for i in range(len(scores))]
    base = items.select(F.col(ident).alias("__id"), *(s.cast("double").alias(n) for n, s in zip(names, scores))).where("__id is not null")
    clean = [F.when(~F.isnan(n) & (F.abs(n) != float("inf")), F.col(n) + 0.0) for n in names]
    one = cut(base.groupBy("__id").agg(*(F.max(c).alias(n) for n, c in zip(names, clean))))
    long = one.select("__id", F.posexplode(F.array(*names)).alias("score", "value")).where("value is not null")
    known = percentiles(long)
    found = lookup(long, known, ["score", "value"], "hot").groupBy("__id").agg(F.collect_list("p").alias("__ps"))
    filled = F.concat(F.coalesce("__ps", F.array().cast("array<double>")), F.array_repeat(F.lit(float(missing)), F.lit(len(names)) - F.coalesce(F.size("__ps"), F.lit(0))))
    vectors = one.select("__id").join(found.withColumn("__has", F.lit(True)), "__id", "left")
    vectors = vectors.select("__id", F.array_sort(F.when(F.col("__has"), filled).otherwise(F.array_repeat(F.lit(float(missing)), len(names)))).alias("percentiles"))
    order = [F.col("percentiles")[i].desc() for i in range(len(names))] + [F.col("__id").asc()]
    ranked = running_total(vectors, order)
    return ranked.select(F.col("__id").alias(ident), (F.col("before") + 1).alias("rank"), "percentiles")


def book_scores() -> list[Column]:
    """The three scores of a book, cleaned.

    Ratings are on 0-5, some on 0-100; 0 means nobody rated, anything else outside is impossible. Counts below 0 are
    unknown.
    """
    r = F.col("average_rating")
    rating = F.when((r > 0) & (r <= 5), r).when((r > 5) & (r <= 100), r / 20)
    counts = [F.when(F.col(c) >= 0, F.col(c)) for c in ("ratings_count", "work_text_reviews_count")]
    return [rating, *counts]


def rank_books(books: DataFrame) -> DataFrame:
    """All books by leximin; of a book delivered twice the latest delivery counts."""
    fields = ["average_rating", "ratings_count", "work_text_reviews_count"]
    latest = books.where("book_id is not null").groupBy("book_id").agg(F.max(F.struct("loaded_at", *fields)).alias("b")).select("book_id", *(f"b.{f}" for f in fields))
    return leximin_rank(latest, "book_id", book_scores())
