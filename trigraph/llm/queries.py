"""Queries of the training-text operators over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.llm.leaks import find_leaks
from trigraph.llm.leximin import rank_books
from trigraph.llm.mixing import FEASIBLE, Mix, mix_boards
from trigraph.llm.repetition import measure, repetition_grades, self_repeating
from trigraph.llm.variants import author_names, variant_classes, variant_pairs

#: A public tokenizer's vocabulary, read where it is installed; a session's ``spark.trigraph.tokenizer`` names another.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Boards that are repeated come in late, the others fade.
RAMPS = {"bread-lab": [(0.0, 0.25), (1.0, 1.75)], "small-gauge": [(0.0, 0.0), (0.25, 0.0), (1.0, 2.0)], "workbench": [(0.0, 1.5), (1.0, 0.5)]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_leximin(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rank_books(read(spark, sf_dir, "books"))
    p = r["percentiles"]
    return r.select("book_id", "rank", p[0].alias("weakest"), p[1].alias("middle"), p[2].alias("strongest"))


def p2_by_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ranking agrees with people's grades: mean rank of the judged books by grade."""
    ranked = rank_books(read(spark, sf_dir, "books"))
    judged = ranked.join(read(spark, sf_dir, "book_grades").distinct(), "book_id")
    return judged.groupBy("grade").agg(F.count(F.lit(1)).alias("books"), F.round(F.avg("rank"), 3).alias("mean_rank"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_pairs(author_names(read(spark, sf_dir, "books")))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variant_classes(author_names(read(spark, sf_dir, "books")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def _mix(spark: SparkSession, sf_dir: str, **rules) -> Mix:
    tokenizer = spark.conf.get("spark.trigraph.tokenizer", TOKENIZER)
    return mix_boards(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"), tokenizer, **rules)


def p6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in the original texts the leaked passages stand."""
    found = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", "share", F.explode("passages").alias("p")).select("doc_id", "item_id", "share", "p.start", "p.end")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix in which every board has its target share."""
    return _mix(spark, sf_dir, schedules=RAMPS, total_tokens=FEASIBLE).rows


def p7_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix as large as all boards together; boards that are too small for it are used as often as they may be."""
    return _mix(spark, sf_dir, schedules=RAMPS).rows


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares that p7_mix reaches."""
    return _mix(spark, sf_dir, schedules=RAMPS, total_tokens=FEASIBLE).report


def p7_curriculum_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, schedules=RAMPS).report


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return self_repeating(read(spark, sf_dir, "documents"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(read(spark, sf_dir, "documents"))


def p8_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier alone says of each post."""
    return repetition_grades(read(spark, sf_dir, "documents")).select("doc_id", F.round("probability", 3).alias("probability"), "grade")


QUERIES = {
    "p2_leximin": p2_leximin,
    "p2_by_grade": p2_by_grade,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p7_mix": p7_mix,
    "p7_curriculum": p7_curriculum,
    "p7_shares": p7_shares,
    "p7_curriculum_shares": p7_curriculum_shares,
    "p8_found": p8_found,
    "p8_shares": p8_shares,
    "p8_grades": p8_grades,
}

_LEXIMIN = """WITH b AS (SELECT book_id, max({'t': loaded_at, 'a': average_rating, 'r': ratings_count, 'w': work_text_reviews_count}) AS b
           FROM books WHERE book_id IS NOT NULL GROUP BY book_id),
c AS (SELECT book_id, CASE WHEN b.a > 0 AND b.a <= 5 THEN b.a WHEN b.a > 5 AND b.a <= 100 THEN b.a / 20 END AS a,
             CASE WHEN b.r >= 0 THEN b.r END AS r, CASE WHEN b.w >= 0 THEN b.w END AS w FROM b),
p AS (SELECT book_id,
  CASE WHEN a IS NULL THEN 0.5::DOUBLE ELSE (2 * (rank() OVER (ORDER BY a NULLS LAST) - 1) + count(*) OVER (PARTITION BY a)) / (2.0::DOUBLE * count(a) OVER ()) END AS pa,
  CASE WHEN r IS NULL THEN 0.5::DOUBLE ELSE (2 * (rank() OVER (ORDER BY r NULLS LAST) - 1) + count(*) OVER (PARTITION BY r)) / (2.0::DOUBLE * count(r) OVER ()) END AS pr,
  CASE WHEN w IS NULL THEN 0.5::DOUBLE ELSE (2 * (rank() OVER (ORDER BY w NULLS LAST) - 1) + count(*) OVER (PARTITION BY w)) / (2.0::DOUBLE * count(w) OVER ()) END AS pw
  FROM c),
v AS (SELECT book_id, list_sort([pa, pr, pw]) AS s FROM p)
SELECT book_id, row_number() OVER (ORDER BY s[1] DESC, s[2] DESC, s[3] DESC, book_id) AS rank, s[1] AS weakest, s[2] AS middle, s[3] AS strongest FROM v"""

SQL = {
    "p2_leximin": _LEXIMIN,
    "p2_by_grade": f"""SELECT grade, count(*) AS books, round(avg(rank), 3) AS mean_rank
FROM ({_LEXIMIN}) JOIN (SELECT DISTINCT book_id, grade FROM book_grades) USING (book_id) GROUP BY grade""",
}
