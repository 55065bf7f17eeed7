"""Similarity filter and nearest neighbours over embeddings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trigraph.functions.vectors import cosine
from trigraph.operators.traversal import Tables, Traversal

OPERATORS = ("=", ">", "<", ">=", "<=", "in")


def embedding(tables: Tables, text: str) -> list[float] | None:
    """The vector of one text, found by a pushed-down filter."""
    if tables.embeddings is None:
        return None
    found = tables.embeddings.where(F.col("id") == text).select("vec").limit(1).collect()
    return list(found[0].vec) if found else None


def _passes(similarity: Column, operator: str, threshold: float | list[float]) -> Column:
    if operator == "in":
        return similarity.between(float(threshold[0]), float(threshold[1]))
    t = F.lit(float(threshold))
    if operator == "=":
        return F.abs(similarity - t) <= 1e-9 * F.greatest(F.abs(similarity), F.abs(t))
    return {">": similarity > t, "<": similarity < t, ">=": similarity >= t, "<=": similarity <= t}[operator]


def check_threshold(operator: str, threshold: float | list[float]) -> None:
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if operator == "in":
        if not isinstance(threshold, list) or len(threshold) != 2 or not all(map(number, threshold)):
            raise ValueError(f"'in' needs a list of two numbers, not {threshold!r}")
    elif not number(threshold):
        raise ValueError(f"a threshold is a number, not {threshold!r}")


def similarities(start: Traversal, target: list[float], strict: bool = False) -> DataFrame:
    """The rows with their ``similarity``; null where the row has no vector."""
    vectors = start.tables.embeddings.select(F.col("id").alias("__id"), cosine(F.col("vec"), target).alias("similarity"))
    return start.rows.join(vectors, F.col("id") == F.col("__id"), "inner" if strict else "left").drop("__id")


def sim(start: Traversal, text: str, operator: str, threshold: float | list[float], strict: bool = False) -> Traversal:
    """Rows whose similarity to ``text`` passes. A missing vector on either side counts as 0, or raises if ``strict``."""
    check_threshold(operator, threshold)
    target = embedding(start.tables, text)
    if target is None:
        if strict:
            raise ValueError(f"no embedding for {text!r}")
        rows = start.rows.withColumn("similarity", F.lit(0.0))
    else:
        rows = similarities(start, target)
        if strict and rows.where("similarity is null").limit(1).count():
            raise ValueError("a row has no embedding")
        rows = rows.withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    kept = rows.where(_passes(F.col("similarity"), operator, threshold)).drop("similarity")
    return start._with(kept, True)


def everything(tables: Tables) -> Traversal:
    """All embedded texts as a frontier, whether or not they are nodes."""
    ids = tables.embeddings.select("id") if tables.embeddings is not None else tables.nodes.select("id").where("false")
    return Traversal(tables, ids)._tracked()


def k_nearest(start: Traversal, text: str, k: int = 10, keep_similarity: bool = False) -> Traversal:
    """The ``k`` rows most similar to ``text``, itself included; equal ones by id. Rows without vectors are left out."""
    target = embedding(start.tables, text)
    if target is None:
        rows = start.rows.where("false").withColumn("similarity", F.lit(0.0))
    else:
        rows = similarities(start, target, strict=True)
    rest = [F.col("path")] if start.track else []
    best = rows.orderBy(F.col("similarity").desc(), F.col("id"), *rest).limit(max(0, k))
    if not keep_similarity:
        return start._with(best.drop("similarity"))
    return replace(start._with(best), sort=(F.col("similarity").desc(),))


def embedding_stats(tables: Tables) -> DataFrame:
    """One row: count and dimensions (null without vectors)."""
    return tables.embeddings.agg(F.count(F.lit(1)).alias("count"), F.max(F.size("vec")).alias("dimensions"))


def scan_embeddings(tables: Tables, limit: int = 100) -> DataFrame:
    """Node ids that have a vector, in order of id."""
    return tables.nodes.join(tables.embeddings.select("id"), "id", "left_semi").orderBy("id").limit(limit)
