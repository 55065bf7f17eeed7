"""Files to triples: N-Triples and N-Quads lines, CSV, edge lists, word vectors."""

from __future__ import annotations

import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line the JVM can split alone: three terms, each a word or plainly quoted text, and maybe more, parted by blanks.
_TERM = r'([^ \t\r\n"\'\\]+|"[^"\\]*")'
_LINE = rf"^[ \t\r]*{_TERM}[ \t\r]+{_TERM}[ \t\r]+{_TERM}(?:[ \t\r]+[^\"'\\]*)?$"
#: What Python takes for blanks.
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_BLANK}+|{_BLANK}+$", "")


def split_line(line: str) -> list[str] | None:
    """Terms by shell rules: quotes go, backslashes escape, blanks in quotes stay but for outer ones."""
    try:
        parts = shlex.split(line)
    except ValueError as e:
        raise ValueError(f"unreadable triple line: {line[:200]!r}") from e
    if not parts:
        return None
    if len(parts) < 3:
        raise ValueError(f"a triple line needs three terms: {line[:200]!r}")
    return [p.strip() for p in parts[:3]]


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of a line file; the context term is dropped, blank lines are skipped.

    Plain lines are split by one regular expression in the JVM; lines with escapes, typed or tagged literals, or mixed
    quoting go to Python.
    """
    lines = spark.read.text(path).where(_strip(F.col("value")) != "")
    plain = F.col("value").rlike(_LINE)

    def term(i: int) -> Column:
        t = F.regexp_extract("value", _LINE, i)
        return _strip(F.when(t.startswith('"'), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t))

    fast = lines.where(plain).select(term(1).alias("s"), term(2).alias("p"), term(3).alias("o"))

    def slow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([p for v in batch["value"] if (p := split_line(v))], columns=["s", "p", "o"])

    return fast.unionByName(lines.where(~plain).mapInPandas(slow, "s string, p string, o string"))


def unpivot(df: DataFrame, id_column: str) -> DataFrame:
    """A table's cells as triples (row's id, column, cell), the id column included; null cells are empty text."""
    if not id_column or id_column not in df.columns:
        raise ValueError("an id column is needed")
    cells = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))
    held = cells.withColumn("__row", F.col(f"`{id_column}`"))
    return held.unpivot("__row", [f"`{c}`" for c in df.columns], "p", "o").select(F.col("__row").alias("s"), "p", "o")


def read_csv(spark: SparkSession, path: str, id_column: str) -> DataFrame:
    """(row's id, column, cell) for each cell of a CSV file with a header."""
    if id_column is None:
        raise ValueError("an id column is needed")
    table = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", None).csv(path)
    return unpivot(table, id_column)


def _words(spark: SparkSession, path: str) -> DataFrame:
    """(w) per line: its words, as any blanks part them."""
    return spark.read.text(path).select(F.split(_strip(F.col("value")), f"{_BLANK}+").alias("w"))


def read_edgelist(spark: SparkSession, path: str, predicate: str = "none") -> DataFrame:
    """The first two words of each line, joined by ``predicate``."""
    words = _words(spark, path).where(F.size("w") >= 2)
    return words.select(F.col("w")[0].alias("s"), F.lit(predicate).alias("p"), F.col("w")[1].alias("o"))


def read_word_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, vec) of lines ``word number number ...``; shorter lines are skipped and don't count for ``limit``."""
    split = _words(spark, path).where(F.size("w") >= 2)
    if limit is not None:
        split = split.limit(limit)
    return split.select(F.col("w")[0].alias("id"), F.transform(F.slice("w", F.lit(2), F.size("w") - 1), lambda x: x.cast("double")).alias("vec"))


def keyed_vectors(model, limit: int | None = None, batch_size: int = 1000) -> Iterator[list[tuple[str, list[float]]]]:
    """Batches of (word, vector) of any object with ``index_to_key`` and item access, or one that has it as ``wv``."""
    vectors = getattr(model, "wv", model)
    keys = vectors.index_to_key[:limit] if limit is not None else vectors.index_to_key
    for at in range(0, len(keys), batch_size):
        yield [(k, [float(x) for x in vectors[k].tolist()]) for k in keys[at : at + batch_size]]
