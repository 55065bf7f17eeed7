"""Triples to files: N-Triples lines, strict N-Triples, CSV, TSV."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("nt", "csv", "tsv")


def strict_node(term: Column) -> Column:
    """A subject or predicate: IRIs and blank nodes pass, all else is wrapped and escaped."""
    wrapped = F.concat(F.lit("<"), F.replace(F.replace(term, F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("%3E")), F.lit(">"))
    return F.when(_plain(term), term).otherwise(wrapped)


def _plain(term: Column) -> Column:
    return (term.startswith("<") & term.endswith(">")) | term.startswith("_:")


def strict_object(term: Column) -> Column:
    """An object: IRIs and blank nodes pass, all else is a quoted literal."""
    text = term
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return F.when(_plain(term), term).otherwise(F.concat(F.lit('"'), text, F.lit('"')))


def nt_lines(edges: DataFrame, strict: bool = False) -> DataFrame:
    s, p, o = F.col("s"), F.col("p"), F.col("o")
    if strict:
        s, p, o = strict_node(s), strict_node(p), strict_object(o)
    return edges.select(F.concat_ws(" ", s, p, o, F.lit(".")).alias("value"))


def _cell(text: str, delimiter: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in (delimiter, '"', "\n", "\r")) else text


def check_format(fmt: str) -> str:
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; there are {', '.join(FORMATS)}")
    return fmt


def write_folder(edges: DataFrame, path: str, fmt: str = "nt", strict: bool = False) -> None:
    """Written by the executors as a folder of part files."""
    fmt = check_format(fmt)
    if fmt == "nt":
        nt_lines(edges, strict).write.text(path)
    else:
        named = edges.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"))
        named.write.option("header", True).option("sep", "," if fmt == "csv" else "\t").option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def get_triples(graph) -> Iterator[tuple[str, str, str]]:
    """All (s, p, o) of a graph, one partition at a time."""
    return graph.iter_triples()


def write_file(edges: DataFrame, path: str, fmt: str = "nt", strict: bool = False) -> int:
    """One local file, streamed partition by partition; returns the number of triples."""
    fmt = check_format(fmt)
    n = 0
    with open(path, "w", encoding="utf-8", newline="") as f:
        if fmt == "nt":
            for r in nt_lines(edges, strict).toLocalIterator(prefetchPartitions=True):
                f.write(r.value + "\n")
                n += 1
        else:
            d = "," if fmt == "csv" else "\t"
            f.write(d.join(("subject", "predicate", "object")) + "\r\n")
            for r in edges.select("s", "p", "o").toLocalIterator(prefetchPartitions=True):
                f.write(d.join(_cell(x, d) for x in r) + "\r\n")
                n += 1
    return n
