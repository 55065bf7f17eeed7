"""Cosine similarity as a column expression: float32 inputs, double sums, all in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def narrow(vec: Column) -> Column:
    """Components narrowed to float32 and widened again, as vectors are compared in single precision."""
    return F.transform(vec, lambda x: x.cast("float").cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def _norm2(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


def cosine(vec: Column, target: Sequence[float]) -> Column:
    """Similarity of ``vec`` to a literal vector; 0 if either has no length. Vectors of other sizes raise an error."""
    t = narrow(F.array(*(F.lit(float(x)) for x in target)))
    v = narrow(vec)
    size = F.size(vec) == len(target)
    checked = F.when(size, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(target)} dimensions, found "), F.size(vec).cast("string"))))
    norms = F.sqrt(_norm2(checked)) * F.sqrt(_norm2(t))
    return F.when(norms == 0, 0.0).otherwise(_dot(checked, t) / norms)
