"""Mixing sources to target shares of tokens along a curriculum.

Each source has a weight schedule over training time, 0 to 1. Its integral gives the tokens the source must have
delivered by any time; inverting it gives each document the time at which it is due, and a range sort by that time
writes the mix. Small sources are repeated in whole passes, each pass in an order of its own.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trigraph.functions.lineage import cut
from trigraph.functions.ranks import running_total

#: Documents of one source and pass that one task puts in order.
GROUP = 20_000
#: Sources a mix may have; their totals are held by the driver.
MOST_SOURCES = 10_000
#: As a mix's size: the largest that meets all target shares.
FEASIBLE = "feasible"

SIZES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("tokens", T.LongType())])


def board(source: Column) -> Column:
    """A source's name without the ways it is written."""
    return F.lower(F.trim(F.regexp_replace(source, r"\s+", " ")))


def token_sizes(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, tokens) per document. ``tokenizer`` is the path of a tokenizer file, which is sent to the executors."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        coder = Tokenizer.from_file(SparkFiles.get(name))
        coder.encode_special_tokens = True
        for batch in batches:
            sizes = []
            for at in range(0, len(batch), 256):
                part = batch["__t"][at : at + 256].tolist()
                sizes.extend(len(e.ids) for e in coder.encode_batch_fast(part, add_special_tokens=False))
            yield pd.DataFrame({"doc_id": batch["__i"], "source": batch["__s"], "tokens": sizes})

    base = docs.select(F.col(doc_id).cast("bigint").alias("__i"), board(F.col(source).cast("string")).alias("__s"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t"))
    sized = base.where("__i is not null and __s is not null").mapInPandas(count, SIZES)
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("b")).select("doc_id", "b.source", "b.tokens")


def allot(shares: Mapping[str, float], sizes: Mapping[str, int], repeats: Mapping[str, int], total: float) -> dict[str, float]:
    """Tokens each source delivers. What a source can't deliver within its repeats goes to the others by their shares."""
    given = {s: 0.0 for s in shares}
    open_ = {s for s in shares if shares[s] > 0 and sizes.get(s, 0) * repeats[s] > 0}
    rest = float(total)
    while open_ and rest > 1e-6:
        unit = rest / sum(shares[s] for s in open_)
        full = {s for s in open_ if sizes[s] * repeats[s] <= unit * shares[s]}
        if not full:
            given |= {s: unit * shares[s] for s in open_}
            break
        given |= {s: float(sizes[s] * repeats[s]) for s in full}
        open_ -= full
        rest = float(total) - sum(given.values())
    return given


def feasible_total(shares: Mapping[str, float], sizes: Mapping[str, int], repeats: Mapping[str, int]) -> float:
    """Tokens of the largest mix in which every source can deliver its share within its repeats.

    Sources that can't deliver anything are passed over; their shares go to the others in any mix.
    """
    able = {s: share for s, share in shares.items() if share > 0 and sizes.get(s, 0) * repeats[s] > 0}
    return min((sizes[s] * repeats[s] * sum(able.values()) / share for s, share in able.items()), default=0.0)


def due_time(delivered: Column, knots: Column) -> Column:
    """The time at which the integral of a piecewise linear schedule reaches the part ``delivered`` (0 to 1).

    ``knots`` are structs (t, w, a): time, weight, and the integral up to there as a part of the whole; ``k`` has
    the slope's share of it. Inside a segment the integral is quadratic and is inverted in closed form.
    """
    seg = F.element_at(F.filter(knots, lambda k: k["a"] <= delivered), -1)
    rest = delivered - seg["a"]
    root = F.sqrt(F.greatest(F.lit(0.0), seg["w"] * seg["w"] + 2 * seg["k"] * rest))
    return F.least(F.lit(1.0), seg["t"] + F.when(rest <= 0, 0.0).otherwise(2 * rest / (seg["w"] + root)))


def _knots(schedule: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    points = sorted(schedule)
    if points[0][0] != 0 or points[-1][0] != 1 or any(w < 0 for _, w in points):
        raise ValueError("a schedule has weights of 0 or more from time 0 to time 1")
    area = [0.0]
    for (t, w), (u, v) in zip(points, points[1:]):
        area.append(area[-1] + (u - t) * (w + v) / 2)
    if not area[-1]:
        raise ValueError("a schedule must have some weight")
    out = []
    for (t, w), (u, v), a in zip(points, points[1:], area):
        if u > t:
            out.append((float(t), w / area[-1], a / area[-1], (v - w) / (u - t) / area[-1]))
    return out


class Mix:
    """A mix: ``rows`` in training order and the ``report`` of shares; see ``mix_sources``."""

    def __init__(self, rows: DataFrame, report: DataFrame):
        self.rows = rows
        self.report = report


def mix_sources(
    sizes: DataFrame,
    targets: DataFrame,
    total_tokens: int | str | None = None,
    schedules: Mapping[str, Sequence[tuple[float, float]]] | None = None,
    seed: int = 17,
) -> Mix:
    """Mixes documents (doc_id, source, tokens) to ``targets`` (source, target_share, max_repeats).

    ``total_tokens`` is the size of the mix, by default that of the targeted sources; ``FEASIBLE`` is the largest
    that meets all shares. ``schedules`` has points (time, weight) of a source's piecewise linear weight, flat by
    default; a schedule moves a source's tokens in time and leaves its total as it is. Rows: doc_id, copy (from 0),
    source, tokens, due (training time), position (tokens that come before). Report: source, target_share,
    actual_share, mix_tokens, source_tokens, mix_rows, max_repeats, feasible_tokens (size of the largest mix that
    meets all shares).

    A pass over a source is put in order by a hash of document and pass. Running totals are taken per hash range,
    range totals are summed per source, so that a source holding most documents is spread over many tasks.

    Defined cases: documents of other sources or without source aren't mixed. Target rows with null fields are left
    out, repeated ones must agree. A source without documents delivers nothing and is reported with 0. A document
    that would pass the end of its source's allotment is taken if most of it fits. Documents without tokens are taken
    when their turn comes. Without documents or targets there are no rows.
    """
    spark = sizes.sparkSession
    named = targets.select(board(F.col("source")).alias("source"), F.col("target_share").cast("double"), F.col("max_repeats").cast("int")).dropna().distinct().limit(MOST_SOURCES + 1).collect()
    if len(named) > MOST_SOURCES or len({r.source for r in named}) < len(named):
        raise ValueError("a source has several targets, or there are too many sources")
    shares = {r.source: r.target_share for r in named}
    repeats = {r.source: max(0, r.max_repeats) for r in named}
    aimed = sizes.where(F.col("source").isin(list(shares))) if shares else sizes.where("false")
    held = {r.source: (r.t or 0, r.n) for r in aimed.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    has = {s: t for s, (t, _) in held.items()}
    most = feasible_total(shares, has, repeats)
    given = allot(shares, has, repeats, sum(has.values()) if total_tokens is None else most if total_tokens == FEASIBLE else total_tokens)

    plan = []
    for s, g in given.items():
        t, n = held.get(s, (0, 0))
        if g > 0 and t > 0:
            passes = min(repeats[s], int(-(-g // t)))
            plan.append((s, float(g), passes, max(1, -(-n // GROUP)), _knots((schedules or {}).get(s, [(0.0, 1.0), (1.0, 1.0)]))))
    schema = "source string, give double, passes int, ranges int, knots array<struct<t:double,w:double,a:double,k:double>>"
    plans = F.broadcast(spark.createDataFrame(plan, schema))
    copies = aimed.join(plans, "source").select("*", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)).alias("copy"))
    copies = copies.withColumn("__h", F.xxhash64("doc_id", "copy", F.lit(seed)))
    unit = (F.col("__h").cast("double") / 2.0**64) + 0.5
    copies = copies.withColumn("__r", F.least(F.floor(unit * F.col("ranges")), F.col("ranges") - 1).cast("int"))
    group = ["source", "copy", "__r"]
    totals = copies.groupBy(*group).agg(F.sum("tokens").alias("__sum"))
    earlier = Window.partitionBy("source").orderBy("copy", "__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*group).orderBy("__h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("__in", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(offsets, group)
    middle = F.col("__offset") + F.col("__in") + F.col("tokens") / 2
    kept = placed.withColumn("__m", middle).where(F.col("__m") <= F.col("give"))
    due = due_time(F.col("__m") / F.col("give"), F.col("knots"))
    rows = running_total(kept.select("doc_id", "copy", "source", "tokens", due.alias("due")), [F.col("due"), F.col("source"), F.col("doc_id"), F.col("copy")], F.col("tokens"), "position")
    got = rows.groupBy("source").agg(F.sum("tokens").alias("mix_tokens"), F.count(F.lit(1)).alias("mix_rows"))
    base = [(s, shares[s], repeats[s], held.get(s, (0, 0))[0]) for s in shares]
    report = spark.createDataFrame(base, "source string, target_share double, max_repeats int, source_tokens long").join(F.broadcast(got), "source", "left").fillna(0, ["mix_tokens", "mix_rows"])
    whole = F.sum("mix_tokens").over(Window.partitionBy())
    report = report.select("source", "target_share", F.when(whole > 0, F.col("mix_tokens") / whole).otherwise(0.0).alias("actual_share"), "mix_tokens", "source_tokens", "mix_rows", "max_repeats", F.floor(F.lit(float(most))).cast("bigint").alias("feasible_tokens"))
    return Mix(rows, report)


def mix_boards(docs: DataFrame, targets: DataFrame, tokenizer: str, **rules) -> Mix:
    """The mix of forum boards, sizes in tokens of ``tokenizer``; texts are tokenized once."""
    return mix_sources(cut(token_sizes(docs, tokenizer)), targets, **rules)
