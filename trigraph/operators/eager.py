"""Eager aggregation through joins: per-key results when a few keys hold most records.

Both inputs are reduced to compact states before they meet, the states are joined, and the joined states are
combined algebraically. No task ever holds all records of a key:

* ``eager_join_aggregate`` joins one state per key and side, so a key with ``m`` left and ``n`` right records costs
  one joined row instead of ``m * n``.
* ``chain_breaks`` joins links with the positions before them. Both are reduced to one state per (key, block), blocks
  being fixed stretches of the position axis. A hub key spreads over as many tasks as it has blocks; only the states
  cross block borders, and they meet in two levels, so that no task holds all states of a hub either.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stretch of the position axis that one group covers. With one record per position a group has at most so many rows.
BLOCK_WIDTH = 1 << 22
#: Neighbouring blocks whose states meet in one group; the groups of a key then meet by one state each.
BLOCKS = 1 << 13
#: Whole numbers are counted and summed in this type, as products of counts and sums outgrow 64 bits.
WHOLE = "decimal(38,0)"


@dataclass(frozen=True)
class Measure:
    """An aggregate over the joined rows: ``kind`` (sum, min, max, avg, count) of ``column`` of one side.

    ``count`` counts the joined rows in which ``column`` isn't null. Counts, and sums of whole numbers, are decimals
    of 38 digits; other sums and ``avg`` are doubles.
    """

    alias: str
    kind: str
    column: str

    def states(self, whole: bool) -> list[Column]:
        c = F.col(self.column)
        if self.kind in ("min", "max"):
            return [getattr(F, self.kind)(c).alias(f"{self.alias}__m")]
        if self.kind == "sum":
            return [F.sum(c.cast("decimal(20,0)" if whole else "double")).cast(WHOLE if whole else "double").alias(f"{self.alias}__s")]
        if self.kind == "count":
            return [F.count(c).alias(f"{self.alias}__c")]
        if self.kind == "avg":
            return [F.sum(c.cast("double")).alias(f"{self.alias}__s"), F.count(c).alias(f"{self.alias}__c")]
        raise ValueError(f"unknown measure kind {self.kind!r}")

    def partial(self, times: Column, whole: bool) -> list[Column]:
        """States of the joined rows, from one side's states repeated ``times``."""
        if self.kind in ("min", "max"):
            return [F.col(f"{self.alias}__m")]
        kinds = {"sum": {"s": whole}, "count": {"c": True}, "avg": {"s": False, "c": True}}[self.kind]
        return [(F.col(f"{self.alias}__{p}").cast(WHOLE if w else "double") * times.cast(WHOLE if w else "double")).alias(f"{self.alias}__{p}") for p, w in kinds.items()]

    def final(self) -> Column:
        """Rolls joined states up to the result."""
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(f"{self.alias}__m").alias(self.alias)
        if self.kind == "avg":
            return (F.sum(f"{self.alias}__s") / F.sum(f"{self.alias}__c").cast("double")).alias(self.alias)
        return F.sum(f"{self.alias}__{self.kind[0]}").alias(self.alias)


def _whole(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.IntegralType)


def _compact(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure], count: str) -> DataFrame:
    """One state per key. Partial aggregation runs before the shuffle, so a hub key ships one row per input task."""
    states = [s for m in measures for s in m.states(_whole(df, m.column))]
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *states)


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_measures: Sequence[Measure] = (),
    right_measures: Sequence[Measure] = (),
    how: str = "inner",
    rollup: dict[str, Column] | None = None,
    count_alias: str = "pairs",
) -> DataFrame:
    """Aggregates of ``left JOIN right USING (on)`` per key, or per ``rollup`` expression over the keys.

    Result columns: the keys (or rollup names), ``count_alias`` (joined rows), and one per measure. ``how`` is inner
    or left; an unmatched left record counts once and the right measures ignore it, as SQL has it.

    Defined cases: rows with a null key join nothing and are left out (with ``left`` too: keys are what results are
    about). Empty inputs give no rows. Repeated rows count each time. Other columns are never read, whatever
    their names.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    names = [m.alias for m in [*left_measures, *right_measures]] + [count_alias]
    if len(set(names)) != len(names):
        raise ValueError("measure names must differ")
    need_left = list(dict.fromkeys([*on, *(m.column for m in left_measures)]))
    need_right = list(dict.fromkeys([*on, *(m.column for m in right_measures)]))
    a = _compact(left.select(*need_left), on, left_measures, "__nl")
    b = _compact(right.select(*need_right), on, right_measures, "__nr")
    joined = a.join(b, list(on), how)
    nr = F.coalesce(F.col("__nr"), F.lit(1)) if how == "left" else F.col("__nr")
    parts = [p for m in left_measures for p in m.partial(nr, _whole(left, m.column))]
    parts += [p for m in right_measures for p in m.partial(F.col("__nl"), _whole(right, m.column))]
    states = joined.select(*on, (F.col("__nl").cast(WHOLE) * nr.cast(WHOLE)).alias("__pairs"), *parts)
    finals = [F.sum("__pairs").alias(count_alias), *(m.final() for m in [*left_measures, *right_measures])]
    groups = [e.alias(n) for n, e in rollup.items()] if rollup else [F.col(k) for k in on]
    return states.groupBy(*groups).agg(*finals)


def _carried(states: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(__k, __b, __links, __carry): states (__k, __b, __last, __links) with the last position of the key's lower blocks.

    The states of ``blocks`` neighbouring blocks meet in one group, which is reduced to one state; a key's groups meet
    by these. The first state of a group takes what its group's state was carried.
    """
    near = states.withColumn("__g", F.floor(F.col("__b") / blocks).cast("bigint"))
    before = near.withColumn("__before", F.lag("__last").over(Window.partitionBy("__k", "__g").orderBy("__b")))
    # Only groups with links are carried to; as their number is read here too, both uses of the states share one shuffle.
    groups = near.groupBy("__k", "__g").agg(F.max("__last").alias("__last"), F.sum("__links").alias("__n"))
    far = groups.select("__k", "__g", "__n", F.lag("__last").over(Window.partitionBy("__k").orderBy("__g")).alias("__far")).where("__far is not null and __n > 0").drop("__n")
    both = before.join(far, ["__k", "__g"], "left")
    return both.select("__k", "__b", "__links", F.coalesce("__before", "__far").alias("__carry"))


def chain_breaks(
    records: DataFrame,
    key: str = "rec_key",
    position: str = "store_position",
    link: str = "value_link",
    none_link: int = -1,
    block_width: int = BLOCK_WIDTH,
    blocks: int = BLOCKS,
) -> DataFrame:
    """Records whose ``link`` isn't the greatest lower ``position`` of a record with the same ``key``.

    Columns ``key``, ``position`` under their given names; distinct rows. In terms of a join: links meet the lower
    positions of their key, and of the joined rows the greatest position per link is wanted. Aggregated eagerly:

    1. Both inputs are salted by block of the position axis, one shuffle on (key, block) for both uses.
    2. Positions are reduced to one state per (key, block), their greatest; links to their number.
    3. The states of a key are joined in order of block (``_carried``): the greatest position of all lower blocks is
       the greatest of their states. Blocks without links are dropped, the others meet their own links.
    4. Inside a block a link's greatest lower position is a running maximum; rolled up, it is the wanted one if there
       is any, else the carried state.

    Defined cases: a null key belongs to no chain and a null position stands nowhere, so such records are no case
    and nobody's predecessor. A null link or ``none_link`` opens a chain and is no case. A record delivered again
    counts once, and equal positions do not precede each other. Without records there are no rows.
    """
    k, p, v = F.col("__k"), F.col("__p"), F.col("__v")
    rows = (
        records.select(F.col(key).alias("__k"), F.col(position).cast("bigint").alias("__p"), F.col(link).cast("bigint").alias("__v"))
        .where(k.isNotNull() & p.isNotNull())
        .withColumn("__b", F.floor(p / F.lit(block_width)).cast("bigint") if block_width & (block_width - 1) else F.shiftright(p, block_width.bit_length() - 1))
        .repartition("__k", "__b")
    )
    group = Window.partitionBy("__k", "__b").orderBy("__p")
    inside = rows.withColumn("__prev", F.max("__p").over(group.rangeBetween(Window.unboundedPreceding, -1)))
    linked = inside.where(v.isNotNull() & (v != none_link))
    states = rows.groupBy("__k", "__b").agg(F.max("__p").alias("__last"), F.count_if(v != none_link).alias("__links"))
    carried = _carried(states, blocks).where("__carry is not null and __links > 0").drop("__links")
    first = linked.where(F.col("__prev").isNull()).drop("__prev").join(carried, ["__k", "__b"], "left")
    broken_first = first.where(F.col("__carry").isNull() | (v != F.col("__carry"))).select(k, p)
    broken_inside = linked.where(F.col("__prev").isNotNull() & (v != F.col("__prev"))).select(k, p)
    return broken_inside.union(broken_first).distinct().select(k.alias(key), p.alias(position))
