"""Resolution of append-only logs to their live state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT, REPLACE, DELETE = "P", "R", "D"
LIST, SET = "L", "U"


def live_edges(log: DataFrame) -> DataFrame:
    """Live (s, p, o) of a log (seq, op, s, p, o).

    The last operation on a triple decides, unless a later REPLACE on (s, p) voids it. Both sides are reduced before
    they meet: one state per triple, one number per replaced (s, p).
    """
    last = log.groupBy("s", "p", "o").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"))
    replaced = log.where(F.col("op") == REPLACE).groupBy("s", "p").agg(F.max("seq").alias("since"))
    joined = last.where(F.col("op") != DELETE).join(replaced, ["s", "p"], "left")
    return joined.where(F.col("since").isNull() | (F.col("seq") >= F.col("since"))).select("s", "p", "o")


def merged_edges(log: DataFrame) -> DataFrame:
    """The rows of a log that decide what it says: of each triple the last operation and the first that isn't a delete
    (it made the vertices), of each (s, p) the last REPLACE."""
    kept = log.groupBy("s", "p", "o").agg(F.max(F.struct("seq", "op")).alias("last"), F.min(F.when(F.col("op") != DELETE, F.struct("seq", "op"))).alias("first"))
    kept = kept.select("s", "p", "o", F.explode(F.array_compact(F.array("first", "last"))).alias("r")).select("r.seq", "r.op", "s", "p", "o")
    replaced = log.where(F.col("op") == REPLACE).groupBy("s", "p").agg(F.max(F.struct("seq", "o")).alias("r"))
    return kept.unionByName(replaced.select("r.seq", F.lit(REPLACE).alias("op"), "s", "p", "r.o")).distinct()


def merged_embeddings(log: DataFrame) -> DataFrame:
    return log.groupBy("id").agg(F.max_by(F.struct("seq", "op", "vec"), "seq").alias("r")).select("r.seq", "r.op", "id", "r.vec")


def over(base: DataFrame, log: DataFrame, few: bool) -> DataFrame:
    """Live (s, p, o) of a compacted ``base`` and a later ``log``. With ``few`` log rows the base isn't shuffled."""
    small = F.broadcast if few else lambda df: df
    kept = base.join(small(log.select("s", "p", "o").distinct()), ["s", "p", "o"], "left_anti")
    kept = kept.join(small(log.where(F.col("op") == REPLACE).select("s", "p").distinct()), ["s", "p"], "left_anti")
    return kept.select("s", "p", "o").unionByName(live_edges(log))


def joined_set(base: DataFrame, more: DataFrame, key: str, few: bool) -> DataFrame:
    """The union of two sets by ``key``; what is in both comes from ``more``. With ``few`` more rows the base isn't shuffled."""
    held = more.select(key)
    return base.join(F.broadcast(held) if few else held, key, "left_anti").unionByName(more)


def ever_nodes(log: DataFrame) -> DataFrame:
    """Every vertex ever put; deletes leave vertices behind."""
    put = log.where(F.col("op") != DELETE)
    return put.select(F.explode(F.array("s", "o")).alias("id")).distinct()


def ever_predicates(log: DataFrame) -> DataFrame:
    return log.where(F.col("op") != DELETE).select("p").distinct()


def live_embeddings(log: DataFrame) -> DataFrame:
    """Last vector of each text, unless deleted last."""
    last = log.groupBy("id").agg(F.max_by(F.struct("op", "vec"), "seq").alias("b"))
    return last.where(F.col("b.op") != DELETE).select("id", F.col("b.vec").alias("vec"))


def live_items(log: DataFrame) -> DataFrame:
    """Live (tbl, key, kind, seq, value) of a key-value log, one row per value.

    ``kind`` is s (scalar), l (list, newest ``seq`` first) or u (set, in order of ``seq``, the first adding). A scalar
    put and a delete void what was before; a list or set goes on from there.

    A key's values are never gathered: each key is reduced to a compact state, and the state is joined to its
    records, a join that adaptive execution splits for keys with many records.
    """
    whole, grown = F.col("op").isin(PUT, DELETE), F.col("op").isin(LIST, SET)
    states = log.groupBy("tbl", "key").agg(
        F.max_by(F.struct("seq", "op", "value"), F.when(whole, F.col("seq"))).alias("base"),
        F.max_by(F.struct("seq", "op"), F.when(grown, F.col("seq"))).alias("added"),
    )
    since = F.coalesce(F.col("base.seq"), F.lit(-1))
    kind = F.when(F.col("added.seq") > since, F.when(F.col("added.op") == LIST, "l").otherwise("u")).when(F.col("base.op") == PUT, "s")
    states = states.select("tbl", "key", "base", since.alias("since"), kind.alias("kind")).where("kind is not null")
    scalars = states.where("kind = 's'").select("tbl", "key", "kind", "base.seq", "base.value")
    items = log.where(grown).join(states.where("kind <> 's'").drop("base"), ["tbl", "key"]).where("seq > since").select("tbl", "key", "kind", "seq", "value")
    sets = items.where("kind = 'u'").groupBy("tbl", "key", "kind", "value").agg(F.min("seq").alias("seq")).select("tbl", "key", "kind", "seq", "value")
    return scalars.unionByName(items.where("kind = 'l'")).unionByName(sets)
