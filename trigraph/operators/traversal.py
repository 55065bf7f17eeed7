"""Graph traversal as lazy DataFrame plans.

A ``Traversal`` is immutable: each operator returns a new one over a longer plan, and only terminals run it. A hop is an
equi-join of the frontier with the edges. With path tracking the frontier is a bag with one row per path; without it is
a set of ids, made distinct after each hop so that chains don't multiply rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.functions.ranks import running_total
from trigraph.schema import NODE, ROW

ASC, DESC = "asc", "desc"
#: Literal starts up to this number are also pushed into the edge scan as a filter.
PUSHED_STARTS = 1000
#: A page that ends within so many rows is taken from the first rows; beyond, rows are numbered.
PAGE_ROWS = 100_000
Predicate = Callable[[str], bool] | Column


@dataclass(frozen=True)
class Tables:
    """What a traversal reads. ``nodes`` has each id once and the ends of all edges.

    ``stored`` tells that edges are a file scan, cheap to read again.
    """

    spark: SparkSession
    edges: DataFrame
    nodes: DataFrame
    predicates: DataFrame
    embeddings: DataFrame | None = None
    stored: bool = False


def as_list(value: str | Iterable[str] | None) -> list[str] | None:
    return None if value is None else [value] if isinstance(value, str) else list(value)


def condition(func: Predicate, column: Column | None = None) -> Column:
    """A filter over ids: a Column is used as it is (over ``id``), a Python callable becomes a boolean UDF fed in Arrow batches."""
    if isinstance(func, Column):
        return func
    if not callable(func):
        raise TypeError("a filter is a Column or a callable")
    return F.udf(lambda x: bool(func(x)), "boolean", useArrow=True)(F.col("id") if column is None else column)


def hop_edges(tables: Tables, predicates: list[str] | None, direction: str, starts: Sequence[str] | None = None) -> DataFrame:
    """(src, pred, dst) along ``direction``; a predicate named twice gives its edges twice."""
    e = tables.edges
    if predicates is not None:
        e = e.where(F.col("p").isin(list(dict.fromkeys(predicates)))) if predicates else e.where("false")
    near, far = ("s", "o") if direction == "out" else ("o", "s")
    if starts is not None and len(starts) <= PUSHED_STARTS:
        e = e.where(F.col(near).isin(list(dict.fromkeys(starts))))
    e = e.select(F.col(near).alias("src"), F.col("p").alias("pred"), F.col(far).alias("dst"))
    if predicates and len(set(predicates)) < len(predicates):
        times = F.create_map(*(F.lit(x) for p in set(predicates) for x in (p, predicates.count(p))))
        e = e.withColumn("__n", F.explode(F.sequence(F.lit(1), times[F.col("pred")]))).drop("__n")
    return e


def adjacency(tables: Tables, predicates: list[str] | None, direction: str, starts: Sequence[str] | None = None) -> DataFrame:
    if direction in ("out", "inc"):
        return hop_edges(tables, predicates, direction, starts)
    if direction == "both":
        return hop_edges(tables, predicates, "out", starts).unionByName(hop_edges(tables, predicates, "inc", starts))
    return hop_edges(tables, [], "out")


def _least(rows: DataFrame) -> DataFrame:
    """One row per id: the one with the least path."""
    one = rows.groupBy("id").agg(F.min_by(F.struct("tags", "edges", "path"), "path").alias("b"))
    return one.select("id", "b.tags", "b.edges", "b.path")


@dataclass(frozen=True)
class Traversal:
    tables: Tables
    base: DataFrame
    track: bool = True
    starts: tuple[str, ...] | None = None  # literal ids of an unhopped frontier
    sort: tuple[Column, ...] | None = None
    whole: tuple[str, ...] | None = None  # the frontier is all nodes, saved under these tags: a hop needs no join
    only: tuple[Column, ...] = ()  # of all nodes, those that pass
    skipped: int = 0  # rows of ``base`` to leave out at the front, in order
    merged: DataFrame | None = None  # of rows whose paths are equally long, at least each id's least path; made one per id by each hop

    @cached_property
    def rows(self) -> DataFrame:
        """The frontier. Rows to be skipped are told by number, counted without one task that sees all rows."""
        if not self.skipped:
            return self.base
        numbered = running_total(self.base, self._order(), None, "__at")
        return numbered.where(F.col("__at") >= self.skipped).drop("__at")

    # sources

    @staticmethod
    def start(tables: Tables, vertex: str | Iterable[str] | None = None, func: Predicate | None = None, track_paths: bool = True) -> Traversal:
        """All nodes, or literal ids (not looked up; a list keeps repeats). ``func`` filters a full scan only."""
        spark = tables.spark
        ids = as_list(vertex)
        only: tuple[Column, ...] = ()
        if ids is None:
            base = tables.nodes.select("id")
            if func is not None:
                only = (condition(func),)
                base = base.where(only[0])
        elif not ids:
            base = spark.createDataFrame([], NODE)
        else:
            base = spark.createDataFrame([(i,) for i in ids], NODE)
            if not track_paths:
                base = base.distinct()
        t = Traversal(tables, base, track_paths, tuple(ids) if ids is not None else None, whole=() if ids is None else None, only=only)
        return t._tracked() if track_paths else t

    def _tracked(self) -> Traversal:
        rows = self.rows.select("id", F.create_map().cast(ROW["tags"].dataType).alias("tags"), F.array().cast("array<string>").alias("edges"), F.array("id").alias("path"))
        return replace(self, base=rows, track=True, merged=rows)

    def _with(self, rows: DataFrame, keep_sort: bool = False) -> Traversal:
        return replace(self, base=rows, starts=None, sort=self.sort if keep_sort else None, whole=None, only=(), skipped=0, merged=None)

    def _each(self, rows: Callable[[DataFrame], DataFrame]) -> Traversal:
        """What keeps, drops or repeats rows by their id alone, or adds to their tags, done to the merged rows too."""
        done = self._with(rows(self.rows), True)
        return done if self.merged is None else replace(done, merged=done.base if self.merged is self.base else rows(self.merged))

    def _where(self, passes: Column) -> Traversal:
        kept = self._each(lambda rows: rows.where(passes))
        if kept.merged is not None and kept.merged is not kept.base:
            read = kept.base._jdf.queryExecution().analyzed().condition().references().mkString(" ").split()
            if any(x.split("#")[0] != "id" for x in read):
                kept = replace(kept, merged=None)
        return kept if self.whole is None else replace(kept, whole=self.whole, only=(*self.only, passes))

    def _order(self) -> list[Column]:
        """The order of rows: the asked one, else by id and path, so that pages are disjoint."""
        rest = [F.col("id"), F.col("path")] if self.track else [F.col("id")]
        return [*(self.sort or ()), *rest]

    def _meet(self, near: DataFrame) -> DataFrame:
        """The rows beside their edges in ``near`` (src, pred, dst). All nodes, or those that pass, meet all edges without a join."""
        if self.whole is None:
            return self.rows.join(near, F.col("id") == F.col("src"))
        met = near.withColumn("id", F.col("src"))
        if self.track:
            tags = F.create_map(*(c for k in self.whole for c in (F.lit(k), F.col("src")))).cast(ROW["tags"].dataType)
            met = met.withColumns({"tags": tags, "edges": F.array().cast("array<string>"), "path": F.array("src")})
        for passes in self.only:
            met = met.where(passes)
        return met

    # hops

    def _hop(self, direction: str, predicates: str | Iterable[str] | None, func: Predicate | None = None) -> Traversal:
        preds = as_list(predicates)
        if func is not None and (preds is None or len(preds) != 1 or not isinstance(predicates, str)):
            raise AssertionError("a hop filter needs one predicate")
        near = adjacency(self.tables, preds, direction, self.starts)
        if func is not None:
            near = near.where(func if isinstance(func, Column) else condition(func, F.col("dst")))
        if not self.track:
            return self._with(self._meet(near).select(F.col("dst").alias("id")).distinct())
        step = lambda t: t._meet(near).select(F.col("dst").alias("id"), "tags", F.array("pred").alias("edges"), F.concat("path", F.array("pred", "dst")).alias("path"))
        hopped = self._with(step(self))
        # The least of equally long paths to an id goes on from the least path to the id before.
        return hopped if self.merged is None else replace(hopped, merged=_least(step(replace(self, base=self.merged))))

    def out(self, predicates: str | Iterable[str] | None = None, func: Predicate | None = None) -> Traversal:
        return self._hop("out", predicates, func)

    def inc(self, predicates: str | Iterable[str] | None = None, func: Predicate | None = None) -> Traversal:
        return self._hop("inc", predicates, func)

    def both(self, predicates: str | Iterable[str] | None = None) -> Traversal:
        """Out and in; a loop or a reciprocal edge counts twice."""
        return self._hop("both", predicates)

    # filters

    def _has(self, direction: str, predicates: str | Iterable[str], vertex: str) -> Traversal:
        preds = as_list(predicates)
        if preds is None:
            raise ValueError("has needs a predicate")
        match = hop_edges(self.tables, preds, direction, self.starts).where(F.col("dst") == vertex)
        if len(preds) <= 1 and self.whole is None:
            return self._each(lambda rows: rows.join(match, F.col("id") == F.col("src"), "left_semi"))
        met = lambda t: t._meet(match).select(*self.rows.columns)
        return replace(self._with(met(self), True), merged=None if self.merged is None else met(replace(self, base=self.merged)))

    def has(self, predicates: str | Iterable[str], vertex: str) -> Traversal:
        """Rows with an edge to ``vertex``, once per matching predicate."""
        return self._has("out", predicates, vertex)

    def hasr(self, predicates: str | Iterable[str], vertex: str) -> Traversal:
        """Rows with an edge from ``vertex``, once per matching predicate."""
        return self._has("inc", predicates, vertex)

    def filter(self, func: Predicate) -> Traversal:
        return self._where(condition(func))

    def is_(self, *nodes: str | Iterable[str]) -> Traversal:
        ids = as_list(nodes[0]) if len(nodes) == 1 else list(nodes)
        if not ids:
            raise ValueError("is_ needs a node")
        return self._where(F.col("id").isin(ids))

    def unique(self) -> Traversal:
        """One row per id: the one with the least path. After hops it is found without all paths."""
        if not self.track:
            return self._with(self.rows.distinct())
        one = _least(self.rows if self.merged is None else self.merged)
        return self._with(one) if self.merged is None else replace(self._with(one), merged=one)

    # tags

    def tag(self, *names: str | Iterable[str]) -> Traversal:
        """Saves the current id under one or more names."""
        if not self.track:
            raise RuntimeError("tags need path tracking")
        keys = as_list(names[0]) if len(names) == 1 else list(names)
        if not keys or not all(isinstance(k, str) for k in keys):
            raise TypeError("a tag is a string")
        kept = F.map_filter("tags", lambda k, _: ~k.isin(keys))
        new = F.create_map(*(c for k in dict.fromkeys(keys) for c in (F.lit(k), F.col("id"))))
        tagged = self._each(lambda rows: rows.withColumn("tags", F.map_concat(kept, new)))
        return tagged if self.whole is None else replace(tagged, whole=tuple(dict.fromkeys((*self.whole, *keys))), only=self.only)

    def back(self, tag: str) -> Traversal:
        """Moves to the vertex saved under ``tag``; rows without it are dropped."""
        if not self.track:
            raise RuntimeError("tags need path tracking")
        moved = self.rows.where(F.map_contains_key("tags", tag)).withColumn("id", F.col("tags")[tag])
        return replace(self._with(moved), merged=None if self.merged is None else moved)  # each id's least row may not be the one that moves there

    # order

    def order(self, direction: str = ASC) -> Traversal:
        return replace(self._with(self.rows), starts=self.starts, merged=self.merged, sort=(F.col("id").desc() if direction == DESC else F.col("id").asc(),))

    def limit(self, n: int) -> Traversal:
        """The first rows in order; after ``skip`` the page behind the skipped ones."""
        if n < 0:
            raise ValueError("limit can't be negative")
        end = self.skipped + n
        if self.skipped and end > PAGE_ROWS:
            numbered = running_total(self.base, self._order(), None, "__at")
            return self._with(numbered.where(F.col("__at").between(self.skipped, end - 1)).drop("__at"), True)
        first = self.base.orderBy(*self._order()).limit(end)
        return self._with(first.offset(self.skipped) if self.skipped else first, True)

    def skip(self, n: int) -> Traversal:
        if n < 0:
            raise ValueError("skip can't be negative")
        return replace(self._with(self.rows, True), skipped=n)

    # terminals and results

    def df(self) -> DataFrame:
        """The rows as a DataFrame, in the asked order if there is one."""
        return self.rows.orderBy(*self._order()) if self.sort else self.rows

    def count_df(self) -> DataFrame:
        return self.rows.agg(F.count(F.lit(1)).alias("count"))

    def count(self) -> int:
        return self.rows.count()

    def ids(self) -> list[str]:
        return [r.id for r in self.df().select("id").collect()]

    def all(self, options: str | None = None) -> dict:
        """``{'result': [{'id', tags...}]}``; with ``'e'`` the predicate of the last hop as ``edges``."""
        out = []
        for r in self.df().collect():
            item: dict = {"id": r["id"]}
            if self.track:
                if options and "e" in options and r["edges"]:
                    item["edges"] = list(r["edges"])
                item.update(r["tags"])
            out.append(item)
        return {"result": out}

    def first(self) -> dict | None:
        found = self.limit(1).all()["result"]
        return found[0] if found else None

    def _paths(self) -> DataFrame:
        if not self.track:
            raise RuntimeError("graph() needs path tracking")
        return self.rows.select("path").distinct()

    def graph_nodes(self) -> DataFrame:
        """Distinct vertices of all paths."""
        steps = self._paths().select(F.posexplode("path").alias("i", "id"))
        return steps.where("i % 2 = 0").select("id").distinct()

    def graph_links(self) -> DataFrame:
        """Distinct (source, label, target) of all paths, in the direction of travel."""
        hops = F.expr("transform(sequence(0, size(path) - 3, 2), i -> struct(path[i] AS source, path[i + 1] AS label, path[i + 2] AS target))")
        return self._paths().where(F.size("path") >= 3).select(F.explode(hops).alias("h")).select("h.*").distinct()

    def graph(self) -> dict:
        return {
            "nodes": [{"id": r.id} for r in self.graph_nodes().orderBy("id").collect()],
            "links": [{"source": r.source, "target": r.target, "label": r.label} for r in self.graph_links().orderBy("source", "label", "target").collect()],
        }
