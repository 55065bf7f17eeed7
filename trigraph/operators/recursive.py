"""Breadth-first and depth-first search by frontier iteration.

Each level is one join of the frontier with the edges, less what was visited. Levels are stored in the shared folder,
which keeps plans short and survives lost executors. A frontier is broadcast only if its counted rows are few; the ids
of a very small one are also pushed into the scan of stored edges.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigraph.functions.lineage import cut, cut_round, stored_rows
from trigraph.functions.ranks import running_total
from trigraph.operators.traversal import PUSHED_STARTS, Predicate, Traversal, adjacency, as_list, condition

#: Frontiers of at most so many rows are sent to all executors instead of shuffling the edges.
BROADCAST_ROWS = 10_000
#: Levels after which an unbounded search over walks (unique=False) gives up.
MOST_LEVELS = 1000
#: Edges of a neighbourhood, and starts, up to which the order-dependent depth-bounded search runs on the driver; with more the executors do it.
DRIVER_EDGES = 100_000


def _least(rows: DataFrame, track: bool) -> DataFrame:
    """One row per id: least path first."""
    if not track:
        return rows.distinct()
    return rows.groupBy("id").agg(F.min_by(F.struct("tags", "edges", "path"), "path").alias("b")).select("id", "b.tags", "b.edges", "b.path")


def _expand(frontier: DataFrame, near: DataFrame, track: bool) -> DataFrame:
    joined = frontier.join(near, F.col("id") == F.col("src"))
    if not track:
        return joined.select(F.col("dst").alias("id"))
    return joined.select(F.col("dst").alias("id"), "tags", F.array("pred").alias("edges"), F.concat("path", F.array("pred", "dst")).alias("path"))


def bfs(
    start: Traversal,
    predicates: str | list[str] | None = None,
    max_depth: int | None = None,
    min_depth: int = 0,
    direction: str = "out",
    until: Predicate | None = None,
    unique: bool = True,
    depth_column: bool = False,
) -> Traversal:
    """Rows reached at depth 1 or more within ``min_depth`` and ``max_depth``, from all current rows at once.

    ``until`` emits a matching row (from ``min_depth`` on, a start too) and ends its branch. With ``unique`` a vertex
    is reached once, by its least path at its least depth, and starts are never reached; without it each walk counts.
    ``depth_column`` keeps the depth in the rows.
    """
    if not unique and max_depth is None and until is None:
        raise ValueError("a search over walks needs max_depth or until")
    tables, track = start.tables, start.track
    near = adjacency(tables, as_list(predicates), direction)
    if not tables.stored:
        near = cut(near)
    stop = condition(until) if until is not None else None
    frontier = start.rows if start.starts is not None else cut(start.rows)
    visited = frontier.select("id").distinct()
    found: list[DataFrame] = []
    depth = 0
    while True:
        live = frontier
        if stop is not None:
            if depth >= min_depth:
                found.append(frontier.where(stop).withColumn("depth", F.lit(depth)))
            live = frontier.where(~F.coalesce(stop, F.lit(False)))
        if depth > 0 and depth >= min_depth:
            found.append(live.withColumn("depth", F.lit(depth)))
        if max_depth is not None and depth >= max_depth:
            break
        if depth >= MOST_LEVELS and not unique:
            raise RuntimeError(f"the search went on after {MOST_LEVELS} levels")
        rows = len(start.starts) if depth == 0 and start.starts is not None else stored_rows(frontier)
        if not rows:
            break
        edges = near
        if tables.stored and rows <= PUSHED_STARTS:
            edges = adjacency(tables, as_list(predicates), direction, [r.id for r in live.select("id").distinct().collect()])
        step = _expand(F.broadcast(live) if rows <= BROADCAST_ROWS else live, edges, track)
        if unique:
            step = _least(step.join(visited, "id", "left_anti"), track)
        frontier = cut(step)
        depth += 1
        if unique:
            visited = cut(visited.unionByName(frontier.select("id"))) if depth % 8 == 0 else visited.unionByName(frontier.select("id"))
    reached = start.rows.where("false").withColumn("depth", F.lit(0))
    for level in found:
        reached = reached.unionByName(level)
    return start._with(reached if depth_column else reached.drop("depth"))


def _dfs_rounds(start: Traversal, near: DataFrame, max_depth: int | None, min_depth: int, until: Predicate | None) -> Traversal:
    """The depth-bounded search of ``dfs`` over the stored edges ``near``, without a bound on their number.

    A vertex's place is the number of its start and those of the edges to it, negative, as the last pushed is popped first;
    vertices are popped in order of place. A vertex is pushed by the first popped of those with an edge to it that are
    expanded, so it has that one's place and the edge's number. Each round takes all places anew from those of the round
    before. Places that only depend on settled ones are settled, and only one set of places stays as it is.
    """
    stop = F.lit(False) if until is None else F.coalesce(condition(until), F.lit(False))
    links = near.select(F.col("src").alias("id"), "pred", "dst").where(~stop).groupBy("id", "dst").agg(F.min("pred").alias("pred"))
    links = running_total(links, [F.col("pred"), F.col("dst"), F.col("id")], None, "n")
    links = cut(links.select(F.col("id").alias("src"), "pred", "dst", (-F.col("n")).alias("n")))
    starts = cut(running_total(start.rows, start._order(), None, "n"))
    state = cut(starts.groupBy("id").agg(F.array(-F.max("n")).alias("place")).withColumns({"src": F.lit(None).cast("string"), "pred": F.lit(None).cast("string")}))
    while True:
        live = state if max_depth is None else state.where(F.size("place") <= max_depth)
        offer = F.struct("place", "n", "src", "pred")
        offers = live.select("id", "place").join(links, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), offer.alias("offer"))
        known = state.select("id", F.struct("place", "src", "pred").alias("known"))
        met = offers.unionByName(known, allowMissingColumns=True).groupBy("id").agg(F.min("offer").alias("offer"), F.max("known").alias("known"))
        taken = F.struct(F.concat("offer.place", F.array("offer.n")).alias("place"), "offer.src", "offer.pred")
        kept = F.when(F.size("known.place") == 1, F.col("known")).when(F.col("offer").isNotNull(), taken)
        step = cut_round(met.select("id", kept.alias("new"), (~kept["place"].eqNullSafe(F.col("known.place"))).alias("moved")))
        state = step.where("new is not null").select("id", "new.*")
        if not step.where("moved").take(1):
            break
    columns = start.rows.columns
    if not start.track:
        found = state.select("id", (F.size("place") - 1).alias("depth"))
    else:
        levels = state.agg(F.max(F.size("place"))).first()[0] or 1
        last = starts.groupBy("id").agg(F.max_by(F.struct(*(c for c in columns if c != "id")), "n").alias("row"))
        level = cut(last.select("id", "row.*"))
        found = starts.select(*columns, F.lit(0).alias("depth"))
        for depth in range(1, levels):
            before = level.select(F.col("id").alias("src"), "tags", "path")
            level = cut_round(state.where(F.size("place") == depth + 1).join(before, "src").select("id", "tags", F.array("pred").alias("edges"), F.concat("path", F.array("pred", "id")).alias("path")))
            found = found.unionByName(level.withColumn("depth", F.lit(depth)))
    return start._with(found.where((F.col("depth") >= min_depth) & ((F.col("depth") > 0) | stop)).select(*columns))


def dfs(
    start: Traversal,
    predicates: str | list[str] | None = None,
    max_depth: int | None = None,
    min_depth: int = 0,
    direction: str = "out",
    until: Predicate | None = None,
    unique: bool = True,
) -> Traversal:
    """Depth-first search.

    Walks (``unique=False``) and searches without depth bounds reach the same vertices as ``bfs`` and run as such.
    With depth bounds and ``unique`` the result depends on the order of neighbours; it is computed exactly as with a
    stack, neighbours in order of (predicate, id): on the driver if at most ``DRIVER_EDGES`` edges are near, else in
    rounds by the executors.
    """
    if not unique or max_depth is None and min_depth <= 1:
        return bfs(start, predicates, max_depth, min_depth, direction, until, unique)
    preds = as_list(predicates)
    tables, track = start.tables, start.track
    near = adjacency(tables, preds, direction)
    reach = bfs(replace(start._with(start.rows.select("id")), track=False, starts=start.starts), preds, None if max_depth is None else max_depth - 1, 0, direction)
    sources = cut(reach.rows.select("id").unionByName(start.rows.select("id")).distinct())
    near = cut(near.join(sources, F.col("src") == F.col("id"), "left_semi"))
    first = start.rows.orderBy(*start._order()).limit(DRIVER_EDGES + 1).collect() if stored_rows(near) <= DRIVER_EDGES else None
    if first is None or len(first) > DRIVER_EDGES:
        return _dfs_rounds(start, near, max_depth, min_depth, until)
    held = near.collect()
    links: dict[str, list[tuple[str, str]]] = {}
    for r in sorted(held, key=lambda r: (r.pred, r.dst)):
        links.setdefault(r.src, []).append((r.pred, r.dst))
    ids = {r.src for r in held} | {r.dst for r in held} | {r["id"] for r in first}
    stops: set[str] = set()
    if until is not None and ids:
        checked = tables.spark.createDataFrame([(i,) for i in sorted(ids)], "id string")
        stops = {r.id for r in checked.where(condition(until)).collect()}
    stack = [((r["id"], dict(r["tags"]), list(r["edges"]), list(r["path"])) if track else (r["id"],), 0) for r in first]
    visited = {r["id"] for r in first}
    out = []
    while stack:
        row, depth = stack.pop()
        if row[0] in stops:
            if depth >= min_depth:
                out.append(row)
            continue
        if depth > 0 and depth >= min_depth:
            out.append(row)
        if max_depth is not None and depth >= max_depth:
            continue
        for pred, dst in links.get(row[0], ()):
            if dst not in visited:
                visited.add(dst)
                stack.append(((dst, row[1], [pred], [*row[3], pred, dst]) if track else (dst,), depth + 1))
    rows = tables.spark.createDataFrame(out, start.rows.schema)
    return start._with(rows)
