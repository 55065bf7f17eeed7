import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trigraph.graph import Graph
from trigraph.operators import recursive
from trigraph.operators.traversal import Traversal

#: A made-up railway: stations, the lines between them, and what they have.
RAILWAY = [
    ("Arn", "leads", "Bex"), ("Arn", "leads", "Cut"), ("Bex", "leads", "Cut"), ("Cut", "leads", "Dov"), ("Dov", "leads", "Arn"), ("Dov", "leads", "Dov"),
    ("Eel", "leads", "Cut"), ("Eel", "leads", "Fyn"), ("Fyn", "leads", "Eel"), ("Arn", "has", "shed"), ("Cut", "has", "crane"), ("Dov", "has", "shed"),
    ("Fyn", "has", "crane"), ("Fyn", "has", "shed"), ("Bex", "near", "Cut"),
]


def triples_frame(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


@pytest.fixture(scope="module")
def g(spark):
    return Graph.from_triples(triples_frame(spark, RAILWAY).cache(), stored=True)


def ids(g):
    return sorted(r["id"] for r in g.all()["result"])


def edges_along(direction, preds=None):
    """(from, predicate, to) along a direction; what the hop operators join with."""
    found = [(s, p, o) for s, p, o in RAILWAY if preds is None or p in preds]
    back = [(o, p, s) for s, p, o in found]
    return found if direction == "out" else back if direction == "inc" else found + back


def walk(starts, *hops):
    """Paths by nested loops: [(start, predicate, vertex, predicate, vertex ...)]."""
    paths = [(v,) for v in starts]
    for direction, preds in hops:
        paths = [(*path, p, b) for path in paths for a, p, b in edges_along(direction, preds) if a == path[-1]]
    return paths


STATIONS = sorted({x for s, _, o in RAILWAY for x in (s, o)})


def ends(starts, *hops):
    return sorted(p[-1] for p in walk(starts, *hops))


def test_hops_keep_paths_as_a_bag(g):
    for v in ("Arn", "Dov", "shed", "nowhere"):
        for d, e in (("out", "inc"), ("inc", "out"), ("both", "out"), ("out", "both")):
            one = getattr(g.v(v), d)("leads")
            assert ids(one) == ends([v], (d, ["leads"]))
            got = getattr(getattr(g.v(v), d)().tag("mid"), e)(["leads", "has"]).df().collect()
            assert sorted(tuple(r.path) for r in got) == sorted(walk([v], (d, None), (e, ["leads", "has"])))
            assert all(r.tags["mid"] == r.path[2] for r in got)
    assert ids(g.v("Arn").out(["nothing"])) == [] == ids(g.v("Arn").out([]))
    assert ids(g.v().inc("has").inc("leads")) == ends(STATIONS, ("inc", ["has"]), ("inc", ["leads"]))
    assert g.v().out().count() == len(RAILWAY) == g.v().inc().count()
    assert ids(g.v("Dov").both("leads")) == ["Arn", "Cut", "Dov", "Dov"]
    assert ids(g.v("Arn").out(["has", "has"])) == ["shed", "shed"]
    assert ids(g.v(["Bex", "Bex", "nobody"])) == ["Bex", "Bex", "nobody"]


def test_sets_without_paths(g):
    assert ids(g.v(track_paths=False).out("leads")) == sorted(set(ends(STATIONS, ("out", ["leads"]))))
    assert g.v(["Bex", "Bex"], track_paths=False).count() == 1
    with pytest.raises(RuntimeError):
        g.v(track_paths=False).tag("x")
    with pytest.raises(RuntimeError):
        g.v(track_paths=False).graph()


def test_filters(g):
    assert ids(g.v().has("leads", "Cut")) == sorted(s for s, p, o in RAILWAY if (p, o) == ("leads", "Cut"))
    assert "edges" not in g.v().has("has", "shed").all("e")["result"][0]
    assert ids(g.v().hasr("leads", "Eel")) == ["Cut", "Fyn"]
    assert ids(g.v(["Bex", "Arn", "Fyn"]).has(["leads", "near", "leads"], "Cut")) == ["Arn"] * 2 + ["Bex"] * 3
    assert ids(g.v().out("leads").has("has", "shed")) == sorted(v for v in ends(STATIONS, ("out", ["leads"])) if (v, "has", "shed") in RAILWAY)
    assert ids(g.v().filter(lambda x: x.startswith("D"))) == ["Dov"] == ids(g.v().filter(F.col("id").startswith("D")))
    assert ids(g.v(func=lambda x: x < "B")) == ["Arn"]
    assert ids(g.v("Arn").out("leads", func=lambda x: x != "Bex")) == ["Cut"]
    with pytest.raises(AssertionError):
        g.v("Arn").out(["leads"], func=lambda x: True)
    assert ids(g.v().out("leads").is_("Cut", "Fyn")) == ["Cut"] * 3 + ["Fyn"] == ids(g.v().out("leads").is_(["Cut", "Fyn"]))
    with pytest.raises(ValueError):
        g.v().has(None, "x")
    with pytest.raises(TypeError):
        g.v().filter(3)
    assert ids(g.v().out("leads").unique()) == ["Arn", "Bex", "Cut", "Dov", "Eel", "Fyn"]


def test_filters_from_all_nodes_go_on_without_a_join(g):
    shed = [v for v in STATIONS if v > "B"]
    t = g.v().filter(F.col("id") > "B").tag("from").is_(*shed).out("leads").current
    assert sorted((r.id, r["tags"]["from"]) for r in t.rows.collect()) == sorted((p[-1], p[0]) for p in walk(shed, ("out", ["leads"])))
    assert "Join" not in t.rows._jdf.queryExecution().optimizedPlan().toString()
    assert ids(g.v(func=lambda x: x > "D").out("leads")) == ends([v for v in STATIONS if v > "D"], ("out", ["leads"]))
    assert ids(g.v().filter(F.col("id") > "D").has("has", "shed")) == ["Dov", "Fyn"]


def test_order_and_pages(g, monkeypatch):
    every = ends(STATIONS, ("out", ["leads"]))
    assert [r["id"] for r in g.v().out("leads").unique().order("desc").all()["result"]] == ["Fyn", "Eel", "Dov", "Cut", "Bex", "Arn"]
    assert [r["id"] for r in g.v().order().skip(2).limit(2).all()["result"]] == STATIONS[2:4]
    assert g.v().order("desc").first() == {"id": "shed"} == g.v().order("desc").one()
    from trigraph.operators import traversal

    for most in (traversal.PAGE_ROWS, 2):
        monkeypatch.setattr(traversal, "PAGE_ROWS", most)
        pages = [r["id"] for k in range(0, 12, 3) for r in g.v().out("leads").skip(k).limit(3).all()["result"]]
        assert pages == every
        assert [r["id"] for r in g.v().out("leads").order("desc").skip(4).all()["result"]] == every[::-1][4:]
        assert sorted(r["id"] for r in g.v().out("leads").skip(7).out("has").all()["result"]) == ends(every[7:], ("out", ["has"]))
        assert g.v().out("leads").skip(3).skip(4).count() == len(every) - 7 and g.v().skip(100).count() == 0
        assert g.v().out("leads").skip(2).limit(5).skip(1).limit(2).count() == 2
    for bad in (lambda: g.v().limit(-1), lambda: g.v().skip(-1)):
        with pytest.raises(ValueError):
            bad()


def test_no_page_sends_all_rows_to_one_task(spark):
    edges = spark.range(1000).selectExpr("'s' || id AS s", "'p' AS p", "'o' || id AS o")
    t = Traversal.start(Graph.from_triples(edges).tables).out("p")
    for page in (t.skip(10).limit(5), t.skip(200_000).limit(5)):
        page.rows.collect()
        plan = page.rows._jdf.queryExecution().executedPlan().toString().split("\n")
        alone = [below for line, below in zip(plan, plan[1:]) if "SinglePartition" in line]
        assert all("HashAggregate(keys=[__part" in x or "TakeOrderedAndProject" in x for x in alone)
    assert t.skip(990).rows.count() == 10


def test_tags_and_paths(g):
    rows = g.v().tag(["a", "b"]).out("has").back("a").all("e")["result"]
    assert sorted((r["id"], r["a"], r["b"], *r["edges"]) for r in rows) == sorted((s, s, s, "has") for s, p, _ in RAILWAY if p == "has")
    assert ids(g.v("Bex").back("missing")) == []
    assert g.v("Eel").tag("x").out("leads").is_("Fyn").tag("x").all()["result"] == [{"id": "Fyn", "x": "Fyn"}]
    assert g.v("Cut").tag("id").out("leads").all()["result"] == [{"id": "Cut"}]
    with pytest.raises(TypeError):
        g.v().tag(3)
    paths = walk(["Arn"], ("out", ["leads"]), ("inc", ["leads"]))
    links = {(p[i], p[i + 2], p[i + 1]) for p in paths for i in range(0, len(p) - 2, 2)}
    assert g.v("Arn").out("leads").inc("leads").graph() == {
        "nodes": [{"id": x} for x in sorted({v for p in paths for v in p[::2]})],
        "links": [{"source": s, "target": t, "label": x} for s, t, x in sorted(links)],
    }
    assert g.v("Arn").graph() == {"nodes": [{"id": "Arn"}], "links": []}


def test_the_graph_is_stateful(g):
    g.v("Eel")
    g.out("leads")
    assert ids(g) == ["Cut", "Fyn"]
    assert ids(g.v("Eel").out("leads").v("Bex")) == ["Bex"]
    assert g.scan(2) == {"result": [{"id": "Arn"}, {"id": "Bex"}]} and g.scan(9, "e") == {"result": [{"id": x} for x in ("has", "leads", "near")]}
    with pytest.raises(AssertionError):
        g.scan(3, 4)
    with pytest.raises(RuntimeError):
        g.put("a", "b", "c")


def test_whole_frontier_hops_have_no_join(g):
    plan = g.v().tag("x").out("leads").df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_unique_after_hops_does_not_make_all_paths(spark):
    """A hub makes paths of all pairs of its neighbours; the least path to each is found without them."""
    rng = random.Random(1)
    v = [f"v{i}" for i in range(9)]
    start = Traversal.start(Graph.from_triples(triples_frame(spark, sorted({(rng.choice(v), rng.choice("pq"), rng.choice(v)) for _ in range(30)})).cache()).tables)
    for chain in (
        lambda t: t.tag("a").out().inc("p"),
        lambda t: t.filter(F.col("id") > "v3").out("p").filter(lambda x: x < "v7").tag("b").both(),
        lambda t: t.tag("a").out("p").out().back("a").inc().hasr(["p", "q"], "v1"),
        lambda t: t.out().filter(F.element_at("path", 1) > "v4").order().out().has("q", "v2"),
    ):
        t = chain(start)
        rows = lambda df: sorted((r["id"], str(r["tags"]), *r["edges"], *r["path"]) for r in df.collect())
        least: dict[str, tuple] = {}
        for r in sorted(t.rows.collect(), key=lambda r: r["path"], reverse=True):
            least[r["id"]] = (r["id"], str(r["tags"]), *r["edges"], *r["path"])
        assert rows(t.unique().rows) == sorted(least.values())
    plan = start.out("p").inc("p").unique().rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by") >= 2


def reach(edges, starts, preds, most, least, direction, until, unique):
    """The search rule, on one machine."""
    def near(v):
        out = [o for s, p, o in edges if s == v and (preds is None or p in preds)] if direction in ("out", "both") else []
        return out + ([s for s, p, o in edges if o == v and (preds is None or p in preds)] if direction in ("inc", "both") else [])

    result, level, seen, depth = [], list(starts), set(starts), 0
    while level:
        after = []
        for v in level:
            if until and until(v):
                if depth >= least:
                    result.append(v)
                continue
            if depth > 0 and depth >= least:
                result.append(v)
            if most is not None and depth >= most:
                continue
            for w in near(v):
                if unique:
                    if w in seen:
                        continue
                    seen.add(w)
                after.append(w)
        level, depth = after, depth + 1
    return sorted(result)


@pytest.mark.parametrize("seed", range(4))
def test_bfs_against_a_simple_search(spark, seed):
    rng = random.Random(seed)
    v = [f"v{i}" for i in range(8)]
    edges = sorted({(rng.choice(v), rng.choice("pq"), rng.choice(v)) for _ in range(14)})
    tables = Graph.from_triples(triples_frame(spark, edges).cache(), stored=True).tables
    for unique, most, least, direction, preds in ((True, None, 0, "both", None), (True, 2, 0, "out", ["p"]), (True, 3, 2, "inc", None), (False, 3, 1, "out", None)):
        for until in (None, lambda x: x in ("v1", "v2")):
            starts = rng.sample(v, 2)
            t = Traversal.start(tables, starts)
            got = recursive.bfs(t, preds, most, least, direction, until, unique)
            assert sorted(got.ids()) == reach(edges, starts, preds, most, least, direction, until, unique)
            if most is None and unique:
                assert sorted(recursive.dfs(t, preds, most, least, direction, until, unique).ids()) == sorted(got.ids())


def test_bounded_dfs_marks_on_push(spark):
    rows = [("a", "p", "b"), ("a", "p", "c"), ("c", "p", "d"), ("d", "p", "b"), ("b", "p", "e")]
    g = Graph.from_triples(triples_frame(spark, rows))
    assert ids(g.v("a").dfs("p", max_depth=2)) == ["b", "c", "d", "e"]
    assert g.v("a").dfs("p", max_depth=2).filter(F.col("id") == "e").df().first()["path"] == ["a", "p", "b", "p", "e"]
    assert ids(g.v("a").dfs("p", max_depth=3, min_depth=2)) == ["d", "e"]
    assert ids(g.v("a").dfs("p", max_depth=2, until=lambda x: x == "c")) == ["b", "c", "e"]


def test_bounded_dfs_beyond_the_drivers_edges(spark, monkeypatch):
    """Too many edges for the driver raised an error; the executors reach the same rows by the same paths."""
    rng = random.Random(0)
    v = [f"v{i:02}" for i in range(14)]
    tables = Graph.from_triples(triples_frame(spark, sorted({(rng.choice(v), rng.choice("pq"), rng.choice(v)) for _ in range(40)})).cache(), stored=True).tables
    for most, least, direction, until, track in ((3, 0, "out", lambda x: x in ("v01", "v02"), True), (None, 3, "inc", None, False)):
        starts = rng.sample(v, 2)
        t = Traversal.start(tables, [*starts, starts[0]], None, track)
        search = lambda: Counter(map(str, recursive.dfs(t.tag("from") if track else t, None, most, least, direction, until).rows.collect()))  # noqa: E731, B023
        few = search()
        with monkeypatch.context() as m:
            m.setattr(recursive, "DRIVER_EDGES", 0)
            assert few and search() == few


def test_searches_edge_cases(spark):
    g = Graph.from_triples(triples_frame(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")]))
    assert ids(g.v("a").bfs()) == ["b", "c"]
    assert ids(g.v("a").bfs(direction="sideways")) == []
    assert ids(g.v("a").bfs(until=lambda x: x == "a")) == ["a"]
    assert g.v("a").tag("from").bfs(max_depth=1).all()["result"] == [{"id": "b", "from": "a"}]
    assert ids(g.v([]).bfs()) == []
    with pytest.raises(ValueError):
        g.v("a").bfs(unique=False)
