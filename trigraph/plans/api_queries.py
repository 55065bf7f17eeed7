"""Queries that go through the public objects: graphs changed, stored, searched and served, key-value stores, files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph import export
from trigraph.config import Config
from trigraph.functions.lineage import shared_path
from trigraph.graph import Graph
from trigraph.kv import KeyValueStore
from trigraph.operators import vectors
from trigraph.plans.graph_queries import _KV, QUERIES, SQL, E, K, query  # noqa: F401 - the queries below are added to these
from trigraph.plans.graph_queries import _records as kv_records
from trigraph.plans.triples import edges, graph, kept, table
from trigraph.sources.files import read_edgelist, read_triples

#: Edges of the small tables, for calls that take or give one row after the other on the driver.
S = """S AS (SELECT concat('nation:', n_nationkey) AS s, 'in_region' AS p, concat('region:', n_regionkey) AS o FROM nation
 UNION SELECT concat('nation:', n_nationkey), 'name', n_name FROM nation UNION SELECT concat('region:', r_regionkey), 'name', r_name FROM region)"""


def _small(spark: SparkSession, sf_dir: str) -> list[tuple[str, str, str]]:
    nation, region = table(spark, sf_dir, "nation").collect(), table(spark, sf_dir, "region").collect()
    rows = [(f"nation:{r.n_nationkey}", "in_region", f"region:{r.n_regionkey}") for r in nation]
    return rows + [(f"nation:{r.n_nationkey}", "name", r.n_name) for r in nation] + [(f"region:{r.r_regionkey}", "name", r.r_name) for r in region]


def _stored(spark: SparkSession, name: str = "api", **options) -> Graph:
    return Graph(spark, name, home=shared_path(spark, "graphs"), **options)


def _frame(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


# changes one by one
@query("q51_puts", f"WITH {S} SELECT s, p, o FROM S WHERE NOT (p = 'name' AND s = 'region:0') UNION ALL SELECT 'region:0', 'name', 'ZERO' UNION ALL SELECT 'region:9', 'name', 'NINE'")
def _(spark, sf_dir):
    g = _stored(spark, flush_rows=20)
    for s, p, o in _small(spark, sf_dir):
        g.put(s, p, o)
    g.update("region:0", "name", "ZERO").put("region:9", "name", "NONE", create_new_edge=True).put("region:9", "name", "NINE", update=True)
    return g.triples_df()


@query("q51b_put_batch_and_delete", f"WITH {S} SELECT s, p, o FROM S WHERE o <> 'region:2'")
def _(spark, sf_dir):
    rows = _small(spark, sf_dir)
    g = _stored(spark).put_batch(rows).compact()
    for s, p, o in rows:
        if o == "region:2":
            g.delete(s, p, o)
    return g.triples_df()


@query("q51c_nodes_stay", f"WITH {S} SELECT s AS id FROM S UNION SELECT o FROM S")
def _(spark, sf_dir):
    """Vertices stay when all their edges are deleted, over a snapshot too."""
    rows = _small(spark, sf_dir)
    g = _stored(spark).begin_batch().put_batch(rows).end_batch().compact()
    for triple in rows:
        g.delete(*triple)
    assert g.triples() == []
    return g.tables.nodes


@query("q51d_truncate_and_names", f"WITH {S} SELECT 'kept' AS graph, s, p, o FROM S WHERE p = 'name' UNION ALL SELECT 'emptied', 'a', 'b', 'c'")
def _(spark, sf_dir):
    rows = _small(spark, sf_dir)
    g = _stored(spark, "emptied").put_batch(rows).truncate().put("a", "b", "c")
    g.use("gone").put("x", "y", "z").sync().drop()
    g.use("kept").put_batch([r for r in rows if r[1] == "name"]).sync()
    parts = [g.use(name).triples_df().select(F.lit(name).alias("graph"), "s", "p", "o") for name in g.ls()]
    return parts[0].unionByName(parts[1])


@query("q51e_tail_over_snapshot", f"WITH {E}, U AS (SELECT concat('part:', p_partkey) AS s FROM part WHERE p_size > 40) SELECT s, p, o FROM E WHERE NOT (p = 'brand' AND s IN (SELECT s FROM U)) AND p IN ('brand', 'child_of', 'segment') UNION ALL SELECT s, 'brand', 'none' FROM U")
def _(spark, sf_dir):
    """Replacements laid over a snapshot."""
    g = _stored(spark).put_batch(edges(spark, sf_dir).where("p in ('brand', 'child_of', 'segment')")).compact()
    large = table(spark, sf_dir, "part").where("p_size > 40")
    g._stored().append("edges", large.select(F.lit("R").alias("op"), F.concat(F.lit("part:"), "p_partkey").alias("s"), F.lit("brand").alias("p"), F.lit("none").alias("o")))
    return g.triples_df()


# documents
@query("q52_put_json", """SELECT concat('_:_id_n', n_nationkey) AS s, p, o FROM (
 SELECT n_nationkey, '_id' AS p, concat('n', n_nationkey) AS o FROM nation UNION ALL SELECT n_nationkey, 'name', upper(n_name) || '!' FROM nation
 UNION ALL SELECT n_nationkey, 'key', n_nationkey::VARCHAR FROM nation UNION ALL SELECT n_nationkey, 'region', concat('_:_id_r', n_regionkey) FROM nation)
 UNION SELECT concat('_:_id_r', r_regionkey), '_id', concat('r', r_regionkey) FROM region UNION SELECT concat('_:_id_r', r_regionkey), 'name', r_name FROM region""")
def _(spark, sf_dir):
    import json

    names = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").collect()}
    nation = table(spark, sf_dir, "nation").collect()
    g = _stored(spark)
    g.put_json(json.dumps([{"_id": f"n{r.n_nationkey}", "name": r.n_name, "key": r.n_nationkey, "region": {"_id": f"r{r.n_regionkey}", "name": names[r.n_regionkey]}} for r in nation]))
    for r in nation:
        g.updatej(json.dumps({"_id": f"n{r.n_nationkey}", "name": r.n_name.upper() + "!"}))
    return g.triples_df()


@query("q52b_json_lists", """SELECT r_name AS region, list_sort(list(n_name)) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def _(spark, sf_dir):
    """Documents without ids: lists are vertices of their own between an object and its items."""
    import json

    nation = table(spark, sf_dir, "nation").collect()
    g = _stored(spark)
    for r in table(spark, sf_dir, "region").collect():
        g.put_json(json.dumps({"region": r.r_name, "nations": [n.n_name for n in nation if n.n_regionkey == r.r_regionkey]}))
    rows = g.v().out("region").tag("region").inc("region").out("nations").out().df()
    return rows.groupBy(F.col("tags")["region"].alias("region")).agg(F.array_sort(F.collect_list("id")).alias("nations"))


# traversal results
@query("q53_vertex_function", f"WITH {E} SELECT o AS id FROM E WHERE p = 'in_region' AND s LIKE 'nation:%1'")
def _(spark, sf_dir):
    return graph(spark, sf_dir).v(func=lambda x: x.startswith("nation:") and x.endswith("1")).out("in_region").df().select("id")


@query("q53b_all_with_edges", f"WITH {S} SELECT s AS start, o AS id, p AS edge FROM S WHERE s LIKE 'nation:%'")
def _(spark, sf_dir):
    g = Graph.from_triples(_frame(spark, _small(spark, sf_dir), "s string, p string, o string"))
    rows = g.v().filter(F.col("id").startswith("nation:")).tag("start").out().all("e")["result"]
    return _frame(spark, ((r["start"], r["id"], r["edges"][0]) for r in rows), "start string, id string, edge string")


@query("q53c_scan", f"WITH {S}, N AS (SELECT s AS id FROM S UNION SELECT o FROM S) SELECT 'v' AS kind, id FROM (SELECT id FROM N ORDER BY id LIMIT 12) UNION ALL SELECT 'e', p FROM (SELECT DISTINCT p FROM S)")
def _(spark, sf_dir):
    g = _stored(spark).put_batch(_small(spark, sf_dir))
    return _frame(spark, [("v", r["id"]) for r in g.scan(12)["result"]] + [("e", r["id"]) for r in g.scan(12, "e")["result"]], "kind string, id string")


@query("q53d_triples", f"WITH {S} SELECT s, p, o FROM S")
def _(spark, sf_dir):
    g = _stored(spark).put_batch(_small(spark, sf_dir))
    assert g.triples() == list(export.get_triples(g))
    return _frame(spark, g.triples(), "s string, p string, o string")


@query("q53e_stats", f"WITH {E}, N AS (SELECT s AS id FROM E UNION SELECT o FROM E) SELECT (SELECT count(*) FROM N) AS nodes, (SELECT count(*) FROM E) AS edges, (SELECT count(DISTINCT p) FROM E) AS predicates")
def _(spark, sf_dir):
    found = graph(spark, sf_dir).stats()
    return _frame(spark, [(found["nodes"], found["edges"], found["predicates"])], "nodes long, edges long, predicates long")


@query("q53f_first_and_count", f"WITH {E} SELECT min(o) AS first, max(o) AS last, count(*) AS n FROM E WHERE p = 'in_nation'")
def _(spark, sf_dir):
    g = graph(spark, sf_dir)
    rows = [(g.v().out("in_nation").order().first()["id"], g.v().out("in_nation").order("desc").one()["id"], g.v().out("in_nation").count())]
    return _frame(spark, rows, "first string, last string, n long")


@query("q53g_deep_page", f"WITH {E} SELECT id, source FROM (SELECT o AS id, s AS source FROM E WHERE p = 'contains' ORDER BY o, s LIMIT 200 OFFSET 1000)")
def _(spark, sf_dir):
    return graph(spark, sf_dir).v().tag("source").out("contains").skip(1000).limit(200).df().select("id", F.col("tags")["source"].alias("source"))


@query("q53h_rest_after_skip", f"WITH {E} SELECT id FROM (SELECT o AS id, s FROM E WHERE p = 'brand' ORDER BY o DESC, s OFFSET 50)")
def _(spark, sf_dir):
    return graph(spark, sf_dir).v().out("brand").order("desc").skip(50).df().select("id")


# searches
@query(
    "q54_bfs_tags_and_paths",
    f"""WITH RECURSIVE {E}, D AS (SELECT s, o FROM E WHERE p = 'child_of'),
 R AS (SELECT 'part:3' AS id, 'part:3' AS path, 0 AS depth UNION ALL SELECT D.s, R.path || '>child_of>' || D.s, depth + 1 FROM R JOIN D ON D.o = R.id WHERE depth < 3)
 SELECT id, 'part:3' AS origin, path FROM R WHERE depth > 0""",
)
def _(spark, sf_dir):
    found = graph(spark, sf_dir).v("part:3").tag("origin").bfs("child_of", max_depth=3, direction="inc").df()
    return found.select("id", F.col("tags")["origin"].alias("origin"), F.concat_ws(">", "path").alias("path"))


@query(
    "q54b_bfs_repeated_starts",
    f"""WITH RECURSIVE {E}, D AS (SELECT s, o FROM E WHERE p = 'child_of'), R AS (SELECT unnest(['part:2', 'part:5']) AS id UNION SELECT D.s FROM R JOIN D ON D.o = R.id)
 SELECT id FROM R WHERE id NOT IN ('part:2', 'part:5')""",
)
def _(spark, sf_dir):
    return graph(spark, sf_dir).v(["part:2", "part:5", "part:2"]).bfs("child_of", direction="inc").df().select("id")


@query(
    "q54c_until_function",
    f"WITH RECURSIVE {E}, D AS (SELECT s, o FROM E WHERE p = 'child_of'), R AS (SELECT 'part:1' AS id UNION SELECT D.s FROM R JOIN D ON D.o = R.id WHERE NOT R.id LIKE '%7') SELECT id FROM R WHERE id LIKE '%7'",
)
def _(spark, sf_dir):
    return graph(spark, sf_dir).v("part:1").bfs("child_of", direction="inc", min_depth=0, until=lambda x: x.endswith("7")).filter(lambda x: x.endswith("7")).df().select("id")


@query(
    "q54d_dfs_with_cross_edges",
    f"""WITH RECURSIVE {K}, A AS (SELECT s, list(o ORDER BY p, o) AS near FROM K WHERE p IN ('follows', 'likes') GROUP BY s),
 W AS (SELECT 0 AS step, [{{'id': 'hub/catalog', 'd': 0}}] AS stack, ['hub/catalog'] AS seen, NULL::VARCHAR AS id, 0 AS depth
  UNION ALL SELECT step + 1, list_concat(stack[:-2], list_transform(news, lambda x: {{'id': x, 'd': d + 1}})), list_concat(seen, news), top, d FROM (
   SELECT step, stack, seen, stack[-1].id AS top, stack[-1].d AS d,
    CASE WHEN stack[-1].d < 3 AND near IS NOT NULL THEN list_filter(near, lambda x, i: NOT list_contains(seen, x) AND list_position(near, x) = i) ELSE [] END AS news
   FROM W LEFT JOIN A ON A.s = stack[-1].id WHERE len(stack) > 0))
 SELECT id FROM W WHERE id IS NOT NULL AND depth > 0""",
)
def _(spark, sf_dir):
    return kept(spark, sf_dir).v("hub/catalog").dfs(["follows", "likes"], max_depth=3).df().select("id")


# vectors
@query("q55_stored_vectors", "SELECT concat('part:', vec_id) AS id, unnest(range(1, len(embedding) + 1))::INTEGER AS at, round(unnest(embedding)::DOUBLE, 5) + 0.0 AS x FROM embeddings WHERE vec_id <> 3")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.col("embedding").alias("vec"))
    g = _stored(spark).put_embeddings_batch(e).compact()
    g.put_embedding("part:3", [1.0]).delete_embedding("part:3")
    assert g.get_embedding("part:3") is None and len(g.get_embedding("part:4")) == 64
    return g.tables.embeddings.select("id", F.posexplode("vec").alias("at", "x")).select("id", (F.col("at") + 1).alias("at"), (F.round("x", 5) + 0.0).alias("x"))


@query("q55b_vectorize", f"WITH {K}, N AS (SELECT s AS id FROM K UNION SELECT o FROM K) SELECT id, 64 AS dimensions, id = '' AS zero FROM N")
def _(spark, sf_dir):
    """All vertices of a stored graph embedded by the offline provider; unit vectors, but for the empty text."""
    g = _stored(spark).put_batch(kept(spark, sf_dir).triples_df())
    done = g.vectorize()
    again = g.vectorize(provider="hashing")
    assert done["vectorized"] == done["total"] == again["skipped"] and again["vectorized"] == 0
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    return g.tables.embeddings.select("id", F.size("vec").alias("dimensions"), (F.abs(norm - 1) > 1e-9).alias("zero"))


@query("q55c_scan_and_stats", "SELECT count(*) AS count, max(len(embedding))::INTEGER AS dimensions, 10 AS scanned FROM embeddings")
def _(spark, sf_dir):
    g = graph(spark, sf_dir)
    stats = g.embedding_stats()
    return _frame(spark, [(stats["count"], stats["dimensions"], len(g.scan_embeddings(10)["result"]))], "count long, dimensions int, scanned int")


@query("q55d_sim_strict", "SELECT concat('part:', vec_id) AS id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) >= 0.1")
def _(spark, sf_dir):
    return vectors.sim(vectors.everything(graph(spark, sf_dir).tables), "part:7", ">=", 0.1, strict=True).df().select("id")


# key-value stores
def _store(spark: SparkSession, sf_dir: str) -> KeyValueStore:
    kv = KeyValueStore(spark, Config.of(home=shared_path(spark, "kv"))).use_table("records")
    return kv.append(kv_records(spark, sf_dir).drop("tbl"))


@query("q56_kv_items", _KV + """SELECT key, kind, CASE WHEN kind = 'l' THEN n ELSE d END AS n, CASE WHEN kind = 'l' THEN newest ELSE oldest END AS head FROM A
UNION ALL SELECT key, 's', 1, max_by(v, seq) FROM S WHERE t = 's' AND key NOT IN (SELECT key FROM A) GROUP BY key""")
def _(spark, sf_dir):
    """The records written to a store, compacted, and read back."""
    items = _store(spark, sf_dir).compact().items()
    head = F.when(F.col("kind") == "l", F.max_by("value", "seq")).otherwise(F.min_by("value", "seq"))
    return items.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), head.alias("head"))


@query("q56b_kv_get", """WITH R AS (SELECT DISTINCT store_position AS seq, value_type AS t, coalesce(rec_value, '') AS v FROM kv_records WHERE rec_key = 'hub/catalog' AND value_type IS NOT NULL),
S AS (SELECT coalesce(max(seq), -1) AS since FROM R WHERE t = 's')
SELECT row_number() OVER (ORDER BY seq DESC) - 1 AS at, v AS value FROM R, S WHERE t <> 's' AND seq > since""")
def _(spark, sf_dir):
    """A list, newest first, by point lookup."""
    kv = _store(spark, sf_dir)
    held = kv.get("hub/catalog")
    assert kv.head("hub/catalog") == ("l", held[0])
    return _frame(spark, enumerate(held), "at long, value string")


@query("q56c_kv_scanner", "SELECT n_name AS key, r_name AS value FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 3")
def _(spark, sf_dir):
    names = {r.r_regionkey: r.r_name for r in table(spark, sf_dir, "region").collect()}
    kv = KeyValueStore(spark, Config.of(home=shared_path(spark, "kv"), flush_rows=10, compact_files=2)).use_table("nations")
    nation = table(spark, sf_dir, "nation").collect()
    for r in nation:
        kv.put(r.n_name, "old").put(r.n_name, names[r.n_regionkey])
    kv.delete(next(r.n_name for r in nation if r.n_nationkey == 3))
    assert kv.list_tables() == ["nations"] and sorted(kv.scanner(lambda key: key)) == sorted(k for k, _ in kv.scanner())
    return _frame(spark, kv.scanner(), "key string, value string")


# files
def _quoted(c: str) -> F.Column:
    text = F.col(c)
    for mark in ("\\", '"'):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return F.concat(F.lit('"'), text, F.lit('"'))


_TRIM = "trim({}, E' \\t\\n\\r')"


@query("q47_load_triples", f"WITH {K} SELECT DISTINCT {_TRIM.format('s')} AS s, {_TRIM.format('p')} AS p, {_TRIM.format('o')} AS o FROM K")
def _(spark, sf_dir):
    """Every triple written with all terms quoted, blanks and marks in them included, and read back."""
    path = shared_path(spark, "nt")
    kept(spark, sf_dir).triples_df().select(F.concat_ws(" ", _quoted("s"), _quoted("p"), _quoted("o"), F.lit(".")).alias("value")).write.text(path)
    return read_triples(spark, path).distinct()


@query("q47b_load_tagged", "SELECT DISTINCT concat('nation:', n_nationkey) AS s, concat('http://x/y#', n_regionkey) AS p, n_name || '@en' AS o FROM nation UNION ALL SELECT concat('region:', r_regionkey), 'size', r_regionkey::VARCHAR || '^^<int>' FROM region")
def _(spark, sf_dir):
    """Tagged and typed literals keep their tags, as shell words do."""
    path = shared_path(spark, "nt")
    tagged = table(spark, sf_dir, "nation").select(F.format_string('nation:%s http://x/y#%s "%s"@en .', "n_nationkey", "n_regionkey", "n_name").alias("value"))
    typed = table(spark, sf_dir, "region").select(F.format_string('\tregion:%s size "%s"^^<int>.', "r_regionkey", "r_regionkey").alias("value"))
    tagged.unionByName(typed.select(F.regexp_replace("value", r"\.$", " .").alias("value"))).write.text(path)
    return read_triples(spark, path)


@query("q48_load_edgelist", f"WITH {K} SELECT s, 'knows' AS p, o FROM K WHERE p = 'follows' AND s <> '' AND o <> '' AND NOT regexp_matches(s || o, '\\s')")
def _(spark, sf_dir):
    """Lines begin and end with tabs; the format can't hold terms with blanks."""
    path = shared_path(spark, "edges")
    rows = kept(spark, sf_dir).triples_df().where(r"p = 'follows' and s <> '' and o <> '' and not (concat(s, o) rlike '\\s')")
    rows.select(F.concat(F.lit("\t"), F.col("s"), F.lit(" \t"), F.col("o"), F.lit("\t")).alias("value")).write.text(path)
    return read_edgelist(spark, path, "knows")


def _round_trip(name: str, sep: str):
    @query(name, f"WITH {K} SELECT s, p, o FROM K")
    def _(spark, sf_dir):
        path = shared_path(spark, "export")
        kept(spark, sf_dir).export_folder(path, name.rsplit("_", 1)[1])
        back = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
        return back.fillna("").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))


_round_trip("q57_export_csv", ",")
_round_trip("q57b_export_tsv", "\t")


# the service
@query("q58_remote", f"WITH {S} SELECT o AS id, s AS start FROM S WHERE p = 'name' AND s IN (SELECT s FROM S WHERE o = 'region:1')")
def _(spark, sf_dir):
    """A served graph asked and changed over HTTP."""
    g = _stored(spark, "served").put_batch(_small(spark, sf_dir)).serve(port=0, writable=True)
    try:
        remote = Graph.connect(f"http://127.0.0.1:{g.port}/served")
        remote.put("x", "in_region", "region:1").delete("x", "in_region", "region:1")
        rows = remote.v("region:1").inc("in_region").tag("start").out("name").all()["result"]
        assert remote.stats()["edges"] == g.stats()["edges"]
    finally:
        g.stop()
    return _frame(spark, ((r["id"], r["start"]) for r in rows), "id string, start string")


@query("q58b_parsed_conditions", f"WITH {K} SELECT o AS id FROM K WHERE p = 'score' AND (TRY_CAST(o AS DOUBLE) > 4.5 OR o = '2')")
def _(spark, sf_dir):
    """A query text with a condition; it is parsed into an expression, never evaluated."""
    from trigraph.server import parse_query

    g = kept(spark, sf_dir)
    for name, args, options in parse_query("v().out('score').filter(lambda x: float(x) > 4.5 or x == '2')"):
        g = getattr(g, name)(*args, **options)
    return g.df().select("id")
