"""Queries of the graph operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph import export
from trigraph.functions.lineage import shared_path
from trigraph.graph import Graph
from trigraph.operators import mutation, recursive, vectors
from trigraph.operators.traversal import DESC, Traversal
from trigraph.plans.triples import EDGES, graph, kept, table
from trigraph.sources.documents import document_triples, flat_json_triples
from trigraph.sources.files import read_csv, read_word_vectors, unpivot

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = f"E AS ({EDGES})"
K = "K AS (SELECT DISTINCT s, p, o FROM triples WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL)"
N = "N AS (SELECT s AS id FROM E UNION SELECT o FROM E)"
V = "V AS (SELECT concat('part:', vec_id) AS id, embedding::DOUBLE[] AS vec FROM embeddings)"
#: Edge changes in order, made of the events.
OPS = """L AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'R' WHEN 'error' THEN 'D' ELSE 'P' END AS op,
  concat('user:', user_id) AS s, concat('day:', CAST(event_id % 3 AS VARCHAR)) AS p, concat('k:', CAST(user_id * 7 % 5 + event_id % 4 AS VARCHAR)) AS o FROM events)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def traverse(name: str, sql: str, chain: Callable[[Traversal], Traversal], start=None, track: bool = True, kept_triples: bool = False, **columns):
    """A query by a chain from ``v(start)``; ``columns`` are the expressions selected, by default the id."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = (kept if kept_triples else graph)(spark, sf_dir)
        t = chain(Traversal.start(g.tables, start, None, track))
        return t.df().selectExpr(*(f"{c} AS {n}" for n, c in (columns or {"id": "id"}).items()))

    QUERIES[name], SQL[name] = run, f"WITH {K if kept_triples else E}{sql}"


# scans and hops
traverse("q01_scan_nodes", f", {N} SELECT id FROM N", lambda t: t)
traverse("q02_out", " SELECT o AS id FROM E WHERE s = 'order:1' AND p = 'contains'", lambda t: t.out("contains"), "order:1")
traverse("q03_out_all_predicates", " SELECT o AS id FROM E WHERE s = 'customer:1'", lambda t: t.out(), "customer:1")
traverse(
    "q04_three_hop_bag",
    """ SELECT c.o AS id FROM E a JOIN E b ON a.o = b.s AND b.p = 'in_nation' JOIN E c ON b.o = c.s AND c.p = 'in_region'
 WHERE a.p = 'placed_by' AND c.o = 'region:1'""",
    lambda t: t.out("placed_by").out("in_nation").out("in_region").is_("region:1"),
)
traverse(
    "q05_three_hop_set",
    """ SELECT DISTINCT c.o AS id FROM E a JOIN E b ON a.o = b.s AND b.p = 'in_nation' JOIN E c ON b.o = c.s AND c.p = 'in_region' WHERE a.p = 'placed_by'""",
    lambda t: t.out("placed_by").out("in_nation").out("in_region"),
    track=False,
)
traverse("q06_inc", " SELECT b.s AS id FROM E a JOIN E b ON a.s = b.o AND b.p = 'in_nation' WHERE a.o = 'region:1' AND a.p = 'in_region'", lambda t: t.inc("in_region").inc("in_nation"), "region:1")
traverse("q07_both", " SELECT o AS id FROM E WHERE s = 'nation:3' UNION ALL SELECT s FROM E WHERE o = 'nation:3'", lambda t: t.both(), "nation:3")
traverse("q07b_both_set", " SELECT o AS id FROM E WHERE s = 'part:40' UNION SELECT s FROM E WHERE o = 'part:40'", lambda t: t.both(), "part:40", False)
traverse("q08_has", " SELECT s AS id FROM E WHERE p = 'segment' AND o = 'BUILDING'", lambda t: t.has("segment", "BUILDING"))
traverse("q09_has_multi_predicate", " SELECT s AS id FROM E WHERE p IN ('contains', 'supplied_by', 'status') AND o IN ('F')", lambda t: t.has(["contains", "supplied_by", "status"], "F"))
traverse("q10_hasr", " SELECT o AS id FROM E WHERE p = 'in_nation' AND s = 'customer:1'", lambda t: t.hasr("in_nation", "customer:1"))
traverse(
    "q10b_has_after_hop",
    " SELECT a.o AS id FROM E a WHERE a.p = 'placed_by' AND EXISTS (SELECT 1 FROM E b WHERE b.s = a.o AND b.p = 'segment' AND b.o = 'MACHINERY')",
    lambda t: t.out("placed_by").has("segment", "MACHINERY"),
)
traverse("q11_filter_text", f", {N} SELECT id FROM N WHERE starts_with(id, 'nation:1')", lambda t: t.filter(F.col("id").startswith("nation:1")))
traverse("q11b_filter_number", " SELECT o AS id FROM K WHERE p = 'score' AND TRY_CAST(o AS DOUBLE) > 4.0", lambda t: t.out("score").filter(F.col("id").try_cast("double") > 4.0), kept_triples=True)
traverse("q11c_filter_function", " SELECT o AS id FROM E WHERE p = 'in_region' AND o LIKE '%1'", lambda t: t.out("in_region").filter(lambda x: x.endswith("1")))
traverse("q11d_hop_filter", " SELECT o AS id FROM E WHERE p = 'brand' AND o LIKE '%2'", lambda t: t.out("brand", func=lambda x: x.endswith("2")))
traverse("q12_unique", " SELECT DISTINCT o AS id FROM E WHERE p = 'segment'", lambda t: t.out("segment").unique())
traverse(
    "q13_order_limit_skip",
    " SELECT id FROM (SELECT DISTINCT o AS id FROM E WHERE p = 'brand' ORDER BY id DESC LIMIT 5 OFFSET 2)",
    lambda t: t.out("brand").unique().order(DESC).skip(2).limit(5),
)
traverse("q13b_pages", " SELECT id FROM (SELECT o AS id, s FROM E WHERE p = 'in_region' ORDER BY id, s LIMIT 7 OFFSET 3)", lambda t: t.out("in_region").skip(3).limit(7))
traverse("q13c_repeated_predicate", " SELECT o AS id FROM E, range(2) WHERE s = 'nation:2' AND p = 'in_region'", lambda t: t.out(["in_region", "in_region"]), "nation:2")
traverse("q13d_unknown_predicate", " SELECT o AS id FROM E WHERE p = 'nothing'", lambda t: t.out("nothing"))
traverse("q13e_literal_starts", " SELECT o AS id FROM E, (SELECT unnest(['nation:1', 'nation:1', 'nowhere']) AS v) WHERE s = v", lambda t: t.out(), ["nation:1", "nation:1", "nowhere"])
traverse("q13f_is", " SELECT o AS id FROM E WHERE p = 'in_nation' AND o IN ('nation:1', 'nation:2')", lambda t: t.out("in_nation").is_("nation:1", "nation:2"))


@query("q14_count", f"WITH {E} SELECT count(*) AS count FROM E WHERE p = 'contains'")
def _(spark, sf_dir):
    return Traversal.start(graph(spark, sf_dir).tables).out("contains").count_df()


# tags and paths
traverse(
    "q15_tag",
    " SELECT a.s AS src, a.o AS mid, b.o AS id FROM E a JOIN E b ON a.o = b.s AND b.p = 'in_region' WHERE a.p = 'in_nation'",
    lambda t: t.tag("a").out("in_nation").tag("b").out("in_region"),
    src="tags['a']",
    mid="tags['b']",
    id="id",
)
traverse(
    "q16_back",
    " SELECT a.s AS id FROM E a WHERE a.p = 'placed_by' AND EXISTS (SELECT 1 FROM E b WHERE b.s = a.o AND b.p = 'in_nation' AND b.o = 'nation:7')",
    lambda t: t.tag("order").out("placed_by").has("in_nation", "nation:7").back("order"),
)
traverse("q16b_tag_again", " SELECT b.s AS x, b.o AS id FROM E a JOIN E b ON a.o = b.s AND b.p = 'in_region' WHERE a.p = 'in_nation'", lambda t: t.tag("x").out("in_nation").tag("x").out("in_region"), x="tags['x']", id="id")
traverse("q17_edges", " SELECT o AS id, p AS edge FROM E WHERE s = 'order:3'", lambda t: t.out(), "order:3", id="id", edge="edges[0]")
traverse(
    "q17b_paths",
    " SELECT a.s || '>' || a.p || '>' || a.o || '>' || b.p || '>' || b.o AS path FROM E a JOIN E b ON a.o = b.s AND b.p = 'in_region' WHERE a.p = 'in_nation' AND a.s LIKE 'supplier:%'",
    lambda t: t.filter(F.col("id").startswith("supplier:")).out("in_nation").out("in_region"),
    path="concat_ws('>', path)",
)


@query("q18_graph_links", f"WITH {E} SELECT s AS source, p AS label, o AS target FROM E WHERE p IN ('in_nation', 'in_region') AND (p = 'in_nation' AND s LIKE 'supplier:%' OR p = 'in_region' AND s IN (SELECT o FROM E WHERE p = 'in_nation' AND s LIKE 'supplier:%'))")
def _(spark, sf_dir):
    t = Traversal.start(graph(spark, sf_dir).tables).filter(F.col("id").startswith("supplier:"))
    return t.out("in_nation").out("in_region").graph_links()


@query("q19_graph_nodes", f"WITH {E} SELECT 'region:2' AS id UNION SELECT s FROM E WHERE p = 'in_region' AND o = 'region:2' UNION SELECT a.s FROM E a JOIN E b ON a.o = b.s WHERE a.p = 'in_nation' AND b.p = 'in_region' AND b.o = 'region:2'")
def _(spark, sf_dir):
    return Traversal.start(graph(spark, sf_dir).tables, "region:2").inc("in_region").inc("in_nation").graph_nodes()


# searches
def search(name: str, sql: str, start, find=recursive.bfs, kept_triples: bool = False, track: bool = True, depth: bool = False, **options):
    @query(name, f"WITH RECURSIVE {K if kept_triples else E}{sql}")
    def _(spark, sf_dir):
        g = (kept if kept_triples else graph)(spark, sf_dir)
        stop = {"until": F.expr(options["until"])} if "until" in options else {}
        found = find(Traversal.start(g.tables, start, None, track), **options | stop, **({"depth_column": True} if depth else {}))
        return found.rows.select("id", *(["depth"] if depth else []))


_DOWN = ", D AS (SELECT s, o FROM E WHERE p = 'child_of'), R AS (SELECT 'part:1' AS id, 0 AS depth UNION SELECT D.s, depth + 1 FROM R JOIN D ON D.o = R.id{})"
search("q20_bfs_depth", _DOWN.format(" WHERE depth < 4") + " SELECT id, depth FROM R WHERE depth > 0", "part:1", predicates="child_of", max_depth=4, direction="inc", depth=True)
search("q21_bfs_min_depth", _DOWN.format(" WHERE depth < 5") + " SELECT id FROM R WHERE depth >= 3", "part:1", predicates="child_of", min_depth=3, max_depth=5, direction="inc")
search(
    "q22_bfs_both",
    """, D AS (SELECT s AS a, o AS b FROM E WHERE p IN ('in_nation', 'in_region') UNION SELECT o, s FROM E WHERE p IN ('in_nation', 'in_region')),
 R AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT D.b, depth + 1 FROM R JOIN D ON D.a = R.id WHERE depth < 2) SELECT DISTINCT id FROM R WHERE id <> 'region:1'""",
    "region:1",
    predicates=["in_nation", "in_region"],
    direction="both",
    max_depth=2,
)
search(
    "q23_bfs_until",
    ", D AS (SELECT s, o FROM E WHERE p = 'child_of'), R AS (SELECT 'part:1' AS id UNION SELECT D.s FROM R JOIN D ON D.o = R.id WHERE NOT R.id LIKE '%5') SELECT id FROM R WHERE id <> 'part:1'",
    "part:1",
    predicates="child_of",
    direction="inc",
    until="endswith(id, '5')",
)
search(
    "q24_bfs_walks",
    ", D AS (SELECT s, o FROM E WHERE p IN ('in_region', 'in_nation')), R AS (SELECT 'region:3' AS id, 0 AS depth UNION ALL SELECT D.s, depth + 1 FROM R JOIN D ON D.o = R.id WHERE depth < 3) SELECT id FROM R WHERE depth > 0",
    "region:3",
    predicates=["in_region", "in_nation"],
    direction="inc",
    unique=False,
    max_depth=3,
)
search("q25_dfs_unbounded", _DOWN.format("") + " SELECT id FROM R WHERE depth > 0", "part:1", recursive.dfs, predicates="child_of", direction="inc")
search("q25b_bfs_set", _DOWN.format("") + " SELECT id FROM R WHERE depth > 0", "part:1", predicates="child_of", direction="inc", track=False)
search("q25c_dfs_depth", _DOWN.format(" WHERE depth < 3") + " SELECT id FROM R WHERE depth > 0", "part:1", recursive.dfs, predicates="child_of", direction="inc", max_depth=3)
search(
    "q25d_bfs_hubs",
    """, R AS (SELECT 'hub/catalog' AS id, 0 AS depth UNION SELECT K.o, depth + 1 FROM R JOIN K ON K.s = R.id AND K.p IN ('follows', 'likes') WHERE depth < 3)
 SELECT id, min(depth) AS depth FROM R WHERE id <> 'hub/catalog' GROUP BY id""",
    "hub/catalog",
    kept_triples=True,
    track=False,
    depth=True,
    predicates=["follows", "likes"],
    max_depth=3,
)
traverse(
    "q25e_hub_two_hops",
    " SELECT DISTINCT b.o AS id FROM K a JOIN K b ON a.o = b.s AND b.p = 'tagged' WHERE a.p = 'follows'",
    lambda t: t.out("follows").out("tagged"),
    track=False,
    kept_triples=True,
)

# vectors
_SIM = "list_cosine_similarity(V.vec, (SELECT vec FROM V WHERE id = 'part:7'))"


def similar(name: str, where: str, operator: str, threshold, source: str = "SELECT id FROM V", chain=None):
    @query(name, f"WITH {E}, {V}, X AS ({source}), S AS (SELECT X.id, coalesce({_SIM}, 0.0) AS sim FROM X LEFT JOIN V ON V.id = X.id) SELECT id FROM S WHERE {where}")
    def _(spark, sf_dir):
        g = graph(spark, sf_dir)
        start = vectors.everything(g.tables) if chain is None else chain(Traversal.start(g.tables))
        return vectors.sim(start, "part:7", operator, threshold).rows.select("id")


similar("q26_sim_gt", "sim > 0.2", ">", 0.2)
similar("q27_sim_in", "sim BETWEEN -0.1 AND 0.1", "in", [-0.1, 0.1])
similar("q28_sim_missing_zero", "sim <= 0.05", "<=", 0.05, "SELECT s AS id FROM E WHERE p = 'brand'", lambda t: t.filter(F.col("id").startswith("part:")).out("brand").inc("brand").unique())
similar("q28b_sim_equal", "abs(sim - 1) <= 1e-9", "=", 1.0)


@query("q29_k_nearest", f"WITH {V} SELECT id, round({_SIM}, 5) AS similarity FROM V ORDER BY {_SIM} DESC, id LIMIT 10")
def _(spark, sf_dir):
    t = vectors.k_nearest(vectors.everything(graph(spark, sf_dir).tables), "part:7", 10, True)
    return t.rows.select("id", F.round("similarity", 5).alias("similarity"))


@query("q30_k_nearest_scoped", f"WITH {E}, {V} SELECT V.id FROM V JOIN E ON E.s = V.id AND E.p = 'child_of' AND E.o IN (SELECT s FROM E WHERE p = 'child_of') ORDER BY {_SIM} DESC, V.id LIMIT 8")
def _(spark, sf_dir):
    t = Traversal.start(graph(spark, sf_dir).tables).tag("x").out("child_of").out("child_of").back("x")
    return vectors.k_nearest(t, "part:7", 8).rows.select("id")


@query("q31_embedding_stats", "SELECT count(*) AS count, max(len(embedding))::INTEGER AS dimensions FROM embeddings")
def _(spark, sf_dir):
    return vectors.embedding_stats(graph(spark, sf_dir).tables)


@query("q32_scan_embeddings", f"WITH {E}, {V}, {N} SELECT id FROM N WHERE id IN (SELECT id FROM V) ORDER BY id LIMIT 100")
def _(spark, sf_dir):
    return vectors.scan_embeddings(graph(spark, sf_dir).tables, 100)


# exports, sources
@query("q33_triples", f"WITH {K} SELECT s, p, o FROM K")
def _(spark, sf_dir):
    return kept(spark, sf_dir).triples_df()


@query("q34_predicates", f"WITH {E} SELECT DISTINCT p FROM E")
def _(spark, sf_dir):
    return graph(spark, sf_dir).tables.predicates


@query("q34b_scan_first_nodes", f"WITH {K}, N AS (SELECT s AS id FROM K UNION SELECT o FROM K) SELECT id FROM N ORDER BY id LIMIT 25")
def _(spark, sf_dir):
    return kept(spark, sf_dir).tables.nodes.orderBy("id").limit(25)


_PART = ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")
_BOOKS = """book_id goodreads_book_id best_book_id work_id books_count isbn isbn13 authors original_publication_year original_title title language_code average_rating
 ratings_count work_ratings_count work_text_reviews_count ratings_1 ratings_2 ratings_3 ratings_4 ratings_5 image_url small_image_url loaded_at""".split()
_DOUBLES = ("p_retailprice", "isbn13", "original_publication_year", "average_rating")


def _plain(df: DataFrame) -> DataFrame:
    """Numbers and times in the form that the checking engine writes too."""
    forms = {"double": lambda c: F.col(c).try_cast("decimal(20,4)"), "timestamp_ntz": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")}
    return df.select(*(forms[t](c).alias(c) if t in forms else F.col(c) for c, t in df.dtypes))


def _cells(columns, ident: str, source: str) -> str:
    form = lambda c: f"TRY_CAST({c} AS DECIMAL(20,4))::VARCHAR" if c in _DOUBLES else f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c == "loaded_at" else f"{c}::VARCHAR"
    return " UNION ALL ".join(f"SELECT coalesce({ident}::VARCHAR, '') AS s, '{c}' AS p, coalesce({form(c)}, '') AS o FROM {source}" for c in columns)


@query("q35_csv_unpivot", _cells(_PART, "p_partkey", "part"))
def _(spark, sf_dir):
    return unpivot(_plain(table(spark, sf_dir, "part")), "p_partkey")


@query("q35b_books_unpivot", _cells(_BOOKS, "book_id", "books"))
def _(spark, sf_dir):
    return unpivot(_plain(table(spark, sf_dir, "books")), "book_id")


@query("q36_json_triples", "SELECT concat('event:', event_id) AS s, unnest(json_keys(props)) AS p, json_extract_string(props, '$.k') AS o FROM events")
def _(spark, sf_dir):
    return flat_json_triples(table(spark, sf_dir, "events"), F.concat(F.lit("event:"), "event_id"), "props")


@query("q36b_document_triples", """SELECT concat('_:_id_', event_id) AS s, p, o FROM (
 SELECT event_id, '_id' AS p, event_id::VARCHAR AS o FROM events
 UNION ALL SELECT event_id, 'type', event_type FROM events WHERE event_type IS NOT NULL
 UNION ALL SELECT event_id, 'props', concat('_:_id_p', event_id) FROM events
) UNION ALL SELECT concat('_:_id_p', event_id), '_id', concat('p', event_id) FROM events""")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    doc = F.to_json(F.struct(F.col("event_id").alias("_id"), F.col("event_type").alias("type"), F.struct(F.concat(F.lit("p"), "event_id").alias("_id")).alias("props")))
    return document_triples(e.select("event_id", doc.alias("doc")), "event_id", "doc").select("s", "p", "o")


# changes
def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "signup", "R").when(F.col("event_type") == "error", "D").otherwise("P")
    i = F.col("event_id")
    return e.select(i.alias("seq"), op.alias("op"), F.concat(F.lit("user:"), "user_id").alias("s"), F.concat(F.lit("day:"), i % 3).alias("p"), F.concat(F.lit("k:"), F.col("user_id") * 7 % 5 + i % 4).alias("o"))


_LIVE = """, W AS (SELECT *, max(CASE WHEN op = 'R' THEN seq END) OVER (PARTITION BY s, p) AS since, row_number() OVER (PARTITION BY s, p, o ORDER BY seq DESC) AS k FROM L)
 SELECT s, p, o FROM W WHERE k = 1 AND op <> 'D' AND (since IS NULL OR seq >= since)"""


@query("q37_update_replace", f"WITH {OPS}{_LIVE}")
def _(spark, sf_dir):
    return mutation.live_edges(_log(spark, sf_dir))


@query("q38_delete", f"WITH {OPS}, L2 AS (SELECT * FROM L WHERE op <> 'R'){_LIVE.replace('FROM L)', 'FROM L2)')}")
def _(spark, sf_dir):
    return mutation.live_edges(_log(spark, sf_dir).where("op <> 'R'"))


@query("q39_update_then_nodes", f"WITH {OPS} SELECT s AS id FROM L WHERE op <> 'D' UNION SELECT o FROM L WHERE op <> 'D'")
def _(spark, sf_dir):
    return mutation.ever_nodes(_log(spark, sf_dir))


@query("q39b_update_then_predicates", f"WITH {OPS} SELECT DISTINCT p FROM L WHERE op <> 'D'")
def _(spark, sf_dir):
    return mutation.ever_predicates(_log(spark, sf_dir))


@query("q39c_stored_updates", f"WITH {OPS}{_LIVE}")
def _(spark, sf_dir):
    """The same changes through a graph's storage: written, compacted, and read as files."""
    g = Graph(spark, "updates", home=shared_path(spark, "graphs"))
    ops = _log(spark, sf_dir).orderBy("seq").select("op", "s", "p", "o")
    g._stored().append("edges", ops)
    return g.compact().triples_df()


@query("q39d_embedding_updates", "SELECT id, unnest(range(len(vec)))::INTEGER AS at, unnest(vec) AS x FROM (SELECT concat('label:', label) AS id, max_by(embedding, vec_id)::DOUBLE[] AS vec FROM embeddings GROUP BY label HAVING max(vec_id) % 2 = 0)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    log = e.select(F.col("vec_id").alias("seq"), F.when(F.col("vec_id") % 2 == 0, "P").otherwise("D").alias("op"), F.concat(F.lit("label:"), "label").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    return mutation.live_embeddings(log).select("id", F.posexplode("vec").alias("at", "x"))


_ESC = r"""replace(replace(replace(replace(o, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r')"""


@query("q40_nt_strict", f"""WITH {K} SELECT (CASE WHEN s LIKE '<%>' OR s LIKE '\\_:%' ESCAPE '\\' THEN s ELSE '<' || replace(replace(s, '\\', '\\\\'), '>', '%3E') || '>' END) || ' ' ||
 (CASE WHEN p LIKE '<%>' OR p LIKE '\\_:%' ESCAPE '\\' THEN p ELSE '<' || replace(replace(p, '\\', '\\\\'), '>', '%3E') || '>' END) || ' ' ||
 (CASE WHEN o LIKE '<%>' OR o LIKE '\\_:%' ESCAPE '\\' THEN o ELSE '"' || {_ESC} || '"' END) || ' .' AS value FROM K""")
def _(spark, sf_dir):
    return export.nt_lines(kept(spark, sf_dir).triples_df(), strict=True)


@query("q41_nt", f"WITH {K} SELECT s || ' ' || p || ' ' || o || ' .' AS value FROM K")
def _(spark, sf_dir):
    return export.nt_lines(kept(spark, sf_dir).triples_df())


# key-value layer: the record table replayed as the log of a store
def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "kv_records").where("rec_key is not null and value_type is not null").dropDuplicates(["store_position"])
    op = F.when(F.col("value_type") == "s", "P").when(F.col("value_type") == "l", "L").otherwise("U")
    return r.select(F.col("store_position").alias("seq"), op.alias("op"), F.lit("main").alias("tbl"), F.col("rec_key").alias("key"), F.coalesce("rec_value", F.lit("")).alias("value"))


_KV = """WITH R AS (SELECT DISTINCT store_position AS seq, rec_key AS key, value_type AS t, coalesce(rec_value, '') AS v FROM kv_records WHERE rec_key IS NOT NULL AND value_type IS NOT NULL),
S AS (SELECT *, max(CASE WHEN t = 's' THEN seq END) OVER (PARTITION BY key) AS since FROM R),
A AS (SELECT key, max_by(t, seq) AS kind, count(*) AS n, count(DISTINCT v) AS d, max_by(v, seq) AS newest, min_by(v, seq) AS oldest FROM S WHERE t <> 's' AND (since IS NULL OR seq > since) GROUP BY key)
"""


@query("q42_kv_values", _KV + """SELECT key, kind, CASE WHEN kind = 'l' THEN n ELSE d END AS n, CASE WHEN kind = 'l' THEN newest ELSE oldest END AS head FROM A
UNION ALL SELECT key, 's', 1, max_by(v, seq) FROM S WHERE t = 's' AND key NOT IN (SELECT key FROM A) GROUP BY key""")
def _(spark, sf_dir):
    items = mutation.live_items(_records(spark, sf_dir))
    newest, oldest = F.max_by("value", "seq"), F.min_by("value", "seq")
    return items.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"), F.when(F.col("kind") == "l", newest).otherwise(oldest).alias("head"))


@query("q43_kv_get", _KV + "SELECT key, kind, CASE WHEN kind = 'l' THEN n ELSE d END AS n FROM A WHERE key = 'user/0'")
def _(spark, sf_dir):
    items = mutation.live_items(_records(spark, sf_dir).where(F.col("key") == "user/0"))
    return items.where("kind <> 's'").groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("q44_stream_triples", "SELECT DISTINCT concat('user:', user_id) AS s, 'did' AS p, event_type AS o FROM events WHERE event_type IS NOT NULL")
def _(spark, sf_dir):
    """Events read as a stream and appended to a graph's log batch by batch."""
    from trigraph.streaming.sink import stream_triples

    g = Graph(spark, "streamed", home=shared_path(spark, "graphs"))
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.concat(F.lit("user:"), "user_id").alias("s"), F.lit("did").alias("p"), F.col("event_type").alias("o"))
    stream_triples(g, rows, shared_path(spark, "stream")).awaitTermination()
    return g.triples_df()


@query("q45_stats", f"WITH {E}, {N} SELECT (SELECT count(*) FROM N) AS nodes, (SELECT count(*) FROM E) AS edges, (SELECT count(DISTINCT p) FROM E) AS predicates")
def _(spark, sf_dir):
    t = graph(spark, sf_dir).tables
    parts = [df.select(F.lit(i).alias("i")) for i, df in enumerate((t.nodes, t.edges, t.predicates))]
    every = parts[0].unionAll(parts[1]).unionAll(parts[2])
    return every.agg(*(F.count_if(F.col("i") == i).alias(n) for i, n in enumerate(("nodes", "edges", "predicates"))))


# files: written from the tables into the shared folder and read back by the engine's readers
@query("q49_load_csv", _cells(_BOOKS, "book_id", "books"))
def _(spark, sf_dir):
    path = shared_path(spark, "csv")
    rows = _plain(table(spark, sf_dir, "books"))
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_csv(spark, path, "book_id")


@query("q50_load_word_vectors", "SELECT concat('part:', vec_id) AS id, unnest(range(len(embedding)))::INTEGER AS at, round(unnest(embedding)::DOUBLE, 4) + 0.0 AS x FROM embeddings")
def _(spark, sf_dir):
    path = shared_path(spark, "vectors")
    e = table(spark, sf_dir, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("part:"), "vec_id"), F.concat_ws(" ", F.transform("embedding", lambda x: x.cast("double").cast("string")))).alias("value")).write.text(path)
    return read_word_vectors(spark, path).select("id", F.posexplode("vec").alias("at", "x")).withColumn("x", F.round("x", 4) + 0.0)
