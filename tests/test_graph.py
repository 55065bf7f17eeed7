import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from trigraph.config import Config
from trigraph.functions.ranks import running_total
from trigraph.functions.skew import components, lookup
from trigraph.graph import Graph
from trigraph.kv import KeyValueStore
from trigraph.operators import mutation
from trigraph.schema import EDGE_LOG
from trigraph.sources import files
from trigraph.sources.documents import document_triples, is_id, triples_of
from trigraph.sources.providers import PROVIDERS, hashing, register
from trigraph.streaming.sink import stream_triples


@pytest.fixture
def g(spark, tmp_path):
    return Graph(spark, "g", home=str(tmp_path / "home"))


def names(g):
    return sorted(r["id"] for r in g.all()["result"])


def test_put_update_delete_reopen(spark, g):
    g.put("a", "p", "b").put("a", "p", "b").put("d", "p", "b").put("a", "p", "c", update=True)
    assert sorted(g.triples()) == [("a", "p", "c"), ("d", "p", "b")]
    g.update("a", "p", "x").delete("d", "p", "b")
    assert sorted(g.triples()) == [("a", "p", "x")]
    assert names(g.v()) == ["a", "b", "c", "d", "x"]
    again = g.get_new_graph_instance()
    assert again.triples() == [("a", "p", "x")]
    g.compact().put("a", "q", "y")
    assert sorted(g.triples()) == [("a", "p", "x"), ("a", "q", "y")] and names(g.v()) == ["a", "b", "c", "d", "x", "y"]
    assert g.scan(5, "e")["result"] == [{"id": "p"}, {"id": "q"}]
    assert g.stats() == {"name": "g", "nodes": 6, "edges": 2, "predicates": 2}
    g.truncate()
    assert g.triples() == [] and g.scan()["result"] == []
    with pytest.raises(AssertionError):
        g.put("a", "p", 3)
    with pytest.raises(DeprecationWarning):
        g.drop("a", "p", "b")
    g.drop()
    assert g.ls() == []


def test_namespaces_and_options(spark, g):
    g.put("a", "p", "b").use("other").put("x", "p", "y")
    assert g.ls() == ["g", "other"] and g.triples() == [("x", "p", "y")]
    assert g.use("g").triples() == [("a", "p", "b")]
    with pytest.raises(ValueError):
        Graph(spark, "z", colour="red")
    assert Config.of(home="h", prefix="/p").root == "/p/h"


def test_log_resolution_against_replay(spark):
    rng = random.Random(11)
    rows = [(i, rng.choice("PPPRD"), rng.choice("ab"), rng.choice("pq"), rng.choice("xyz")) for i in range(1, 200)]
    live = set()
    for _, op, s, p, o in rows:
        if op == "D":
            live.discard((s, p, o))
            continue
        if op == "R":
            live = {t for t in live if t[:2] != (s, p)}
        live.add((s, p, o))
    log = spark.createDataFrame(rows, EDGE_LOG)
    assert {tuple(r) for r in mutation.live_edges(log).collect()} == live
    assert mutation.live_edges(log.limit(0)).count() == 0


def test_small_puts_are_flushed_and_compacted(spark, tmp_path):
    g = Graph(spark, "g", home=str(tmp_path), flush_rows=3, compact_files=4)
    for i in range(20):
        g.put(f"s{i}", "p", "o")
    assert len(g.triples()) == 20 and len(g.store.manifest["edges"]) < 4


def test_changes_over_a_snapshot_against_replay(spark, tmp_path, monkeypatch):
    from trigraph import store

    rng = random.Random(5)
    g = Graph(spark, "g", home=str(tmp_path), flush_rows=0, compact_files=3)
    live, nodes, vecs = set(), set(), {}
    for step in range(5):
        monkeypatch.setattr(store, "TAIL_ROWS", 0 if step == 3 else 100_000)
        for _ in range(30):
            s, p, o, op = f"s{rng.randrange(5)}", rng.choice("pq"), f"o{rng.randrange(6)}", rng.choice("PPRD")
            if op == "D":
                g.delete(s, p, o)
                live.discard((s, p, o))
                continue
            if op == "R":
                live = {t for t in live if t[:2] != (s, p)}
            g.put(s, p, o, update=op == "R")
            live.add((s, p, o))
            nodes |= {s, o}
        word = f"w{step % 3}"
        if step == 2:
            g.delete_embedding("w0")
            vecs.pop("w0", None)
        g.put_embedding(word, [float(step)])
        vecs[word] = [float(step)]
        g.sync()
        if step == 0:
            g.compact().put_batch([(f"big{i}", "p", "x") for i in range(400)]).compact()
            live |= {(f"big{i}", "p", "x") for i in range(400)}
            nodes |= {f"big{i}" for i in range(400)} | {"x"}
            snapshot = g.store.manifest["snapshot"]
        assert set(g.triples()) == live and len(g.triples()) == len(live)
        assert sorted(r.id for r in g.tables.nodes.collect()) == sorted(nodes)
        assert sorted(r.p for r in g.tables.predicates.collect()) == ["p", "q"]
        assert {r.id: r.vec for r in g.tables.embeddings.collect()} == vecs
    assert g.store.manifest["snapshot"] == snapshot and len(g.store.manifest["edges"]) < 3
    assert set(Graph(spark, "g", home=str(tmp_path)).triples()) == live


def test_a_change_does_not_shuffle_the_snapshot(spark, tmp_path):
    g = Graph(spark, "g", home=str(tmp_path)).put_batch([(f"s{i}", "p", f"o{i}") for i in range(50)]).compact()
    g.put("s1", "p", "new", update=True).delete("s2", "p", "o2").put("s3", "q", "o3").sync()

    def above_snapshot(plan, above=()):
        """Names of the operators above each scan of the snapshot."""
        if plan.nodeName() == "AdaptiveSparkPlan":
            return above_snapshot(plan.initialPlan(), above)
        if plan.nodeName().startswith("Scan parquet"):
            return [above] if "snapshot" in plan.relation().location().rootPaths().mkString(",") else []
        children = plan.children()
        return [x for i in range(children.size()) for x in above_snapshot(children.apply(i), (*above, plan.nodeName()))]

    for df in (g.tables.edges, g.tables.nodes, g.tables.predicates):
        paths = above_snapshot(df._jdf.queryExecution().executedPlan())
        assert len(paths) == 1 and not any("Exchange" in name for name in paths[0])
    assert len(g.triples()) == 50


def test_memory_view_follows_changes(g):
    g.enable_memory_view().put("a", "p", "b")
    assert g.v("a").out().count() == 1
    g.put("a", "p", "c")
    assert g.v("a").out().count() == 2
    assert g.disable_memory_view().v("a").out().count() == 2


def test_json(spark, g):
    g.putj(json.dumps({"_id": "1", "name": "n", "age": 5, "ok": True, "none": None, "at": {"city": "c"}, "tags": ["x", "y", {"z": "w"}]}))
    assert names(g.v("_:_id_1").out("name")) == ["n"] and names(g.v("_:_id_1").out(["age", "ok", "_id"])) == ["1", "5", "true"]
    assert names(g.v("_:_id_1").out("at").out("city")) == ["c"]
    assert names(g.v("_:_id_1").out("tags").out("tags").out("z")) == ["w"] and g.v("_:_id_1").out("tags").out("tags").count() == 3
    g.updatej('{"_id": "1", "name": "m"}')
    assert names(g.v("_:_id_1").out("name")) == ["m"] and names(g.v("_:_id_1").out("age")) == ["5"]
    with pytest.raises(ValueError):
        g.updatej('{"_id": "1", "k": [{"_id": "2"}]}')
    with pytest.raises(ValueError):
        g.putj("3")
    g.putj('[{"_id": "8"}, {"_id": "9"}]')
    assert is_id("_:_id_8") and not is_id("_:x") and names(g.v("_:_id_9").out("_id")) == ["9"]
    docs = spark.createDataFrame([(1, '{"a": {"b": "c"}}'), (2, None)], "i int, d string")
    first, second = (sorted(map(tuple, document_triples(docs, "i", "d").collect())) for _ in range(2))
    assert first == second and len(first) == 2
    assert g.load_documents(docs, "i", "d").v().out("b").count() == 1
    assert list(triples_of({}, "s")) == []


def test_triple_files(spark, g, tmp_path):
    path = tmp_path / "t.nq"
    path.write_text('<a> <p> <b> .\n\n_:x <p> "two words" .\ns p "q"@en .\ns p "it\'s \\"so\\"" .\n s\tp\to\n')
    g.load_triples(str(path))
    assert sorted(g.triples()) == [("<a>", "<p>", "<b>"), ("_:x", "<p>", "two words"), ("s", "p", "it's \"so\""), ("s", "p", "o"), ("s", "p", "q@en")]
    bad = tmp_path / "bad.nq"
    bad.write_text('a "b\n')
    with pytest.raises(Exception, match="unreadable"):
        files.read_triples(spark, str(bad)).collect()
    g.load_triples(str(path), "second")
    assert "second" in g.ls()


def test_csv_edges_and_vectors(spark, g, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('id,"full title",note\n1,"A, ""B""",\n2,C,"two\nlines"\n')
    g.load_csv(str(path), "id")
    want = {(r["id"], k, v) for r in csv.DictReader(open(path, newline="")) for k, v in r.items()}
    assert set(g.triples()) == want and ("1", "note", "") in want
    with pytest.raises(ValueError):
        g.load_csv(str(path), None)
    edges = tmp_path / "e.txt"
    edges.write_text("a b\n  c\t d 9\nlone\n")
    assert sorted(map(tuple, files.read_edgelist(spark, str(edges), "knows").collect())) == [("a", "knows", "b"), ("c", "knows", "d")]
    assert g.load_edgelist(str(edges), predicate="k").v("a").out("k").count() == 1
    vecs = tmp_path / "v.txt"
    vecs.write_text("king 1 0.5\nqueen 0 1\nx\n")
    assert g.load_glove(str(vecs)) == 2 and g.get_embedding("king") == [1.0, 0.5] and g.embedding_stats() == {"count": 2, "dimensions": 2}

    class Row(list):
        def tolist(self):
            return list(self)

    class Model:
        index_to_key = ["w1", "w2", "w3"]

        def __getitem__(self, k):
            return Row([1.0, float(k[1])])

    assert g.load_gensim(Model(), limit=2) == 2 and g.get_embedding("w2") == [1.0, 2.0] and g.get_embedding("w3") is None


def test_export_round_trip(spark, g, tmp_path):
    rows = [("a b", "p", 'say "hi"\n'), ("<i>", "_:p", "<o>"), ("x>y\\", "q", "plain"), ("t\tu", "p", "")]
    g.put_batch(rows)
    path = tmp_path / "out"
    assert g.export(str(path), "CSV") == 4
    got = list(csv.DictReader(open(path, newline="")))
    assert sorted(tuple(r[k] for k in ("subject", "predicate", "object")) for r in got) == sorted(rows)
    g.export(str(path), "tsv")
    assert sorted(tuple(r) for r in list(csv.reader(open(path, newline=""), delimiter="\t"))[1:]) == sorted(rows)
    g.export(str(path), "nt", strict=True)
    assert sorted(open(path)) == sorted(['<a b> <p> "say \\"hi\\"\\n" .\n', "<i> _:p <o> .\n", '<x%3Ey\\\\> <q> "plain" .\n', '<t\tu> <p> "" .\n'])
    with pytest.raises(ValueError):
        g.export(str(path), "xml")
    g.export_folder(str(tmp_path / "folder"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("emptyValue", "").csv(str(tmp_path / "folder"))
    assert back.count() == 4


def test_similarity(g):
    fruit = {"apple": [1.0, 0.0], "orange": [0.8, 0.6], "lime": [0.6, 0.8], "bread": [-1.0, 0.0], "nil": [0.0, 0.0]}
    g.put_batch([(f, "isa", "food") for f in fruit]).put_embeddings_batch(fruit.items())
    assert names(g.v().sim("apple", ">", 0.7)) == ["apple", "orange"]
    assert names(g.v().sim("apple", "<=", 0.0)) == ["bread", "food", "nil"]
    assert names(g.v().sim("apple", "in", [0.5, 0.7])) == ["lime"] and names(g.v().sim("apple", "=", 1.0)) == ["apple"]
    assert names(g.v().sim("nothing", "=", 0.0)) == ["apple", "bread", "food", "lime", "nil", "orange"]
    for bad in (("~", 1), ("in", 1), ("in", [1]), (">", "x")):
        with pytest.raises(ValueError):
            g.v().sim("apple", *bad)
    with pytest.raises(ValueError):
        g.v().sim("apple", ">", 0.1, strict=True)
    assert [r["id"] for r in g.v().k_nearest("apple", 3).all()["result"]] == ["apple", "orange", "lime"]
    assert g.v("food").k_nearest("apple").count() == 0 == g.v([]).k_nearest("apple").count() == g.v().k_nearest("unknown").count()
    g.current = None
    g.put_embedding("grape", [0.9, 0.1]).delete_embedding("lime")
    assert [r["id"] for r in g.k_nearest("apple", 2).all()["result"]] == ["apple", "grape"] and g.get_embedding("lime") is None
    assert [r["id"] for r in g.scan_embeddings(9)["result"]] == ["apple", "bread", "nil", "orange"]
    assert g.v(track_paths=False).k_nearest("apple", 1).count() == 1
    g.put_embedding("odd", [1.0, 2.0, 3.0]).put("odd", "isa", "food")
    with pytest.raises(Exception, match="dimensions"):
        g.v().sim("apple", ">", 0.5).all()
    with pytest.raises(TypeError):
        g.put_embeddings_batch([(3, [1.0])])


def test_vectorize(g):
    g.put_batch([("red apple", "isa", "fruit"), ("red car", "isa", "thing")])
    assert g.vectorize() == {"vectorized": 4, "skipped": 0, "total": 4}
    assert g.vectorize(["fruit", "new text"]) == {"vectorized": 1, "skipped": 1, "total": 2}
    assert [r["id"] for r in g.v().k_nearest("a red apple", 1).all()["result"]] == ["red apple"]
    assert hashing(["x"]) == hashing(["x"])

    def broken(texts, **_):
        raise RuntimeError("no service")

    register("broken", broken)
    try:
        assert g.vectorize(["zzz", "fruit"], "broken") == {"vectorized": 0, "skipped": 1, "total": 2, "errors": ["no service"], "failed_batches": 1}
    finally:
        PROVIDERS.pop("broken")
    for bad in ({"batch_size": 0}, {"provider": "none"}):
        with pytest.raises(ValueError):
            g.vectorize(**bad)


def test_key_value_layer(spark, tmp_path):
    kv = KeyValueStore(spark, Config.of(home=str(tmp_path)), "ns")
    kv.use_table("t").put("a", "1").put("a", "2").put_list("l", "x").put_list("l", "y").put_set("s", "u").put_set("s", "v").put_set("s", "u").put("gone", "1").delete("gone")
    assert kv.get("a") == "2" and kv.get("l") == ["y", "x"] and kv.get("s") == ["u", "v"] and kv.get("gone") is None
    kv.put("l", "scalar").put_list("m", "1")
    assert dict(kv.scanner()) == {"a": "2", "l": "scalar", "m": ["1"], "s": ["u", "v"]}
    assert kv.get("l") == "scalar" and sorted(kv.scanner(lambda k: k.upper())) == ["A", "L", "M", "S"]
    assert kv.list_tables() == ["t"] and kv.is_namespace("ns") and not kv.is_namespace("none")
    assert kv.use_table("other").get("a") is None and kv.use_table("t").get("a") == "2"
    for bad in (lambda: kv.put(3, "x"), lambda: kv.put_set("k", 3)):
        with pytest.raises(AssertionError):
            bad()


def test_key_value_types(spark, tmp_path):
    kv = KeyValueStore(spark, Config.of(home=str(tmp_path)))
    values = {"text": "é", "empty": "", "yes": True, "no": False, "whole": -(1 << 63), "float": 0.1, "inf": float("inf"), "bytes": b"\x00\xff", "array": [1.5, 2.0], "none": "None"}
    for k, v in values.items():
        kv.put(k, v)
    assert {k: kv.get(k) for k in values} == values and type(kv.get("yes")) is bool and type(kv.get("whole")) is int
    kv.put_list("l", 1).put_list("l", b"x").put(b"text", None)
    assert kv.get("l") == [b"x", 1] and kv.get(b"text") == "None" and kv.head("l") == ("l", b"x") and kv.head("float") == ("s", 0.1) and kv.head("gone") is None
    for bad in (1 << 63, [True], ["a"]):
        with pytest.raises(ValueError):
            kv.put("x", bad)


def test_key_value_stores_compact_and_go_on_counting(spark, tmp_path):
    config = Config.of(home=str(tmp_path), flush_rows=2, compact_files=3)
    kv = KeyValueStore(spark, config, "n").use_table("t")
    for i in range(9):
        kv.put("k", i).put_list("l", str(i)).put_set("s", str(i % 3))
    kv.delete("l").put_list("l", "new").get_table("u").put("k", "other").flush()
    kv = KeyValueStore(spark, config, "n").use_table("t")
    assert len(kv.manifest["parts"]) < 3 and kv.list_tables() == ["t", "u"]
    assert dict(kv.scanner()) == {"k": 8, "l": ["new"], "s": ["0", "1", "2"]} == dict(kv.compact().scanner())
    kv.put("k", "later").put_list("l", "newer")
    assert kv.get("k") == "later" and kv.get("l") == ["newer", "new"] and kv.get_table("u").get("k") == "other" and kv.table == "t"
    rows = spark.createDataFrame([("P", "k", "a", 1), ("P", "k", "b", 2), ("U", "s", "9", 3)], "op string, key string, value string, seq long")
    assert kv.append(rows).get("k") == "b" and kv.get("s") == ["0", "1", "2", "9"]


def test_streamed_triples(spark, g, tmp_path):
    spark.createDataFrame([("a", "p", "b", "P"), ("a", "p", "b", "P"), (None, "p", "b", "P")], "s string, p string, o string, op string").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("s string, p string, o string, op string").parquet(str(tmp_path / "in"))
    stream_triples(g, stream(), str(tmp_path / "cp")).awaitTermination()
    assert g.triples() == [("a", "p", "b")]
    spark.createDataFrame([("a", "p", "c", "R")], "s string, p string, o string, op string").write.mode("append").parquet(str(tmp_path / "in"))
    stream_triples(g, stream(), str(tmp_path / "cp")).awaitTermination()
    assert g.triples() == [("a", "p", "c")]


def test_running_total_lookup_components(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 30), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int, w int").repartition(5)
    total, want = 0, {}
    for n, (a, b, w) in enumerate(sorted(rows)):
        want[b] = (n, total)
        total += w
    order = [F.col("a"), F.col("b")]
    got = {r.b: r.before for r in running_total(df, order).collect()}
    heavy = {r.b: r.before for r in running_total(df, order, F.col("w")).collect()}
    assert {b: (got[b], heavy[b]) for b in got} == want
    assert running_total(df.limit(0), order).count() == 0
    one = spark.createDataFrame([(k, f"v{k}", k < 3) for k in range(31)], "a int, v string, hot boolean")
    assert lookup(df, one, ["a"], "hot").count() == 500
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z1", "z2"), ("z2", "z1"), ("q", "q")]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert all(found[f"n{i:03}"] == "n000" for i in range(61)) and found["z2"] == "z1" and "q" not in found
