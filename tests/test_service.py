import json
import urllib.error
import urllib.request

import pytest

from trigraph.graph import Graph
from trigraph.server import QueryError, parse_query
from trigraph.view import page


@pytest.fixture(scope="module")
def served(spark, tmp_path_factory):
    g = Graph(spark, "club", home=str(tmp_path_factory.mktemp("home")))
    g.put_batch([("ida", "knows", "jon"), ("jon", "knows", "kim"), ("jon", "score", "7"), ("kim", "score", "12")])
    g.serve(port=0, writable=True)
    yield g
    g.stop()


@pytest.fixture
def remote(served):
    return Graph.connect(f"http://127.0.0.1:{served.port}/club")


def test_remote_answers_as_local(served, remote):
    assert remote.v("ida").out("knows").tag("x").all() == served.v("ida").out("knows").tag("x").all()
    assert remote.v().count() == served.v().count()
    assert remote.v("ida").bfs("knows", max_depth=2).order("desc").all() == {"result": [{"id": "kim"}, {"id": "jon"}]}
    assert remote.v("ida").bfs("knows", until="lambda x: x == 'jon'").all() == {"result": [{"id": "jon"}]}
    assert remote.v().out("score").filter("lambda x: int(x) > 8 and not x.startswith('9')").all() == {"result": [{"id": "12"}]}
    assert remote.v().has("knows", "jon").first() == {"id": "ida"}
    assert remote.v("jon").both().unique().order().skip(1).limit(1).all()["result"] == [{"id": "ida"}]
    assert remote.scan(1) == {"result": [{"id": "12"}]} and remote.stats()["edges"] == 4
    assert remote.v("ida").out().graph() == served.v("ida").out().graph()
    assert remote.v(["ida", "jon"]).is_("jon").back("none").all() == {"result": []}


def test_replies_come_in_pages(served, remote, monkeypatch):
    from trigraph import server

    monkeypatch.setattr(server, "PAGE_ROWS", 2)
    every = sorted(r["id"] for r in served.v().out().all()["result"])
    assert [r["id"] for r in remote.v().out().all()["result"]] == every and len(every) > 2
    assert [r["id"] for r in remote.v().out().order("desc").all()["result"]] == every[::-1]
    assert len(remote.v().out().skip(1).limit(2).all()["result"]) == 2
    for query in ("v().out().graph()", "scan(5)"):
        with pytest.raises(RuntimeError):
            remote._post("query", {"q": query})
    pages = [remote._post("query", {"q": "v().triples()", "page": k}) for k in (0, 1)]
    assert [len(p["result"]) for p in pages] == [2, 2] and pages[0]["more"]


def test_a_url_names_a_graph():
    for bad in ("http://127.0.0.1:1", "http://127.0.0.1:1/"):
        with pytest.raises(ValueError):
            Graph.connect(bad)
    assert Graph.connect("http://127.0.0.1:1/g/", timeout=3).timeout == 3


def test_remote_changes(served, remote):
    remote.put("x", "p", "y").put_batch([("x", "p", "z")]).put("x", "q", "1").put("x", "q", "2", update=True)
    assert sorted(r["id"] for r in served.v("x").out().all()["result"]) == ["2", "y", "z"]
    remote.delete("x", "p", "y")
    assert remote.v("x").out("p").all()["result"] == [{"id": "z"}]
    with pytest.raises(NotImplementedError):
        remote.drop()
    with pytest.raises(TypeError):
        remote.filter(lambda x: True)
    with pytest.raises(RuntimeError, match="already served"):
        served.serve(port=served.port)


@pytest.mark.parametrize(
    "bad",
    ["", "1", "import os", "__import__('os')", "v().__class__", "v().drop()", "out('p')", "v(open('x'))", "v(*['a'])", "v().filter(lambda x: x.__len__())", "v().filter(lambda x, y: True)", "v()[0]", "v", "g.v()", "v(" * 3000],
)
def test_nothing_else_runs(bad):
    with pytest.raises(QueryError):
        parse_query(bad)


def test_pages_and_errors(served):
    base = f"http://127.0.0.1:{served.port}"
    assert b"club" in urllib.request.urlopen(f"{base}/").read()
    assert b"predicates" in urllib.request.urlopen(f"{base}/club/").read()
    for path, body, code in (("/none/query", {"q": "v()"}, 404), ("/club/query", {"q": "v().drop()"}, 400), ("/club/mutate", {"op": "drop"}, 400), ("/club/other", {}, 404)):
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode()))
        assert e.value.code == code
    assert parse_query('v("a(b)").out("p.q")')[0] == ("v", ["a(b)"], {})


def test_read_only(spark, tmp_path):
    g = Graph(spark, "ro", home=str(tmp_path)).put("a", "p", "b")
    g.serve(port=0)
    try:
        with pytest.raises(RuntimeError, match="read-only"):
            Graph.connect(f"http://127.0.0.1:{g.port}/ro").put("a", "p", "c")
    finally:
        g.stop()


def test_views(spark, tmp_path):
    g = Graph(spark, "v", home=str(tmp_path)).put("a", "p", "</script>")
    view = g.v("a").out().view("../x/first")
    with pytest.raises(FileNotFoundError):
        g.getv("none")
    assert view.path == f"{tmp_path}/views/first.html" and g.lsv() == ["first"] and g.getv("first").html == view.html
    assert "</script>\"" not in view.html.split("application/json")[1].split("</script>")[0] and "iframe" in view.render()
    loaded = g.getv("first")
    assert loaded.data == view.data == {"nodes": [{"id": "</script>"}, {"id": "a"}], "links": [{"source": "a", "target": "</script>", "label": "p"}]}
    assert 'width="320" height="240"' in loaded.render(240, 320) and "#181a1f" in loaded.render(dark=True) and "#181a1f" not in loaded.render()
    g.v("a").view("second", persist=False)
    g.v("a").out().show(dark=True)
    assert g.lsv() == ["first"]
    assert "&lt;" in page("<t>", {"nodes": [], "links": []})
