"""Graphs over HTTP. Queries are parsed as a chain of allowed calls with literal arguments; nothing is evaluated."""

from __future__ import annotations

import ast
import html
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

#: Methods a query may call, and of these the ones that may start it.
STARTS = ("v", "scan", "k_nearest")
CHAIN = frozenset("v out inc both has hasr filter is_ unique limit skip order tag back bfs dfs sim k_nearest all count first one scan graph triples".split())
MUTATIONS = ("put", "put_batch", "delete", "truncate")
MOST_BODY = 64 << 20
#: Rows of one reply; the client asks for further pages.
PAGE_ROWS = 10_000


class QueryError(ValueError):
    pass


def _literal(node: ast.expr):
    try:
        return ast.literal_eval(node)
    except ValueError as e:
        raise QueryError("arguments must be literals") from e


def _comparison(node: ast.expr):
    """A lambda of one parameter over string methods and comparisons, as a Column over id."""
    from pyspark.sql import functions as F

    if not isinstance(node, ast.Lambda) or len(node.args.args) != 1 or node.args.defaults:
        raise QueryError("a condition is a lambda of one parameter")
    name = node.args.args[0].arg

    def value(x: ast.expr):
        if isinstance(x, ast.Name) and x.id == name:
            return F.col("id")
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name) and x.func.id in ("int", "float", "len") and len(x.args) == 1:
            inner = value(x.args[0])
            return F.length(inner) if x.func.id == "len" else inner.try_cast("bigint" if x.func.id == "int" else "double")
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("lower", "upper", "strip") and not x.args:
            return {"lower": F.lower, "upper": F.upper, "strip": F.trim}[x.func.attr](value(x.func.value))
        return F.lit(_literal(x))

    def test(x: ast.expr):
        if isinstance(x, ast.BoolOp):
            parts = [test(p) for p in x.values]
            out = parts[0]
            for p in parts[1:]:
                out = out & p if isinstance(x.op, ast.And) else out | p
            return out
        if isinstance(x, ast.UnaryOp) and isinstance(x.op, ast.Not):
            return ~test(x.operand)
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Attribute) and x.func.attr in ("startswith", "endswith") and len(x.args) == 1:
            return getattr(value(x.func.value), x.func.attr)(value(x.args[0]))
        if isinstance(x, ast.Compare) and len(x.ops) == 1:
            left, op, right = x.left, x.ops[0], x.comparators[0]
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                    found = value(left).isin([_literal(e) for e in right.elts])
                else:
                    found = value(right).contains(value(left))
                return ~found if isinstance(op, ast.NotIn) else found
            ops = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
            if type(op) in ops:
                return getattr(value(left), ops[type(op)])(value(right))
        raise QueryError("a condition may compare, start, end or contain")

    return test(node.body)


def parse_query(text: str) -> list[tuple[str, list, dict]]:
    """``v("a").out("p")`` as [(method, args, kwargs)]."""
    try:
        node = ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError, RecursionError) as e:
        raise QueryError("the query can't be parsed") from e
    steps: list[tuple[str, list, dict]] = []
    while isinstance(node, ast.Call):
        f = node.func
        name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
        if name not in CHAIN:
            raise QueryError(f"method {name!r} isn't allowed")
        arg = lambda a: _comparison(a) if isinstance(a, ast.Lambda) else _literal(a)
        if any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords):
            raise QueryError("arguments must be literals")
        steps.append((name, [arg(a) for a in node.args], {k.arg: arg(k.value) for k in node.keywords}))
        if isinstance(f, ast.Name):
            if name not in STARTS:
                raise QueryError(f"a query starts with {' or '.join(STARTS)}")
            return steps[::-1]
        node = f.value
    raise QueryError("a query is a chain of calls")


def run_query(graph, text: str, page: int = 0) -> tuple[object, bool]:
    """The result and whether there is a further page. No reply holds more than ``PAGE_ROWS`` rows."""
    from pyspark.sql import functions as F

    result = None
    for name, args, kwargs in parse_query(text):
        if name == "all":
            rows = graph.current.skip(page * PAGE_ROWS).limit(PAGE_ROWS + 1).all(*args, **kwargs)["result"]
            return {"result": rows[:PAGE_ROWS]}, len(rows) > PAGE_ROWS
        if name == "triples":
            after = graph.triples_df().orderBy(F.col("s"), F.col("p"), F.col("o")).limit((page + 1) * PAGE_ROWS + 1).offset(page * PAGE_ROWS)
            rows = [tuple(r) for r in after.collect()]
            return rows[:PAGE_ROWS], len(rows) > PAGE_ROWS
        if name == "graph" and graph.current.graph_links().limit(PAGE_ROWS + 1).count() > PAGE_ROWS:
            raise QueryError(f"a graph of over {PAGE_ROWS} links isn't sent; use limit()")
        if name == "scan" and (args[0] if args else kwargs.get("limit", 0)) > PAGE_ROWS:
            raise QueryError(f"a scan sends at most {PAGE_ROWS} ids")
        result = getattr(graph, name)(*args, **kwargs)
    return result if isinstance(result, (dict, int, list)) or result is None else [], False


def mutate(graph, body: dict) -> dict:
    op = body.get("op")
    if op in ("put", "delete"):
        args = [body[k] for k in ("s", "p", "o")]
        graph.put(*args, update=bool(body.get("update"))) if op == "put" else graph.delete(*args)
    elif op == "put_batch":
        graph.put_batch([tuple(t) for t in body["triples"]])
    elif op == "truncate":
        graph.truncate()
    else:
        raise QueryError(f"operation {op!r} isn't one of {', '.join(MUTATIONS)}")
    return {"ok": True}


class _Served:
    def __init__(self, port: int, host: str):
        self.graphs: dict[str, tuple[object, bool, threading.RLock]] = {}
        served = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args) -> None:
                pass

            def _send(self, code: int, body: dict | str) -> None:
                text = body if isinstance(body, str) else json.dumps(body)
                data = text.encode()
                self.send_response(code)
                self.send_header("Content-Type", "text/html; charset=utf-8" if isinstance(body, str) else "application/json")
                self.send_header("Content-Length", str(len(data)))
                self.send_header("Access-Control-Allow-Origin", "*")
                self.end_headers()
                self.wfile.write(data)

            def _target(self) -> tuple[str, str]:
                parts = [p for p in self.path.split("?")[0].split("/") if p]
                return (parts + [""])[0], "/".join(parts[1:])

            def do_OPTIONS(self) -> None:
                self.send_response(204)
                for k, v in (("Origin", "*"), ("Methods", "GET, POST, OPTIONS"), ("Headers", "Content-Type")):
                    self.send_header(f"Access-Control-Allow-{k}", v)
                self.end_headers()

            def do_GET(self) -> None:
                name, rest = self._target()
                if not name:
                    links = "".join(f'<li><a href="/{html.escape(n)}/">{html.escape(n)}</a>' for n in served.graphs)
                    return self._send(200, f"<title>graphs</title><ul>{links}</ul>")
                if name not in served.graphs:
                    return self._send(404, {"ok": False, "error": "no such graph"})
                graph, writable, lock = served.graphs[name]
                with lock:
                    stats = graph.stats()
                if rest == "stats":
                    return self._send(200, {"ok": True, "result": stats})
                if rest:
                    return self._send(404, {"ok": False, "error": "no such page"})
                rows = "".join(f"<tr><td>{html.escape(k)}<td>{html.escape(str(x))}" for k, x in (stats | {"writable": writable}).items())
                return self._send(200, f"<title>{html.escape(name)}</title><table>{rows}</table>")

            def do_POST(self) -> None:
                name, rest = self._target()
                if name not in served.graphs:
                    return self._send(404, {"ok": False, "error": "no such graph"})
                graph, writable, lock = served.graphs[name]
                try:
                    size = int(self.headers.get("Content-Length") or 0)
                    if size > MOST_BODY:
                        return self._send(413, {"ok": False, "error": "the request is too large"})
                    body = json.loads(self.rfile.read(size) or b"{}")
                    if rest == "query":
                        with lock:
                            result, more = run_query(graph, body["q"], int(body.get("page", 0)))
                            return self._send(200, {"ok": True, "result": result} | ({"more": True} if more else {}))
                    if rest == "mutate":
                        if not writable:
                            return self._send(403, {"ok": False, "error": "the graph is read-only"})
                        with lock:
                            return self._send(200, mutate(graph, body))
                    return self._send(404, {"ok": False, "error": "no such page"})
                except Exception as e:  # noqa: BLE001
                    return self._send(400, {"ok": False, "error": str(e)[:1000]})

        self.http = ThreadingHTTPServer((host, port), Handler)
        self.port = self.http.server_address[1]
        self.thread = threading.Thread(target=self.http.serve_forever, daemon=True)


_servers: dict[int, _Served] = {}


def serve(graph, port: int = 8080, host: str = "127.0.0.1", blocking: bool = False, writable: bool = False) -> int:
    """Serves a graph under ``/<name>/``; graphs on one port share a server. Returns the port."""
    server = _servers.get(port)
    if server is None:
        server = _Served(port, host)
        _servers[server.port] = server
        server.thread.start()
    if graph.name in server.graphs:
        raise RuntimeError(f"graph {graph.name!r} is already served on port {server.port}")
    server.graphs[graph.name] = (graph, writable, threading.RLock())
    graph.port = server.port
    if blocking:
        server.thread.join()
    return server.port


def stop(graph) -> None:
    for port, server in list(_servers.items()):
        if server.graphs.get(graph.name, (None,))[0] is graph:
            del server.graphs[graph.name]
            if not server.graphs:
                server.http.shutdown()
                server.http.server_close()
                del _servers[port]
