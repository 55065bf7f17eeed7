"""Client of a served graph, with the local graph's methods."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request


class RemoteGraph:
    def __init__(self, url: str, timeout: float = 60):
        if not urllib.parse.urlsplit(url).path.strip("/"):
            raise ValueError("the URL ends with the graph's name: http://host:port/name")
        self.url, self.timeout = url.rstrip("/"), timeout
        self._steps: list[str] = []

    def _post(self, page: str, body: dict) -> dict:
        request = urllib.request.Request(f"{self.url}/{page}", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.loads(reply.read())
        except urllib.error.HTTPError as e:
            raise RuntimeError(json.loads(e.read() or b"{}").get("error", str(e))) from e

    def _step(self, name: str, *args, **kwargs) -> RemoteGraph:
        if any(callable(a) for a in (*args, *kwargs.values())):
            raise TypeError("a remote graph takes conditions as text, such as 'lambda x: x > \"a\"'")
        given = [repr(a) for a in args] + [f"{k}={v!r}" for k, v in kwargs.items() if v is not None]
        self._steps.append(f"{name}({', '.join(given)})")
        return self

    def _run(self, last: str):
        steps, self._steps = [*self._steps, last], []
        return self._post("query", {"q": ".".join(steps)})["result"]

    def v(self, vertex=None, track_paths: bool = True) -> RemoteGraph:
        self._steps = []
        return self._step("v", *([] if vertex is None else [vertex]), **({} if track_paths else {"track_paths": False}))

    def out(self, predicates=None) -> RemoteGraph:
        return self._step("out", *([] if predicates is None else [predicates]))

    def inc(self, predicates=None) -> RemoteGraph:
        return self._step("inc", *([] if predicates is None else [predicates]))

    def both(self, predicates=None) -> RemoteGraph:
        return self._step("both", *([] if predicates is None else [predicates]))

    def has(self, predicates, vertex: str) -> RemoteGraph:
        return self._step("has", predicates, vertex)

    def hasr(self, predicates, vertex: str) -> RemoteGraph:
        return self._step("hasr", predicates, vertex)

    def is_(self, *nodes) -> RemoteGraph:
        return self._step("is_", *nodes)

    def unique(self) -> RemoteGraph:
        return self._step("unique")

    def limit(self, n: int) -> RemoteGraph:
        return self._step("limit", n)

    def skip(self, n: int) -> RemoteGraph:
        return self._step("skip", n)

    def order(self, direction: str = "asc") -> RemoteGraph:
        return self._step("order", direction)

    def tag(self, *names) -> RemoteGraph:
        return self._step("tag", *names)

    def back(self, tag: str) -> RemoteGraph:
        return self._step("back", tag)

    def filter(self, condition: str) -> RemoteGraph:
        """``condition`` is the text of a lambda over the id."""
        if not isinstance(condition, str):
            raise TypeError("a remote condition is the text of a lambda")
        self._steps.append(f"filter({condition})")
        return self

    def _search(self, name: str, until: str | None, **options) -> RemoteGraph:
        given = [f"{k}={v!r}" for k, v in options.items() if v is not None]
        self._steps.append(f"{name}({', '.join(given + ([f'until={until}'] if until else []))})")
        return self

    def bfs(self, predicates=None, max_depth=None, min_depth=0, direction="out", until: str | None = None, unique=True) -> RemoteGraph:
        return self._search("bfs", until, predicates=predicates, max_depth=max_depth, min_depth=min_depth, direction=direction, unique=unique)

    def dfs(self, predicates=None, max_depth=None, min_depth=0, direction="out", until: str | None = None, unique=True) -> RemoteGraph:
        return self._search("dfs", until, predicates=predicates, max_depth=max_depth, min_depth=min_depth, direction=direction, unique=unique)

    def sim(self, text: str, operator: str, threshold, strict: bool = False) -> RemoteGraph:
        return self._step("sim", text, operator, threshold, strict=strict)

    def k_nearest(self, text: str, k: int = 10) -> RemoteGraph:
        return self._step("k_nearest", text, k=k)

    def all(self, options: str | None = None) -> dict:
        """All rows, fetched page by page."""
        steps, self._steps = ".".join([*self._steps, "all()" if options is None else f"all({options!r})"]), []
        rows: list[dict] = []
        page, more = 0, True
        while more:
            reply = self._post("query", {"q": steps, "page": page})
            rows += reply["result"]["result"]
            page, more = page + 1, reply.get("more", False)
        return {"result": rows}

    def count(self) -> int:
        return self._run("count()")

    def first(self) -> dict | None:
        return self._run("first()")

    one = first

    def graph(self) -> dict:
        return self._run("graph()")

    def scan(self, limit: int = 10, scan_type: str = "v") -> dict:
        self._steps = []
        return self._run(f"scan({limit!r}, {scan_type!r})")

    def put(self, s: str, p: str, o: str, update: bool = False) -> RemoteGraph:
        self._post("mutate", {"op": "put", "s": s, "p": p, "o": o, "update": update})
        return self

    def put_batch(self, triples) -> RemoteGraph:
        self._post("mutate", {"op": "put_batch", "triples": [list(t) for t in triples]})
        return self

    def delete(self, s: str, p: str, o: str) -> RemoteGraph:
        self._post("mutate", {"op": "delete", "s": s, "p": p, "o": o})
        return self

    def truncate(self) -> RemoteGraph:
        self._post("mutate", {"op": "truncate"})
        return self

    def drop(self) -> RemoteGraph:
        raise NotImplementedError("a served graph can't be dropped from afar")

    def stats(self) -> dict:
        with urllib.request.urlopen(f"{self.url}/stats", timeout=self.timeout) as reply:
            return json.loads(reply.read())["result"]
