"""The graph: mutations over a store, and a current traversal that chained calls move along."""

from __future__ import annotations

import json as jsonlib
from collections.abc import Iterable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph import export as exporting
from trigraph.config import Config
from trigraph.functions.lineage import cut, shared_path
from trigraph.operators import recursive, vectors
from trigraph.operators.mutation import DELETE, PUT, REPLACE
from trigraph.operators.traversal import ASC, Predicate, Tables, Traversal
from trigraph.schema import EMBEDDING
from trigraph.sources import documents, files, providers
from trigraph.store import GraphStore, graph_names

Triple = tuple[str, str, str]
#: Messages of failed batches that ``vectorize`` returns; the number of failed batches is told beside them.
MOST_ERRORS = 100


def _texts(*values: str) -> None:
    if not all(isinstance(v, str) for v in values):
        raise AssertionError("graph terms are text")


class Graph:
    """A named graph. Chained traversal methods move ``current`` and return the graph; terminals read it.

    ``Graph(spark, "name", home=...)`` stores under ``home``. If none is named, the graph is temporary: it lies in a
    fresh part of the session's shared folder and goes with the application.
    ``Graph.from_triples(df)`` reads existing DataFrames and can't be changed.
    """

    def __init__(self, spark: SparkSession, name: str, **options):
        self.spark, self.name = spark, name
        self.config = Config.of(**options if "home" in options else options | {"home": shared_path(spark, "graphs")})
        self.store: GraphStore | None = GraphStore(spark, self.config, name)
        self.current: Traversal | None = None
        self._fixed: Tables | None = None
        self._read: tuple[int, Tables] | None = None
        self._keep = False
        self._provider: tuple[str, dict] | None = None

    @classmethod
    def from_triples(cls, edges: DataFrame, nodes: DataFrame | None = None, predicates: DataFrame | None = None, embeddings: DataFrame | None = None, stored: bool = False) -> Graph:
        """A read-only graph over distinct triples (s, p, o), and embeddings (id, vec). ``stored``: ``edges`` is cheap to read again."""
        g = cls.__new__(cls)
        spark = edges.sparkSession
        e = edges.select("s", "p", "o")
        ids = nodes.select("id") if nodes is not None else e.select(F.explode(F.array("s", "o")).alias("id")).distinct()
        g.spark, g.name, g.config, g.store, g.current, g._read, g._keep, g._provider = spark, "triples", Config(), None, None, None, False, None
        vecs = embeddings if embeddings is not None else spark.createDataFrame([], EMBEDDING)
        g._fixed = Tables(spark, e, ids, predicates if predicates is not None else e.select("p").distinct(), vecs, stored)
        return g

    # state

    @property
    def tables(self) -> Tables:
        if self._fixed is not None:
            return self._fixed
        store = self._stored()
        if self._read is None or self._read[0] != store.version:
            self.refresh()
            store.flush()
            tables = store.tables()
            if self._keep:
                tables.edges.cache()
            self._read = (store.version, tables)
        return self._read[1]

    def _stored(self) -> GraphStore:
        if self.store is None:
            raise RuntimeError("this graph is read-only")
        return self.store

    def enable_memory_view(self) -> Graph:
        """Keeps the edges in memory between queries, until the graph changes."""
        self._keep, self._read = True, None
        return self

    def disable_memory_view(self) -> Graph:
        self.refresh()
        self._keep = False
        return self

    def refresh(self) -> Graph:
        if self._read is not None and self._keep:
            self._read[1].edges.unpersist()
        self._read = None
        return self

    def ls(self) -> list[str]:
        return graph_names(self.spark, self.config)

    def use(self, name: str) -> Graph:
        """Switches to another graph of this home, made if it isn't there."""
        self.sync()
        self.refresh()
        self.name, self.store, self.current = name, GraphStore(self.spark, self.config, name), None
        return self

    def get_new_graph_instance(self) -> Graph:
        self.sync()
        g = Graph(self.spark, self.name, **{k: getattr(self.config, k) for k in ("home", "prefix", "views", "flush_rows", "compact_files")})
        return g

    def sync(self) -> Graph:
        self._stored().flush()
        return self

    close = end_batch = sync

    def begin_batch(self) -> Graph:
        """Changes wait in the buffer until it is full, read, or ended; that is how they always go."""
        self._stored()
        return self

    def compact(self) -> Graph:
        self._stored().flush()
        self._stored().compact()
        return self

    # changes

    def put(self, s: str, p: str, o: str, update: bool = False, create_new_edge: bool = False) -> Graph:
        """Adds a triple; ``update`` replaces all objects of (s, p). ``create_new_edge`` is accepted and adds too."""
        _texts(s, p, o)
        self._stored().add("edges", [(REPLACE if update and not create_new_edge else PUT, s, p, o)])
        return self

    def put_batch(self, triples: Iterable[Triple] | DataFrame) -> Graph:
        if isinstance(triples, DataFrame):
            self._stored().append("edges", triples.select(F.lit(PUT).alias("op"), "s", "p", "o"))
            return self
        rows = []
        for s, p, o in triples:
            _texts(s, p, o)
            rows.append((PUT, s, p, o))
        self._stored().add("edges", rows)
        return self

    def update(self, s: str, p: str, o: str) -> Graph:
        return self.put(s, p, o, update=True)

    def delete(self, s: str, p: str, o: str) -> Graph:
        """Removes one triple; its vertices stay."""
        _texts(s, p, o)
        self._stored().add("edges", [(DELETE, s, p, o)])
        return self

    def truncate(self) -> Graph:
        self._stored().truncate()
        self.current = None
        return self

    def drop(self, *triple: str) -> Graph:
        """Removes the whole graph."""
        if triple:
            raise DeprecationWarning("drop() removes a graph; use delete(s, p, o) for a triple")
        self._stored().drop()
        self.current = None
        return self

    def put_json(self, doc: str, update: bool = False) -> Graph:
        """A JSON object, or a list of objects, as triples."""
        seed = f"{self.name}/{self._stored().manifest['seq']}"
        self._stored().add("edges", list(documents.triples_of(jsonlib.loads(doc), seed, update)))
        return self

    putj = put_json

    def updatej(self, doc: str) -> Graph:
        return self.put_json(doc, update=True)

    def load_documents(self, docs: DataFrame, ident: str, column: str, update: bool = False) -> Graph:
        """JSON documents of a DataFrame, parsed by the executors."""
        self._stored().append("edges", documents.document_triples(docs, ident, column, update))
        return self

    def _other(self, graph_name: str | None) -> Graph:
        return self if graph_name in (None, self.name) else Graph(self.spark, graph_name, home=self.config.home, prefix=self.config.prefix)

    def load_triples(self, path: str, graph_name: str | None = None) -> Graph:
        self._other(graph_name).put_batch(files.read_triples(self.spark, path))
        return self

    def load_csv(self, path: str, id_column: str, graph_name: str | None = None) -> Graph:
        self._other(graph_name).put_batch(files.read_csv(self.spark, path, id_column))
        return self

    def load_edgelist(self, path: str, graph_name: str | None = None, predicate: str = "none") -> Graph:
        self._other(graph_name).put_batch(files.read_edgelist(self.spark, path, predicate))
        return self

    # embeddings

    def put_embedding(self, text: str, vec: Iterable[float]) -> Graph:
        _texts(text)
        self._stored().add("embeddings", [(PUT, text, [float(x) for x in vec])])
        return self

    def put_embeddings_batch(self, pairs: Iterable[tuple[str, Iterable[float]]] | DataFrame) -> Graph:
        if isinstance(pairs, DataFrame):
            self._stored().append("embeddings", pairs.select(F.lit(PUT).alias("op"), "id", F.col("vec").cast("array<double>").alias("vec")))
            return self
        rows = []
        for text, vec in pairs:
            if not isinstance(text, str):
                raise TypeError("an embedding's key is text")
            rows.append((PUT, text, [float(x) for x in vec]))
        self._stored().add("embeddings", rows)
        return self

    def delete_embedding(self, text: str) -> Graph:
        _texts(text)
        self._stored().add("embeddings", [(DELETE, text, None)])
        return self

    def get_embedding(self, text: str) -> list[float] | None:
        _texts(text)
        return vectors.embedding(self.tables, text)

    def scan_embeddings(self, limit: int = 100) -> dict:
        return {"result": [{"id": r.id} for r in vectors.scan_embeddings(self.tables, limit).collect()]}

    def embedding_stats(self) -> dict:
        r = vectors.embedding_stats(self.tables).first()
        return {"count": r["count"], "dimensions": r["dimensions"]}

    def load_glove(self, path: str, limit: int | None = None, batch_size: int = 1000) -> int:
        loaded = files.read_word_vectors(self.spark, path, limit)
        self.put_embeddings_batch(loaded)
        return loaded.count()

    def load_gensim(self, model, limit: int | None = None, batch_size: int = 1000) -> int:
        n = 0
        for batch in files.keyed_vectors(model, limit, batch_size):
            self.put_embeddings_batch(batch)
            n += len(batch)
        return n

    def vectorize(self, texts: str | list[str] | None = None, provider: str = "hashing", batch_size: int = 100, **kwargs) -> dict:
        """Embeds the texts, or all nodes, that have no vector yet. The executors call the provider in batches."""
        if not isinstance(batch_size, int) or batch_size < 1:
            raise ValueError(f"batch_size must be a positive integer, not {batch_size!r}")
        if provider not in providers.PROVIDERS:
            raise ValueError(f"unknown provider {provider!r}; there are {', '.join(providers.PROVIDERS)}")
        self._provider = (provider, kwargs)
        embed = providers.PROVIDERS[provider]
        listed = [texts] if isinstance(texts, str) else texts
        wanted = self.tables.nodes.select("id") if listed is None else self.spark.createDataFrame([(t,) for t in listed], "id string")
        total = wanted.count()
        missing = wanted.join(self.tables.embeddings.select("id"), "id", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part in providers.chunked(batch["id"].tolist(), batch_size):
                    try:
                        got = [(t, [float(x) for x in v], None) for t, v in embed(part, **kwargs)]
                    except Exception as e:  # noqa: BLE001
                        got = [(None, None, str(e))]
                    yield pd.DataFrame(got, columns=["id", "vec", "error"])

        skipped = total - missing.count()
        done = cut(missing.mapInPandas(run, "id string, vec array<double>, error string"))
        made = done.where("error is null")
        n = made.count()
        if n:
            self.put_embeddings_batch(made)
        out = {"vectorized": n, "skipped": skipped, "total": total}
        failed = done.where("error is not null")
        errors = [r.error for r in failed.select("error").limit(MOST_ERRORS).collect()]
        return out | ({"errors": errors, "failed_batches": failed.count()} if errors else {})

    def _auto_embed(self, text: str) -> None:
        if self._provider and self.store is not None and vectors.embedding(self.tables, text) is None:
            try:
                self.put_embeddings_batch(providers.PROVIDERS[self._provider[0]]([text], **self._provider[1]))
            except Exception:  # noqa: BLE001, S110 - a query without a vector still runs
                pass

    # traversal

    def _at(self) -> Traversal:
        if self.current is None:
            raise RuntimeError("a traversal starts with v()")
        return self.current

    def _move(self, t: Traversal) -> Graph:
        self.current = t
        return self

    def v(self, vertex: str | list[str] | None = None, func: Predicate | None = None, track_paths: bool = True) -> Graph:
        """Starts anew, also in the middle of a chain."""
        return self._move(Traversal.start(self.tables, vertex, func, track_paths))

    def out(self, predicates=None, func: Predicate | None = None) -> Graph:
        return self._move(self._at().out(predicates, func))

    def inc(self, predicates=None, func: Predicate | None = None) -> Graph:
        return self._move(self._at().inc(predicates, func))

    def both(self, predicates=None) -> Graph:
        return self._move(self._at().both(predicates))

    def has(self, predicates, vertex: str) -> Graph:
        return self._move(self._at().has(predicates, vertex))

    def hasr(self, predicates, vertex: str) -> Graph:
        return self._move(self._at().hasr(predicates, vertex))

    def filter(self, func: Predicate) -> Graph:
        return self._move(self._at().filter(func))

    def is_(self, *nodes) -> Graph:
        return self._move(self._at().is_(*nodes))

    def unique(self) -> Graph:
        return self._move(self._at().unique())

    def tag(self, *names) -> Graph:
        return self._move(self._at().tag(*names))

    def back(self, tag: str) -> Graph:
        return self._move(self._at().back(tag))

    def order(self, direction: str = ASC) -> Graph:
        return self._move(self._at().order(direction))

    def limit(self, n: int) -> Graph:
        return self._move(self._at().limit(n))

    def skip(self, n: int) -> Graph:
        return self._move(self._at().skip(n))

    def bfs(self, predicates=None, max_depth=None, min_depth=0, direction="out", until=None, unique=True) -> Graph:
        return self._move(recursive.bfs(self._at(), predicates, max_depth, min_depth, direction, until, unique))

    def dfs(self, predicates=None, max_depth=None, min_depth=0, direction="out", until=None, unique=True) -> Graph:
        return self._move(recursive.dfs(self._at(), predicates, max_depth, min_depth, direction, until, unique))

    def sim(self, text: str, operator: str, threshold, strict: bool = False) -> Graph:
        vectors.check_threshold(operator, threshold)
        start = self._at()
        self._auto_embed(text)
        return self._move(vectors.sim(self._fresh(start), text, operator, threshold, strict))

    def k_nearest(self, text: str, k: int = 10) -> Graph:
        """Nearest rows; without a started traversal, nearest of all embedded texts."""
        self._auto_embed(text)
        start = vectors.everything(self.tables) if self.current is None else self._fresh(self.current)
        return self._move(vectors.k_nearest(start, text, k))

    def _fresh(self, t: Traversal) -> Traversal:
        return replace(t, tables=self.tables)

    # terminals

    def all(self, options: str | None = None) -> dict:
        return self._at().all(options)

    def first(self) -> dict | None:
        return self._at().first()

    one = first

    def count(self) -> int:
        return self._at().count()

    def df(self) -> DataFrame:
        return self._at().df()

    def graph(self) -> dict:
        return self._at().graph()

    def scan(self, limit: int = 10, scan_type: str = "v") -> dict:
        """The first node ids, or predicates with ``'e'``, in order."""
        if not isinstance(scan_type, str):
            raise AssertionError("scan_type is text")
        t = self.tables
        found = t.predicates.select(F.col("p").alias("id")) if scan_type == "e" else t.nodes.select("id")
        return {"result": [{"id": r.id} for r in found.orderBy("id").limit(limit).collect()]}

    def triples_df(self) -> DataFrame:
        return self.tables.edges.select("s", "p", "o")

    def triples(self) -> list[Triple]:
        return list(self.iter_triples())

    def iter_triples(self) -> Iterator[Triple]:
        for r in self.triples_df().toLocalIterator(prefetchPartitions=True):
            yield r.s, r.p, r.o

    def export(self, path: str, fmt: str = "nt", strict: bool = False) -> int:
        """Writes all triples to one file and returns their number."""
        return exporting.write_file(self.triples_df(), path, fmt, strict)

    def export_folder(self, path: str, fmt: str = "nt", strict: bool = False) -> Graph:
        exporting.write_folder(self.triples_df(), path, fmt, strict)
        return self

    def stats(self) -> dict:
        t = self.tables
        return {"name": self.name, "nodes": t.nodes.count(), "edges": t.edges.count(), "predicates": t.predicates.count()}

    # views and service

    def view(self, name: str, persist: bool = True):
        from trigraph.view import View

        return View.of(self, name, persist)

    def show(self, height: int = 500, width: int = 700, dark: bool = False):
        """Shows the traversal's graph in a notebook, without keeping the page."""
        view = self.view("graph", persist=False)
        view.show(height, width, dark)
        return view

    def lsv(self) -> list[str]:
        from trigraph.view import saved

        return saved(self)

    def getv(self, name: str):
        from trigraph.view import View

        return View.load(self, name)

    def serve(self, port: int = 8080, host: str = "127.0.0.1", blocking: bool = False, writable: bool = False) -> Graph:
        from trigraph.server import serve

        serve(self, port, host, blocking, writable)
        return self

    def stop(self) -> Graph:
        from trigraph.server import stop

        stop(self)
        return self

    @staticmethod
    def connect(url: str, timeout: float = 60):
        from trigraph.remote import RemoteGraph

        return RemoteGraph(url, timeout)
