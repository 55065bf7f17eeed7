"""Append-only stores: a folder per graph, log parts in Parquet, and a manifest that names what is valid."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.config import Config
from trigraph.functions.files import Files
from trigraph.operators.mutation import DELETE, ever_nodes, ever_predicates, joined_set, live_edges, live_embeddings, merged_edges, merged_embeddings, over
from trigraph.operators.traversal import Tables
from trigraph.schema import EDGE, EDGE_LOG, EMBEDDING, EMBEDDING_LOG, NODE, PREDICATE

HIDDEN = ("sys", "views", "kv")
#: A log of at most so many rows (or vectors) is sent to all executors and laid over the snapshot.
TAIL_ROWS = 100_000
#: Log rows, as a part of the snapshot's rows, from which a snapshot is written anew; before, only log parts are merged.
REWRITE = 0.25


class GraphStore:
    """One graph's storage.

    Mutations are log rows; small ones wait in a buffer that is written before any read. A part counts once the
    manifest names it, so a job that dies half-way leaves the graph as it was. ``compact`` writes a snapshot (edges
    clustered by predicate and subject, for file pruning) and starts a new log. After a snapshot, reads lay the log over
    it and don't group it again; when log parts get many they are merged, and only a log that has grown to a
    fixed part of the snapshot is compacted, so the work of a change doesn't grow with the graph. Parts that went out of
    use are removed one step later, so that plans made from the state just before still run. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, config: Config, name: str):
        self.spark, self.config, self.name = spark, config, name
        self.files = Files(spark)
        self.path = f"{config.root.rstrip('/')}/{name}"
        self._buffers: dict[str, list[tuple]] = {"edges": [], "embeddings": []}
        text = self.files.read_text(f"{self.path}/manifest.json")
        self.manifest = json.loads(text) if text else {"seq": 1, "edges": [], "embeddings": [], "snapshot": None}
        if not text:
            self.files.mkdirs(self.path)
            self._save()
        self.version = 0

    def _save(self) -> None:
        self.files.write_text(f"{self.path}/manifest.json", json.dumps(self.manifest))

    def _schema(self, kind: str):
        return EDGE_LOG if kind == "edges" else EMBEDDING_LOG

    # writing

    def add(self, kind: str, rows: Sequence[tuple]) -> None:
        """Rows without seq; they get consecutive numbers in order."""
        seq = self.manifest["seq"]
        self._buffers[kind].extend((seq + i, *r) for i, r in enumerate(rows))
        self.manifest["seq"] = seq + len(rows)
        self.version += 1
        if self.config.flush_rows and len(self._buffers[kind]) >= self.config.flush_rows:
            self.flush()

    def append(self, kind: str, rows: DataFrame) -> None:
        """A DataFrame of log rows without seq (op, ...), written by the executors."""
        self.flush()
        base = self.manifest["seq"]
        part, n = self._write(kind, rows.withColumn("seq", F.lit(base) + F.monotonically_increasing_id()))
        top = self.spark.read.schema(self._schema(kind)).parquet(f"{self.path}/{part}").agg(F.max("seq")).first()[0] if n else None
        self._commit(kind, part, n, base if top is None else top + 1)

    def _write(self, kind: str, rows: DataFrame) -> tuple[str, int]:
        """A new part's name and its number of rows, told by the files' footers."""
        part = f"{kind}-{uuid.uuid4().hex}"
        rows.select(*self._schema(kind).names).write.parquet(f"{self.path}/{part}")
        return part, self.spark.read.schema(self._schema(kind)).parquet(f"{self.path}/{part}").count()

    def _commit(self, kind: str, part: str, n: int, seq: int) -> None:
        self.manifest[kind].append(part)
        self.manifest["seq"] = max(seq, self.manifest["seq"])
        self._counts()[part] = n
        self._save()
        self.version += 1
        if len(self.manifest[kind]) >= self.config.compact_files:
            held = sum(self._counts().get(f"{self.manifest['snapshot']}/{k}", 0) for k in self._buffers)
            if sum(map(self.tail_rows, self._buffers)) < REWRITE * held:
                self._merge(kind)
            else:
                self.compact()

    def _merge(self, kind: str) -> None:
        """Makes one part of a log's parts."""
        log = self._tail(kind)
        part, n = self._write(kind, (merged_edges if kind == "edges" else merged_embeddings)(log))
        gone, self.manifest[kind] = self.manifest[kind], [part]
        self._counts()[part] = n
        self._retire(gone)

    def _retire(self, gone: list[str]) -> None:
        """Notes parts that went out of use and removes those noted before."""
        before, self.manifest["old"] = self.manifest.get("old", []), gone
        for part in gone:
            self._counts().pop(part, None)
        self._save()
        self.version += 1
        for part in before:
            self.files.delete(f"{self.path}/{part}")

    def _counts(self) -> dict[str, int]:
        return self.manifest.setdefault("counts", {})

    def tail_rows(self, kind: str) -> int:
        """Log rows since the snapshot."""
        return sum(self._counts().get(p, TAIL_ROWS + 1) for p in self.manifest[kind])

    def flush(self) -> None:
        for kind, rows in self._buffers.items():
            if rows:
                part = f"{kind}-{uuid.uuid4().hex}"
                self.spark.createDataFrame(rows, self._schema(kind)).coalesce(1).write.parquet(f"{self.path}/{part}")
                self._buffers[kind] = []
                self._commit(kind, part, len(rows), self.manifest["seq"])

    def truncate(self) -> None:
        """Empties the graph, vertices and predicates included; embeddings too."""
        self._buffers = {"edges": [], "embeddings": []}
        self.manifest = {"seq": self.manifest["seq"], "edges": [], "embeddings": [], "snapshot": None}
        self._save()
        self.version += 1

    def drop(self) -> None:
        self._buffers = {"edges": [], "embeddings": []}
        self.files.delete(self.path)
        self.manifest = {"seq": 1, "edges": [], "embeddings": [], "snapshot": None}
        self.version += 1

    # reading

    def _tail(self, kind: str) -> DataFrame:
        """The log since the snapshot."""
        schema = self._schema(kind)
        parts = [f"{self.path}/{p}" for p in self.manifest[kind]]
        return self.spark.read.schema(schema).parquet(*parts) if parts else self.spark.createDataFrame([], schema)

    def _snapshot(self, kind: str) -> DataFrame:
        schema = {"edges": EDGE, "embeddings": EMBEDDING, "nodes": NODE, "predicates": PREDICATE}[kind]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{self.manifest['snapshot']}/{kind}")

    def tables(self) -> Tables:
        self.flush()
        log, vectors = self._tail("edges"), self._tail("embeddings")
        if not self.manifest["snapshot"]:
            return Tables(self.spark, live_edges(log), ever_nodes(log), ever_predicates(log), live_embeddings(vectors))
        edges, nodes, predicates, embeddings = (self._snapshot(k) for k in ("edges", "nodes", "predicates", "embeddings"))
        few = self.tail_rows("edges") <= TAIL_ROWS
        if self.manifest["edges"]:
            edges = over(edges, log, few)
            nodes, predicates = joined_set(nodes, ever_nodes(log), "id", few), joined_set(predicates, ever_predicates(log), "p", few)
        if self.manifest["embeddings"]:
            held = embeddings.join(_small(vectors.select("id").distinct(), self.tail_rows("embeddings") <= TAIL_ROWS), "id", "left_anti")
            embeddings = held.unionByName(live_embeddings(vectors))
        return Tables(self.spark, edges, nodes, predicates, embeddings, stored=few)

    def compact(self) -> None:
        """Writes the live state as a snapshot; the log then starts anew."""
        t = self.tables()
        name = f"snapshot-{uuid.uuid4().hex}"
        at = f"{self.path}/{name}"
        t.edges.repartitionByRange("p", "s").sortWithinPartitions("p", "s").write.parquet(f"{at}/edges")
        t.nodes.write.parquet(f"{at}/nodes")
        t.predicates.write.parquet(f"{at}/predicates")
        t.embeddings.write.parquet(f"{at}/embeddings")
        gone = [x for x in (self.manifest["snapshot"], *self.manifest["edges"], *self.manifest["embeddings"]) if x]
        self.manifest |= {"edges": [], "embeddings": [], "snapshot": name, "counts": {}}
        for kind in ("edges", "embeddings"):
            self._counts()[f"{name}/{kind}"] = self._snapshot(kind).count()
        self._retire(gone)


def _small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def graph_names(spark: SparkSession, config: Config) -> list[str]:
    return [n for n in Files(spark).names(config.root) if n not in HIDDEN]
