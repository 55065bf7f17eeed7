"""The key-value layer: namespaces of tables over one append-only log."""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigraph.config import Config
from trigraph.functions.files import Files
from trigraph.functions.lineage import shared_path
from trigraph.operators.mutation import DELETE, LIST, PUT, SET, live_items
from trigraph.schema import KV_LOG

Value = str | bool | int | float | bytes | list


def encoded(value: Value) -> str:
    """A value as text that begins with the letter of its type; other objects become their text."""
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, bool):
        return "B1" if value else "B0"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise ValueError(f"{value} doesn't fit 64 bits")
        return f"i{value}"
    if isinstance(value, float):
        return "f" + value.hex()
    if isinstance(value, bytes):
        return "b" + base64.b64encode(value).decode()
    if isinstance(value, list):
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in value):
            raise ValueError("an array holds numbers")
        return "a" + json.dumps([float(x).hex() for x in value])
    return "s" + str(value)


def decoded(text: str) -> Value:
    kind, rest = text[:1], text[1:]
    if kind == "B":
        return rest == "1"
    if kind == "i":
        return int(rest)
    if kind == "f":
        return float.fromhex(rest)
    if kind == "b":
        return base64.b64decode(rest)
    return [float.fromhex(x) for x in json.loads(rest)] if kind == "a" else rest


class KeyValueStore:
    """Tables of string keys; a value is a scalar (text, boolean, whole number, float, bytes or array of numbers), a
    list (newest first) or a set. One writer at a time.

    Changes are numbered by a stored counter and written as parts that a manifest names. When there are many parts they
    are compacted to the live values, sorted by table and key, so that a lookup reads few row groups.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, namespace: str = "default"):
        self.spark, self.config = spark, config or Config.of(home=shared_path(spark, "kv"))
        self.files = Files(spark)
        self._rows: list[tuple] = []
        self.use_namespace(namespace)

    # namespaces and tables

    def use_namespace(self, name: str) -> KeyValueStore:
        self.flush()
        self.namespace, self.table = name, "main"
        self.path = f"{self.config.root.rstrip('/')}/kv/{name}"
        text = self.files.read_text(f"{self.path}/manifest.json")
        self.manifest = json.loads(text) if text else {"seq": 0, "parts": [], "tables": [], "old": []}
        if not text:
            self.files.mkdirs(self.path)
            self._save()
        return self

    create_or_load_namespace = use_namespace

    def _save(self) -> None:
        self.files.write_text(f"{self.path}/manifest.json", json.dumps(self.manifest))

    def is_namespace(self, name: str) -> bool:
        return self.files.exists(f"{self.config.root.rstrip('/')}/kv/{name}")

    def use_table(self, name: str) -> KeyValueStore:
        if name not in self.manifest["tables"]:
            self.manifest["tables"].append(name)
            self._save()
        self.table = name
        return self

    create_table = load_table = use_table

    def get_table(self, name: str, namespace: str | None = None) -> KeyValueStore:
        """Another store over the named table; this one stays at its own. What waits here is written first."""
        self.flush()
        return KeyValueStore(self.spark, self.config, namespace or self.namespace).use_table(name)

    def list_tables(self) -> list[str]:
        return sorted(self.manifest["tables"])

    # writing

    def _add(self, op: str, key: str | bytes, value: Value | None) -> KeyValueStore:
        if not isinstance(key, (str, bytes)):
            raise AssertionError("a key is text or bytes")
        self.manifest["seq"] += 1
        text = None if op == DELETE else encoded(value)
        self._rows.append((self.manifest["seq"], op, self.table, key.decode() if isinstance(key, bytes) else key, text))
        if len(self._rows) >= max(1, self.config.flush_rows or 1 << 30):
            self.flush()
        return self

    def put(self, key: str | bytes, value: Value) -> KeyValueStore:
        return self._add(PUT, key, value)

    def put_list(self, key: str | bytes, value: Value) -> KeyValueStore:
        return self._add(LIST, key, value)

    def put_set(self, key: str | bytes, value: str) -> KeyValueStore:
        if not isinstance(value, str):
            raise AssertionError("a set holds text")
        return self._add(SET, key, value)

    def delete(self, key: str | bytes) -> KeyValueStore:
        return self._add(DELETE, key, None)

    def append(self, rows: DataFrame) -> KeyValueStore:
        """A DataFrame of changes (op, key, value as text[, seq]) of the current table, written by the executors.

        ``seq`` gives their order among themselves; without it rows are in the order they are read.
        """
        self.flush()
        base = self.manifest["seq"] + 1
        at = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        return self._write(rows.select((F.lit(base) + at).alias("seq"), "op", F.lit(self.table).alias("tbl"), "key", F.concat(F.lit("s"), "value").alias("value")))

    def _write(self, rows: DataFrame) -> KeyValueStore:
        part = f"part-{uuid.uuid4().hex}"
        rows.select(*KV_LOG.names).write.parquet(f"{self.path}/{part}")
        top = self.spark.read.schema(KV_LOG).parquet(f"{self.path}/{part}").agg(F.max("seq")).first()[0]
        self.manifest["seq"] = max(self.manifest["seq"], top or 0)
        self.manifest["parts"].append(part)
        self._save()
        if len(self.manifest["parts"]) >= self.config.compact_files:
            self.compact()
        return self

    def flush(self) -> None:
        if self._rows:
            rows, self._rows = self._rows, []
            self._write(self.spark.createDataFrame(rows, KV_LOG).coalesce(1))

    sync = flush

    def compact(self) -> KeyValueStore:
        """Rewrites all tables of the namespace as their live values; parts before the last ones are removed."""
        self.flush()
        op = F.when(F.col("kind") == "s", PUT).when(F.col("kind") == "l", LIST).otherwise(SET)
        live = live_items(self._log()).select("seq", op.alias("op"), "tbl", "key", "value")
        part = f"part-{uuid.uuid4().hex}"
        live.repartitionByRange("tbl", "key", "seq").sortWithinPartitions("tbl", "key", "seq").write.parquet(f"{self.path}/{part}")
        gone, self.manifest["old"], self.manifest["parts"] = self.manifest["old"], self.manifest["parts"], [part]
        self._save()
        for x in gone:
            self.files.delete(f"{self.path}/{x}")
        return self

    # reading

    def _log(self) -> DataFrame:
        parts = [f"{self.path}/{p}" for p in self.manifest["parts"]]
        return self.spark.read.schema(KV_LOG).parquet(*parts) if parts else self.spark.createDataFrame([], KV_LOG)

    def log(self) -> DataFrame:
        """The changes of the current table; values begin with the letter of their type."""
        self.flush()
        return self._log().where(F.col("tbl") == self.table)

    def items(self) -> DataFrame:
        """(key, kind, seq, type, value) of the current table, one row per value; values as text."""
        return live_items(self.log()).select("key", "kind", "seq", F.substring("value", 1, 1).alias("type"), F.expr("substring(value, 2)").alias("value"))

    def get(self, key: str | bytes) -> Value | list[Value] | None:
        """A point lookup; the key filter reaches the scan."""
        name = key.decode() if isinstance(key, bytes) else key
        rows = live_items(self.log().where(F.col("key") == name)).collect()
        return next((value for _, value in _grouped(sorted(rows, key=_place))), None)

    def head(self, key: str | bytes) -> tuple[str, Value] | None:
        """A key's kind and first value alone: the scalar, a list's newest or a set's first. One row leaves the executors."""
        name = key.decode() if isinstance(key, bytes) else key
        rows = live_items(self.log().where(F.col("key") == name))
        found = rows.orderBy(F.when(F.col("kind") == "l", -F.col("seq")).otherwise(F.col("seq"))).limit(1).collect()
        return (found[0]["kind"], decoded(found[0]["value"])) if found else None

    def scanner(self, process: Callable[[str], object] | None = None) -> Iterator:
        """(key, value) pairs in order of key, or ``process(key)`` in their place, one partition at a time."""
        place = F.when(F.col("kind") == "l", -F.col("seq")).otherwise(F.col("seq"))
        rows = live_items(self.log()).orderBy("key", place).toLocalIterator(prefetchPartitions=True)
        for key, value in _grouped(rows):
            yield process(key) if process else (key, value)


def _place(row) -> int:
    return -row["seq"] if row["kind"] == "l" else row["seq"]


def _grouped(rows: Iterable) -> Iterator[tuple[str, Value | list[Value]]]:
    for key, group in groupby(rows, key=lambda r: r["key"]):
        held = list(group)
        yield key, decoded(held[0]["value"]) if held[0]["kind"] == "s" else [decoded(r["value"]) for r in held]
