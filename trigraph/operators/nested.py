"""Deeply nested JSON documents to flat tables that keep parent-child links.

One pass: a depth-first visitor walks each document once and emits tagged rows (table tag, primary key, parent key,
payload). The stream is written partitioned by tag into the shared folder, each table's payload in columns of its own
types, and each table is read back from its own partition with its own schema, so no document is parsed twice and a
table's reader touches neither the other tables nor their columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigraph.functions.files import Files
from trigraph.functions.lineage import shared_path

KEYS = "doc_id long, tag string, pk string, parent string, ordinal long"


@dataclass(frozen=True)
class Field:
    """A scalar at a path. ``bare``: a text in place of the first object is the value; ``wrapped``: an object's first value is meant."""

    path: tuple[str, ...]
    bare: bool = False
    wrapped: bool = False
    type: str = "string"


@dataclass(frozen=True)
class Shape:
    """What a document holds: rows nested in rows of their own kind, and lists of values.

    ``tag`` names the table of the nested rows, ``children`` the field they nest in and ``fields`` their columns; a
    bare text in place of a row has it in column ``text``. ``lists`` has, by table, the field below which and the
    name under which values stand.
    """

    tag: str
    children: str
    text: str
    fields: Mapping[str, Field]
    lists: Mapping[str, tuple[str, str]]

    def columns(self, tag: str) -> dict[str, str]:
        """Payload columns of a table, with their types."""
        return {n: f.type for n, f in self.fields.items()} if tag == self.tag else {tag: "string"}


PEOPLE = Shape(
    "person",
    "friends",
    "person_name",
    {"id_text": Field(("_id",), wrapped=True), "person_name": Field(("name",)), "city": Field(("location", "city"), bare=True)},
    {"phone": ("contact", "phone")},
)
#: All that is known of people.
WHOLE_PEOPLE = replace(
    PEOPLE,
    fields={**PEOPLE.fields, "country": Field(("location", "country")), "lat": Field(("location", "geo", "lat"), type="double"), "lon": Field(("location", "geo", "lon"), type="double"), "note": Field(("note",))},
    lists={**PEOPLE.lists, "email": ("contact", "email"), "color": ("colors", "colors")},
)
ROOT_PARENT = "-"


class Number(str):
    """A JSON number, kept as its text."""


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


_decode = json.JSONDecoder(parse_int=Number, parse_float=Number, parse_constant=_constant)
_space = re.compile(r"[ \t\n\r]*")
_scalar = re.compile(r'-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.ASCII)
_words = {"true": True, "false": False, "null": None}


def _deep(text: str):
    """JSON of any depth, with a stack of its own; used when the built-in parser runs out of recursion."""
    at = _space.match(text, 0).end()
    root: list = []
    stack: list[tuple[list | dict, str | None]] = [(root, None)]
    key: str | None = None

    def skip() -> str:
        nonlocal at
        at = _space.match(text, at).end()
        return text[at : at + 1]

    def put(value) -> None:
        holder = stack[-1][0]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    expect_value = True
    while True:
        c = skip()
        holder = stack[-1][0]
        if expect_value:
            if isinstance(holder, dict):
                if c != '"':
                    raise ValueError("expected a key")
                key, at = json.decoder.scanstring(text, at + 1, True)
                if skip() != ":":
                    raise ValueError("expected a colon")
                at += 1
                c = skip()
            if c == '"':
                value, at = json.decoder.scanstring(text, at + 1, True)
                put(value)
                expect_value = False
            elif c and c in "{[":
                value = {} if c == "{" else []
                put(value)
                at += 1
                if skip() == ("}" if c == "{" else "]"):
                    at += 1
                    expect_value = False
                else:
                    stack.append((value, key))
            else:
                m = _scalar.match(text, at)
                if not m:
                    raise ValueError("expected a value")
                at = m.end()
                put(_words[m[0]] if m[0] in _words else Number(m[0]))
                expect_value = False
        elif len(stack) == 1:
            if c:
                raise ValueError("text after the value")
            return root[0]
        elif c == ",":
            at += 1
            expect_value = True
        elif c == ("}" if isinstance(holder, dict) else "]"):
            at += 1
            key = stack.pop()[1]
        else:
            raise ValueError("expected a comma or an end")


def parse(text: str | None):
    """The parsed document, numbers as their text; ValueError if it isn't JSON."""
    if text is None:
        raise ValueError("no document")
    try:
        value, end = _decode.raw_decode(text, _space.match(text, 0).end())
    except RecursionError:
        return _deep(text)
    if _space.match(text, end).end() != len(text):
        raise ValueError("text after the value")
    return value


def _text(value) -> str:
    """A scalar as text; null, lists and objects as empty."""
    if isinstance(value, bool):
        return "true" if value else "false"
    return _clean(value) if isinstance(value, str) else ""


def _clean(text: str) -> str:
    """Without lone surrogates, which no column can hold."""
    return text if text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _value(row: dict, field: Field) -> str:
    """A field's scalar as text; lists of one are their element, other lists no value."""
    value, last = row, len(field.path)
    for i, name in enumerate(field.path):
        value = value.get(name)
        while isinstance(value, list) and (len(field.path) > 1) and len(value) == 1:
            value = value[0]
        if not isinstance(value, dict):
            last = i + 1
            break
    if last < len(field.path) and not (field.bare and last == 1):
        return ""
    while field.wrapped and isinstance(value, dict):
        value = next(iter(value.values()), None)
    return _text(value)


def _listed(value, name: str, named: bool = False) -> Iterator[str]:
    """Non-empty values of every ``name`` below ``value``, in the order of the document."""
    stack = [(value, named)]
    while stack:
        value, named = stack.pop()
        if isinstance(value, dict):
            stack.extend((v, k == name) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            stack.extend((v, named) for v in reversed(value))
        elif named and (text := _text(value)).strip():
            yield text


def _below(value) -> list:
    """The places of a field of nested rows: a lone object or text is a list of one, an empty object none."""
    if isinstance(value, str) and not isinstance(value, Number):
        try:
            held = parse(value)
        except ValueError:
            held = None
        if isinstance(held, list):
            return held
        return [value] if value.strip() else []
    if isinstance(value, dict):
        return [value] if value else []
    return value if isinstance(value, list) else []


def visit(doc: dict, shape: Shape = PEOPLE) -> Iterator[tuple]:
    """Depth-first (tag, pk, parent, ordinal, values) of one document. A nested row's key is its path."""
    stack = [("", ROOT_PARENT, 0, doc)]
    while stack:
        path, parent, place, row = stack.pop()
        if isinstance(row, str):
            yield shape.tag, path, parent, place, [_clean(row) if n == shape.text else "" for n in shape.fields]
            continue
        yield shape.tag, path, parent, place, [_value(row, f) for f in shape.fields.values()]
        for tag, (start, name) in shape.lists.items():
            for i, text in enumerate(_listed(row.get(start), name, start == name)):
                yield tag, f"{path}#{i}", path, i, [text]
        below = [(f"{path}.{i}" if path else str(i), path, i, f) for i, f in enumerate(_below(row.get(shape.children))) if isinstance(f, (dict, str))]
        stack.extend(reversed(below))


def tagged_rows(docs: DataFrame, ident: str = "raw_id", column: str = "doc_json", version: str = "loaded_at", shape: Shape = PEOPLE) -> DataFrame:
    """The tagged stream of all documents, lazily: keys, and the payload columns of all tables.

    Of a document delivered more than once the latest ``version`` counts (of equally late ones the greatest text).
    """
    tags = [shape.tag, *shape.lists]
    names = [(t, n, f"{t}__{n}", kind) for t in tags for n, kind in shape.columns(t).items()]
    start = {t: next(i for i, (of, *_) in enumerate(names) if of == t) for t in tags}
    keys = [part.split()[0] for part in KEYS.split(", ")]

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*keys, *(full for _, _, full, _ in names)]
        for batch in batches:
            rows: list[tuple] = []
            for ident, text in zip(batch["__i"], batch["__t"]):
                try:
                    doc = parse(text)
                except ValueError:
                    continue
                if isinstance(doc, dict):
                    for tag, pk, parent, ordinal, values in visit(doc, shape):
                        before = start[tag]
                        rows.append((ident, tag, pk, parent, ordinal, *(None,) * before, *values, *(None,) * (len(names) - before - len(values))))
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            yield pd.DataFrame(rows, columns=columns)

    one = docs.select(F.col(ident).cast("bigint").alias("__i"), F.col(column).cast("string").alias("__t"), F.col(version).alias("__v")).where("__i is not null and __t is not null")
    one = one.groupBy("__i").agg(F.max_by("__t", F.struct("__v", "__t")).alias("__t"))
    rows = one.mapInPandas(emit, ", ".join([KEYS, *(f"{full} string" for _, _, full, _ in names)]))
    return rows.select(*keys, *(F.col(full) if kind == "string" else F.col(full).try_cast(kind).alias(full) for _, _, full, kind in names))


class FlatTables:
    """The related flat tables of nested documents; see ``flatten``."""

    def __init__(self, docs: DataFrame, ident: str, column: str, version: str, shape: Shape):
        self.ident, self.shape = ident, shape
        self.spark = docs.sparkSession
        self.path = shared_path(self.spark, "flat-tables")
        tagged_rows(docs, ident, column, version, shape).write.partitionBy("tag").parquet(self.path)

    def table(self, tag: str) -> DataFrame:
        """One table (the ident, pk, parent, ordinal, payload) with its own schema; the reader prunes to the tag's partition."""
        payload = self.shape.columns(tag)
        schema = ", ".join([KEYS, *(f"{tag}__{n} {kind}" for n, kind in payload.items())])
        rows = self.spark.read.schema(schema).parquet(self.path).where(F.col("tag") == tag)
        return rows.select(F.col("doc_id").alias(self.ident), "pk", "parent", "ordinal", *(F.col(f"{tag}__{n}").alias(n) for n in payload))

    def drop(self) -> None:
        """Removes the written tables; else they go with the application's shared folder."""
        Files(self.spark).delete(self.path)

    @property
    def persons(self) -> DataFrame:
        return self.table("person")

    @property
    def phones(self) -> DataFrame:
        return self.table("phone")

    def person_phones(self) -> DataFrame:
        """A row per person and phone; a person without phones has one row with position -1 and an empty phone."""
        phones = self.phones.select(F.col(self.ident).alias("__i"), F.col("parent").alias("__of"), F.col("ordinal").alias("phone_pos"), "phone")
        p = self.persons
        joined = p.join(phones, (p[self.ident] == phones["__i"]) & (p["pk"] == phones["__of"]), "left")
        return joined.select(
            p[self.ident],
            p["pk"].alias("person_path"),
            p["parent"].alias("parent_path"),
            "id_text",
            "person_name",
            "city",
            F.coalesce("phone_pos", F.lit(-1).cast("bigint")).alias("phone_pos"),
            F.coalesce("phone", F.lit("")).alias("phone"),
        )


def flatten(docs: DataFrame, ident: str = "raw_id", column: str = "doc_json", version: str = "loaded_at", shape: Shape = PEOPLE) -> FlatTables:
    """Persons and phones of nested person documents, or the tables of another ``shape``.

    Persons are the document (path empty, parent ``-``) and each friend at any depth (path: 0-based places joined by
    dots). ``pk`` and ``parent`` are paths, unique within a document, so (``ident``, ``parent``) names the parent row.

    Defined cases: null, empty or unreadable documents, and such that aren't an object, give no rows; neither does a
    null ``ident``. Null friends (and numbers, lists or booleans in a friend's place) are skipped and keep their
    place. Absent text fields are empty, numbers that can't be read null. A repeated document counts once, at its
    latest version. Documents may be of any length and depth. Other columns are never read. Empty input gives empty tables.
    """
    return FlatTables(docs, ident, column, version, shape)
