"""JSON documents to triples.

An object is a vertex: ``_:_id_<_id>`` if it has an ``_id``, else a blank node whose label is derived from the document
and the place in it, so that a retried task makes the same vertex. A list is a vertex of its own between the parent
and its items. Numbers and booleans become their JSON text, nulls are skipped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, ID_BLANK = "_:", "_:_id_"


def is_id(label: str) -> bool:
    return label.startswith(ID_BLANK)


def _leaf(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def triples_of(doc, seed: str, update: bool = False) -> Iterator[tuple[str, str, str, str]]:
    """(op, s, p, o) of one document in order; op is R where an update replaces, else P."""
    docs = doc if isinstance(doc, list) else [doc]
    for i, one in enumerate(docs):
        if not isinstance(one, dict):
            raise ValueError("a document is an object or a list of objects")
        yield from _object(one, f"{seed}/{i}", update)


def _blank(place: str) -> str:
    return BLANK + hashlib.sha256(place.encode()).hexdigest()[:32]


def _label(obj: dict, place: str) -> str:
    return _blank(place) if obj.get("_id") is None else f"{ID_BLANK}{_leaf(obj['_id'])}"


def _object(obj: dict, place: str, update: bool) -> Iterator[tuple[str, str, str, str]]:
    stack: list[tuple[dict | list, str, str, str]] = [(obj, _label(obj, place), place, "")]
    while stack:
        holder, subject, where, of = stack.pop()
        listed = isinstance(holder, list)
        below = []
        for key, value in enumerate(holder) if listed else holder.items():
            predicate = of if listed else str(key)
            at = f"{where}[{key}]" if listed else f"{where}/{key}"
            if value is None:
                continue
            if isinstance(value, dict) and update and listed and "_id" in value:
                raise ValueError("an object with _id directly in a list can't be updated")
            term = _label(value, at) if isinstance(value, dict) else _blank(at) if isinstance(value, list) else _leaf(value)
            yield "R" if update and not listed else "P", subject, predicate, term
            if isinstance(value, (dict, list)):
                below.append((value, term, at, predicate))
        stack.extend(reversed(below))


def document_triples(docs: DataFrame, ident: str, column: str, update: bool = False) -> DataFrame:
    """Triples (op, s, p, o) of many documents, parsed by the executors; unreadable ones raise an error."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [t for i, d in zip(batch["i"], batch["d"]) if d is not None for t in triples_of(json.loads(d), str(i), update)]
            yield pd.DataFrame(rows, columns=["op", "s", "p", "o"])

    return docs.select(F.col(ident).cast("string").alias("i"), F.col(column).cast("string").alias("d")).mapInPandas(parse, "op string, s string, p string, o string")


def flat_json_triples(df: DataFrame, subject: Column, column: str) -> DataFrame:
    """(s, p, o) of flat JSON objects, in the JVM; values become text, nulls are skipped."""
    pairs = F.from_json(F.col(column), "map<string,string>")
    return df.select(subject.alias("s"), F.explode(pairs).alias("p", "o")).where("o is not null")
