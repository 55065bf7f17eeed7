import json
import random

import pytest

from trigraph.operators.nested import WHOLE_PEOPLE, Field, Shape, flatten, parse, visit

SCHEMA = "raw_id long, doc_json string, loaded_at timestamp_ntz, pk string, parent string"


def run(spark, docs):
    from datetime import datetime

    rows = [(i, d, datetime(2024, 1, 1 + k % 20), "c", "d") for k, (i, d) in enumerate(docs)]
    t = flatten(spark.createDataFrame(rows, SCHEMA))
    return t, sorted(tuple(r) for r in t.person_phones().collect())


def test_shapes(spark):
    doc = {
        "_id": {"$oid": "7"},
        "name": "a",
        "location": [{"city": "x"}],
        "contact": [{"phone": ["1", None, ""]}, {"other": {"phone": 22.50}}],
        "friends": [None, "bo", {"_id": 5, "location": "y", "contact": {}, "friends": {"name": "deep", "contact": {"phone": "9"}}}, {"friends": "[{\"name\": \"told\"}]"}],
    }
    text = json.dumps(doc).replace("22.5", "22.50")
    _, rows = run(spark, [(1, text)])
    assert rows == sorted(
        [
            (1, "", "-", "7", "a", "x", 0, "1"),
            (1, "", "-", "7", "a", "x", 1, "22.50"),
            (1, "1", "", "", "bo", "", -1, ""),
            (1, "2", "", "5", "", "y", -1, ""),
            (1, "2.0", "2", "", "deep", "", 0, "9"),
            (1, "3", "", "", "", "", -1, ""),
            (1, "3.0", "3", "", "told", "", -1, ""),
        ]
    )


def test_typed_tables_of_other_shapes(spark):
    doc = {
        "name": "a", "colors": ["red", None, ["blue"], {"x": "no"}], "location": {"city": "x", "country": "y", "geo": {"lat": 1.5, "lon": "east"}},
        "contact": [{"email": "e@x", "phone": 1}], "friends": ["bo", {"location": "z", "colors": "green", "note": 7}],
    }
    docs = spark.createDataFrame([(1, json.dumps(doc), 1)], "raw_id long, doc_json string, loaded_at int")
    t = flatten(docs, shape=WHOLE_PEOPLE)
    people = {r.pk: r for r in t.persons.collect()}
    assert (people[""].country, people[""].lat, people[""].lon) == ("y", 1.5, None) and people["1"].country == "" and (people["1"].city, people["1"].note) == ("z", "7")
    assert people["0"].person_name == "bo" and people["0"].lat is None
    assert sorted((r.parent, r.ordinal, r.color) for r in t.table("color").collect()) == [("", 0, "red"), ("", 1, "blue"), ("1", 0, "green")]
    assert [(r.parent, r.email) for r in t.table("email").collect()] == [("", "e@x")]
    plan = t.table("color")._jdf.queryExecution().executedPlan().toString()
    assert "color__color" in plan and "person__" not in plan and "PartitionFilters: [isnotnull(tag" in plan
    boxes = Shape("box", "boxes", "label", {"label": Field(("label",)), "weight": Field(("size", "kg"), type="int")}, {})
    t = flatten(spark.createDataFrame([(1, '{"label": "a", "boxes": {"label": "b", "size": {"kg": 3}}}', 1)], "raw_id long, doc_json string, loaded_at int"), shape=boxes)
    assert sorted((r.pk, r.parent, r.label, r.weight) for r in t.table("box").collect()) == [("", "-", "a", None), ("0", "", "b", 3)]


def test_tables_link_and_odd_documents(spark):
    docs = [(1, None), (2, ""), (3, "{'a': 1}"), (4, "[1]"), (5, "null"), (6, '{"a":1} x'), (7, "{}"), (7, '{"name":"new"}'), (None, "{}"), (8, '{"friends":{}}'), (9, '{"name":"\\ud800","n":NaN}'), (10, '{"name":"\\ud800"}')]
    t, rows = run(spark, docs)
    assert [r[0] for r in rows] == [7, 8, 10]
    assert rows[0][4] == "new"
    persons = {(r.raw_id, r.pk) for r in t.persons.collect()}
    assert all((r.raw_id, r.parent) in persons for r in t.phones.collect())
    t, rows = run(spark, [])
    assert rows == [] and t.persons.count() == 0
    t.drop()
    with pytest.raises(Exception, match="(?i)exist"):
        t.persons.count()


def test_deep_documents_parse_without_recursion(spark):
    depth = 5_000
    text = '{"friends":[' * depth + '{"name":"end","contact":{"phone":"1"}}' + "]}" * depth
    persons = [x for x in visit(parse(text)) if x[0] == "person"]
    assert len(persons) == depth + 1 and persons[-1][4][1] == "end"


def test_own_parser_agrees():
    from trigraph.operators.nested import _deep

    rng = random.Random(1)

    def value(d):
        kind = rng.randint(0, 6 if d else 4)
        return [None, True, rng.randint(-9, 9), rng.random(), 'a"\\\né', None, None][kind] if kind < 5 else [value(d - 1) for _ in range(rng.randint(0, 3))] if kind == 5 else {f"k{i}": value(d - 1) for i in range(rng.randint(0, 3))}

    for _ in range(300):
        text = json.dumps(value(4), indent=rng.choice([None, 1]))
        assert _deep(text) == parse(text)
    for bad in ["", "{", "[1,]", '{"a"}', '{"a":}', "[1] 2", "01", "{,}", '"a', "tru"]:
        with pytest.raises(ValueError):
            _deep(bad)
        with pytest.raises(ValueError):
            parse(bad)
