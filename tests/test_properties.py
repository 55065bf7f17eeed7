"""Generated cases for the rules that have a simple statement on one machine."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from trigraph.operators.nested import parse, visit
from trigraph.server import QueryError, parse_query
from trigraph.sources.documents import triples_of

scalars = st.none() | st.booleans() | st.integers(-(10**12), 10**12) | st.text(max_size=6)
values = st.recursive(scalars, lambda v: st.lists(v, max_size=3) | st.dictionaries(st.sampled_from(["friends", "contact", "phone", "name", "_id", "location", "city"]), v, max_size=4), max_leaves=20)
objects = st.dictionaries(st.sampled_from(["friends", "contact", "phone", "name", "_id", "location"]), values, max_size=6)


@given(objects)
@settings(max_examples=200, deadline=None)
def test_any_object_flattens_to_a_tree(doc):
    rows = list(visit(parse(json.dumps(doc))))
    people = [r for r in rows if r[0] == "person"]
    paths = [r[1] for r in people]
    assert len(set(paths)) == len(paths) and paths[0] == "" and people[0][2] == "-"
    for _, path, parent, place, _ in people[1:]:
        assert parent in paths and path == (f"{parent}.{place}" if parent else str(place))
    for tag, pk, parent, _, payload in rows:
        if tag == "phone":
            assert parent in paths and payload[0].strip() and pk.startswith(f"{parent}#")


@given(objects)
@settings(max_examples=200, deadline=None)
def test_any_object_becomes_text_triples_the_same_way_twice(doc):
    first = list(triples_of(doc, "seed"))
    assert first == list(triples_of(json.loads(json.dumps(doc)), "seed"))
    assert all(isinstance(x, str) for t in first for x in t)


@given(st.text(max_size=40))
@settings(max_examples=300, deadline=None)
def test_no_text_is_run_as_a_query(text):
    try:
        steps = parse_query(text)
    except QueryError:
        return
    assert steps[0][0] in ("v", "scan", "k_nearest")
