import random

import pytest

from trigraph.llm.leaks import Items, find_leaks, prepared_items
from trigraph.llm.text import words_of

STOCK = "read the passage below and choose the best answer"


def make_items(rng, n=12):
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    return [(i, f"{STOCK}. " + " ".join(word() for _ in range(60)).capitalize() + "?") for i in range(n)]


@pytest.fixture(scope="module")
def items():
    return make_items(random.Random(4))


def frame(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1.0) for i, t in docs], "doc_id long, text string, passages string, share double")
    e = spark.createDataFrame([(i, t, "s", 5) for i, t in items], "item_id long, item_text string, text string, doc_id long")
    return d, e


def leaks(spark, docs, items, **options):
    return {(r.doc_id, r.item_id): r for r in find_leaks(*frame(spark, docs, items), **options).collect()}


def test_whole_partial_quoted_altered_and_not(spark, items):
    body = items[3][1].split(". ")[1].split()
    filler = "you get a spare pump for nothing and it hums all night"
    altered = body[:]
    for k in range(4, len(altered), 9):
        altered[k] = "changed"
    quoted = "\n".join("> " + " ".join(body[k : k + 6]) for k in range(0, 42, 6))
    rng = random.Random(1)
    mixed = body[:]
    rng.shuffle(mixed)
    docs = [
        (1, f"{filler} {items[3][1]} {filler}"),
        (2, f"{filler} {' '.join(body[:36])} {filler}"),
        (3, f"{' '.join(body[:18])} {filler} <br>{filler}<br> {' '.join(body[40:58])}"),
        (4, quoted),
        (5, " ".join(altered).upper()),
        (6, " ".join(f"<b>{w}</b>" for w in body)),
        (7, f"{STOCK} {filler}"),
        (8, " ".join(body[:12]) + " " + filler),
        (9, " ".join(mixed)),
        (10, " ".join(x for w in body for x in (w, *filler.split()[:5]))),
        (11, None),
        (12, ""),
        (1, f"{filler} {items[3][1]} {filler}"),
        (None, items[3][1]),
        (14, (" ".join(body[:20]) + " ") * 3000),
        (15, (" ".join(body[:30]) + " ") * 3000),
        (13, ("la " * 200_000) + " ".join(body) + (" lo" * 200_000)),
    ]
    found = leaks(spark, docs, items)
    assert set(found) == {(k, 3) for k in (1, 2, 3, 4, 5, 6, 13, 15)}
    p = found[(2, 3)].passages[0]
    text = docs[1][1]
    assert text[p.start : p.end] == " ".join(body[:36])


def test_blocks_repeats_and_empty_sides(spark, items):
    docs = [(i, t) for i, t in items]
    twice = items + [(100, items[0][1]), (101, None), (None, "x y z"), (102, ""), (103, "Tiny words")]
    want = {(i, i) for i, _ in items} | {(0, 100)}
    assert set(leaks(spark, docs, twice)) == want
    assert set(leaks(spark, docs, twice, block_words=150)) == want
    assert set(leaks(spark, [(1, "some tiny words here")], twice)) == {(1, 103)}
    assert leaks(spark, docs, []) == {} and leaks(spark, [], items) == {}


def test_hits_are_all_phrase_places(items):
    rng = random.Random(9)
    opening = len(STOCK.split())
    known = Items([(i, words_of(t), opening) for i, t in items], share=0.1)
    pool = [w for _, t in items[:3] for w in t.lower().replace("?", "").replace(".", "").split()]
    for _ in range(50):
        at = rng.randrange(len(pool) - 20)
        words = pool[at : at + rng.randint(0, 20)] + rng.sample(pool, 10)
        got = {(i, a, b) for i, hs in known.hits(words).items() for a, b in hs}
        want = {(i, a, b) for i, w in enumerate(known.words) for a in range(len(words) - 2) for b in range(opening, len(w) - 2) if words[a : a + 3] == w[b : b + 3]}
        assert got == want


def opening_words(spark, items):
    return {r.item_id: r.opening for r in prepared_items(frame(spark, [], items)[1]).collect()}


def test_stock_openings_of_any_length(spark, items):
    assert set(opening_words(spark, items).values()) == {len(STOCK.split())}
    rng = random.Random(2)
    long = " ".join(f"w{k}" for k in range(72))
    own = [(i, f"{long} " + " ".join(rng.choice("abcdefgh") + str(rng.randrange(10_000)) for _ in range(4))) for i in range(6)]
    assert set(opening_words(spark, own).values()) == {72}
    docs = [(1, long), (2, own[2][1]), (3, f"{long} and more"), (4, "so it says: " + own[4][1].split("w71 ")[1])]
    assert set(leaks(spark, docs, own)) == {(2, 2), (4, 4)}


@pytest.mark.parametrize("n", [3, 5, 50])
@pytest.mark.parametrize("at", [20, 45, 59])
def test_items_unlike_in_a_word_hide_nothing(spark, items, n, at):
    body = items[0][1].split(". ")[1].rstrip("?").lower().split()
    alike = [(i, " ".join([*body[:at], f"other{i}x", *body[at + 1 :]])) for i in range(n)]
    shared = " ".join([*body[:at], "nothing", *body[at + 1 :]])
    found = leaks(spark, [(1, f"see this {shared} so"), (2, alike[1][1]), (3, " ".join(body[:15]))], [*alike, *items[5:9]])
    assert {k for d, k in found if d == 1} == set(range(n)) == {k for d, k in found if d == 2} and not any(d == 3 for d, _ in found)
    assert min(r.share for r in found.values()) > 0.9
