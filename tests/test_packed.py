import random
import re

from trigraph.operators.packed import unpack

SCHEMA = "book_id long, authors string, pos int, author string"


def run(spark, texts, **options):
    rows = [(i, t, 7, "clash") for i, t in enumerate(texts)]
    out = {}
    for r in unpack(spark.createDataFrame(rows, SCHEMA), **options).orderBy("book_id", "pos").collect():
        out.setdefault(r.book_id, []).append(r.author)
        assert r.pos == len(out[r.book_id])
    return [out.get(i, []) for i in range(len(texts))]


def test_rules(spark):
    texts = [
        "A B, C D",
        '"Smith, John"; «Roe & Co»|\'Doe, J.\' / “X, Y”',
        'Al "Bo" Cy, Di',
        '"Al ""Bo"" Cy" and Di',
        "Anderson and Sandy AND Andy",
        "One, and Two, & Three\tFour",
        "Solo",
        "",
        None,
        "  , ;; ",
        "Trail; ",
        '"open, B',
        "O'Neil, D'Arcy",
        '"A, B" C, D',
        "Al Bo, PhD; Cy Di, Jr., Ed Fo, Junior",
    ]
    want = [
        ["A B", "C D"],
        ["Smith, John", "Roe & Co", "Doe, J.", "X, Y"],
        ['Al "Bo" Cy', "Di"],
        ['Al "Bo" Cy', "Di"],
        ["Anderson", "Sandy", "Andy"],
        ["One", "Two", "Three", "Four"],
        [],
        [],
        [],
        [],
        [],
        ['"open', "B"],
        ["O'Neil", "D'Arcy"],
        ['"A', 'B" C', "D"],
        ["Al Bo, PhD", "Cy Di, Jr.", "Ed Fo", "Junior"],
    ]
    assert run(spark, texts) == want


def test_single_values_repeats_and_empty_input(spark):
    df = spark.createDataFrame([(1, "Solo", 1, ""), (1, "Solo", 2, ""), (None, "A, B", 1, ""), (2, "X;X", 1, "")], SCHEMA)
    assert sorted(map(tuple, unpack(df, only_packed=False).collect())) == [(1, 1, "Solo"), (2, 1, "X"), (2, 2, "X")]
    assert unpack(df.limit(0)).count() == 0


def test_long_texts(spark):
    n = 20_000
    many = run(spark, [", ".join(f"N{i}" for i in range(n)), '"' * 30_001, "x" * 500_000 + ";y", '"' + "a, " * 50_000 + '"; b'])
    assert [len(m) for m in many] == [n, 0, 2, 2]


def test_round_trip_of_random_values(spark):
    rng = random.Random(5)
    texts, want = [], []
    for _ in range(300):
        values = ["".join(rng.choice("ab c,;&'x") for _ in range(rng.randint(1, 9))).strip() for _ in range(rng.randint(2, 5))]
        values = [v for v in values if v]
        packed = "; ".join('"' + v.replace('"', '""') + '"' for v in values)
        texts.append(packed)
        want.append(values if len(values) > 1 else [])
    assert run(spark, texts) == want
    assert not any(re.search('"', v) for vs in want for v in vs)


def test_control_characters_stay(spark):
    assert run(spark, ["a\x01b, c\x02a", '"x,\x02b\x01", \x02']) == [["a\x01b", "c\x02a"], ["x,\x02b\x01", "\x02"]]
