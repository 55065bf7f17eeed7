import random
import shlex

import pytest

from trigraph.sources.files import read_edgelist, read_triples, read_word_vectors


def write(tmp_path, lines):
    path = tmp_path / "lines.txt"
    path.write_bytes("".join(x + "\n" for x in lines).encode())
    return str(path)


def test_lines_by_shell_rules_fast_or_slow(spark, tmp_path):
    rng = random.Random(7)
    pieces = ["<http://x/y#frag>", "_:b1", "word", '"plain text"', '"q"@en', '"7"^^<int>', '"a\\"b"', "'single one'", "it#s", '" outer "', "é ", "a\\ b", '""', "<a>b", '"x"y', "."]
    blanks = [" ", "\t", "  ", " \t "]
    lines = []
    for _ in range(600):
        terms = [rng.choice(pieces) for _ in range(rng.choice((3, 3, 4, 4, 5)))]
        lines.append(rng.choice(("", " ", "\t")) + "".join(t + rng.choice(blanks) for t in terms[:-1]) + terms[-1] + rng.choice(("", " ", " .")))
    want = [tuple(t.strip() for t in shlex.split(x)[:3]) for x in lines]
    got = [tuple(r) for r in read_triples(spark, write(tmp_path, [*lines, "", "  \t", " "])).collect()]
    assert sorted(got) == sorted(want)


def test_bad_lines_raise(spark, tmp_path):
    for bad in ('a b "open', "a b"):
        with pytest.raises(Exception, match="triple line"):
            read_triples(spark, write(tmp_path, ["a b c", bad])).collect()


def test_words_of_edges_and_vectors(spark, tmp_path):
    path = write(tmp_path, ["\ta b", "c\t\td e ", "", "alone", " f g"])
    assert sorted(tuple(r) for r in read_edgelist(spark, path, "k").collect()) == [("a", "k", "b"), ("c", "k", "d"), ("f", "k", "g")]
    path = write(tmp_path, ["", "short", "a 1 2\t", "\tb 3 4", "c 5 6"])
    assert {r.id: list(r.vec) for r in read_word_vectors(spark, path).collect()} == {"a": [1, 2], "b": [3, 4], "c": [5, 6]}
    assert read_word_vectors(spark, path, 2).count() == 2
