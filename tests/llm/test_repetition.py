import glob
import random

import numpy as np
import pytest

from trigraph.llm.hashed import BUCKETS, SIZE, WORD_GRAMS, entries, fit, varied
from trigraph.llm.repetition import LEAST, LIKELY, POSSIBLE, _invented, measure, normal_words, repeated_words, repeats, repetition_grades, self_repeating
from trigraph.llm.text import words_of

UNIQUE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from their old oak tree near our village pond".split()


def share(text):
    w = normal_words(text)
    return repeated_words(w) / max(1, len(w))


def test_measure_of_known_texts():
    sentence = " ".join(UNIQUE[:12])
    assert share(" ".join(UNIQUE)) == 0
    assert share(sentence + ". " + sentence.upper() + "!") == 0.5
    assert share("<p>" + sentence + "</p> 17 [b]" + sentence + "[/b] 18 &amp;" + sentence) > 0.6
    changed = sentence.split()
    changed[5] = "other"
    assert share(sentence + " " + " ".join(changed)) == 0.5
    dropped = UNIQUE[:5] + UNIQUE[6:12]
    assert share(sentence + " " + " ".join(dropped)) == 11 / 23
    assert share("spam " * 50) > 0.9
    assert share(None) == share("") == share("...!") == 0


def test_exact_copies_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        base = [f"w{i}" for i in range(rng.randint(10, 40))]
        at = rng.randrange(len(base) - 8)
        n = rng.randint(LEAST, len(base) - at)
        words = base + ["x1", "y1"] + base[at : at + n] + ["x2", "y2"] + base[at : at + n]
        assert repeated_words(words) == 2 * n
    short = [f"w{i}" for i in range(20)]
    assert repeated_words(short + ["x"] + short[3 : 3 + LEAST - 1]) == 0


def test_whole_table(spark):
    sentence = " ".join(UNIQUE[:12])
    rows = [(1, sentence * 3, 0.0), (2, " ".join(UNIQUE), 1.0), (3, None, 1.0), (4, "", 1.0), (1, sentence * 3, 0.0), (None, sentence * 3, 0.0), (5, "buy now cheap " * 200_000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, repeated_share double")
    assert sorted(r.doc_id for r in self_repeating(df).collect()) == [1, 5]
    got = {r.doc_id: r.repeated_share for r in measure(df).collect()}
    assert got[3] == got[4] == got[2] == 0 and len(got) == 5
    assert measure(df.limit(0)).count() == 0


def test_places_between_the_first_and_the_last_are_followed():
    lead, a, b, c = "as we said".split(), *([f"{x}{i}" for i in range(10)] for x in "abc")
    assert repeated_words(lead + a + lead + b + lead + c + lead + b) == 13


def test_only_tags_are_markup():
    assert words_of("[I quote from the test: one two] [list of three] a <b and\n> c") == "i quote from the test one two list of three a b and c".split()
    tags = '[b]x[/b] [quote=Al Bo, post: 1]y[/quote] [quote author=Al Bo date=3]z[/quote] [img width=3]http://a/b[/img] [hr /] <br/> <a href="u"\n title="v w">q</a>'
    assert words_of(tags) == ["x", "y", "z", "q"]


def test_markup_of_any_length():
    hidden = "a word " * 60_000
    for text in (f"<!--{hidden}-->x y", f"<script>{hidden}</script >x y", f"<b {hidden}>x y", f"[quote={hidden}]x y", f"<a t='{hidden}'\n/>x y", f"http://{'u' * 50_000} x y"):
        assert words_of(text) == ["x", "y"]
    assert words_of("<!-- a <style> b") == ["a", "b"] and words_of("<style>a<!--b</style>c-->") == ["c"]
    assert len(words_of("<!--" * 100_000 + "<script>" * 100_000)) == 0


def test_hashed_entries_against_a_plain_count():
    texts = ["a b c a b c d".split(), [], ["x"], "a b".split()]
    row, bucket, value = entries(texts)
    x = np.zeros((len(texts), SIZE))
    np.add.at(x, (row, bucket), value)
    for t, words in enumerate(texts):
        for k, n in enumerate(WORD_GRAMS):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            again = sum(g in grams[:i] for i, g in enumerate(grams))
            assert x[t, BUCKETS + k] == pytest.approx(again / max(1, len(grams)))
        letters = " ".join(words)
        grams = [letters[i : i + 8] for i in range(len(letters) - 7)]
        assert x[t, BUCKETS + len(WORD_GRAMS)] == pytest.approx(sum(g in grams[:i] for i, g in enumerate(grams)) / max(1, len(grams)))
        assert x[t, -1] == 1


def labelled(texts, seed):
    rows, labels = varied(texts, repeats, seed)
    return rows, np.array(labels)


def test_classifier_on_held_out_rows():
    texts = _invented(300)
    model = fit(*labelled(texts[:200], 1))
    rows, labels = labelled(texts[200:], 2)
    p = model.probabilities(rows)
    assert (p[labels] >= POSSIBLE).all() and (labels == (p >= LIKELY)).mean() > 0.95
    for lo, hi in ((0.0, 0.2), (0.8, 1.0)):  # calibrated
        held = (p >= lo) & (p <= hi)
        assert abs(labels[held].mean() - p[held].mean()) < 0.07
    assert (model.probabilities(rows[:1]) == p[:1]).all() and len(model.probabilities([])) == 0


@pytest.mark.skipif(not glob.glob("/root/testdata/sf0.01/documents.parquet"), reason="no test tables here")
def test_the_classifier_loses_no_post(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {r.doc_id for r in measure(docs).where("repeated_share >= 0.3").collect()}
    assert {r.doc_id for r in self_repeating(docs).collect()} == want and want
    grades = repetition_grades(docs).collect()
    assert len(grades) == docs.count() and want <= {r.doc_id for r in grades if r.grade != "no"}
    assert len({r.doc_id for r in grades if r.grade == "likely"} ^ want) <= 3
