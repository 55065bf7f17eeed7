import glob
import random

import pytest
from pyspark.sql import functions as F

from trigraph.llm.mixing import FEASIBLE, _knots, allot, due_time, feasible_total, mix_boards, mix_sources

FLAT = [(0.0, 1.0), (1.0, 1.0)]


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_allot():
    assert allot({"a": 0.5, "b": 0.5}, {"a": 100, "b": 100}, {"a": 1, "b": 1}, 100) == {"a": 50, "b": 50}
    assert allot({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, {"a": 2, "b": 1, "c": 1}, 120) == pytest.approx({"a": 20, "b": 60, "c": 40})
    assert allot({"a": 0.5, "b": 0.5}, {"a": 10}, {"a": 1, "b": 3}, 1000) == {"a": 10, "b": 0}
    assert allot({}, {}, {}, 5) == {}


def test_the_largest_feasible_mix_meets_all_shares(spark):
    assert feasible_total({"a": 0.5, "b": 0.5}, {"a": 10, "b": 100}, {"a": 3, "b": 1}) == 60
    assert feasible_total({"a": 0.5, "b": 0.5}, {"a": 10}, {"a": 3, "b": 1}) == 30 and feasible_total({}, {}, {}) == 0
    rows = [(i, "abc"[i % 3], 1 + i % 7) for i in range(3000)] + [(9000 + i, "d", 3) for i in range(40)]
    mix = mix_sources(sizes(spark, rows), targets(spark, [("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.3, 1), ("d", 0.1, 2)]), FEASIBLE)
    report = {r.source: r for r in mix.report.collect()}
    assert all(r.feasible_tokens == 2400 and abs(r.actual_share - r.target_share) < 0.01 for r in report.values())
    assert report["d"].mix_tokens == 240


def test_shares_repeats_and_order(spark):
    rng = random.Random(1)
    rows = [(i, "big", rng.randint(1, 50)) for i in range(3000)] + [(10_000 + i, "small", rng.randint(1, 50)) for i in range(300)] + [(20_000 + i, "tiny", 10) for i in range(5)] + [(30_000, "other", 10), (30_001, "big", 0)]
    t = targets(spark, [("Big ", 0.6, 1), ("small", 0.3, 4), ("tiny", 0.1, 3), ("gone", 0.0, 1), (None, 0.5, 1)])
    mix = mix_sources(sizes(spark, rows), t, total_tokens=40_000)
    got = mix.rows.collect()
    before = 0
    for r in sorted(got, key=lambda r: (r.position, r.due, r.source, r.doc_id)):
        assert r.position == before
        before += r.tokens
    assert [r.due for r in sorted(got, key=lambda r: r.position)] == sorted(r.due for r in got)
    assert len({(r.doc_id, r.copy) for r in got}) == len(got)
    per = {}
    for r in got:
        per[r.source] = per.get(r.source, 0) + r.tokens
    assert per["tiny"] == 150 and max(r.copy for r in got if r.source == "tiny") == 2
    rest = 40_000 - 150
    assert abs(per["big"] - rest * 2 / 3) < 60 and abs(per["small"] - rest / 3) < 60
    report = {r.source: r for r in mix.report.collect()}
    assert report["big"].actual_share == pytest.approx(per["big"] / sum(per.values())) and report["gone"].mix_tokens == 0 and len(report) == 4
    early = sum(r.tokens for r in got if r.due < 0.25 and r.source == "big")
    assert abs(early / per["big"] - 0.25) < 0.01


def test_schedules_are_inverted_exactly(spark):
    points = [(0.0, 0.0), (0.3, 2.0), (0.3, 0.5), (0.8, 0.5), (1.0, 3.0)]
    knots = _knots(points)

    def integral(t):
        a = 0.0
        for (u, w, _, k), end in zip(knots, [x[0] for x in knots[1:]] + [1.0]):
            d = min(t, end) - u
            if d > 0:
                a += w * d + k * d * d / 2
        return a

    rows = [(i / 200, knots) for i in range(201)]
    df = spark.createDataFrame(rows, "d double, knots array<struct<t:double,w:double,a:double,k:double>>")
    for r in df.select("d", due_time(F.col("d"), F.col("knots")).alias("t")).collect():
        assert integral(r.t) == pytest.approx(r.d, abs=1e-9)
    for bad in ([(0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0)], [(0.0, -1.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            _knots(bad)


def test_a_hot_source_is_spread_and_late_ramp_comes_late(spark):
    rows = [(i, "a", 1) for i in range(50_000)] + [(60_000 + i, "b", 1) for i in range(1000)]
    t = targets(spark, [("a", 0.5, 1), ("b", 0.5, 20)])
    mix = mix_sources(sizes(spark, rows), t, 30_000, {"b": [(0.0, 0.0), (1.0, 2.0)]}).rows
    share = mix.where("due < 0.5").groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in share}
    assert abs(n["a"] - 7500) < 20 and abs(n["b"] - 3750) < 20


def test_empty_inputs_and_bad_targets(spark):
    empty = sizes(spark, [])
    assert mix_sources(empty, targets(spark, [("a", 1.0, 1)])).rows.count() == 0
    assert mix_sources(sizes(spark, [(1, "a", 3)]), targets(spark, [])).rows.count() == 0
    with pytest.raises(ValueError):
        mix_sources(empty, targets(spark, [("a", 1.0, 1), ("a", 0.5, 1)]))


@pytest.mark.skipif(not glob.glob("/opt/tokenizers/byte_bpe_50k.json"), reason="no tokenizer here")
def test_boards_with_a_tokenizer(spark):
    docs = spark.createDataFrame([(1, "hello world", "A b", 1), (2, None, "a  B ", 1), (3, "x " * 50_000, "a b", 1), (4, "hi", None, 1), (1, "hello world", "A b", 1)], "doc_id long, text string, source string, tokens int")
    mix = mix_boards(docs, targets(spark, [("a b", 1.0, 1)]), "/opt/tokenizers/byte_bpe_50k.json")
    got = {r.doc_id: r.tokens for r in mix.rows.collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] >= 50_000 and 4 not in got


def test_the_mix_query_varies_weights_over_time(monkeypatch):
    from trigraph.llm import queries

    passed = []
    monkeypatch.setattr(queries, "_mix", lambda spark, sf_dir, **rules: passed.append(rules) or type("M", (), {"rows": None}))
    queries.p7_mix(None, "")
    assert passed[0]["total_tokens"] == FEASIBLE
    assert any(len({w for _, w in steps}) > 1 for steps in passed[0]["schedules"].values())
