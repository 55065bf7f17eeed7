import importlib
import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def test_entry_imports_without_a_session_or_training_operators():
    code = "import sys; sys.modules['trigraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q04_three_hop_bag' in q and 'p1_found' in q and 'p8_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert done.returncode == 0, done.stderr


def test_nothing_imports_the_training_subpackage():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "trigraph")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "trigraph.llm" not in text.read(), f


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_every_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    entry = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    sql = entry.oracle_sql()
    for name, query in entry.queries().items():
        if name in sql:
            df = query(spark, DATA)
            got = [tuple(r) for r in df.collect()]
            want = con.execute(sql[name]).fetchall()
            columns = [c[0] for c in con.description]
            assert sorted(columns) == sorted(df.columns), name
            assert _normal(got, df.columns) == _normal(want, columns), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).columns == ["id"]
