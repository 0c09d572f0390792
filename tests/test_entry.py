import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from concord.plans import oracle, queries

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, order):
    def cell(v):
        return "~" if v is None or v != v else f"{round(float(v), 5) + 0.0:.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module", autouse=True)
def shared_scores():
    """Stored scores are made once for all reports here."""
    kept, real = {}, {n: getattr(queries, n) for n in ("scored", "pairs")}
    for n, f in real.items():
        setattr(queries, n, lambda t, n=n, f=f: kept[n] if n in kept else kept.setdefault(n, f(t)))
    yield
    for n, f in real.items():
        setattr(queries, n, f)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_against_sql(spark, duck, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("PythonUDF|Pandas|InArrow|ArrowEval|BatchEval", plan)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(oracle.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert got
    assert plain(got, [df.columns.index(c) for c in names]) == plain(want.fetchall(), [columns.index(c) for c in names])


def test_queries_without_sql(spark, sf_dir):
    for name in set(queries.queries()) - set(oracle.oracle_sql()):
        assert not queries.queries()[name](spark, sf_dir).isEmpty()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_works_without_the_training_data_part(tmp_path):
    for p in ("concord", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    if (tmp_path / "concord" / "llm").exists():
        (tmp_path / "concord" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 59 and not any(n.startswith('op') for n in q); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr


def test_nothing_imports_the_training_data_part():
    for p in (ROOT / "concord").rglob("*.py"):
        if "llm" not in p.parts:
            assert "concord.llm" not in p.read_text()
