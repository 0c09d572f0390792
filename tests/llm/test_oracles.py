import duckdb
import pytest

from concord.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in df.select(*columns).collect()) == key(want.fetchall())


def test_url_filter_against_sql_with_links(spark, tmp_path):
    """The given pages have few links between hosts; these have many."""
    import random

    rng = random.Random(1)
    hosts = [f"{a}.{b}" for a in ("x", "y", "z.w", "q") for b in ("example.com", "example.net", "b.org", "c.io")]
    rows = []
    for i in range(300):
        links = " ".join(f"<a href='HTTPS://{rng.choice(hosts).upper()}/p'>" for _ in range(rng.randrange(4)))
        rows.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['en'] * 8 + ['de', 'es'])}/{rng.choice(['7', '8', '9', '9'])}", links))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op2_url_filter(spark, str(tmp_path)).collect())
    want = sorted(con.execute(queries.oracle_sql()["op2_url_filter"]).fetchall())
    assert list(map(str, got)) == list(map(str, want))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}
