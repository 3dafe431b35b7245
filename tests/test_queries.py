"""Every query with SQL against DuckDB, on the smallest tables."""

import math
import os

import pytest

from tessera import plans

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def oracle():
    made = duckdb.connect()
    for file in os.listdir(DATA):
        made.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return made


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 5) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, oracle, name):
    df = plans.QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in plans.ORACLE_SQL:
        assert rows and plans.QUERIES[name](spark, DATA).exceptAll(df).isEmpty()
        return
    told = oracle.execute(plans.ORACLE_SQL[name])
    columns = [c[0] for c in told.description]
    assert sorted(columns) == sorted(df.columns)
    want = [dict(zip(columns, r)) for r in told.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in sorted(columns)])
    assert sorted(map(key, want)) == sorted(key(r.asDict()) for r in rows)


def test_equal_lines_of_an_order_count_by_their_place(spark, tmp_path):
    """The files' sizes and splits deal rows to tasks in another order than that of the files."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 3000
    (tmp_path / "lineitem.parquet").mkdir()
    for name, copies, status in (("a", 1, "F"), ("b", 3, "O"), ("c", 5, "P")):
        keys = list(range(n)) * copies
        rows = {"l_orderkey": keys, "l_linenumber": [2 + (k % 3 > 0) for k in keys], "l_linestatus": [status] * len(keys), "l_comment": [f"{name} {i * 7919}" for i in range(len(keys))]}
        pq.write_table(pa.table(rows), tmp_path / f"lineitem.parquet/{name}.parquet", row_group_size=1000)
    pq.write_table(pa.table({"o_orderkey": list(range(n)), "o_orderstatus": ["F"] * n}), tmp_path / "orders.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20000)
    try:
        rows = plans.QUERIES["j4_gold_join"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == n and {(r["answer"], r["hit"]) for r in rows} == {("F", True)}


def test_judgements_are_read_once(spark):
    """Sections and lines are found once a row, not for each count and score that names them."""
    plan = plans.QUERIES["f12_f14_judgements"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 4 and plan.count("[Clinically Significant Errors]") == 1, plan
