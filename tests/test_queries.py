import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
if not os.path.isdir(SF):
    pytest.skip("no test tables here", allow_module_level=True)

from quire.plans.registry import ORACLES, QUERIES  # noqa: E402


def rows(df):
    columns = sorted(df.columns)
    plain = df[columns].astype(object).where(df[columns].notna(), None)
    say = lambda v: str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(int(v)) if isinstance(v, float) and v == int(v) else f"{v:.6f}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(map(say, r)) for r in plain.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLES[name]).df())


# The other queries without SQL lay out the same model; tests/test_document.py holds its tables to books of known content.
@pytest.mark.parametrize("name", ["content_blocks", "lines_from_spans", "phrase_anchors", "sentences"])
def test_query_without_sql_gives_rows_of_a_stable_shape(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.limit(5).collect() is not None


def test_entry_runs_without_the_llm_package(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() >= 0
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
