import pytest
from compare import DATA, duck, duck_rows, spark_rows

from tarnbeck.plans import corpus, general, ingestion, knowledge, retrieval, streams

MODULES = (general, retrieval, knowledge, corpus, ingestion, streams)
SF = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted({k for m in MODULES for k in m.ORACLE}))
def test_query_equals_sql(spark, con, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    sql = next(m.ORACLE[name] for m in MODULES if name in m.ORACLE)
    assert spark_rows(query(spark, str(SF))) == duck_rows(con, sql)


@pytest.mark.parametrize("name", sorted({k for m in MODULES for k in m.QUERIES} - {k for m in MODULES for k in m.ORACLE}))
def test_query_runs(spark, name):
    query = next(m.QUERIES[name] for m in MODULES if name in m.QUERIES)
    assert query(spark, str(SF)).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["ref_table", "ref_field", "ref_id", "reason"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_name_is_used_once():
    names = [k for m in MODULES for k in m.QUERIES]
    assert len(names) == len(set(names))


def test_nothing_imports_the_language_package():
    from pathlib import Path

    root = Path(general.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tarnbeck.llm" not in p.read_text(), p


def test_every_category_is_expanded(spark):
    starts = [r["start"] for r in knowledge.category_expansion(spark, str(SF)).collect()]
    nodes = spark.read.parquet(str(SF / "taxonomy_node.parquet"))
    assert len(starts) == len(set(starts)) and set(starts) == {r["id"] for r in nodes.where("kind = 'category' and id is not null").collect()}
