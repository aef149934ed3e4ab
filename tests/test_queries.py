import pytest

from clarifex.queries import ORACLES, QUERIES
from tests.duck import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    got = rows(QUERIES[name](spark, SF).toPandas())
    if name in ORACLES:
        assert got == rows(connection(SF).execute(ORACLES[name]).df())
    else:
        assert got[1]


def test_filled_columns_have_no_gaps(spark):
    for name in QUERIES:
        if name.startswith("impute_") and name not in ORACLES:
            df = QUERIES[name](spark, SF)
            assert not df.where(" or ".join(f"{c} is null" for c in df.columns)).take(1), name


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "blueprint_orders" in e.queries()


def test_nothing_else_imports_the_corpus_operators():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "clarifex"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "clarifex.llm" in p.read_text()]
