import pytest

from clarifex.llm.queries import ORACLES, QUERIES
from tests.duck import connection, rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(connection(SF).execute(ORACLES[name]).df())


def test_columns_and_rows(spark):
    want = {
        "op1_mixing": {"doc_id", "size", "source_size", "target", "taken"},
        "op3_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op5_token_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
        "op8_simhash": {"doc_id", "fingerprint", "component_id"},
        "op9_quality": {"doc_id", "held_out", "score", "predicted"},
    }
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for name, columns in want.items():
        df = QUERIES[name](spark, SF)
        assert columns <= set(df.columns) and sorted(r.doc_id for r in df.collect()) == ids, name
    assert len(QUERIES) == 10 and {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 11)}
