import pytest

import __spark_entry__ as contract
import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_each_operator_is_registered_once():
    names = [n.split("_")[0] for n in contract.queries() if n.startswith("op")]
    assert sorted(names) == sorted(f"op{i}" for i in range(1, 14)) and "pipeline" in contract.queries()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert name == "sentencepiece" or docs.columns == columns
    assert docs.filter("NOT exact").count() == 0


@pytest.mark.parametrize("name", ["op3_mixing", "op11_collocations", "op13_sharding"])
def test_twins(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = contract.queries()[name](spark, SF)
    found = con.execute(contract.oracle_sql()[name])
    names = [d[0] for d in found.description]
    want = sorted(tuple(row[names.index(c)] for c in df.columns) for row in found.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
