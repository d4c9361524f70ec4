"""The corpus queries that SQL can express give DuckDB's rows."""

import pytest
from oracle import same

from lexiforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, name):
    assert same(queries.QUERIES[name](spark, sf), queries.ORACLE[name], sf) is None


def test_quality_contract(spark, sf):
    df = queries.QUERIES["op5_quality_classifier"](spark, sf)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_schemas(spark, sf):
    kinds = {k: dict(queries.QUERIES[k](spark, sf).dtypes) for k in ("op2_exact_top_k", "op6_nearest_neighbours", "op9_sharding", "op10_packing")}
    assert kinds["op2_exact_top_k"] == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    assert kinds["op6_nearest_neighbours"] == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert kinds["op9_sharding"] == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    assert kinds["op10_packing"] == {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
