"""The registered queries: columns of their contracts, and their SQL where they have it."""

import os

import duckdb
import pytest

from tests.test_oracles import DATA, TABLES, plain
from tidemark.llm import pii, quality, queries, sharding

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op2_repeated_passages": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op3_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op4_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op5_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op6_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op8_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_personal_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op13_alignment": {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"},
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, DATA)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    ids = [r["doc_id"] for r in df.collect()]
    assert sorted(ids) == sorted(r["doc_id"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 7, 8.0, "y", 3)], "doc_id long, text string, spans string, slot long, score double, law string, size int")
    assert sharding.shard(df).columns == ["doc_id", "text", "spans", "score", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.shard(df).first()["size"] == 21
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.score(df, quality.fit(df, none))
    assert scored.columns == ["doc_id", "text", "spans", "slot", "law", "size", "score", "predicted"] and scored.first()["score"] == 0.5
    found = pii.find_personal_data(df)
    assert found.columns.count("spans") == 1 and found.first()["spans"] == ""
