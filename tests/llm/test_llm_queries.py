"""The registered queries against their SQL, and their contracts' columns."""

import os

import pytest

from sparkquiver.llm.queries import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_shingles component_id", "op2": "doc_id keep_id group_size kept text_sha256", "op3": "doc_id held_out score predicted",
    "op4": "doc_id n_bytes n_tokens over_limit", "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "doc_id size text_crc32 law shard slot grown_shard", "op9": "doc_id held_out score predicted",
    "op10": "doc_id piece start length ids_crc32 sequence_id offset",
}


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert set(COLUMNS.get(name.split("_")[0], "doc_id").split()) <= set(got.columns)
    if name.split("_")[0] not in ("op5", "op10"):
        assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    if name in ORACLES:
        c = duckdb.connect()
        for f in os.listdir(SF):
            c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
        assert rows(got) == rows(c.execute(ORACLES[name]).df())
