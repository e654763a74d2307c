"""The registered queries on a small table: contracts, SQL, and the pipeline."""

import os
import zlib

import pytest

from tidemark.llm import decontamination, quality_rules, queries, secret_scan
from tidemark.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
COLUMNS = {
    "op1_simhash": "doc_id fingerprint component_id", "op2_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op3_quality_rank": "doc_id held_out score predicted",
    "op4_token_files": "doc_id start n_tokens ids_crc32", "op5_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op6_decontamination": "doc_id item_id", "op7_language_id": "doc_id held_out lang_pred score",
    "op8_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset", "op10_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, name):
    df = queries.queries()[name](spark, DATA)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    rows = df.collect()
    n = table(spark, DATA, "documents").count()
    if name not in ("op6_decontamination", "op8_chat_format", "op9_packing"):
        assert len(rows) == n and len({r.doc_id for r in rows}) == n
    if "held_out" in df.columns:
        of, rest = (4, 2) if name.startswith("op3") else (5, 0)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % of == rest) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want, got = c.sql(queries.oracle_sql()[name]).df(), queries.queries()[name](spark, DATA).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) and sorted(map(tuple, got[columns].values)) == sorted(map(tuple, want[columns].values))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = table(spark, DATA, "documents")
    bench = table(spark, DATA, "benchmark")
    kept = {r.doc_id for r in quality_rules.judged(docs.select("doc_id", "text"), references=quality_rules.learned(docs)).filter("kept").collect()}
    found = docs
    left = []
    for name, stage in pipeline.STAGES[:-1]:
        found = spark.createDataFrame(stage(spark, found, DATA).collect(), docs.schema)
        assert found.columns == docs.columns, name
        left.append({r.doc_id for r in found.select("doc_id").collect()})
    assert left[0] == kept and left[1] < left[0] and left[2] <= left[1] and left[3] == left[2]
    assert decontamination.overlaps(found, bench).count() == 0
    assert all(r.text == secret_scan.masked(r.text) and r.n_chars == len(r.text) for r in found.collect())
    packed = pipeline.STAGES[-1][1](spark, found, DATA).collect()
    assert {r.doc_id for r in packed} == left[3]
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in pipeline.run(spark, DATA).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
