"""Every registered query of the subpackage, and the pipeline, on the smallest tables through the driver's entry."""

import duckdb
import pytest

import __spark_entry__ as entry
from shelfmark.llm import queries

NAMES = [*queries.queries(), "pipeline"]
COLUMNS = {
    "op1_toxicity": "doc_id held_out score predicted",
    "op2_ngram_jaccard_join": "doc_id n_shingles component_id",
    "op3_nearest_neighbours": "query_id rank vec_id score",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op5_token_store": "doc_id start n_tokens ids_crc32",
    "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_sequence_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op9_source_mixing": "doc_id domain lang source n_tokens copies",
    "op10_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "pipeline": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", NAMES)
def test_query_runs_and_has_its_columns(spark, tiny, name):
    df = entry.queries()[name](spark, tiny)
    assert df.columns == COLUMNS[name].split()
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert got
    if name in entry.oracle_sql():
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{tiny}/documents.parquet'")
        rows = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]}) q").fetchall()
        assert got == sorted(map(repr, rows))
