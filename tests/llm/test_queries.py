"""The registered queries: names, contract columns, and the SQL of those that have one."""

import parity
import pytest

from gridmill.llm import queries, sql

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sentencepiece": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op2_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_embeddings": {"vec_id", "n_links", "component_id", "kept"},
    "op5_simhash": {"doc_id", "fingerprint", "component_id"},
    "op6_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op7_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op8_lm_scoring": {"doc_id", "n_tokens", "loss_target", "loss_background", "difference"},
    "op9_mixing": {"doc_id", "source", "mix_slot", "mix_block", "mix_rank"},
    "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
}
TABLE = {"op2_warc": "pages", "op4_embeddings": "embeddings"}


def test_one_query_for_each_operator():
    assert set(queries.queries()) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    found = queries.queries()[name](spark, SF)
    assert COLUMNS[name] <= set(found.columns)
    rows = spark.read.parquet(f"{SF}/{TABLE.get(name, 'documents')}.parquet").count()
    if name == "op7_chat":
        rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() + 1
    assert found.count() == rows


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_sql(spark, name):
    assert parity.compare(spark, SF, name, queries.queries()[name], sql.oracle_sql()[name]) == ""
