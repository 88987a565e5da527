"""The registered queries against DuckDB where SQL can say them, and what they return."""

import pytest
from oracle import compare, connect
from sheetlake.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_toxicity": "doc_id held_out score predicted", "op4_nearest_vectors": "query_id rank vec_id score",
    "op5_mix_sources": "doc_id size source_size target taken", "op6_personal_data": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op7_pack_documents": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op9_simhash_near_dedup": "doc_id fingerprint component_id",
    "op10_license_scan": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op11_shingle_join": "doc_id n_shingles component_id", "op12_importance_resampling": "doc_id n_features weight score rank",
    "op13_centroid_clusters": "vec_id cluster distance cluster_inertia inertia centroid_sha256"}


@pytest.mark.parametrize("key", list(ORACLES))
def test_query_matches_oracle(spark, key):
    assert compare(spark, connect(FOLDER), QUERIES[key], ORACLES[key], FOLDER) is None


@pytest.mark.parametrize("key", list(COLUMNS))
def test_columns(spark, key):
    result = QUERIES[key](spark, FOLDER)
    assert result.columns == COLUMNS[key].split()
    kinds = {"score": "double", "rank": "int"} if key != "op12_importance_resampling" else dict.fromkeys(result.columns, "bigint")
    assert all(kind == kinds.get(name, kind) for name, kind in result.dtypes)


def test_one_query_per_operator():
    import __spark_entry__ as contract

    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14)) and set(QUERIES) | {"pipeline"} <= set(contract.queries())
