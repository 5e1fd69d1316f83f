"""The registered queries over a whole small folder of tables: contract columns first, every row judged."""

import os

import pytest

from lodestore.llm.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")

COLUMNS = {
    "op1_line_dedup": "doc_id bigint, source string, text string, n_lines bigint, n_removed bigint",
    "op2_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op3_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op4_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_license_scans": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean",
    "op7_histogram_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op8_sentencepiece_codec": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op9_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, text string, passage_text string",
    "op10_embedding_near_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op11_merkle_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12_conversation_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, longest bigint, longest_at bigint",
}


@pytest.mark.parametrize("name", QUERIES)
def test_columns_and_rows(spark, name):
    got = QUERIES[name](spark, SF_DIR)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == COLUMNS[name]
    source = {"op2_url_filters": "pages", "op10_embedding_near_dedup": "embeddings", "op12_conversation_trie": "conversations"}.get(name, "documents")
    ids = sorted(r[0] for r in spark.read.parquet(f"{SF_DIR}/{source}.parquet").select(got.columns[0]).collect())
    found = sorted(r[0] for r in got.select(got.columns[0]).collect())
    if name.startswith("op12"):
        assert set(found) <= set(ids) and got.where("depth = 0").count() == 1
        return
    assert sorted(set(found)) == ids if name.startswith("op3") else found == ids
