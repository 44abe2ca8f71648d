"""The registered queries run and give their columns."""

from __future__ import annotations

import pytest

from sievelight.llm.queries import QUERIES

COLUMNS = {
    "op1": {"query_id", "rank", "vec_id", "score"},
    "op2": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op3": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op4": {"doc_id", "held_out", "lang_pred", "score"},
    "op5": {"doc_id", "size", "source_size", "target", "taken"},
    "op6": {"doc_id", "n_shingles", "component_id"},
    "op7": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op8": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
    "op10": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op11": {"doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"},
    "op12": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op13": {"doc_id", "n_lines", "n_dropped", "kept_sha256"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, name):
    assert COLUMNS[name.split("_")[0]] <= set(QUERIES[name](spark, "/root/testdata/sf0.001").columns)
