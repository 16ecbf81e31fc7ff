"""Every text query has SQL that gives its rows, or a module of brute-force tests."""

from pathlib import Path

import pytest
from compare import database, differences

import __spark_entry__
from plumbline.llm.oracle import ORACLE
from plumbline.llm.queries import QUERIES

BRUTE = {
    "op1_fingerprints": "test_fingerprints",
    "op2_suffix_dedup": "test_suffixes",
    "op3_licences": "test_licences_tokens",
    "op5_ngram_join": "test_ngram_join",
    "op7_token_counts": "test_licences_tokens",
    "op8_quality": "test_quality",
    "op9_personal_data": "test_pii",
    "op10_pack": "test_packing",
    "op12_whitening": "test_whitening",
    "op13_byte_bpe": "test_bpe",
}


def test_every_query_is_compared():
    assert set(QUERIES) == set(ORACLE) | set(BRUTE) and not set(ORACLE) & set(BRUTE)
    assert set(__spark_entry__.queries()) >= {*QUERIES, "pipeline"}
    for module in BRUTE.values():
        assert (Path(__file__).parent / f"{module}.py").exists()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, folder, name):
    assert differences(QUERIES[name](spark, folder), database(folder), ORACLE[name]) == []
