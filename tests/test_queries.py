"""A selection of the registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHOSEN = [
    "inspect_battles", "merge_dedup", "conversation_first_turns", "hash_split", "length_gap", "code_stats", "bank_rows", "span_summaries", "win_relevance", "label_inconsistency",
    "bias_screen", "region_contrast", "diagnose_pool_contrast", "head_to_head", "elicitation", "feature_mi", "winning_prevalence", "omissions", "holdout_buckets", "validate_scores",
    "top_pairs", "parse_presence", "parse_concept_result", "merge_union", "shuffled_names", "label_mapping",
    "split_reliability", "lens_metrics", "lens_encode_jump", "lens_encode_topk", "prompt_names",
]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "labels", "conversations"):
        con.sql(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    rel = duck.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == names
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    want = sorted((tuple(plain(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
