"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events"
SAMPLE = (
    "p01_build_chunks", "p01_chunks_from_blocks", "w06_best_blocks", "p02_bm25_topk", "p03_cosine_topk", "p04_hybrid",
    "p05_rerank", "j07_phrase_tiers", "p12_locations", "p13_export", "s11_outline", "p10_parse_analyses", "p16_facts",
    "w12_attempt", "j14_citation_documents", "j15_occurrences", "p07_retry", "p17_interaction_log", "a22_analysis_request", "p13_export_with_follow_ups",
    "p14_citations", "w14_sessions", "x02_retention_stream", "s05_responses", "x03_ingest", "o01_global_top", "p06_chat_retrieve", "p17_model_events", "s03_lines", "t07_truncate", "p08_decomposition",
)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    return None if value is None else str(value)


def test_names_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_ranks_passages(spark):
    assert contract.entry(spark).limit(5).count() == 5


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, db, name):
    found = contract.queries()[name](spark, SF)
    result = db.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted([tuple(plain(v) for v in row) for row in result.fetchall()], key=str)
    got = sorted([tuple(plain(row[c]) for c in columns) for row in found.collect()], key=str)
    assert got == want
