"""Registered queries against their DuckDB oracles on the smallest data set."""

import decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from callsift.sources.fixtures import TABLES

from conftest import SF_SMALL

FAST = ["leaderboard", "analysis_validate", "json_cut", "score_coerce", "turns_parse", "call_duration",
        "transcript_hash", "list_view", "search_documents", "detail_labels", "latency_percentiles",
        "latency_telemetry", "eval_fields", "eval_dimensions", "score_anchor", "prompt_messages", "cache_hits",
        "dedup_by_hash", "payload_pick", "upload_defaults", "ingest_summary", "upsert_calls", "apply_edits",
        "edit_quarantine", "rules_extraction", "rules_scores", "rules_stage_action", "rules_text", "analysis_json",
        "change_feed", "store_cache_hits", "apply_typed_edits", "typed_edit_quarantine", "call_detail", "list_sorted_all", "list_filters",
        "list_text_order", "calls_jsonl", "reason_truncate_long", "telemetry_cost", "rules_reasons", "rules_gazetteer", "search_indexed"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def canon(cols, rows):
    def n(v):
        if isinstance(v, float | decimal.Decimal):
            return round(float(v), 9)
        return v
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(n(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    df = queries()[name](spark, SF_SMALL)
    res = duck.execute(oracle_sql()[name])
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    want = canon([d[0] for d in res.description], res.fetchall())
    assert got == want


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() >= 1 and "avg_score" in df.columns
