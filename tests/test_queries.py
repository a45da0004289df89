import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402

from secondlook.plans.oracles import all_oracles  # noqa: E402
from secondlook.plans.queries import QUERIES  # noqa: E402

# A cross-section; tools/compare.py runs all of them.
SAMPLE = [
    "scan_samples", "sink_labeled_csv", "sink_report", "text_variations", "build_compact_prompt", "parse_response",
    "validate_output", "detect_injection", "assemble_errors", "pii_summary", "cache_lookup", "cache_upsert",
    "dynamic_confusion", "merge_templates", "score_prompts", "review_batch", "audit_run", "stream_audit",
]


def test_every_oracle_has_a_query_and_every_query_an_oracle():
    assert set(all_oracles()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_oracle(spark, con, sf, name):
    ok, info = compare.compare(spark, con, name, sf)
    assert ok, info
