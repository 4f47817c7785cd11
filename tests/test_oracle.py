"""A cross-section of the registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import checks
from checks.run import TABLES, rows_of

checks.load_all()
SF = "/root/testdata/sf0.001"
NAMES = ["b1b_timestamps_multi", "b6_masked_lines", "c1_time_window", "e1_quality_gate_windowed", "e3_route_layer",
         "d2_correlate_tokens", "d3_correlate_types", "d5_cascades_types", "e5_anomalies_tokens", "e6_anomalies_types",
         "e7_incidents_lines", "e8_incidents_types", "e12_settings_issues", "f1_templates_exact", "e9_tfidf_keywords_by_language",
         "h1_minhash", "h11_compress_text", "h6_merge_chunks", "i5_find_similar_records", "d14_fuse_locations", "m3_score_candidates",
         "d8_g3_symbolicate", "d9_map_js_frames", "k5_regressions", "b9b_context_keywords", "l3_stream_incidents", "l6_stream_regressions"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(checks.SQL) <= set(checks.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = checks.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(checks.SQL[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())
