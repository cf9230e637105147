"""Registered queries against DuckDB on the same tables. TEST_ALL_QUERIES=1 runs every query, otherwise a selection."""

import os

import duckdb
import pytest

from flowsieve.plans import registry
from flowsieve.plans.check import TABLES, _rows

ORACLES = registry.oracles()
CHOSEN = [
    "a03_verdict_breakdown", "a07_pairs", "a08_attackers", "a11_hourly", "a15_kpis", "a19_ack_log", "f03_cidr", "f09_auto_widen", "j01_rows", "j02_alert_last",
    "j03_asof_alert", "j04_interval_correlate", "j05_suppress", "j08_ack_trail", "j09_related", "j12_label_by_window", "j15_trend", "m01_stratified_split",
    "m12_auc", "m13_tier_results", "o01_page_deep", "o04_hard_cap", "p02_to_features", "p14_parse_flow_key", "p16_normalize_alerts", "p23_validate",
    "snk4_export_rows", "st1_flows_idle_active", "u02_dedup", "w01_anomalies", "w02_campaign_view", "w06_cap_benign", "w07_event_gaps", "w09_rate_rule", "w10_iat_stats",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("TEST_ALL_QUERIES") else CHOSEN)
def test_matches_sql(spark, sf, con, name):
    df = registry.runner(name)(spark, sf)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_names_are_unique_and_complete():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 140
