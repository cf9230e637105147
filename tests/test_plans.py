"""What the plans must look like: no per-row Python, filters and columns at the scan, bounded broadcasts."""

import re

import pytest

from flowsieve.operators import correlate, enrich, learn, packets as K, predicates, suppress, triage
from flowsieve.plans import driver_tables as D
from flowsieve.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a03_verdict_breakdown", "a11_hourly", "a14_technique_counts", "f03_cidr", "j04_interval_correlate", "j05_suppress", "j12_label_by_window", "p02_to_features",
                                  "p16_normalize_alerts", "p17_format_predictions", "st1_flows_idle", "w02_campaign_view", "w10_iat_stats", "m12_auc"])
def test_no_python_in_the_plan(spark, sf, name):
    text = plan(registry.runner(name)(spark, sf))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_only_needed_columns_are_read(spark, sf):
    text = plan(registry.runner("a03_verdict_breakdown")(spark, sf))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert read == {"o_orderkey:bigint,o_custkey:bigint", "event_id:bigint,event_type:string"} or all("totalprice" not in r and "props" not in r for r in read)


def test_correlation_shuffles_the_flows_once(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(correlate.correlate(D.flows(spark, sf), D.alerts(spark, sf).drop("o")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = text.count("SortMergeJoin") + text.count("ShuffledHashJoin")
    # one for the correlation, one inside the derived alerts
    assert joins == 2 and text.count("Exchange hashpartitioning(k_ip1") == 2


def test_knowledge_base_is_broadcast_because_of_its_size(spark, sf):
    text = plan(enrich.enrich_attack(D.judged(spark, sf), enrich.default_kb(spark)))
    assert "BroadcastHashJoin [_leaf" in text


def test_rule_joins_are_equi_joins(spark, sf):
    text = plan(suppress.match_rules(D.fresh_predictions(spark, sf), D.rules(spark, sf), D.as_of()))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_cold_flows_need_one_shuffle(spark, sf):
    p = D.packets(spark, sf)
    before = plan(p).count("Exchange hashpartitioning")
    text = plan(K.build_flows(p, active_ms=None, support=2.0))
    assert text.count("Exchange hashpartitioning(k_ip1") == 1 and text.count("Exchange hashpartitioning") == before + 1


def test_time_filter_reaches_the_scan(spark, sf, tmp_path):
    path = str(tmp_path / "q")
    D.fresh_predictions(spark, sf).drop("mitre").write.parquet(path)
    text = plan(predicates.in_range(spark.read.parquet(path).select("id", "flow_timestamp"), "7d", D.as_of()))
    assert "PushedFilters: [IsNotNull(flow_timestamp), GreaterThanOrEqual(flow_timestamp" in text and "ReadSchema: struct<id:string,flow_timestamp:timestamp>" in text


def stored(spark, sf, path):
    D.fresh_predictions(spark, sf).drop("mitre").write.parquet(path)
    return spark.read.parquet(path)


def test_a_deep_page_ranks_only_its_own_rows(spark, sf, tmp_path):
    q = stored(spark, sf, str(tmp_path / "q"))
    offset = q.count() // 2
    assert offset > 20
    whole = [r.id for r in q.orderBy(q.flow_timestamp.desc(), "id").select("id").collect()]
    before, triage.DEEP = triage.DEEP, 0
    try:
        page = triage.page(q, limit=20, offset=offset)
    finally:
        triage.DEEP = before
    assert [r.id for r in page.collect()] == whole[offset : offset + 20]
    text = plan(page)
    window = text.split("Window [row_number()", 1)[1]
    # rows are shuffled once, for the last ranking, behind the broadcast of the buckets that reach into the page
    assert text.count("BroadcastHashJoin [coalesce(_before") >= 2 and "BroadcastHashJoin" in window and "NestedLoop" not in text


def test_all_tiers_are_counted_in_one_scan(spark, sf, tmp_path):
    q = stored(spark, sf, str(tmp_path / "q"))
    f = q.family
    tiers = {"all": (f.isNotNull(), f, q.source), "none": (f == "no such", f, q.source), "some": (q.source == "ml_only", f, f)}
    out = learn.tier_results(q, tiers)
    assert plan(out).count("FileScan parquet") == 1
    rows = {r.tier: r for r in out.collect()}
    assert set(rows) == set(tiers) and rows["none"]["rows"] is None and rows["none"].classes == 0
    for name, (where, truth, pred) in tiers.items():
        if name != "none":
            one = learn.summary(learn.report(learn.confusion(q.filter(where).select(truth.alias("t"), pred.alias("p")), "t", "p"))).first()
            assert {k: rows[name][k] for k in one.asDict()} == one.asDict()


def test_a_page_of_campaigns_ranks_only_their_rows(spark, sf, tmp_path):
    text = plan(triage.campaign_view(stored(spark, sf, str(tmp_path / "q")), samples=5, limit=3))
    ranked = text.split("Window [row_number()", 1)[1]
    assert "LeftSemi, BuildRight" in ranked.split("FileScan parquet", 1)[0]
