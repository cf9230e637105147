"""Hand-written rows for the rules that are easy to get wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.functions import scoring as S
from flowsieve.operators import analytics as A
from flowsieve.operators import correlate, enrich, predicates, standardize as Z, suppress, triage, verdict

UTC = dt.timezone.utc


def one(df):
    return df.collect()[0]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_verdict_and_overrides(spark):
    base = [(hit, bad, sev, s2) for hit in (True, False) for bad in (True, False) for sev in ("Low", "Medium", "High", None) for s2 in (None, 0.0, 0.5)]
    df = frame(spark, base, "hit boolean, bad boolean, severity string, s2 double")
    d = df.withColumns({
        "alert": F.when(F.col("hit"), F.struct(F.lit(1).alias("x"))), "prediction": F.when(F.col("bad"), "Malicious").otherwise("Normal"), "confidence": F.lit(0.33),
        "stage2_p": F.col("s2"), "stage3_p": F.lit(0.5)})
    for r in verdict.hybrid_verdict(d).collect():
        source = {(True, True): "confirmed", (True, False): "signature_only", (False, True): "ml_only", (False, False): "benign"}[(r.hit, r.bad)]
        assert r.source == source
        product = 0.25 if r.s2 else 0.33
        if source == "confirmed":
            assert (r.prediction, r.confidence, r.severity == "Low") == ("Malicious", product, False)
        elif source == "signature_only":
            assert (r.prediction, r.confidence, r.severity) == ("Malicious", 0.0, "High")
        elif source == "ml_only":
            assert (r.prediction, r.confidence) == ("Suspicious", product)
        else:
            assert (r.prediction, r.confidence) == ("Normal", 0.33)


@pytest.mark.parametrize("value,band", [(0.70, "low"), (0.80, "low"), (0.85, "high"), (0.90, "high"), (0.95, "very_high"), (1.0, "very_high"), (0.1, "low")])
def test_confidence_band(spark, value, band):
    assert one(spark.range(1).select(S.confidence_band(F.lit(value)).alias("b"))).b == band


@pytest.mark.parametrize("s3,s2,sev", [(0.95, 0.90, "High"), (0.95, 0.89, "Medium"), (0.80, 0.70, "Medium"), (0.80, 0.69, "Low"), (0.79, 0.99, "Low")])
def test_severity_limits(spark, s3, s2, sev):
    assert one(spark.range(1).select(S.hierarchical_severity(F.lit(s3), F.lit(s2)).alias("s"))).s == sev


def test_rounding_is_half_up(spark):
    r = one(spark.range(1).select(S.round_to(F.lit(0.12345)).alias("a"), S.round_to(F.lit(0.00005)).alias("b"), S.round_to(F.lit(2.5), 0).alias("c")))
    assert (r.a, r.b, r.c) == (0.1235, 0.0001, 3.0)


def test_best_entry_takes_first_label_on_a_draw(spark):
    r = one(spark.sql("SELECT map('b', 0.4D, 'a', 0.4D, 'c', 0.2D) AS m").select(S.best_entry("m").alias("x"), S.top_entries("m", 2).alias("t")))
    assert (r.x.label, r.x.minus_p) == ("a", -0.4) and [e.key for e in r.t] == ["a", "b"]


def test_flow_key_and_back(spark):
    df = frame(spark, [("10.0.0.1", 1, "10.0.0.2", 2, "6"), ("fe80::1", 443, "::1", 53, "udp"), ("1.1.1.1", 0, "2.2.2.2", 0, "58"), ("a", 1, "b", 2, "tcp")], "s string, sp int, d string, dp int, p string")
    got = df.select(N.flow_key("s", "d", "sp", "dp", "p").alias("k")).collect()
    assert [r.k for r in got] == ["10.0.0.1:1-10.0.0.2:2-TCP", "fe80::1:443-::1:53-UDP", "1.1.1.1:0-2.2.2.2:0-58", "a:1-b:2-TCP"]
    back = df.select(N.parse_flow_key(N.flow_key("s", "d", "sp", "dp", "p")).alias("k")).select("k.*").collect()
    assert [(r.src_ip, r.src_port, r.dst_ip, r.dst_port) for r in back] == [("10.0.0.1", 1, "10.0.0.2", 2), ("fe80::1", 443, "::1", 53), ("1.1.1.1", 0, "2.2.2.2", 0), ("a", 1, "b", 2)]
    for bad in ("nonsense", "a:b-c:d-TCP", "", None):
        r = one(spark.createDataFrame([(bad,)], "k string").select(N.parse_flow_key("k").alias("k"))).k
        assert tuple(r) == ("N/A", "N/A", 0, 0, "TCP")


def test_address_and_port(spark):
    texts = ["1.2.3.4:80", "[::1]:443", "[::1]", "1.2.3.4", "1.2.3.4:http"]
    got = frame(spark, [(t,) for t in texts], "t string").select(N.split_addr_port("t").alias("x")).select("x.*").collect()
    assert [tuple(r) for r in got] == [("1.2.3.4", 80), ("::1", 443), ("::1", 0), ("1.2.3.4", 0), ("1.2.3.4:http", 0)]


@pytest.mark.parametrize("cidr,hits", [
    ("0.0.0.0/0", {"10.1.2.3", "10.1.2.4", "192.168.0.1"}), ("10.0.0.0/8", {"10.1.2.3", "10.1.2.4"}), ("10.1.2.77/24", {"10.1.2.3", "10.1.2.4"}),
    ("10.1.2.3/32", {"10.1.2.3"}), ("fe80::/10", {"fe80::9"}), ("::/0", {"fe80::9"}),
])
def test_cidr(spark, cidr, hits):
    df = frame(spark, [("10.1.2.3",), ("10.1.2.4",), ("192.168.0.1",), ("fe80::9",), ("bad",), ("300.1.1.1",), (None,)], "ip string")
    assert {r.ip for r in df.filter(N.in_cidr("ip", cidr)).collect()} == hits


def test_malformed_cidr_is_an_error(spark):
    with pytest.raises(ValueError):
        N.in_cidr("ip", "10.0.0.0/99")
    with pytest.raises(ValueError):
        suppress.check_cidr("nonsense")


def test_private_addresses(spark):
    cases = {"10.0.0.1": True, "172.16.0.1": True, "172.31.255.1": True, "172.32.0.1": False, "192.168.1.1": True, "127.0.0.1": True, "169.254.1.1": True, "::1": True, "fe80::1": True, "8.8.8.8": False, "": True}
    got = frame(spark, [(k,) for k in cases], "ip string").select("ip", N.is_private_ip("ip").alias("p")).collect()
    assert {r.ip: r.p for r in got} == cases


def test_cleaning(spark):
    df = frame(spark, [("Infinity", float("nan"), "x"), ("-Infinity", float("inf"), None), ("NaN", 1.5, ""), ("", None, "y"), ("abc", 2.0, "z"), (None, 0.0, "z"), ("4.5", -1.0, "z")],
               "`Flow Duration` string, other double, note string")
    got = Z.clean(df).collect()
    assert [r["Flow Duration"] for r in got] == [0, 0, 0, 0, 0, 0, 4.5]
    assert [r.other for r in got] == [0, 0, 1.5, 0, 2, 0, -1] and [r.note for r in got] == ["x", None, "", "y", "z", "z", "z"]


def test_alert_lines(spark):
    lines = [
        '{"src_addr":"1.1.1.1","src_port":5,"dst_addr":"2.2.2.2","dst_port":80,"proto":"tcp","sid":7,"msg":"m","class":"c","priority":3,"action":"allow","timestamp":"t"}',
        '{"src_ap":"1.1.1.1:5","dst_ap":"[::1]:443","rule":"1:2001:3"}', '{"src_addr":"1.1.1.1","src_port":"x","dst_addr":"2.2.2.2"}', '{"src_addr":"1.1.1.1"}',
        '{"src_addr":"1.1', "", "   ", '{"dst_ap":"1.1.1.1:5"}', '{"src_ap":"1.1.1.1:5","dst_ap":"2.2.2.2:6","rule":"broken"}',
    ]
    got = Z.normalize_alerts(frame(spark, [(x,) for x in lines], "value string")).collect()
    assert [r.flow_key for r in got] == ["1.1.1.1:5-2.2.2.2:80-TCP", "1.1.1.1:5-::1:443-TCP", "1.1.1.1:0-2.2.2.2:0-TCP", "1.1.1.1:5-2.2.2.2:6-TCP"]
    assert [r.snort_sid for r in got] == [7, 2001, 0, 0] and got[0].snort_priority == 3 and got[1].snort_msg == ""


RULE = "id string, kind string, value string, hits long, created_at timestamp, expires_at timestamp"
PRED = "id string, snort_sid int, source_ip string, destination_ip string, source_port int, destination_port int, protocol string"
T0 = dt.datetime(2024, 1, 1)


def rule(i, kind, value, day=1, expires=None):
    return (i, kind, value, 0, dt.datetime(2024, 1, day), expires)


def test_suppression_order(spark):
    p = frame(spark, [("p", 5, "10.0.0.1", "b", 1, 2, "TCP")], PRED)
    as_of = F.to_timestamp(F.lit("2024-02-01"))
    every = [rule("sid", "sid", "5"), rule("key", "flow_key", "10.0.0.1:1-b:2-TCP"), rule("ip", "src_ip", "10.0.0.1"), rule("net", "src_cidr", "10.0.0.9/8")]
    for i in range(4):
        got = one(suppress.match_rules(p, frame(spark, every[i:], RULE), as_of))
        assert got.rule.id == every[i][0]
    gone = [rule("old", "sid", "5", expires=dt.datetime(2024, 1, 5))]
    assert one(suppress.match_rules(p, frame(spark, gone, RULE), as_of)).rule is None
    two = [rule("a", "sid", "5", 1), rule("b", "sid", "5", 9)]
    assert one(suppress.match_rules(p, frame(spark, two, RULE), as_of)).rule.id == "b"
    nets = [rule("wide", "src_cidr", "10.0.0.0/8", 3), rule("narrow", "src_cidr", "10.0.0.0/24", 2), rule("bad", "src_cidr", "10.0.0.0/77", 9), rule("host", "src_cidr", "10.0.0.1", 1)]
    assert one(suppress.match_rules(p, frame(spark, nets, RULE), as_of)).rule.id == "wide"
    assert suppress.suppress(p, frame(spark, two, RULE), as_of).count() == 0
    hits = {r.id: r.hits for r in suppress.rule_hits(p, frame(spark, two, RULE), as_of).collect()}
    assert hits == {"a": 0, "b": 1}


def test_enrichment(spark):
    leaves = [leaf for leaf in fixed.LEAVES if leaf != fixed.BENIGN]
    data = [("Malicious", 0.9, leaf) for leaf in leaves] + [("Malicious", 0.9, "New"), ("Malicious", 0.9, None), ("Suspicious", 0.9, "Bot"), ("Malicious", 0.69, "Bot"), ("Normal", 0.99, None)]
    df = frame(spark, data, "prediction string, confidence double, attack_type string")
    got = enrich.enrich_attack(df, enrich.default_kb(spark)).collect()
    by = {(r.prediction, r.confidence, r.attack_type): r.mitre for r in got}
    for leaf in leaves:
        m = by[("Malicious", 0.9, leaf)]
        assert m.tactics and m.techniques and not m.unmapped and m.confidence_band == "high"
    stub = by[("Malicious", 0.9, "New")]
    assert stub.unmapped and stub.attack_type == "New" and stub.tactics == []
    assert all(by[k] is None for k in [("Malicious", 0.9, None), ("Suspicious", 0.9, "Bot"), ("Malicious", 0.69, "Bot"), ("Normal", 0.99, None)])
    bot = by[("Malicious", 0.9, "Bot")]
    assert [t.name for t in bot.tactics] == ["Command and Control", "Impact"] and [t.id for t in bot.techniques] == ["T1071", "T1571", "T1498"]


def test_unknown_label_stops_the_job(spark):
    df = frame(spark, [("Bot",), ("Nope",)], "label string")
    with pytest.raises(Exception, match="label without family"):
        enrich.with_family(df).collect()
    assert [r.family for r in enrich.with_family(df, strict=False).collect()] == ["BotnetInfiltration", None]


def test_anomalies(spark):
    def hours(values):
        return frame(spark, [(T0 + dt.timedelta(hours=i), v) for i, v in enumerate(values)], "hour timestamp, malicious_only long")

    assert A.anomalies(hours([1, 2, 1, 2, 1, 99])).count() == 0
    assert A.anomalies(hours([5] * 7 + [99])).count() == 0
    got = A.anomalies(hours([1, 2, 1, 2, 1, 2, 50])).collect()
    assert len(got) == 1 and got[0].value == 50 and got[0].z == pytest.approx((50 - 1.5) / 0.5)


def preds(spark, pairs):
    return frame(spark, [(str(i), a, b, "DoS", "Malicious") for i, (a, b) in enumerate(pairs)], "id string, source_ip string, destination_ip string, family string, prediction string")


def test_attackers_and_victims(spark):
    df = preds(spark, [("a", "b")] * 3 + [("b", "a")] * 1 + [("c", "d"), ("d", "c")] + [("e", "e")] * 2 + [("f", "a")])
    assert {r.ip: r["count"] for r in A.attackers(df).collect()} == {"a": 4, "c": 2, "e": 2, "f": 1}
    assert {r.ip: r["count"] for r in A.victims(df).collect()} == {"b": 4, "d": 2, "e": 2, "a": 1}
    rev = {(r.source_ip, r.destination_ip): (r["count"], r.reverse_count) for r in A.with_reverse(df).collect()}
    assert rev[("a", "b")] == (3, 1) and rev[("b", "a")] == (1, 3) and rev[("f", "a")] == (1, 0) and ("a", "f") not in rev


def queue(spark, n):
    return frame(spark, [(f"p{i:03d}", T0 + dt.timedelta(minutes=i // 3), ["High", "Low", None][i % 3], ["DoS", None][i % 2], "ml_only") for i in range(n)],
                 "id string, flow_timestamp timestamp, severity string, family string, source string")


@pytest.mark.parametrize("sort,way", [("time", "desc"), ("severity", "desc"), ("family", "asc"), ("family", "desc"), ("source", "asc"), ("time", "asc")])
def test_pages_have_no_gaps_or_repeats(spark, sort, way, monkeypatch):
    df = queue(spark, 57)
    whole = [r.id for r in triage.page(df, sort, way, 1000, 0).collect()]
    assert len(whole) == 57
    near = [r.id for o in range(0, 57, 10) for r in triage.page(df, sort, way, 10, o).collect()]
    monkeypatch.setattr(triage, "DEEP", 0)
    deep = [r.id for o in (0, 20, 40) for r in triage.page(df, sort, way, 20, o).collect()]
    assert near == whole and deep == whole


def test_page_limits(spark):
    df = queue(spark, 5)
    assert triage.page(df, limit=0).count() == 1 and triage.page(df, limit=5000).count() == 5
    assert triage.page(df, offset=99).count() == 0 and triage.page(df, offset=-3).count() == 5


def test_trend_states(spark):
    cur = frame(spark, [("a", 5), ("b", 0), ("c", 1000), ("d", 12), ("e", 7)], "measure string, value long")
    pri = frame(spark, [("a", 0), ("b", 0), ("c", 1005), ("d", 10), ("e", 10)], "measure string, value long")
    got = {r.measure: (r.state, r.label) for r in A.trend(cur, pri).collect()}
    assert got == {"a": ("new", "new"), "b": (None, None), "c": ("≈", "≈"), "d": ("up", "+20%"), "e": ("down", "-30%")}


def test_ack_back_to_new_counts_as_backlog(spark):
    df = frame(spark, [("new", T0 + dt.timedelta(hours=1)), ("reviewed", T0 + dt.timedelta(hours=2)), ("new", None)], "ack_state string, ack_at timestamp").withColumn("flow_timestamp", F.lit(T0))
    r = one(A.kpis(df, F.lit(T0 + dt.timedelta(hours=5))))
    assert (r.mtta_seconds, r.backlog, r.oldest_unacked_seconds, r.acked) == (7200.0, 2, 18000.0, 1)


def test_modes(spark):
    df = frame(spark, [("confirmed", "m", 7, 0.5), ("signature_only", "m", 7, None), ("ml_only", "", 0, 0.5), ("benign", "", 0, 0.5)], "source string, snort_msg string, snort_sid int, stage2_p double")
    assert sorted(r.source for r in Z.apply_mode(df, "hybrid").collect()) == ["benign", "confirmed", "ml_only", "signature_only"]
    ml = Z.apply_mode(df, "ml").collect()
    assert sorted(r.source for r in ml) == ["benign", "ml_only", "ml_only"] and all(r.snort_sid == 0 and r.snort_msg == "" for r in ml)
    sn = Z.apply_mode(df, "snort").collect()
    assert sorted(r.source for r in sn) == ["benign", "signature_only", "signature_only"] and all(r.stage2_p is None for r in sn)


def test_duplicate_column_names_keep_the_first(spark):
    df = spark.range(1).select(F.lit(1).alias("Fwd Header Length"), F.lit(2).alias(" Fwd Header Length.1 "), F.lit(3).alias("Max Packet Length"))
    got = Z.normalize_columns(df)
    assert got.columns == ["Fwd Header Length", "Packet Length Max"] and one(got)[0] == 1


def test_down_up_ratio_without_forward_packets(spark):
    df = frame(spark, [(0, 5), (4, 2)], "src2dst_packets long, dst2src_packets long").withColumns({c: F.lit(0) for c in ("bidirectional_duration_ms", "bidirectional_bytes", "bidirectional_packets", "bidirectional_stddev_ps")})
    assert [r.down_up_ratio for r in Z.derive_live(df).collect()] == [0.0, 0.5]
    assert [r["Down/Up Ratio"] for r in Z.to_features(df).collect()] == [5.0, 0.5]


def test_private_fields_of_the_range_filters(spark):
    df = frame(spark, [(T0,), (T0 - dt.timedelta(hours=1),), (T0 - dt.timedelta(hours=2),), (T0 - dt.timedelta(hours=3),)], "flow_timestamp timestamp")
    as_of = F.lit(T0)
    assert predicates.in_range(df, "1h", as_of).count() == 2 and predicates.prior_window(df, "1h", as_of).count() == 1
    assert predicates.prior_window(df, "all", as_of) is None and predicates.in_range(df, "unknown", as_of).count() == 4


def test_correlation_prefers_the_forward_key(spark):
    flows = frame(spark, [("f", "a", "b", 1, 2, 6), ("g", "b", "a", 2, 1, 6), ("h", "x", "y", 1, 1, 6)], "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int")
    alerts = frame(spark, [(1, "a", "b", 1, 2, 6, 50), (2, "b", "a", 2, 1, 6, 10), (3, "y", "x", 1, 1, 6, 5), (4, "a", "b", 1, 2, 6, 40)], "event_id int, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, alert_ms long")
    both = {r.flow_id: r.alert.event_id for r in correlate.correlate(flows, alerts).collect()}
    assert both == {"f": 4, "g": 2, "h": 3}
    fwd = {r.flow_id: r.alert and r.alert.event_id for r in correlate.correlate(flows, alerts, bidirectional=False, keep="last").collect()}
    assert fwd == {"f": 1, "g": 2, "h": None}
