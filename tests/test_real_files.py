"""What real files and sensors bring: doubled headers, dates without leading zeros, mixed alert spellings, nulls in keys, networks of all kinds."""

import datetime as dt
import ipaddress
import json

import pytest
from pyspark.sql import functions as F

from flowsieve.functions import network as N
from flowsieve.functions import times as TM
from flowsieve.operators import correlate, distributed as X, learn, packets as K, predicates, standardize as Z, suppress, triage
from flowsieve.sources import readers


def test_doubled_header_keeps_the_first_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Dst Port, Fwd Header Length,Fwd Header Length, Label\n80,20,99,BENIGN\n")
    assert readers.read_flow_csv(spark, str(tmp_path / "a.csv")).collect() == [("80", "20", "BENIGN")]
    (out,) = readers.corpus_to_parquet(spark, [str(tmp_path / "a.csv")], str(tmp_path / "out"))
    assert spark.read.parquet(out).select("Fwd Header Length").first()[0] == 20.0


def test_corpora_of_one_name_are_kept_apart(spark, tmp_path):
    for folder, port in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "monday.csv").write_text(f"Dst Port,Label\n{port},BENIGN\n")
    out = readers.corpus_to_parquet(spark, [str(tmp_path / f / "monday.csv") for f in "ab"], str(tmp_path / "out"))
    assert [o.rsplit("/", 1)[-1] for o in out] == ["a_monday.parquet", "b_monday.parquet"]
    assert [spark.read.parquet(o).first()["Dst Port"] for o in out] == [1.0, 2.0]


@pytest.mark.parametrize("text, day_first, want", [
    ("7/8/2017 3:30", True, dt.datetime(2017, 8, 7, 3, 30)), ("7/8/2017 3:30", False, dt.datetime(2017, 7, 8, 3, 30)), ("13/7/2017 3:30:05", False, dt.datetime(2017, 7, 13, 3, 30, 5)),
    ("05/07/2017 08:42:42", True, dt.datetime(2017, 7, 5, 8, 42, 42)), ("5/7/2017 1:02:03 PM", True, dt.datetime(2017, 7, 5, 13, 2, 3)), ("2017-07-05T01:02:03", True, dt.datetime(2017, 7, 5, 1, 2, 3)), ("soon", True, None)])
def test_times_of_corpora(spark, text, day_first, want):
    got = spark.createDataFrame([(text,)], "t string").select(F.unix_millis(TM.parse_any("t", day_first))).first()[0]
    assert got == (want and int(want.replace(tzinfo=dt.timezone.utc).timestamp() * 1000))


def test_search_takes_a_backslash_as_it_is(spark):
    columns = ("source_ip", "destination_ip", "snort_msg", "snort_sid", "family", "attack_type", "id", "source_port", "destination_port")
    rows = [(None, None, m, None, None, None, str(i), None, None) for i, m in enumerate(["a\\b", "a%b", "axb", "C:\\"])]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    found = lambda q: sorted(r.id for r in predicates.search(df, q).collect())
    assert found("a\\b") == ["0"] and found("a\\%b") == ["1"] and found("a%b") == ["0", "1", "2"] and found(":\\") == ["3"]


def test_alert_lines_reach_the_flows(spark, tmp_path):
    lines = [
        {"src_addr": "10.0.0.1", "src_port": 1000, "dst_ap": "10.0.0.2:80", "proto": "tcp", "sid": 5, "seconds": 1500000000},
        {"src_ap": "10.0.0.3:53", "dst_addr": "10.0.0.4", "dst_port": "9", "proto": "UDP", "rule": "1:6:1", "timestamp": "17/07/05-09:47:00.250000"},
        {"src_addr": "10.0.0.5", "src_port": 1, "dst_addr": "10.0.0.6", "dst_port": 2, "proto": "TCP", "timestamp": "07/05-09:47:00.000000"},
    ]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    alerts = readers.read_alerts(spark, str(tmp_path), year=2017)
    millis = lambda *t: int(dt.datetime(*t, tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = {r.snort_sid: (r.src_ip, r.src_port, r.dst_ip, r.dst_port, r.protocol, r.alert_ms) for r in alerts.collect()}
    assert got == {5: ("10.0.0.1", 1000, "10.0.0.2", 80, 6, 1500000000000), 6: ("10.0.0.3", 53, "10.0.0.4", 9, 17, millis(2017, 7, 5, 9, 47) + 250), 0: ("10.0.0.5", 1, "10.0.0.6", 2, 6, millis(2017, 7, 5, 9, 47))}
    flows = spark.createDataFrame([("10.0.0.2", "10.0.0.1", 80, 1000, 6, 1500000000500), ("10.0.0.9", "10.0.0.1", 80, 1000, 6, 0)],
                                  "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, bidirectional_first_seen_ms long")
    flows = K.identified(flows)
    assert sorted(r.alert.snort_sid if r.alert else -1 for r in correlate.correlate(flows, alerts).collect()) == [-1, 5]
    turned = alerts.selectExpr("dst_ip AS src_ip", "src_ip AS dst_ip", "dst_port AS src_port", "src_port AS dst_port", "protocol", "alert_ms", "event_id", "snort_sid")
    assert sorted(r.alert.snort_sid if r.alert else -1 for r in correlate.asof_alert(flows, turned).collect()) == [-1, 5]
    assert Z.joinable_alerts(spark.createDataFrame([("junk",)], "value string")).count() == 0


def test_limits_keep_rows_without_a_time_for_any_size(spark):
    times = [dt.datetime(2024, 1, 1, h) if h % 3 else None for h in range(20)]
    df = spark.createDataFrame([(f"i{n:02d}", t) for n, t in enumerate(times)], "id string, flow_timestamp timestamp")
    order = [r.id for r in triage.latest_n(df, 20).collect()]
    assert len(order) == 20 and order[-7:] == [f"i{n:02d}" for n in range(0, 20, 3)]
    for n in (5, 15, 10_000, 10_001):
        assert [r.id for r in triage.latest_n(df, n).collect()] == order[:n]
    capped = triage.cap_results(df.withColumn("source", F.when(F.col("id") < "i05", "confirmed")).withColumn("seq", F.substring("id", 2, 2).cast("long")), 12, "seq")
    assert [r.seq for r in capped.collect()] == list(range(12))


def test_null_keys_are_rows_too(spark):
    df = spark.createDataFrame([(None if i < 4 else "a", None if i % 5 == 0 else f"{i:032x}", i) for i in range(20)], "label string, h string, i int")
    split = learn.stratified_split(df, "label", "h", 25, 25).collect()
    assert len(split) == 20 and sum(r.label is None for r in split) == 4
    assert X.first_n(df, F.col("h"), [F.col("h"), F.col("i")], 2, ["label"]).groupBy("label").count().collect() != []
    assert X.first_n(df, F.col("h"), [F.col("h").asc_nulls_last(), F.col("i")], 100, ["label"]).count() == 20
    scores = spark.createDataFrame([(0.5, 1), (None, 10), (0.9, 2), (0.1, 4)], "x double, n long")
    assert sorted((r.x is None, r.x or 0, r.t) for r in X.running_totals(scores, "x", {"t": "n"}, descending=True, parts=3).collect()) == [(False, 0.1, 7), (False, 0.5, 3), (False, 0.9, 2), (True, 0, 17)]


def test_neighbours_do_not_depend_on_how_rows_are_dealt(spark):
    rng = __import__("random").Random(1)
    rows = [(i, *[1e8 + rng.random() for _ in range(12)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"x{j} double" for j in range(12)))
    names = [f"x{j}" for j in range(12)]
    one = sorted(learn.nearest(df.coalesce(1), "id", names, 3, block=300).collect())
    assert one == sorted(learn.nearest(df.repartition(7), "id", names, 3, block=11).collect()) and len(one) == 900
    exact = lambda i: sorted((sum((a - b) ** 2 for a, b in zip(rows[i][1:], r[1:])), r[0]) for r in rows if r[0] != i)[:3]
    assert all([r.neighbour for r in sorted(one, key=lambda r: r.rank) if r.id == i] == [j for _, j in exact(i)] for i in range(0, 300, 29))
    assert {r.neighbour for r in learn.nearest(df, "id", names, 3, most=10).collect()} <= {r.id for r in df.orderBy(F.xxhash64("id")).limit(10).collect()}


ADDRESSES = ["10.1.2.3", "255.255.255.255", "0.0.0.0", "::1", "::", "fe80::1%eth0", "2001:db8::8:800:200c:417a", "2001:DB8:0:0:8:800:200C:417A", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8", "1::8",
             "1.2.3", "1.2.3.256", "1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "g::1", "12345::", "", "x", None, "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:"]


def test_address_bits_against_the_standard_library(spark):
    def bits(a):
        try:
            ip = ipaddress.ip_address(a.split("%")[0])
            return f"{int(ip):0{ip.max_prefixlen}b}"
        except (ValueError, AttributeError):
            return None

    df = spark.createDataFrame([(i, a) for i, a in enumerate(ADDRESSES)], "i int, a string")
    assert {ADDRESSES[r.i]: r.b for r in df.select("i", N.address_bits("a").alias("b")).collect()} == {a: bits(a) for a in ADDRESSES}


def test_rules_with_masks_and_ipv6(spark):
    now = dt.datetime(2024, 1, 1)
    values = ["10.0.0.0/255.0.0.0", "192.168.0.0/0.0.255.255", "2001:db8::/32", "fe80::1", "172.16.5.0/255.255.0.255", "bad/8", "1.2.3.4/40", "203.0.113.7"]
    rules = spark.createDataFrame([(str(i), "src_cidr", v, now, None) for i, v in enumerate(values)], "id string, kind string, value string, created_at timestamp, expires_at timestamp")
    rows = ["10.9.9.9", "192.168.7.7", "2001:db8:1::5", "fe80::1", "fe80::2", "172.16.5.9", "2001:db9::", "203.0.113.7", None, "junk"]
    df = spark.createDataFrame([(a, 0) for a in rows], "source_ip string, snort_sid int").withColumns(
        {"destination_ip": F.lit("d"), "source_port": F.lit(1), "destination_port": F.lit(2), "protocol": F.lit("TCP")})
    for limit in (suppress.BROADCAST_RULES, 0):
        suppress_limit, suppress.BROADCAST_RULES = suppress.BROADCAST_RULES, limit
        try:
            got = {r.source_ip: r.rule and r.rule.id for r in suppress.match_rules(df, rules, F.lit(now)).collect()}
        finally:
            suppress.BROADCAST_RULES = suppress_limit
        assert got == {"10.9.9.9": "0", "192.168.7.7": "1", "2001:db8:1::5": "2", "fe80::1": "3", "203.0.113.7": "7"} | {a: None for a in ("fe80::2", "172.16.5.9", "2001:db9::", None, "junk")}
