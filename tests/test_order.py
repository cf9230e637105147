"""Order-dependent helpers, flow building and quotas against plain Python, with hot keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators import correlate, learn, packets as K, triage
from flowsieve.operators import distributed as X

PACKET = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int, ts_ms long, length int, flags int, packet_id long"


def make_packets(seed, n=400, span=400_000, hot=0.4):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        a, b = ("10.0.0.1", "10.0.0.2") if rnd.random() < hot else (f"10.0.1.{rnd.randint(1, 4)}", f"10.0.2.{rnd.randint(1, 4)}")
        if rnd.random() < 0.4:
            a, b = b, a
        port = {True: (1000, 80), False: (80, 1000)}[a.startswith("10.0.0.1") or a.startswith("10.0.1")]
        flags = rnd.choice([2, 16, 16, 16, 24, 24, 17, 4]) if rnd.random() < 0.3 else 16
        out.append((a, b, *port, rnd.choice([6, 6, 17]), 1_704_067_200_000 + rnd.randint(0, span // 100) * 100, rnd.choice([40, 60, 600, 1500]), flags, i))
    return out


def brute_flows(packets, idle, active, close):
    """Flows by walking each conversation in time; simultaneous packets belong together."""
    conv = defaultdict(lambda: defaultdict(list))
    for p in packets:
        fwd = (p[0], p[1], p[2], p[3])
        rev = (p[1], p[0], p[3], p[2])
        conv[(min(fwd, rev), p[4])][p[5]].append(p)
    flows = []
    for (key, proto), times in conv.items():
        current = None
        for ts in sorted(times):
            if current and (ts - current["last"] >= idle or current["closed"] or (active is not None and ts - current["start"] >= active)):
                flows.append(current)
                current = None
            if current is None:
                lead = min(times[ts], key=lambda p: (p[6], p[7], (p[0], p[1], p[2], p[3]) != key))
                current = {"start": ts, "src": lead[0], "dst": lead[1], "n": 0, "bytes": 0, "fwd": 0, "closed": False, "proto": proto}
            current["last"] = ts
            for p in times[ts]:
                current["n"] += 1
                current["bytes"] += p[6]
                current["fwd"] += p[0] == current["src"]
            current["closed"] = close and proto == 6 and any(p[7] & 5 for p in times[ts])
        flows.append(current)
    return sorted((f["src"], f["dst"], f["proto"], f["start"], f["last"], f["n"], f["bytes"], f["fwd"]) for f in flows)


def flow_tuples(df):
    return sorted((r.src_ip, r.dst_ip, r.protocol, r.bidirectional_first_seen_ms, r.bidirectional_last_seen_ms, r.bidirectional_packets, r.bidirectional_bytes, r.src2dst_packets) for r in df.collect())


@pytest.mark.parametrize("idle,active,close,limit,support", [
    (30_000, None, False, 100, None), (30_000, None, True, 100, 2.0), (30_000, 10_000, True, 100_000, 0.1), (30_000, 10_000, False, 0, 0.1), (5_000, 20_000, False, 20, 0.2),
    (30_000, 45_000, True, 0, 0.001), (30_000, 10_000, True, 0, 2.0), (30_000, 45_000, False, 0, 2.0)])
def test_flows(spark, idle, active, close, limit, support):
    """``support`` decides which conversations count as hot: all of them, one, or none."""
    data = make_packets(idle + (active or 0))
    df = spark.createDataFrame(data, PACKET)
    got = K.build_flows(df, idle, active, close, fold_limit=limit, with_gaps=False, support=support)
    assert flow_tuples(got) == brute_flows(data, idle, active, close)


@pytest.mark.parametrize("active", [None, 40_000])
def test_hot_and_cold_conversations_give_the_same_records(spark, active):
    df = spark.createDataFrame(make_packets(9, n=500, span=9_000_000), PACKET)
    both = [sorted(map(str, K.build_flows(df, 600_000, active, True, support=s).collect())) for s in (0.001, 2.0)]
    assert both[0] == both[1]


def test_idle_gap_on_the_limit_starts_a_flow(spark):
    data = [("a", "b", 1, 2, 17, t, 40, 0, t) for t in (0, 29_999, 59_999, 59_999 + 29_999)]
    got = K.build_flows(spark.createDataFrame(data, PACKET), 30_000, None, False, with_gaps=False)
    assert [(f[3], f[5]) for f in flow_tuples(got)] == [(0, 2), (59_999, 2)]


def test_flow_gap_statistics(spark):
    data = [("a", "b", 1, 2, 17, 0, 40, 0, 1), ("b", "a", 2, 1, 17, 1000, 60, 0, 2), ("a", "b", 1, 2, 17, 4000, 80, 0, 3)]
    r = K.build_flows(spark.createDataFrame(data, PACKET), 30_000, 10_000, True).collect()[0]
    assert (r.src_ip, r.bidirectional_mean_piat_ms, r.bidirectional_min_piat_ms, r.src2dst_mean_piat_ms, r.dst2src_mean_piat_ms) == ("a", 2000.0, 1000.0, 4000.0, 0.0)
    assert (r.src2dst_bytes, r.dst2src_bytes, r.src2dst_mean_ps, r.bidirectional_duration_ms, r.src2dst_duration_ms) == (120, 60, 60.0, 4000, 4000)


def test_previous_with_hot_key(spark):
    rnd = random.Random(3)
    data = [("hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 40)}", rnd.randint(0, 20_000), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, ts long, i long")
    got = {r.i: r.prev_i for r in X.previous_by_time(df, ["k"], "ts", ["i"], ["i"], width=5000, hot_width=100).collect()}
    want = {}
    by = defaultdict(list)
    for k, ts, i in sorted(data, key=lambda r: (r[1], r[2])):
        want[i] = by[k][-1] if by[k] else None
        by[k].append(i)
    assert got == want


def test_previous_overall_with_equal_times(spark):
    data = [(t, f"{i:04d}") for i, t in enumerate([5, 5, 5, 100_000, 100_000, 400_000, 7] * 20)]
    got = {r.id: r.prev_ts for r in X.previous_overall(spark.createDataFrame(data, "ts long, id string"), "ts", "id").collect()}
    want, last = {}, None
    for t, i in sorted(data):
        want[i], last = last, t
    assert got == want


def test_trailing_counts(spark):
    rnd = random.Random(5)
    data = [("s" if rnd.random() < 0.6 else "t", rnd.randint(0, 30_000)) for _ in range(500)]
    got = {(r.k, r.ts): r.in_window for r in X.trailing_counts(spark.createDataFrame(data, "k string, ts long"), "ts", 5000, ["k"]).collect()}
    assert got == {(k, t): sum(1 for k2, t2 in data if k2 == k and t - 5000 <= t2 <= t) for k, t in set(data)}


def test_first_n_and_rank(spark):
    data = [(i * 37 % 1000, i) for i in range(500)]
    df = spark.createDataFrame(data, "v long, id long")
    for n in (0, 1, 7, 250, 499, 500, 900):
        got = sorted(r.id for r in X.first_n(df, F.floor(F.col("v") / 100), [F.col("v"), F.col("id")], n).collect())
        assert got == sorted(i for _, i in sorted(data)[:n])
        twice = X.first_n(df, F.floor(F.col("v") / 100), [F.col("v"), F.col("id")], n, finer=[F.floor(F.col("v") / 10), F.col("v")])
        assert sorted(r.id for r in twice.collect()) == got
    keyed = X.first_n(df.withColumn("k", F.col("id") % 3), F.floor(F.col("v") / 100), [F.col("v"), F.col("id")], 50, ["k"], [F.floor(F.col("v") / 10)])
    assert sorted(r.id for r in keyed.collect()) == sorted(i for k in range(3) for _, i in sorted(d for d in data if d[1] % 3 == k)[:50])
    levels = [(F.floor(F.col("v") / 100), [F.col("_bucket")]), (F.floor(F.col("v") / 10), [F.col("_bucket")])]
    for low, high in ((1, 1), (250, 260), (480, 900), (600, 700)):
        got = X.ranked_slice(df, levels, [F.col("v"), F.col("id")], low, high).orderBy("rank").collect()
        assert [(r.v, r.id) for r in got] == sorted(data)[low - 1 : high] and [r["rank"] for r in got] == list(range(low, min(high, 500) + 1))
    ranked = X.global_rank(df, F.floor(F.col("v") / 100), [F.col("v"), F.col("id")])
    assert {r.id: r["rank"] for r in ranked.collect()} == {i: k + 1 for k, (_, i) in enumerate(sorted(data))}


def test_running_totals(spark):
    data = [(float(v), v % 3, 1) for v in range(300)]
    got = X.running_totals(spark.createDataFrame(data, "x double, p long, q long"), "x", {"sp": "p", "sq": "q"}, descending=True, parts=7).collect()
    assert {r.x: (r.sp, r.sq) for r in got} == {x: (sum(d[1] for d in data if d[0] >= x), sum(1 for d in data if d[0] >= x)) for x, _, _ in data}


def test_hot_values_finds_every_frequent_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    assert X.hot_values(df, "v", 0.05) == [-1]


def brute_quota(packets, quotas, target):
    used, out, total = defaultdict(int), [], 0
    for ts, pid, w, size in sorted(packets):
        if w is None or used[w] + size > quotas[w]:
            continue
        if total + size > target:
            break
        used[w] += size
        total += size
        out.append(pid)
    return sorted(out)


@pytest.mark.parametrize("seed,target", [(1, 10**9), (2, 9000), (3, 4000), (4, 10)])
def test_quota_sample(spark, seed, target):
    rnd = random.Random(seed)
    data = [(rnd.randint(0, 300_000), i, rnd.choice([0, 0, 0, 1, 2, None]), rnd.choice([40, 60, 200, 600, 1500])) for i in range(300)]
    quotas = {0: 5000, 1: 2000, 2: 100}
    p = spark.createDataFrame(data, "ts_ms long, packet_id long, window_ord int, length int").withColumn("window", F.col("window_ord").cast("string"))
    w = spark.createDataFrame(list(quotas.items()), "ord int, quota_bytes long")
    got = sorted(r.packet_id for r in K.quota_sample(p, w, target).collect())
    assert got == brute_quota(data, quotas, target)


@pytest.mark.parametrize("splits", [1, 8])
def test_interval_join_with_hot_key(spark, splits):
    rnd = random.Random(11)
    key = lambda: ("h", "d", 1, 2, 6) if rnd.random() < 0.5 else (f"s{rnd.randint(0, 9)}", "d", 1, 2, 6)
    flows = [(f"f{i}", *key(), rnd.randint(0, 600_000)) for i in range(200)]
    alerts = [(i, *key(), rnd.randint(0, 600) * 1000) for i in range(80)]
    fd = spark.createDataFrame(flows, "flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, first_seen_ms long")
    ad = spark.createDataFrame(alerts, "event_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, alert_ms long")
    got = correlate.interval_correlate(fd, ad, support=0.05, splits=splits).collect()
    want = {}
    for f in flows:
        c = [(a[6], a[0]) for a in alerts if a[1:6] == f[1:6] and f[6] - 60_000 <= a[6] <= f[6] + 2_500]
        want[f[0]] = max(c)[1] if c else None
    assert {r.flow_id: r.alert and r.alert.event_id for r in got if r.flow_id} == want
    alone = {(a[1:6], a[6]) for a in alerts if not any(a[1:6] == f[1:6] and f[6] - 60_000 <= a[6] <= f[6] + 2_500 for f in flows)}
    assert {((r.src_ip, r.dst_ip, r.src_port, r.dst_port, r.protocol), r.alert.alert_ms) for r in got if r.flow_id is None} == alone


def test_overlapping_windows_take_the_first(spark):
    w = spark.createDataFrame([("late", 1000, 5000, 1), ("first", 4000, 9_000_000, 0), ("point", 500, 500, 2)], "name string, start_ms long, end_ms long, ord int")
    p = spark.createDataFrame([(t,) for t in (499, 500, 501, 1000, 3999, 4000, 5000, 8_999_999, 9_000_000, 9_000_001)], "ts_ms long")
    got = {r.ts_ms: r.window for r in correlate.label_by_window(p, w).collect()}
    assert got == {499: None, 500: "point", 501: None, 1000: "late", 3999: "late", 4000: "first", 5000: "first", 8_999_999: "first", 9_000_000: "first", 9_000_001: None}


def test_nearest_in_blocks_is_exact(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, a double, b double")
    got = defaultdict(list)
    for r in learn.nearest(df, "id", ["a", "b"], 3, block=17).orderBy("id", "rank").collect():
        got[r.id].append(r.neighbour)
    for i, a, b in pts:
        want = sorted((((a - x) ** 2 + (b - y) ** 2), j) for j, x, y in pts if j != i)[:3]
        assert got[i] == [j for _, j in want]


def test_oversampling_fills_every_class(spark):
    data = [(i, "big" if i < 40 else "small" if i < 47 else "tiny", float(i % 7), float(i)) for i in range(50)]
    df = spark.createDataFrame(data, "id long, label string, a double, b double")
    out = learn.oversample(df, "id", ["a", "b"], block=20)
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {"big": 40, "small": 40, "tiny": 40}
    low, high = out.filter("label = 'tiny'").agg(F.min("b"), F.max("b")).first()
    assert low >= 47 and high <= 49


def test_feature_selection(spark):
    df = spark.range(200).select(F.col("id").alias("ident"), (F.col("id") % 13).cast("double").alias("x"), ((F.col("id") % 13) * 2 + 1).cast("double").alias("y"), F.lit(4.0).alias("c"), (F.col("id") % 7).cast("double").alias("z"))
    assert learn.select_features(df, ["ident", "x", "y", "c", "z"], ["ident"]) == ["x", "z"]


def test_related_and_campaigns(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    data = [(f"p{i:02d}", t0 + dt.timedelta(seconds=i), "a", "b", 1, 2, "TCP", "DoS" if i % 2 else None) for i in range(30)] + [("solo", t0, "x", "y", 1, 2, "TCP", "DoS")]
    df = spark.createDataFrame(data, "id string, flow_timestamp timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, family string")
    got = defaultdict(list)
    for r in triage.related(df).orderBy("id", "position").collect():
        got[r.id].append(r.related_id)
    assert set(got) == {f"p{i:02d}" for i in range(30)} and got["p29"] == [f"p{i:02d}" for i in range(28, 18, -1)] and got["p00"] == [f"p{i:02d}" for i in range(29, 19, -1)]
    view = triage.campaign_view(df, samples=5).collect()
    by = {(r.source_ip, r.family): r for r in view}
    assert by[("a", None)]["count"] == 15 and by[("a", None)].sample_ids == ["p28", "p26", "p24", "p22", "p20"] and by[("a", "DoS")].newest.id == "p29"


def test_a_hierarchy_reads_its_training_rows_a_few_times(spark):
    """Every fit passes over its rows again and again; the plan behind them must not run each time."""
    families = list(fixed.LEAVES_OF_FAMILY.items())
    read = spark.sparkContext.accumulator(0)
    data = [(i, (leaves := families[i % len(families)][1])[i // 6 % len(leaves)], float(i % 13), float(i % 5)) for i in range(600)]

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    train = spark.createDataFrame([(i, "Benign" if i % 7 == 0 else leaf, a, b) for i, leaf, a, b in data], "id long, label string, a double, b double").mapInPandas(counted, "id long, label string, a double, b double")
    model = learn.fit_hierarchy(train, ["a", "b"], trees=2, depth=2)
    assert set(model.leaf) == {name for name, leaves in families if len(leaves) > 1}
    assert read.value <= 600 * 10
