"""Streams against the batch operators on the same rows."""

import pytest
from pyspark.sql import functions as F

from flowsieve.operators import correlate, enrich
from flowsieve.plans import driver_tables as D
from flowsieve.sources import readers
from flowsieve.streaming import flow_builder as B
from flowsieve.streaming import live as L
from tests.test_order import PACKET, brute_flows, flow_tuples, make_packets

KEYS = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"
FLOW = f"flow_id string, {KEYS}, first_seen_ms long"
ALERT = f"event_id long, {KEYS}, alert_ms long, snort_sid int, snort_msg string, snort_classtype string, snort_priority int"
END = 4 * 10**12


def write_steps(df, ts, path, files):
    """Input in several files in order of time, as a capture would deliver it."""
    rows = sorted(df.collect(), key=lambda r: r[ts])
    size = max(1, -(-len(rows) // files))
    for i in range(0, len(rows), size):
        df.sparkSession.createDataFrame(rows[i:i + size], df.schema).coalesce(1).write.mode("append").parquet(path)


def drain(stream, checkpoint, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert not q.isActive
    return q


def sides(spark, seed=1):
    import random

    rnd = random.Random(seed)
    key = lambda: (f"s{rnd.randint(0, 5)}", "d", 1, 2, 6)
    flows = [(f"f{i}", *key(), 1_704_067_200_000 + rnd.randint(0, 400) * 1000) for i in range(40)]
    alerts = [(i, *key(), 1_704_067_200_000 + rnd.randint(0, 400) * 1000, 7, "m", "c", 1) for i in range(30)]
    # limits of the hold times, and a key that only alerts know
    t = 1_704_067_300_000
    flows += [("e1", "x", "d", 1, 2, 6, t), ("e2", "y", "d", 1, 2, 6, t), ("e3", "z", "d", 1, 2, 6, t)]
    alerts += [(100, "x", "d", 1, 2, 6, t - 60_000, 7, "m", "c", 1), (101, "y", "d", 1, 2, 6, t + 2_501, 7, "m", "c", 1), (102, "z", "d", 1, 2, 6, t + 2_500, 7, "m", "c", 1), (103, "only", "d", 1, 2, 6, t, 7, "m", "c", 1)]
    return spark.createDataFrame(flows, FLOW), spark.createDataFrame(alerts, ALERT)


def pairs(rows):
    return sorted(((r.flow_id, r.src_ip, r.alert and r.alert.event_id) for r in rows), key=repr)


class Sink(list):
    """Rows by batch, replaced when a batch is stored again; late rows apart."""

    def __init__(self):
        self.batches, self.late = {}, {}

    def __call__(self, rows, late, batch_id):
        self.batches[batch_id] = rows.collect()
        if late is not None:
            self.late[batch_id] = late.collect()

    def all(self):
        return [r for b in self.batches.values() for r in b]


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def join_run(spark, tmp_path, parts, lateness_ms, sink, finish=True):
    """Feeds (flows, alerts) part by part; the stream is started anew for each."""
    fp, ap, cp, held = (str(tmp_path / n) for n in ("f", "a", "c", "held"))
    put(spark, [], FLOW, fp)
    put(spark, [], ALERT, ap)
    for flows, alerts in parts:
        put(spark, flows, FLOW, fp)
        put(spark, alerts, ALERT, ap)
        job = L.live_join(spark, held, sink, lateness_ms=lateness_ms)
        stream = L.sides(readers.stream_flows(spark, fp, schema=spark.createDataFrame([], FLOW).schema), readers.stream_flows(spark, ap, schema=spark.createDataFrame([], ALERT).schema))
        job.start(stream, cp, {"availableNow": True}).awaitTermination(240)
    if finish:
        job.finish()
        job.finish()  # a repeated end changes nothing
    return job


def test_correlation_equals_batch_and_survives_restarts(spark, tmp_path):
    flows, alerts = sides(spark)
    want = pairs(correlate.interval_correlate(flows, alerts).collect())
    f, a = (sorted(d.collect(), key=lambda r: r[6]) for d in (flows, alerts))
    cut = lambda rows, k: [r for i, r in enumerate(rows) if i * 3 // len(rows) == k]
    sink = Sink()
    join_run(spark, tmp_path, [(cut(f, k), cut(a, k)) for k in range(3)], 400_000, sink)
    assert pairs(sink.all()) == want and not sink.late and len(sink.batches[0]) < len(want)
    shuffled = Sink()
    join_run(spark, tmp_path / "again", [(f[k::3], a[k::3]) for k in range(3)], 500_000, shuffled)
    assert pairs(shuffled.all()) == want and not shuffled.late


def test_late_rows_come_out_on_their_own(spark, tmp_path):
    t = 1_704_067_200_000
    flow = lambda i, s: (f"f{i}", "s", "d", 1, 2, 6, t + s * 1000)
    alert = lambda i, s: (i, "s", "d", 1, 2, 6, t + s * 1000, 7, "m", "c", 1)
    sink = Sink()
    parts = [([flow(1, 100), flow(2, 500)], [alert(1, 90), alert(2, 500)]), ([flow(3, 489), flow(4, 490), flow(5, 900)], [alert(3, 489), alert(4, 491), alert(5, 900)])]
    join_run(spark, tmp_path, parts, 10_000, sink)
    assert {(r.flow_id, r.alert and r.alert.event_id) for r in sink.late[1]} == {("f3", None), (None, 3)}
    assert {(r.flow_id, r.alert and r.alert.event_id) for r in sink.all()} == {("f1", 1), ("f2", 2), ("f4", 4), ("f5", 5)}


class Replacing(Sink):
    """A sink whose batches replace all of the batch, its late rows too."""

    def __call__(self, rows, late, batch_id):
        self.batches[batch_id] = rows.collect()
        self.late[batch_id] = [] if late is None else late.collect()


def test_late_rows_of_the_last_batch_survive_the_end(spark, tmp_path):
    t = 1_704_067_200_000
    flow = lambda i, s: (f"f{i}", "s", "d", 1, 2, 6, t + s * 1000)
    alert = lambda i, s: (i, "s", "d", 1, 2, 6, t + s * 1000, 7, "m", "c", 1)
    sink = Replacing()
    parts = [([flow(1, 100), flow(2, 500)], [alert(1, 90), alert(2, 500)]), ([flow(3, 200), flow(5, 900)], [alert(3, 300), alert(5, 900)])]
    join_run(spark, tmp_path, parts, 10_000, sink)
    assert {(r.flow_id, r.alert and r.alert.event_id) for r in sink.late[1]} == {("f3", None), (None, 3)}
    assert sorted((r.flow_id, r.alert.event_id) for r in sink.all()) == [("f1", 1), ("f2", 2), ("f5", 5)]


def test_late_packets_of_the_last_batch_survive_the_end(spark, tmp_path):
    t = 1_704_067_200_000
    packet = lambda s: ("s", "d", 1, 2, 6, t + s * 1000, 60, 0)
    sink = Replacing()
    job = B.flow_job(spark, str(tmp_path), sink)
    for batch, seconds in enumerate(([0, 500], [1, 900], [2, 3])):
        job.take(B.packet_rows(spark.createDataFrame([packet(s) for s in seconds], f"{KEYS}, ts_ms long, length int, flags int")), batch)
    job.finish()
    assert {b: len(late) for b, late in sink.late.items()} == {0: 0, 1: 1, 2: 2}
    assert sum(r.bidirectional_packets for r in sink.all()) == 3


def test_rows_without_a_time_are_joined_as_in_the_batch_form(spark, tmp_path):
    flows, alerts = sides(spark, 5)
    untimed = [("n1", "s1", "d", 1, 2, 6, None), ("n2", "only", "d", 1, 2, 6, None)]
    silent = [(200, "s1", "d", 1, 2, 6, None, 7, "m", "c", 1), (201, "new", "d", 1, 2, 6, None, 7, "m", "c", 1), (202, "new", "d", 1, 2, 6, None, 7, "m", "c", 1)]
    f, a = ([tuple(r) for r in d.collect()] for d in (flows, alerts))
    want = pairs(correlate.interval_correlate(spark.createDataFrame(f + untimed, FLOW), spark.createDataFrame(a + silent, ALERT)).collect())
    sink = Sink()
    join_run(spark, tmp_path, [(f[::2] + untimed[:1], a[::2] + silent[:2]), (f[1::2] + untimed[1:], a[1::2] + silent[2:])], 500_000, sink)
    assert pairs(sink.all()) == want and not sink.late


def test_state_of_a_flooded_key_is_one_window(spark, tmp_path):
    t = 1_704_067_200_000
    flows = [[(f"f{k}-{i}", "s", "d", 1, 2, 6, t + (k * 1000 + i) * 1000) for i in range(0, 1000, 5)] for k in range(2)]
    alerts = [[(k * 1000 + i, "s", "d", 1, 2, 6, t + (k * 1000 + i) * 1000, 7, "m", "c", 1) for i in range(1000)] for k in range(2)]
    sink = Sink()
    join_run(spark, tmp_path, zip(flows, alerts), 10_000, sink, finish=False)
    held = spark.read.parquet(str(tmp_path / "held" / "rows" / "batch=1")).filter("NOT _done")
    assert held.filter("_side = 'flow'").count() <= 4 and held.filter("_side = 'alert'").count() <= 80
    assert sum(len(b) for b in sink.batches.values()) >= 390 and all(r.alert for r in sink.all())


def test_a_repeated_batch_and_a_start_after_the_end(spark, tmp_path):
    flows, alerts = sides(spark, 3)
    sink = Sink()
    job = join_run(spark, tmp_path, [(flows.collect(), alerts.collect())], 10_000, sink)
    whole = pairs(sink.all())
    assert whole == pairs(correlate.interval_correlate(flows, alerts).collect())
    job.take(L.sides(flows, alerts), 0)
    job.finish()
    assert pairs(sink.all()) == whole
    t = 1_704_067_200_000 + 10**7
    put(spark, [("new", "s0", "d", 1, 2, 6, t)], FLOW, str(tmp_path / "f"))
    put(spark, [(999, "s0", "d", 1, 2, 6, t, 7, "m", "c", 1)], ALERT, str(tmp_path / "a"))
    join_run(spark, tmp_path, [([], [])], 10_000, sink)
    assert pairs(sink.batches[max(sink.batches)]) == [("new", "s0", 999)] and len(sink.all()) == len(whole) + 1


@pytest.mark.parametrize("idle,active,close_flags", [(30_000, 10_000, True), (30_000, None, False), (30_000, 20_000, False), (5_000, None, True)])
def test_flow_stream_equals_batch(spark, tmp_path, idle, active, close_flags):
    data = make_packets(77, n=150) + [("q", "r", 1, 2, 17, 1_704_067_200_000 + t, 40, 0, 1000 + t) for t in range(0, 400_000, 4_000)]
    rows = sorted(data, key=lambda r: r[5])
    path, sink = str(tmp_path / "p"), Sink()
    put(spark, [], PACKET, path)
    schema = spark.createDataFrame([], PACKET).schema
    sizes = []
    for k in range(4):
        # neighbouring parts overlap by less than the lateness, so packets of one instant come in several batches
        put(spark, [r for i, r in enumerate(rows) if (i + (i % 3 - 1) * 5) * 4 // len(rows) == k or k == 0 and (i + (i % 3 - 1) * 5) < 0 or k == 3 and (i + (i % 3 - 1) * 5) >= len(rows)], PACKET, path)
        job = B.flow_job(spark, str(tmp_path / "held"), sink, idle, active, close_flags, lateness_ms=60_000)
        job.start(B.packet_rows(readers.stream_flows(spark, path, schema=schema)), str(tmp_path / "c"), {"availableNow": True}).awaitTermination(240)
        sizes.append(spark.read.parquet(str(tmp_path / "held" / "rows" / f"batch={k}")).filter("NOT _done").count())
    job.finish()
    assert not sink.late and sum(len(b) > 0 for b in sink.batches.values()) > 1
    got = sorted((r.src_ip, r.dst_ip, r.protocol, r.bidirectional_first_seen_ms, r.bidirectional_last_seen_ms, r.bidirectional_packets, r.bidirectional_bytes, r.src2dst_packets) for r in sink.all())
    assert got == brute_flows(data, idle, active, close_flags)
    assert max(sizes) < len(rows) / 3


def test_session_window_flows(spark, tmp_path):
    data = make_packets(5, n=150) + [("q", "r", 1, 2, 17, 1_704_067_200_000 + t, 40, 0, 1000 + t) for t in (0, 29_999, 59_999)]
    df = spark.createDataFrame(data, PACKET)
    path, clock = str(tmp_path / "p"), str(tmp_path / "clock")
    write_steps(df, "ts_ms", path, 2)
    L.set_clock(spark, clock, None)
    for name, now in (("sessions1", None), ("sessions2", END)):
        if now:
            L.set_clock(spark, clock, now)
        stream = B.session_flows(L.with_clock(readers.stream_flows(spark, path, schema=df.schema), "ts_ms", clock), lateness="500 seconds")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r.flow_start, r.packets, r.bytes) for r in spark.read.parquet(str(tmp_path / "out")).filter("k_ip1 is not null").collect())
    assert got == sorted((f[3], f[5], f[6]) for f in brute_flows(data, 30_000, None, False))


def test_rates_counters_and_duplicates(spark, tmp_path):
    data = [(i, 1_704_067_200_000 + i * 500, "s" if i % 2 else "t", 6, 2, ["confirmed", "benign"][i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "id int, ts_ms long, src_ip string, protocol int, flags int, source string").withColumn("ts", F.timestamp_millis("ts_ms"))
    path = str(tmp_path / "e")
    df.write.parquet(path)
    read = lambda: spark.readStream.schema(df.schema).parquet(path)
    drain(L.event_rate(read()), str(tmp_path / "c1"), "rate", "update")
    best = spark.table("rate").agg(F.max("events")).first()[0]
    assert best == 10
    drain(L.verdict_counters(read()), str(tmp_path / "c2"), "verdicts", "complete")
    assert {r.source: r.events for r in spark.table("verdicts").collect()} == {"confirmed": 30, "benign": 30}
    drain(L.rate_alerts(read(), n=4), str(tmp_path / "c3"), "floods", "update")
    assert spark.table("floods").count() > 0 and spark.table("floods").agg(F.min("packets")).first()[0] == 5
    drain(L.one_per_key(read(), ("src_ip",), "ts", "10 minutes"), str(tmp_path / "c4"), "single")
    assert spark.table("single").count() == 2


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    path = str(tmp_path / "e")
    schema = "ts timestamp, v int"
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1, 12)
    def put(*seconds):
        spark.createDataFrame([(t0 + dt.timedelta(seconds=s), 1) for s in seconds], schema).coalesce(1).write.mode("append").parquet(path)

    put(0, 100)
    stream = lambda: L.event_rate(spark.readStream.schema(schema).parquet(path), lateness="10 seconds")

    def run():
        q = stream().writeStream.foreachBatch(lambda b, i: b.count()).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return q

    run()
    put(1, 101)
    q = run()
    assert L.dropped_late_rows(q) > 0


def test_live_job(spark, sf, tmp_path):
    flows = D.scored(spark, sf).select("flow_id", *correlate.KEY, "first_seen_ms", "prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "stage3_p", "stage2_probs", "stage3_probs")
    flows = flows.withColumn("protocol", F.col("protocol").cast("int"))
    alerts = D.alerts(spark, sf).drop("o").withColumn("protocol", F.col("protocol").cast("int"))
    fp, ap, out, cp = (str(tmp_path / n) for n in ("f", "a", "out", "c"))
    flows.coalesce(1).write.parquet(fp)
    alerts.coalesce(1).write.parquet(ap)
    joined = L.sides(readers.stream_flows(spark, fp, schema=flows.schema), readers.stream_flows(spark, ap, schema=alerts.schema))
    job = L.live_job(spark, f"{out}/held", out, enrich.default_kb(spark), D.rules(spark, sf), D.as_of())
    for _ in range(2):
        job.start(joined, cp, {"availableNow": True}).awaitTermination(300)
        job.finish()
    stored = L.read_queue(spark, out)
    assert stored.count() == stored.select("id").distinct().count() > 0
    assert stored.filter("source = 'benign'").count() == 0
    batch = correlate.interval_correlate(flows, alerts)
    has, bad = F.col("alert").isNotNull(), F.coalesce(F.col("prediction") == "Malicious", F.lit(False))
    expect = {r.v: r.n for r in batch.select(F.when(has & bad, "confirmed").when(has, "signature_only").when(bad, "ml_only").otherwise("benign").alias("v")).groupBy("v").agg(F.count("*").alias("n")).collect()}
    got = {r.source: r["count"] for r in stored.groupBy("source").count().collect()}
    assert all(got[v] <= expect[v] for v in got) and sum(got.values()) < sum(n for v, n in expect.items() if v != "benign")
    log = spark.read.option("header", True).csv(f"{out}/session/csv/*")
    logged = {r.verdict: r["count"] for r in log.groupBy("verdict").count().collect()}
    assert logged == {v: n for v, n in expect.items() if v != "benign"}


def test_the_live_job_keeps_no_wide_rows(spark, sf, tmp_path, monkeypatch):
    """What a batch keeps beside its output are narrow tables that go with it; the session log is compressed."""
    flows = D.scored(spark, sf).select("flow_id", *correlate.KEY, "first_seen_ms", "prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "stage3_p", "stage2_probs", "stage3_probs")
    alerts = D.alerts(spark, sf).drop("o")
    out, held = str(tmp_path / "out"), []
    append = L.sinks.append_live
    monkeypatch.setattr(L.sinks, "append_live", lambda *args: (held.append(len(spark.sparkContext._jsc.getPersistentRDDs())), append(*args)))
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    job = L.live_job(spark, f"{out}/held", out, enrich.default_kb(spark), None, D.as_of())
    job.take(L.sides(flows.filter("first_seen_ms is not null").limit(200), alerts.limit(200)), 0)
    job.finish()
    assert held == [before] * 2
    assert not list((tmp_path / "out" / "held" / "in").glob("batch=*")) and not list((tmp_path / "out" / "held" / "events").glob("batch=*"))
    for kind in ("csv", "ndjson"):
        parts = list((tmp_path / "out" / "session" / kind / "batch=0").glob("part-*"))
        assert parts and all(p.name.endswith(".gz") for p in parts)
    logged = spark.read.json(f"{out}/session/ndjson/*")
    assert logged.count() == L.read_queue(spark, out).count() == spark.read.option("header", True).csv(f"{out}/session/csv/*").count() > 0
