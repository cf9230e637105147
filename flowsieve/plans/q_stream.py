"""Registered queries that run as streams over the given tables, drained to the end, and files written and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators import enrich, packets, standardize
from flowsieve.operators.correlate import KEY
from flowsieve.plans import driver_tables as D
from flowsieve.plans import q_flow
from flowsieve.session import shared_folder
from flowsieve.sources import readers, sinks
from flowsieve.streaming import flow_builder as B
from flowsieve.streaming import live as L

END_MS = 4_000_000_000_000
DAY_MS = 86_400_000


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream."""
    shape = D.table(spark, sf_dir, name).schema
    return spark.readStream.schema(shape).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@contextmanager
def _stateful(spark):
    """State in RocksDB, one store per core instead of one per shuffle partition; the session's own settings come back afterwards."""
    keys = {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)), L.PROVIDER: L.ROCKSDB}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _written(spark, make, mode: str = "append") -> DataFrame:
    """Runs the stream ``make(clock folder)`` over everything there is, then past all that is held, and returns what it wrote."""
    run = _folder(spark, "stream")
    L.set_clock(spark, f"{run}/clock", None)
    with _stateful(spark):
        stream = make(f"{run}/clock")
        writer = stream.writeStream.option("checkpointLocation", f"{run}/state").trigger(availableNow=True).outputMode(mode)
        if mode == "append":
            for now in (None, END_MS):
                if now:
                    L.set_clock(spark, f"{run}/clock", now)
                writer.format("parquet").option("path", f"{run}/rows").start().awaitTermination()
            return spark.read.schema(stream.schema).parquet(f"{run}/rows")

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{run}/rows/batch={batch_id}")

        writer.foreachBatch(keep).start().awaitTermination()
        return spark.read.option("basePath", f"{run}/rows").parquet(f"{run}/rows/batch=*")


# ---- jobs that hold rows --------------------------------------------------------------------------------------------


def _kept(folder: str, with_late: bool = False):
    """A sink: a folder per batch, late rows apart; with ``with_late`` there is a folder for them in any case."""
    def store(rows: DataFrame, late: DataFrame | None, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        if late is not None or with_late:
            (rows.limit(0) if late is None else late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

    return store


def _read_kept(spark, folder: str, part: str = "rows") -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{part}").parquet(f"{folder}/{part}/batch=*")


def _fed(spark, job: L.HeldRows, run: str, stream, tables: dict[str, tuple[DataFrame, Column]], batches: int, finish: bool = True) -> Iterator[int]:
    """Hands the rows of each table to the job's streams in ``batches`` parts, by the number the column gives; the job stops and starts again between them."""
    sources = {}
    for name, (rows, _) in tables.items():
        rows.limit(0).write.parquet(f"{run}/in/{name}")
        sources[name] = spark.readStream.schema(rows.schema).parquet(f"{run}/in/{name}")
    with _stateful(spark):
        for k in range(batches):
            for name, (rows, part) in tables.items():
                (rows.filter(part == k) if batches > 1 else rows).write.mode("append").parquet(f"{run}/in/{name}")
            job.start(stream(**sources), f"{run}/state", {"availableNow": True}).awaitTermination()
            yield k
        if finish:
            job.finish()


def _by_time(ts: str, batches: int) -> Column:
    """The part of the month a time lies in."""
    return F.least(F.lit(batches - 1), F.greatest(F.lit(0), F.floor((F.col(ts) - D.BASE_MS) * batches / (30 * DAY_MS))))


def _live_sides(spark, sf, by) -> dict:
    flows = D.flows(spark, sf).select("o", "flow_id", *KEY, "first_seen_ms")
    alerts = D.alerts(spark, sf)
    return {"flows": (flows, by(flows, "first_seen_ms", "o")), "alerts": (alerts, by(alerts, "alert_ms", "event_id"))}


def _sides(flows, alerts) -> DataFrame:
    return L.sides(flows.drop("o"), alerts.drop("o"))


def st2_correlate(spark, sf):
    """Both streams in two batches along time."""
    run = _folder(spark, "join")
    job = L.live_join(spark, f"{run}/held", _kept(run))
    for _ in _fed(spark, job, run, _sides, _live_sides(spark, sf, lambda d, ts, n: _by_time(ts, 2)), 2):
        pass
    return _read_kept(spark, run).select("flow_id", *KEY, F.col("alert.event_id").alias("event_id"))


LATE_MS = 10 * DAY_MS


def st4_late_rows(spark, sf):
    """Rows come in four batches without regard to time; what is more than ten days behind comes out on its own, unmatched."""
    run = _folder(spark, "late")
    job = L.live_join(spark, f"{run}/held", _kept(run, True), lateness_ms=LATE_MS)
    for _ in _fed(spark, job, run, _sides, _live_sides(spark, sf, lambda d, ts, n: F.greatest(F.lit(0), F.col(n) % 4)), 4):
        pass
    pick = lambda d, late: d.select("flow_id", *KEY, F.col("alert.event_id").alias("event_id"), F.lit(late).alias("late"))
    return pick(_read_kept(spark, run), False).unionByName(pick(_read_kept(spark, run, "late"), True))


def st8_drain(spark, sf):
    """What the join still held when it stopped, decided then."""
    run = _folder(spark, "drain")
    job = L.live_join(spark, f"{run}/held", _kept(run))
    for _ in _fed(spark, job, run, _sides, _live_sides(spark, sf, lambda d, ts, n: F.lit(0)), 1, finish=False):
        before = spark.read.parquet(f"{run}/rows/batch=0").select("flow_id", F.col("alert.event_id").alias("event_id"))
    out = before.withColumn("n", F.lit(-1))
    late = L.live_join(spark, f"{run}/held", _kept(f"{run}/end"))
    late.finish()
    after = spark.read.parquet(f"{run}/end/rows/batch=0").select("flow_id", F.col("alert.event_id").alias("event_id"), F.lit(1).alias("n"))
    return out.unionByName(after).groupBy("flow_id", "event_id").agg(F.sum("n").alias("n")).filter("n > 0").drop("n")


def st7_microbatches(spark, sf):
    """Completed flows from four files, one file a batch."""
    run = _folder(spark, "batches")
    flows = D.flows(spark, sf).select("o", "flow_id", *KEY, "first_seen_ms")
    for k in range(4):
        flows.filter(F.col("o") % 4 == k).coalesce(1).write.mode("append").parquet(f"{run}/in")
    stream = readers.stream_flows(spark, f"{run}/in", schema=flows.schema, files_per_trigger=1)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("protocol").agg(F.count("*").alias("flows"), F.max("first_seen_ms").alias("last_ms")).write.mode("overwrite").parquet(f"{run}/rows/batch={batch_id}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start().awaitTermination()
    return _read_kept(spark, run).select(F.col("batch").cast("long").alias("batch"), "protocol", "flows", "last_ms")


def st1_flows(spark, sf):
    """Packets in four batches along time, with active limit and flags; the job starts anew for each."""
    run = _folder(spark, "flows")
    p = D.packets(spark, sf).withColumn("flags", F.when(F.col("l_partkey") % 9 == 0, 17).otherwise(F.col("flags"))).select(*KEY, "ts_ms", "length", "flags")
    job = B.flow_job(spark, f"{run}/held", _kept(run), fixed.IDLE_MS, 10_000, True)
    for _ in _fed(spark, job, run, lambda packets: B.packet_rows(packets), {"packets": (p, _by_time("ts_ms", 4))}, 4):
        pass
    return _read_kept(spark, run).select(*q_flow.SHORT)


def st3_live_job(spark, sf):
    """The whole live path: joined, judged, enriched, logged, suppressed and stored; then the stored queue is read."""
    run = _folder(spark, "live")
    job = L.live_job(spark, f"{run}/held", run, enrich.default_kb(spark), D.rules(spark, sf), D.as_of())
    flows = D.scored_of(D.flows_of(_stream(spark, sf, "orders"))).drop("o", "c", "raw_family", "raw_leaf", "raw2_p", "raw3_p")
    alerts = D.alerts_of(_stream(spark, sf, "events"), D.flows(spark, sf), D.order_count(spark, sf)).drop("o")
    with _stateful(spark):
        job.start(L.sides(flows, alerts), f"{run}/state", {"availableNow": True}).awaitTermination()
        job.finish()
    q = L.read_queue(spark, run)
    return q.select("id", "source", "prediction", "severity", "confidence", F.coalesce("snort_sid", F.lit(0)).alias("snort_sid"))


# ---- streams with built-in state --------------------------------------------------------------------------------------


def _alert_stream(spark, sf):
    return D.alerts_of(_stream(spark, sf, "events"), D.flows(spark, sf), D.order_count(spark, sf)).drop("o")


def st5_one_per_key(spark, sf):
    """Alerts of a key within ten years count once."""
    a = _alert_stream(spark, sf).withColumn("ts", F.timestamp_millis("alert_ms"))
    out = _written(spark, lambda clock: L.one_per_key(L.with_clock(a, "ts", clock), KEY, "ts", "3650 days").select(*KEY))
    return out.filter("src_ip is not null")


def st6_verdict_counters(spark, sf):
    """Running counters over the alerts by signature, as the live overview keeps them by verdict."""
    ev = _alert_stream(spark, sf).select(F.col("snort_classtype").alias("source"))
    out = _written(spark, lambda clock: L.verdict_counters(ev), "complete")
    last = out.agg(F.max("batch").alias("m"))
    return out.join(F.broadcast(last), out["batch"] == last["m"]).select("source", "events")


def st6_event_rate(spark, sf):
    a = _alert_stream(spark, sf).withColumn("ts", F.timestamp_millis("alert_ms"))
    out = _written(spark, lambda clock: L.event_rate(L.with_clock(a, "ts", clock)))
    return out.select(F.unix_millis("start").alias("start_ms"), "events", "eps").filter(F.col("start_ms") < END_MS - 10_000)


def st1_session_flows(spark, sf):
    p = D.packets_of(_stream(spark, sf, "lineitem"), D.flows(spark, sf))
    out = _written(spark, lambda clock: B.session_flows(L.with_clock(p, "ts_ms", clock)))
    return out.filter("k_ip1 is not null").select("flow_start", "last_ms", "packets", "bytes")


LIVE_SQL = q_flow.INTERVAL_SQL.rsplit("SELECT s.flow_id", 1)[0] + f""", {D.RULES_SQL}, ev AS (
  SELECT 'evt_' || s.flow_id AS id, {', '.join('s.' + k for k in KEY)}, s.prediction AS said, s.severity AS sev, s.confidence AS conf, s.stage2_p, s.stage3_p, a.event_id, a.snort_sid
  FROM scored s LEFT JOIN cand c ON c.flow_id = s.flow_id AND c.rn = 1 LEFT JOIN alerts a ON a.event_id = c.event_id
  UNION ALL SELECT 'evt_alert_' || event_id, {', '.join(KEY)}, NULL, NULL, NULL, NULL, NULL, event_id, snort_sid FROM lonely WHERE rn = 1),
v AS (SELECT *, CASE WHEN event_id IS NOT NULL AND said = 'Malicious' THEN 'confirmed' WHEN event_id IS NOT NULL THEN 'signature_only' WHEN said = 'Malicious' THEN 'ml_only' ELSE 'benign' END AS source,
  src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS k FROM ev)
SELECT id, source, CASE source WHEN 'ml_only' THEN 'Suspicious' ELSE 'Malicious' END AS prediction, CASE WHEN source = 'signature_only' THEN 'High' WHEN source = 'confirmed' AND sev = 'Low' THEN 'Medium' ELSE sev END AS severity,
  CASE WHEN source = 'signature_only' THEN 0 ELSE {D.r4('stage2_p * stage3_p')} END AS confidence, coalesce(snort_sid, 0) AS snort_sid FROM v
WHERE source <> 'benign' AND NOT EXISTS (SELECT 1 FROM rules r WHERE (r.expires IS NULL OR r.expires > DATE '2024-01-31') AND ((r.kind = 'sid' AND CAST(v.snort_sid AS VARCHAR) = r.value)
  OR (r.kind = 'flow_key' AND v.k = r.value) OR (r.kind = 'src_ip' AND v.src_ip = r.value) OR (r.kind = 'src_cidr' AND v.src_ip LIKE '10.2.%')))"""


# ---- files written and read back ------------------------------------------------------------------------------------

def snk1_append(spark, sf):
    """Queue rows stored as the same batch twice are there once."""
    path, rows = _folder(spark, "queue"), D.fresh_predictions(spark, sf)
    for _ in range(2):
        sinks.append_predictions(rows, path, D.as_of(), batch_id=1)
    q = sinks.read_stored(spark, path)
    return q.groupBy(F.col("flow_date").cast("string").alias("day"), "source").agg(F.count("*").alias("rows"), F.count("snort_sid").alias("with_alert"))


def snk1_days(spark, sf):
    """Two batches and one repeated, a day put together, then seven days read."""
    path, rows = _folder(spark, "queue"), D.fresh_predictions(spark, sf)
    o = F.substring_index("id", "_", -1).cast("long")
    for k in (0, 1, 1):
        sinks.append_predictions(rows.filter(o % 2 == k), path, D.as_of(), batch_id=k)
    sinks.compact_day(spark, path, "2024-01-10")
    q = sinks.read_stored(spark, path, "2024-01-08", "2024-01-14")
    return q.groupBy(F.col("flow_date").cast("string").alias("day")).agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


def snk5_export_json(spark, sf):
    path = _folder(spark, "json")
    sinks.export_json(D.fresh_predictions(spark, sf).drop("first_seen_at"), path)
    return spark.read.json(path).groupBy("sourceIp", "prediction").agg(F.count("*").alias("rows"))


def src1_flow_csv(spark, sf):
    """Flow features as a CSV file with blanks in its header, read, cleaned and completed."""
    path = _folder(spark, "csv")
    rows = D.flows(spark, sf).selectExpr("if(o % 7 = 0, 'Infinity', CAST(o AS STRING)) AS ` Flow Duration `", "dst_port AS ` Dst Port`", "flow_id")
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    f = standardize.ensure_features(standardize.clean(readers.read_flow_csv(spark, path)), keep=["flow_id"])
    return f.select("flow_id", F.col("Flow Duration").alias("duration"), F.col("Dst Port").alias("port"), F.col("Idle Max").alias("idle"))


def src1_mixed_headers(spark, sf):
    """Flow features in files whose columns stand in different orders, one of them without a column."""
    path = _folder(spark, "mixed")
    rows = D.flows(spark, sf).select("o", F.col("o").cast("string").alias("Flow Duration"), F.col("dst_port").alias(" Dst Port"), F.col("raw_leaf").alias("Label"), "flow_id")
    orders = (["Flow Duration", " Dst Port", "Label", "flow_id"], ["flow_id", "Label", " Dst Port", "Flow Duration"], ["Label", "flow_id", "Flow Duration"])
    for k, columns in enumerate(orders):
        rows.filter(F.col("o") % 3 == k).select(*columns).write.mode("append").option("header", True).csv(path)
    f = readers.read_flow_csv(spark, path)
    return f.select("flow_id", F.col("Flow Duration").cast("long").alias("duration"), F.col("Dst Port").cast("long").alias("port"), F.col("Label").alias("label"))


def src2_flow_records(spark, sf):
    """Flows built from packets, exported and read back with the meter's schema."""
    path = _folder(spark, "records")
    packets.build_flows(D.packets(spark, sf), active_ms=None, close_on_flags=False).select(*[F.col(x.name).cast(x.dataType) for x in readers.FLOW.fields]).write.parquet(path)
    r = readers.read_flow_records(spark, path)
    return r.groupBy("protocol").agg(F.count("*").alias("flows"), F.sum("bidirectional_packets").alias("packets"), F.sum("bidirectional_bytes").alias("bytes"))


def src3_corpus(spark, sf):
    """A labelled CSV file converted to float32 Parquet; the second call finds it converted."""
    path = _folder(spark, "corpus")
    D.corpus(spark, sf, 2018).drop("row_id", "__source").write.option("header", True).csv(f"{path}/2018.csv")
    for _ in range(2):
        done = readers.corpus_to_parquet(spark, [f"{path}/2018.csv"], f"{path}/out")
    t = spark.read.parquet(*done)
    return t.groupBy(F.trim("Label").alias("label")).agg(F.count("*").alias("rows"), F.count("Flow Duration").alias("numbers"), F.sum(F.col("Dst Port").cast("double")).alias("ports"))


A = f"WITH {D.FLOWS_SQL},{D.ALERTS_SQL} "
_TAIL = q_flow.INTERVAL_SQL[len(q_flow.A):]
LATE_SQL = q_flow.A + f""", marks AS (
  SELECT k, least((SELECT max(first_seen_ms) FROM scored WHERE o % 4 < k), (SELECT max(alert_ms) FROM alerts WHERE event_id % 4 < k)) - {LATE_MS} AS wm FROM range(1, 4) AS t(k)),
flow_marks AS (SELECT s.*, coalesce(first_seen_ms < wm, false) AS late FROM scored s LEFT JOIN marks ON k = o % 4),
alert_marks AS (SELECT a.*, coalesce(alert_ms < wm, false) AS late FROM alerts a LEFT JOIN marks ON k = event_id % 4),
on_time_flows AS (SELECT * FROM flow_marks WHERE NOT late), on_time_alerts AS (SELECT * FROM alert_marks WHERE NOT late)
""" + _TAIL.replace("FROM scored s", "FROM on_time_flows s").replace("FROM alerts a", "FROM on_time_alerts a").replace("JOIN alerts a", "JOIN on_time_alerts a").replace(
    "c.event_id FROM", "c.event_id, false AS late FROM").replace("event_id FROM lonely", "event_id, false FROM lonely") + f"""
UNION ALL SELECT flow_id, {', '.join(KEY)}, NULL, true FROM flow_marks WHERE late UNION ALL SELECT NULL, {', '.join(KEY)}, event_id, true FROM alert_marks WHERE late"""
DRAIN_SQL = q_flow.A + ", last AS (SELECT least((SELECT max(first_seen_ms) FROM scored), (SELECT max(alert_ms) FROM alerts)) - 10000 AS wm)" + _TAIL.rsplit("SELECT s.flow_id", 1)[0] + """
SELECT s.flow_id, c.event_id FROM scored s LEFT JOIN cand c ON c.flow_id = s.flow_id AND c.rn = 1, last WHERE s.first_seen_ms + 2500 >= wm
UNION ALL SELECT NULL, event_id FROM lonely, last WHERE rn = 1 AND alert_ms + 60000 >= wm"""
P = f"WITH {D.PRED_SQL} "
QUERIES = {
    "st3_live_job": (st3_live_job, LIVE_SQL),
    "snk1_append_predictions": (snk1_append, P + "SELECT strftime(flow_timestamp, '%Y-%m-%d') AS day, source, count(*) AS rows, count(*) FILTER (snort_sid <> 0) AS with_alert FROM pred GROUP BY ALL"),
    "snk1_days": (snk1_days, P + "SELECT strftime(flow_timestamp, '%Y-%m-%d') AS day, count(*) AS rows, count(DISTINCT id) AS ids FROM pred WHERE strftime(flow_timestamp, '%Y-%m-%d') BETWEEN '2024-01-08' AND '2024-01-14' GROUP BY 1"),
    "snk5_export_json": (snk5_export_json, P + 'SELECT source_ip AS "sourceIp", prediction, count(*) AS rows FROM pred GROUP BY ALL'),
    "src1_flow_csv": (src1_flow_csv, f"WITH {D.FLOWS_SQL} SELECT flow_id, CASE WHEN o % 7 = 0 THEN 0 ELSE CAST(o AS DOUBLE) END AS duration, CAST(dst_port AS DOUBLE) AS port, CAST(0 AS DOUBLE) AS idle FROM flows"),
    "src1_mixed_headers": (src1_mixed_headers, f"WITH {D.FLOWS_SQL} SELECT flow_id, o AS duration, CASE WHEN o % 3 < 2 THEN CAST(dst_port AS BIGINT) END AS port, raw_leaf AS label FROM flows"),
    "src2_flow_records": (src2_flow_records, q_flow._flow_sql(False, False, ("*",)).rsplit("SELECT", 1)[0] + "SELECT protocol, count(*) AS flows, CAST(sum(bidirectional_packets) AS BIGINT) AS packets, CAST(sum(bidirectional_bytes) AS BIGINT) AS bytes FROM flow GROUP BY protocol"),
    "src3_corpus_to_parquet": (src3_corpus, "WITH c AS (SELECT (["+ ",".join(f"'{x}'" for x in D.SPELLINGS) + "])[CAST(l_partkey % 15 AS INT) + 1] AS label, l_partkey % 50 AS bad, l_suppkey % 7 AS port FROM lineitem WHERE l_suppkey % 2 = 0) SELECT label, count(*) AS rows, count(*) FILTER (bad NOT IN (2, 3)) AS numbers, CAST(sum(port) AS DOUBLE) AS ports FROM c GROUP BY label"),
    "st1_stream_flows": (st1_flows, q_flow.QUERIES["st1_flows_flags_active"][1]),
    "st2_stream_correlate": (st2_correlate, q_flow.INTERVAL_SQL),
    "st4_late_rows": (st4_late_rows, LATE_SQL),
    "st7_microbatches": (st7_microbatches, f"WITH {D.FLOWS_SQL} SELECT o % 4 AS batch, protocol, count(*) AS flows, max(first_seen_ms) AS last_ms FROM flows GROUP BY ALL"),
    "st8_drain": (st8_drain, DRAIN_SQL),
    "st5_stream_one_per_key": (st5_one_per_key, A + f"SELECT DISTINCT {', '.join(KEY)} FROM alerts"),
    "st6_stream_counters": (st6_verdict_counters, A + "SELECT snort_classtype AS source, count(*) AS events FROM alerts GROUP BY 1"),
    "st6_stream_rate": (st6_event_rate, A + "SELECT w AS start_ms, count(*) AS events, count(*) / CAST(5 AS DOUBLE) AS eps FROM (SELECT unnest(range((alert_ms // 1000) * 1000 - 4000, (alert_ms // 1000) * 1000 + 1, 1000)) AS w FROM alerts) GROUP BY w"),
    "st1_stream_sessions": (st1_session_flows, q_flow._flow_sql(False, False, ("bidirectional_first_seen_ms AS flow_start", "bidirectional_last_seen_ms AS last_ms", "bidirectional_packets AS packets", "bidirectional_bytes AS bytes"))),
}
