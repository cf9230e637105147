"""The live path as Structured Streaming jobs.

Flows and alerts are joined on the flow key within their hold times, on event time, so results do not depend on arrival order, and a restart from the checkpoint continues where
the last batch ended. What waits for a partner is a table (``held``); counters, rates and duplicate suppression keep their state in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.operators import enrich, predicates, standardize, suppress
from flowsieve.operators.correlate import KEY, merge_in_time
from flowsieve.sources import sinks
from flowsieve.streaming.held import END, Decide, HeldRows, Store

#: State on local disk of the executors, with checkpoints in the folder of the query: set ``PROVIDER`` to ``ROCKSDB`` before a stream with built-in state starts.
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- flow and alert join --------------------------------------------------------------------------------------------


def sides(flows: DataFrame, alerts: DataFrame, flow_ts: str = "first_seen_ms", alert_ts: str = "alert_ms") -> DataFrame:
    """Both streams as one, so that a batch holds rows of both."""
    f = flows.select(F.lit("flow").alias("_side"), F.col(flow_ts).alias("_t"), F.struct(*flows.columns).alias("flow"))
    a = alerts.select(F.lit("alert").alias("_side"), F.col(alert_ts).alias("_t"), F.struct(*alerts.columns).alias("alert"))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    return f.select("*", none(a, "alert"), F.lit(False).alias("taken")).unionByName(a.select("*", none(f, "flow"), F.lit(False).alias("taken")))


def _decided(before_ms: int, after_ms: int, alert_id: str, flow_id: str) -> Decide:
    """Rows of ``sides`` decided: flows have their alert in place of null, alerts say whether a flow could take them.

    A flow is done when no alert it could take is to come, an alert nobody took when no flow that could take it is to come. A taken alert is held, and at last dropped, as long as
    a flow that is not done could take it as well; all other rows leave. A key holds the flows and alerts of one window and the lateness. Without a time a flow is done at once, an
    alert at the end, when one stands for all of its key.
    """

    def decide(rows: DataFrame, now: int | None) -> DataFrame:
        keys = [F.col(f"flow.{c}").alias(c) for c in dict.fromkeys([*KEY, flow_id])]  # the flow itself goes along once
        f = rows.filter("_side = 'flow'").select(*keys, F.col("_t").alias("_ft"), F.col("flow").alias("_flow"))
        a = rows.filter("_side = 'alert'").select(*[F.col(f"alert.{k}").alias(k) for k in KEY], F.col(f"alert.{alert_id}").alias("_id"), F.col("_t").alias("_at"), F.col("alert").alias("_alert"), "taken")
        m = merge_in_time(f, a, before_ms, after_ms, "_ft", "_at", "_id", flow_id)
        fresh = F.when(F.col("_last.t") >= F.col("_t") - F.col("_width"), F.col("_last.a"))
        limit = F.lit(now).cast("long")
        passed = lambda t, untimed=now == END: F.coalesce(t < limit, F.lit(untimed))
        done = passed(F.col("flow._ft") + after_ms, now is not None)
        flows = m.filter("_kind = 1").select(
            F.lit("flow").alias("_side"), F.col("flow._ft").alias("_t"), F.col("flow._flow").alias("flow"), F.when(done, fresh["_alert"]).alias("alert"), F.lit(False).alias("taken"), done.alias("_done"))
        near = F.coalesce(F.col("_next") <= F.col("_t") + F.col("_width"), F.lit(False))
        alerts = m.filter("_kind = 0").groupBy(*KEY, "_t").agg(F.max(near | F.col("alert.taken")).alias("taken"), F.any_value("alert").alias("a"))
        done = passed(F.col("_t") + before_ms)
        alerts = alerts.filter(~(F.col("taken") & passed(F.col("_t") + before_ms + after_ms))).select(
            F.lit("alert").alias("_side"), "_t", F.lit(None).cast(rows.schema["flow"].dataType).alias("flow"), F.col("a._alert").alias("alert"), "taken", (done & ~F.col("taken")).alias("_done"))
        return flows.unionByName(alerts)

    return decide


def joined_rows(decided: DataFrame) -> DataFrame:
    """Rows of the join in the form of ``interval_correlate``, plus ``event_ms``: flows with struct ``alert``, and alerts of their own with the key and null flow columns."""
    flow, alert = decided.schema["flow"].dataType, decided.schema["alert"].dataType
    own = [(F.coalesce(F.col(f"flow.{c}"), F.col(f"alert.{c}").cast(flow[c].dataType)) if c in KEY else F.col(f"flow.{c}")).alias(c) for c in flow.names]
    body = F.when(F.col("alert").isNotNull(), F.struct(*[F.col(f"alert.{c}").alias(c) for c in alert.names if c not in KEY]))
    return decided.select(*own, body.alias("alert"), F.col("_t").alias("event_ms"))


def live_join(
    spark: SparkSession, folder: str, store: Store, before_ms: int = fixed.HASH_HOLD_MS, after_ms: int = fixed.FLOW_HOLD_MS, flow_id: str = "flow_id",
    alert_id: str = "event_id", lateness_ms: int = 10_000,
) -> HeldRows:
    """The streaming form of ``interval_correlate`` over ``sides``: the same rows for the same input, whatever the batches, as long as no row is late.

    ``store`` gets the joined rows of each batch, and apart from them rows more than ``lateness_ms`` behind, unmatched.
    """
    def put(decided: DataFrame, late: DataFrame | None, batch_id: int) -> None:
        store(joined_rows(decided), late and joined_rows(late), batch_id)

    return HeldRows(spark, folder, ("flow", "alert"), lateness_ms, _decided(before_ms, after_ms, alert_id, flow_id), put)


# ---- one event per key, counters, rates -------------------------------------------------------------------------------


def with_clock(stream: DataFrame, ts: str, folder: str) -> DataFrame:
    """The stream with rows whose columns are null but for ``ts``: the instants ``set_clock`` writes. They move the watermark when nothing else comes."""
    spark = stream.sparkSession
    clock = spark.readStream.schema("ms long").parquet(folder)
    time = F.timestamp_millis("ms") if stream.schema[ts].dataType.typeName() == "timestamp" else F.col("ms")
    return stream.unionByName(clock.select(*[time.alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields]))


def set_clock(spark: SparkSession, folder: str, ms: int | None) -> None:
    """Lets streams ``with_clock`` know that it is ``ms``. Without a time the folder is only made, which has to be done before they start."""
    spark.createDataFrame([] if ms is None else [(ms,)], "ms long").coalesce(1).write.mode("append").parquet(folder)


def one_per_key(stream: DataFrame, keys: tuple[str, ...], ts: str, hold: str) -> DataFrame:
    """At most one row per key within the hold time."""
    return stream.withWatermark(ts, hold).dropDuplicatesWithinWatermark(list(keys))


def verdict_counters(events: DataFrame) -> DataFrame:
    """Running number of events per verdict (for update mode)."""
    return events.groupBy("source").agg(F.count("*").alias("events"))


def event_rate(events: DataFrame, ts: str = "ts", window: str = "5 seconds", slide: str = "1 second", lateness: str = "10 seconds") -> DataFrame:
    """Events per second over sliding windows."""
    size = float(window.split()[0])
    g = events.withWatermark(ts, lateness).groupBy(F.window(ts, window, slide)).agg(F.count("*").alias("events"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "events", (F.col("events") / F.lit(size)).alias("eps"))


def rate_alerts(packets: DataFrame, n: int = 200, ts: str = "ts", keys: tuple[str, ...] = ("src_ip",), lateness: str = "10 seconds") -> DataFrame:
    """Sources with more than ``n`` packets that carry SYN alone in a five-second window, sliding by a second."""
    syn = packets.filter((F.col("protocol") == 6) & (F.col("flags") == 2))
    g = syn.withWatermark(ts, lateness).groupBy(F.window(ts, "5 seconds", "1 second"), *keys).agg(F.count("*").alias("packets"))
    return g.filter(F.col("packets") > n).select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "packets")


def dropped_late_rows(query) -> int:
    """Rows a running or finished query dropped because they were later than its watermark."""
    total = 0
    for p in query.recentProgress:
        for op in p["stateOperators"]:
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total


# ---- live job ---------------------------------------------------------------------------------------------------------


def live_events(joined: DataFrame, score: Callable[[DataFrame], DataFrame] | None, kb: DataFrame, mode: str, model_version: str, keep_benign: bool = False) -> DataFrame:
    """Joined pairs to live events: score, verdict, enrichment, view of the chosen mode, benign rows dropped."""
    return _viewed(_judged_events(joined, score, mode, model_version, keep_benign), kb, mode)


def _viewed(events: DataFrame, kb: DataFrame, mode: str) -> DataFrame:
    return standardize.apply_mode(enrich.enrich_attack(events, kb), mode)


def _judged_events(joined: DataFrame, score: Callable[[DataFrame], DataFrame] | None, mode: str, model_version: str, keep_benign: bool) -> DataFrame:
    """Live events before the enrichment. Without a flow there is no model output; in ``snort`` mode the model is not asked at all."""
    fields = ("prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "stage2_probs", "stage3_p", "stage3_probs")
    if mode == "snort":
        types = {f: "map<string,double>" if f.endswith("_probs") else "double" if f.endswith("_p") or f == "confidence" else "string" for f in fields}
        d = joined.withColumn("model", F.lit(None).cast("struct<" + ",".join(f"{f}:{t}" for f, t in types.items()) + ">"))
    else:
        scored = score(joined) if score is not None else joined
        d = scored.withColumn("model", F.when(F.col("first_seen_ms").isNotNull(), F.struct(*[F.col(f) for f in fields])))
    d = predicates.drop_benign(d.withColumn("prediction", F.col("model.prediction")), keep_benign)
    a = F.col("alert")
    keyed = d.select(
        F.concat(F.lit("evt_"), F.coalesce("flow_id", F.concat(F.lit("alert_"), a["event_id"].cast("string")))).alias("id"),
        F.timestamp_millis("event_ms").alias("timestamp"), N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("flow_key"), "model",
        F.when(a.isNotNull(), F.struct(
            F.col("src_ip"), F.col("dst_ip"), F.col("src_port"), F.col("dst_port"), N.protocol_name("protocol").alias("protocol"), a["snort_sid"].alias("snort_sid"),
            a["snort_msg"].alias("snort_msg"), a["snort_classtype"].alias("snort_classtype"), a["snort_priority"].alias("snort_priority"))).alias("alert"))
    return standardize.build_events(keyed, model_version)


def live_job(
    spark: SparkSession, folder: str, out: str, kb: DataFrame, rules: DataFrame | None, as_of: Column, mode: str = "hybrid",
    score: Callable[[DataFrame], DataFrame] | None = None, model_version: str = "live", keep_benign: bool = False, lateness_ms: int = 10_000,
) -> HeldRows:
    """The live job over ``sides``: every batch is joined, scored, judged, enriched, logged, suppressed and stored. Start it on the streams, and ``finish`` it at the end.

    All writes of a batch replace what an interrupted attempt left, so the stored queue has each event once. Late rows are treated like the others, on their own: a late flow has no
    alert, a late alert no flow. Rules are cut to intervals once.

    The attack knowledge makes an event many times larger. So events are written once without it, as a table that goes when the batch is stored, and each sink adds what it needs.
    """
    fixed_rules = suppress.prepare(rules, as_of) if rules is not None else None

    def store(joined: DataFrame, late: DataFrame | None, batch_id: int) -> None:
        rows, path = joined if late is None else joined.unionByName(late), f"{folder}/events/batch={batch_id}"
        plain = _judged_events(rows, score, mode, model_version, keep_benign)
        plain.write.mode("overwrite").parquet(path)
        try:
            events = _viewed(spark.read.schema(plain.schema).parquet(path), kb, mode)
            sinks.write_session_log(events, f"{out}/session", batch_id)
            queue = events.withColumnsRenamed({"src_ip": "source_ip", "dst_ip": "destination_ip", "src_port": "source_port", "dst_port": "destination_port"})
            kept = queue
            if fixed_rules is not None:
                judged = suppress.match_prepared(queue, fixed_rules)
                kept = judged.filter("rule is null").drop("rule")
                sinks.write_rule_hits(judged, f"{out}/hits", batch_id)
            back = kept.withColumnsRenamed({"source_ip": "src_ip", "destination_ip": "dst_ip", "source_port": "src_port", "destination_port": "dst_port"})
            sinks.append_live(back, f"{out}/queue", as_of, batch_id)
        finally:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    return live_join(spark, folder, store, lateness_ms=lateness_ms)


def read_rule_hits(rules: DataFrame, out: str) -> DataFrame:
    """Rules with their hit totals raised by what the live job's batches suppressed."""
    spark = rules.sparkSession
    new = spark.read.schema("id string, hits long").parquet(f"{out}/hits/batch=*").groupBy("id").agg(F.sum("hits").alias("_new"))
    return rules.join(new, "id", "left").withColumn("hits", F.col("hits") + F.coalesce("_new", F.lit(0))).drop("_new")


def read_queue(spark: SparkSession, out: str) -> DataFrame:
    return sinks.read_stored(spark, f"{out}/queue")
