"""Joining flows with signature alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators.distributed import hot_values

KEY = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
PAIR = ("k_ip1", "k_port1", "k_ip2", "k_port2", "k_protocol")


def in_order(src_ip="src_ip", dst_ip="dst_ip", src_port="src_port", dst_port="dst_port") -> Column:
    """Whether the row runs from the smaller endpoint to the larger one."""
    s, d = F.col(src_ip), F.col(dst_ip)
    return (s < d) | ((s == d) & (F.col(src_port) <= F.col(dst_port)))


def with_pair(df: DataFrame) -> DataFrame:
    """Adds the direction-free key of a conversation and ``k_forward``, the direction of the row in it."""
    f = in_order()
    pick = lambda a, b: F.when(f, F.col(a)).otherwise(F.col(b))
    return df.withColumns({
        "k_ip1": pick("src_ip", "dst_ip"), "k_port1": pick("src_port", "dst_port"),
        "k_ip2": pick("dst_ip", "src_ip"), "k_port2": pick("dst_port", "src_port"),
        "k_protocol": F.col("protocol"), "k_forward": f,
    })


def alert_per_key(alerts: DataFrame, keep: str = "first", ts: str = "alert_ms", tie: str = "event_id", keys: Sequence[str] = KEY) -> DataFrame:
    """One alert per key: the first seen (files) or the last seen (live)."""
    payload = [c for c in alerts.columns if c not in keys]
    choose = F.min_by if keep == "first" else F.max_by
    chosen = alerts.groupBy(*keys).agg(choose(F.struct(*payload), F.struct(ts, tie)).alias("a"))
    return chosen.select(*keys, "a.*")


def correlate(
    flows: DataFrame, alerts: DataFrame, bidirectional: bool = True, keep: str = "first", ts: str = "alert_ms", tie: str = "event_id"
) -> DataFrame:
    """Each flow with the alert of its key, else (if ``bidirectional``) of the reversed key, as struct ``alert``.

    Both lookups are one join: alerts are folded to one row per conversation with a slot for each direction, so the
    flows are shuffled once. A conversation has one alert row, so a hot one only lengthens the flow side, which
    adaptive skew joins split.
    """
    payload = [c for c in alerts.columns if c not in KEY]
    a = with_pair(alerts)
    choose = F.min_by if keep == "first" else F.max_by
    body, order = F.struct(*payload), F.struct(ts, tie)
    slots = a.groupBy(*PAIR).agg(
        choose(body, F.when(F.col("k_forward"), order)).alias("a_forward"),
        choose(body, F.when(~F.col("k_forward"), order)).alias("a_backward"),
    )
    joined = with_pair(flows).join(slots, list(PAIR), "left")
    own = F.when(F.col("k_forward"), F.col("a_forward")).otherwise(F.col("a_backward"))
    other = F.when(F.col("k_forward"), F.col("a_backward")).otherwise(F.col("a_forward"))
    return joined.select(*flows.columns, (F.coalesce(own, other) if bidirectional else own).alias("alert"))


def merge_in_time(
    flows: DataFrame, alerts: DataFrame, before_ms: int, after_ms: int, flow_ts: str, alert_ts: str, tie: str, flow_id: str,
    support: float = 0.01, splits: int = 32,
) -> DataFrame:
    """Flows and alerts of a key merged along time, cut into buckets as wide as the window.

    An alert is copied to the next bucket, because a flow up to one window later may need it. Simultaneous alerts of a key
    are one entry, so a key holds a bounded number of alerts per bucket. The flows of a key that holds more than
    ``support`` of all flows are spread over ``splits`` groups, with the alerts of that key copied to each.
    """
    width = before_ms + after_ms
    h = F.xxhash64(*KEY)
    keyed = flows.withColumn("_h", h)
    hot = hot_values(keyed, "_h", support) if splits > 1 else []
    payload = [c for c in alerts.columns if c not in KEY]
    single = alerts.groupBy(*KEY, F.col(alert_ts).alias("_t")).agg(F.max_by(F.struct(*payload), tie).alias("alert")).withColumn("_h", h)
    is_hot = F.col("_h").isin(hot) if hot else F.lit(False)
    f = keyed.select(
        *KEY, (F.col(flow_ts) + after_ms).alias("_t"), F.lit(1).alias("_kind"), F.struct(*flows.columns).alias("flow"),
        F.lit(None).cast(single.schema["alert"].dataType).alias("alert"),
        F.when(is_hot, F.pmod(F.xxhash64(flow_id), F.lit(splits))).otherwise(F.lit(0)).cast("int").alias("_salt"),
    ).withColumn("_bucket", F.floor(F.col("_t") / width))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(splits - 1))).otherwise(F.array(F.lit(0)))
    a = single.select(
        *KEY, "_t", F.lit(0).alias("_kind"), F.lit(None).cast(f.schema["flow"].dataType).alias("flow"), "alert",
        F.explode(copies).alias("_salt"),
    )
    here = F.floor(F.col("_t") / width)
    a = a.withColumn("_bucket", F.explode(F.array(here, here + 1)))
    merged = f.unionByName(a)
    w = Window.partitionBy(*KEY, "_bucket", "_salt").orderBy("_t", "_kind")
    seen = F.when(F.col("_kind") == 0, F.struct(F.col("_t").alias("t"), F.col("alert").alias("a")))
    last = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    coming = F.first(F.when(F.col("_kind") == 1, F.col("_t")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return merged.withColumn("_last", last).withColumn("_next", coming).withColumn("_width", F.lit(width))


def asof_alert(
    flows: DataFrame, alerts: DataFrame, ttl_ms: int = fixed.HASH_HOLD_MS, flow_ts: str = "first_seen_ms", alert_ts: str = "alert_ms",
    tie: str = "event_id", flow_id: str = "flow_id", after_ms: int = 0, support: float = 0.01, splits: int = 32,
) -> DataFrame:
    """Each flow with the latest alert of its key from ``ttl_ms`` before to ``after_ms`` after it, as struct ``alert``."""
    m = merge_in_time(flows, alerts, ttl_ms, after_ms, flow_ts, alert_ts, tie, flow_id, support, splits)
    fresh = F.when(F.col("_last.t") >= F.col("_t") - F.col("_width"), F.col("_last.a"))
    return m.filter("_kind = 1").select("flow.*", fresh.alias("alert"))


def interval_correlate(
    flows: DataFrame, alerts: DataFrame, before_ms: int = fixed.HASH_HOLD_MS, after_ms: int = fixed.FLOW_HOLD_MS,
    flow_ts: str = "first_seen_ms", alert_ts: str = "alert_ms", tie: str = "event_id", flow_id: str = "flow_id",
    support: float = 0.01, splits: int = 32,
) -> DataFrame:
    """The asymmetric join of the live path, both sides kept.

    A flow takes the latest alert of its key in ``[flow - before, flow + after]``. An alert no flow could take comes out
    as a row of its own with null flow columns and the key filled from the alert.
    """
    m = merge_in_time(flows, alerts, before_ms, after_ms, flow_ts, alert_ts, tie, flow_id, support, splits)
    fresh = F.when(F.col("_last.t") >= F.col("_t") - F.col("_width"), F.col("_last.a"))
    matched = m.filter("_kind = 1").select("flow.*", fresh.alias("alert"))
    lonely = (
        m.filter("_kind = 0")
        .groupBy(*KEY, "_t")
        .agg(F.max(F.coalesce(F.col("_next") <= F.col("_t") + F.col("_width"), F.lit(False))).alias("taken"), F.any_value("alert").alias("alert"))
        .filter(~F.col("taken"))
    )
    fill = [F.col(c) if c in KEY else F.lit(None).cast(flows.schema[c].dataType).alias(c) for c in flows.columns]
    return matched.unionByName(lonely.select(*fill, "alert"))


def label_by_window(packets: DataFrame, windows: DataFrame, ts: str = "ts_ms", slot_ms: int = 3_600_000) -> DataFrame:
    """Each packet with the name and order of the first window that holds its time, ends included; null outside.

    ``windows``: name, start_ms, end_ms, ord. The windows are first cut into pieces that do not overlap, each owned by its
    first window, so that a packet meets one piece at most. Pieces are joined on the time slot they touch: an equi-join
    with a range test, which stays a join on a key however many windows there are.
    """
    edges = (
        windows.select(F.col("start_ms").alias("e")).unionByName(windows.select((F.col("end_ms") + 1).alias("e"))).distinct()
    )
    # the edges are cut along time like everything else, by the slot they fall into
    pieces = (
        edges.withColumn("_w", F.lit(0))
        .withColumn("e2", F.lead("e").over(Window.partitionBy("_w").orderBy("e")) - 1)
        .filter("e2 is not null")
        .withColumn("slot", F.explode(F.sequence(F.floor(F.col("e") / slot_ms), F.floor(F.col("e2") / slot_ms))))
    )
    spans = windows.withColumn("slot", F.explode(F.sequence(F.floor(F.col("start_ms") / slot_ms), F.floor(F.col("end_ms") / slot_ms))))
    owned = (
        pieces.join(spans, (pieces.slot == spans.slot) & (spans.start_ms <= pieces.e) & (spans.end_ms >= pieces.e2))
        .groupBy(pieces.slot.alias("slot"), "e", "e2")
        .agg(F.min_by(F.struct("name", "ord"), "ord").alias("win"))
    )
    p = packets.withColumn("slot", F.floor(F.col(ts) / slot_ms))
    return (
        p.join(owned, (p.slot == owned.slot) & p[ts].between(owned.e, owned.e2), "left")
        .select(*[p[c] for c in packets.columns], F.col("win.name").alias("window"), F.col("win.ord").alias("window_ord"))
    )
