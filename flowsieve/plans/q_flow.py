"""Registered queries: packets, flows, windows in time, correlation along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators import correlate, enrich, packets as K, triage
from flowsieve.operators.distributed import trailing_counts
from flowsieve.plans import driver_tables as D
from flowsieve.sources import readers

KEYS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
P = f"WITH {D.PACKETS_SQL} "
A = f"WITH {D.SCORED_SQL},{D.ALERTS_SQL} "


def _alert_key(keep):
    return lambda s, d: correlate.alert_per_key(D.alerts(s, d), keep).select(*KEYS, "event_id", "snort_sid")


def _alert_key_sql(way):
    return A + f"SELECT {', '.join(KEYS)}, event_id, snort_sid FROM alerts QUALIFY row_number() OVER (PARTITION BY {', '.join(KEYS)} ORDER BY alert_ms {way}, event_id {way}) = 1"


def _asof(s, d):
    j = correlate.asof_alert(D.flows(s, d), D.alerts(s, d).drop("o"))
    return j.select("flow_id", F.col("alert.event_id").alias("event_id"))


SAME = " AND ".join(f"a.{k} = s.{k}" for k in KEYS)
WITHIN = "a.alert_ms BETWEEN s.first_seen_ms - 60000 AND s.first_seen_ms + {after}"


def _asof_sql(after):
    return f"""cand AS (SELECT s.flow_id, a.event_id, row_number() OVER (PARTITION BY s.flow_id ORDER BY a.alert_ms DESC, a.event_id DESC) AS rn
      FROM scored s JOIN alerts a ON {SAME} AND {WITHIN.format(after=after)})"""


def _interval(s, d):
    j = correlate.interval_correlate(D.scored(s, d), D.alerts(s, d).drop("o"))
    return j.select("flow_id", *KEYS, F.col("alert.event_id").alias("event_id"))


# one row per key and time stands for simultaneous alerts of a key that no flow could take
INTERVAL_SQL = A + f""", {_asof_sql(2500)}, lonely AS (
  SELECT a.*, row_number() OVER (PARTITION BY {', '.join('a.' + k for k in KEYS)}, a.alert_ms ORDER BY a.event_id DESC) AS rn FROM alerts a
  WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE {SAME} AND {WITHIN.format(after=2500)}))
SELECT s.flow_id, {', '.join('s.' + k for k in KEYS)}, c.event_id FROM scored s LEFT JOIN cand c ON c.flow_id = s.flow_id AND c.rn = 1
UNION ALL SELECT NULL, {', '.join(KEYS)}, event_id FROM lonely WHERE rn = 1"""


def _windows(s, d):
    return readers.attack_windows(D.schedule(s, d), D.TZ_HOURS)


def _labelled(s, d):
    return correlate.label_by_window(D.packets(s, d), _windows(s, d))


J12_SQL = f"""labelled AS (SELECT p.*, (SELECT min(ord) FROM windows w WHERE p.ts_ms BETWEEN w.start_ms AND w.end_ms) AS window_ord FROM packets p)"""


def _flows_of(s, d, active, flags):
    return K.build_flows(D.packets(s, d), fixed.IDLE_MS, active, flags)


ENDS = ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")
SHORT = (*ENDS, "bidirectional_first_seen_ms", "bidirectional_last_seen_ms", "bidirectional_packets", "bidirectional_bytes",
         "src2dst_packets", "dst2src_bytes", "bidirectional_syn_packets")
FULL = (*SHORT, "bidirectional_duration_ms", "src2dst_duration_ms", "dst2src_duration_ms", "bidirectional_min_ps", "bidirectional_max_ps",
        "bidirectional_mean_ps", "bidirectional_stddev_ps", "dst2src_mean_ps", "bidirectional_min_piat_ms", "bidirectional_max_piat_ms",
        "bidirectional_mean_piat_ms", "bidirectional_stddev_piat_ms", "src2dst_mean_piat_ms", "dst2src_max_piat_ms", "src2dst_psh_packets")


def _segments_sql(flags: bool) -> str:
    closes = "bool_or(protocol = 6 AND flags & 5 <> 0)" if flags else "false"
    return f"""inst AS (SELECT pair, ts_ms, {closes} AS closes FROM paired GROUP BY ALL),
      marked AS (SELECT *, CASE WHEN lag(ts_ms) OVER w IS NULL OR ts_ms - lag(ts_ms) OVER w >= 30000 OR lag(closes) OVER w THEN ts_ms END AS opens FROM inst WINDOW w AS (PARTITION BY pair ORDER BY ts_ms)),
      seg AS (SELECT pair, ts_ms, max(opens) OVER (PARTITION BY pair ORDER BY ts_ms) AS seg FROM marked)"""


FLOW_OF_SEG = "flow_of AS (SELECT pair, ts_ms, seg AS flow_start FROM seg)"
FLOW_OF_ACTIVE = """starts AS (SELECT DISTINCT pair, seg, seg AS start FROM seg UNION ALL
        SELECT s.pair, s.seg, min(i.ts_ms) AS start FROM starts s JOIN seg i ON i.pair = s.pair AND i.seg = s.seg AND i.ts_ms >= s.start + 10000 GROUP BY s.pair, s.seg),
      flow_of AS (SELECT i.pair, i.ts_ms, max(s.start) AS flow_start FROM seg i JOIN starts s ON s.pair = i.pair AND s.seg = i.seg AND s.start <= i.ts_ms GROUP BY ALL)"""


def _gap(scope: str, cond: str) -> str:
    return f"""gap_{scope} AS (SELECT pair, flow_start, min(g) AS lo, max(g) AS hi, count(g) AS n, sum(g) AS s, sum(g * g) AS q FROM (
        SELECT pair, flow_start, ts_ms - lag(ts_ms) OVER (PARTITION BY pair, flow_start ORDER BY ts_ms) AS g FROM pk WHERE {cond}) GROUP BY ALL)"""


def _flow_sql(flags: bool, active: bool, columns) -> str:
    order = "ts_ms, length, flags, NOT fwd"
    head = P.replace("WITH ", "WITH RECURSIVE ", 1)
    return head + f""", {_segments_sql(flags)}, {FLOW_OF_ACTIVE if active else FLOW_OF_SEG},
      pk0 AS (SELECT p.*, f.flow_start FROM paired p JOIN flow_of f ON f.pair = p.pair AND f.ts_ms = p.ts_ms),
      pk AS (SELECT *, fwd = first_value(fwd) OVER (PARTITION BY pair, flow_start ORDER BY {order}) AS s2d,
        first_value(src_ip) OVER w AS f_src, first_value(dst_ip) OVER w AS f_dst, first_value(src_port) OVER w AS f_sp, first_value(dst_port) OVER w AS f_dp FROM pk0
        WINDOW w AS (PARTITION BY pair, flow_start ORDER BY {order})),
      {_gap('a', 'true')}, {_gap('f', 's2d')}, {_gap('b', 'NOT s2d')},
      base AS (SELECT pair, flow_start, any_value(f_src) AS src_ip, any_value(f_dst) AS dst_ip, any_value(f_sp) AS src_port, any_value(f_dp) AS dst_port,
        any_value(protocol) AS protocol, flow_start AS bidirectional_first_seen_ms, max(ts_ms) AS bidirectional_last_seen_ms, count(*) AS bidirectional_packets,
        CAST(sum(length) AS BIGINT) AS bidirectional_bytes, count(*) FILTER (s2d) AS src2dst_packets, CAST(coalesce(sum(length) FILTER (NOT s2d), 0) AS BIGINT) AS dst2src_bytes,
        count(*) FILTER (flags & 2 <> 0) AS bidirectional_syn_packets, max(ts_ms) - flow_start AS bidirectional_duration_ms,
        coalesce(max(ts_ms) FILTER (s2d) - min(ts_ms) FILTER (s2d), 0) AS src2dst_duration_ms, coalesce(max(ts_ms) FILTER (NOT s2d) - min(ts_ms) FILTER (NOT s2d), 0) AS dst2src_duration_ms,
        CAST(min(length) AS DOUBLE) AS bidirectional_min_ps, CAST(max(length) AS DOUBLE) AS bidirectional_max_ps, CAST(sum(length) AS DOUBLE) / count(*) AS bidirectional_mean_ps,
        CASE WHEN count(*) > 1 THEN sqrt(greatest(CAST(sum(length * length) AS DOUBLE) - CAST(sum(length) AS DOUBLE) * CAST(sum(length) AS DOUBLE) / count(*), 0) / (count(*) - 1)) ELSE 0 END AS bidirectional_stddev_ps,
        CASE WHEN count(*) FILTER (NOT s2d) > 0 THEN CAST(sum(length) FILTER (NOT s2d) AS DOUBLE) / count(*) FILTER (NOT s2d) ELSE 0 END AS dst2src_mean_ps,
        count(*) FILTER (s2d AND flags & 8 <> 0) AS src2dst_psh_packets FROM pk GROUP BY pair, flow_start),
      flow AS (SELECT b.*, CAST(coalesce(ga.lo, 0) AS DOUBLE) AS bidirectional_min_piat_ms, CAST(coalesce(ga.hi, 0) AS DOUBLE) AS bidirectional_max_piat_ms,
        CASE WHEN ga.n > 0 THEN CAST(ga.s AS DOUBLE) / ga.n ELSE 0 END AS bidirectional_mean_piat_ms,
        CASE WHEN ga.n > 1 THEN sqrt(greatest(CAST(ga.q AS DOUBLE) - CAST(ga.s AS DOUBLE) * CAST(ga.s AS DOUBLE) / ga.n, 0) / (ga.n - 1)) ELSE 0 END AS bidirectional_stddev_piat_ms,
        CASE WHEN gf.n > 0 THEN CAST(gf.s AS DOUBLE) / gf.n ELSE 0 END AS src2dst_mean_piat_ms, CAST(coalesce(gb.hi, 0) AS DOUBLE) AS dst2src_max_piat_ms
        FROM base b LEFT JOIN gap_a ga USING (pair, flow_start) LEFT JOIN gap_f gf USING (pair, flow_start) LEFT JOIN gap_b gb USING (pair, flow_start))
      SELECT {', '.join(columns)} FROM flow"""


def _iat(s, d):
    return K.iat_stats(D.packets(s, d)).select(
        F.concat_ws("-", F.concat_ws(":", "k_ip1", "k_port1"), F.concat_ws(":", "k_ip2", "k_port2"), "k_protocol").alias("pair"), "scope", "events",
        "min_piat_ms", "max_piat_ms", "mean_piat_ms", "stddev_piat_ms")


IAT_SQL = P + """, sc AS (SELECT pair, 'both' AS scope, ts_ms FROM paired UNION ALL SELECT pair, CASE WHEN fwd THEN 'forward' ELSE 'backward' END, ts_ms FROM paired),
  g AS (SELECT pair, scope, ts_ms - lag(ts_ms) OVER (PARTITION BY pair, scope ORDER BY ts_ms) AS g FROM sc),
  x AS (SELECT pair, scope, count(*) AS events, count(g) AS n, min(g) AS lo, max(g) AS hi, sum(g) AS s, sum(g * g) AS q FROM g GROUP BY ALL)
  SELECT pair, scope, events, CAST(coalesce(lo, 0) AS DOUBLE) AS min_piat_ms, CAST(coalesce(hi, 0) AS DOUBLE) AS max_piat_ms, CASE WHEN n > 0 THEN CAST(s AS DOUBLE) / n ELSE 0 END AS mean_piat_ms,
    CASE WHEN n > 1 THEN sqrt(greatest(CAST(q AS DOUBLE) - CAST(s AS DOUBLE) * CAST(s AS DOUBLE) / n, 0) / (n - 1)) ELSE 0 END AS stddev_piat_ms FROM x"""


def _quota(s, d):
    out = K.quota_sample(_labelled(s, d), _windows(s, d), 120_000)
    return out.select("packet_id", "window", "length", "ts_ms")


# each packet of a window sees the room those taken before it have left
QUOTA_SQL = P.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {D.WINDOWS_SQL}, {J12_SQL}, lined AS (
  SELECT packet_id, window_ord, length, ts_ms, row_number() OVER (PARTITION BY window_ord ORDER BY ts_ms, packet_id) AS rn FROM labelled WHERE window_ord IS NOT NULL),
walk(window_ord, rn, room, taken, packet_id) AS (
  SELECT ord, CAST(0 AS BIGINT), CAST(quota_bytes AS BIGINT), false, CAST(NULL AS BIGINT) FROM windows
  UNION ALL
  SELECT l.window_ord, l.rn, CASE WHEN l.length <= w.room THEN w.room - l.length ELSE w.room END, l.length <= w.room, l.packet_id FROM walk w JOIN lined l ON l.window_ord = w.window_ord AND l.rn = w.rn + 1),
summed AS (SELECT l.packet_id, l.window_ord, l.length, l.ts_ms, sum(l.length) OVER (ORDER BY l.ts_ms, l.packet_id ROWS UNBOUNDED PRECEDING) AS upto FROM walk w JOIN lined l ON l.packet_id = w.packet_id WHERE w.taken)
SELECT packet_id, name AS window, length, ts_ms FROM summed JOIN windows ON ord = window_ord WHERE upto <= 120000"""


def _related(s, d):
    """Flows rebuilt from packets share their key when a conversation paused, so they have relatives."""
    f = K.build_flows(D.packets(s, d), fixed.IDLE_MS, None, False, with_gaps=False)
    ends = F.concat_ws("/", F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip"), F.least("src_port", "dst_port"), F.greatest("src_port", "dst_port"))
    rows = f.select(
        F.concat_ws("@", ends, "bidirectional_first_seen_ms").alias("id"), F.timestamp_millis("bidirectional_first_seen_ms").alias("flow_timestamp"),
        F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("destination_ip"), F.col("src_port").alias("source_port"),
        F.col("dst_port").alias("destination_port"), "protocol")
    return triage.related(rows)


RELATED_SQL = _flow_sql(False, False, ("*",)).rsplit("SELECT", 1)[0] + """, rows AS (SELECT least(src_ip, dst_ip) || '/' || greatest(src_ip, dst_ip) || '/' || least(src_port, dst_port) || '/' || greatest(src_port, dst_port) || '@' || flow_start AS id,
    flow_start, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || protocol AS k FROM flow)
  SELECT a.id, CAST(row_number() OVER (PARTITION BY a.id ORDER BY b.flow_start DESC, b.id) - 1 AS INT) AS position, b.id AS related_id FROM rows a JOIN rows b ON a.k = b.k AND a.id <> b.id
  QUALIFY position < 10"""


def _family_rows(s, d):
    return enrich.with_family(D.flows(s, d).select("flow_id", F.col("raw_leaf").alias("label")))


def _sessions(s, d):
    """A session per user: their first event attaches the source one hour in."""
    e = D.table(s, d, "events")
    return e.groupBy(F.col("user_id").alias("session_id")).agg((F.min(F.unix_millis(F.col("ts").cast("timestamp"))) + 3_600_000).alias("attached_ms"))


def _after_attach(s, d):
    from flowsieve.operators import predicates

    ev = D.table(s, d, "events").select(F.col("user_id").alias("session_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return predicates.after_attach(ev, _sessions(s, d)).select("session_id", "event_id")


def _rate_stream_as_batch(s, d):
    """The sliding event rate as the stream computes it: 5-second windows every second."""
    p = D.packets(s, d).select(F.timestamp_millis("ts_ms").alias("ts"))
    g = p.groupBy(F.window("ts", "5 seconds", "1 second")).agg(F.count("*").alias("events"))
    return g.select(F.unix_millis("window.start").alias("start_ms"), "events", (F.col("events") / F.lit(5.0)).alias("eps"))


QUERIES = {
    "src9_attack_windows": (lambda s, d: _windows(s, d).select("ord", "name", "start_ms", "end_ms"), f"WITH {D.WINDOWS_SQL} SELECT ord, name, start_ms, end_ms FROM windows"),
    "j02_alert_first": (_alert_key("first"), _alert_key_sql("ASC")),
    "j02_alert_last": (_alert_key("last"), _alert_key_sql("DESC")),
    "j03_asof_alert": (_asof, A + f", {_asof_sql(0)} SELECT s.flow_id, c.event_id FROM scored s LEFT JOIN cand c ON c.flow_id = s.flow_id AND c.rn = 1"),
    "j04_interval_correlate": (_interval, INTERVAL_SQL),
    "j09_related": (_related, RELATED_SQL),
    "j10_with_service": (lambda s, d: enrich.with_service(D.flows(s, d), "dst_port").select("flow_id", "service"), f"WITH {D.FLOWS_SQL} SELECT flow_id, CASE dst_port WHEN 22 THEN 'SSH' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 53 THEN 'DNS' WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP-Alt' WHEN 21 THEN 'FTP' ELSE '' END AS service FROM flows"),
    "j11_with_family": (_family_rows, f"WITH {D.FLOWS_SQL} SELECT flow_id, raw_leaf AS label, raw_family AS family FROM flows"),
    "j12_label_by_window": (lambda s, d: _labelled(s, d).select("packet_id", "window_ord", "window"), P + f", {D.WINDOWS_SQL}, {J12_SQL} SELECT packet_id, window_ord, name AS window FROM labelled LEFT JOIN windows ON ord = window_ord"),
    "st1_flows_idle": (lambda s, d: _flows_of(s, d, None, False).select(*FULL), _flow_sql(False, False, FULL)),
    "st1_flows_idle_active": (lambda s, d: _flows_of(s, d, 10_000, False).select(*FULL), _flow_sql(False, True, FULL)),
    "st1_flows_flags_active": (lambda s, d: K.build_flows(D.packets(s, d).withColumn("flags", F.when(F.col("l_partkey") % 9 == 0, 17).otherwise(F.col("flags"))), fixed.IDLE_MS, 10_000, True).select(*SHORT),
                               _flow_sql(True, True, SHORT).replace("CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 24 ELSE 16 END AS flags", "CASE WHEN l_partkey % 9 = 0 THEN 17 WHEN l_returnflag = 'R' THEN 2 WHEN l_returnflag = 'N' THEN 24 ELSE 16 END AS flags")),
    "st6_event_rate": (_rate_stream_as_batch, P + "SELECT w AS start_ms, count(*) AS events, count(*) / CAST(5 AS DOUBLE) AS eps FROM (SELECT unnest(range((ts_ms // 1000) * 1000 - 4000, (ts_ms // 1000) * 1000 + 1, 1000)) AS w FROM packets) GROUP BY w"),
    "w04_eps": (lambda s, d: K.eps(D.packets(s, d)), P + ", c AS (SELECT ts_ms, count(*) OVER (ORDER BY ts_ms RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS n FROM packets) SELECT DISTINCT ts_ms, n * CAST(1000 AS DOUBLE) / 5000 AS eps FROM c"),
    "w05_quota_sample": (_quota, QUOTA_SQL),
    "w07_event_gaps": (lambda s, d: K.event_gaps(D.flows(s, d), 2.0).select("flow_id", "wait_s"), f"WITH {D.FLOWS_SQL} SELECT flow_id, least(coalesce((first_seen_ms - lag(first_seen_ms) OVER (ORDER BY first_seen_ms, flow_id)) / CAST(1000 AS DOUBLE) / 2, 0), 30) AS wait_s FROM flows"),
    "w09_rate_rule": (lambda s, d: K.rate_rule(D.packets(s, d), 1, 5).select("src_ip", "ts_ms", "in_window"), P + ", c AS (SELECT src_ip, ts_ms, count(*) OVER (PARTITION BY src_ip ORDER BY ts_ms RANGE BETWEEN 5000 PRECEDING AND CURRENT ROW) AS in_window FROM packets WHERE protocol = 6 AND flags = 2) SELECT DISTINCT src_ip, ts_ms, in_window FROM c WHERE in_window > 1"),
    "w09_trailing_pairs": (lambda s, d: trailing_counts(D.packets(s, d), "ts_ms", 20_000, ["src_ip", "dst_ip"]), P + ", c AS (SELECT src_ip, dst_ip, ts_ms, count(*) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts_ms RANGE BETWEEN 20000 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY src_ip, dst_ip, ts_ms) AS at_once FROM packets) SELECT DISTINCT * FROM c"),
    "w10_iat_stats": (_iat, IAT_SQL),
    "f12_after_attach": (_after_attach, "WITH a AS (SELECT user_id, min(epoch_ms(ts)) + 3600000 AS f FROM events GROUP BY user_id) SELECT e.user_id AS session_id, event_id FROM events e JOIN a USING (user_id) WHERE epoch_ms(e.ts) >= f"),
}
