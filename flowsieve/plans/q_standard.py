"""Registered queries: standardisation, scalar rules, corpora, knowledge base, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.functions import scoring as S
from flowsieve.functions import times as TM
from flowsieve.operators import analytics as A
from flowsieve.operators import correlate, enrich, standardize as Z, triage, verdict
from flowsieve.operators import packets as K
from flowsieve.operators.distributed import seeded_hash
from flowsieve.plans import driver_tables as D
from flowsieve.session import shared_folder
from flowsieve.sources import readers, sinks

MS = F.unix_millis
FL = f"WITH {D.FLOWS_SQL} "
SC = f"WITH {D.SCORED_SQL} "
J = f"WITH {D.JUDGED_SQL} "
P = f"WITH {D.PRED_SQL} "
C = f"WITH {D.CORPUS_SQL} "


# ---- meter records: the flows with counters that a meter would deliver, by integer arithmetic ------------------------

METER = {
    "src2dst_packets": "o % 40", "dst2src_packets": "c % 30", "src2dst_bytes": "o % 40 * 90", "dst2src_bytes": "c % 30 * 700",
    "bidirectional_packets": "o % 40 + c % 30", "bidirectional_bytes": "o % 40 * 90 + c % 30 * 700", "bidirectional_duration_ms": "o * 41 % 60000",
    "bidirectional_stddev_ps": "CAST(o % 300 AS DOUBLE) / 4", "bidirectional_mean_ps": "CAST(o % 900 AS DOUBLE) / 2", "src2dst_mean_ps": "CAST(c % 900 AS DOUBLE) / 2",
    "src2dst_min_ps": "CAST(c % 60 AS DOUBLE)", "src2dst_duration_ms": "o % 5000", "src2dst_mean_piat_ms": "CAST(o % 5000 AS DOUBLE) / 8",
    **{f"src2dst_{f}_packets": f"(o + {i}) % 5" for i, f in enumerate(fixed.TCP_FLAGS)},
    **{f"dst2src_{f}_packets": f"(c + {i}) % 4" for i, f in enumerate(fixed.TCP_FLAGS)},
}
METER_SQL = D.FLOWS_SQL + ", meter AS (SELECT flow_id, dst_port, protocol, " + ", ".join(f"{v} AS {k}" for k, v in METER.items()) + " FROM flows)"


def _meter(s, d):
    return D.flows(s, d).selectExpr("flow_id", "dst_port", "protocol", *[f"{v} AS {k}" for k, v in METER.items()])


def _short(cols):
    """Feature columns under names any engine accepts."""
    return [F.col(f"`{c}`").cast("double").alias(c.lower().replace(" ", "_").replace("/", "_")) for c in cols]


P2 = ["Dst Port", "Protocol", "Flow Duration", "Packet Length Variance", "Fwd Segment Size Avg", "Average Packet Size", "Fwd Seg Size Min", "Fwd Act Data Pkts",
      "Fwd IAT Total", "Fwd IAT Mean", "FIN Flag Count", "CWR Flag Count", "ECE Flag Count", "Fwd PSH Flags", "Bwd URG Flags", "Fwd Header Length",
      "Bwd Header Length", "Down/Up Ratio", "Subflow Bwd Bytes"]
P2_SQL = f"""WITH {METER_SQL} SELECT flow_id, CAST(dst_port AS DOUBLE) AS dst_port, CAST(protocol AS DOUBLE) AS protocol, CAST(bidirectional_duration_ms AS DOUBLE) AS flow_duration,
  bidirectional_stddev_ps * bidirectional_stddev_ps AS packet_length_variance, src2dst_mean_ps AS fwd_segment_size_avg, bidirectional_mean_ps AS average_packet_size,
  src2dst_min_ps AS fwd_seg_size_min, CAST(src2dst_packets AS DOUBLE) AS fwd_act_data_pkts, CAST(src2dst_duration_ms AS DOUBLE) AS fwd_iat_total, src2dst_mean_piat_ms AS fwd_iat_mean,
  CAST(src2dst_fin_packets + dst2src_fin_packets AS DOUBLE) AS fin_flag_count, CAST(src2dst_cwr_packets + dst2src_cwr_packets AS DOUBLE) AS cwr_flag_count,
  CAST(src2dst_ece_packets + dst2src_ece_packets AS DOUBLE) AS ece_flag_count, CAST(src2dst_psh_packets AS DOUBLE) AS fwd_psh_flags, CAST(dst2src_urg_packets AS DOUBLE) AS bwd_urg_flags,
  CAST(src2dst_packets * 20 AS DOUBLE) AS fwd_header_length, CAST(dst2src_packets * 20 AS DOUBLE) AS bwd_header_length,
  CAST(dst2src_packets AS DOUBLE) / CASE WHEN src2dst_packets = 0 THEN 1 ELSE src2dst_packets END AS down_up_ratio, CAST(dst2src_bytes AS DOUBLE) AS subflow_bwd_bytes FROM meter"""


def _to_features(s, d):
    return Z.to_features(_meter(s, d)).select("flow_id", *_short(P2))


LIVE = ("flow_bytes_per_sec", "flow_packets_per_sec", "fwd_packets_per_sec", "bwd_packets_per_sec", "down_up_ratio", "packet_length_variance",
        "fwd_header_length", "bwd_header_length", "syn_flag_count", "rst_flag_count")
SECS = "(bidirectional_duration_ms / CAST(1000 AS DOUBLE) + CAST(1e-9 AS DOUBLE))"
P7_SQL = f"""WITH {METER_SQL} SELECT flow_id, bidirectional_bytes / {SECS} AS flow_bytes_per_sec, bidirectional_packets / {SECS} AS flow_packets_per_sec, src2dst_packets / {SECS} AS fwd_packets_per_sec,
  dst2src_packets / {SECS} AS bwd_packets_per_sec, CASE WHEN src2dst_packets > 0 THEN CAST(dst2src_packets AS DOUBLE) / src2dst_packets ELSE 0 END AS down_up_ratio,
  bidirectional_stddev_ps * bidirectional_stddev_ps AS packet_length_variance, src2dst_packets * 20 AS fwd_header_length, dst2src_packets * 20 AS bwd_header_length,
  src2dst_syn_packets + dst2src_syn_packets AS syn_flag_count, src2dst_rst_packets + dst2src_rst_packets AS rst_flag_count FROM meter"""


def _complete_features(s, d):
    """All 70 features of the meter records: the sum of each row and how many are not zero."""
    f = Z.ensure_features(Z.clean(Z.to_features(_meter(s, d))), keep=["flow_id"])
    cols = [F.col(f"`{c}`") for c in fixed.FEATURES]
    arr = F.array(*cols)
    return f.select("flow_id", F.size(arr).alias("features"), F.size(F.filter(arr, lambda x: x != 0)).alias("filled"))


P5_SQL = f"""WITH {METER_SQL}, v AS (SELECT flow_id, unnest([CAST(dst_port AS DOUBLE), protocol, bidirectional_duration_ms, bidirectional_stddev_ps, bidirectional_stddev_ps,
  bidirectional_mean_ps, bidirectional_mean_ps, src2dst_mean_ps, src2dst_mean_ps, src2dst_min_ps, src2dst_min_ps, src2dst_packets, src2dst_packets, src2dst_packets, dst2src_packets, dst2src_packets,
  src2dst_bytes, dst2src_bytes, src2dst_duration_ms, src2dst_mean_piat_ms, dst2src_packets, src2dst_psh_packets, dst2src_psh_packets, src2dst_urg_packets, dst2src_urg_packets,
  {', '.join(f'src2dst_{f}_packets + dst2src_{f}_packets' for f in fixed.TCP_FLAGS)}]) AS x, src2dst_packets FROM meter)
  SELECT flow_id, 70 AS features, CAST(count(*) FILTER (x <> 0) AS INT) AS filled FROM v GROUP BY flow_id"""

# ---- other vocabularies -------------------------------------------------------------------------------------------

TEXT = "CASE o % 23 WHEN 0 THEN '' WHEN 1 THEN 'abc' WHEN 2 THEN 'Infinity' WHEN 3 THEN 'NaN' WHEN 4 THEN '-Infinity' ELSE CAST(o % 977 AS VARCHAR) END"
TEXT_SPARK = TEXT.replace("VARCHAR", "STRING")
NUM = "CASE WHEN o % 23 <= 4 THEN CAST(0 AS DOUBLE) ELSE CAST(o % 977 AS DOUBLE) END"


def _hash_rows(s, d):
    h = D.flows(s, d).selectExpr("flow_id", f"{TEXT_SPARK} AS flow_duration", "if(o % 5 = 0, '', CAST(c AS STRING)) AS idle_max", "CAST(o AS STRING) AS `Idle Max`", "'7' AS `Active Max`", "CAST(dst_port AS STRING) AS dst_port")
    return Z.hash_to_features(h, keep=["flow_id"]).select("flow_id", *_short(["Flow Duration", "Idle Max", "Active Max", "Dst Port", "Bwd IAT Std"]))


def _short_rows(s, d):
    h = D.flows(s, d).selectExpr("flow_id", f"{TEXT_SPARK} AS flow_duration", "CAST(c AS STRING) AS pkt_len_max", "CAST(o % 9 AS DOUBLE) / 8 AS idle_std", "CAST(o % 9 AS DOUBLE) / 8 AS fwd_seg_size_avg")
    return Z.short_to_features(h).select("flow_id", F.col("Flow Duration").alias("flow_duration_raw"), *_short(["Packet Length Max", "Idle Std", "Fwd Segment Size Avg"]))


def _clean_rows(s, d):
    h = D.flows(s, d).selectExpr("flow_id", f"{TEXT_SPARK} AS `Flow Duration`", "if(o % 3 = 0, CAST('NaN' AS DOUBLE), CAST(o AS DOUBLE)) AS extra", "if(o % 4 = 0, NULL, c) AS whole", "if(o % 7 = 0, NULL, src_ip) AS note")
    return Z.clean(h).select("flow_id", *_short(["Flow Duration"]), "extra", "whole", "note")


def _corpus_rows(s, d):
    a, b = (Z.normalize_labels(Z.normalize_columns(D.corpus(s, d, y), y)) for y in (2017, 2018))
    extra = ["Label", "__source", "row_id"]
    return Z.union_corpora(a, b, extra=extra)


def _numeric_corpus(s, d):
    u = _corpus_rows(s, d)
    feats = [c for c in u.columns if c in fixed.FEATURES]
    return u.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in feats], "Label", "__source", "row_id"), feats


def _union(s, d):
    u = _corpus_rows(s, d)
    return u.select(F.col("Dst Port").alias("dst_port"), F.col("Packet Length Max").alias("len_max"), F.col("Fwd Header Length").alias("header"), F.col("Label").alias("label"),
                    F.col("__source").alias("source"), "row_id")


def _incomplete(s, d):
    u, feats = _numeric_corpus(s, d)
    return Z.drop_incomplete(u, feats).select("row_id")


def _dedup(s, d):
    u, feats = _numeric_corpus(s, d)
    return Z.dedup(Z.drop_incomplete(u, feats), feats, ["row_id", "Label"]).select("row_id", *_short(["Dst Port", "Flow Duration", "Packet Length Max", "Fwd Header Length"]))


def _label_counts(s, d):
    return A.label_counts(_corpus_rows(s, d)).select(F.col("Label").alias("label"), F.col("__source").alias("source"), "rows")


def _normalized(s, d):
    """Column names after normalisation, with the sum of a column two names compete for."""
    a = Z.normalize_columns(D.corpus(s, d, 2017), 2017)
    return a.select(F.col("Dst Port").alias("dst_port"), F.col("Packet Length Max").alias("len_max"), F.col("Fwd Header Length").alias("header"), F.col("Total Fwd Packet").alias("fwd_packets"), "row_id")


def _cap(s, d):
    u = _corpus_rows(s, d).withColumn("h", seeded_hash(["row_id", "Label"], 7))
    u = u.withColumn("Label", F.when(F.col("row_id") % 3 == 0, fixed.BENIGN).otherwise(F.col("Label")))
    return K.cap_benign(u, {"Y2017": None, "Y2018": 5000}, "h").select("row_id", F.col("Label").alias("label"), F.col("__source").alias("source"))


def _unmapped(s, d):
    raw = D.corpus(s, d, 2018).withColumn("Label", F.trim("Label"))
    return Z.unmapped_labels(raw).select(F.col("Label").alias("label"), "rows")


def _coverage(s, d):
    a, b = Z.normalize_columns(D.corpus(s, d, 2017), 2017), Z.normalize_columns(D.corpus(s, d, 2018), 2018)
    shared = [c for c in fixed.FEATURES if c in a.columns and c in b.columns]
    u, _ = _numeric_corpus(s, d)
    return Z.value_profile(u, shared)


def _downcast(s, d):
    t = Z.downcast(D.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema.fields}
    return t.groupBy(F.lit(kinds["l_orderkey"]).alias("key_type"), F.lit(kinds["l_quantity"]).alias("quantity_type")).agg(
        F.count("*").alias("rows"), F.sum(F.col("l_quantity").cast("double")).alias("quantity"))


# ---- text forms ---------------------------------------------------------------------------------------------------

def _parsed_keys(s, d):
    f = D.flows(s, d)
    key = F.when(F.col("o") % 10 == 0, F.concat(F.lit("bad-"), F.col("o").cast("string"))).when(
        F.col("o") % 10 == 1, F.concat(F.lit("fe80::"), F.col("c").cast("string"), F.lit(":443-::1:53-UDP"))).otherwise(
        N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol"))
    return f.select("flow_id", N.parse_flow_key(key).alias("k")).select("flow_id", "k.*")


def _addr_port(s, d):
    e = D.table(s, d, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[fe80::"), F.col("user_id").cast("string"), F.lit("]:"), F.col("event_id").cast("string"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("10.0.0."), F.col("user_id").cast("string"), F.lit(":"), F.col("event_id").cast("string"))).otherwise(
        F.concat(F.lit("10.0.0.1:"), F.col("event_type")))
    return e.select("event_id", N.split_addr_port(text).alias("a")).select("event_id", "a.addr", "a.port")


def _alert_lines(s, d):
    """Alert lines in the spellings sensors use, some of them broken."""
    a = D.alerts(s, d)
    f = lambda fmt, *c: F.format_string(fmt, *[F.col(x) for x in c])
    split = f('{"src_addr":"%s","src_port":%d,"dst_addr":"%s","dst_port":%d,"proto":"tcp","sid":%d,"msg":"m %d","priority":2}', "src_ip", "src_port", "dst_ip", "dst_port", "snort_sid", "event_id")
    joined = f('{"src_ap":"%s:%d","dst_ap":"%s:%d","rule":"1:%d:4","class":"c","action":"allow"}', "src_ip", "src_port", "dst_ip", "dst_port", "snort_sid")
    broken = f('{"src_addr":"%s","broken', "src_ip")
    missing = f('{"src_addr":"%s","sid":%d}', "src_ip", "snort_sid")
    k = F.floor(F.col("event_id") / 5) % 4
    return a.select("event_id", F.when(k == 0, split).when(k == 1, joined).when(k == 2, broken).otherwise(missing).alias("value"))


def _alerts_from_files(s, d):
    """Alerts written as JSON files in three spellings, with broken lines between, read back through the public reader and joined with the flows."""
    a = D.alerts(s, d).withColumn("proto", N.protocol_name("protocol"))
    at = F.timestamp_millis("alert_ms")
    k = F.floor(F.col("event_id") / 5) % 4
    side = lambda way, split: {f"{way}_addr": F.col(f"{way}_ip"), f"{way}_port": F.col(f"{way}_port")} if split else {f"{way}_ap": F.concat(f"{way}_ip", F.lit(":"), f"{way}_port")}
    line = lambda **cells: F.to_json(F.struct(*[v.alias(n) for n, v in cells.items()], F.col("proto"), F.col("snort_sid").alias("sid")))
    lines = (F.when(k == 0, line(**side("src", True), **side("dst", True), seconds=F.col("alert_ms") / 1000))
             .when(k == 1, line(**side("src", False), **side("dst", False), timestamp=F.date_format(at, "yy/MM/dd-HH:mm:ss.SSSSSS")))
             .when(k == 2, line(**side("src", False), **side("dst", True), timestamp=F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))).otherwise(F.lit('{"src_addr": "1.1')))
    folder = f"{shared_folder(s)}/alerts-{uuid.uuid4().hex}"
    a.select(lines.alias("value")).write.text(folder)
    joined = correlate.correlate(D.flows(s, d), readers.read_alerts(s, folder))
    return joined.filter("alert is not null").select("flow_id", "alert.alert_ms")


ALERT_FILES_SQL = f"""WITH {D.FLOWS_SQL},{D.ALERTS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY alert_ms) AS n FROM alerts WHERE event_id // 5 % 4 < 3)
SELECT f.flow_id, coalesce(x.alert_ms, y.alert_ms) AS alert_ms FROM flows f
  LEFT JOIN a x ON x.n = 1 AND (x.src_ip, x.dst_ip, x.src_port, x.dst_port, x.protocol) = (f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol)
  LEFT JOIN a y ON y.n = 1 AND (y.src_ip, y.dst_ip, y.src_port, y.dst_port, y.protocol) = (f.dst_ip, f.src_ip, f.dst_port, f.src_port, f.protocol)
WHERE x.n = 1 OR y.n = 1"""


def _times_from_files(s, d):
    """Events written as CSV files with a doubled header and day-first times without leading zeros, read back with their times."""
    at = F.timestamp_seconds(F.lit(1499410000) + F.col("event_id") * 61)
    e = D.table(s, d, "events").select(F.col("event_id").alias("Dst Port"), F.date_format(at, "d/M/yyyy H:mm").alias(" Timestamp"), (F.col("event_id") % 100).alias(" Fwd Header Length"), F.lit(-1).alias("again"))
    folder = f"{shared_folder(s)}/flows-{uuid.uuid4().hex}"
    header = F.lit("Dst Port, Timestamp, Fwd Header Length, Fwd Header Length")
    rows = e.select(F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in e.columns]).alias("value"))
    opens = F.monotonically_increasing_id() % (1 << 33) == 0  # the first row of each file
    rows.select(F.concat(F.when(opens, F.concat(header, F.lit("\n"))).otherwise(F.lit("")), F.col("value")).alias("value")).write.text(folder)
    read = readers.read_flow_csv(s, folder)
    return read.select(F.col("Dst Port").cast("long").alias("event_id"), MS(Z.event_time(read, D.as_of())).alias("time_ms"), F.col("Fwd Header Length").cast("long").alias("fwd_header"))


def _normalized_alerts(s, d):
    return Z.normalize_alerts(_alert_lines(s, d)).select("event_id", "flow_key", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "snort_sid", "snort_msg", "snort_classtype", "snort_priority", "snort_action")


ALERT_LINE_SQL = f"""WITH {D.FLOWS_SQL},{D.ALERTS_SQL}, k AS (SELECT *, event_id // 5 % 4 AS k FROM alerts)
SELECT event_id, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-TCP' AS flow_key, src_ip, dst_ip, src_port, dst_port, 'TCP' AS protocol, snort_sid,
  CASE WHEN k = 0 THEN 'm ' || event_id ELSE '' END AS snort_msg, CASE WHEN k = 1 THEN 'c' ELSE '' END AS snort_classtype, CASE WHEN k = 0 THEN 2 ELSE 0 END AS snort_priority,
  CASE WHEN k = 1 THEN 'allow' ELSE '' END AS snort_action FROM k WHERE k < 2"""


def _event_times(s, d):
    e = D.table(s, d, "events").selectExpr(
        "event_id", "CASE WHEN event_id % 4 = 0 THEN 1704067200000 + event_id * 1000 WHEN event_id % 4 = 1 THEN 0 END AS bidirectional_first_seen_ms",
        "CASE event_id % 4 WHEN 1 THEN concat('2024-01-02T03:04:', lpad(CAST(event_id % 60 AS STRING), 2, '0')) WHEN 2 THEN concat('07/02/2024 10:', lpad(CAST(event_id % 60 AS STRING), 2, '0')) ELSE 'unknown' END AS Timestamp")
    return e.select("event_id", MS(Z.event_time(e, D.as_of())).alias("time_ms"))


def _parsed_times(s, d):
    e = D.table(s, d, "events").selectExpr(
        "event_id", "CASE event_id % 3 WHEN 0 THEN concat('2024-01-05T06:07:', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '+02:00') WHEN 1 THEN concat('2024-01-05 06:07:', lpad(CAST(event_id % 60 AS STRING), 2, '0')) ELSE 'soon' END AS t",
        "CASE event_id % 2 WHEN 0 THEN CAST(event_id AS STRING) ELSE 'x' END AS v")
    return e.select("event_id", MS(TM.parse_iso("t")).alias("ms"), TM.safe_double("v").alias("v"))


def _validated(s, d):
    f = D.flows(s, d).selectExpr(
        "flow_id", "if(o % 11 = 0, 70000, src_port) AS sport", "CAST(dst_port AS INT) AS dsport", "if(o % 13 = 0, 'gre', 'TCP') AS proto",
        "if(o % 17 = 0, '300.1.1.1', src_ip) AS srcip", "if(o % 19 = 0, '', dst_ip) AS dstip", "if(o % 7 = 0, -1.0D, duration) AS dur", "c % 50 - 1 AS sbytes")
    v, r = Z.split_valid(f)
    valid = v.select("flow_id", F.lit("").alias("reasons"))
    return valid.unionByName(r.select("flow_id", F.concat_ws("; ", "reasons").alias("reasons")))


P23_SQL = FL + """SELECT flow_id, concat_ws('; ', CASE WHEN o % 11 = 0 THEN 'Source Port out of range' END, CASE WHEN o % 13 = 0 THEN 'Protocol not supported' END,
  CASE WHEN o % 17 = 0 THEN 'Source IP not IPv4' END, CASE WHEN o % 7 = 0 THEN 'dur negative' END, CASE WHEN c % 50 = 0 THEN 'sbytes negative' END) AS reasons FROM flows"""


def _conn(s, d):
    f = D.flows(s, d).selectExpr(
        "flow_id", "CAST(protocol AS INT) AS proto", "CAST(c % 30 AS DOUBLE) / 4 AS dur", "o % 40 * 90 AS sbytes", "c % 30 * 700 AS dbytes", "o % 40 AS spkts", "c % 30 AS dpkts",
        "CAST(o % 16 + 1 AS DOUBLE) / 8 AS syn_time", "CAST(o % 16 + 3 AS DOUBLE) / 8 AS synack_time", "CAST(o % 16 + 8 AS DOUBLE) / 8 AS ack_time",
        "CAST(o % 32 AS INT) AS src_flags", "CAST(c % 32 AS INT) AS dst_flags")
    out = Z.derive_conn_features(f)
    by_bytes = Z.connection_state_by_bytes(F.col("proto"), F.col("sbytes"), F.col("dbytes")).alias("state_by_bytes")
    return out.select("flow_id", "sload", "dload", "smeansz", "dmeansz", "synack", "ackdat", "tcprtt", "state", by_bytes)


P9_SQL = FL + """, r AS (SELECT *, CAST(c % 30 AS DOUBLE) / 4 AS dur, o % 40 * 90 AS sbytes, c % 30 * 700 AS dbytes, o % 40 AS spkts, c % 30 AS dpkts, o % 32 AS sf, c % 32 AS df FROM flows)
SELECT flow_id, CASE WHEN dur > 0 THEN sbytes * 8 / dur ELSE 0 END AS sload, CASE WHEN dur > 0 THEN dbytes * 8 / dur ELSE 0 END AS dload, CASE WHEN spkts > 0 THEN CAST(sbytes AS DOUBLE) / spkts ELSE 0 END AS smeansz,
  CASE WHEN dpkts > 0 THEN CAST(dbytes AS DOUBLE) / dpkts ELSE 0 END AS dmeansz, CAST(0.25 AS DOUBLE) AS synack, CAST(0.625 AS DOUBLE) AS ackdat, CAST(0.875 AS DOUBLE) AS tcprtt,
  CASE WHEN protocol <> 6 THEN 'CON' WHEN (sf & 4) <> 0 OR (df & 4) <> 0 THEN 'RST' WHEN (sf & 1) <> 0 AND (df & 1) <> 0 THEN 'FIN' WHEN (sf & 2) <> 0 AND (df & 2) <> 0 AND (df & 16) <> 0 THEN 'CON'
       WHEN (sf & 2) <> 0 AND (df & 2) = 0 THEN 'REQ' ELSE 'CON' END AS state,
  CASE WHEN protocol IN (17, 1) THEN 'CON' WHEN sbytes > 0 AND dbytes > 0 THEN 'CON' WHEN sbytes > 0 THEN 'REQ' ELSE 'INT' END AS state_by_bytes FROM r"""


def _jitter(s, d):
    return Z.jitter(D.packets(s, d), ["src_ip", "dst_ip"], tie=["packet_id"])


JITTER_SQL = f"""WITH {D.PACKETS_SQL}, a AS (SELECT src_ip, dst_ip, ts_ms, packet_id, ts_ms - lag(ts_ms) OVER w AS g FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts_ms, packet_id)),
b AS (SELECT src_ip, dst_ip, abs(g - lag(g) OVER w) AS j FROM a WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts_ms, packet_id))
SELECT src_ip, dst_ip, coalesce(CAST(sum(j) AS DOUBLE) / nullif(count(j), 0), 0) AS jitter_ms FROM b GROUP BY ALL"""


# ---- events, views, exports ---------------------------------------------------------------------------------------

def _events(s, d, mode="hybrid"):
    j = D.scored(s, d)
    from flowsieve.operators import correlate

    j = correlate.correlate(j, D.alerts(s, d).drop("o"))
    model = F.struct("prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "stage2_probs", "stage3_p", "stage3_probs")
    full = F.when(F.col("alert").isNotNull(), F.struct(
        F.col("alert.snort_sid").alias("snort_sid"), F.col("alert.snort_msg").alias("snort_msg"), F.col("alert.snort_classtype").alias("snort_classtype"),
        F.col("alert.snort_priority").alias("snort_priority"), F.when(F.col("o") % 2 == 0, F.lit("172.16.0.9")).otherwise("").alias("src_ip"), F.lit(None).cast("string").alias("dst_ip"),
        F.lit(0).alias("src_port"), F.lit(9).alias("dst_port"), F.lit("UDP").alias("protocol")))
    joined = j.select(
        F.concat(F.lit("evt_"), F.col("o").cast("string")).alias("id"), F.timestamp_millis("first_seen_ms").alias("timestamp"),
        N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("flow_key"), model.alias("model"), full.alias("alert"))
    return Z.apply_mode(Z.build_events(joined, D.MODEL_VERSION), mode)


EVENT_COLS = ("id", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "source", "snort_sid", "snort_msg")
EVENTS_SQL = J + """, ev AS (SELECT 'evt_' || o AS id, CASE WHEN event_id IS NOT NULL AND o % 2 = 0 THEN '172.16.0.9' ELSE src_ip END AS src_ip, dst_ip, src_port, CASE WHEN event_id IS NOT NULL THEN 9 ELSE dst_port END AS dst_port,
  CASE WHEN event_id IS NOT NULL THEN 'UDP' ELSE CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END END AS protocol, prediction, confidence, severity, attack_type, family, stage1_p, stage2_p, stage3_p, source,
  coalesce(snort_sid, 0) AS snort_sid, coalesce(snort_msg, '') AS snort_msg, first_seen_ms FROM judged)
"""
COLS = ", ".join(EVENT_COLS)


def _mode_sql(mode):
    if mode == "ml":
        return EVENTS_SQL + f"SELECT {COLS.replace(', source', '').replace(', snort_sid', '').replace(', snort_msg', '')}, CASE source WHEN 'confirmed' THEN 'ml_only' ELSE source END AS source, 0 AS snort_sid, '' AS snort_msg FROM ev WHERE source <> 'signature_only'"
    return EVENTS_SQL + f"SELECT {COLS.replace(', stage1_p', '').replace(', stage2_p', '').replace(', source', '')}, CAST(NULL AS DOUBLE) AS stage1_p, CAST(NULL AS DOUBLE) AS stage2_p, CASE source WHEN 'confirmed' THEN 'signature_only' ELSE source END AS source FROM ev WHERE source <> 'ml_only'"


def _queue_rows(s, d):
    q = Z.live_to_queue(_events(s, d).withColumn("mitre", F.lit(None).cast("struct<confidence_band:string,tactics:array<struct<id:string,name:string>>>")))
    return q.select("id", "source_ip", "destination_port", "packet_size", "duration", "subtype", "ack_state", "source", MS("flow_timestamp").alias("flow_ms"))


def _summary(s, d):
    v = Z.summary_view(D.fresh_predictions(s, d))
    return v.select("id", MS("timestamp").alias("ms"), "sourceIp", "destinationPort", "packetSize", "snort_sid", F.col("mitre.confidence_band").alias("band"), F.size(F.coalesce(F.map_keys(F.from_json(F.to_json("mitre"), "map<string,string>")), F.array())).alias("mitre_fields"))


def _full(s, d):
    v = Z.full_view(Z.queue_defaults(D.fresh_predictions(s, d), D.as_of()))
    return v.select("id", "sourceIp", "snort_sid", "snort_msg", MS("firstSeenAt").alias("stored_ms"), F.size("mlFeatures").alias("features"), F.size(F.coalesce("stage2_probs", F.create_map().cast("map<string,double>"))).alias("classes"))


def _exported(s, d):
    e = sinks.export_rows(D.predictions(s, d))
    text = [F.col(f"`{c}`").cast("string").alias(c.lower().replace(" ", "_")) for c in fixed.EXPORT_COLUMNS if c != "Duration"]
    return e.select(*text, S.round_to(F.col("Duration").cast("double"), 6).alias("duration"))


EXPORT_SQL = P + """SELECT strftime(flow_timestamp, '%Y-%m-%dT%H:%M:%S') AS timestamp, source_ip, destination_ip, CAST(source_port AS VARCHAR) AS source_port, CAST(destination_port AS VARCHAR) AS destination_port, protocol,
  CAST(packet_size AS VARCHAR) AS packet_size, prediction, coalesce(family, '') AS family, coalesce(attack_type, '') AS attack_type, source AS verdict, CAST(CAST(round(CAST(confidence AS DECIMAL(24,12)), 2) AS DECIMAL(10,2)) AS VARCHAR) AS confidence,
  coalesce(severity, 'N/A') AS severity, CAST(snort_sid AS VARCHAR) AS snort_sid, snort_msg, ack_state,
  round(CAST(duration AS DECIMAL(38,12)), 6)::DOUBLE AS duration FROM pred"""


def _log_rows(s, d):
    e = enrich.enrich_attack(_events(s, d), enrich.default_kb(s))
    r = sinks.session_log_rows(e.withColumn("timestamp", MS("timestamp").cast("string")))
    numbers = ("confidence", "stage1_p", "stage2_p", "stage3_p")
    return r.select(*[S.round_to(F.expr(f"try_cast({c} AS DOUBLE)"), 6).alias(c) if c in numbers else c for c in fixed.SESSION_LOG_COLUMNS])


LOG_SQL = EVENTS_SQL + f""", {D.KB_SQL} SELECT CAST(first_seen_ms AS VARCHAR) AS timestamp, src_ip, dst_ip, CAST(src_port AS VARCHAR) AS src_port, CAST(dst_port AS VARCHAR) AS dst_port, protocol, source AS verdict, prediction,
  coalesce(family, '') AS family, coalesce(attack_type, '') AS leaf, coalesce(severity, '') AS severity, CASE WHEN snort_sid = 0 THEN '' ELSE CAST(snort_sid AS VARCHAR) END AS snort_sid, snort_msg,
  CASE WHEN snort_sid = 0 THEN '' ELSE {D._case('snort_sid', {D.SIDS[k]: v for k, v in D.CLASSES.items()}, "''")} END AS snort_classtype,
  CASE WHEN prediction = 'Malicious' AND confidence >= 0.7 AND attack_type IS NOT NULL THEN (SELECT tactic FROM kb_tactic k WHERE k.category = attack_type AND pos = 0) ELSE '' END AS mitre_tactic, '{D.MODEL_VERSION}' AS model_version,
  {", ".join(f"round(CAST({c} AS DECIMAL(38,12)), 6)::DOUBLE AS {c}" for c in ("confidence", "stage1_p", "stage2_p", "stage3_p"))} FROM ev"""


def _reports(s, d):
    p = enrich.with_usernames(D.predictions(s, d), D.users(s, d))
    r = sinks.incident_reports(p)
    lines = F.split("report", "\n")
    return r.select("id", F.size(lines).alias("lines"), F.element_at(lines, 1).alias("title"), F.element_at(lines, 16).alias("key_line"), F.md5(F.element_at(lines, -1)).alias("last_md5"))


def _trail_lines(s, d):
    t = triage.with_ack_trail(D.fresh_predictions(s, d).select("id"), D.ack_log(s, d), D.users(s, d))
    return sinks.incident_trail(t).select("id", "change_id", "line")


TRAIL_SQL = f"""WITH {D.ACK_SQL}, {D.USERS_SQL}, l AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY prediction_id ORDER BY changed_ms, id), 'new') AS from_state FROM ack_log)
SELECT prediction_id AS id, l.id AS change_id, '- ' || coalesce(u.username, 'unknown') || ': ' || from_state || ' → ' || to_state || ' (' || strftime(make_timestamp(changed_ms * 1000), '%Y-%m-%dT%H:%M:%S') || ')' AS line FROM l LEFT JOIN users u ON u.id = l.user_id"""


def _traffic_rows(s, d):
    f = D.flows(s, d).selectExpr("CAST(first_seen_ms AS STRING) AS timestamp", "src_ip", "dst_ip", "src_port AS sport", "dst_port AS dport", "if(o % 5 = 0, NULL, 'x') AS service", "flow_id AS other")
    r = sinks.traffic_log_rows(f)
    return r


TRAFFIC_SQL = {"timestamp": "CAST(first_seen_ms AS VARCHAR)", "src_ip": "src_ip", "dst_ip": "dst_ip", "sport": "CAST(src_port AS VARCHAR)", "dport": "CAST(dst_port AS VARCHAR)", "service": "CASE WHEN o % 5 = 0 THEN '' ELSE 'x' END"}


# ---- scalar rules -------------------------------------------------------------------------------------------------

def _scalars(s, d):
    f = D.flows(s, d)
    p2, p3 = F.col("raw2_p"), F.col("raw3_p")
    sev = F.when(F.col("o") % 4 == 0, "High").when(F.col("o") % 4 == 1, "Medium").when(F.col("o") % 4 == 2, "Low")
    lab = F.when(F.col("o") % 3 == 0, "Malicious").when(F.col("o") % 3 == 1, "Suspicious").otherwise("Normal")
    age = F.col("o") * 7 % 200000
    return f.select(
        "flow_id", S.hierarchical_severity(p3, p2).alias("severity"), S.single_severity(p2).alias("single"), S.confidence_band(p2).alias("band"),
        S.age_bucket(age).alias("bucket"), S.compact_age(age).alias("age"), S.quality(F.when(F.col("o") % 5 == 0, F.lit(None).cast("double")).otherwise(p2)).alias("quality"),
        S.risk_level(lab, sev).alias("risk"), S.chained_confidence(F.col("stage1_p"), p2, p3).alias("chained"),
        N.protocol_name("protocol").alias("proto"), N.protocol_name(F.col("o") % 140, wide=True).alias("wide"), N.protocol_name(F.lit("udp")).alias("named"))


SCALARS_SQL = FL + f"""SELECT flow_id, CASE WHEN raw3_p >= 0.95 AND raw2_p >= 0.90 THEN 'High' WHEN raw3_p >= 0.8 AND raw2_p >= 0.7 THEN 'Medium' ELSE 'Low' END AS severity,
  CASE WHEN raw2_p > 0.9 THEN 'High' WHEN raw2_p > 0.8 THEN 'Medium' ELSE 'Low' END AS single,
  CASE WHEN raw2_p >= 0.7 AND raw2_p < 0.85 THEN 'low' WHEN raw2_p >= 0.85 AND raw2_p < 0.95 THEN 'high' WHEN raw2_p >= 0.95 THEN 'very_high' ELSE 'low' END AS band,
  CASE WHEN o * 7 % 200000 < 300 THEN 'fresh' WHEN o * 7 % 200000 < 1800 THEN 'aging' WHEN o * 7 % 200000 < 14400 THEN 'stale' ELSE 'overdue' END AS bucket,
  CASE WHEN o * 7 % 200000 < 60 THEN (o * 7 % 200000) || 's' WHEN o * 7 % 200000 < 3600 THEN (o * 7 % 200000 // 60) || 'm' WHEN o * 7 % 200000 < 86400 THEN (o * 7 % 200000 // 3600) || 'h' ELSE (o * 7 % 200000 // 86400) || 'd' END AS age,
  CASE WHEN o % 5 = 0 THEN NULL WHEN raw2_p >= 0.9 THEN 'Corroborated' WHEN raw2_p >= 0.7 THEN 'Likely' ELSE 'Uncertain' END AS quality,
  CASE o % 3 WHEN 0 THEN CASE o % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' ELSE 'Medium' END WHEN 1 THEN 'Medium' ELSE 'None' END AS risk, {D.r4('stage1_p * raw2_p * raw3_p')} AS chained,
  CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS proto, CASE o % 140 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 58 THEN 'ICMPv6' WHEN 132 THEN 'SCTP' ELSE CAST(o % 140 AS VARCHAR) END AS wide, 'UDP' AS named FROM flows"""


def _top_probs(s, d):
    t = D.scored(s, d).filter("stage2_probs is not null").select("flow_id", F.posexplode(S.top_entries("stage2_probs", 2)).alias("pos", "e"))
    return t.select("flow_id", "pos", F.col("e.key").alias("label"), F.col("e.value").alias("p"))


OTHERS = D.r4("(1 - raw2_p) / CAST(5 AS DOUBLE)")
TOP_SQL = SC + f""", l AS (SELECT flow_id, raw_family, raw2_p, unnest({D._sql_list(fixed.FAMILIES)}) AS label FROM scored WHERE prediction = 'Malicious'),
  v AS (SELECT flow_id, label, CASE WHEN label = raw_family THEN {D.r4('raw2_p')} ELSE {OTHERS} END AS p FROM l)
  SELECT flow_id, CAST(row_number() OVER (PARTITION BY flow_id ORDER BY p DESC, label) - 1 AS INT) AS pos, label, p FROM v QUALIFY pos < 2"""


def _single(s, d):
    f = D.flows(s, d)
    probs = F.create_map(*[x for leaf in fixed.LEAVES for x in (
        F.lit(leaf), F.when(F.col("raw_leaf") == leaf, F.col("raw2_p")).when(F.lit(leaf) == fixed.BENIGN, F.col("stage1_p") * 0.9).otherwise(F.lit(0.001)))])
    return verdict.score_single(f.withColumn("probs", probs)).select("flow_id", "prediction", "confidence", "severity", "attack_type", "stage1_p")


SINGLE_SQL = FL + f""", b AS (SELECT flow_id, raw_leaf, raw2_p, stage1_p * CAST(0.9 AS DOUBLE) AS bp, raw2_p > stage1_p * CAST(0.9 AS DOUBLE) OR (raw2_p = stage1_p * CAST(0.9 AS DOUBLE) AND raw_leaf < 'Benign') AS attack FROM flows)
  SELECT flow_id, CASE WHEN attack THEN 'Malicious' ELSE 'Normal' END AS prediction, CASE WHEN attack THEN {D.r4('raw2_p')} ELSE {D.r4('bp')} END AS confidence,
  CASE WHEN NOT attack THEN NULL WHEN raw2_p > 0.9 THEN 'High' WHEN raw2_p > 0.8 THEN 'Medium' ELSE 'Low' END AS severity, CASE WHEN attack THEN raw_leaf END AS attack_type, {D.r4('1 - bp')} AS stage1_p FROM b"""


def _kb_seen(s, d, tactic=None, text=None):
    """Categories found, with the number of queue rows each explains."""
    hit = enrich.search_kb(enrich.default_kb(s), tactic, text).select(F.col("category").alias("raw_leaf"))
    return D.flows(s, d).join(hit, "raw_leaf").groupBy("raw_leaf").agg(F.count("*").alias("rows"))


def _kb_coverage(s, d):
    seen = D.flows(s, d).select(F.col("raw_leaf").alias("category")).distinct()
    return enrich.kb_coverage(enrich.default_kb(s).join(seen, "category", "left_semi"))


def _kb_unmapped(s, d):
    f = D.flows(s, d).select(F.when(F.col("o") % 9 == 0, F.concat(F.lit("New-"), F.col("raw_family"))).otherwise(F.col("raw_leaf")).alias("attack_type"))
    return enrich.leaves_without_mapping(f, enrich.default_kb(s))


def _first_of(s, d):
    f = D.flows(s, d).selectExpr("flow_id", "if(o % 3 = 0, NULL, src_ip) AS `src_ip`", "if(o % 2 = 0, NULL, dst_ip) AS `Source IP`", "if(o % 5 = 0, CAST('NaN' AS DOUBLE), CAST(o AS DOUBLE)) AS size")
    return f.select("flow_id", Z.first_of(f, ["src_ip", "Source IP", "Src IP"], "N/A").alias("ip"), Z.first_of(f, ["size", "none"], -1.0).alias("size"))


def _manual(s, d):
    r = D.flows(s, d).selectExpr("flow_id AS srcip", "dst_ip AS dstip", "CAST(src_port AS STRING) AS sport", "CAST(dst_port AS STRING) AS dsport",
                                 "if(o % 2 = 0, 'tcp', 'UDP') AS proto", "CAST(c % 8 AS STRING) AS dur", "CAST(o % 50 AS STRING) AS spkts", "'' AS dpkts", "CAST(o % 900 AS STRING) AS sbytes", "'x' AS dbytes")
    return readers.manual_features(r).select(F.col("srcip").alias("flow_id"), *_short(["Dst Port", "Protocol", "Flow Duration", "Subflow Fwd Packets", "Subflow Bwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Bytes"]))


KB = f"{D.KB_SQL}"
QUERIES = {
    "p01_normalize_columns": (_normalized, "WITH c AS (SELECT * FROM lineitem WHERE l_suppkey % 2 = 1) SELECT CAST(l_suppkey % 7 AS VARCHAR) AS dst_port, CAST(CAST(l_quantity AS INT) % 5 AS VARCHAR) AS len_max, CAST(l_linenumber % 3 AS VARCHAR) AS header, CAST(l_partkey % 9 AS VARCHAR) AS fwd_packets, ((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey AS row_id FROM c"),
    "p02_to_features": (_to_features, P2_SQL),
    "p03_short_to_features": (_short_rows, FL + f"SELECT flow_id, CASE o % 23 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN CAST('Infinity' AS DOUBLE) WHEN 3 THEN CAST('NaN' AS DOUBLE) WHEN 4 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(o % 977 AS DOUBLE) * 1000 END AS flow_duration_raw, CAST(c AS DOUBLE) AS packet_length_max, CAST(o % 9 AS DOUBLE) / 8 * 1000 AS idle_std, CAST(o % 9 AS DOUBLE) / 8 AS fwd_segment_size_avg FROM flows"),
    "p04_hash_to_features": (_hash_rows, FL + f"SELECT flow_id, {NUM} AS flow_duration, CASE WHEN o % 5 = 0 THEN CAST(o AS DOUBLE) ELSE CAST(c AS DOUBLE) END AS idle_max, CAST(7 AS DOUBLE) AS active_max, CAST(dst_port AS DOUBLE) AS dst_port, CAST(0 AS DOUBLE) AS bwd_iat_std FROM flows"),
    "p05_ensure_features": (_complete_features, P5_SQL),
    "p06_clean": (_clean_rows, FL + f"SELECT flow_id, {NUM} AS flow_duration, CASE WHEN o % 3 = 0 THEN 0 ELSE CAST(o AS DOUBLE) END AS extra, CASE WHEN o % 4 = 0 THEN 0 ELSE c END AS whole, CASE WHEN o % 7 = 0 THEN NULL ELSE src_ip END AS note FROM flows"),
    "p07_derive_live": (lambda s, d: Z.derive_flow_features(_meter(s, d)).select("flow_id", *LIVE), P7_SQL),
    "p08_derive_batch": (lambda s, d: Z.derive_flow_features(_meter(s, d), batch=True).select("flow_id", *_short(["Down/Up Ratio", "CWR Flag Count"])), f"WITH {METER_SQL} SELECT flow_id, CAST(dst2src_packets AS DOUBLE) / CASE WHEN src2dst_packets = 0 THEN 1 ELSE src2dst_packets END AS down_up_ratio, CAST(src2dst_cwr_packets + dst2src_cwr_packets AS DOUBLE) AS cwr_flag_count FROM meter"),
    "p09_conn_features": (_conn, P9_SQL),
    "p09_jitter": (_jitter, JITTER_SQL),
    "p11_first_of": (_first_of, FL + "SELECT flow_id, coalesce(CASE WHEN o % 3 <> 0 THEN src_ip END, CASE WHEN o % 2 <> 0 THEN dst_ip END, 'N/A') AS ip, CASE WHEN o % 5 = 0 THEN -1 ELSE CAST(o AS DOUBLE) END AS size FROM flows"),
    "p12_event_time": (_event_times, f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1704067200000 + event_id * 1000 WHEN 1 THEN epoch_ms(TIMESTAMP '2024-01-02 03:04:00') + (event_id % 60) * 1000 WHEN 2 THEN epoch_ms(TIMESTAMP '2024-02-07 10:00:00') + (event_id % 60) * 60000 ELSE {D.AS_OF_MS} END AS time_ms FROM events"),
    "p13_flow_key": (lambda s, d: D.flows(s, d).select("flow_id", N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("key")), FL + "SELECT flow_id, src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS key FROM flows"),
    "p14_parse_flow_key": (_parsed_keys, FL + "SELECT flow_id, CASE o % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN 'fe80::' || c ELSE src_ip END AS src_ip, CASE o % 10 WHEN 0 THEN 'N/A' WHEN 1 THEN '::1' ELSE dst_ip END AS dst_ip, CASE o % 10 WHEN 0 THEN 0 WHEN 1 THEN 443 ELSE src_port END AS src_port, CASE o % 10 WHEN 0 THEN 0 WHEN 1 THEN 53 ELSE dst_port END AS dst_port, CASE o % 10 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' ELSE CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END END AS protocol FROM flows"),
    "p15_split_addr_port": (_addr_port, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'fe80::' || user_id WHEN 1 THEN '10.0.0.' || user_id ELSE '10.0.0.1:' || event_type END AS addr, CAST(CASE WHEN event_id % 3 < 2 THEN event_id ELSE 0 END AS INT) AS port FROM events"),
    "p16_normalize_alerts": (_normalized_alerts, ALERT_LINE_SQL),
    "p18_summary_view": (_summary, P + "SELECT id, flow_ms AS ms, source_ip AS \"sourceIp\", destination_port AS \"destinationPort\", packet_size AS \"packetSize\", snort_sid, CASE WHEN has_mitre THEN band END AS band, CASE WHEN has_mitre THEN 3 ELSE 0 END AS mitre_fields FROM pred"),
    "p18_full_view": (_full, P + "SELECT id, source_ip AS \"sourceIp\", snort_sid, snort_msg, stored_ms, 10 AS features, CASE WHEN attack_type IS NULL THEN 0 ELSE 6 END AS classes FROM pred"),
    "p19_live_to_queue": (_queue_rows, EVENTS_SQL + "SELECT id, src_ip AS source_ip, dst_port AS destination_port, 0 AS packet_size, CAST(0 AS DOUBLE) AS duration, attack_type AS subtype, 'new' AS ack_state, source, first_seen_ms AS flow_ms FROM ev"),
    "p20_build_events": (lambda s, d: _events(s, d).select(*EVENT_COLS), EVENTS_SQL + f"SELECT {COLS} FROM ev"),
    "p21_mode_ml": (lambda s, d: _events(s, d, "ml").select(*EVENT_COLS), _mode_sql("ml")),
    "p21_mode_snort": (lambda s, d: _events(s, d, "snort").select(*EVENT_COLS), _mode_sql("snort")),
    "p22_parse_times": (_parsed_times, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN epoch_ms(TIMESTAMP '2024-01-05 04:07:00') + (event_id % 60) * 1000 WHEN 1 THEN epoch_ms(TIMESTAMP '2024-01-05 06:07:00') + (event_id % 60) * 1000 END AS ms, CASE event_id % 2 WHEN 0 THEN CAST(event_id AS DOUBLE) END AS v FROM events"),
    "p23_validate": (_validated, P23_SQL),
    "p24_downcast": (_downcast, "SELECT 'int' AS key_type, 'float' AS quantity_type, count(*) AS rows, sum(l_quantity) AS quantity FROM lineitem"),
    "p25_normalize_labels": (lambda s, d: _corpus_rows(s, d).groupBy(F.col("Label").alias("label")).agg(F.count("*").alias("rows")), C + "SELECT label, count(*) AS rows FROM corpus GROUP BY label"),
    "p26_first_tactic": (lambda s, d: D.fresh_predictions(s, d).groupBy(enrich.first_tactic("mitre").alias("tactic")).agg(F.count("*").alias("rows")), P + "SELECT CASE WHEN has_mitre THEN (SELECT tactic FROM kb_tactic k WHERE k.category = attack_type AND pos = 0) ELSE '' END AS tactic, count(*) AS rows FROM pred GROUP BY 1"),
    "src4_alert_lines": (lambda s, d: _normalized_alerts(s, d).groupBy("protocol", "snort_action").agg(F.count("*").alias("rows")), f"WITH {D.FLOWS_SQL},{D.ALERTS_SQL} SELECT 'TCP' AS protocol, CASE WHEN event_id // 5 % 4 = 1 THEN 'allow' ELSE '' END AS snort_action, count(*) AS rows FROM alerts WHERE event_id // 5 % 4 < 2 GROUP BY ALL"),
    "src4_alert_files": (_alerts_from_files, ALERT_FILES_SQL),
    "src1_corpus_files": (_times_from_files, "SELECT event_id, (1499410000 + event_id * 61) // 60 * 60000 AS time_ms, event_id % 100 AS fwd_header FROM events"),
    "src7_manual_records": (_manual, FL + "SELECT flow_id, CAST(dst_port AS DOUBLE) AS dst_port, CASE WHEN o % 2 = 0 THEN 6.0::DOUBLE ELSE 17 END AS protocol, CAST(c % 8 AS DOUBLE) * 1000 AS flow_duration, CAST(o % 50 AS DOUBLE) AS subflow_fwd_packets, 0::DOUBLE AS subflow_bwd_packets, CAST(o % 900 AS DOUBLE) AS subflow_fwd_bytes, 0::DOUBLE AS subflow_bwd_bytes FROM flows"),
    "snk3_session_log_rows": (_log_rows, LOG_SQL),
    "snk4_export_rows": (_exported, EXPORT_SQL),
    "snk6_incident_reports": (_reports, None),
    "snk6_incident_trail": (_trail_lines, TRAIL_SQL),
    "snk7_traffic_log_rows": (_traffic_rows, FL + "SELECT " + ", ".join(f"""{TRAFFIC_SQL.get(c, "''")} AS {c}""" for c in fixed.TRAFFIC_LOG_COLUMNS) + " FROM flows"),
    "c01_c10_scalars": (_scalars, SCALARS_SQL),
    "c02_overrides": (lambda s, d: D.judged(s, d).groupBy("source", "prediction", "severity").agg(F.count("*").alias("rows"), F.sum(F.round(F.col("confidence") * 10000).cast("long")).alias("confidence_e4")), J + "SELECT source, prediction, severity, count(*) AS rows, CAST(sum(CAST(round(confidence * 10000) AS BIGINT)) AS BIGINT) AS confidence_e4 FROM judged GROUP BY ALL"),
    "m08_hierarchical": (lambda s, d: D.scored(s, d).select("flow_id", "prediction", "confidence", "severity", "attack_type", "family", "stage1_p", "stage2_p", "stage3_p"), SC + "SELECT flow_id, prediction, confidence, severity, attack_type, family, stage1_p, stage2_p, stage3_p FROM scored"),
    "m09_single_model": (_single, SINGLE_SQL),
    "o06_top_probs": (_top_probs, TOP_SQL),
    "f10_search_kb_text": (lambda s, d: _kb_seen(s, d, text="brute force"), FL + f", {KB} SELECT raw_leaf, count(*) AS rows FROM flows WHERE raw_leaf IN (SELECT category FROM kb_technique WHERE lower(technique) LIKE '%brute force%' UNION SELECT category FROM kb WHERE lower(description) LIKE '%brute force%' OR lower(category) LIKE '%brute force%') GROUP BY raw_leaf"),
    "f10_search_kb_tactic": (lambda s, d: _kb_seen(s, d, tactic="TA0040", text="T1498"), FL + f", {KB} SELECT raw_leaf, count(*) AS rows FROM flows WHERE raw_leaf IN (SELECT category FROM kb_tactic WHERE tactic_id = 'TA0040') AND raw_leaf IN (SELECT category FROM kb_technique WHERE technique_id LIKE 'T1498%') GROUP BY raw_leaf"),
    "a27_kb_coverage": (_kb_coverage, FL + f", {KB}, seen AS (SELECT DISTINCT raw_leaf FROM flows) SELECT (SELECT count(DISTINCT tactic_id) FROM kb_tactic JOIN seen ON raw_leaf = category) AS tactics, (SELECT count(DISTINCT technique_id) FROM kb_technique JOIN seen ON raw_leaf = category) AS techniques"),
    "a27_unmapped_leaves": (_kb_unmapped, FL + "SELECT 'New-' || raw_family AS attack_type, count(*) AS rows FROM flows WHERE o % 9 = 0 GROUP BY 1"),
    "f11_drop_incomplete": (_incomplete, C + "SELECT row_id FROM corpus WHERE bad >= 4"),
    "u01_union": (_union, C + "SELECT CAST(CAST(dst_port AS INT) AS VARCHAR) AS dst_port, CAST(CAST(len_max AS INT) AS VARCHAR) AS len_max, CAST(CAST(header AS INT) AS VARCHAR) AS header, label, source, row_id FROM corpus"),
    "u02_dedup": (_dedup, C + "SELECT min(row_id) AS row_id, dst_port, duration AS flow_duration, len_max AS packet_length_max, header AS fwd_header_length FROM corpus WHERE bad >= 4 GROUP BY dst_port, duration, len_max, header"),
    "u03_unmapped_labels": (_unmapped, f"SELECT (["+ ",".join(f"'{x}'" for x in D.SPELLINGS) + "])[CAST(l_partkey % 15 AS INT) + 1] AS label, count(*) AS rows FROM lineitem WHERE l_suppkey % 2 = 0 AND l_partkey % 15 <> 10 GROUP BY 1"),
    "a25_label_counts": (_label_counts, C + "SELECT label, source, count(*) AS rows FROM corpus GROUP BY ROLLUP (label, source)"),
    "a30_value_profile": (_coverage, C + "SELECT unnest(['Dst Port', 'Flow Duration', 'Packet Length Max', 'Fwd Header Length']) AS feature, unnest([0, count(*) FILTER (bad IN (2, 3)), 0, 0]) AS nulls, unnest([0, count(*) FILTER (bad < 2), 0, 0]) AS not_finite FROM corpus"),
    "w06_cap_benign": (_cap, C + """, r AS (SELECT row_id, source, CASE WHEN row_id % 3 = 0 THEN 'Benign' ELSE label END AS label, md5('7|' || row_id || '|' || label) AS h FROM corpus),
        k AS (SELECT *, row_number() OVER (PARTITION BY source, label = 'Benign' ORDER BY h) AS rn FROM r) SELECT row_id, label, source FROM k WHERE label <> 'Benign' OR source = 'Y2017' OR rn <= 5000"""),
}
