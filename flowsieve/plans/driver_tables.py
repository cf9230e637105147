"""The given tables read as network data.

Every column is integer arithmetic on keys, so that any engine derives the same rows. The ``*_SQL`` texts are the same
derivations for the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.operators import correlate, enrich, verdict

BASE_MS = 1_704_067_200_000          # 2024-01-01
AS_OF = "2024-01-31 00:00:00"
AS_OF_MS = BASE_MS + 30 * 86_400_000
TAU = 0.6
MODEL_VERSION = "tables-1"
PORTS = [22, 80, 443, 53, 3389, 8080, 21, 0]
SIDS = {"error": 2001219, "click": 2002910, "view": 2013028, "signup": 2024364, "purchase": 1000003}
CLASSES = {"error": "attempted-recon", "click": "web-application-attack", "view": "misc-activity",
           "signup": "trojan-activity", "purchase": "attempted-dos"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of ``orders``, from the file footers."""
    return table(spark, sf_dir, "orders").count()


def as_of():
    return F.to_timestamp(F.lit(AS_OF))


# ---- flows --------------------------------------------------------------------------------------------------------

def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per order, with the class probabilities a model would give."""
    return flows_of(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))


def flows_of(orders: DataFrame) -> DataFrame:
    return (
        orders.selectExpr(
            "o_orderkey AS o", "o_custkey AS c",
            "concat('10.', o_custkey % 4, '.0.', o_custkey % 25 + 1) AS host_a",
            "concat('192.168.', o_orderkey % 3, '.', o_orderkey % 11 + 1) AS host_b",
            f"element_at(array({_quoted(fixed.FAMILIES)}), CAST((o_orderkey * 7 + o_custkey * 3) % 6 + 1 AS INT)) AS raw_family")
        .selectExpr(
            "o", "c", "concat('flow_', o) AS flow_id",
            "if(o % 17 = 0, host_b, host_a) AS src_ip", "if(o % 17 = 0, host_a, host_b) AS dst_ip",
            "CAST(1024 + (o * 37) % 60000 AS INT) AS src_port",
            f"element_at(array({_quoted(PORTS)}), CAST(o % 8 + 1 AS INT)) AS dst_port",
            "CASE WHEN o % 10 < 7 THEN 6 WHEN o % 10 < 9 THEN 17 ELSE 1 END AS protocol",
            f"{BASE_MS} + ((o * 173) % 2592000) * 1000 AS first_seen_ms",
            "CAST((o * 97) % 100000 AS INT) AS packet_size", "CAST((o * 41) % 60000 AS DOUBLE) AS duration",
            "((o * 31 + c) % 10000) / 10000D AS stage1_p",
            "raw_family", "(5000 + (o * 131 + c * 17) % 5000) / 10000D AS raw2_p", "(5000 + (o * 197 + c * 29) % 5000) / 10000D AS raw3_p",
            "CASE raw_family " + " ".join(
                f"WHEN '{f}' THEN element_at(array({_quoted(leaves)}), CAST((o + c) % {len(leaves)} + 1 AS INT))"
                for f, leaves in fixed.LEAVES_OF_FAMILY.items()) + " END AS raw_leaf")
    )


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _leaf_sql() -> str:
    cases = " ".join(
        f"WHEN '{f}' THEN ({_sql_list(leaves)})[CAST((o + c) % {len(leaves)} AS INT) + 1]"
        for f, leaves in fixed.LEAVES_OF_FAMILY.items()
    )
    return f"CASE raw_family {cases} END"


FLOWS_SQL = f"""
flow_base AS (
  SELECT o_orderkey AS o, o_custkey AS c, 'flow_' || o_orderkey AS flow_id,
    '10.' || (o_custkey % 4) || '.0.' || (o_custkey % 25 + 1) AS host_a,
    '192.168.' || (o_orderkey % 3) || '.' || (o_orderkey % 11 + 1) AS host_b,
    CAST(1024 + (o_orderkey * 37) % 60000 AS INT) AS src_port,
    CAST(({_sql_list(PORTS)})[CAST(o_orderkey % 8 AS INT) + 1] AS INT) AS dst_port,
    CASE WHEN o_orderkey % 10 < 7 THEN 6 WHEN o_orderkey % 10 < 9 THEN 17 ELSE 1 END AS protocol,
    CAST({BASE_MS} AS BIGINT) + ((o_orderkey * 173) % 2592000) * 1000 AS first_seen_ms,
    CAST((o_orderkey * 97) % 100000 AS INT) AS packet_size, CAST((o_orderkey * 41) % 60000 AS DOUBLE) AS duration,
    CAST((o_orderkey * 31 + o_custkey) % 10000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS stage1_p,
    ({_sql_list(fixed.FAMILIES)})[CAST((o_orderkey * 7 + o_custkey * 3) % 6 AS INT) + 1] AS raw_family,
    CAST(5000 + (o_orderkey * 131 + o_custkey * 17) % 5000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS raw2_p,
    CAST(5000 + (o_orderkey * 197 + o_custkey * 29) % 5000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS raw3_p
  FROM orders),
flows AS (
  SELECT *, CASE WHEN o % 17 = 0 THEN host_b ELSE host_a END AS src_ip,
    CASE WHEN o % 17 = 0 THEN host_a ELSE host_b END AS dst_ip, {_leaf_sql()} AS raw_leaf
  FROM flow_base)"""


# ---- model output -------------------------------------------------------------------------------------------------

def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows with the model's decision."""
    return scored_of(flows(spark, sf_dir))


def scored_of(flow_rows: DataFrame) -> DataFrame:
    def class_map(classes, label, p):
        rest = f"(1 - {p}) / {len(classes) - 1}D"
        return "map(" + ", ".join(f"'{x}', if({label} = '{x}', {p}, {rest})" for x in classes) + ")"

    leaf_maps = " ".join(
        f"WHEN '{f}' THEN {class_map(leaves, 'raw_leaf', 'raw3_p')}" for f, leaves in fixed.LEAVES_OF_FAMILY.items() if len(leaves) > 1)
    d = flow_rows.selectExpr(
        "*", f"{class_map(fixed.FAMILIES, 'raw_family', 'raw2_p')} AS stage2_probs", f"CASE raw_family {leaf_maps} END AS stage3_probs")
    return verdict.score_hierarchical(d, TAU)


_SINGLE = "('" + "', '".join(fixed.SINGLE_LEAF) + "')"
R4 = "CAST(ROUND(CAST({} AS DECIMAL(24,12)), 4) AS DOUBLE)"


def r4(x: str) -> str:
    return R4.format(x)


SCORED_SQL = FLOWS_SQL + f""",
model AS (
  SELECT *, stage1_p >= {TAU} AS attack, CASE WHEN raw_family IN {_SINGLE} THEN CAST(1 AS DOUBLE) ELSE raw3_p END AS leaf_p FROM flows),
scored AS (
  SELECT o, c, flow_id, src_ip, dst_ip, src_port, dst_port, protocol, first_seen_ms, packet_size, duration, stage1_p,
    raw_family, raw_leaf, raw2_p, raw3_p,
    CASE WHEN attack THEN 'Malicious' ELSE 'Normal' END AS prediction,
    CASE WHEN attack THEN {r4('stage1_p * raw2_p * leaf_p')} ELSE {r4('1 - stage1_p')} END AS confidence,
    CASE WHEN NOT attack THEN NULL WHEN leaf_p >= 0.95 AND raw2_p >= 0.90 THEN 'High'
         WHEN leaf_p >= 0.80 AND raw2_p >= 0.70 THEN 'Medium' ELSE 'Low' END AS severity,
    CASE WHEN attack THEN raw_leaf END AS attack_type, CASE WHEN attack THEN raw_family END AS family,
    CASE WHEN attack THEN raw2_p END AS stage2_p, CASE WHEN attack THEN leaf_p END AS stage3_p
  FROM model)"""


# ---- alerts -------------------------------------------------------------------------------------------------------

def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is an alert about some flow, a quarter of them with the reversed key."""
    return alerts_of(table(spark, sf_dir, "events"), flows(spark, sf_dir), order_count(spark, sf_dir))


def alerts_of(events: DataFrame, flow_rows: DataFrame, n: int) -> DataFrame:
    ev = events.selectExpr("event_id", "event_type", f"(event_id * 13) % {n} AS o")
    f = flow_rows.select("o", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_seen_ms")
    turn = lambda a, b: f"if(event_id % 4 = 1, {b}, {a}) AS {a}"
    return ev.join(f, "o").selectExpr(
        "event_id", "o", turn("src_ip", "dst_ip"), turn("dst_ip", "src_ip"), turn("src_port", "dst_port"), turn("dst_port", "src_port"),
        "protocol", "first_seen_ms + ((event_id * 7) % 121 - 90) * 1000 AS alert_ms",
        f"{_case('event_type', SIDS, '0')} AS snort_sid", "concat('SIG ', event_type, ' activity') AS snort_msg",
        f"""{_case('event_type', CLASSES, "''")} AS snort_classtype""", "CAST(event_id % 3 + 1 AS INT) AS snort_priority")


def _case(col: str, table: dict, default: str) -> str:
    value = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {col} " + " ".join(f"WHEN {value(k)} THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


ALERTS_SQL = f"""
alert_base AS (
  SELECT e.event_id, e.event_type, f.o, f.src_ip, f.dst_ip, f.src_port, f.dst_port, f.protocol,
    f.first_seen_ms + ((e.event_id * 7) % 121 - 90) * 1000 AS alert_ms, e.event_id % 4 = 1 AS back
  FROM events e JOIN flows f ON f.o = (e.event_id * 13) % (SELECT count(*) FROM orders)),
alerts AS (
  SELECT event_id, o, CASE WHEN back THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN back THEN src_ip ELSE dst_ip END AS dst_ip,
    CASE WHEN back THEN dst_port ELSE src_port END AS src_port, CASE WHEN back THEN src_port ELSE dst_port END AS dst_port,
    protocol, alert_ms, {_case('event_type', SIDS, '0')} AS snort_sid, 'SIG ' || event_type || ' activity' AS snort_msg,
    {_case('event_type', CLASSES, "''")} AS snort_classtype, CAST(event_id % 3 + 1 AS INT) AS snort_priority
  FROM alert_base)"""


# ---- predictions --------------------------------------------------------------------------------------------------

def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows with their alert, verdict and headline fields."""
    joined = correlate.correlate(scored(spark, sf_dir), alerts(spark, sf_dir).drop("o"))
    return verdict.hybrid_verdict(joined)


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.enrich_attack(judged(spark, sf_dir), enrich.default_kb(spark))


def _first(direction: str) -> str:
    key = ("a.src_ip = s.src_ip AND a.dst_ip = s.dst_ip AND a.src_port = s.src_port AND a.dst_port = s.dst_port"
           if direction == "fwd" else
           "a.src_ip = s.dst_ip AND a.dst_ip = s.src_ip AND a.src_port = s.dst_port AND a.dst_port = s.src_port")
    return f"LEFT JOIN first_alert {direction} ON " + key.replace("a.", direction + ".") + f" AND {direction}.protocol = s.protocol"


def _either(col: str) -> str:
    return f"CASE WHEN fwd.event_id IS NOT NULL THEN fwd.{col} ELSE rev.{col} END AS {col}"


JUDGED_SQL = SCORED_SQL + "," + ALERTS_SQL + f""",
first_alert AS (
  SELECT * FROM alerts QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol ORDER BY alert_ms, event_id) = 1),
matched AS (
  SELECT s.*, {_either('event_id')}, {_either('alert_ms')}, {_either('snort_sid')}, {_either('snort_msg')}, {_either('snort_classtype')}, {_either('snort_priority')}
  FROM scored s {_first('fwd')} {_first('rev')}),
sourced AS (
  SELECT * REPLACE (prediction AS prediction),
    CASE WHEN event_id IS NOT NULL AND prediction = 'Malicious' THEN 'confirmed' WHEN event_id IS NOT NULL THEN 'signature_only'
         WHEN prediction = 'Malicious' THEN 'ml_only' ELSE 'benign' END AS source FROM matched),
judged AS (
  SELECT * REPLACE (
    CASE source WHEN 'confirmed' THEN 'Malicious' WHEN 'signature_only' THEN 'Malicious' WHEN 'ml_only' THEN 'Suspicious' ELSE prediction END AS prediction,
    CASE WHEN source = 'confirmed' AND severity = 'Low' THEN 'Medium' WHEN source = 'signature_only' THEN 'High' ELSE severity END AS severity,
    CASE WHEN source IN ('confirmed', 'ml_only') AND coalesce(stage2_p, 0) <> 0 AND coalesce(stage3_p, 0) <> 0 THEN {r4('stage2_p * stage3_p')}
         WHEN source = 'signature_only' THEN 0.0 ELSE confidence END AS confidence)
  FROM sourced)"""


# ---- queue, acknowledgement log, users, rules ---------------------------------------------------------------------

def _meter_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({
        "first_seen_ms": "bidirectional_first_seen_ms", "packet_size": "bidirectional_bytes", "duration": "bidirectional_duration_ms"})


def fresh_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue rows as they are first stored."""
    from flowsieve.operators import standardize

    rows = standardize.format_predictions(_meter_names(judged(spark, sf_dir)), enrich.default_kb(spark), as_of(), MODEL_VERSION)
    o = F.substring_index("id", "_", -1).cast("long")
    return rows.withColumn("first_seen_at", F.timestamp_millis(F.unix_millis("flow_timestamp") + (30 + o % 600) * 1000))


STATES = {"click": "reviewed", "purchase": "escalated", "error": "dismissed", "signup": "new"}


def ack_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgement changes from events: one each, plus a later escalation per twelfth."""
    n = order_count(spark, sf_dir)
    e = F.col("event_id")
    ev = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", ((e * 29) % n).alias("o"))
    first = F.struct(e.alias("id"), N.lookup(F.col("event_type"), STATES, F.lit("new")).alias("to_state"), (60 + (e * 11) % 7200).alias("late"))
    second = F.when(e % 12 == 0, F.struct(
        (e + 1000000).alias("id"), F.lit("escalated").alias("to_state"), (9000 + (e * 11) % 7200).alias("late")))
    ch = ev.select("o", "user_id", F.explode(F.array_compact(F.array(first, second))).alias("c"))
    f = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("o"), (F.lit(BASE_MS) + ((F.col("o_orderkey") * 173) % 2592000) * 1000).alias("first_seen_ms"))
    return ch.join(f, "o").select(
        F.col("c.id").alias("id"), F.concat(F.lit("flow_"), F.col("o").cast("string")).alias("prediction_id"), "user_id",
        F.col("c.to_state").alias("to_state"), F.lit(None).cast("string").alias("note"),
        F.timestamp_millis(F.col("first_seen_ms") + F.col("c.late") * 1000).alias("changed_at"))


ACK_SQL = f"""
ack_log AS (
  SELECT e.event_id AS id, 'flow_' || o_orderkey AS prediction_id, e.user_id, {_case('e.event_type', STATES, "'new'")} AS to_state,
    {BASE_MS} + ((o_orderkey * 173) % 2592000) * 1000 + (60 + (e.event_id * 11) % 7200) * 1000 AS changed_ms
  FROM events e JOIN orders ON o_orderkey = (e.event_id * 29) % (SELECT count(*) FROM orders)
  UNION ALL
  SELECT e.event_id + 1000000, 'flow_' || o_orderkey, e.user_id, 'escalated',
    {BASE_MS} + ((o_orderkey * 173) % 2592000) * 1000 + (9000 + (e.event_id * 11) % 7200) * 1000
  FROM events e JOIN orders ON o_orderkey = (e.event_id * 29) % (SELECT count(*) FROM orders)
  WHERE e.event_id % 12 = 0),
last_ack AS (
  SELECT prediction_id, to_state, changed_ms, user_id FROM ack_log
  QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY changed_ms DESC, id DESC) = 1)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue with the acknowledgement states of the log."""
    from flowsieve.operators import triage

    return triage.with_ack_state(fresh_predictions(spark, sf_dir), ack_log(spark, sf_dir))


def _kb_sql() -> str:
    tactics, techniques = [], []
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for cat, _, ts in fixed.ATTACK_KB:
        for i, (tid, tname, ks) in enumerate(ts):
            tactics.append(f"({quote(cat)}, {i}, {quote(tid)}, {quote(tname)})")
            for kid, kname in ks:
                techniques.append(f"({quote(cat)}, {i}, {quote(tid)}, {quote(kid)}, {quote(kname)}, {quote(fixed.technique_url(kid))}, {quote(ts[0][1])})")
    texts = [f"({quote(cat)}, {quote(text)})" for cat, text, _ in fixed.ATTACK_KB]
    return (
        f"kb(category, description) AS (VALUES {', '.join(texts)}),\n"
        f"kb_tactic(category, pos, tactic_id, tactic) AS (VALUES {', '.join(tactics)}),\n"
        f"kb_technique(category, pos, tactic_id, technique_id, technique, url, first_tactic) AS (VALUES {', '.join(techniques)})"
    )


KB_SQL = _kb_sql()
PRED_SQL = JUDGED_SQL + "," + ACK_SQL + "," + KB_SQL + f""",
pred AS (
  SELECT j.flow_id AS id, j.o, first_seen_ms AS flow_ms, first_seen_ms + (30 + j.o % 600) * 1000 AS stored_ms, make_timestamp(first_seen_ms * 1000) AS flow_timestamp,
    src_ip AS source_ip, dst_ip AS destination_ip, src_port AS source_port, dst_port AS destination_port,
    CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END AS protocol, packet_size, duration,
    prediction, attack_type, family, attack_type AS subtype, confidence, severity, stage1_p, stage2_p, stage3_p, source,
    coalesce(snort_msg, '') AS snort_msg, coalesce(snort_sid, 0) AS snort_sid, coalesce(snort_classtype, '') AS snort_classtype,
    coalesce(snort_priority, 0) AS snort_priority,
    prediction = 'Malicious' AND confidence >= 0.7 AND attack_type IS NOT NULL AS has_mitre,
    CASE WHEN confidence >= 0.7 AND confidence < 0.85 THEN 'low' WHEN confidence >= 0.85 AND confidence < 0.95 THEN 'high'
         WHEN confidence >= 0.95 THEN 'very_high' ELSE 'low' END AS band,
    coalesce(a.to_state, 'new') AS ack_state, a.changed_ms AS ack_ms, a.user_id AS ack_by
  FROM judged j LEFT JOIN last_ack a ON a.prediction_id = j.flow_id)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("id"), F.lower("c_name").alias("username"), F.when(c % 50 == 0, "admin").otherwise("analyst").alias("role"))


USERS_SQL = "users AS (SELECT c_custkey AS id, lower(c_name) AS username FROM customer)"

FLOW_123 = "SELECT src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'ICMP' END FROM flows WHERE o = 123"
RULES = [
    # id, kind, value (None: the key of flow 123), created, expires
    ("r1", "sid", "2013028", "2024-01-02", None), ("r2", "flow_key", None, "2024-01-03", None),
    ("r3", "src_ip", "10.1.0.7", "2024-01-04", None), ("r4", "src_cidr", "10.2.0.0/16", "2024-01-05", None),
    ("r5", "sid", "2001219", "2024-01-06", "2024-01-20"), ("r6", "sid", "2013028", "2024-01-07", None),
]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six suppression rules; one names the key of a flow, so it is read from the flows."""
    listed = [(i, k, v, 0, c, e) for i, k, v, c, e in RULES if v is not None]
    plain = spark.createDataFrame(listed, "id string, kind string, value string, hits long, created string, expires string")
    i, k, _, c, e = RULES[1]
    keyed = flows(spark, sf_dir).filter("o = 123").select(
        F.lit(i).alias("id"), F.lit(k).alias("kind"), N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("value"),
        F.lit(0).cast("long").alias("hits"), F.lit(c).alias("created"), F.lit(e).cast("string").alias("expires"))
    return plain.unionByName(keyed).select(
        "id", "kind", "value", "hits", F.to_timestamp("created").alias("created_at"), F.to_timestamp("expires").alias("expires_at"))


RULES_SQL = "rules(id, kind, value, created, expires) AS (VALUES " + ", ".join(
    f"('{i}', '{k}', {'(' + FLOW_123 + ')' if v is None else repr(v)}, DATE '{c}', {'CAST(NULL AS DATE)' if e is None else f'DATE {e!r}'})"
    for i, k, v, c, e in RULES) + ")"


def both_families(flow_rows: DataFrame) -> DataFrame:
    """Flows of which every third has an IPv6 source, one of 16 networks."""
    six = "concat('2001:DB8:0:', lower(hex(o % 16)), '::', lower(hex(c % 250 + 1)))"
    return flow_rows.selectExpr("flow_id", f"if(o % 3 = 0, {six}, src_ip) AS source_ip", "src_port AS source_port", "dst_ip AS destination_ip", "dst_port AS destination_port", "protocol", "0 AS snort_sid")


FAMILIES_SQL = FLOWS_SQL + """,
numbered AS (
  SELECT flow_id, CASE WHEN o % 3 = 0 THEN 6 ELSE 4 END AS family, CASE WHEN o % 3 = 0 THEN (o % 16) * CAST(1048576 AS HUGEINT) + c % 250 + 1 ELSE
    list_reduce(list_transform(string_split(src_ip, '.'), lambda x: CAST(x AS HUGEINT)), lambda x, y: x * 256 + y) END AS address FROM flows)"""


def network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network per nation and kind: nested, with lengths, netmasks and host masks, of both families."""
    n = table(spark, sf_dir, "nation").selectExpr("n_nationkey AS n")
    value = """explode(array(
      concat('10.', n % 4, '.0.', n % 25, '/', array('32', '31', '255.255.255.252', '0.0.0.7', '28')[n % 5]), concat('10.', n % 4, '.7.7/', if(n % 2 = 0, '16', '255.255.240.0')), if(n = 7, '10.0.0.0/8', '192.168.1.0/24'),
      concat('2001:db8:0:', lower(hex(n % 16)), '::/', array('64', '128', '120', '127', '63')[n % 5]), if(n = 11, '2001:db8::/32', 'fe80::/10'))) AS value"""
    return n.selectExpr("n", value).selectExpr(
        "concat(value, ' ', n) AS id", "'src_cidr' AS kind", "value", "0L AS hits", "timestamp_seconds(1704067200 + (n * 7) % 11 * 3600) AS created_at", "CAST(NULL AS TIMESTAMP) AS expires_at")


NETWORKS_SQL = """
listed AS (
  SELECT n_nationkey AS n, unnest([
    {v: '10.' || (n_nationkey % 4) || '.0.' || (n_nationkey % 25) || '/' || (['32', '31', '255.255.255.252', '0.0.0.7', '28'])[n_nationkey % 5 + 1], f: 4, a: CAST(10 * 16777216 + (n_nationkey % 4) * 65536 + n_nationkey % 25 AS HUGEINT), size: CAST(([1, 2, 4, 8, 16])[n_nationkey % 5 + 1] AS HUGEINT)},
    {v: '10.' || (n_nationkey % 4) || '.7.7/' || CASE WHEN n_nationkey % 2 = 0 THEN '16' ELSE '255.255.240.0' END, f: 4, a: CAST(10 * 16777216 + (n_nationkey % 4) * 65536 + 7 * 256 + 7 AS HUGEINT), size: CAST(CASE WHEN n_nationkey % 2 = 0 THEN 65536 ELSE 4096 END AS HUGEINT)},
    {v: CASE WHEN n_nationkey = 7 THEN '10.0.0.0/8' ELSE '192.168.1.0/24' END, f: 4, a: CAST(CASE WHEN n_nationkey = 7 THEN 10 * 16777216 ELSE 192 * CAST(16777216 AS BIGINT) + 168 * 65536 + 256 END AS HUGEINT), size: CAST(CASE WHEN n_nationkey = 7 THEN 16777216 ELSE 256 END AS HUGEINT)},
    {v: '2001:db8:0:' || lower(to_hex(n_nationkey % 16)) || '::/' || (['64', '128', '120', '127', '63'])[n_nationkey % 5 + 1], f: 6, a: CAST((n_nationkey % 16) * CAST(1048576 AS HUGEINT) AS HUGEINT), size: CAST(([1048576, 1, 256, 2, 2097152])[n_nationkey % 5 + 1] AS HUGEINT)},
    {v: CASE WHEN n_nationkey = 11 THEN '2001:db8::/32' ELSE 'fe80::/10' END, f: CASE WHEN n_nationkey = 11 THEN 6 ELSE 0 END, a: CAST(0 AS HUGEINT), size: CAST(1000000000 AS HUGEINT)}]) AS x FROM nation),
networks AS (SELECT x.v || ' ' || n AS id, x.f AS family, x.a // x.size * x.size AS low, x.size AS size, (n * 7) % 11 AS age FROM listed)"""


# ---- packets and windows ------------------------------------------------------------------------------------------

PACKET_TIE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per line item, a third of them answers."""
    return packets_of(table(spark, sf_dir, "lineitem").select("l_orderkey", *PACKET_TIE, "l_returnflag"), flows(spark, sf_dir))


def packets_of(lines: DataFrame, flow_rows: DataFrame) -> DataFrame:
    line = lines.selectExpr(
        "l_orderkey AS o", *PACKET_TIE, "l_suppkey % 3 = 0 AS back", "(l_linenumber * 3 + l_partkey % 40) * 1000 AS late",
        "40 + CAST(l_quantity AS INT) * 20 AS length", "CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 24 ELSE 16 END AS flags")
    f = flow_rows.select("o", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "first_seen_ms")
    turn = lambda a, b: f"if(back, {b}, {a}) AS {a}"
    return line.join(f, "o").selectExpr(
        "o", turn("src_ip", "dst_ip"), turn("dst_ip", "src_ip"), turn("src_port", "dst_port"), turn("dst_port", "src_port"), "protocol",
        "first_seen_ms + late AS ts_ms", "length", "flags", *PACKET_TIE,
        "(((o * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey) * 64 + CAST(l_quantity AS INT) AS packet_id")


PACKETS_SQL = FLOWS_SQL + """,
packets AS (
  SELECT o, CASE WHEN l_suppkey % 3 = 0 THEN dst_ip ELSE src_ip END AS src_ip, CASE WHEN l_suppkey % 3 = 0 THEN src_ip ELSE dst_ip END AS dst_ip,
    CASE WHEN l_suppkey % 3 = 0 THEN dst_port ELSE src_port END AS src_port, CASE WHEN l_suppkey % 3 = 0 THEN src_port ELSE dst_port END AS dst_port,
    protocol, first_seen_ms + (l_linenumber * 3 + l_partkey % 40) * 1000 AS ts_ms, 40 + CAST(l_quantity AS INT) * 20 AS length,
    CASE l_returnflag WHEN 'R' THEN 2 WHEN 'N' THEN 24 ELSE 16 END AS flags, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
    (((o * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey) * 64 + CAST(l_quantity AS INT) AS packet_id
  FROM lineitem JOIN flows ON o = l_orderkey),
paired AS (
  SELECT *, src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) AS fwd,
    CASE WHEN src_ip < dst_ip OR (src_ip = dst_ip AND src_port <= dst_port) THEN src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || protocol
         ELSE dst_ip || ':' || dst_port || '-' || src_ip || ':' || src_port || '-' || protocol END AS pair
  FROM packets)"""

TZ_HOURS = -3


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attack window per nation, given as local clock times; some overlap."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS ord", "n_name AS name", "date_add(DATE '2024-01-01', n_nationkey % 12 * 2) AS day",
        "concat(lpad(CAST(n_nationkey * 5 % 18 AS STRING), 2, '0'), ':00:00') AS start",
        "concat(lpad(CAST(n_nationkey * 5 % 18 + 4 + n_nationkey % 3 AS STRING), 2, '0'), ':00:00') AS end",
        "CAST(4000 + n_nationkey * 500 AS BIGINT) AS quota_bytes")


WINDOWS_SQL = f"""
windows AS (
  SELECT n_nationkey AS ord, n_name AS name, 4000 + n_nationkey * 500 AS quota_bytes,
    {BASE_MS} + (n_nationkey % 12 * 2) * 86400000 + (n_nationkey * 5 % 18 + {-TZ_HOURS}) * 3600000 AS start_ms,
    {BASE_MS} + (n_nationkey % 12 * 2) * 86400000 + (n_nationkey * 5 % 18 + 4 + n_nationkey % 3 + {-TZ_HOURS}) * 3600000 AS end_ms
  FROM nation)"""


# ---- training corpora ---------------------------------------------------------------------------------------------

SPELLINGS = ["BENIGN", "Botnet Ares", "Web Attack - Brute Force", "Brute Force -XSS", "DDOS attack-HOIC", "DoS GoldenEye", "DoS Hulk",
             "DoS Slowhttptest - Attempted", "DoS slowloris", "FTP-Patator", "Heartbleed", "Infiltration - Dropbox Download", "Portscan",
             "Web Attack - SQL", "SSH-Bruteforce"]


def corpus(spark: SparkSession, sf_dir: str, year: int) -> DataFrame:
    """Labelled rows as text, in the column vocabulary of one year; some cells are no numbers."""
    part = 1 if year == 2017 else 0
    duration = "CASE l_partkey % 50 WHEN 0 THEN 'Infinity' WHEN 1 THEN 'NaN' WHEN 2 THEN 'abc' WHEN 3 THEN '' ELSE CAST(l_linenumber * 1000 AS STRING) END"
    label = f"element_at(array({_quoted(SPELLINGS)}), CAST(l_partkey % 15 + 1 AS INT))"
    names = {
        2017: [" Destination Port", "Flow Duration", "Max Packet Length", "Fwd Header Length", "Fwd Header Length.1", "Total Fwd Packets"],
        2018: ["Dst Port", "Flow Duration", "Packet Length Max", "Fwd Header Length", "Idle Max", "Protocol"],
    }[year]
    values = ["l_suppkey % 7", duration, "CAST(l_quantity AS INT) % 5", "l_linenumber % 3", "l_linenumber + 100", "l_partkey % 9"]
    return table(spark, sf_dir, "lineitem").filter(f"l_suppkey % 2 = {part}").selectExpr(
        *[f"CAST({v} AS STRING) AS `{n}`" for v, n in zip(values, names)], f"concat(' ', {label}, ' ') AS Label", f"'Y{year}' AS __source",
        "((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey AS row_id")


CORPUS_SQL = f"""
corpus AS (
  SELECT CASE WHEN l_suppkey % 2 = 1 THEN 'Y2017' ELSE 'Y2018' END AS source, CAST(l_suppkey % 7 AS DOUBLE) AS dst_port,
    CASE WHEN l_partkey % 50 < 4 THEN NULL ELSE CAST(l_linenumber * 1000 AS DOUBLE) END AS duration, l_partkey % 50 AS bad,
    CAST(CAST(l_quantity AS INT) % 5 AS DOUBLE) AS len_max, CAST(l_linenumber % 3 AS DOUBLE) AS header,
    (['Benign','Bot','BruteForce-Web','BruteForce-XSS','DDoS','DoS-GoldenEye','DoS-Hulk','DoS-SlowHTTPTest','DoS-Slowloris','FTP-BruteForce','Heartbleed','Infiltration','PortScan','SQL-Injection','SSH-BruteForce'])[CAST(l_partkey % 15 AS INT) + 1] AS label,
    ((l_orderkey * 8 + l_linenumber) * 200003 + l_partkey) * 10007 + l_suppkey AS row_id
  FROM lineitem)"""
