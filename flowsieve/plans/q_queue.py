"""Registered queries: the analyst queue and the analytics page."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.functions import scoring as S
from flowsieve.operators import analytics as A
from flowsieve.operators import enrich, predicates, suppress, triage
from flowsieve.plans import driver_tables as D

P = f"WITH {D.PRED_SQL} "
MS = F.unix_millis
COUNT = lambda d: d.agg(F.count("*").alias("rows"))


def _p(fn):
    return lambda spark, sf: fn(D.predictions(spark, sf))


def _hour(sql: str = "flow_ms") -> str:
    return f"({sql} // 3600000) * 3600000"


BAD = "prediction <> 'Normal'"
HOURLY_SQL = P + f""", hourly AS (
  SELECT {_hour()} AS hour_ms, count(*) FILTER (prediction = 'Normal') AS normal,
    count(*) FILTER (prediction NOT IN ('Normal', 'Suspicious')) AS malicious_only, count(*) FILTER (prediction = 'Suspicious') AS suspicious
  FROM pred GROUP BY ALL), hour_family AS (
  SELECT {_hour()} AS hour_ms, family, count(*) AS n FROM pred WHERE {BAD} AND family IS NOT NULL GROUP BY ALL)
"""
PAIR_SQL = P + f""", pair AS (
  SELECT source_ip, destination_ip, count(*) AS n FROM pred WHERE {BAD} GROUP BY ALL), conv AS (
  SELECT p.source_ip, p.destination_ip, p.n, coalesce(r.n, 0) AS back
  FROM pair p LEFT JOIN pair r ON r.source_ip = p.destination_ip AND r.destination_ip = p.source_ip)
"""
LEAD = "(n > back OR (n = back AND source_ip <= destination_ip))"


def _with_hour(d):
    return d.select(*[c for c in d.columns if c != "hour"], MS("hour").alias("hour_ms"))


def _fixed_hour(d):
    h = A.hourly(d)
    return h.select(MS("hour").alias("hour_ms"), "normal", "malicious_only", "suspicious",
                    *[F.coalesce(F.try_element_at("families", F.lit(f)), F.lit(0)).alias(f"n_{f}") for f in fixed.FAMILIES])


def _block_sql(where: str) -> str:
    return f"""SELECT count(*) FILTER (prediction = 'Normal') AS normal, count(*) FILTER ({BAD}) AS malicious_incl_suspicious,
      {', '.join(f"count(*) FILTER ({BAD} AND lower(severity) = '{v}') AS {v}" for v in ('high', 'medium', 'low'))},
      {', '.join(f"count(*) FILTER (source = '{v}') AS {v}" for v in fixed.VERDICTS)} FROM pred WHERE {where}"""


_WEEK = 7 * 86_400_000
CUR, PRI = f"flow_ms >= {D.AS_OF_MS - _WEEK}", f"flow_ms >= {D.AS_OF_MS - 2 * _WEEK} AND flow_ms < {D.AS_OF_MS - _WEEK}"
_MEASURES = ["normal", "malicious_incl_suspicious", "high", "medium", "low", *fixed.VERDICTS]


def _trend(d):
    cur = A.window_block(predicates.in_range(d, "7d", D.as_of()))
    pri = A.prior_block(d, "7d", D.as_of())
    return A.trend(A.measures(cur), A.measures(pri))


TREND_SQL = P + f""", cur AS ({_block_sql(CUR)}), pri AS ({_block_sql(PRI)}),
c AS (UNPIVOT cur ON {', '.join(_MEASURES)} INTO NAME measure VALUE current), p AS (UNPIVOT pri ON {', '.join(_MEASURES)} INTO NAME measure VALUE prior),
j AS (SELECT c.measure, current, prior, CASE WHEN prior = 0 THEN NULL ELSE (current - prior) * 100.0::DOUBLE / prior END AS delta FROM c JOIN p USING (measure)),
s AS (SELECT *, CASE WHEN prior = 0 AND current = 0 THEN NULL WHEN prior = 0 THEN 'new' WHEN abs(delta) < 1 THEN '≈' WHEN delta > 0 THEN 'up' ELSE 'down' END AS state FROM j)
SELECT measure, current, prior, state, CASE state WHEN 'up' THEN '+' || CAST(round(CAST(delta AS DECIMAL(24,6)), 0) AS BIGINT) || '%'
  WHEN 'down' THEN CAST(round(CAST(delta AS DECIMAL(24,6)), 0) AS BIGINT) || '%' ELSE state END AS label FROM s"""


WIDE_AS_OF = D.AS_OF_MS + 3 * 86_400_000
WIDEN_SQL = P + f""", c AS (SELECT {', '.join(f"count(*) FILTER (flow_ms >= {WIDE_AS_OF - 1000 * s}) AS n_{k}" for k, s in fixed.RANGE_SECONDS.items() if s)}, count(*) AS n_all FROM pred WHERE prediction = 'Normal'),
u AS (SELECT * FROM (SELECT unnest(['1h', '24h', '7d', '30d', 'all']) AS range, unnest([n_1h, n_24h, n_7d, n_30d, n_all]) AS rows, unnest([1, 2, 3, 4, 5]) AS i FROM c) WHERE rows > 0)
SELECT range, rows, range <> '1h' AS widened FROM u ORDER BY i LIMIT 1"""


def _page(sort, direction, limit, offset):
    def run(d):
        return triage.page(d, sort, direction, limit, offset).select("id", "severity", "family", "source", MS("flow_timestamp").alias("flow_ms"))
    return _p(run)


RANK = "CASE severity WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END"


def _page_sql(key, direction, limit, offset):
    nulls = "NULLS FIRST" if direction == "desc" else "NULLS LAST"
    return P + f"SELECT id, severity, family, source, flow_ms FROM pred ORDER BY {key} {direction} {nulls}, flow_ms DESC, id LIMIT {limit} OFFSET {offset}"


CAMP = P + """, camp AS (
  SELECT source_ip, destination_ip, family, count(*) AS count, min(flow_ms) AS first_ms, max(flow_ms) AS last_ms FROM pred GROUP BY ALL)
"""


def _campaigns(d):
    c = triage.campaigns(d)
    return c.select("source_ip", "destination_ip", "family", "count", MS("first_seen").alias("first_ms"), MS("last_seen").alias("last_ms"))


def _campaign_view(d, **page):
    v = triage.campaign_view(d.select("id", "flow_timestamp", "source_ip", "destination_ip", "family", "severity"), **page)
    return v.select("source_ip", "destination_ip", "family", "count", F.col("newest.id").alias("newest_id"),
                    F.size("sample_ids").alias("samples"), F.concat_ws(",", "sample_ids").alias("ids"))


def _suppressed(spark, sf):
    m = suppress.match_rules(D.fresh_predictions(spark, sf), D.rules(spark, sf), D.as_of())
    return m.select("id", F.col("rule.id").alias("rule_id"), F.col("rule.kind").alias("kind"))


def _networks(spark, sf):
    m = suppress.match_rules(D.both_families(D.flows(spark, sf)), D.network_rules(spark, sf), D.as_of())
    return m.select("flow_id", F.col("rule.id").alias("rule_id"))


NETWORK_SQL = f"""WITH {D.FAMILIES_SQL},{D.NETWORKS_SQL}
SELECT flow_id, (SELECT (array_agg(n.id ORDER BY age DESC, n.id))[1] FROM networks n WHERE n.family = p.family AND p.address BETWEEN low AND low + size - 1) AS rule_id FROM numbered p"""


def _key_sql(t):
    return f"{t}.source_ip || ':' || {t}.source_port || '-' || {t}.destination_ip || ':' || {t}.destination_port || '-' || {t}.protocol"


SUPPRESS_SQL = P + f""", {D.RULES_SQL}, hit AS (
  SELECT p.id, r.id AS rule_id, r.kind, row_number() OVER (PARTITION BY p.id ORDER BY
    CASE r.kind WHEN 'sid' THEN 0 WHEN 'flow_key' THEN 1 WHEN 'src_ip' THEN 2 ELSE 3 END, r.created DESC, r.id) AS rn
  FROM pred p JOIN rules r ON (r.expires IS NULL OR r.expires > DATE '2024-01-31') AND (
    (r.kind = 'sid' AND CAST(p.snort_sid AS VARCHAR) = r.value) OR (r.kind = 'flow_key' AND {_key_sql('p')} = r.value)
    OR (r.kind = 'src_ip' AND p.source_ip = r.value) OR (r.kind = 'src_cidr' AND p.source_ip LIKE '10.2.%')))
"""


def _trail(spark, sf):
    t = triage.with_ack_trail(D.fresh_predictions(spark, sf).select("id", "source"), D.ack_log(spark, sf), D.users(spark, sf))
    return t.select("id", "source", "change_id", "from_state", "to_state", MS("changed_at").alias("changed_ms"), "changed_by")


def _ack_state(spark, sf):
    return triage.ack_state(D.ack_log(spark, sf)).select("prediction_id", "ack_state", MS("ack_at").alias("ack_ms"), "ack_by")


def _ack_log(spark, sf):
    return triage.ack_log(D.ack_log(spark, sf)).select("id", "prediction_id", "from_state", "to_state", MS("changed_at").alias("changed_ms"))


def _listed_ids(spark, sf):
    """Ids an analyst ticked: one per event, some of which name no flow."""
    return D.table(spark, sf, "events").select(F.concat(F.lit("flow_"), (F.col("event_id") * 7).cast("string")).alias("id"))


def _ack_ids(spark, sf):
    log = triage.ack_ids(D.predictions(spark, sf), _listed_ids(spark, sf), "reviewed", D.as_of(), 7, "bulk")
    return log.select("prediction_id", "from_state", "to_state", "user_id", "note", MS("changed_at").alias("changed_ms"))


def _ack_match(spark, sf):
    log = triage.ack_match(D.predictions(spark, sf), "dismissed", D.as_of(), destination_ip="192.168.1.3", family="BruteForce", user_id=3)
    return log.select("prediction_id", "from_state", "to_state", "user_id")


def _split_ids(spark, sf):
    found, missing = triage.split_ids(_listed_ids(spark, sf), D.flows(spark, sf).select(F.col("flow_id").alias("id")))
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


def _sev(col="severity"):
    return f"lower({col})"


def _stats(d):
    return triage.store_stats(d).select("rows", MS("oldest").alias("oldest_ms"), MS("newest").alias("newest_ms"))


def _ids(d):
    return d.select("id")


def _bundle(spark, sf):
    """The values of the count sections of the page, and the rows of the others."""
    parts = A.analytics(D.predictions(spark, sf), "7d", D.as_of())
    long = lambda name, key, value: parts[name].select(F.lit(name).alias("section"), F.expr(key).cast("string").alias("key"), F.expr(value).cast("long").alias("value"))
    out = None
    for name, key, value in (("verdicts", "source", "count"), ("families", "family", "count"), ("leaves", "leaf", "count"), ("severity_by_family", "family", "total"), ("protocols", "protocol", "count"),
                             ("hourly", "unix_millis(hour)", "malicious_only + suspicious"), ("ports", "destination_port", "count"), *(("headline", f"'{c}'", c) for c in ("normal", "malicious_incl_suspicious", "suspicious")),
                             *(("severity", f"'{c}'", c) for c in ("high", "medium", "low"))):
        one = long(name, key, value)
        out = one if out is None else out.unionByName(one)
    return out


IN_WEEK = f"flow_ms >= {D.AS_OF_MS - 7 * 86400000}"
BUNDLE_SQL = P + ", week AS (SELECT * FROM pred WHERE " + IN_WEEK + "), bad AS (SELECT * FROM week WHERE prediction <> 'Normal')" + """
SELECT 'verdicts' AS section, source AS key, count(*) AS value FROM week GROUP BY source
UNION ALL SELECT 'families', family, count(*) FROM bad WHERE family IS NOT NULL GROUP BY family
UNION ALL SELECT 'leaves', attack_type, count(*) FROM bad WHERE attack_type IS NOT NULL GROUP BY attack_type, family
UNION ALL SELECT 'severity_by_family', family, count(*) FILTER (lower(severity) IN ('high', 'medium', 'low')) FROM bad WHERE family IS NOT NULL GROUP BY family
UNION ALL SELECT 'protocols', upper(protocol), count(*) FROM week GROUP BY upper(protocol)
UNION ALL SELECT 'hourly', CAST(flow_ms // 3600000 * 3600000 AS VARCHAR), count(*) FILTER (prediction <> 'Normal') FROM week GROUP BY flow_ms // 3600000
UNION ALL SELECT * FROM (SELECT 'ports', CAST(destination_port AS VARCHAR), count(*) AS c FROM bad WHERE destination_port > 0 GROUP BY destination_port ORDER BY c DESC, destination_port LIMIT 10)
UNION ALL SELECT 'headline', unnest(['normal', 'malicious_incl_suspicious', 'suspicious']), unnest([count(*) FILTER (prediction = 'Normal'), count(*) FILTER (prediction <> 'Normal'), count(*) FILTER (prediction = 'Suspicious')]) FROM week
UNION ALL SELECT 'severity', unnest(['high', 'medium', 'low']), unnest([count(*) FILTER (lower(severity) = 'high'), count(*) FILTER (lower(severity) = 'medium'), count(*) FILTER (lower(severity) = 'low')]) FROM bad"""


def _o(d, *cols):
    return d.select(*cols)


FRESH_COLS = ("id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "packet_size", "duration", "prediction",
              "attack_type", "family", "subtype", "confidence", "severity", "stage1_p", "stage2_p", "stage3_p", "source", "snort_msg",
              "snort_sid", "snort_classtype", "snort_priority")

QUERIES = {
    "a01_headline": (_p(A.headline), P + f"SELECT count(*) FILTER (prediction = 'Normal') AS normal, count(*) FILTER ({BAD}) AS malicious_incl_suspicious, count(*) FILTER (prediction = 'Suspicious') AS suspicious FROM pred"),
    "a02_severity_counts": (_p(A.severity_counts), P + "SELECT " + ", ".join(f"count(*) FILTER ({BAD} AND lower(severity) = '{v}') AS {v}" for v in ("high", "medium", "low")) + " FROM pred"),
    "a03_verdict_breakdown": (lambda s, d: A.verdict_breakdown(D.judged(s, d)), f"WITH {D.JUDGED_SQL} SELECT source, count(*) AS count FROM judged GROUP BY source"),
    "a04_family_breakdown": (_p(A.family_breakdown), P + f"SELECT family, count(*) AS count FROM pred WHERE family IS NOT NULL AND {BAD} GROUP BY family"),
    "a05_leaf_breakdown": (_p(A.leaf_breakdown), P + f"SELECT attack_type AS leaf, family, count(*) AS count, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM pred WHERE attack_type IS NOT NULL AND {BAD} GROUP BY ALL"),
    "a06_severity_by_family": (_p(A.severity_by_family), P + "SELECT family, " + ", ".join(f"count(*) FILTER (lower(severity) = '{v}') AS {v}" for v in ("high", "medium", "low")) + f", count(*) FILTER (severity IS NOT NULL) AS total FROM pred WHERE family IS NOT NULL AND {BAD} GROUP BY family"),
    "a07_pairs": (_p(A.pairs), P + f""", pf AS (SELECT source_ip, destination_ip, coalesce(family, 'Unknown') AS family, count(*) AS n FROM pred WHERE {BAD} GROUP BY ALL)
        SELECT source_ip, destination_ip, CAST(sum(n) AS BIGINT) AS count, first(family ORDER BY n DESC, family) AS top_family FROM pf GROUP BY ALL ORDER BY count DESC, source_ip, destination_ip LIMIT 10"""),
    "a08_attackers": (_p(A.attackers), PAIR_SQL + f"SELECT source_ip AS ip, CAST(sum(n + CASE WHEN source_ip = destination_ip THEN 0 ELSE back END) AS BIGINT) AS count FROM conv WHERE {LEAD} GROUP BY ip ORDER BY count DESC, ip LIMIT 5"),
    "a08_victims": (_p(A.victims), PAIR_SQL + f"SELECT destination_ip AS ip, CAST(sum(n + CASE WHEN source_ip = destination_ip THEN 0 ELSE back END) AS BIGINT) AS count FROM conv WHERE {LEAD} GROUP BY ip ORDER BY count DESC, ip LIMIT 5"),
    "a09_top_ports": (_p(A.top_ports), P + f"SELECT destination_port, count(*) AS count, CASE destination_port WHEN 22 THEN 'SSH' WHEN 80 THEN 'HTTP' WHEN 443 THEN 'HTTPS' WHEN 53 THEN 'DNS' WHEN 3389 THEN 'RDP' WHEN 8080 THEN 'HTTP-Alt' WHEN 21 THEN 'FTP' ELSE CASE WHEN destination_port = 0 THEN '' ELSE (SELECT coalesce(max(s), '') FROM (VALUES {', '.join(f'({k}, {v!r})' for k, v in fixed.PORT_SERVICES.items())}) t(p, s) WHERE p = destination_port) END END AS service FROM pred WHERE {BAD} AND destination_port > 0 GROUP BY destination_port ORDER BY count DESC, destination_port LIMIT 10"),
    "a10_protocols": (_p(A.protocols), P + "SELECT upper(protocol) AS protocol, count(*) AS count FROM pred GROUP BY 1"),
    "a11_hourly": (_p(_fixed_hour), HOURLY_SQL + "SELECT h.*, " + ", ".join(f"coalesce((SELECT n FROM hour_family f WHERE f.hour_ms = h.hour_ms AND f.family = '{x}'), 0) AS \"n_{x}\"" for x in fixed.FAMILIES) + " FROM hourly h"),
    "a12_steps": (_p(lambda d: A.steps(A.hourly(d))), HOURLY_SQL + "SELECT row_number() OVER (ORDER BY hour_ms) AS step, normal, malicious_only + suspicious AS suspicious FROM hourly"),
    "a13_tactic_counts": (_p(A.tactic_counts), P + f"SELECT tactic, count(*) AS count FROM pred JOIN kb_tactic ON category = attack_type WHERE has_mitre AND {BAD} GROUP BY tactic"),
    "a14_technique_counts": (_p(A.technique_counts), P + f"SELECT technique_id AS id, technique AS name, url, first_tactic AS tactic, count(*) AS count FROM pred JOIN kb_technique ON category = attack_type WHERE has_mitre AND {BAD} GROUP BY ALL"),
    "a15_kpis": (_p(lambda d: A.kpis(d, D.as_of())), P + f"SELECT CAST(sum(ack_ms - flow_ms) FILTER (ack_state <> 'new') AS DOUBLE) * 1000 / count(*) FILTER (ack_state <> 'new' AND ack_ms IS NOT NULL) / 1000000 AS mtta_seconds, count(*) FILTER (ack_state = 'new') AS backlog, CAST(max({D.AS_OF_MS} - flow_ms) FILTER (ack_state = 'new') AS DOUBLE) * 1000 / 1000000 AS oldest_unacked_seconds, count(*) FILTER (ack_state <> 'new' AND ack_ms IS NOT NULL) AS acked FROM pred"),
    "a16_prior_block": (_p(lambda d: A.prior_block(d, "7d", D.as_of())), P + _block_sql(PRI)),
    "a17_ack_counts": (_p(triage.ack_counts), P + "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (ack_state = '{s}') AS {s}" for s in fixed.ACK_STATES) + " FROM pred"),
    "a18_campaigns": (_p(_campaigns), CAMP + "SELECT * FROM camp"),
    "a18_campaign_total": (_p(triage.campaign_total), CAMP + "SELECT count(*) AS total FROM camp"),
    "a19_ack_state": (_ack_state, f"WITH {D.ACK_SQL} SELECT prediction_id, to_state AS ack_state, changed_ms AS ack_ms, user_id AS ack_by FROM last_ack"),
    "a19_ack_log": (_ack_log, f"WITH {D.ACK_SQL} SELECT id, prediction_id, coalesce(lag(to_state) OVER (PARTITION BY prediction_id ORDER BY changed_ms, id), 'new') AS from_state, to_state, changed_ms FROM ack_log"),
    "a20_batch_counts": (_p(A.batch_counts), P + "SELECT count(*) FILTER (prediction = 'Normal') AS normal, count(*) FILTER (prediction = 'Malicious') AS malicious, count(*) FILTER (prediction = 'Suspicious') AS suspicious, " + ", ".join(f"count(*) FILTER (source = '{v}') AS {v}" for v in fixed.VERDICTS) + " FROM pred"),
    "a21_store_stats": (_p(_stats), P + "SELECT count(*) AS rows, min(flow_ms) AS oldest_ms, max(flow_ms) AS newest_ms FROM pred"),
    "a22_agreement": (_p(A.agreement), P + "SELECT source IN ('confirmed', 'signature_only') AS signature, source IN ('confirmed', 'ml_only') AS model, count(*) AS count, CAST(round(CAST(count(*) * CAST(100 AS DOUBLE) / sum(count(*)) OVER () AS DECIMAL(24,12)), 1) AS DOUBLE) AS percent FROM pred GROUP BY source"),
    "a23_analytics_bundle": (_bundle, BUNDLE_SQL),
    "a24_detection_latency": (_p(A.detection_latency), P + "SELECT count(*) AS rows, CAST(sum((stored_ms - flow_ms) // 1000) AS DOUBLE) / count(*) AS mean_s, quantile_disc((stored_ms - flow_ms) // 1000, 0.5) AS median_s, max((stored_ms - flow_ms) // 1000) AS max_s FROM pred"),
    "a26_rule_hits": (lambda s, d: suppress.rule_hits(D.fresh_predictions(s, d), D.rules(s, d), D.as_of()).select("id", "kind", "hits"), SUPPRESS_SQL + "SELECT r.id, r.kind, (SELECT count(*) FROM hit WHERE rn = 1 AND rule_id = r.id) AS hits FROM rules r"),
    "a28_timeline_summary": (_p(lambda d: A.timeline_summary(A.hourly(d)).select("normal", "malicious_only", "suspicious", MS("peak_hour").alias("peak_ms"), "peak")), HOURLY_SQL + "SELECT CAST(sum(normal) AS BIGINT) AS normal, CAST(sum(malicious_only) AS BIGINT) AS malicious_only, CAST(sum(suspicious) AS BIGINT) AS suspicious, first(hour_ms ORDER BY malicious_only DESC, hour_ms) AS peak_ms, max(malicious_only) AS peak FROM hourly"),
    "a29_live_topk": (_p(A.live_topk), P + """, e AS (SELECT 'verdict' AS section, source AS key FROM pred UNION ALL SELECT 'family', family FROM pred UNION ALL SELECT 'source', source_ip FROM pred UNION ALL SELECT 'leaf', attack_type FROM pred),
        g AS (SELECT section, key, count(*) AS count FROM e WHERE key IS NOT NULL GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY count DESC, key) AS INT) AS rank FROM g)
        SELECT * FROM r WHERE rank <= CASE section WHEN 'family' THEN 6 WHEN 'verdict' THEN 4 ELSE 5 END"""),
    "w01_anomalies": (_p(lambda d: _with_hour(A.anomalies(A.hourly(d)))), HOURLY_SQL + """, w AS (SELECT hour_ms, malicious_only AS value, sum(malicious_only) OVER v AS s, sum(malicious_only * malicious_only) OVER v AS q, count(*) OVER v AS n
        FROM hourly WINDOW v AS (ORDER BY hour_ms ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
        x AS (SELECT hour_ms, value, CAST(s AS DOUBLE) / n AS mean, sqrt(CAST(n * q - s * s AS DOUBLE) / (n * n)) AS sd FROM w WHERE n = 6)
        SELECT hour_ms, value, (value - mean) / sd AS z FROM x WHERE sd > 0 AND (value - mean) / sd >= 2.5"""),
    "w02_campaign_view": (_p(_campaign_view), CAMP + """, r AS (SELECT *, row_number() OVER (PARTITION BY source_ip, destination_ip, family ORDER BY flow_ms DESC, id) AS rn FROM pred)
        SELECT r.source_ip, r.destination_ip, r.family, any_value(c.count) AS count, first(r.id ORDER BY rn) AS newest_id, CAST(count(*) AS INT) AS samples, string_agg(r.id, ',' ORDER BY rn) AS ids
        FROM r JOIN camp c ON c.source_ip = r.source_ip AND c.destination_ip = r.destination_ip AND c.family IS NOT DISTINCT FROM r.family WHERE rn <= 50 GROUP BY r.source_ip, r.destination_ip, r.family"""),
    "w02_campaign_page": (_p(lambda d: _campaign_view(d, samples=20, limit=40, offset=5)), CAMP + """, chosen AS (SELECT * FROM camp ORDER BY count DESC, source_ip NULLS FIRST, destination_ip NULLS FIRST, family NULLS FIRST LIMIT 40 OFFSET 5),
        r AS (SELECT *, row_number() OVER (PARTITION BY source_ip, destination_ip, family ORDER BY flow_ms DESC, id) AS rn FROM pred)
        SELECT r.source_ip, r.destination_ip, r.family, any_value(c.count) AS count, first(r.id ORDER BY rn) AS newest_id, CAST(count(*) AS INT) AS samples, string_agg(r.id, ',' ORDER BY rn) AS ids
        FROM r JOIN chosen c ON c.source_ip = r.source_ip AND c.destination_ip = r.destination_ip AND c.family IS NOT DISTINCT FROM r.family WHERE rn <= 20 GROUP BY r.source_ip, r.destination_ip, r.family"""),
    "w03_latest_n": (_p(lambda d: triage.latest_n(d, 2000).select("id", MS("flow_timestamp").alias("flow_ms"))), P + "SELECT id, flow_ms FROM pred ORDER BY flow_ms DESC, id LIMIT 2000"),
    "w08_heatmap": (_p(lambda d: _with_hour(A.heatmap(A.hourly_families(d)))), HOURLY_SQL + """, t AS (SELECT family, CAST(sum(n) AS BIGINT) AS family_total, CAST(row_number() OVER (ORDER BY sum(n) DESC, family) AS INT) AS family_rank FROM hour_family GROUP BY family)
        SELECT family, hour_ms, n AS count, CAST(round(CAST(log10(n + 1) / log10((SELECT max(n) + 1 FROM hour_family)) AS DECIMAL(24,12)), 6) AS DOUBLE) AS intensity, family_total, family_rank FROM hour_family JOIN t USING (family)"""),
    "j14_reverse_pairs": (_p(A.with_reverse), PAIR_SQL + "SELECT source_ip, destination_ip, n AS count, back AS reverse_count FROM conv"),
    "j15_trend": (_p(_trend), TREND_SQL),
    "f01_queue_filter": (_p(lambda d: predicates.queue_filter(d, ack_state="new", severity="HIGH", source="signature_only", port_min=22, port_max=443).select("id")), P + "SELECT id FROM pred WHERE ack_state = 'new' AND severity = 'High' AND source = 'signature_only' AND destination_port BETWEEN 22 AND 443"),
    "f02_search": (_p(lambda d: predicates.search(d, "20130_8").select("id")), P + "SELECT id FROM pred WHERE " + " OR ".join(f"lower(coalesce(CAST({c} AS VARCHAR), '')) LIKE '%20130_8%'" for c in ("source_ip", "destination_ip", "snort_msg", "snort_sid", "family", "attack_type", "id", "source_port", "destination_port"))),
    "f02_search_text": (_p(lambda d: predicates.search(d, "Slow").select("id")), P + "SELECT id FROM pred WHERE lower(coalesce(attack_type, '')) LIKE '%slow%' OR lower(coalesce(family, '')) LIKE '%slow%' OR lower(snort_msg) LIKE '%slow%'"),
    "f03_cidr": (_p(lambda d: predicates.queue_filter(d, src_cidr="10.2.3.4/16", dst_cidr="192.168.0.0/22").select("id")), P + "SELECT id FROM pred WHERE source_ip LIKE '10.2.%' AND (destination_ip LIKE '192.168.0.%' OR destination_ip LIKE '192.168.1.%' OR destination_ip LIKE '192.168.2.%' OR destination_ip LIKE '192.168.3.%')"),
    "f03_cidr_v6": (lambda s, d: D.both_families(D.flows(s, d)).filter(N.in_cidr("source_ip", "2001:db8:0:4::/63")).select("flow_id", "source_ip"), f"WITH {D.FLOWS_SQL} SELECT flow_id, '2001:DB8:0:' || lower(to_hex(o % 16)) || '::' || lower(to_hex(c % 250 + 1)) AS source_ip FROM flows WHERE o % 3 = 0 AND o % 16 IN (4, 5)"),
    "f04_in_range": (_p(lambda d: predicates.in_range(d, "24h", D.as_of()).select("id")), P + f"SELECT id FROM pred WHERE flow_ms >= {D.AS_OF_MS - 86400000}"),
    "f05_prior_window": (_p(lambda d: predicates.prior_window(d, "24h", D.as_of()).select("id")), P + f"SELECT id FROM pred WHERE flow_ms >= {D.AS_OF_MS - 2 * 86400000} AND flow_ms < {D.AS_OF_MS - 86400000}"),
    "f06_drop_benign": (lambda s, d: predicates.drop_benign(D.judged(s, d)).groupBy("source", "prediction").agg(F.count("*").alias("rows")), f"WITH {D.JUDGED_SQL} SELECT source, prediction, count(*) AS rows FROM judged WHERE event_id IS NOT NULL OR prediction = 'Malicious' GROUP BY ALL"),
    "f07_triage_filter": (_p(lambda d: predicates.triage_filter(d, "actionable").select("id")), P + "SELECT id FROM pred WHERE prediction = 'Malicious' AND severity IN ('High', 'Medium')"),
    "f08_private_ip": (_p(lambda d: d.select("id", N.is_private_ip("source_ip").alias("src_private"), N.is_private_ip(F.concat(F.lit("172."), F.col("destination_port").cast("string"), F.lit(".0.1"))).alias("made_private"))), P + "SELECT id, source_ip LIKE '10.%' OR source_ip LIKE '192.168.%' AS src_private, destination_port BETWEEN 16 AND 31 AS made_private FROM pred"),
    "f09_auto_widen": (_p(lambda d: predicates.auto_widen(d.filter(F.col("prediction") == "Normal"), "1h", F.to_timestamp(F.lit("2024-02-03 00:00:00")))), WIDEN_SQL),
    "o01_page_time": (_page("time", "desc", 200, 0), _page_sql("flow_ms", "desc", 200, 0)),
    "o01_page_severity": (_page("severity", "desc", 500, 300), _page_sql(RANK, "desc", 500, 300)),
    "o01_page_family_asc": (_page("family", "asc", 1000, 2000), _page_sql("family", "asc", 1000, 2000)),
    "o01_page_deep_time": (_page("time", "desc", 500, 11000), _page_sql("flow_ms", "desc", 500, 11000)),
    "o01_page_deep": (_page("source", "asc", 1000, 12000), _page_sql("source", "asc", 1000, 12000)),
    "o01_page_total": (_p(lambda d: COUNT(predicates.queue_filter(d, severity="medium"))), P + "SELECT count(*) AS rows FROM pred WHERE severity = 'Medium'"),
    "o02_severity_rank": (_p(lambda d: d.select("id", S.severity_rank("severity").alias("rank"))), P + f"SELECT id, {RANK} AS rank FROM pred"),
    "o03_cap_results": (_p(lambda d: triage.cap_results(d.withColumn("o", F.substring_index("id", "_", -1).cast("long")), 8000, "o").select("id", "source")), P + "SELECT id, source FROM pred ORDER BY source = 'benign', o LIMIT 8000"),
    "o04_hard_cap": (_p(lambda d: triage.hard_cap(d, 11000).select("id")), P + "SELECT id FROM pred ORDER BY stored_ms DESC, id LIMIT 11000"),
    "o05_retain_days": (_p(lambda d: triage.retain_days(d, 10, D.as_of()).select("id")), P + f"SELECT id FROM pred WHERE flow_ms >= {D.AS_OF_MS - 10 * 86400000}"),
    "o07_active_rules": (lambda s, d: suppress.active_rules(D.rules(s, d), D.as_of()).select("id", "kind", "value"), f"WITH {D.FLOWS_SQL}, {D.RULES_SQL} SELECT id, kind, value FROM rules WHERE expires IS NULL OR expires > DATE '2024-01-31'"),
    "j05_suppress": (_suppressed, SUPPRESS_SQL + "SELECT p.id, hit.rule_id, hit.kind FROM pred p LEFT JOIN hit ON hit.id = p.id AND rn = 1"),
    "j05_networks": (_networks, NETWORK_SQL),
    "j05_kept": (lambda s, d: suppress.suppress(D.fresh_predictions(s, d), D.rules(s, d), D.as_of()).groupBy("source").agg(F.count("*").alias("rows")), SUPPRESS_SQL + "SELECT source, count(*) AS rows FROM pred WHERE id NOT IN (SELECT id FROM hit) GROUP BY source"),
    "j06_enrich_attack": (_p(lambda d: d.select("id", F.col("mitre.confidence_band").alias("band"), F.size(F.coalesce("mitre.tactics", F.array().cast("array<struct<id:string,name:string>>"))).alias("tactics"), enrich.first_tactic("mitre").alias("first_tactic"), F.transform("mitre.techniques", lambda t: t["id"])[0].alias("technique"))), P + """SELECT id, CASE WHEN has_mitre THEN band END AS band, CASE WHEN has_mitre THEN (SELECT CAST(count(*) AS INT) FROM kb_tactic k WHERE k.category = attack_type) ELSE 0 END AS tactics,
        CASE WHEN has_mitre THEN (SELECT tactic FROM kb_tactic k WHERE k.category = attack_type AND pos = 0) ELSE '' END AS first_tactic,
        CASE WHEN has_mitre THEN (SELECT min(technique_id) FROM kb_technique k WHERE k.category = attack_type AND pos = 0) END AS technique FROM pred"""),
    "j07_usernames": (_p(lambda d: d), None),
    "j08_ack_trail": (_trail, P + f", {D.USERS_SQL}, l AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY prediction_id ORDER BY changed_ms, id), 'new') AS from_state FROM ack_log) SELECT p.id, p.source, l.id AS change_id, l.from_state, l.to_state, l.changed_ms, u.username AS changed_by FROM pred p LEFT JOIN l ON l.prediction_id = p.id LEFT JOIN users u ON u.id = l.user_id"),
    "j13_split_ids": (_split_ids, f"WITH {D.FLOWS_SQL} SELECT 'flow_' || (event_id * 7) AS id, 'flow_' || (event_id * 7) IN (SELECT flow_id FROM flows) AS found FROM events"),
    "j16_ack_ids": (_ack_ids, P + f"SELECT id AS prediction_id, ack_state AS from_state, 'reviewed' AS to_state, CAST(7 AS BIGINT) AS user_id, 'bulk' AS note, {D.AS_OF_MS} AS changed_ms FROM pred WHERE id IN (SELECT 'flow_' || (event_id * 7) FROM events)"),
    "j16_ack_match": (_ack_match, P + "SELECT id AS prediction_id, ack_state AS from_state, 'dismissed' AS to_state, CAST(3 AS BIGINT) AS user_id FROM pred WHERE destination_ip = '192.168.1.3' AND family = 'BruteForce'"),
    "p17_format_predictions": (lambda s, d: D.fresh_predictions(s, d).select(*FRESH_COLS, MS("flow_timestamp").alias("flow_ms")), P + f"SELECT {', '.join(FRESH_COLS)}, flow_ms FROM pred"),
}
QUERIES["j07_usernames"] = (
    lambda s, d: enrich.with_usernames(D.predictions(s, d), D.users(s, d)).select("id", "ack_by", "ack_by_name"),
    P + f", {D.USERS_SQL} SELECT p.id, ack_by, username AS ack_by_name FROM pred p LEFT JOIN users u ON u.id = ack_by",
)
