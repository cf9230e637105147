"""Registered queries: correlation, verdicts and attack enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowsieve.operators import correlate, verdict
from flowsieve.plans import driver_tables as D


def _verdict_counts(df):
    return df.groupBy("source").agg(F.count("*").alias("flows"))


def j1_correlate_both(spark, sf):
    return _verdict_counts(D.judged(spark, sf))


def j1_correlate_forward(spark, sf):
    joined = correlate.correlate(D.scored(spark, sf), D.alerts(spark, sf).drop("o"), bidirectional=False)
    return _verdict_counts(verdict.hybrid_verdict(joined))


def j1_rows(spark, sf):
    d = D.judged(spark, sf)
    return d.select("flow_id", "source", "prediction", "severity", "confidence", F.col("alert.snort_sid").alias("snort_sid"),
                    F.col("alert.event_id").alias("event_id"))


QUERIES = {
    "j01_correlate_both": (j1_correlate_both, f"WITH {D.JUDGED_SQL} SELECT source, count(*) AS flows FROM judged GROUP BY source"),
    "j01_correlate_forward": (j1_correlate_forward, f"""WITH {D.JUDGED_SQL}, f AS (SELECT s.flow_id, CASE WHEN a.event_id IS NOT NULL AND s.prediction = 'Malicious' THEN 'confirmed'
        WHEN a.event_id IS NOT NULL THEN 'signature_only' WHEN s.prediction = 'Malicious' THEN 'ml_only' ELSE 'benign' END AS source
        FROM scored s LEFT JOIN first_alert a USING (src_ip, dst_ip, src_port, dst_port, protocol)) SELECT source, count(*) AS flows FROM f GROUP BY source"""),
    "j01_rows": (j1_rows, f"WITH {D.JUDGED_SQL} SELECT flow_id, source, prediction, severity, confidence, snort_sid, event_id FROM judged"),
}
