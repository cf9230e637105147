"""Filters of the analyst queue and the live path. All are plain column predicates, so they reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N


def search_predicate(q: str) -> Column:
    """Text in any of nine columns, case ignored; ``%`` and ``_`` in it are wildcards, unless a backslash stands before them. Any other backslash is one."""
    pattern = "%" + re.sub(r"\\([%_\\])|\\", lambda m: m[0] if m[1] else "\\\\", q.lower()) + "%"
    texts = ("source_ip", "destination_ip", "snort_msg", "snort_sid", "family", "attack_type", "id", "source_port", "destination_port")
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).like(pattern), F.lit(False))
    return hit


def search(df: DataFrame, q: str) -> DataFrame:
    return df.filter(search_predicate(q))


def queue_filter(
    df: DataFrame, ack_state: str | None = None, severity: str | None = None, source: str | None = None, q: str | None = None,
    src_cidr: str | None = None, dst_cidr: str | None = None, port_min: int | None = None, port_max: int | None = None,
) -> DataFrame:
    """The conditions of the queue, each optional, all of them together."""
    if ack_state:
        df = df.filter(F.col("ack_state") == ack_state)
    if severity:
        df = df.filter(F.lower("severity") == severity.lower())
    if source:
        df = df.filter(F.col("source") == source)
    if q:
        df = search(df, q)
    if src_cidr:
        df = df.filter(N.in_cidr("source_ip", src_cidr))
    if dst_cidr:
        df = df.filter(N.in_cidr("destination_ip", dst_cidr))
    if port_min is not None:
        df = df.filter(F.col("destination_port") >= port_min)
    if port_max is not None:
        df = df.filter(F.col("destination_port") <= port_max)
    return df


def _ago(as_of: Column, seconds: int) -> Column:
    return as_of - F.make_dt_interval(secs=F.lit(float(seconds)))


def _partition_floor(df: DataFrame, ts: str, low: Column) -> DataFrame:
    """On a stored queue the date column follows the time, so the lower bound prunes folders as well."""
    if "flow_date" in df.columns and ts == "flow_timestamp":
        return df.filter(F.col("flow_date") >= F.to_date(low))
    return df


def in_range(df: DataFrame, key: str, as_of: Column, ts: str = "flow_timestamp") -> DataFrame:
    """Rows not older than the range; an unknown key means everything."""
    seconds = fixed.RANGE_SECONDS.get(key)
    if seconds is None:
        return df
    low = _ago(as_of, seconds)
    return _partition_floor(df, ts, low).filter(F.col(ts) >= low)


def prior_window(df: DataFrame, key: str, as_of: Column, ts: str = "flow_timestamp") -> DataFrame | None:
    """Rows of the window of equal length before the current one; there is none before ``all``."""
    seconds = fixed.RANGE_SECONDS.get(key)
    if seconds is None:
        return None
    low = _ago(as_of, 2 * seconds)
    return _partition_floor(df, ts, low).filter((F.col(ts) >= low) & (F.col(ts) < _ago(as_of, seconds)))


def drop_benign(df: DataFrame, keep: bool = False, alert: str = "alert") -> DataFrame:
    """Drops rows without an alert that the model does not call malicious."""
    if keep:
        return df
    return df.filter(F.col(alert).isNotNull() | F.coalesce(F.col("prediction") == "Malicious", F.lit(False)))


def triage_filter(df: DataFrame, key: str) -> DataFrame:
    """``actionable``: malicious and at least Medium; ``normal`` and ``suspicious`` by label; anything else: all rows."""
    if key == "actionable":
        return df.filter((F.col("prediction") == "Malicious") & F.col("severity").isin("High", "Medium"))
    if key == "normal":
        return df.filter(F.col("prediction") == "Normal")
    if key == "suspicious":
        return df.filter(F.col("prediction") == "Suspicious")
    return df


def auto_widen(df: DataFrame, start: str, as_of: Column, ts: str = "flow_timestamp") -> DataFrame:
    """The first range from ``start`` on that holds rows, with its row count: one pass counts all ranges.

    An empty table stays at ``start``.
    """
    keys = list(fixed.RANGE_SECONDS)
    wider = keys[keys.index(start):]
    counts = []
    for k in wider:
        seconds = fixed.RANGE_SECONDS[k]
        hit = F.lit(True) if seconds is None else F.col(ts) >= _ago(as_of, seconds)
        counts.append(F.count_if(hit).alias(f"n_{k}"))
    one = df.agg(*counts)
    pick = F.lit(start)
    count = F.lit(0).cast("long")
    for k in reversed(wider):
        pick = F.when(F.col(f"n_{k}") > 0, F.lit(k)).otherwise(pick)
        count = F.when(F.col(f"n_{k}") > 0, F.col(f"n_{k}")).otherwise(count)
    return one.select(pick.alias("range"), count.alias("rows"), (pick != start).alias("widened"))


def after_attach(flows: DataFrame, sessions: DataFrame, ts: str = "ts_ms") -> DataFrame:
    """Flow events of a session from the moment its source was attached."""
    s = sessions.select("session_id", F.col("attached_ms").alias("_from"))
    return flows.join(s, "session_id").filter(F.col(ts) >= F.col("_from")).drop("_from")
