"""The analyst queue: paging, campaigns, acknowledgement log, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.functions import scoring as S
from flowsieve.operators import enrich
from flowsieve.operators.distributed import first_n, previous_by_time, ranked_slice, same

DEEP = 10_000
HOUR = 3600


def _hour(ts: str) -> Column:
    return F.floor(F.unix_seconds(F.col(ts)) / HOUR)


def _second(ts: str) -> Column:
    return F.unix_seconds(F.col(ts))


def sort_key(name: str) -> Column:
    if name in ("severity", "risk"):
        return S.severity_rank("severity")
    return F.col({"family": "family", "source": "source"}.get(name, "flow_timestamp"))


def page(df: DataFrame, sort: str = "time", direction: str = "desc", limit: int = 200, offset: int = 0) -> DataFrame:
    """One page of the queue: sort key, then newest, then id; the limit is held to 1–1000.

    Missing values come first when descending and last when ascending. A page near the top is a top-k; a page far down is
    placed by the numbers of rows per hour and second, and only the rows of its own seconds are ranked.
    """
    limit, offset = max(1, min(int(limit), 1000)), max(0, int(offset))
    key = sort_key(sort)
    way = (lambda c: c.asc_nulls_last()) if direction == "asc" else (lambda c: c.desc_nulls_first())
    newest = [F.col("flow_timestamp").desc(), F.col("id")]
    if offset + limit <= DEEP:
        return df.orderBy(way(key), *newest).offset(offset).limit(limit)
    if sort in ("severity", "risk", "family", "source"):
        bucket = F.struct(key.alias("k"), _hour("flow_timestamp").alias("h"))
        levels = [(bucket, [way(F.col("_bucket.k")), F.col("_bucket.h").desc()]), (_second("flow_timestamp"), [F.col("_bucket").desc()])]
    else:
        levels = [(_hour("flow_timestamp"), [way(F.col("_bucket"))]), (_second("flow_timestamp"), [way(F.col("_bucket"))])]
    return ranked_slice(df, levels, [way(key), *newest], offset + 1, offset + limit, "_rank").orderBy("_rank").drop("_rank")


def cap_results(df: DataFrame, n: int, seq: str) -> DataFrame:
    """At most ``n`` rows, rows that need action first, input order kept in both parts; n ≤ 0 means no cap."""
    if n <= 0:
        return df
    benign = F.coalesce(F.col("source"), F.lit("benign")) == "benign"
    width = 1 << 16
    bucket = F.struct(benign.alias("b"), F.floor(F.col(seq) / width).alias("s"))
    return first_n(df, bucket, [benign, F.col(seq)], n).orderBy(benign, seq)


def latest_n(df: DataFrame, n: int = 2000, ts: str = "flow_timestamp", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows, newest first; rows without a time come last."""
    return hard_cap(df, n, ts, tie).orderBy(F.col(ts).desc_nulls_last(), F.col(tie))


def hard_cap(df: DataFrame, n: int, ts: str = "first_seen_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` rows of a table, for limits of any size: whole hours are kept or dropped, of one hour whole seconds, and one second is ranked. Rows without a time are the oldest."""
    if n <= 0:
        return df
    return first_n(df, -_hour(ts), [F.col(ts).desc_nulls_last(), F.col(tie)], n, finer=[-_second(ts)])


def retain_days(df: DataFrame, days: int, as_of: Column, ts: str = "flow_timestamp") -> DataFrame:
    if days <= 0:
        return df
    cutoff = as_of - F.make_dt_interval(days=F.lit(days))
    if "flow_date" in df.columns:
        df = df.filter(F.col("flow_date") >= F.to_date(cutoff))
    return df.filter(F.col(ts) >= cutoff)


def store_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.min("flow_timestamp").alias("oldest"), F.max("flow_timestamp").alias("newest"),
    )


def ack_counts(df: DataFrame) -> DataFrame:
    """Rows per acknowledgement state, states without rows as 0, and the total."""
    return df.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("ack_state") == s).alias(s) for s in fixed.ACK_STATES],
    )


# ---- campaigns ------------------------------------------------------------------------------------------------------

CAMPAIGN = ("source_ip", "destination_ip", "family")


def campaigns(df: DataFrame) -> DataFrame:
    """Rows folded by source, destination and family."""
    return df.groupBy(*CAMPAIGN).agg(
        F.count("*").alias("count"), F.min("flow_timestamp").alias("first_seen"), F.max("flow_timestamp").alias("last_seen"),
    )


def campaign_total(df: DataFrame) -> DataFrame:
    return df.select(*CAMPAIGN).distinct().agg(F.count("*").alias("total"))


def campaign_view(df: DataFrame, samples: int = 50, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Campaigns, largest first, with their newest row (struct ``newest``) and the ids of up to ``samples`` newest rows.

    The ranking keeps at most ``samples`` rows per campaign and task before anything is shuffled, so neither a large
    campaign nor its id list grows without bound. With a limit only the rows of the chosen campaigns are ranked.
    """
    groups = campaigns(df)
    if limit is not None:
        ordered = groups.orderBy(F.col("count").desc(), *[F.col(c).asc_nulls_first() for c in CAMPAIGN])
        groups = ordered.offset(offset).limit(limit)
        chosen = groups.select(*CAMPAIGN)
        df = same(df, F.broadcast(chosen) if limit <= DEEP else chosen, CAMPAIGN, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*CAMPAIGN).orderBy(F.col("flow_timestamp").desc(), F.col("id")))
    top = df.withColumn("_rank", rank).filter(F.col("_rank") <= samples)
    body = [c for c in df.columns if c not in CAMPAIGN]
    heads = top.groupBy(*CAMPAIGN).agg(
        F.min_by(F.struct(*body), "_rank").alias("newest"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "id"))), lambda e: e["id"]).alias("sample_ids"),
    )
    alike = [groups[c].eqNullSafe(heads[c]) for c in CAMPAIGN]
    return groups.join(heads, alike).select(*[groups[c] for c in CAMPAIGN], "count", "first_seen", "last_seen", "newest", "sample_ids")


def related(df: DataFrame, limit: int = 10) -> DataFrame:
    """For every row the ids of up to ``limit`` newest other rows with the same flow key, as (id, related_id, position).

    Each key keeps its ``limit + 1`` newest rows as a short list; a row takes the list without itself. The work is linear
    in the rows, no pairs within a key are formed.
    """
    key = N.flow_key("source_ip", "destination_ip", "source_port", "destination_port", "protocol")
    d = df.select("id", "flow_timestamp", key.alias("_key"))
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("flow_timestamp").desc(), F.col("id")))
    short = (
        d.withColumn("_rank", rank).filter(F.col("_rank") <= limit + 1)
        .groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_rank", "id"))).alias("_list"))
        .filter(F.size("_list") > 1)
    )
    others = F.slice(F.filter("_list", lambda e: e["id"] != F.col("id")), 1, limit)
    return d.join(short, "_key").select("id", F.posexplode(F.transform(others, lambda e: e["id"])).alias("position", "related_id"))


# ---- acknowledgement log --------------------------------------------------------------------------------------------

def ack_state(log: DataFrame) -> DataFrame:
    """Latest change per prediction: state, time, user, note."""
    last = F.max_by(F.struct("to_state", "changed_at", "user_id", "note"), F.struct("changed_at", "id")).alias("s")
    return log.groupBy("prediction_id").agg(last).select(
        "prediction_id", F.col("s.to_state").alias("ack_state"), F.col("s.changed_at").alias("ack_at"),
        F.col("s.user_id").alias("ack_by"), F.col("s.note").alias("ack_note"),
    )


def ack_log(log: DataFrame) -> DataFrame:
    """The log with ``from_state``: the state before each change, ``new`` at the start."""
    timed = log.withColumn("_ms", F.unix_millis("changed_at"))
    out = previous_by_time(timed, ["prediction_id"], "_ms", ["to_state"], ["id"], width=86_400_000)
    return out.withColumn("from_state", F.coalesce("prev_to_state", F.lit("new"))).drop("prev_to_state", "_ms")


def with_ack_state(df: DataFrame, log: DataFrame) -> DataFrame:
    """Queue rows with the state the log gives them; rows nobody touched are ``new``."""
    s = ack_state(log).withColumnRenamed("prediction_id", "id")
    plain = df.drop("ack_state", "ack_at", "ack_by", "ack_note")
    return plain.join(s, "id", "left").withColumn("ack_state", F.coalesce("ack_state", F.lit("new")))


def with_ack_trail(df: DataFrame, log: DataFrame, users: DataFrame) -> DataFrame:
    """Queue rows with their changes, one output row per change (one with nulls if none). Within a partition a prediction's changes stand together, newest first;
    the whole result is not sorted.

    The trail stays in rows: a prediction may have any number of changes.
    """
    trail = enrich.with_usernames(ack_log(log), users, "user_id", "changed_by").select(
        F.col("prediction_id").alias("id"), F.col("id").alias("change_id"), "from_state", "to_state", F.col("note").alias("change_note"),
        "changed_at", "changed_by",
    )
    return df.join(trail, "id", "left").sortWithinPartitions("id", F.col("changed_at").desc(), F.col("change_id").desc())


def _changes(targets: DataFrame, state: str, user_id: int | None, note: str | None, at: Column) -> DataFrame:
    if state not in fixed.ACK_STATES:
        raise ValueError(f"unknown state {state!r}")
    return targets.select(
        F.concat_ws(":", "id", F.unix_micros(at).cast("string")).alias("id"), F.col("id").alias("prediction_id"),
        F.lit(user_id).cast("long").alias("user_id"), F.col("ack_state").alias("from_state"), F.lit(state).alias("to_state"),
        F.lit(note).cast("string").alias("note"), at.alias("changed_at"),
    )


def ack_ids(df: DataFrame, ids: DataFrame, state: str, at: Column, user_id: int | None = None, note: str | None = None) -> DataFrame:
    """Log rows that set the listed predictions to ``state``; unknown ids give none (see ``split_ids``)."""
    return _changes(df.join(ids.select("id").distinct(), "id", "left_semi"), state, user_id, note, at)


def ack_match(
    df: DataFrame, state: str, at: Column, source_ip: str | None = None, destination_ip: str | None = None, family: str | None = None,
    user_id: int | None = None, note: str | None = None,
) -> DataFrame:
    """Log rows that set every prediction with the given source, destination or family (at least one) to ``state``."""
    wanted = {"source_ip": source_ip, "destination_ip": destination_ip, "family": family}
    if not any(wanted.values()):
        raise ValueError("give at least one of source_ip, destination_ip, family")
    for c, v in wanted.items():
        if v:
            df = df.filter(F.col(c) == v)
    return _changes(df, state, user_id, note, at)


def split_ids(ids: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ids that exist and those that do not."""
    known = df.select("id")
    return ids.join(known, "id", "left_semi"), ids.join(known, "id", "left_anti")
