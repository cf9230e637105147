"""Aggregates of the analytics page and the live overview.

``roll_up`` folds the rows once by hour and the few-valued columns. Every count section takes either rows or that folded
table (recognised by its column ``n``), so one pass over the data feeds them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.functions import scoring as S
from flowsieve.functions import times as TM
from flowsieve.operators import enrich, predicates, triage
from flowsieve.session import cut_lineage

DIMENSIONS = ("hour", "prediction", "severity", "source", "family", "attack_type", "protocol")


def roll_up(df: DataFrame) -> DataFrame:
    """Row counts by hour, label, severity, verdict, family, leaf and protocol."""
    d = df.withColumns({"hour": TM.hour_of("flow_timestamp"), "severity": F.lower("severity"), "protocol": F.upper("protocol")})
    return d.groupBy(*DIMENSIONS).agg(F.count("*").alias("n"))


def _n(df: DataFrame, when: Column | None = None) -> Column:
    if "n" in df.columns:
        return F.coalesce(F.sum("n" if when is None else F.when(when, F.col("n"))), F.lit(0)).cast("long")
    return F.count("*") if when is None else F.count_if(F.coalesce(when, F.lit(False)))


def _bad(df: DataFrame) -> DataFrame:
    return df.filter(F.col("prediction") != "Normal")


def headline(df: DataFrame) -> DataFrame:
    """Normal, malicious (suspicious rows included) and suspicious."""
    p = F.col("prediction")
    return df.agg(
        _n(df, p == "Normal").alias("normal"), _n(df, p != "Normal").alias("malicious_incl_suspicious"),
        _n(df, p == "Suspicious").alias("suspicious"),
    )


def severity_counts(df: DataFrame) -> DataFrame:
    s = F.lower("severity")
    b = _bad(df)
    return b.agg(*[_n(b, s == v).alias(v) for v in ("high", "medium", "low")])


def verdict_breakdown(df: DataFrame) -> DataFrame:
    """Rows per verdict; a missing one counts as benign; verdicts without rows are left out; fixed order."""
    d = df.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), F.lit("benign")))
    order = F.array_position(F.array(*[F.lit(v) for v in fixed.VERDICTS]), F.col("source"))
    return d.filter(F.col("source").isin(*fixed.VERDICTS)).groupBy("source").agg(_n(d).alias("count")).orderBy(order)


def family_breakdown(df: DataFrame) -> DataFrame:
    b = _bad(df).filter("family is not null")
    return b.groupBy("family").agg(_n(b).alias("count")).orderBy(F.col("count").desc(), "family")


def leaf_breakdown(df: DataFrame) -> DataFrame:
    """Rows per leaf and family with their share of all such rows (leaves are a handful of groups)."""
    b = _bad(df).filter("attack_type is not null")
    g = b.groupBy("attack_type", "family").agg(_n(b).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return g.select(
        F.col("attack_type").alias("leaf"), F.coalesce("family", F.lit("Unknown")).alias("family"), "count",
        (F.col("count") / total).alias("share"),
    ).orderBy(F.col("count").desc(), "leaf")


def severity_by_family(df: DataFrame) -> DataFrame:
    b = _bad(df).filter("family is not null")
    s = F.lower("severity")
    cells = b.groupBy("family").agg(*[_n(b, s == v).alias(v) for v in ("high", "medium", "low")])
    return cells.withColumn("total", F.col("high") + F.col("medium") + F.col("low")).orderBy(F.col("total").desc(), "family")


def pair_counts(df: DataFrame) -> DataFrame:
    """Non-Normal rows per direction and family: the small table the pair sections are folded from."""
    b = _bad(df).filter("source_ip is not null and destination_ip is not null")
    fam = F.coalesce(F.nullif("family", F.lit("")), F.lit("Unknown"))
    return b.groupBy("source_ip", "destination_ip", fam.alias("family")).agg(F.count("*").alias("count"))


def pairs(df: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` busiest source→destination pairs with their dominant family."""
    g = pair_counts(df).groupBy("source_ip", "destination_ip").agg(
        F.sum("count").alias("count"), F.min_by("family", F.struct(-F.col("count"), "family")).alias("top_family"))
    return g.orderBy(F.col("count").desc(), "source_ip", "destination_ip").limit(k)


def conversations(df: DataFrame) -> DataFrame:
    """Both directions of an address pair in one row: (a, b) with a ≤ b, rows a→b and rows b→a."""
    p = pair_counts(df)
    ahead = F.col("source_ip") <= F.col("destination_ip")
    return p.groupBy(F.least("source_ip", "destination_ip").alias("a"), F.greatest("source_ip", "destination_ip").alias("b")).agg(
        F.sum(F.when(ahead, F.col("count")).otherwise(0)).alias("ab"), F.sum(F.when(ahead, 0).otherwise(F.col("count"))).alias("ba"))


def _roles(df: DataFrame, role: str, k: int) -> DataFrame:
    lead = F.col("ab") >= F.col("ba")
    attacker = F.when(lead, F.col("a")).otherwise(F.col("b"))
    victim = F.when(lead, F.col("b")).otherwise(F.col("a"))
    g = conversations(df).groupBy((attacker if role == "attacker" else victim).alias("ip"))
    return g.agg(F.sum(F.col("ab") + F.col("ba")).alias("count")).orderBy(F.col("count").desc(), "ip").limit(k)


def attackers(df: DataFrame, k: int = 5) -> DataFrame:
    """The side of a conversation with more rows is the attacker (at a draw the smaller address); both directions count."""
    return _roles(df, "attacker", k)


def victims(df: DataFrame, k: int = 5) -> DataFrame:
    return _roles(df, "victim", k)


def with_reverse(df: DataFrame) -> DataFrame:
    """Directed pairs with the count of the opposite direction, 0 if there is none. Both directions of a pair meet in one
    group, so no self-join is needed."""
    c = conversations(df)
    one = lambda s, d, n, r: F.struct(F.col(s).alias("source_ip"), F.col(d).alias("destination_ip"), F.col(n).alias("count"), F.col(r).alias("reverse_count"))
    both = F.when(F.col("a") == F.col("b"), F.array(one("a", "b", "ab", "ba"))).otherwise(
        F.array(one("a", "b", "ab", "ba"), one("b", "a", "ba", "ab")))
    return c.select(F.explode(both).alias("p")).select("p.*").filter("count > 0")


def top_ports(df: DataFrame, k: int = 10) -> DataFrame:
    g = _bad(df).filter("destination_port > 0").groupBy("destination_port").agg(F.count("*").alias("count"))
    return enrich.with_service(g.orderBy(F.col("count").desc(), "destination_port").limit(k))


def protocols(df: DataFrame) -> DataFrame:
    d = df.withColumn("protocol", F.upper("protocol"))
    return d.groupBy("protocol").agg(_n(d).alias("count"))


def hourly_families(df: DataFrame) -> DataFrame:
    """Non-Normal rows per hour and family."""
    d = df if "hour" in df.columns else df.withColumn("hour", TM.hour_of("flow_timestamp"))
    b = _bad(d).filter("hour is not null and family is not null and family <> ''")
    return b.groupBy("hour", "family").agg(_n(b).alias("count"))


def hourly(df: DataFrame) -> DataFrame:
    """Normal, malicious (suspicious rows not included) and suspicious per hour, with rows per family as a map."""
    d = df if "hour" in df.columns else df.withColumn("hour", TM.hour_of("flow_timestamp"))
    p = F.col("prediction")
    d = d.filter("hour is not null")
    # by hour and family first: both the counts and the (at most six) map entries come from the same groups
    by_family = d.groupBy("hour", "family").agg(
        _n(d, p == "Normal").alias("normal"), _n(d, ~p.isin("Normal", "Suspicious")).alias("malicious_only"),
        _n(d, p == "Suspicious").alias("suspicious"))
    bad = F.col("malicious_only") + F.col("suspicious")
    entry = F.when((bad > 0) & (F.coalesce("family", F.lit("")) != ""), F.struct("family", bad.alias("n")))
    return by_family.groupBy("hour").agg(
        F.sum("normal").alias("normal"), F.sum("malicious_only").alias("malicious_only"), F.sum("suspicious").alias("suspicious"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("families"),
    ).orderBy("hour")


def steps(hourly_df: DataFrame) -> DataFrame:
    """The hourly timeline as numbered steps (one row per hour, so the numbering is over a short table)."""
    w = Window.partitionBy().orderBy("hour")
    return hourly_df.select(
        F.row_number().over(w).alias("step"), "normal", (F.col("malicious_only") + F.col("suspicious")).alias("suspicious"))


def tactic_counts(df: DataFrame) -> DataFrame:
    """Rows per tactic. Equal tactic lists are counted together first, then unfolded."""
    g = _bad(df).filter("mitre is not null").groupBy(F.col("mitre.tactics").alias("t")).agg(F.count("*").alias("n"))
    e = g.select(F.explode("t").alias("t"), "n").filter("t.name is not null and t.name <> ''")
    return e.groupBy(F.col("t.name").alias("tactic")).agg(F.sum("n").alias("count")).orderBy(F.col("count").desc(), "tactic")


def technique_counts(df: DataFrame) -> DataFrame:
    """Rows per technique, listed under the first tactic of the row."""
    first = F.try_element_at(F.col("mitre.tactics"), F.lit(1))["name"]
    g = _bad(df).filter("mitre is not null").groupBy(F.col("mitre.techniques").alias("k"), F.coalesce(first, F.lit("")).alias("tactic")).agg(
        F.count("*").alias("n"))
    e = g.select(F.explode("k").alias("k"), "tactic", "n").filter("k.id is not null and k.id <> ''")
    return e.groupBy(F.col("k.id").alias("id"), F.col("k.name").alias("name"), F.col("k.url").alias("url"), "tactic").agg(
        F.sum("n").alias("count")).orderBy(F.col("count").desc(), "id", "tactic")


def kpis(df: DataFrame, as_of: Column) -> DataFrame:
    """Mean seconds to acknowledge, backlog, age of the oldest open row, acknowledged rows.

    A row set back to ``new`` counts as backlog, whatever its acknowledgement time.
    """
    acked = (F.col("ack_state") != "new") & F.col("ack_at").isNotNull()
    wait = F.when(acked, F.unix_micros("ack_at") - F.unix_micros("flow_timestamp"))
    age = F.when(F.col("ack_state") == "new", F.unix_micros(as_of) - F.unix_micros("flow_timestamp"))
    mean = F.try_divide(F.sum(wait).cast("double"), F.count(wait)) / 1_000_000.0
    return df.agg(
        mean.alias("mtta_seconds"), F.count_if(F.col("ack_state") == "new").alias("backlog"),
        F.coalesce(F.max(age) / F.lit(1_000_000.0), F.lit(0.0)).alias("oldest_unacked_seconds"), F.count_if(acked).alias("acked"),
    )


def prior_block(df: DataFrame, key: str, as_of: Column) -> DataFrame | None:
    """Counts of the window before: label, severity and verdict totals in one row."""
    d = predicates.prior_window(df, key, as_of)
    return None if d is None else window_block(d)


def window_block(d: DataFrame) -> DataFrame:
    bad, s = F.col("prediction") != "Normal", F.lower("severity")
    src = F.coalesce(F.nullif("source", F.lit("")), F.lit("benign"))
    return d.agg(
        F.count_if(~bad).alias("normal"), F.count_if(bad).alias("malicious_incl_suspicious"),
        *[F.count_if(bad & (s == v)).alias(v) for v in ("high", "medium", "low")],
        *[F.count_if(src == v).alias(v) for v in fixed.VERDICTS],
    )


def measures(block: DataFrame) -> DataFrame:
    """A one-row block as (measure, value) rows."""
    entries = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in block.columns])
    return block.select(F.explode(entries).alias("m")).select("m.*")


def trend(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Change of each measure against the window before: ``new`` from zero, ``≈`` below one percent, else signed percent."""
    c = current.withColumnRenamed("value", "current")
    p = prior.withColumnRenamed("value", "prior")
    j = c.join(p, "measure", "full_outer")
    delta = F.try_divide((F.col("current") - F.col("prior")) * F.lit(100.0), F.col("prior"))
    whole = F.round(delta.cast("decimal(24,6)"), 0).cast("long").cast("string")
    state = (
        F.when(F.col("prior").isNull() | F.col("current").isNull(), None)
        .when((F.col("prior") == 0) & (F.col("current") == 0), None)
        .when(F.col("prior") == 0, "new").when(F.abs(delta) < 1, "≈").when(delta > 0, "up").otherwise("down")
    )
    text = F.when(state == "up", F.concat(F.lit("+"), whole, F.lit("%"))).when(state == "down", F.concat(whole, F.lit("%"))).otherwise(state)
    return j.select("measure", "current", "prior", state.alias("state"), text.alias("label"))


def batch_counts(df: DataFrame) -> DataFrame:
    """Outcome of one analysed batch: three labels and four verdicts."""
    p = F.col("prediction")
    src = F.coalesce(F.nullif("source", F.lit("")), F.lit("benign"))
    return df.agg(
        F.count_if(p == "Normal").alias("normal"), F.count_if(~p.isin("Normal", "Suspicious") | p.isNull()).alias("malicious"),
        F.count_if(p == "Suspicious").alias("suspicious"), *[F.count_if(src == v).alias(v) for v in fixed.VERDICTS],
    )


def agreement(df: DataFrame) -> DataFrame:
    """Which of the two detectors fired: the four cells with their percentage (one decimal)."""
    g = verdict_breakdown(df)
    total = F.sum("count").over(Window.partitionBy())
    hit, bad = F.col("source").isin("confirmed", "signature_only"), F.col("source").isin("confirmed", "ml_only")
    return g.select(hit.alias("signature"), bad.alias("model"), "count", S.round_to(F.col("count") * F.lit(100.0) / total, 1).alias("percent"))


def detection_latency(df: DataFrame) -> DataFrame:
    """Seconds from the flow to its arrival in the store."""
    s = F.unix_seconds("first_seen_at") - F.unix_seconds("flow_timestamp")
    return df.agg(
        F.count(s).alias("rows"), F.try_divide(F.sum(s).cast("double"), F.count(s)).alias("mean_s"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_seconds(first_seen_at) - unix_seconds(flow_timestamp))").alias("median_s"),
        F.max(s).alias("max_s"),
    )


def label_counts(df: DataFrame, label: str = "Label", source: str = "__source") -> DataFrame:
    """Rows per label, per source and label, and in total, in one pass."""
    return df.rollup(label, source).agg(F.count("*").alias("rows"))


def timeline_summary(hourly_df: DataFrame) -> DataFrame:
    """Totals of the timeline and its peak malicious hour (the first of equal ones)."""
    peak = F.max_by(F.struct("hour", "malicious_only"), F.struct("malicious_only", -F.unix_seconds("hour")))
    return hourly_df.agg(
        F.sum("normal").alias("normal"), F.sum("malicious_only").alias("malicious_only"), F.sum("suspicious").alias("suspicious"),
        peak.alias("p"),
    ).select(
        "normal", "malicious_only", "suspicious",
        F.when(F.col("p.malicious_only") > 0, F.col("p.hour")).alias("peak_hour"), F.col("p.malicious_only").alias("peak"))


def anomalies(hourly_df: DataFrame, lookback: int = fixed.ANOMALY_LOOKBACK, z: float = fixed.ANOMALY_Z, value: str = "malicious_only") -> DataFrame:
    """Hours whose value lies ``z`` standard deviations above the ``lookback`` hours listed before them.

    The input has one row per hour, so the whole-table window runs over a short table. Sums of whole numbers keep mean and
    deviation exact.
    """
    w = Window.partitionBy().orderBy("hour").rowsBetween(-lookback, -1)
    x = F.col(value)
    s, q, n = F.sum(x).over(w), F.sum(x * x).over(w), F.count(x).over(w)
    d = hourly_df.select("hour", x.alias("value"), s.alias("s"), q.alias("q"), n.alias("n")).filter((F.col("n") == lookback) & (F.col("n") >= 3))
    sd = F.sqrt((F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double") / (F.col("n") * F.col("n")))
    d = d.withColumn("sd", sd).filter("sd > 0")
    score = (F.col("value") - F.col("s").cast("double") / F.col("n")) / F.col("sd")
    return d.withColumn("z", score).filter(F.col("z") >= z).select("hour", "value", "z")


def heatmap(hour_family: DataFrame) -> DataFrame:
    """Intensity of each hour and family on a log scale against the largest cell; families ranked by their total."""
    peak = F.max("count").over(Window.partitionBy())
    share = F.log10(F.col("count") + F.lit(1.0)) / F.log10(peak + F.lit(1.0))
    totals = hour_family.groupBy("family").agg(F.sum("count").alias("family_total"))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.col("family_total").desc(), "family"))
    return hour_family.select("hour", "family", "count", S.round_to(share, 6).alias("intensity")).join(
        totals.select("family", "family_total", rank.alias("family_rank")), "family")


def live_topk(df: DataFrame) -> DataFrame:
    """Live overview in one table (section, key, count): verdict mix, six families, five sources, five leaves.

    One pass folds by the four columns' own groups; only the short per-section counts are ranked.
    """
    leaf = F.coalesce(F.nullif("subtype", F.lit("")), F.col("attack_type"))
    entry = lambda name, key: F.struct(F.lit(name).alias("section"), key.alias("key"))
    sections = F.array(
        entry("verdict", F.col("source")), entry("family", F.col("family")), entry("source", F.col("source_ip")), entry("leaf", leaf))
    long = df.select(F.explode(sections).alias("e")).select("e.*").filter("key is not null and key <> ''")
    g = long.groupBy("section", "key").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("section").orderBy(F.col("count").desc(), "key"))
    size = F.when(F.col("section") == "family", 6).when(F.col("section") == "verdict", 4).otherwise(5)
    return g.withColumn("rank", rank).filter(F.col("rank") <= 6).filter(F.col("rank") <= size)


#: Wide columns no section of the analytics page reads.
WIDE_COLUMNS = ("ml_features", "stage2_probs", "stage3_probs", "ack_note")


def analytics(df: DataFrame, key: str, as_of: Column) -> dict[str, DataFrame]:
    """Every section of the analytics page for one time range.

    ``df`` is read three times at most: for the rows in range, whose columns the sections need are written to the shared folder, for the range before, and for the store's statistics. The
    written rows are folded once (``roll_up``), and all count sections read that short table, which is written as well; Spark's cleaner removes both when nothing refers to them.
    """
    key = key if key in fixed.RANGE_SECONDS else "all"
    rows = cut_lineage(predicates.in_range(df, key, as_of).drop(*WIDE_COLUMNS))
    base = cut_lineage(roll_up(rows))
    by_hour = hourly(base)
    prior = prior_block(df, key, as_of)
    out = {
        "headline": headline(base), "severity": severity_counts(base), "verdicts": verdict_breakdown(base),
        "families": family_breakdown(base), "leaves": leaf_breakdown(base), "severity_by_family": severity_by_family(base),
        "protocols": protocols(base), "hourly": by_hour, "steps": steps(by_hour), "anomalies": anomalies(by_hour),
        "heatmap": heatmap(hourly_families(base)), "timeline": timeline_summary(by_hour),
        "pairs": pairs(rows), "attackers": attackers(rows), "victims": victims(rows), "ports": top_ports(rows),
        "tactics": tactic_counts(rows), "techniques": technique_counts(rows), "kpis": kpis(rows, as_of),
        "store": triage.store_stats(df),
    }
    if prior is not None:
        out["prior"] = prior
        out["trend"] = trend(measures(window_block(rows)), measures(prior))
    return out
