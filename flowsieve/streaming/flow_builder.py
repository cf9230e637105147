"""Packets to flows as a stream: the same rules as ``operators.packets.build_flows``, on event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators.correlate import PAIR, with_pair
from flowsieve.operators.packets import FLAG_BITS, closing, cut_in_order, opening_rank, orient
from flowsieve.streaming.held import Decide, HeldRows, Store

_SUMS = [f"{m}_{d}" for d in "fb" for m in ("n", "bytes", "sq", *FLAG_BITS)]
_LOWS = [f"{m}_{d}" for d in "fb" for m in ("min", "first")]
_HIGHS = [f"{m}_{d}" for d in "fb" for m in ("max", "last")]


def packet_rows(packets: DataFrame) -> DataFrame:
    """A packet stream in the form the job takes."""
    return with_pair(packets).select(F.lit("packet").alias("_side"), F.col("ts_ms").alias("_t"), *PAIR, "k_forward", "ts_ms", "length", "flags")


def _runs(rows: DataFrame) -> DataFrame:
    """Packets as runs of one packet each: counters, first and last time of each direction, ``ts_ms`` to ``until``."""
    f, size, flags = F.col("k_forward"), F.col("length").cast("long"), F.col("flags")
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    out = {"until": F.col("ts_ms"), "opens": opening_rank(f, size, flags), "closes": closing(flags)}
    for d, mine in (("f", f), ("b", ~f)):
        only = lambda value, other: F.when(mine, value).otherwise(other)  # noqa: B023,E731
        out |= {f"n_{d}": only(F.lit(1).cast("long"), zero), f"bytes_{d}": only(size, zero), f"sq_{d}": only(size * size, zero), f"min_{d}": only(size, none), f"max_{d}": only(size, none),
                f"first_{d}": only(F.col("ts_ms"), none), f"last_{d}": only(F.col("ts_ms"), none)}
        out |= {f"{flag}_{d}": (mine & (flags.bitwiseAND(F.lit(bit)) != 0)).cast("long") for flag, bit in FLAG_BITS.items()}
    return rows.filter("ts_ms is not null").select(*PAIR, "ts_ms", *[v.alias(k) for k, v in out.items()]).select(*PAIR, "ts_ms", "until", "opens", "closes", *_SUMS, *_LOWS, *_HIGHS)


def _folded(rows: DataFrame, start: str) -> DataFrame:
    """Runs put together by conversation and ``start``, which becomes their ``ts_ms``."""
    agg: list[Column] = [F.max("until").alias("until"), F.min_by("opens", F.struct("ts_ms", "opens")).alias("opens"), F.max_by("closes", F.struct("until", "closes")).alias("closes")]
    agg += [F.sum(c).alias(c) for c in _SUMS] + [F.min(c).alias(c) for c in _LOWS] + [F.max(c).alias(c) for c in _HIGHS]
    return rows.groupBy(*PAIR, F.col(start).alias("_start")).agg(*agg).withColumnRenamed("_start", "ts_ms")


def _decided(idle_ms: int, active_ms: int | None, close_on_flags: bool) -> Decide:
    """Runs the watermark has passed become flows. Of a conversation at most one flow stays open, as a single run; runs not passed yet wait as they are.

    A flow is done when a later one of its conversation has begun, when it was closed by a flag, or when the watermark has reached the end of its pause or its active limit.
    """

    def decide(rows: DataFrame, now: int | None) -> DataFrame:
        # one shuffle, by conversation; an instant may have come in several batches
        whole = _folded(rows.repartition(*PAIR), "ts_ms")
        if now is None:
            return whole.withColumn("_done", F.lit(False))
        limit = F.lit(now)
        waits = F.col("ts_ms") >= limit
        w = Window.partitionBy(*PAIR).orderBy("ts_ms")
        closed = F.lag("closes").over(w) if close_on_flags else F.lit(False)
        begins = waits | F.coalesce((F.col("ts_ms") - F.lag("until").over(w) >= idle_ms) | closed, F.lit(True))
        seg = whole.withColumn("_o", F.when(begins, F.col("ts_ms"))).withColumn("seg", F.max("_o").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_o")
        if active_ms is None:
            flows = seg.withColumn("flow_start", F.col("seg"))
        else:
            seg = seg.withColumn("_end", F.max("until").over(Window.partitionBy(*PAIR, "seg")))
            lasts = F.col("_end") - F.col("seg") >= active_ms
            flows = seg.filter(~lasts).drop("_end").withColumn("flow_start", F.col("seg")).unionByName(cut_in_order(seg.filter(lasts).drop("_end"), active_ms))
        flows = _folded(flows, "flow_start")
        over = (F.lead("ts_ms").over(w) < limit) | (F.col("until") + idle_ms <= limit)
        if close_on_flags:
            over = over | F.col("closes")
        if active_ms is not None:
            over = over | (F.col("ts_ms") + active_ms <= limit)
        return flows.withColumn("_done", F.coalesce(over, F.lit(False)) & ~waits)

    return decide


def flow_job(
    spark: SparkSession, folder: str, store: Store, idle_ms: int = fixed.IDLE_MS, active_ms: int | None = fixed.ACTIVE_LIVE_MS, close_on_flags: bool = True,
    lateness_ms: int = 10_000,
) -> HeldRows:
    """Flow records (without gap statistics) of a stream of ``packet_rows``. ``store`` gets those each batch completes, and late packets, which join no flow, as they are."""
    def put(decided: DataFrame, late: DataFrame | None, batch_id: int) -> None:
        ready = decided.withColumnsRenamed({"ts_ms": "flow_start", "until": "last"}).withColumns({
            "opens_forward": F.col("opens").bitwiseAND(F.lit(1)) == 0, **{f"dur_{d}": F.col(f"last_{d}") - F.col(f"first_{d}") for d in "fb"}})
        store(orient(ready, with_gaps=False), late, batch_id)

    return HeldRows(spark, folder, ("packet",), lateness_ms, _decided(idle_ms, active_ms, close_on_flags), put, _runs)


def session_flows(packets: DataFrame, idle_ms: int = fixed.IDLE_MS, lateness: str = "10 seconds") -> DataFrame:
    """Flows closed by pauses only, with the built-in session window: nothing but partial counts is kept per key.

    Session windows that just touch are merged, while a pause of exactly ``idle_ms`` ends a flow; hence the millisecond less.
    """
    idle = f"{idle_ms - 1} milliseconds"
    p = with_pair(packets).withColumn("event_time", F.timestamp_millis("ts_ms")).withWatermark("event_time", lateness)
    g = p.groupBy(*PAIR, F.session_window("event_time", idle)).agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"), F.max("ts_ms").alias("last_ms"))
    return g.select(*PAIR, F.unix_millis("session_window.start").alias("flow_start"), "last_ms", "packets", "bytes")
