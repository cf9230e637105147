"""Order-dependent work without one big task.

A window over a whole key (or over the whole table) lands in a single task. The helpers here cut each key into buckets
along its order, work inside the buckets in parallel, and carry one small summary row per bucket across. Results are
exact and do not depend on how the buckets are cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_MS = 3_600_000


def previous_by_time(
    df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], tie: Sequence[str] = (), width: int = HOUR_MS,
    hot_width: int | None = 1000, support: float = 0.05,
) -> DataFrame:
    """``prev_<value>`` of the row before, per key in the order (ts, tie).

    Rows are partitioned by key and time bucket. The first row of a bucket takes its predecessor from the tails of the
    earlier buckets, one row per key and bucket. Keys with more than ``support`` of all rows are cut finer, into buckets of
    ``hot_width``.
    """
    cut = df.withColumn("_h", F.xxhash64(*keys))
    hot = hot_values(cut, "_h", support) if hot_width else []
    size = F.when(F.col("_h").isin(hot), hot_width).otherwise(width) if hot else F.lit(width)
    cut = cut.withColumn("_bucket", F.floor(F.col(ts) / size) * size).drop("_h")
    at = [*keys, "_bucket"]
    inner = cut.withColumn("_lag", F.lag(F.struct(*values)).over(Window.partitionBy(*at).orderBy(ts, *tie)))
    tails = cut.groupBy(*at).agg(F.max_by(F.struct(*values), F.struct(ts, *tie)).alias("_tail"))
    carry = tails.select(*at, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"))
    joined = inner.join(carry, at, "left").withColumn("_prev", F.coalesce("_lag", "_carry"))
    return joined.select(*df.columns, *[F.col("_prev")[v].alias(f"prev_{v}") for v in values])


def previous_overall(df: DataFrame, ts: str, tie: str, width: int = 60_000) -> DataFrame:
    """``prev_<ts>`` of the row before in the order (ts, tie) of the whole table, null for the first row.

    Only the distinct times are put in order. Of the rows of one time the first by ``tie`` has the time before as its
    predecessor, the others have the same time.
    """
    times = df.groupBy(ts).agg(F.min(tie).alias("_first")).withColumn("_bucket", F.floor(F.col(ts) / width)).withColumn("_all", F.lit(0))
    inner = times.withColumn("_lag", F.lag(ts).over(Window.partitionBy("_bucket").orderBy(ts)))
    tails = times.groupBy("_all", "_bucket").agg(F.max(ts).alias("_tail"))
    carry = tails.select("_bucket", F.lag("_tail").over(Window.partitionBy("_all").orderBy("_bucket")).alias("_carry"))
    before = inner.join(carry, "_bucket", "left").select(ts, "_first", F.coalesce("_lag", "_carry").alias("_before"))
    prev = F.when(F.col(tie) == F.col("_first"), F.col("_before")).otherwise(F.col(ts))
    return df.join(before, ts).select(*df.columns, prev.alias(f"prev_{ts}"))


def trailing_counts(df: DataFrame, ts: str, span_ms: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per key in ``[t - span, t]`` for every time ``t`` that has rows, as (keys, ts, at_once, in_window).

    Counts per time first, then windows inside buckets as long as the span, each with a copy of the bucket before: a
    window never holds more than two spans of distinct times, however many rows a key has.
    """
    per = df.groupBy(*keys, ts).agg(F.count("*").alias("at_once"))
    own = F.floor(F.col(ts) / span_ms)
    both = per.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = Window.partitionBy(*keys, "_bucket").orderBy(ts).rangeBetween(-span_ms, 0)
    return both.withColumn("in_window", F.sum("at_once").over(w)).filter("_own = _bucket").drop("_own", "_bucket")


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` in which null equals null; the keys of the left side stay."""
    renamed = right.withColumnsRenamed({k: f"_same_{i}" for i, k in enumerate(keys)})
    condition = [left[k].eqNullSafe(renamed[f"_same_{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, condition, how).drop(*[f"_same_{i}" for i in range(len(keys))])


def value_buckets(df: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Adds ``_bucket``: the range of ``column`` a row falls into, ascending, cut so that ranges hold similar numbers of
    rows, as many as there are shuffle partitions; null for null. The cut points are approximate; anything computed per bucket and carried across is
    still exact."""
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts)
    splits = [float("-inf"), *sorted(set(points)), float("inf")]
    if len(splits) < 3:
        return df.withColumn("_bucket", F.lit(0))
    cut = Bucketizer(splits=splits, inputCol=column, outputCol="_bucket", handleInvalid="keep").transform(df)
    return cut.withColumn("_bucket", F.when(F.col(column).isNotNull(), F.col("_bucket").cast("int")))


def running_totals(
    df: DataFrame, order: str, sums: dict[str, str], keys: Sequence[str] = (), descending: bool = False, parts: int | None = None
) -> DataFrame:
    """Running sums along ``order``, which must be unique per key; ``sums`` maps output names to input columns. Rows without a value of ``order`` stand first,
    with ``descending`` last."""
    keys = list(keys) or ["_all"]
    cut = value_buckets(df.withColumn("_all", F.lit(0)), order, parts)
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    per_bucket = cut.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(direction("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(direction(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        same(cut, offsets, [*keys, "_bucket"])
        .select(*df.columns, *[(F.col(f"_o_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])
    )


def first_n(
    df: DataFrame, bucket: Column, order: Sequence[Column], n: int | Column, keys: Sequence[str] = (), finer: Sequence[Column] = ()
) -> DataFrame:
    """The first ``n`` rows per key in the order (bucket, order), for any size of ``n``.

    Buckets that lie wholly inside are kept without sorting or shuffling their rows. Only the rows of the one bucket per
    key that the limit cuts through are ranked; with ``finer`` that bucket is first cut again, by each of its columns in turn. ``bucket`` and ``finer`` must rise
    with the order; rows without a bucket stand last. Null is a key like any other. ``n`` may be a column of the keys.
    """
    keys = list(keys) or ["_all"]
    cut = df.withColumn("_all", F.lit(0)).withColumn("_bucket", bucket)
    limit = n if isinstance(n, Column) else F.lit(n)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    plan = sizes.select(*keys, "_bucket", "_size", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    plan = plan.withColumn("_limit", limit).filter(F.col("_before") < F.col("_limit"))
    whole = (F.col("_before") + F.col("_size")) <= F.col("_limit")
    kept = same(cut, plan.filter(whole).select(*keys, "_bucket"), [*keys, "_bucket"], "left_semi")
    edge = same(cut, plan.filter(~whole).select(*keys, "_bucket", (F.col("_limit") - F.col("_before")).alias("_room")), [*keys, "_bucket"])
    if finer:
        room = f"_room_{len(finer)}"
        edge = first_n(edge.drop("_bucket").withColumnRenamed("_room", room), finer[0], order, F.col(room), [*keys, room], finer[1:])
    else:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        edge = edge.withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_room"))
    return kept.select(*df.columns).unionByName(edge.select(*df.columns))


def global_rank(
    df: DataFrame, bucket: Column, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank",
    bucket_order: Sequence[Column] | None = None,
) -> DataFrame:
    """Row number per key in the order (bucket, order): rank inside the bucket plus the sizes of the buckets before.

    ``bucket`` may be a struct, then ``bucket_order`` gives the direction of each of its fields (as ``_bucket.<field>``).
    """
    keys = list(keys) or ["_all"]
    along = list(bucket_order or ["_bucket"])
    cut = df.withColumn("_all", F.lit(0)).withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    return cut.join(offsets, [*keys, "_bucket"]).select(*df.columns, (F.col("_before") + inside).alias(name))


def ranked_slice(
    df: DataFrame, levels: Sequence[tuple[Column, Sequence[Column]]], order: Sequence[Column], low: int, high: int, name: str = "rank"
) -> DataFrame:
    """The rows with the numbers ``low`` to ``high`` in an order of the whole table, with their number.

    Each level is a bucket and the direction of buckets (on ``_bucket``); both must agree with ``order``. The sizes of the buckets tell which of them reach into
    the slice, and only their rows go to the next level and are ranked at last. At most ``high - low + 1`` buckets reach into it, which bounds what is broadcast.
    """
    cut = df.withColumn("_before", F.lit(0).cast("long"))
    for bucket, along in levels:
        cut = cut.withColumn("_bucket", bucket)
        sizes = cut.groupBy("_before", "_bucket").agg(F.count("*").alias("_size"))
        earlier = Window.partitionBy("_before").orderBy(*along).rowsBetween(Window.unboundedPreceding, -1)
        placed = sizes.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        placed = placed.filter((F.col("_start") < high) & (F.col("_start") + F.col("_size") >= low)).drop("_size")
        cut = same(cut, F.broadcast(placed), ["_before", "_bucket"]).drop("_before", "_bucket").withColumnRenamed("_start", "_before")
    inside = F.row_number().over(Window.partitionBy("_before").orderBy(*order))  # buckets begin at different numbers
    return cut.select(*df.columns, (F.col("_before") + inside).alias(name)).filter(F.col(name).between(low, high))


def seeded_hash(columns: Sequence[str], seed: int | str) -> Column:
    """A uniform hex text per row that other engines can compute as well."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def hash_bucket(h: str | Column, digits: int = 3) -> Column:
    """The leading hex digits: 16**digits buckets that rise with the hash."""
    return F.substring(F.col(h) if isinstance(h, str) else h, 1, digits)


def hot_values(df: DataFrame, column: str, support: float = 0.01) -> list:
    """Values of ``column`` that hold at least ``support`` of the rows; never more than 1/support of them.

    One pass finds a superset without a shuffle, a second one counts only those candidates.
    """
    if support > 1:
        return []
    thin = df.select(column)
    candidates = thin.stat.freqItems([column], support).first()[0]
    if not candidates:
        return []
    # one group per candidate and one, null, for all other rows: at most 1/support + 1 rows come back
    known = F.when(F.col(column).isin(candidates), F.col(column))
    counted = thin.groupBy(known.alias("v")).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in counted)
    return [r["v"] for r in counted if r["v"] is not None and r["n"] >= support * total]
