"""Document fingerprints sensitive to edit distance: order min-hash (operator 10). Column expressions only.

A text is a sequence of tokens: runs of ``[^\\x20\\x09-\\x0D]``, cut every ``CHUNK`` characters, so that a text without spaces has a sequence as well. Its k-mers
(``K`` tokens; all tokens of a shorter text) are numbered by occurrence, so that a repeated one counts as often as it occurs. Each numbered k-mer gets a hash; the leading
bits choose one of ``BINS`` bins, and each bin keeps its two smallest. The two are put into the order they have in the text, and the hash of that ordered pair is the
bin's entry: it stays only if both k-mers stay and keep their order. One hash per k-mer serves all bins (one permutation), instead of one per entry.

The fingerprint is the string of all entries, 8 hexadecimal digits each: 6 bits of bin, 26 of the pair. The likeness of two fingerprints is the number of equal
entries by the number of bins filled in either; of two empty ones 1. Equal texts have equal fingerprints. A null text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
CHUNK = 12
BINS = 64
_BIN_BITS, _PAIR_BITS, _POSITION_BITS = 6, 26, 31
_LOW = (1 << _POSITION_BITS) - 1
_NONE = -(1 << 63)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]{1,%d})" % CHUNK), F.lit(1))


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _placed(value: Column, position: Column) -> Column:
    """33 bits of a hash and a position in one number; sorting sorts by hash, then position."""
    return value.bitwiseAND(F.lit(~_LOW)).bitwiseOR(position.cast("long").bitwiseAND(F.lit(_LOW)))


def _bin(value: Column) -> Column:
    return F.shiftrightunsigned(value, 64 - _BIN_BITS)


def numbered(words: Column) -> Column:
    """Sorted hashes, with positions, of the occurrence-numbered k-mers of an array of tokens."""
    n = F.greatest(F.size(words) - (K - 1), F.least(F.size(words), F.lit(1)))
    kmers = F.sort_array(F.transform(_upto(n), lambda i: _placed(F.xxhash64(*[F.get(words, i + j) for j in range(K)]), i)))

    def number(s: Column) -> Column:
        kind = lambda j: F.shiftright(F.get(s, j), _POSITION_BITS)
        firsts = F.filter(_upto(F.size(s)), lambda j: (j == 0) | (kind(j) != kind(j - 1)))

        def per_kind(f: Column) -> Column:
            again = F.flatten(F.transform(f, lambda a, q: F.transform(F.sequence(a, F.coalesce(F.get(f, q + 1), F.size(s)) - 1), lambda j: _placed(F.xxhash64(kind(j), j - a), F.get(s, j)))))
            once = F.transform(s, lambda v: _placed(F.xxhash64(F.shiftright(v, _POSITION_BITS), F.lit(0)), v))
            return F.sort_array(F.when(F.size(f) == F.size(s), once).otherwise(again))

        return let(firsts, per_kind)

    return let(kmers, number)


def entries(text: Column) -> Column:
    """The fingerprint as an array of numbers: bin and pair."""

    def least_two(o: Column) -> Column:
        return F.filter(o, lambda v, j: (j < 2) | (_bin(F.get(o, j - 2)) != _bin(v)))

    def pairs(kept: Column) -> Column:
        def entry(v: Column, j: Column) -> Column:
            after = F.get(kept, j + 1)
            value = lambda x: F.shiftright(x, _POSITION_BITS)
            pair = (F.when(after.isNull() | (_bin(after) != _bin(v)), F.xxhash64(value(v)))
                    .when(v.bitwiseAND(F.lit(_LOW)) < after.bitwiseAND(F.lit(_LOW)), F.xxhash64(value(v), value(after))).otherwise(F.xxhash64(value(after), value(v))))
            first = (j == 0) | (_bin(F.get(kept, j - 1)) != _bin(v))
            return F.when(first, F.shiftleft(_bin(v), _PAIR_BITS).bitwiseOR(pair.bitwiseAND(F.lit((1 << _PAIR_BITS) - 1))))

        return F.filter(F.transform(kept, entry), lambda x: x.isNotNull())

    return let(tokens(text), lambda w: let(numbered(w), lambda o: let(least_two(o), pairs)))


def as_string(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, _PAIR_BITS))
    both = F.size(F.array_union(bins(a), bins(b)))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """``docs`` with ``columns`` of the row that follows in descending doc_id (after the last: the first).

    Rows go to buckets between doc_ids that divide them evenly; each of these dividing rows also stands at the end of the bucket above, as the
    follower of that bucket's last row. Rows of one doc_id are ordered by their text; a null doc_id is the smallest.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))
    cuts = docs.select(F.percentile_approx(key, [i / parts for i in range(1, parts + 1)], 10 * parts).alias("cuts"), F.max(key).alias("top")).first()
    tops = sorted({*(cuts["cuts"] or []), cuts["top"] if cuts["top"] is not None else 0})  # as many as there are buckets
    step = 64
    every, coarse = F.lit(tops), F.lit(tops[step - 1 :: step]) if len(tops) >= step else F.array().cast("array<long>")
    base = step * F.size(F.filter(coarse, lambda t: t < F.col("_key")))
    own = base + F.size(F.filter(F.slice(every, base + 1, step), lambda t: t < F.col("_key")))
    placed = docs.withColumn("_key", key).withColumn("_own", own)
    above = F.when(F.get(every, F.col("_own")) == F.col("_key"), F.when(F.col("_own") == len(tops) - 1, 0).otherwise(F.col("_own") + 1))
    spread = placed.withColumn("_bucket", F.explode(F.filter(F.array(F.struct(F.lit(0).alias("extra"), F.col("_own").alias("at")), F.struct(F.lit(1).alias("extra"), above.alias("at"))), lambda b: b["at"].isNotNull())))
    order = Window.partitionBy("_at").orderBy("_extra", F.desc("_key"), "text")
    spread = spread.withColumns({"_at": F.col("_bucket.at"), "_extra": F.col("_bucket.extra")}).drop("_bucket", "_own")
    return spread.withColumns({prefix + c: F.lead(c).over(order) for c in columns}).where("_extra = 0").drop("_at", "_extra", "_key")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, the text with its last half replaced by the next document's beginning (``edited``), the fingerprints of both, and the likeness of the
    fingerprint to the edited text's and to the next document's."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("entries", entries(F.col("text")))
    near = with_next(own, ["text", "entries"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = near.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.withColumn("edited_entries", entries(F.col("edited")))
    return both.select("doc_id", n.cast("long").alias("n_chars"), "edited", as_string(F.col("entries")).alias("fingerprint"), as_string(F.col("edited_entries")).alias("edited_fingerprint"),
                       likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"), likeness(F.col("entries"), F.col("next_entries")).alias("near_next"))
