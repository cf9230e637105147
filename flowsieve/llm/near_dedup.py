"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 7).

A document is the set of its distinct word shingles (its whole word sequence if that is shorter). Its sketch has ``BANDS * ROWS`` coordinates and is filled in
rounds: in each of the first t rounds every shingle is hashed to one bin and a value, and a bin keeps the smallest (round, value); a further t rounds put all
shingles into one bin each, so that every coordinate fills. A set of n shingles needs about ``t log t / n`` rounds instead of t hash functions. Coordinates
of two sets agree with the probability of their Jaccard similarity J, as concentrated as independent hash functions, so a pair at J = 0.85 shares none
of 24 bands of 4 with probability 2e-8.

Links are confirmed on the full sets, without forming the pairs of a group:

* Equal sets are one class, represented by the smallest doc_id.
* In each bucket every class is compared with the bucket's hub, the class that meets most others over all its buckets. That links copies to what they
  were copied from, and gives components.
* Only buckets with more than one component are looked at again. There a class of a smaller component is compared with those classes of other components
  that have one of its rarest shingles and a size that leaves room for a link (prefix filter). Copies changed too much for a link to their origin
  have their rarest shingles to themselves, or share them with few, whatever the number of copies.

Components come from alternating star contractions, as joins; nothing is collected. A null or empty text has no shingles and no links. ``doc_id`` identifies a
document and is below 2^62; repeated rows stay rows and share their component. Rows without doc_id are told apart by their texts, stand behind all others, and have a component_id only
if a document with a doc_id is in their component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.text import Words, mix, seeded, slices, stash, string_array

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 24, 4
SIZE_STEP = math.log(1.03)
_EMPTY = np.uint64((1 << 64) - 1)
_LOW, _HALF, _ODD = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(0x9E3779B97F4A7C15)


def sequence_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position on (positions near the end have fewer words and are left out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    value = words[:n].copy()
    for j in range(1, size):
        value = mix(value) * _ODD + words[j : j + n]
    return mix(value + np.uint64(size))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for low, high in slices(column):
        words = Words(column.slice(low, high - low), lower=True)
        hashes = words.hashes()
        shingles = sequence_hash(hashes, size)
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            yield np.unique(shingles[a : b - size + 1]) if b - a >= size else sequence_hash(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes."""
    out = np.full(t, _EMPTY)
    for i in range(t):
        x = seeded(items, i + 1)
        np.minimum.at(out, ((x >> _HALF) * np.uint64(t)) >> _HALF, (x & _LOW) | np.uint64(i << 32))
        if out.max() != _EMPTY:
            return out
    for i in np.flatnonzero(out == _EMPTY):
        out[i] = (seeded(items, t + 1 + int(i)) & _LOW).min() | np.uint64((t + int(i)) << 32)
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = values.reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64) * _ODD
    for j in range(rows):
        key = mix(key) + part[:, j]
    return mix(key).view(np.int64)


NO_ID = 1 << 62


def node(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row is known by: its doc_id, or a number from ``NO_ID`` on that follows from its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Per row: id, number of shingles, 128 bits that stand for the set, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, high, low, keys = [], [], [], []
            for items in shingle_sets(string_array(batch.column(1)), size):
                n.append(len(items))
                with np.errstate(over="ignore"):
                    high.append(seeded(items, 7001).sum(dtype=np.uint64))
                    low.append(seeded(items, 7002).sum(dtype=np.uint64))
                keys.append(band_keys(sketch(items, bands * rows), bands, rows) if len(items) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(high, np.uint64).view(np.int64)), pa.array(np.array(low, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "n", "high", "low", "keys"])

    return docs.select(node().alias("id"), "text").mapInArrow(run, "id long, n long, high long, low long, keys array<long>")


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            known: dict[int, np.ndarray] = {}
            a_ids = batch.column("a").to_pylist()
            a_text = string_array(batch.column("a_text"))
            for i, y in enumerate(shingle_sets(string_array(batch.column("b_text")), size)):
                if a_ids[i] not in known:
                    known = {a_ids[i]: next(shingle_sets(a_text.slice(i, 1), size))}
                x = known[a_ids[i]]
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) → (node, component) for all nodes with an edge; a component is known by its smallest node."""
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b") % (1 << 31)), F.lit(0))).first()
    before = mark(now)
    while before[0]:
        both = now.unionAll(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        now = stash(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _size_class(n):
    return F.floor(F.log(n.cast("double")) / SIZE_STEP)


def remaining_pairs(rows: DataFrame, texts: DataFrame, component: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that share a bucket with several components and may still be a link between two. ``rows``: key, id of the buckets with several classes.

    A link of sizes n, m has at least ``percent * (n + m) / (100 + percent)`` common shingles, so of any ``n`` minus that plus one shingles of the first set, the second has
    one. The rarest are taken: those a changed copy has to itself lead nowhere. The r-th rarest needs to be followed only to sets up to the size for which r
    are that many; sets of other sizes are kept out of the join by a class of sizes in its key.
    """
    placed = rows.join(component, rows["id"] == component["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = per.groupBy("key").agg(F.max(F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", (-F.col("main.col2")).alias("main"))
    beside_main = placed.join(mixed, "key").groupBy("id", "component").agg(F.max(F.col("component") != F.col("main")).alias("asking"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, items in enumerate(shingle_sets(string_array(batch.column("text")), size)):
                one = [pa.repeat(batch.column(c)[i], len(items)) for c in ("id", "component", "asking")]
                yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), *one, pa.repeat(len(items), len(items)).cast(pa.int64())], names=["item", "id", "component", "asking", "n"])

    shape = "item long, id long, component long, asking boolean, n long"
    items = stash(texts.join(beside_main, "id").select("id", "component", "asking", "text").mapInArrow(spread, shape), "items")
    common = items.groupBy("item").agg(F.count("*").alias("sets")).where("sets > 1")
    own = items.where("asking").join(common, "item", "left").withColumn("sets", F.coalesce("sets", F.lit(1)))
    ranked = own.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("sets", "item")))
    low = F.ceil(F.col("n") * percent / 100)
    top = F.floor((F.col("n") - F.col("r") + 1) * (100 + percent) / percent) - F.col("n")
    asking = ranked.where("sets > 1").select("item", F.col("id").alias("a"), F.col("component").alias("a_component"), low.alias("low"), top.alias("top")).where("top >= low")
    asking = asking.withColumn("class", F.explode(F.sequence(_size_class(F.col("low")), _size_class(F.col("top")))))
    asked = items.select("item", F.col("id").alias("b"), F.col("component").alias("b_component"), F.col("n").alias("b_n"), _size_class(F.col("n")).alias("class"))
    fits = (F.col("a_component") != F.col("b_component")) & F.col("b_n").between(F.col("low"), F.col("top"))
    return asking.join(asked, ["item", "class"]).where(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (whether that is the document itself), node (see ``node``), one row per row of ``docs``."""
    docs = docs.select("doc_id", "text")
    signed = stash(signatures(docs, size, bands, rows), "signatures")
    classes = signed.where("n > 0").groupBy("n", "high", "low").agg(F.min("id").alias("class"))
    member = signed.join(classes, ["n", "high", "low"], "left").withColumn("class", F.coalesce("class", "id"))
    single = member.where("id = class AND n > 0").select("id", "n", "keys").dropDuplicates(["id"])
    keyed = single.select("id", F.explode(F.array_distinct("keys")).alias("key"))
    filled = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = stash(keyed.join(filled, "key"), "buckets")
    degree = met.groupBy("id").agg(F.sum(F.col("n") - 1).alias("degree"))
    hub = met.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("hub")).select("key", (-F.col("hub.col2")).alias("hub"))
    stars = met.join(hub, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    texts = stash(docs.select(node().alias("id"), "text").join(degree.select("id"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    links = stash(verified(stars, texts, size, percent), "links")
    component = connected(links)
    rest = stash(remaining_pairs(met.select("key", "id"), texts, component, size, percent), "rest")
    if not rest.isEmpty():
        component = connected(links.unionAll(verified(rest, texts, size, percent)))
    found = member.select("id", "n", "class").join(component, F.col("class") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "class"))
    known = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return found.select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"), F.col("id").alias("node"))
