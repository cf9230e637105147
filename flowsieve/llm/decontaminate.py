"""Benchmark passages in documents, edits included (operator 2), by the q-gram lemma and banded alignment.

Texts and items are compared by their letters and digits only, lower-cased, so spacing, punctuation and case do not hide a passage. An item of n characters
may differ by ``k = EDITS * n`` edits, less for short items (``budget``). An occurrence within the budget keeps at least ``n + 1 - Q * (k + 1)`` of the item's q-grams, and the
kept ones lie on at most ``k + 1`` neighbouring diagonals (position in the text minus position in the item). So:

1. All q-grams of a batch of texts are hashed at once and looked up in a bitmap, then in the sorted hashes of the items' q-grams.
2. Hits are counted, each q-gram of the item once, in diagonal bands of ``2 (k + 1)`` that overlap by half; a band with enough of them is a region.
3. Each region is aligned with the item in a band around its diagonals; a region within the budget is a leak.

A benchmark of at most ``SHARD_CHARS`` characters is broadcast and met by all documents in one pass. A larger one stays in Spark (``_far``): of ``n + 1 - Q`` q-grams an
occurrence may lose ``Q * k``, so it keeps one of any ``Q * k + 1``; each item is looked for by those of its q-grams that fewest texts have, found by an equi-join, and steps
2 and 3 decide on the pairs so found. Only a bitmap of fixed size (``FILTER_BITS``) of the items' q-grams is broadcast then. Both ways give the same rows. Items with
fewer than ``Q`` letters and digits are no evidence and never match. Null and empty texts have no leaks. Overlapping finds of one item in a document are one (the one with the
fewest edits). Equal items each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.text import fresh, mix, slices, stash, string_array

Q = 12
EDITS = 0.06
SHARD_CHARS = 1 << 20
FILTER_BITS = 27
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_table: np.ndarray | None = None


def budget(n: int, q: int = Q, edits: float = EDITS) -> int:
    """Edits an item of ``n`` characters may differ by: as many as leave at least one q-gram untouched for certain."""
    return max(0, min(int(edits * n), n // q - 1))


def folding() -> np.ndarray:
    """Per code point below 65536: 0 if it is neither letter nor digit, else its lower-case form."""
    global _table
    if _table is None:
        table = np.zeros(1 << 16, np.uint16)
        for c in range(1 << 16):
            if 0xD800 <= c < 0xE000:
                continue
            if chr(c).isalnum():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
        _table = table
    return _table


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The compared characters of a text, and the position of each in it."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) and points.max() >= 1 << 16:  # beyond the table: kept as they are, by their low bits
        low = (points & np.uint32(0xFFFF)).astype(np.uint16)
        values = np.where(points < 1 << 16, folding()[low], low | np.uint16(1))
    else:
        values = folding()[points]
    at = np.flatnonzero(values)
    return values[at], at


def gram_hashes(values: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the ``q`` (a multiple of 4) characters from each position on."""
    n = len(values) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(values, np.uint16)
    out = np.zeros(n, np.uint64)
    for j in range(0, q, 4):
        part = np.ndarray((n,), np.uint64, raw, offset=2 * j, strides=(2,))
        out = (out ^ (out >> np.uint64(29))) * _MULTIPLIERS[1] + part * _MULTIPLIERS[(j // 4) % 3]
    return out


class Items:
    """The q-gram index of some benchmark items."""

    def __init__(self, rows: list[tuple[int, str]], q: int = Q, edits: float = EDITS):
        self.q = q
        self.ids, self.texts = [], []
        hashes, owner, place = [], [], []
        for item_id, text in rows:
            values, _ = folded(text or "")
            if len(values) < q:
                continue
            grams = gram_hashes(values, q)
            hashes.append(grams)
            owner.append(np.full(len(grams), len(self.ids)))
            place.append(np.arange(len(grams)))
            self.ids.append(item_id)
            self.texts.append(values)
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.budget = np.array([budget(int(n), q, edits) for n in self.size], np.int64)
        self.least = self.size + 1 - q * (self.budget + 1)
        flat = mix(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.owner = np.concatenate(owner)[order] if owner else np.zeros(0, np.int64)
        self.place = np.concatenate(place)[order] if place else np.zeros(0, np.int64)
        self.bits = max(16, int(64 * max(1, len(flat))).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        if hashes:
            self.seen[np.concatenate(hashes) >> np.uint64(64 - self.bits)] = True

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``values``, item, position in the item) of all shared q-grams."""
        grams = gram_hashes(values, self.q)
        at = np.flatnonzero(self.seen[grams >> np.uint64(64 - self.bits)])
        full = mix(grams[at])
        low, high = np.searchsorted(self.hashes, full), np.searchsorted(self.hashes, full, side="right")
        some = high > low
        at, low, many = at[some], low[some], (high - low)[some]
        which = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
        return np.repeat(at, many), self.owner[which], self.place[which]

    def regions(self, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
        """(item, lowest diagonal of the band) of the bands with enough q-grams, from the hits of one text."""
        step = self.budget[item] + 1
        band = np.floor_divide(at - place, step)
        item, place, band = np.concatenate([item, item]), np.concatenate([place, place]), np.concatenate([band, band - 1])
        rows = np.unique(np.stack([item, band, place], axis=1), axis=0)
        bands, count = np.unique(rows[:, :2], axis=0, return_counts=True)
        good = bands[count >= self.least[bands[:, 0]]]
        return [(int(i), int(b) * int(self.budget[i] + 1)) for i, b in good]

    def leaks(self, values: np.ndarray, at: np.ndarray, item: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the occurrences within the budget in one text, from its hits."""
        found: list[tuple[int, int, int, int]] = []
        for i, low in self.regions(at, item, place):
            k = int(self.budget[i])
            best = align(self.texts[i], values, low - k, low + 2 * (k + 1) + k, k)
            if best is not None:
                found.append((i, *best))
        found.sort(key=lambda f: (f[0], f[3], f[1]))
        kept: list[tuple[int, int, int, int]] = []
        for f in found:
            if not any(f[0] == g[0] and f[1] < g[2] and g[1] < f[2] for g in kept):
                kept.append(f)
        return kept


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The occurrence of ``item`` in ``text`` with the fewest edits on the diagonals ``low`` to ``high``: (start, end, edits), None beyond ``k`` edits.

    Row i holds, per diagonal d, the edits of the first i characters of the item against text that ends before position i + d, and where it starts.
    """
    n, m = len(item), len(text)
    d = np.arange(low, high + 1)
    far = 1 << 20
    for exact in range(max(0, low), min(high, m - n) + 1):
        if text[exact] == item[0] and text[exact + n - 1] == item[-1] and np.array_equal(text[exact : exact + n], item):
            return exact, exact + n, 0
    cost = np.where((d >= 0) & (d <= m), 0, far)
    start = np.clip(d, 0, m)
    index = np.arange(len(d))
    padded = np.concatenate([text, np.zeros(1, text.dtype)])
    for i in range(1, n + 1):
        end = i + d
        inside = (end >= 1) & (end <= m)
        same = cost + (padded[np.where(inside, end - 1, m)] != item[i - 1])
        same[~inside] = far
        gone = np.append(cost[1:] + 1, far)  # a character of the item is not in the text
        gone[(end < 0) | (end > m)] = far
        take = gone < same
        now = np.where(take, gone, same)
        begin = np.where(take, np.append(start[1:], 0), start)
        slope = now - index  # characters of the text that are not in the item
        lowest = np.minimum.accumulate(slope)
        source = np.maximum.accumulate(np.where(slope == lowest, index, 0))
        better = lowest + index < now
        cost = np.where(better, lowest + index, now)
        start = np.where(better, begin[source], begin)
        cost[(end < 0) | (end > m)] = far
        if cost.min() > k:
            return None
    best = int(np.argmin(cost))
    return int(start[best]), int(n + d[best]), int(cost[best])


def _per_text(batch_texts: pa.Array, items: Items) -> Iterator[tuple[int, list[tuple[int, int, int, int]]]]:
    """(row, leaks) of the texts with a leak; positions are code points of the text."""
    for low, high in slices(batch_texts):
        texts = [t or "" for t in batch_texts.slice(low, high - low).to_pylist()]
        values, at = folded("\n".join(texts))
        edge = np.cumsum([0, *(len(t) + 1 for t in texts)])
        pos, item, place = items.hits(values)
        if not len(pos):
            continue
        first = np.searchsorted(at, edge)
        row = np.searchsorted(first, pos, side="right") - 1
        for r in np.unique(row):
            mine = row == r
            a, b = int(first[r]), int(first[r + 1])
            found = items.leaks(values[a:b], pos[mine] - a, item[mine], place[mine])
            if found:
                where = at[a:b] - int(edge[r])
                yield low + int(r), [(i, int(where[s]), int(where[e - 1]) + 1, c) for i, s, e, c in found]


def _worth(benchmark: DataFrame, q: int) -> DataFrame:
    return benchmark.where(F.length("text") >= q)


def _small(benchmark: DataFrame, q: int):
    """The items as one broadcast, or None if they have more than SHARD_CHARS characters."""
    items = _worth(benchmark, q).select("item_id", "text")
    if (items.agg(F.sum(F.length("text"))).first()[0] or 0) > SHARD_CHARS:
        return None
    rows = [(r["item_id"], r["text"]) for r in items.orderBy("item_id", "text").collect()]
    return benchmark.sparkSession.sparkContext.broadcast(rows)


def _known(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def _places(batches: Iterator[pa.RecordBatch], q: int, edits: float) -> Iterator[pa.RecordBatch]:
    """All q-grams of the items, and how many of them are enough to look for."""
    for batch in batches:
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            values, _ = folded(text)
            grams = gram_hashes(values, q)
            if len(grams):
                most = q * budget(len(values), q, edits) + 1
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(grams), pa.binary()), pa.array(np.arange(len(grams), dtype=np.int32)), pa.array(grams.view(np.int64)),
                                                  pa.array(np.full(len(grams), most, np.int32))], names=["item", "place", "gram", "most"])


def _passing(batches: Iterator[pa.RecordBatch], q: int, bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The q-grams of the texts that the bitmap of the items' q-grams lets through."""
    shift = np.uint64(64 - 6 - (len(bitmap).bit_length() - 1))
    for batch in batches:
        column = string_array(batch.column("text"))
        for low, high in slices(column):
            keys, found = [], []
            for key, text in zip(batch.column("key").slice(low, high - low).to_pylist(), column.slice(low, high - low).to_pylist()):
                grams = np.unique(gram_hashes(folded(text)[0], q))
                cell = grams >> shift
                grams = grams[(bitmap[cell >> np.uint64(6)] >> (cell & np.uint64(63))) & np.uint64(1) == 1]
                keys += [key] * len(grams)
                found.append(grams)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.concatenate(found).view(np.int64))], names=["key", "gram"])


def _decided(batches: Iterator[pa.RecordBatch], q: int, edits: float) -> Iterator[pa.RecordBatch]:
    """The occurrences of an item in a text, for pairs of both."""
    one = lru_cache(256)(lambda text: Items([(0, text)], q, edits))
    for batch in batches:
        rows, found, last, cut = [], [], None, None
        for r, (key, text, item_text) in enumerate(zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("item_text").to_pylist())):
            if key != last:
                last, cut = key, folded(text)
            values, at = cut
            for _, start, end, edited in one(item_text).leaks(values, *one(item_text).hits(values)):
                rows.append(r)
                found.append((int(at[start]), int(at[end - 1]) + 1, edited))
        column = lambda j: pa.array([f[j] for f in found], pa.int64())
        take = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("key").take(take), batch.column("item").take(take), column(0), column(1), column(2)], names=["key", "item", "start", "end", "edits"])


def _far(docs: DataFrame, benchmark: DataFrame, q: int, edits: float) -> DataFrame:
    """key and item (digests of the texts), start, end, edits of all occurrences, for a benchmark of any size; equal texts are looked at once."""
    items = _worth(benchmark, q).select(_known().alias("item"), "text").dropDuplicates(["item"])
    grams = stash(items.mapInArrow(lambda b: _places(b, q, edits), "item binary, place int, gram long, most int"), "item-grams")
    cell = F.shiftrightunsigned("gram", 64 - FILTER_BITS)
    words = grams.select(F.shiftright(cell, 6).alias("word"), cell.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow()
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    bitmap[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    shipped = docs.sparkSession.sparkContext.broadcast(bitmap)
    texts = docs.where(F.length("text") >= q).select(_known().alias("key"), "text")
    seen = stash(texts.mapInArrow(lambda b: _passing(b, q, shipped.value), "key binary, gram long").distinct(), "text-grams")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("texts", F.lit(0)), "gram", "place"))
    common = seen.groupBy("gram").agg(F.count("*").alias("texts"))
    sought = grams.join(common, "gram", "left").withColumn("rank", rank).where("rank <= most AND texts IS NOT NULL").select("item", "gram").distinct()
    pairs = stash(sought.join(seen, "gram").select("key", "item").distinct(), "text-items")
    held = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    near = pairs.join(items.withColumnRenamed("text", "item_text"), "item").join(held, "key").select("key", "item", "text", "item_text")
    return near.mapInArrow(lambda b: _decided(b, q, edits), "key binary, item binary, start long, end long, edits long")


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """doc_id, item_id, start, end (code points of the text), edits: a row per item and place of a document that holds it."""
    shard = _small(benchmark, q)
    if shard is None:
        found = _far(docs, benchmark, q, edits)
        named = found.join(_worth(benchmark, q).select(_known().alias("item"), F.col("item_id").cast("long").alias("item_id")), "item")
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _known().alias("key")).join(named, "key").select("doc_id", "item_id", "start", "end", "edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shard.value, q, edits)
        for batch in batches:
            rows, found = [], []
            for r, spans in _per_text(string_array(batch.column("text")), items):
                rows += [r] * len(spans)
                found += spans
            column = lambda j: pa.array([f[j] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array([items.ids[f[0]] for f in found], pa.int64()), column(1), column(2), column(3)],
                                             names=["doc_id", "item_id", "start", "end", "edits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, edits long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs`` whose text holds no item."""
    shard = _small(benchmark, q)
    if shard is None:
        key = fresh(docs, "_key")
        held = _far(docs.select("text"), benchmark, q, edits).select(F.col("key").alias(key)).distinct()
        return docs.withColumn(key, _known()).join(held, key, "left_anti").select(*docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shard.value, q, edits)
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for r, _ in _per_text(string_array(batch.column("text")), items):
                clean[r] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
