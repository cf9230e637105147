"""Removal of passages that an earlier document already has (operator 1), by suffix automata of reference shards and matching statistics.

Every window of ``WINDOW`` consecutive words is judged on the input: it goes if the same word sequence starts in a document with a smaller doc_id. The whole
corpus is reference and query at once, so an automaton of it cannot be broadcast; instead reference and queries are dealt out together, so that every pair of
equal windows meets in one shard:

1. Each window is known by the smallest hash among its ``GRAM``-word sequences (the leftmost of equals), its anchor. Equal windows have equal anchors, and
   neighbouring windows mostly share theirs. Anchors that one document alone has are dropped, after one shuffle of (anchor, doc_id).
2. A document's windows of one anchor are one short stretch of words. Stretches are shuffled by anchor; those of one anchor are a reference shard. An anchor with
   more than ``HEAVY`` stretches is split: each of its windows is a stretch of its own, shuffled by the hash of its words, so equal windows still meet.
3. The stretches of a shard are streamed in the order of doc_id. One whose words an earlier document has is removed there as a whole. Any other passes through the suffix automaton of
   the distinct stretches of earlier documents: the length of the longest match that ends at each word (matching statistics) gives the maximal spans of at least ``WINDOW`` words that
   an earlier document has. Then it is added to the automaton.
4. The spans meet their documents' texts, which are shuffled once.

A shard holds at most ``HEAVY`` different surroundings of a short word sequence, or equal windows (but for equal hashes), whatever the number of documents: rows are
streamed, only distinct stretches are kept. A row is known by a hash of doc_id and text together with its doc_id, so several rows may have one doc_id, or none; rows of one doc_id, and
rows without, do not remove each other's words. A null doc_id stands behind all others. A null text has no words. Repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.near_dedup import sequence_hash
from flowsieve.llm.text import LAST, Words, mix, slices, string_array

WINDOW = 13
#: Words of an anchor: short ones make long stretches, but are shared by texts that share no window.
GRAM = 5
HEAVY = 4096


class SuffixAutomaton:
    """All subsequences of some sequences of hashable items, in states whose number is linear in the items."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, transitions: dict, link: int) -> int:
        self.next.append(transitions)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, item, q: int) -> int:
        """The part of state ``q`` that is reached from ``p`` by its longest way, as a state of its own."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(item) == q:
            self.next[p][item] = clone
            p = self.link[p]
        return clone

    def add(self, items: list) -> None:
        last = 0
        for item in items:
            q = self.next[last].get(item)
            if q is not None:  # an earlier sequence has been here
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, item, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p >= 0 and item not in self.next[p]:
                self.next[p][item] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][item]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, item, q)
            last = new

    def matches(self, items: list) -> list[int]:
        """For each position the length of the longest match that ends there."""
        out, state, length = [], 0, 0
        for item in items:
            while state and item not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if item in self.next[state]:
                state, length = self.next[state][item], length + 1
            else:
                length = 0
            out.append(length)
        return out


def spans_of(lengths: list[int], least: int) -> list[tuple[int, int]]:
    """The union of all matches of at least ``least`` items, as (start, length)."""
    found: list[list[int]] = []
    for i, n in enumerate(lengths):
        if n >= least:
            if found and i - n + 1 <= found[-1][1]:
                found[-1] = [min(found[-1][0], i - n + 1), i + 1]
            else:
                found.append([i - n + 1, i + 1])
    return [(a, b - a) for a, b in found]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = pick(values[: len(values) - step], values[step:])
        have += step
    return values


def anchored(words: Words, hashes: np.ndarray, window: int, gram: int):
    """Per stretch of windows with one anchor: text number, first window, number of windows, anchor."""
    grams = sequence_hash(hashes, gram)
    wide = window - gram + 1
    if len(grams) < wide:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    least = _sliding(grams, wide, np.minimum)
    at = np.full(len(least), -1, np.int64)
    for j in range(wide):  # the leftmost of equals
        hit = (at < 0) & (grams[j : j + len(least)] == least)
        at[hit] = np.flatnonzero(hit) + j
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + window <= words.first[text + 1])
    anchor = at[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return text[start[first]], start[first], np.diff(np.append(first, len(start))), grams[anchor[first]]


def _stretches(texts: pa.Array, window: int, gram: int):
    for low, high in slices(texts):
        words = Words(texts.slice(low, high - low))
        yield low, words, anchored(words, words.hashes(), window, gram)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for low, _, (text, _, _, anchor) in _stretches(string_array(batch.column(1)), window, gram):
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(ids[low + text[first]]), pa.array(np.diff(np.append(first, len(text))))], names=["anchor", "key", "n"])

    return run


def _repeated(limit: int):
    """Of rows sorted by anchor, those whose anchor is there again, and whether it has more than ``limit`` stretches. At most ``limit`` rows of an anchor wait."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last anchor's rows that are not out yet: arrays of anchors, ids
        now, rows, stretches = None, 0, 0

        def out(heavy: bool):
            anchor, ids = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.repeat(heavy, len(ids))], names=["anchor", "key", "heavy"])

        for batch in batches:
            anchor, ids, n = (batch.column(k).to_numpy() for k in range(3))
            if not len(anchor):
                continue
            start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
            end = np.append(start[1:], len(anchor))
            total = np.add.reduceat(n, start)
            if anchor[0] != now:
                if rows > 1 and held:
                    yield out(stretches > limit)
                held, now, rows, stretches = [], anchor[0], 0, 0
            # the first anchor goes on from the batch before, the last one may go on in the next
            rows, stretches = rows + int(end[0]), stretches + int(total[0])
            held.append((anchor[: end[0]], ids[: end[0]]))
            if stretches > limit and rows > 1:
                yield out(True)
                held = []
            if len(start) == 1:
                continue
            if rows > 1 and held:
                yield out(False)
            many = end - start > 1
            many[0] = many[-1] = False
            keep = np.repeat(many, end - start)
            yield pa.RecordBatch.from_arrays([pa.array(anchor[keep]), pa.array(ids[keep]), pa.array(np.repeat(total > limit, end - start)[keep])], names=["anchor", "key", "heavy"])
            now, rows, stretches = anchor[-1], int(end[-1] - start[-1]), int(total[-1])
            held = [(anchor[start[-1] :], ids[start[-1] :])]
            if stretches > limit and rows > 1:
                yield out(True)
                held = []
        if rows > 1 and held:
            yield out(stretches > limit)

    return run


def _cut(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("key").to_numpy()
            lists, heavy_lists = string_array(batch.column("anchors")), string_array(batch.column("heavy"))
            for low, words, (text, start, many, anchor) in _stretches(string_array(batch.column("text")), window, gram):
                out: dict[str, list] = {"anchor": [], "words": [], "id": [], "key": [], "starts": []}
                edge = np.searchsorted(text, np.arange(len(words.first)))
                whole = None
                for i in range(len(words.first) - 1):
                    a, b = edge[i], edge[i + 1]
                    own = anchor[a:b].view(np.int64)
                    found: dict[tuple, list] = {}
                    base = int(words.first[i])
                    for j in (a + np.flatnonzero(np.isin(own, np.asarray(lists[low + i].values)))).tolist():
                        s = int(start[j])
                        found.setdefault((int(anchor[j].view(np.int64)), words.text(s, s + int(many[j]) + window - 1)), []).append(s - base)
                    if len(heavy_lists[low + i].values):
                        if whole is None:
                            whole = sequence_hash(words.hashes(), window)
                        for j in (a + np.flatnonzero(np.isin(own, np.asarray(heavy_lists[low + i].values)))).tolist():
                            first, n = int(start[j]), int(many[j])
                            parts = mix(whole[first : first + n] ^ mix(anchor[j : j + 1])).view(np.int64).tolist()
                            for s, part in enumerate(parts, first):
                                found.setdefault((part, words.text(s, s + window)), []).append(s - base)
                    for (shard, stretch), starts in found.items():
                        out["anchor"].append(shard)
                        out["words"].append(stretch)
                        out["starts"].append(np.array(starts, "<i4").tobytes())
                    out["id"] += [int(ids[low + i])] * len(found)
                    out["key"] += [int(keys[low + i])] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["words"], pa.binary()), pa.array(out["id"], pa.int64()), pa.array(out["key"], pa.int64()), pa.array(out["starts"], pa.binary())], names=list(out))

    return run


class _Shard:
    """The stretches of one shard in the order of doc_id. The automaton is made when a second different stretch comes."""

    def __init__(self, window: int):
        self.window = window
        self.holder: dict[bytes, int] = {}  # distinct stretches by their first document
        self.automaton: SuffixAutomaton | None = None
        self.before: list[list] = []  # earlier documents' stretches that are not in the automaton yet
        self.here: list[list] = []  # the present document's
        self.now: int | None = None
        self.seen_here: dict[bytes, list] = {}

    def spans(self, holder: int, words: bytes) -> list[tuple[int, int]]:
        """(start, length) of what earlier documents have of the stretch."""
        if holder != self.now:
            self.before += self.here
            self.here, self.seen_here, self.now = [], {}, holder
        first = self.holder.get(words)
        if first is not None and first != holder:
            return [(0, words.count(b" ") + 1)]
        if words in self.seen_here:
            return self.seen_here[words]
        items = words.split(b" ")
        parts: list[tuple[int, int]] = []
        if self.before or self.automaton:
            self.automaton = self.automaton or SuffixAutomaton()
            for earlier in self.before:
                self.automaton.add(earlier)
            self.before = []
            parts = spans_of(self.automaton.matches(items), self.window)
        if holder != LAST:  # nothing comes behind rows without doc_id
            self.holder[words] = holder
            self.here.append(items)
            self.seen_here[words] = parts
        return parts


def _judge(window: int):
    """Rows sorted by anchor and id → (key, id, spans): little-endian 32-bit pairs (start, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, _Shard(window)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for anchor, words, holder, key, starts in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if anchor != now:
                    now, shard = anchor, _Shard(window)
                parts = shard.spans(holder, words)
                if parts:
                    at = np.frombuffer(starts, "<i4")
                    pairs = np.array(parts, "<i4").reshape(1, -1, 2) + np.stack([at, np.zeros_like(at)], axis=1)[:, None, :]
                    for column, value in zip(out, (key, holder, pairs.astype("<i4").tobytes())):
                        column.append(value)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["key", "id", "spans"])

    return run


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, spans = batch.column("id").to_pylist(), batch.column("spans")
        texts = string_array(batch.column("text"))
        for low, high in slices(texts):
            words = Words(texts.slice(low, high - low))
            total, removed, kept = np.diff(words.first), np.zeros(high - low, np.int64), []
            for i in range(high - low):
                a, b = int(words.first[i]), int(words.first[i + 1])
                mine = [s["spans"] for s in spans[low + i].as_py() or () if s["id"] == ids[low + i]]
                if not mine:
                    kept.append(words.text(a, b))
                    continue
                pairs = np.frombuffer(b"".join(mine), "<i4").reshape(-1, 2)
                gone = np.zeros(b - a + 1, np.int64)
                np.add.at(gone, pairs[:, 0], 1)
                np.add.at(gone, pairs[:, 0] + pairs[:, 1], -1)
                stays = np.cumsum(gone)[: b - a] == 0
                removed[i] = b - a - int(stays.sum())
                edge = np.diff(stays.astype(np.int8), prepend=0, append=0)
                kept.append(b" ".join(words.text(a + s, a + e) for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())))
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(low, high - low), pa.array(total.astype(np.int64)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "kept"])


def dealt(docs: DataFrame, texts: DataFrame, window: int, gram: int, heavy: int) -> DataFrame:
    """The stretches (anchor, words, id, key, starts) by what they are shuffled by: their anchor, or for split anchors a hash of the window."""
    anchors = docs.select("key", "text").mapInArrow(_anchors(window, gram), "anchor long, key long, n long")
    shared = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(heavy), "anchor long, key long, heavy boolean")
    wanted = shared.groupBy("key").agg(F.collect_set(F.when(~F.col("heavy"), F.col("anchor"))).alias("anchors"), F.collect_set(F.when(F.col("heavy"), F.col("anchor"))).alias("heavy"))
    return texts.join(wanted, "key").select("id", "key", "text", "anchors", "heavy").mapInArrow(_cut(window, gram), "anchor long, words binary, id long, key long, starts binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), one row per row of ``docs``."""
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("key"), "text")
    texts = docs.repartition("key")  # one shuffle of the texts; both joins below read it, with the same columns
    cut = dealt(docs, texts, window, gram, heavy)
    spans = cut.repartition("anchor").sortWithinPartitions("anchor", "id").mapInArrow(_judge(window), "key long, id long, spans binary")
    kept = texts.join(spans.groupBy("key").agg(F.collect_list(F.struct("id", "spans")).alias("spans")), "key", "left").select("id", "key", "text", "spans").mapInArrow(_keep, "id long, n_words long, n_removed long, kept string")
    return kept.select(F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept")
