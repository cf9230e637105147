"""Phrase collocations per language (operator 11), by an FM-index per shard over word ids.

1. The texts of one language in one partition are gathered to shards of ``SHARD_BYTES`` (a longer text alone): the sequence of word numbers, and the words. Words never cross the end of
   a piece, symbol 0.
2. A shard's index is two Burrows-Wheeler transforms of its sequence, of the words before each context and of the words behind it. Contexts are sorted to a depth of one word less than
   the longest phrase, which is all that intervals of such phrases need. The sequence is half as large as the index, so it is what is kept, and the index is made where it is used.
3. An interval of the index is a phrase, its size the number of occurrences. Extending it by a word on one side is a step of backward search in that side's transform; the interval in
   the other one follows (bidirectional search). All intervals of a level are extended together.
4. Words and pairs of all shards are enumerated first. Only a short hash and a count up to ``least`` of each is sent, to buckets of hashes, which answer each shard which of its hashes
   reach ``least`` together. That is a bound from above, so hashes that meet lose nothing. Phrases with a word more, where the extension to the left and the one to the right of phrases
   that are left meet, are asked for likewise, level by level.
5. What is left, and the longest phrases made of it, is sent with its words; the counts are summed across shards, and what is below ``least`` goes.
6. A phrase's cuts are joined to the counts of their parts. As the count never rises with more words, a longer phrase that contains it and is frequent enough exists exactly if one by a
   single word to the left or right does.

A shard is bounded in bytes, a bucket in entries, and a hot word or phrase is one row per shard. A null text has no words, a null language is ``und``. Repeated rows count
as often as they are there; other columns, doc_id included, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.llm.text import give_back, mix, stash

LONGEST = 4
LEAST = 30
TOP = 2000
SHARD_BYTES = 4 << 20
HELD_BYTES = 12 << 20
#: Bytes of text whose words and pairs make one bucket of hashes (about as many bytes again).
BUCKET_BYTES = 8 << 20
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.full(256, _WORD, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW32 = np.uint64((1 << 32) - 1)


# ---- index ------------------------------------------------------------------------------------------------------------


def numbered(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """The sequence of word numbers of some texts, from 1 by falling frequency, with a 0 before each piece and at the end; and the words."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    kind = _KIND[raw]
    inside = kind == _WORD
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(1, np.int32), pa.array([], pa.large_binary())
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    index = coded.indices.to_numpy()
    times = np.bincount(index, minlength=len(coded.dictionary))
    order = np.argsort(-times, kind="stable")
    number = np.empty(len(order), np.int32)
    number[order] = np.arange(1, len(order) + 1, dtype=np.int32)
    piece = np.cumsum(kind == _BREAK, dtype=np.int32)[start]
    first = np.flatnonzero(np.diff(piece, prepend=-1))
    return np.append(np.insert(number[index], first, 0), np.int32(0)), coded.dictionary.take(pa.array(order))


def transform(sequence: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each position, positions sorted by the ``depth`` symbols from there on (the sequence is a circle)."""
    rank, width = sequence.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        width += step
        rank = np.unique(key, return_inverse=True)[1].reshape(-1) if width < depth else key
    return sequence[np.argsort(rank, kind="stable") - 1]


class Phrases:
    """Phrases of one length: ``words`` (one row each), and per side the first row of the interval; ``size`` is the same on both."""

    def __init__(self, words: np.ndarray, size: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.words, self.size, self.left, self.right = words, size, left, right

    def __len__(self) -> int:
        return len(self.size)

    def where(self, keep: np.ndarray) -> Phrases:
        return Phrases(self.words[keep], self.size[keep], self.left[keep], self.right[keep])


class Index:
    """Both transforms of a shard: ``left`` holds the words before contexts sorted forwards, ``right`` those behind contexts sorted backwards."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.sides = {"left": left, "right": right}
        times = np.bincount(left)
        self.first = np.cumsum(times) - times
        self.times = times
        self._step: dict[str, np.ndarray] = {}

    @classmethod
    def of(cls, sequence: np.ndarray, longest: int = LONGEST) -> Index:
        depth = max(longest - 1, 1)
        return cls(transform(sequence, depth), transform(sequence[::-1], depth))

    def step(self, side: str) -> np.ndarray:
        """Row of each row's context with the symbol added: where its symbol begins plus its rank among equal symbols."""
        if side not in self._step:
            symbols = self.sides[side]
            self._step[side] = to = np.empty(len(symbols), np.int64)
            to[np.argsort(symbols, kind="stable")] = np.arange(len(symbols))
        return self._step[side]

    def words(self) -> Phrases:
        n = np.arange(1, len(self.times))
        return Phrases(n[:, None], self.times[1:], self.first[1:], self.first[1:])

    def extend(self, p: Phrases, side: str) -> Phrases:
        """All phrases with one word more on that side."""
        here, there = (p.left, p.right) if side == "left" else (p.right, p.left)
        offset = np.cumsum(p.size) - p.size
        parent = np.repeat(np.arange(len(p)), p.size)
        rows = np.arange(len(parent)) - np.repeat(offset - here, p.size)
        symbol = self.sides[side][rows].astype(np.int64)
        key = parent * len(self.times) + symbol
        order = np.argsort(key, kind="stable")
        key = key[order]
        group = np.flatnonzero(np.diff(key, prepend=-1))
        size = np.diff(np.append(group, len(key)))
        at = order[group]
        parent, symbol = parent[at], symbol[at]
        here, there = self.step(side)[rows[at]], there[parent] + group - offset[parent]
        new = [symbol[:, None], p.words[parent]]
        left, right = (here, there) if side == "left" else (there, here)
        return Phrases(np.concatenate(new if side == "left" else new[::-1], axis=1), size, left, right).where(symbol > 0)

    def longer(self, p: Phrases) -> Phrases:
        """Phrases with one word more whose parts without the first and without the last word are both in ``p``."""
        a, b = self.extend(p, "left"), self.extend(p, "right")
        return a.where(np.isin(a.left, b.left))


def _planes(symbols: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest ones first: the higher ones are mostly zero and compress well."""
    return np.ascontiguousarray(symbols.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int32)


def _hashes(lang: str, words: bytes) -> np.ndarray:
    """A 64-bit hash per word number (0: none) in its language."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
    return np.fromiter((0, *(xxhash.xxh64_intdigest(w, seed) for w in words.split(b" "))) if words else (0,), np.uint64)


def _phrase_hashes(p: Phrases, of_word: np.ndarray) -> np.ndarray:
    h = mix(of_word[p.words[:, 0]] + np.uint64(p.words.shape[1]))
    for k in range(1, p.words.shape[1]):
        h = mix(h + of_word[p.words[:, k]])
    return h


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


# ---- steps ------------------------------------------------------------------------------------------------------------


def _build(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list[bytes]] = {}  # copies: a text must not keep its whole batch
        bytes_of: dict[str, int] = {}

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal made
            sequence, words = numbered(held.pop(lang))
            del bytes_of[lang]
            made += 1
            out = pa.RecordBatch.from_pydict({"shard": pa.array([base + made], pa.int64()), "lang": [lang], "n_words": pa.array([int((sequence > 0).sum())], pa.int64()),
                                              "words": pa.array([b" ".join(words.to_pylist())], pa.binary()), "sequence": pa.array([_planes(sequence)], pa.binary())})
            give_back()
            return out

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(raw)
                bytes_of[lang] = bytes_of.get(lang, 0) + len(raw)
                if bytes_of[lang] >= shard_bytes:
                    yield flush(lang)
                elif sum(bytes_of.values()) >= HELD_BYTES:
                    yield flush(max(bytes_of, key=bytes_of.get))
        for lang in list(held):
            yield flush(lang)

    return run


class _Shard:
    """A shard's index and what it has been answered so far."""

    def __init__(self, row: dict, longest: int, buckets: int):
        sequence = _from_planes(row["sequence"])
        self.answers = row.get("answers")
        if self.answers:
            self.index = Index.of(sequence, longest)
        else:  # nothing is asked but extensions to the left
            left = transform(sequence, longest - 1)
            self.index = Index(left, left)
        self.of_word = _hashes(row["lang"], row["words"])
        self.buckets = np.uint64(buckets)
        if self.answers:
            self.known = np.concatenate([np.frombuffer(a["hashes"], "<u4").astype(np.uint64) + (np.uint64(a["bucket"]) << np.uint64(32)) for a in self.answers])

    def keys(self, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """The bucket and the sent half of each phrase's hash."""
        h = _phrase_hashes(p, self.of_word)
        return mix(h) % self.buckets, h & _LOW32

    def level(self, k: int) -> list[Phrases]:
        """Phrases of 1 to ``k`` words; those of fewer than ``k`` words that are excluded, or made of excluded ones, are left out."""
        found: list[Phrases] = []
        for length in range(1, k + 1):
            p = self.index.words() if length == 1 else self.index.longer(found[-1])
            if length < k:
                bucket, half = self.keys(p)
                p = p.where(np.isin((bucket << np.uint64(32)) + half, self.known))
            found.append(p)
        return found


def _ask(longest: int, buckets: int, least: int, k: int | None):
    """The hashes of each shard, with counts up to ``least``, by bucket: of all words and pairs (``k`` is None), or of the phrases of ``k`` words that are possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                shard = _Shard(row, longest, buckets)
                if k is None:
                    words = shard.index.words()
                    found = [words, shard.index.extend(words, "left")] if len(words) else [words]
                else:
                    found = shard.level(k)[-1:]
                bucket, half = (np.concatenate(c) for c in zip(*map(shard.keys, found)))
                n = np.concatenate([np.minimum(p.size, least) for p in found])
                order = np.lexsort((half, bucket))
                bucket, half, n = bucket[order].astype(np.int64), half[order].astype("<u4"), n[order].astype(np.uint8 if least < 256 else "<u4")
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                cut = list(zip(edge, np.append(edge[1:], len(half))))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.repeat(row["shard"], len(edge)).cast(pa.int64()), pa.array([half[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([n[a:b].tobytes() for a, b in cut], pa.binary())], names=["bucket", "shard", "hashes", "counts"])
                del shard, found
                give_back()

    return run


def _answer(least: int):
    def run(table: pa.Table) -> pa.Table:
        raw = table["hashes"].to_pylist()
        h = np.frombuffer(b"".join(raw), "<u4")
        n = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint8 if least < 256 else "<u4").astype(np.int64)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.diff(h[order].astype(np.int64), prepend=-1))
        enough = np.empty(len(h), bool)
        if len(h):
            enough[order] = np.repeat(np.add.reduceat(n[order], start) >= least, np.diff(np.append(start, len(h))))
        edge = np.cumsum([0, *(len(r) // 4 for r in raw)])
        return pa.table({"shard": table["shard"], "bucket": table["bucket"], "hashes": pa.array([h[a:b][enough[a:b]].tobytes() for a, b in zip(edge[:-1], edge[1:])], pa.binary())})

    return run


_PHRASES = pa.list_(pa.string())


def _spell(longest: int, buckets: int):
    """The phrases of each shard that may be frequent, with their words and counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _one_by_one(batch):
                words = pa.array([b"", *row["words"].split(b" ")], pa.binary()).cast(pa.string())
                shard = _Shard(row, longest, buckets)
                found = shard.level(longest)
                bucket = np.concatenate([shard.keys(p)[0] for p in found]).astype(np.int64)
                phrases = pa.concat_arrays([pc.binary_join_element_wise(*(words.take(pa.array(p.words[:, j])) for j in range(k)), " ") for k, p in enumerate(found, 1)])
                n = np.concatenate([p.size for p in found]).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket = bucket[order]
                edge = np.flatnonzero(np.diff(bucket, prepend=-1))
                cut = pa.array(np.append(edge, len(bucket)).astype(np.int32))
                at = pa.array(order)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge]), pa.repeat(row["lang"], len(edge)), pa.ListArray.from_arrays(cut, phrases.take(at)), pa.ListArray.from_arrays(cut, pa.array(n).take(at))], names=["bucket", "lang", "phrases", "counts"])
                del shard, words, found, phrases
                give_back()

    return run


def _sum(least: int):
    """Counts of each phrase of a bucket across shards."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        phrases, counts = (pa.concat_arrays([c for c in table[name].chunks]) if table.num_rows else pa.array([], t) for name, t in (("phrases", _PHRASES), ("counts", pa.list_(pa.int64()))))
        lang = table["lang"].take(pc.list_parent_indices(phrases))
        sums = pa.table({"lang": lang, "phrase": phrases.flatten(), "f": counts.flatten()}).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        return sums.filter(pc.greater_equal(sums["f_sum"], least)).select(["lang", "phrase", "f_sum"]).rename_columns(["lang", "phrase", "f"])

    return run


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of up to ``longest`` words (two at least) with at least ``least`` occurrences, and (lang, n): the words of each language."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text <> ''")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    shards = stash(texts.mapInArrow(_build(shard_bytes), "shard long, lang string, n_words long, words binary, sequence binary"), "shards")
    fields = ["shard", "lang", "words", "sequence"]
    answers, asked = None, shards.select(*fields)
    for k in (None, *range(3, longest)):
        sent = asked.mapInArrow(_ask(longest, buckets, least, k), "bucket long, shard long, hashes binary, counts binary")
        new = stash(sent.groupBy("bucket").applyInArrow(_answer(least), "shard long, bucket long, hashes binary").where(F.octet_length("hashes") > 0), "answers")
        answers = new if answers is None else answers.unionByName(new)
        asked = shards.join(answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "hashes")).alias("answers")), "shard").select(*fields, "answers")
    found = asked.mapInArrow(_spell(longest, buckets), "bucket long, lang string, phrases array<string>, counts array<long>")
    counts = found.groupBy("bucket").applyInArrow(_sum(least), "lang string, phrase string, f long")
    return stash(counts.withColumn("k", F.size(F.split("phrase", " "))), "phrases"), shards.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, inside_percent: int = 80, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words and more."""
    counts, totals = phrase_counts(docs, longest, least, **sizes)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    words = F.split("phrase", " ")
    cuts = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), words.alias("words"), "k").select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    part = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).withColumn("score", F.expr("(CAST(a AS DECIMAL(20,0)) * 2000000BD) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    best = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    longer = counts.where("k > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    left = best.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (big("longest") * 100 < big("a") * inside_percent))
    left = left.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
