"""Language-model scores of whole texts by a probabilistic suffix tree (operator 4).

Tokens are words, A-Z lower-cased, then one end per text. Two models learn from the training documents:

* The base: add-one probabilities of tokens. Counts cover all training tokens. Words above a share of ``FREQUENT`` of all tokens (at most ``1 / FREQUENT`` of them)
  are broadcast.
* The suffix tree over the bytes of the tokens, with one space between words and an end. A context (the bytes before a byte) is a state if it occurs at least
  ``LEAST`` times and what follows it diverges from what follows its longest proper suffix that is a state: the log-likelihood gain is at least ``GAIN``.
  Contexts are up to ``DEPTH`` bytes long; their number grows with the input.
  A state's next-byte distribution is smoothed with its parent's in proportion to the number of different next bytes (Witten-Bell), the root's with the
  uniform one. A byte's probability is that of the longest suffix of its history that is a state.

Neither words nor states pass through the driver, but for frequent words and for states of up to ``SHORT`` bytes, of which a script has only so many. Training
counts are dealt to buckets, words by their hash and grams by the ``SHORT + 1`` bytes before the last, so a bucket has all longer contexts of its grams and builds their part of
the tree. Documents are handled in blocks: a block asks every bucket once for its distinct words and grams, and sums the answers over its texts. What up to ``TOGETHER`` asked
grams have in common is looked up once. The answers on grams are single-precision logarithms. Training words and grams are counted by block before they leave it; sums by text
follow one plain sort of numbers that carry their text.

A null text is empty and has the end token only. Without training documents the base counts are 0 and the tree is uniform. Repeated rows stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import Words, give_back, mix, slices, stash, string_array

DEPTH = 6
SHORT = 3
LEAST = 4
GAIN = 8.0
FREQUENT = 2e-5
END = 10
BLOCK_BYTES = 8 << 20
PART_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
SORTED_BYTES = 4 << 20
TOGETHER = 1 << 19
_BYTE = np.uint64(8)
#: What is dealt to buckets: training grams, training words, a block's grams, its words, its texts.
GRAMS, WORDS, ASKED_GRAMS, ASKED_WORDS, TEXTS = range(5)
DEALT = "bucket int, kind int, block long, key binary, rows binary, n long"


def held_out(modulus: int = 7, remainder: int = 2):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def symbols(words: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one behind the other, each as ``depth`` spaces, its words with one space between, and the end; and where each text's first word starts."""
    data, many = words.data, np.diff(words.first)
    taken = (data != 32) & (data - np.uint8(9) > 4)
    taken[np.delete(words.end, words.first[1:][many > 0] - 1)] = True  # the byte behind a word that another one follows
    size = np.append(0, np.cumsum(words.end - words.start))
    begin = np.append(0, np.cumsum(size[words.first[1:]] - size[words.first[:-1]] + np.maximum(many, 1) + depth))
    kept = data[taken]
    kept[kept - np.uint8(9) <= 4] = 32
    out = np.full(int(begin[-1]), 32, np.uint8)
    body = np.ones(len(out), bool)
    for j in range(depth):
        body[begin[:-1] + j] = False
    body[begin[1:] - 1] = False
    out[body] = kept
    out[begin[1:] - 1] = END
    return out, begin[:-1] + depth


def _histories(symbol: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Each ``depth`` neighbours as one number, the last one highest: two shorter such numbers put together."""
    if depth == 1:
        return symbol
    far = depth // 2
    behind = _histories(symbol, far, bits)
    out = (behind if depth == 2 * far else _histories(symbol, depth - far, bits))[far:] << np.uint64(far * bits)
    out |= behind[: len(out)]
    return out


def grams(stream: np.ndarray, starts: np.ndarray, depth: int, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Per byte of a text one number: the ``depth`` bytes before it, the nearest one highest, then itself; and where each text begins among them.

    A shorter context is then a leading part of a longer one, so sorted numbers look up the states of every depth in ascending order. With fewer ``bits``, the
    stream has codes of so many bits instead of bytes.
    """
    n = len(stream) - depth
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if bits == 8:  # eight bytes from each place on, read as one number
        value = np.ndarray(n, "<u8", np.append(stream, np.zeros(8, np.uint8)), strides=(1,)) & np.uint64((1 << 8 * depth) - 1)
        value <<= _BYTE
    else:
        value = _histories(stream.astype(np.uint64), depth, bits)[:-1] << np.uint64(bits)
    value |= stream[depth:]
    keep = np.ones(n, bool)
    for j in range(1, depth + 1):
        at = starts - depth - j
        keep[at[at >= 0]] = False
    return value[keep], starts - depth * np.arange(1, len(starts) + 1)


def _plain(value: np.ndarray, symbol: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Numbers of ``grams`` of codes → those of the bytes they stand for."""
    out = np.zeros(len(value), np.uint64)
    for j in range(depth + 1):
        code = (value >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)
        out |= symbol[code.astype(np.int64)] << np.uint64(8 * j)
    return out


@dataclass
class Tree:
    """Per depth: the sorted states, the weight of the parent for each, the sorted (state, byte) numbers and their probabilities."""

    root: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, value: np.ndarray, depth: int) -> np.ndarray:
        """Probabilities of the last bytes of ``value``, numbers of ``grams`` with that depth."""
        byte = value & np.uint64(255)
        p = self.root[byte.astype(np.int64)]
        for d, (states, weight, keys, known) in enumerate(self.levels, 1):
            if not len(states):
                continue
            # a history is sought once for all neighbours that share it, a byte only behind a state
            history = value >> np.uint64(8 * (depth - d + 1))
            start = _starts(history)
            is_state, i = _is_in(history[start], states)
            size = np.diff(np.append(start, len(value)))
            at = np.flatnonzero(np.repeat(is_state, size))
            key = (history[at] << _BYTE) | byte[at]
            is_known, j = _is_in(key, keys)
            p[at] = np.where(is_known, known[j], weight[np.repeat(i[is_state], size[is_state])] * p[at])
        return p


def _starts(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)


def _is_in(values: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``values`` is among some sorted numbers, and its place there."""
    if not len(among):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    i = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[i] == values, i


def _distinct(values: np.ndarray) -> np.ndarray:
    """As ``np.unique``, which hashes and takes several times as long."""
    values = np.sort(values)
    return values[_starts(values)]


def _summed(have: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts put together; parts that are sorted are merged."""
    key, n = np.concatenate([h[0] for h in have]), np.concatenate([h[1].astype(np.int64) for h in have])
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = _starts(key)
    return key[start], np.add.reduceat(n[order], start) if len(start) else n


def _counted(texts: Iterator[pa.Array], depth: int, most: int = 2 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted numbers of ``grams`` with their counts, whenever ``most`` of them have come together."""
    have: list[tuple[np.ndarray, np.ndarray]] = []
    fresh: list[np.ndarray] = []

    def counted() -> list[tuple[np.ndarray, np.ndarray]]:
        value = np.sort(np.concatenate(fresh))
        start = _starts(value)
        found = value[start], np.diff(np.append(start, len(value)))
        return [_summed([*have, found]) if have else found]

    for column in texts:
        for low, high in slices(column):
            fresh.append(grams(*symbols(Words(column.slice(low, high - low), lower=True), depth), depth)[0])
            if sum(map(len, fresh)) >= SORTED_BYTES:
                have, fresh = counted(), []
                if len(have[0][0]) > most:
                    yield have.pop()
    if have or fresh:
        yield counted()[0] if fresh else have[0]


def _count_batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["gram", "n"])


def _gram_counts(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _counted((string_array(b.column(0)) for b in batches), depth):
            yield _count_batch(key, n)

    return run


def _squeezed(values: np.ndarray) -> bytes:
    """Bytes, compressed, behind their number."""
    return len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(values), codec="zstd", asbytes=True)


def _whole(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(memoryview(raw)[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True), np.uint8)


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers, compressed byte by byte."""
    return _squeezed(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel())


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(_whole(raw).reshape(8, -1).T).view("<u8").ravel()


def _packed(values: np.ndarray) -> bytes:
    return _planes(np.diff(values, prepend=np.uint64(0)))


def _unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(raw), dtype=np.uint64)


def _dealt(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket that keeps the order within each; the buckets that occur, and where each starts and the last ends."""
    bucket = ((mix(values) >> np.uint64(1)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)  # short numbers are sorted by radix
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    start = _starts(bucket)
    return order, bucket[start].astype(np.int64), np.append(start, len(values))


def _above(value: np.ndarray, depth: int, short: int) -> np.ndarray:
    """What grams are dealt by: the nearest bytes of their context, one more than the shallow tree reaches."""
    return value >> np.uint64(8 * (depth - min(short + 1, depth) + 1))


def _rows(bucket, kind: int, block, key, rows, n) -> pa.RecordBatch:
    size = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * size, pa.int32()), pa.array([block] * size, pa.int64()), pa.array(key, pa.binary()), pa.array(rows, pa.binary()), pa.array(n, pa.int64())],
                                      names=["bucket", "kind", "block", "key", "rows", "n"])


def _dealt_grams(depth: int, short: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _counted((string_array(b.column(0)) for b in batches), depth):
            order, which, edge = _dealt(_above(key, depth, short), buckets)
            parts = [order[a:b] for a, b in zip(edge[:-1], edge[1:])]
            yield _rows(which, GRAMS, 0, [_packed(key[i]) for i in parts], [_planes(n[i]) for i in parts], [0] * len(parts))

    return run


def _leading(depth: int, short: int):
    """Dealt grams → counts of their last ``short`` bytes and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have: list[tuple[np.ndarray, np.ndarray]] = []
            for key, n in zip(batch.column(0), batch.column(1)):
                value = _unpacked(key.as_py())
                have.append((((value >> np.uint64(8 * (depth - short + 1))) << _BYTE) | (value & np.uint64(255)), _from_planes(n.as_py())))
                if len(have) >= 64:
                    have = [_summed(have)]
            if have:
                yield _count_batch(*_summed(have))

    return run


def _level(tree: Tree, key: np.ndarray, n: np.ndarray, depth: int, least: float, gain: float):
    """The next level of ``tree``, from the sorted distinct (context, byte) numbers of that depth and their counts."""
    history = key >> _BYTE
    start = _starts(history)
    history, kinds = history[start], np.diff(np.append(start, len(key)))
    inverse = np.repeat(np.arange(len(start)), kinds)
    size_of = np.bincount(inverse, weights=n, minlength=len(history))
    parent = tree.probability(key, depth)
    diverges = (size_of >= least) & (np.bincount(inverse, weights=n * np.log(n / size_of[inverse] / parent), minlength=len(history)) >= gain)
    known = (n + kinds[inverse] * parent) / (size_of + kinds)[inverse]
    keep = diverges[inverse]
    return history[diverges], (kinds / (size_of + kinds))[diverges], key[keep], known[keep]


def _fit(counts: DataFrame, depth: int, least: int, min_share: float, gain: float) -> Tree:
    """The tree of grams (gram, n; repeated) of ``depth`` bytes and the next. The states are fetched."""
    counted = stash(counts.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    total = counted.agg(F.sum("n")).first()[0] or 0
    root = np.ones(256)
    byte = F.col("gram").bitwiseAND(F.lit(255))
    for r in counted.groupBy(byte.alias("byte")).agg(F.sum("n").alias("n")).collect():
        root[r["byte"]] += r["n"]
    tree = Tree(root / root.sum(), [])
    least = max(min_share * total, least)
    for d in range(1, depth + 1):
        entry = counted.groupBy(F.shiftleft(F.shiftright("gram", 8 * (depth - d + 1)), 8).bitwiseOR(byte).alias("key")).agg(F.sum("n").alias("n"))
        size = entry.groupBy(F.shiftright("key", 8).alias("history")).agg(F.sum("n").alias("size")).where(F.col("size") >= least)
        rows = entry.join(size, F.shiftright("key", 8) == F.col("history")).select("key", "n").toArrow()
        key, n = rows["key"].to_numpy().astype(np.uint64), rows["n"].to_numpy().astype(np.float64)
        order = np.argsort(key)
        tree.levels.append(_level(tree, key[order], n[order], d, least, gain))
    return tree


def fit_tree(texts: DataFrame, depth: int = SHORT, min_share: float = 0.0, gain: float = GAIN) -> Tree:
    """The whole tree of a column ``text`` on one machine; ``min_share`` is a least share of all positions for a context."""
    return _fit(texts.select("text").mapInArrow(_gram_counts(depth), "gram long, n long"), depth, LEAST, min_share, gain)


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray, gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` one behind the other, each with ``gap`` spaces behind it, and where they begin and the last ends."""
    edge = np.concatenate([[0], np.cumsum(size + gap)])
    out = np.full(int(edge[-1]), 32, np.uint8)
    before = np.cumsum(size) - size
    each = np.arange(int(size.sum()))
    out[np.repeat(edge[:-1] - before, size) + each] = data[np.repeat(start - before, size) + each]
    return out, edge


class Kinds:
    """The distinct words of a block, part by part: hashes, counts and bytes."""

    def __init__(self):
        self.hashes, self.n, self.size, self.data = [], [], [], []

    def add(self, words: Words, but: np.ndarray | None = None) -> None:
        """``but``: sorted hashes of words that are left out."""
        kind = words.hashes()
        order = np.argsort(kind)  # which of equal words comes first is of no account, so the order need not be stable
        kind = kind[order]
        start = _starts(kind)
        kind, first, n = kind[start], order[start], np.diff(np.append(start, len(kind)))
        if but is not None:
            new = ~_is_in(kind, but)[0]
            kind, first, n = kind[new], first[new], n[new]
        size = words.end[first] - words.start[first]
        self.hashes.append(kind)
        self.n.append(n)
        self.size.append(size)
        self.data.append(_gathered(words.data, words.start[first], size)[0])

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted hashes and their counts; place and size of each word in the bytes, which come last."""
        kind, first, inverse = np.unique(np.concatenate(self.hashes), return_index=True, return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate(self.n), minlength=len(kind)).astype(np.int64)
        size = np.concatenate(self.size)
        return kind, n, (np.cumsum(size) - size)[first], size[first], np.concatenate(self.data)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = string_array(batch.column(0))
        for low, high in slices(texts, BLOCK_BYTES):
            block, found = texts.slice(low, high - low), Kinds()
            for a, b in slices(block, PART_BYTES):
                found.add(Words(block.slice(a, b - a), lower=True))
            kind, n, start, size, data = found.all()
            # a binary column holds 2 GB at most
            for i in range(0, len(kind), 1 << 16):
                j = slice(i, i + (1 << 16))
                raw, edge = _gathered(data, start[j], size[j])
                word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(kind[j]), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([word, pa.array(kind[j].view(np.int64)), pa.array(n[j])], names=["word", "hash", "n"])


def _dealt_words(buckets: int):
    """Counted words (word, hash, c) → rows of the words of a bucket with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[pa.RecordBatch] = []

        def dealt() -> pa.RecordBatch:
            rows = pa.Table.from_batches(have)
            order, which, edge = _dealt(np.asarray(rows["hash"]).view(np.uint64), buckets)
            words, n = rows["word"].take(pa.array(order)).to_pylist(), np.asarray(rows["c"])[order]
            parts = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            return _rows(which, WORDS, 0, [b" ".join(words[a:b]) for a, b in parts], [_planes(n[a:b]) for a, b in parts], [0] * len(parts))

        for batch in batches:
            have.append(batch)
            if sum(b.nbytes for b in have) >= BLOCK_BYTES:
                yield dealt()
                have = []
        if have:
            yield dealt()

    return run


def _ask(frequent, depth: int, short: int, buckets: int):
    """Blocks of documents → their distinct grams and words, dealt to buckets, and their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value[0]
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column(0), string_array(batch.column(1))
            for low, high in slices(texts, BLOCK_BYTES):
                asked, kinds = [], Kinds()
                at = int(mix(np.array([block], np.uint64))[0] >> np.uint64(1)) % buckets
                for part, (a, b) in enumerate(slices(texts.slice(low, high - low), PART_BYTES)):
                    column, doc = texts.slice(low + a, b - a), ids.slice(low + a, b - a)
                    words = Words(column, lower=True)
                    kinds.add(words, often)
                    asked.append(_distinct(grams(*symbols(words, depth), depth)[0]))
                    facts = np.asarray(doc.fill_null(0)).astype("<i8").tobytes() + np.asarray(doc.is_null()).astype(np.uint8).tobytes()
                    yield _rows([at], TEXTS, block, [facts + np.diff(words.edge).astype("<i8").tobytes()], [_squeezed(words.data)], [part])
                value = _distinct(np.concatenate(asked))
                order, which, edge = _dealt(_above(value, depth, short), buckets)
                yield _rows(which, ASKED_GRAMS, block, [None] * len(which), [_packed(value[order[a:b]]) for a, b in zip(edge[:-1], edge[1:])], [0] * len(which))
                kind, _, start, size, data = kinds.all()
                order, which, edge = _dealt(kind, buckets)
                raw, place = _gathered(data, start[order], size[order], 1)
                lists = [raw[place[a] : place[b] - 1].tobytes() for a, b in zip(edge[:-1], edge[1:])]
                yield _rows(which, ASKED_WORDS, block, [None] * len(which), lists, [0] * len(which))
                block += 1

    return run


def _answer(short_tree, depth: int, least: int, gain: float):
    """Rows sorted by bucket and kind → per block and bucket the logarithms of its grams' probabilities and the counts of its words; texts as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shallow: Tree = short_tree.value
        now, tree = None, None
        have: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[int, np.ndarray]] = []
        n_waiting = 0
        counts: dict[bytes, int] = {}

        def grown() -> Tree:
            out = Tree(shallow.root, list(shallow.levels))
            key, n = _summed(have) if have else (np.zeros(0, np.uint64), np.zeros(0))
            for d in range(len(shallow.levels) + 1, depth + 1):
                level = (key, n) if d == depth else _summed([(((key >> np.uint64(8 * (depth - d + 1))) << _BYTE) | (key & np.uint64(255)), n)])
                out.levels.append(_level(out, *level, d, least, gain))
            return out

        def looked_up() -> list[tuple]:
            """Answers on the grams that wait: one that many blocks ask for is looked up once."""
            nonlocal tree, n_waiting
            if not waiting:
                return []
            if tree is None:
                tree = grown()
                have.clear()
            value = np.concatenate([v for _, v in waiting])
            order = np.argsort(value)
            value = value[order]
            start = _starts(value)
            logs = np.empty(len(value), "<f4")
            logs[order] = np.repeat(np.log10(tree.probability(value[start], depth)).astype("<f4"), np.diff(np.append(start, len(value))))
            each = np.split(logs, np.cumsum([len(v) for _, v in waiting])[:-1])
            rows = [(now, ASKED_GRAMS, block, None, x.tobytes(), 0) for (block, _), x in zip(waiting, each)]
            waiting.clear()
            n_waiting = 0
            return rows

        def sent(out: list[tuple]) -> pa.RecordBatch:
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["bucket", "kind", "block", "key", "rows", "n"])

        for batch in batches:
            out: list[tuple] = []
            held = 0
            for bucket, kind, block, key, rows, n in zip(*(batch.column(k) for k in range(6))):
                bucket, kind, before = bucket.as_py(), kind.as_py(), len(out)
                if bucket != now or kind != ASKED_GRAMS or n_waiting >= TOGETHER:
                    out += looked_up()
                if bucket != now:
                    now, tree, have, counts = bucket, None, [], {}
                if kind == GRAMS:
                    have.append((_unpacked(key.as_py()), _from_planes(rows.as_py())))
                    if len(have) >= 32:
                        have = [_summed(have)]
                elif kind == WORDS:
                    counts.update(zip(key.as_py().split(b" "), _from_planes(rows.as_py()).tolist()))
                elif kind == ASKED_GRAMS:
                    waiting.append((block.as_py(), _unpacked(rows.as_py())))
                    n_waiting += len(waiting[-1][1])
                elif kind == ASKED_WORDS:
                    names = rows.as_py().split(b" ")
                    out.append((bucket, kind, block.as_py(), None, _planes(np.fromiter(map(counts.get, names, repeat(0)), np.int64, len(names))), 0))
                else:
                    out.append((bucket, kind, block.as_py(), key.as_py(), rows.as_py(), n.as_py()))
                held += sum(len(row[4]) for row in out[before:])
                if held > PART_BYTES:
                    yield sent(out)
                    out, held = [], 0
            if out:
                yield sent(out)
            del batch
            give_back()
        if waiting:
            yield sent(looked_up())

    return run


def _owned(value: np.ndarray, begin: np.ndarray, depth: int, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By group of texts: the distinct numbers of ``grams``, how often each occurs, and the text in the group of each occurrence. A symbol of a number takes ``bits`` bits.

    The texts of a group are told apart by the bits a number leaves free, so one plain sort brings equal numbers together and keeps whose they are."""
    free = np.uint64(64 - bits * (depth + 1))
    edge, out = np.append(begin, len(value)), []
    for a in range(0, len(begin), 1 << int(free)):
        b = min(a + (1 << int(free)), len(begin))
        both = value[edge[a] : edge[b]] << free
        both |= np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(edge[a : b + 1]))
        both.sort()
        found = both >> free
        start = _starts(found)
        times = np.diff(np.append(start, len(found))).astype(np.int32)
        found = found[start]
        both &= np.uint64((1 << int(free)) - 1)
        out.append((found, times, both.astype(np.uint8 if free <= 8 else np.int32 if free <= 31 else np.int64)))
    return out


def _sums(logs: np.ndarray, times: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Per text of a group, each of which has one occurrence at least, the sum of ``logs`` over its occurrences; a part of them at a time."""
    texts = int(owner.max()) + 1
    out, edge = np.zeros(texts), np.append(0, np.cumsum(times, dtype=np.int64))
    for a in range(0, len(times), 1 << 18):
        j = slice(a, a + (1 << 18))
        out += np.bincount(owner[edge[a] : edge[min(a + (1 << 18), len(times))]], weights=np.repeat(logs[j], times[j]), minlength=texts)
    return out


def _sum_up(frequent, depth: int, short: int, buckets: int, tokens: int, kinds: int, ends: int):
    """Blocks → documents. ``tokens``, ``kinds``: all and distinct training tokens; ``ends``: training documents."""
    each = np.log10(float(tokens + kinds + 1))

    def run(table: pa.Table) -> pa.Table:
        often, often_n = frequent.value
        kind, place = np.asarray(table["kind"]), np.asarray(table["bucket"])
        rows, keys, number = table["rows"], table["key"], np.asarray(table["n"])

        def answers(of: int, read) -> np.ndarray:
            at = np.flatnonzero(kind == of)
            return np.concatenate([np.zeros(0), *(read(rows[i].as_py()) for i in at[np.argsort(place[at])].tolist())])

        ids, nulls, data, edges = [], [], [], []
        occurs = np.zeros(256, bool)
        occurs[[32, END]] = True
        at = np.flatnonzero(kind == TEXTS)
        for i in at[np.argsort(number[at])].tolist():
            facts = keys[i].as_py()
            data.append(_whole(rows[i].as_py()))
            occurs[data[-1]] = True
            m = len(facts) // 17
            ids.append(np.frombuffer(facts, "<i8", m))
            nulls.append(np.frombuffer(facts, np.uint8, m, 8 * m))
            edges.append(np.append(0, np.cumsum(np.frombuffer(facts, "<i8", m, 9 * m))).astype(np.int64))
        # a number of the bytes' ranks is shorter and sorts alike: the bits it leaves tell all texts of most blocks apart
        code, symbol = (np.cumsum(occurs) - 1).astype(np.uint8), np.flatnonzero(occurs).astype(np.uint64)
        bits = (len(symbol) - 1).bit_length()
        parts, values, begins, done = [], [], [], 0
        for edge, raw in zip(edges, data):
            words = Words(pa.LargeStringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.tobytes()), pa.py_buffer(raw)))
            of_word, word = np.unique(words.hashes(), return_inverse=True)
            parts.append((np.diff(words.first), of_word, word.astype(np.int32)))
            stream, starts = symbols(words, depth)
            value, begin = grams(code[stream], starts, depth, bits)
            values.append(value)
            begins.append(begin + done)
            done += len(value)
        del data, words, stream, value, word
        give_back()
        value = np.concatenate(values)
        del values
        owned = _owned(value, np.concatenate(begins), depth, bits)
        value = owned[0][0] if len(owned) == 1 else _distinct(np.concatenate([found for found, _, _ in owned]))
        logs = np.zeros(len(value))
        logs[_dealt(_above(_plain(value, symbol, depth, bits), depth, short), buckets)[0]] = answers(ASKED_GRAMS, lambda raw: np.frombuffer(raw, "<f4"))
        score = [_sums(logs if len(owned) == 1 else logs[np.searchsorted(value, found)], times, owner) for found, times, owner in owned]
        del owned
        hashes = _distinct(np.concatenate([p[1] for p in parts]))
        here, i = _is_in(hashes, often)
        c = np.zeros(len(hashes))
        c[here] = often_n[i[here]]
        asked = np.flatnonzero(~here)
        c[asked[_dealt(hashes[asked], buckets)[0]]] = answers(ASKED_WORDS, lambda raw: _from_planes(raw).astype(np.int64))
        total, known, base = [], [], []
        for count, of_word, word in parts:
            m = len(count)
            times = c[np.searchsorted(hashes, of_word)][word]
            row = np.repeat(np.arange(m), count)
            total.append(count + 1)
            known.append(np.bincount(row, weights=times > 0, minlength=m).astype(np.int64) + int(ends > 0))
            base.append(np.bincount(row, weights=np.log10(times + 1), minlength=m) + np.log10(ends + 1.0) - (count + 1) * each)
        del parts
        give_back()
        total, known, base, score = (np.concatenate(x) for x in (total, known, base, score))
        return pa.table({"doc_id": pa.array(np.concatenate(ids), pa.int64(), mask=np.concatenate(nulls) > 0), "n_tokens": total, "n_known": known, "base_score": base, "score": score})

    return run


def score(docs: DataFrame, training: DataFrame, depth: int = DEPTH, least: int = LEAST, gain: float = GAIN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known (tokens seen in training), train_tokens, base_score, score (log10 of the text's probability)."""
    spark = docs.sparkSession
    context = spark.sparkContext
    counts = stash(training.select("text").mapInArrow(_word_counts, "word binary, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("c")), "words")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("kinds"), F.sum(F.col("c") * (F.octet_length("word") + 1)).alias("bytes")).first()
    ends = training.count()
    tokens, kinds = size["tokens"] + ends, size["kinds"] + int(ends > 0)
    fetched = counts.where(F.col("c") >= max(1.0, FREQUENT * size["tokens"])).toArrow() if size["tokens"] * FREQUENT >= 1 else None
    often, often_n = (fetched["hash"].to_numpy().view(np.uint64), fetched["c"].to_numpy()) if fetched else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    order = np.argsort(often)
    frequent = context.broadcast((often[order], often_n[order]))
    short = min(SHORT, depth)
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (size["bytes"] or 0) // BUCKET_BYTES)
    learnt = stash(training.select("text").mapInArrow(_dealt_grams(depth, short, buckets), DEALT), "grams")
    tree = context.broadcast(_fit(learnt.select("key", "rows").mapInArrow(_leading(depth, short), "gram long, n long"), short, least, 0.0, gain))

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_ask(frequent, depth, short, buckets), DEALT)
    together = learnt.unionAll(counts.select("word", "hash", "c").mapInArrow(_dealt_words(buckets), DEALT)).unionAll(asked)
    answered = together.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_answer(tree, depth, least, gain), DEALT)
    found = answered.groupBy("block").applyInArrow(_sum_up(frequent, depth, short, buckets, tokens, kinds, ends), "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(tokens).cast("long"))
