"""Alignment of two tokenizers and corpus-wide counts of the ids they link (operator 12), by inverted pair bitmaps.

A text is encoded twice: with one space before it by byte-level BPE (A), as it is by a piece model that adds this space (B). Byte offsets where tokens of both end cut the text
into groups; every A token is linked to every B token of its group. A document is held by an id pair that is linked in it.

1. Documents are gathered to blocks of at most ``BLOCK_ROWS`` rows and about ``BLOCK_LINKS`` links (a document beyond that alone). A block is inverted: each id pair has a compressed
   bitmap of the block's documents, a sorted array of 16-bit numbers or, when dense, one bit a document. How often a document links the pair, less one, is kept in
   multiplicity planes, one such bitmap per binary digit. Blocks are written once, with their documents.
2. Bitmaps of different blocks never overlap, so OR-merging those of a pair sets them side by side, and popcounts add up: a block sends one number per pair, and no bitmap of a
   frequent pair grows with the corpus in one place. The sums give each pair's count and each A id's highest count.
3. The counts return to the blocks that hold the pair. There the postings return scores: each document in a pair's bitmap gets the pair's count as often as the planes say.

Counts are of rows: repeated rows count as often as they are there, whatever their doc_id, and each is a row of the result, as are rows without doc_id. Texts that are null or empty, or whose
tokens do not join to the bytes of space and text, have no tokens: zeros and an empty description, and they hold no pair. Special tokens' strings are plain text. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.bpe import codec, default_tokenizer
from flowsieve.llm.text import give_back, stash

BLOCK_ROWS = 4096
BLOCK_LINKS = 3 << 20
#: Linked pairs of one group above this number are made from its distinct ids.
WIDE = 1 << 16
_ID_BITS, _ROW_BITS = 22, 16
_NONE = np.zeros(0, np.int64)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# ---- one text ---------------------------------------------------------------------------------------------------------


class Tokenizers:
    """Both tokenizers, with the bytes of each id, its length, and its decimal number with each sign that may follow it."""

    def __init__(self, path_a: str, path_b: str):
        self.a = codec(path_a)
        self.path_a, self.path_b = path_a, path_b
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = self.a.table
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.length_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.length_b = np.array([len(t) for t in self.bytes_b], np.int64)
        self.size = max(len(self.bytes_a), len(self.bytes_b))
        self.spelled = [f"{i}{sign}".encode() for sign in (",", "|", ";", "") for i in range(self.size)]

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path_b)

    @cached_property
    def whole(self):
        """The library itself, for texts the fast encoder does not take; special tokens' strings are plain text."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path_a)
        found.no_truncation()
        found.no_padding()
        found.encode_special_tokens = True
        return found

    def ids_a(self, text: str) -> list[int]:
        if self.a.ordered:
            try:
                text.encode("latin-1")
                return self.a.fast.encode_ordinary(text)
            except UnicodeEncodeError:
                pass
        return self.whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none if the tokens of one do not join to the bytes of space and text."""
        if not text:
            return _NONE, _NONE
        a, b = self.ids_a(f" {text}"), self.b.encode(text, num_threads=1)
        raw = f" {text}".encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return _NONE, _NONE
        return np.array(a, np.int64), np.array(b, np.int64)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def groups(length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the group of each token, from the lengths of both sides' tokens."""
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    total = int(end_a[-1])
    marks = np.zeros(total + 1, np.uint8)
    marks[end_a] = 1
    marks[end_b] += 1
    cut_a, cut_b = marks[end_a] == 2, marks[end_b] == 2
    return np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b


def spelled(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, t: Tokenizers) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, A's before B's."""
    n = int(group_a[-1]) + 1
    last_a, last_b = np.cumsum(np.bincount(group_a, minlength=n)), np.cumsum(np.bincount(group_b, minlength=n))
    code = np.empty(len(a) + len(b), np.int64)
    sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    sign_a[last_a - 1] = 1
    sign_b[last_b - 1] = 2
    sign_b[-1] = 3
    code[np.arange(len(a)) + np.append(0, last_b[:-1])[group_a]] = sign_a * t.size + a
    code[np.arange(len(b)) + last_a[group_b]] = sign_b * t.size + b
    return b"".join(map(t.spelled.__getitem__, code.tolist()))


def pairs_of(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, wide: int = WIDE) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs, each as ``a << _ID_BITS | b``, with how often each entry counts; an entry may come more than once."""
    n = int(group_a[-1]) + 1
    many_a, many_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    last_b = np.cumsum(many_b)
    big = np.flatnonzero(many_a * many_b > wide)
    of_a = many_b[group_a]
    of_a[np.isin(group_a, big)] = 0
    parent = np.repeat(np.arange(len(a)), of_a)
    partner = np.arange(len(parent)) - np.repeat(np.cumsum(of_a) - of_a, of_a) + (last_b - many_b)[group_a][parent]
    pairs, times = [a[parent] << _ID_BITS | b[partner]], [np.ones(len(parent), np.int64)]
    for g in big.tolist():
        x, nx = np.unique(a[group_a == g], return_counts=True)
        y, ny = np.unique(b[group_b == g], return_counts=True)
        pairs.append((x[:, None] << _ID_BITS | y[None, :]).reshape(-1))
        times.append((nx[:, None] * ny[None, :]).reshape(-1))
    return np.concatenate(pairs), np.concatenate(times)


# ---- compressed bitmaps -----------------------------------------------------------------------------------------------


def compress(of: np.ndarray, row: np.ndarray, n: int, rows: int) -> tuple[bytes, bytes, bytes]:
    """Bitmaps 0 … n-1 over ``rows`` rows, given by sorted (bitmap, row) entries: sizes, sorted arrays, and dense bitmaps of those that are smaller so."""
    size = np.bincount(of, minlength=n)
    dense = size * 16 > rows
    in_dense = dense[of]
    width = -(-rows // 8)
    bits = np.zeros((int(dense.sum()), width), np.uint8)
    at = (np.cumsum(dense) - 1)[of[in_dense]]
    r = row[in_dense]
    np.bitwise_or.at(bits, (at, r >> 3), (1 << (r & 7)).astype(np.uint8))
    return size.astype("<u4").tobytes(), row[~in_dense].astype("<u2").tobytes(), bits.tobytes()


def popcounts(bitmap: tuple[bytes, bytes, bytes], rows: int) -> np.ndarray:
    """Rows in each bitmap: dense ones are counted bit by bit, arrays by their length."""
    size = np.frombuffer(bitmap[0], "<u4").astype(np.int64)
    dense = np.flatnonzero(size * 16 > rows)
    if len(dense):
        bits = np.frombuffer(bitmap[2], np.uint8).reshape(len(dense), -1)
        size[dense] = np.bitwise_count(bits).sum(axis=1)
    return size


def entries(bitmap: tuple[bytes, bytes, bytes], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap, row) of every set bit, arrays first."""
    size = np.frombuffer(bitmap[0], "<u4").astype(np.int64)
    dense = size * 16 > rows
    sparse = np.flatnonzero(~dense)
    of, row = [np.repeat(sparse, size[sparse])], [np.frombuffer(bitmap[1], "<u2").astype(np.int64)]
    if dense.any():
        bits = np.unpackbits(np.frombuffer(bitmap[2], np.uint8).reshape(int(dense.sum()), -1), axis=1, bitorder="little")
        which, r = np.nonzero(bits)
        of.append(np.flatnonzero(dense)[which])
        row.append(r)
    return np.concatenate(of), np.concatenate(row)


# ---- steps ------------------------------------------------------------------------------------------------------------

_BLOCK = "block long, ids binary, no_id binary, figures binary, described array<binary>, pairs binary, documents array<binary>, planes array<binary>"


def _invert(path_a: str, path_b: str, describe: Callable[[bytes], bytes], block_rows: int, block_links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(path_a, path_b)
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        figures: list[tuple] = []
        described: list[bytes] = []
        keys: list[np.ndarray] = []
        times: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal made, held
            rows = len(ids)
            key = np.concatenate(keys) if keys else _NONE
            plain = not times or all(x is None for x in times)
            if plain:
                key, n = np.unique(key, return_counts=True)
            else:
                weight = np.concatenate([np.ones(len(k), np.int64) if x is None else x for k, x in zip(keys, times)])
                order = np.argsort(key, kind="stable")
                key, weight = key[order], weight[order]
                start = np.flatnonzero(np.diff(key, prepend=-1))
                key, n = key[start], np.add.reduceat(weight, start)
            pair, of = np.unique(key >> _ROW_BITS, return_inverse=True)
            of, row = of.reshape(-1), key & ((1 << _ROW_BITS) - 1)
            planes: list[bytes] = []
            more = n - 1
            while len(more) and more.max() > 0:
                odd = (more & 1) == 1
                planes += compress(of[odd], row[odd], len(pair), rows)
                more >>= 1
            made += 1
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([base + made], pa.int64()), "ids": pa.array([np.array([i or 0 for i in ids], "<i8").tobytes()], pa.binary()), "no_id": pa.array([np.array([i is None for i in ids], np.uint8).tobytes()], pa.binary()),
                "figures": pa.array([np.array(figures, "<i8").tobytes()], pa.binary()), "described": pa.array([described], pa.list_(pa.binary())), "pairs": pa.array([pair.astype("<i8").tobytes()], pa.binary()),
                "documents": pa.array([list(compress(of, row, len(pair), rows))], pa.list_(pa.binary())), "planes": pa.array([planes], pa.list_(pa.binary()))})
            for x in (ids, figures, described, keys, times):
                x.clear()
            held = 0
            give_back()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                a, b = t.encode(text.as_py())
                n_links = n_groups = 0
                said = b""
                if len(a):
                    group_a, group_b = groups(t.length_a[a], t.length_b[b])
                    n_groups = int(group_a[-1]) + 1
                    said = describe(spelled(a, b, group_a, group_b, t))
                    pair, n = pairs_of(a, b, group_a, group_b)
                    n_links = int(n.sum())
                    keys.append(pair << _ROW_BITS | len(ids))
                    times.append(None if n_links == len(n) else n)
                    held += len(pair)
                ids.append(doc_id)
                figures.append((len(a), len(b), n_groups, n_links))
                described.append(said)
                if len(ids) >= block_rows or held >= block_links:
                    yield flush()
        if ids:
            yield flush()

    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            pairs = np.frombuffer(row["pairs"], "<i8")
            n = popcounts(tuple(row["documents"]), row["rows"])
            for low in range(0, len(pairs), 1 << 18):
                part = pairs[low : low + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.repeat(row["block"], len(part)).cast(pa.int64()), pa.array(part), pa.array(n[low : low + (1 << 18)])], names=["block", "pair", "n"])


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {k: batch.column(k)[r] for k in batch.schema.names}
            ids = np.frombuffer(row["ids"].as_py(), "<i8")
            rows = len(ids)
            figures = np.frombuffer(row["figures"].as_py(), "<i8").reshape(rows, 4)
            pairs = np.frombuffer(row["pairs"].as_py(), "<i8")
            total, best = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            if len(pairs):
                answers = row["answers"].values
                order = np.argsort(answers.field("pair").to_numpy())
                count, highest = answers.field("n").to_numpy()[order], answers.field("highest").to_numpy(zero_copy_only=False)[order]
                planes = row["planes"].as_py()
                for weight, bitmap in [(1, row["documents"].as_py()), *((1 << k, planes[3 * k : 3 * k + 3]) for k in range(len(planes) // 3))]:
                    of, at = entries(tuple(bitmap), rows)
                    np.add.at(total, at, weight * count[of])
                    np.add.at(best, at, weight * highest[of].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=np.frombuffer(row["no_id"].as_py(), np.uint8).astype(bool)), *(pa.array(np.ascontiguousarray(figures[:, k])) for k in range(4)), pa.array(best), pa.array(total), row["described"].values], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "described"])
        give_back()


def whole_groups(raw: bytes) -> bytes:
    return raw


def link(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, describe: Callable[[bytes], bytes] = whole_groups, block_rows: int = BLOCK_ROWS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, described; one row per row of ``docs``. ``described`` is what ``describe`` keeps of the groups' ids, written as
    ``a1,a2|b1;a3|b2,b3`` (by default all of it), and empty without tokens."""
    if block_rows > 1 << _ROW_BITS:
        raise ValueError("a block's documents are numbered in 16 bits")
    path_a, path_b = path_a or default_tokenizer(), path_b or default_pieces()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = stash(texts.mapInArrow(_invert(path_a, path_b, describe, block_rows, block_links), _BLOCK), "links")
    sent = blocks.select("block", "pairs", "documents", F.floor(F.octet_length("ids") / 8).alias("rows")).mapInArrow(_pair_counts, "block long, pair long, n long")
    counts = sent.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", _ID_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    judged = counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("highest"))
    answers = sent.select("block", "pair").join(judged, "pair").groupBy("block").agg(F.collect_list(F.struct("pair", "n", "highest")).alias("answers"))
    return blocks.join(answers, "block", "left").drop("block").mapInArrow(_scores, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, described binary")
