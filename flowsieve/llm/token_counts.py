"""Token counts without token ids (operator 9).

The text is split into pre-tokens, the pieces byte-pair encoding never crosses. A block of documents yields one row per distinct pre-token with its
frequency in each document of the block; the rows are shuffled by pre-token, so that each distinct one is counted once and its count meets all its
frequency rows there; the products are added per document inside each task and finally per block. No ids of a document are ever made.

A pre-token that is hot, that is in at least one of ``HOT`` documents of a block, or an entry of the vocabulary itself (one token), is resolved inside its block
instead of being sent: such rows would all meet in one task. Blocks hold at most ``BLOCK_BYTES`` of text (a longer text alone), so a block's documents and
sums fit one task at any size of the input.

Special tokens' strings in a text count as one token each, as in the library's default. A null text is empty: no bytes, no tokens. Repeated rows stay rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.bpe import Codec, codec, default_tokenizer

BLOCK_BYTES = 12 << 20
BLOCK_ROWS = 1 << 15
HOT = 64
LIMIT = 512
_SPACE, _LETTER, _DIGIT = r"\t-\r \x85\xa0", r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The splitting pattern for texts within Latin-1.
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_CUT = re.compile(rf"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def pre_tokens(text: str, c: Codec) -> list[str]:
    """The pieces the library splits a text without special tokens into."""
    try:
        text.encode("latin-1")
        return _LATIN.findall(text)
    except UnicodeEncodeError:
        return [text[a:b] for _, (a, b) in c.library.pre_tokenizer.pre_tokenize_str(text)]


def chunks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """Parts of a very long text, cut where a single space stands between two other characters: a pre-token always begins there."""
    at = 0
    while len(text) - at > size:
        m = _CUT.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def piece_length(piece: str, c: Codec) -> int:
    return 1 if piece.encode() in c.ranks else len(c.fast.encode_ordinary(piece)) if c.plain(piece) else len(c.library.encode(piece, add_special_tokens=False))


class _Numbering(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _block(texts: list[str], c: Codec, special: re.Pattern | None):
    """Pre-token numbers with the sorted (piece, document) pairs of one block, frequencies, and tokens from special strings."""
    number, rows, extra = _Numbering(), [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = [text]
        if special is not None and special.search(text):
            extra[i] = len(special.findall(text))
            parts = special.split(text)
        for part in parts:
            for chunk in chunks(part) if len(part) > 1 << 20 else (part,):
                pieces = pre_tokens(chunk, c)
                rows.append((np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces)) << 32) | i)
    pairs, times = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_counts=True)
    return list(number), pairs >> 32, pairs & 0xFFFFFFFF, times, extra


def _frequencies(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        special = re.compile("|".join(re.escape(s) for s in sorted(c.special, key=len, reverse=True))) if c.special else None
        block = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[str] = []
        held = 0

        def flush():
            pieces, of, doc, times, extra = _block(texts, c, special)
            spread = np.bincount(of, minlength=len(pieces))
            length = np.fromiter((1 if p.encode() in c.ranks else 0 for p in pieces), np.int64, len(pieces))
            for j in np.flatnonzero((length == 0) & (spread * HOT >= max(len(texts), HOT))):
                length[j] = piece_length(pieces[j], c)
            known = np.bincount(doc, weights=length[of] * times, minlength=len(texts)).astype(np.int64) + extra
            meta = np.stack([np.fromiter((i is None for i in ids), np.int64, len(ids)), np.fromiter((i or 0 for i in ids), np.int64, len(ids)),
                             np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts)), known], axis=1)
            sent = length[of] == 0
            of, doc, times = of[sent], doc[sent], times[sent]
            deep = times > 255
            while deep.any():  # a frequency is one byte; more of it makes further entries
                of, doc = np.concatenate([of, of[deep]]), np.concatenate([doc, doc[deep]])
                times = np.concatenate([np.where(deep, 255, times), times[deep] - 255])
                deep = times > 255
            order = np.argsort(of, kind="stable")
            of, doc, times = of[order], doc[order], times[order]
            entry = np.empty((len(of), 3), np.uint8)
            entry[:, 0], entry[:, 1], entry[:, 2] = doc & 255, doc >> 8, times
            which, start = np.unique(of, return_index=True)
            edges = np.append(start, len(of)).astype(np.int32) * 3
            lists = pa.BinaryArray.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(entry.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array([pieces[j] for j in which], pa.string()), pa.repeat(block, len(which)).cast(pa.int64()), lists], names=["piece", "block", "rows"])
            # the block's documents travel under a key of their own; it begins with a byte no pre-token of two characters begins with
            yield pa.RecordBatch.from_arrays([pa.array([f"\0block {block}"], pa.string()), pa.array([block], pa.int64()), pa.array([meta.tobytes()], pa.binary())], names=["piece", "block", "rows"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BLOCK_BYTES or len(ids) >= BLOCK_ROWS:
                    yield from flush()
                    ids, texts, held, block = [], [], 0, block + 1
        if ids:
            yield from flush()

    return run


def _products(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        counted: dict[str, int] = {}
        sums: dict[int, list] = {}
        held = 0

        def flush():
            for block, parts in sums.items():
                doc, add = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                total = np.bincount(doc, weights=add)
                some = np.flatnonzero(total)
                yield block, np.stack([some, total[some].astype(np.int64)], axis=1).astype("<u4").tobytes()

        def batch_of(rows):
            blocks, data = [r[0] for r in rows], [r[1] for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([False] * len(rows)), pa.array(data, pa.binary())], names=["block", "documents", "rows"])

        for batch in batches:
            pieces, blocks, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            by_block: dict[int, tuple[list, list]] = {}
            for piece, block, row in zip(pieces, blocks, rows):
                if piece.startswith("\0block "):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([True]), pa.array([row], pa.binary())], names=["block", "documents", "rows"])
                    continue
                n = counted.get(piece)
                if n is None:
                    n = counted[piece] = piece_length(piece, c)
                where = by_block.setdefault(block, ([], []))
                where[0].append(row)
                where[1].append(n)
            for block, (lists, n) in by_block.items():
                entry = np.frombuffer(b"".join(lists), np.uint8).reshape(-1, 3).astype(np.int64)
                per = np.repeat(np.array(n), np.fromiter((len(x) // 3 for x in lists), np.int64, len(lists)))
                sums.setdefault(block, []).append((entry[:, 0] | entry[:, 1] << 8, entry[:, 2] * per))
                held += len(entry)
            if held > 4 << 20:
                yield batch_of(list(flush()))
                sums, held = {}, 0
        if sums:
            yield batch_of(list(flush()))

    return run


def _totals(table: pa.Table) -> pa.Table:
    documents = table["documents"].to_pylist()
    rows = table["rows"].to_pylist()
    meta = np.frombuffer(next(r for r, d in zip(rows, documents) if d), np.int64).reshape(-1, 4)
    total = meta[:, 3].copy()
    for r, d in zip(rows, documents):
        if not d:
            part = np.frombuffer(r, "<u4").reshape(-1, 2).astype(np.int64)
            total[part[:, 0]] += part[:, 1]
    return pa.table({"doc_id": pa.array(meta[:, 1], pa.int64(), mask=meta[:, 0].astype(bool)), "n_bytes": pa.array(meta[:, 2], pa.int64()), "n_tokens": pa.array(total, pa.int64())})


def count_tokens(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens."""
    path = path or default_tokenizer()
    sent = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_frequencies(path), "piece string, block long, rows binary")
    products = sent.repartition("piece").mapInArrow(_products(path), "block long, documents boolean, rows binary")
    return products.groupBy("block").applyInArrow(_totals, "doc_id long, n_bytes long, n_tokens long")
