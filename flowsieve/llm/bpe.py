"""Byte-pair encoding and decoding of whole texts (operator 6), by tree concatenation.

A text of at most ``LONG`` characters is one leaf. A longer one is cut into leaves of ``LEAF`` characters, which are rows of their own: they are spread over
the cluster and encoded in parallel, wherever the cuts fall. Per text the leaves are then joined pairwise, level by level. At each join the tokens around it
are turned back into text and re-encoded in a window that grows until its outermost tokens are the ones both sides already have. A sequence of tokens is the
encoding of its text exactly if all neighbouring pairs are, and after agreement every pair lies inside the left side, the window or the right side.

Ids equal those of the ``tokenizers`` library for the same file. Texts within Latin-1 are encoded by ``tiktoken`` with ranks taken from that file, which
gives the same ids several times faster (both split such texts alike; tests compare them over all pairs of its characters); other texts, and texts that
hold a special token's string, by ``tokenizers`` itself.

A null text is an empty one and has no tokens. A repeated row is encoded again and stays a row. Other columns are kept by ``encode`` for all texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve.llm.text import fresh, give_back

LEAF = 1 << 14
LONG = 1 << 15
WINDOW = 32
AGREE = 8
#: Fixed value: how the byte-level pre-tokenizer of the file splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {chr(b): b for b in shown}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return table


class Codec:
    """Encoder and decoder of one byte-level BPE file. The two libraries are loaded when a text needs them; decoding needs neither."""

    def __init__(self, path: str):
        self.path = path
        with open(path) as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = byte_of_char()
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        ids = [spec["model"]["vocab"][m] for m in merged]
        self.ordered = spec.get("normalizer") is None and len(ranks) == 256 + len(ids) and all(a < b for a, b in zip(ids, ids[1:]))
        self.ranks = ranks
        size = max([*ranks.values(), *self.special.values()]) + 1
        self.table: list[bytes] = [b""] * size
        for token, i in ranks.items():
            self.table[i] = token
        for token, i in self.special.items():
            self.table[i] = token.encode()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    @cached_property
    def fast(self):
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        """Whether the fast encoder gives the library's ids."""
        if not self.ordered or any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def encode(self, text: str) -> np.ndarray:
        if self.plain(text):
            return np.array(self.fast.encode_ordinary(text), dtype="<u4")
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def raw(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.table.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def join(a: np.ndarray, b: np.ndarray, c: Codec, window: int = WINDOW) -> np.ndarray:
    """The encoding of the two texts behind each other, from the encodings of each."""
    if not len(a) or not len(b):
        return np.concatenate([a, b])
    k = window
    while True:
        left, right = a[max(0, len(a) - k) :], b[:k]
        try:
            text = (c.raw(left) + c.raw(right)).decode("utf-8")
        except UnicodeDecodeError:  # a token ends inside a character
            k += 1
            continue
        middle = c.encode(text)
        m = min(AGREE, len(left), len(right), len(middle))
        if (len(left) == len(a) or np.array_equal(middle[:m], left[:m])) and (len(right) == len(b) or np.array_equal(middle[-m:], right[-m:])):
            return np.concatenate([a[: len(a) - len(left)], middle, b[len(right) :]])
        k *= 2


def join_tree(parts: list[np.ndarray], c: Codec, window: int = WINDOW) -> np.ndarray:
    while len(parts) > 1:
        parts = [join(parts[i], parts[i + 1], c, window) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else np.zeros(0, "<u4")


def leaves(text: str, size: int = LEAF) -> list[str]:
    return [text[i : i + size] for i in range(0, len(text), size)] or [""]


def _adding(path: str, text: str, ids: str, keep: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [c.encode(t or "") for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array([f.tobytes() for f in found], pa.binary())], names=[*keep, ids])
            give_back()

    return run


def encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", leaf: int = LEAF, long: int = LONG) -> DataFrame:
    """``docs`` with the column ``ids``: binary, little-endian unsigned 32-bit integers. A column of that name is replaced."""
    path = path or default_tokenizer()
    docs = docs.drop(ids)
    keep = docs.columns
    shape = T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())])
    size = F.coalesce(F.length(text), F.lit(0))
    short = docs.where(size <= long).mapInArrow(_adding(path, text, ids, keep), shape)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = leaves(row.column("_text")[0].as_py(), leaf)
                yield pa.RecordBatch.from_arrays([pa.repeat(row.column("_row")[0], len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.string())], names=["_row", "_part", "_text"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            found = [c.encode(t).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_part"), pa.array(found, pa.binary())], names=["_row", "_part", "_ids"])

    def merge(table: pa.Table) -> pa.Table:
        rows = dict(zip(table["_part"].to_pylist(), table["_ids"].to_pylist()))  # rows with the same text have the same leaves
        whole = join_tree([np.frombuffer(rows[p], "<u4") for p in range(len(rows))], codec(path))
        return pa.table({"_row": table["_row"].slice(0, 1), "_ids": pa.array([whole.tobytes()], pa.binary())})

    # a long text is known by its hash and length; only texts are merged, the other columns stay where they are
    row = fresh(docs, "_row")
    big = docs.where(size > long).withColumn(row, F.sha2(F.encode(F.col(text), "utf-8"), 256))
    spread = big.select(F.col(row).alias("_row"), F.col(text).alias("_text")).dropDuplicates(["_row"]).mapInArrow(cut, "_row string, _part int, _text string")
    encoded = spread.repartition("_row", "_part").mapInArrow(encode_leaves, "_row string, _part int, _ids binary")
    merged = encoded.groupBy("_row").applyInArrow(merge, "_row string, _ids binary").select(F.col("_row").alias(row), F.col("_ids").alias(ids))
    return short.unionByName(big.join(merged, row).select(*keep, ids))


def decode(df: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` (null: empty) in the column ``text``, special tokens included."""
    path = path or default_tokenizer()
    df = df.drop(text)
    keep = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = [c.decode(np.frombuffer(b or b"", "<u4")) for b in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(found, pa.string())], names=[*keep, text])
            give_back()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(text, T.StringType())]))
