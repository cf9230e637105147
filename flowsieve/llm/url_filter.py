"""URL filter over a sorted digest array (operator 3).

Rules ``(host, path, verdict)`` become one string each, ``host + path``. Their 64-bit xxhash keys are sorted into an array in a file that every executor
gets once (``SparkContext.addFile``) and maps into memory, with the full strings beside it. A URL makes one probe per (suffix of its host, rule path
length); all probes of an Arrow batch are hashed and looked up with one vectorised binary search, and each hit is confirmed by the stored string, so a
collision of keys cannot match. The longest rule string wins. The array is shipped only up to ``MAX_BYTES``; beyond that the same probes are joined with
the rules on the cluster.

A null or malformed URL (no ``://``) has an empty host and path, hits no rule and takes ``default``. Two rules of one string: ``block`` wins.
"""

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.text import fresh

MAX_BYTES = 256 << 20
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url", host: str = "host", path: str = "path") -> DataFrame:
    """``pages`` with host (after the first ``://`` up to ``/``, ``?``, ``#``; A-Z lower-cased) and path (then up to ``?`` or ``#``) of ``url``; both are
    empty without ``://``. Columns of these names are replaced."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    found = F.regexp_extract(rest, r"\A([^/?#]*)([^?#]*)", 1), F.regexp_extract(rest, r"\A([^/?#]*)([^?#]*)", 2)
    return pages.withColumns({host: F.coalesce(F.translate(found[0], _UPPER, _LOWER), F.lit("")), path: F.coalesce(found[1], F.lit(""))})


class DigestArray:
    """Sorted keys, verdicts and strings of the rules, mapped from one file.

    Layout: number of rules, number of path lengths (uint64 each), the path lengths, the sorted keys, string offsets (n + 1), verdicts (one byte), strings.
    """

    def __init__(self, path: str):
        head = np.memmap(path, dtype="<u8", mode="r", shape=(2,))
        n, m = int(head[0]), int(head[1])
        whole = np.memmap(path, dtype="<u8", mode="r", offset=16, shape=(m + n + n + 1,))
        self.lengths, self.keys, self.offsets = whole[:m].tolist(), whole[m : m + n], whole[m + n :]
        start = 16 + 8 * (m + 2 * n + 1)
        self.block = np.memmap(path, dtype=np.uint8, mode="r", offset=start, shape=(n,)) if n else np.zeros(0, np.uint8)
        size = int(self.offsets[-1])
        self.strings = np.memmap(path, dtype=np.uint8, mode="r", offset=start + n, shape=(size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def pack(rules: list[tuple[str, str, str]]) -> bytes:
        folded: dict[str, bool] = {}
        for host, path, verdict in rules:
            folded[host + path] = folded.get(host + path, False) or verdict == "block"
        lengths = sorted({len(path) for _, path, _ in rules})
        rows = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), block) for text, block in folded.items())
        offsets = np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.uint64)
        words = np.array([len(rows), len(lengths), *lengths, *(r[0] for r in rows)], dtype=np.uint64)
        return words.tobytes() + offsets.astype("<u8").tobytes() + bytes(r[2] for r in rows) + b"".join(r[1] for r in rows)

    def lookup(self, probes: list[bytes]) -> np.ndarray:
        """Index of each probe's rule, -1 without one. Keys that collide stand side by side; the stored strings decide."""
        if not probes or not len(self.keys):
            return np.full(len(probes), -1)
        keys = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), dtype=np.uint64, count=len(probes))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(probes), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:
                if self.strings[int(self.offsets[j]) : int(self.offsets[j + 1])].tobytes() == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out


def probe_strings(host: str, path: str, lengths: list[int]) -> list[str]:
    """All rule strings that would fit, the longest first; of equally long ones that with the longer host, then the smaller string."""
    parts = host.split(".") if host else []
    found = {".".join(parts[i:]) + path[:n] for i in range(len(parts)) for n in lengths if n <= len(path)}
    return sorted(found, key=lambda s: (-len(s), -len(s.partition("/")[0]), s))


def _judge(file: str):
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        store = DigestArray(SparkFiles.get(file))
        for host, path in batches:
            per_row = [probe_strings(h, p, store.lengths) for h, p in zip(host, path)]
            flat = [s for row in per_row for s in row]
            hit = store.lookup([s.encode() for s in flat])
            rules, verdicts, at = [], [], 0
            for row in per_row:
                first = next((k for k in range(at, at + len(row)) if hit[k] >= 0), None)
                rules.append(None if first is None else flat[first])
                verdicts.append(None if first is None else ("block" if store.block[hit[first]] else "allow"))
                at += len(row)
            yield pd.DataFrame({"rule": pd.Series(rules, dtype="object"), "verdict": pd.Series(verdicts, dtype="object")})

    return run


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = list(RULES), default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null without one) and ``verdict``."""
    spark = pages.sparkSession
    parts = with_parts(pages, url)
    packed = DigestArray.pack(rules)
    if len(packed) > MAX_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), default, url)
    name = f"rules-{uuid.uuid4().hex}.bin"
    folder = tempfile.mkdtemp(prefix="rules-")  # the driver serves this file to the executors until the session ends
    atexit.register(shutil.rmtree, folder, True)
    file = os.path.join(folder, name)
    with open(file, "wb") as out:
        out.write(packed)
    spark.sparkContext.addFile(file)
    hit = fresh(parts, "_hit")
    return _answer(parts.withColumn(hit, F.pandas_udf(_judge(name), "rule string, verdict string")(F.col("host"), F.col("path"))), hit, default)


def _answer(df: DataFrame, hit: str, default: str) -> DataFrame:
    return df.withColumns({"rule": F.col(f"{hit}.rule"), "verdict": F.coalesce(F.col(f"{hit}.verdict"), F.lit(default))}).drop(hit)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The same answer for rule lists of any size: probes and rules meet in a join on the rule string."""
    folded = rules.groupBy(F.concat("host", "path").alias("_rule")).agg(F.min(F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("_free"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as there are different lengths of paths
    parts = with_parts(pages, url)
    row, hit = fresh(parts, "_row"), fresh(parts, "_hit")
    parts = parts.withColumn(row, F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cut = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    probes = F.flatten(F.transform(hosts, lambda h: F.transform(cut, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))
    asked = parts.where("host <> ''").select(row, F.explode(F.array_distinct(probes)).alias("_rule"))
    order = F.struct(-F.length("_rule"), -F.length(F.substring_index("_rule", "/", 1)), F.col("_rule"))
    best = asked.join(folded, "_rule").groupBy(row).agg(F.min_by(F.struct(F.col("_rule").alias("rule"), F.when(F.col("_free") == 0, "block").otherwise("allow").alias("verdict")), order).alias(hit))
    return _answer(parts.join(best, row, "left").drop(row), hit, default)
