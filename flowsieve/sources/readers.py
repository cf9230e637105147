"""Reading flow records, alerts, corpora and the knowledge base."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import fixed
from flowsieve.operators import enrich, standardize

_SCOPES = ("bidirectional", "src2dst", "dst2src")
FLOW = T.StructType(
    [
        T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()), T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()), T.StructField("protocol", T.IntegerType()), T.StructField("ip_version", T.IntegerType()),
        T.StructField("bidirectional_first_seen_ms", T.LongType()),
    ]
    + [T.StructField(f"{s}_{n}", T.LongType()) for s in _SCOPES for n in ("duration_ms", "packets", "bytes")]
    + [T.StructField(f"{s}_{m}_ps", T.DoubleType()) for s in _SCOPES for m in ("min", "max", "mean", "stddev")]
    + [T.StructField(f"{s}_{m}_piat_ms", T.DoubleType()) for s in _SCOPES for m in ("min", "max", "mean", "stddev")]
    + [T.StructField(f"{s}_{f}_packets", T.LongType()) for s in _SCOPES[1:] for f in fixed.TCP_FLAGS]
)


#: Files whose header lines are read at the same time.
HEADER_THREADS = 32


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """The cells of the first line of a file that is not blank; none for an empty file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = p.getFileSystem(conf).open(p)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(p)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        line = lines.readLine()
        while line is not None and not line.strip():
            line = lines.readLine()
    finally:
        stream.close()
    return tuple((cell or f"_c{i}").strip() for i, cell in enumerate(next(csv.reader([line])))) if line is not None else ()


def _by_header(spark: SparkSession, path: str | list[str]) -> list[tuple[tuple[str, ...], DataFrame]]:
    """The files at ``path`` by their header lines: trimmed cells, and the rows with columns ``c0``, ``c1``, ...; the last one is filled only on lines with too many cells.

    Files may have their columns in different orders; each different header is one read of its files, by position (Spark would rename every column of a header cell that occurs twice, so
    that none of them keeps the name). Only first lines pass through the driver.
    """
    files = sorted(spark.read.text(path).inputFiles())
    with ThreadPoolExecutor(HEADER_THREADS) as pool:
        heads = list(pool.map(lambda f: _header(spark, f), files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, head in zip(files, heads):
        if head:
            groups.setdefault(head, []).append(file)
    found = []
    for head, own in groups.items():
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(head) + 1)])
        rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("header", True).option("enforceSchema", True)
        found.append((head, rows.csv(path if len(own) == len(files) else [unquote(f) for f in own])))
    return found


def _together(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_flow_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Feature CSV with any subset of columns; header cells are trimmed, values stay text until ``clean``. Every file is read by its own header: columns may stand in any order, and are
    null where a file lacks them. Of a header cell that occurs twice the first column counts."""
    parts = [raw.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(header) if n not in header[:i]]) for header, raw in _by_header(spark, path)]
    return _together(parts) if parts else spark.createDataFrame([], T.StructType([]))


def read_flow_records(spark: SparkSession, path: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Exported flow records in the flow meter's attributes."""
    reader = spark.read.schema(FLOW)
    return reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def corpus_to_parquet(spark: SparkSession, paths: Sequence[str], out_dir: str) -> list[str]:
    """Converts labelled CSV files to Parquet: known features as float32 plus the label, snappy-compressed.

    A path may be a folder; every file in it is read by its own header. Lines with too many cells are skipped, missing cells are null. A file that was converted completely before is not read again. Files of one name keep the
    name of their folder as well.
    """
    written = []
    names_of = [path.rstrip("/").removesuffix(".csv").split("/") for path in paths]
    for path, parts in zip(paths, names_of):
        depth = next(n for n in range(1, len(parts) + 1) if n == len(parts) or sum(other[-n:] == parts[-n:] for other in names_of) == 1)
        out = f"{out_dir}/{'_'.join(p for p in parts[-depth:] if p)}.parquet"
        written.append(out)
        if _exists(spark, f"{out}/_SUCCESS"):
            continue
        parts = []
        for header, raw in _by_header(spark, path):
            cols: dict[str, Column] = {}
            for i, h in enumerate(header):
                n = fixed.CORPUS_ALIASES.get(h, h)
                if n in fixed.FEATURES:
                    cols.setdefault(n, F.col(f"c{i}").try_cast("float").alias(n))
                elif n.lower() == "label":
                    cols.setdefault("Label", F.col(f"c{i}").alias("Label"))
            if any(n in fixed.FEATURES for n in cols):
                parts.append(raw.filter(F.col(f"c{len(header)}").isNull()).select(*cols.values()))
        if not parts:
            written.pop()
            continue
        _together(parts).write.mode("overwrite").option("compression", "snappy").parquet(out)
    return written


def read_alerts(spark: SparkSession, path: str | list[str], year: int | None = None) -> DataFrame:
    """Alert JSON lines in the form the joins with flows take; unreadable lines and lines without addresses are dropped. ``year`` completes times that have none."""
    return standardize.joinable_alerts(spark.read.text(path), "value", year)


def stream_alerts(spark: SparkSession, folder: str, files_per_trigger: int | None = None, year: int | None = None) -> DataFrame:
    """The same as a stream of files in a folder; a rotated log is simply the next file."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return standardize.joinable_alerts(reader.text(folder), "value", year)


def stream_flows(spark: SparkSession, folder: str, fmt: str = "parquet", schema: T.StructType = FLOW, files_per_trigger: int | None = None) -> DataFrame:
    """Completed flows as a stream of files."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.format(fmt).load(folder)


def flows_from_records(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """Connections an analyst typed in, as features. Seconds become milliseconds, the protocol name its number."""
    numbers = {v.lower(): k for k, v in fixed.KEY_PROTOCOLS.items()}
    shape = ", ".join(f"{f} string" for f in fixed.MANUAL_FIELDS)
    text = [tuple(None if r.get(f) is None else str(r[f]) for f in fixed.MANUAL_FIELDS) for r in rows]
    return manual_features(spark.createDataFrame(text, shape), numbers)


def manual_features(df: DataFrame, numbers: dict[str, int] | None = None) -> DataFrame:
    """Short-form connection fields to the ordered features; fields nobody knows give 0."""
    numbers = numbers or {v.lower(): k for k, v in fixed.KEY_PROTOCOLS.items()}
    proto = F.col("proto").try_cast("int")
    for name, value in numbers.items():
        proto = F.when(F.lower("proto") == name, value).otherwise(proto)
    d = df.withColumns({"proto": proto, "dur": F.col("dur").try_cast("double") * 1000.0})
    return standardize.ensure_features(standardize.clean(standardize.renamed(d, fixed.MANUAL_NAMES)), keep=["srcip", "dstip", "sport"])


def read_attack_kb(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge-base document to one row per category."""
    category = "struct<description:string,tactics:array<struct<id:string,name:string,techniques:array<struct<id:string,name:string,url:string>>>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"mappings map<string,{category}>").alias("d"))
    rows = doc.select(F.explode("d.mappings").alias("category", "v")).select("category", "v.description", "v.tactics")
    return rows.select("category", F.coalesce("description", F.lit("")).alias("description"), F.col("tactics").cast(enrich.KB_SCHEMA["tactics"].dataType).alias("tactics"))


def attack_windows(df: DataFrame, tz_offset_hours: int) -> DataFrame:
    """Schedule rows (name, day, start, end as local clock times) with epoch bounds; rows keep their order ``ord``."""
    def epoch(clock: str):
        local = F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.col(clock)))
        return F.unix_millis(local - F.make_interval(hours=F.lit(tz_offset_hours)))

    return df.withColumns({"start_ms": epoch("start"), "end_ms": epoch("end")})
