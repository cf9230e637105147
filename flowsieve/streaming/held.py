"""Micro-batch jobs on event time whose state is a table in the shared folder.

A batch's rows and what earlier batches left undecided are worked on together by ordinary DataFrame operators, so hot keys are split as in batch jobs and no key is bound to one task.
The result is one table per batch: rows with ``_done`` are the batch's output, the others are what the next batch starts from. A repeated batch reads the same table of the batch
before and replaces its own, so interrupted attempts leave nothing behind. Rows the watermark has passed before they came are not lost: they go to the sink on their own.

When a stream has stopped for good, ``finish`` decides what is still held, without closing rows in the input.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Rows to be decided, and the watermark in milliseconds (None: nothing is final yet; END: everything is) → the same rows decided, with ``_done``.
Decide = Callable[[DataFrame, int | None], DataFrame]
#: Output rows of a batch, rows that came too late (or None), number of the batch.
Store = Callable[[DataFrame, DataFrame | None, int], None]
END = 1 << 62


class HeldRows:
    """The tables of one job. Rows of the stream have ``_t`` (event time in milliseconds) and ``_side``; the watermark follows the slowest of ``sides``; rows without a time are never late. ``fold`` turns them into the rows
    that are held, if those differ."""

    def __init__(self, spark: SparkSession, folder: str, sides: tuple[str, ...], lateness_ms: int, decide: Decide, store: Store, fold: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.folder, self.sides, self.lateness_ms = spark, folder.rstrip("/"), sides, lateness_ms
        self.decide, self.store, self.fold = decide, store, fold or (lambda rows: rows)

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _has(self, name: str) -> bool:
        p, fs = self._path(f"{name}/_SUCCESS")
        return fs.exists(p)

    def _marks(self, batch_id: int) -> dict:
        """Latest time of each side up to a batch."""
        if batch_id < 0:
            return dict.fromkeys(self.sides)
        p, fs = self._path(f"marks/batch={batch_id}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.java.io.BufferedReader(self.spark._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
        finally:
            stream.close()

    def _put_marks(self, batch_id: int, marks: dict) -> None:
        p, fs = self._path(f"marks/batch={batch_id}")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(marks).encode()))
        out.close()

    def _watermark(self, marks: dict) -> int | None:
        return None if any(v is None for v in marks.values()) else min(marks.values()) - self.lateness_ms

    def _rows(self, batch_id: int, done: bool, spark: SparkSession | None = None) -> DataFrame:
        rows = (spark or self.spark).read.parquet(f"{self.folder}/rows/batch={batch_id}")
        return rows.filter("_done" if done else "NOT _done").drop("_done")

    def _put_by(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows as a table: a few times smaller on disk than what Spark persists, as nested columns are compressed too."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.folder}/{name}")

    def _late(self, batch_id: int) -> DataFrame | None:
        """Rows of a batch that came too late, kept because ``finish`` stores the last batch once more."""
        name = f"late/batch={batch_id}"
        return self.spark.read.parquet(f"{self.folder}/{name}") if self._has(name) else None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        before = self._marks(batch_id - 1)
        known = self._watermark(before)
        late = F.lit(False) if known is None else F.coalesce(F.col("_t") < known, F.lit(False))
        batch = self._put_by(batch, f"in/batch={batch_id}")
        try:
            seen = batch.agg(*[F.max(F.when(F.col("_side") == s, F.col("_t"))).alias(s) for s in self.sides], F.count_if(late).alias("_late")).first()
            marks = {s: max((v for v in (before[s], seen[s]) if v is not None), default=None) for s in self.sides}
            rows = self.fold(batch.filter(~late))
            if batch_id and not self._has(f"drained/batch={batch_id - 1}"):
                rows = rows.unionByName(self._rows(batch_id - 1, False, batch.sparkSession))
            self.decide(rows, self._watermark(marks)).write.mode("overwrite").parquet(f"{self.folder}/rows/batch={batch_id}")
            if seen["_late"]:
                batch.filter(late).write.mode("overwrite").parquet(f"{self.folder}/late/batch={batch_id}")
            self._put_marks(batch_id, marks)
            self.store(self._rows(batch_id, True), self._late(batch_id), batch_id)
        finally:
            p, fs = self._path(f"in/batch={batch_id}")
            fs.delete(p, True)

    def finish(self) -> None:
        """Decides all that is still held and stores it with the last batch, whose output is replaced and whose late rows stay. A later start of the stream begins with nothing held."""
        p, fs = self._path("marks")
        if not fs.exists(p):
            return
        last = max(int(s.getPath().getName().removeprefix("batch=")) for s in fs.listStatus(p))
        if not self._has(f"drained/batch={last}"):
            self.decide(self._rows(last, False), END).filter("_done").drop("_done").write.mode("overwrite").parquet(f"{self.folder}/drained/batch={last}")
        drained = self.spark.read.parquet(f"{self.folder}/drained/batch={last}")
        self.store(self._rows(last, True).unionByName(drained), self._late(last), last)

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """``trigger`` defaults to a batch a second; ``{"availableNow": True}`` works on all there is and stops."""
        writer = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
