"""Writing the queue, logs and exports. Every sink writes files in parallel; none gathers rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import fixed
from flowsieve.operators import enrich, standardize


def append_predictions(df: DataFrame, path: str, as_of: Column, batch_id: int | str | None = None) -> None:
    """Appends queue rows to the table, in folders by day of the flow and, inside them, by batch.

    With a ``batch_id`` the rows replace what an earlier attempt of that batch left in the same days, so a retried batch is stored once. Without one the rows get a batch name of their own.
    A query on some days opens their folders only; ``compact_day`` puts the batches of a day together.
    """
    d = standardize.queue_defaults(df, as_of)
    if "first_seen_at" not in d.columns:
        d = d.withColumn("first_seen_at", as_of)
    name = str(batch_id) if batch_id is not None else f"a{uuid.uuid4().hex}"
    d = d.withColumns({"flow_date": F.to_date("flow_timestamp"), "batch": F.lit(name)})
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("flow_date", "batch").parquet(path)


def _files(spark: SparkSession, pattern: str) -> tuple[list, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath() for s in fs.globStatus(p) or ()], fs


def _lines(spark: SparkSession, path) -> list[str]:
    """The lines of a small file whose name Spark's readers leave out."""
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return list(iter(reader.readLine, None))
    finally:
        stream.close()


def read_stored(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The stored queue, of some days (ISO dates, ends included) if given. Batches that a compaction has taken in and not removed yet are left out."""
    rows = spark.read.option("recursiveFileLookup", False).schema(_stored_schema(spark, path)).parquet(path)
    if since:
        rows = rows.filter(F.col("flow_date") >= F.lit(since).cast("date"))
    if until:
        rows = rows.filter(F.col("flow_date") <= F.lit(until).cast("date"))
    for mark in _files(spark, f"{path}/flow_date=*/batch=c*/_taken")[0]:
        day = mark.getParent().getParent().getName().removeprefix("flow_date=")
        taken = _lines(spark, mark)
        rows = rows.filter(~((F.col("flow_date") == F.lit(day).cast("date")) & F.col("batch").isin(taken)))
    return rows.drop("batch")


def _stored_schema(spark: SparkSession, path: str) -> T.StructType:
    found = spark.read.parquet(path).schema
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name == "batch" else f for f in found.fields])


def compact_day(spark: SparkSession, path: str, day: str, files: int = 1) -> int:
    """Puts all batches of a day together in ``files`` files and removes them; returns how many there were. It can be repeated after an interruption: until the list of what it
    has taken in stands beside the new files, readers use the old ones, from then on the new ones. Batches that come meanwhile are left alone."""
    folder = f"{path}/flow_date={day}"
    found, fs = _files(spark, f"{folder}/batch=*")
    names = {p.getName().removeprefix("batch="): p for p in found}
    for name, p in list(names.items()):
        if name.startswith("c"):
            mark = spark._jvm.org.apache.hadoop.fs.Path(p, "_taken")
            if fs.exists(mark):
                for old in _lines(spark, mark):  # an earlier run's leftovers
                    if old in names:
                        fs.delete(names.pop(old), True)
            else:  # not completed
                fs.delete(names.pop(name), True)
    if len(names) < 2:
        return len(names)
    new = f"{folder}/batch=c{uuid.uuid4().hex}"
    spark.read.parquet(*[p.toString() for p in names.values()]).coalesce(files).write.parquet(f"{path}/_new/{new.rsplit('=', 1)[1]}")
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_new/{new.rsplit('=', 1)[1]}")
    out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_new/{new.rsplit('=', 1)[1]}/_taken"))
    out.write(bytearray("\n".join(sorted(names)).encode()))
    out.close()
    fs.rename(made, spark._jvm.org.apache.hadoop.fs.Path(new))  # files and list appear together
    for p in names.values():
        fs.delete(p, True)
    return len(names)


def append_live(events: DataFrame, path: str, as_of: Column, batch_id: int) -> None:
    """Appends live events that are not benign and have an id."""
    keep = (F.lower(F.coalesce("source", F.lit(""))) != "benign") & (F.coalesce("id", F.lit("")) != "")
    append_predictions(standardize.live_to_queue(events.filter(keep)), path, as_of, batch_id)


def session_log_rows(events: DataFrame) -> DataFrame:
    """Live events as flat session-log rows: empty text where a value is missing."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    source = {"verdict": "source", "leaf": "attack_type"}
    cols = []
    for name in fixed.SESSION_LOG_COLUMNS:
        if name == "mitre_tactic":
            cols.append((enrich.first_tactic("mitre") if "mitre" in events.columns else F.lit("")).alias(name))
        elif name == "snort_sid":
            cols.append(F.coalesce(F.nullif(F.col(name), F.lit(0)).cast("string"), F.lit("")).alias(name))
        else:
            cols.append(text(source.get(name, name)).alias(name))
    return events.select(*cols)


def write_session_log(events: DataFrame, folder: str, batch_id: int) -> None:
    """One batch of the session log: flat CSV and complete JSON lines, both gzipped, since the lines repeat the attack knowledge; a retry replaces its own files."""
    session_log_rows(events).write.mode("overwrite").option("emptyValue", "").option("compression", "gzip").csv(f"{folder}/csv/batch={batch_id}", header=True)
    events.write.mode("overwrite").option("compression", "gzip").json(f"{folder}/ndjson/batch={batch_id}")


def export_rows(df: DataFrame) -> DataFrame:
    """The analyst's export columns; confidence with two decimals, missing severity ``N/A``."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    values = [
        F.date_format("flow_timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.col("source_ip"), F.col("destination_ip"), F.col("source_port"),
        F.col("destination_port"), F.col("protocol"), F.col("packet_size"), F.col("duration"), F.col("prediction"), blank("family"),
        blank("attack_type"), blank("source"), F.round(F.col("confidence").cast("decimal(24,12)"), 2).cast("decimal(10,2)").cast("string"),
        F.coalesce(F.nullif("severity", F.lit("")), F.lit("N/A")), blank("snort_sid"), blank("snort_msg"), F.coalesce("ack_state", F.lit("new")),
    ]
    return df.select(*[v.alias(n) for v, n in zip(values, fixed.EXPORT_COLUMNS)])


def export_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def export_json(df: DataFrame, path: str) -> None:
    """Summary rows as JSON lines."""
    standardize.summary_view(df).write.mode("overwrite").json(path)


def traffic_log_rows(df: DataFrame) -> DataFrame:
    """The fixed traffic-log columns; absent ones are empty, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c) for c in fixed.TRAFFIC_LOG_COLUMNS])


def write_traffic_log(df: DataFrame, path: str) -> None:
    traffic_log_rows(df).write.mode("append").option("emptyValue", "").csv(path, header=True)


def write_rule_hits(judged: DataFrame, path: str, batch_id: int) -> None:
    """How many rows of a batch each rule suppressed; a repeated batch replaces its own file. ``judged`` has the column ``rule`` of ``match_rules``."""
    hits = judged.filter("rule is not null").groupBy(F.col("rule.id").cast("string").alias("id")).agg(F.count("*").alias("hits"))
    hits.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _form(value: Column, form: str) -> Column:
    """A value of the report as text."""
    if form == "code":
        return F.concat(F.lit("`"), value.cast("string"), F.lit("`"))
    if form == "dash":
        return F.coalesce(value.cast("string"), F.lit("-"))
    if form == "time":
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    if form in ("bytes", "seconds"):
        return F.concat(value.cast("string"), F.lit(" bytes" if form == "bytes" else "s"))
    if form.startswith(("percent", "routing")):
        digits = int(form[-1])
        shown = F.concat(F.round((value * 100).cast("decimal(24,12)"), digits).cast(f"decimal(20,{digits})").cast("string"), F.lit("%"))
        return F.concat(shown, F.lit(" _(routing only)_")) if form.startswith("routing") else shown
    return value.cast("string")


def _listed(heading: str, entries: Column, shown) -> Column:
    return F.when(F.size(entries) > 0, F.concat_ws("\n", F.lit(heading), F.transform(entries, shown)))


def incident_reports(df: DataFrame) -> DataFrame:
    """The report body of each prediction as (id, report), laid out by ``fixed.REPORT_SECTIONS``.

    ``ack_by_name`` is used where present. The activity trail follows as rows of its own (``incident_trail``), because a
    prediction may have any number of changes.
    """
    c, have = F.col, set(df.columns)
    end = lambda side: F.concat(c(f"{side}_ip"), F.lit(":"), c(f"{side}_port"))
    derived = {"from": end("source"), "to": end("destination"), "key": F.concat(end("source"), F.lit("-"), end("destination"), F.lit("-"), c("protocol")),
               "source or unknown": F.coalesce("source", F.lit("unknown")), "state or new": F.coalesce("ack_state", F.lit("new"))}
    parts: list[Column] = [F.concat(F.lit(fixed.REPORT_TITLE), F.coalesce("attack_type", "prediction"))]
    for heading, needs, lines in fixed.REPORT_SECTIONS:
        there = F.lit(True) if needs is None else c(needs).isNotNull() if needs == "mitre" else F.coalesce(c(needs), F.lit("")) != ""
        for text in ([""] if heading is None else ["", heading, ""]):
            parts.append(F.when(there, F.lit(text)))
        for label, name, form in lines:
            if name not in derived and name not in have:
                continue
            value = derived.get(name, c(name) if name in have else None)
            shown = F.concat(F.lit(f"- **{label}:** "), _form(value, form))
            blank = F.lit(False) if not name.startswith("snort_") else value.cast("string").isin("", "0")
            parts.append(F.when(there & ~F.coalesce(blank, F.lit(True)), shown))
        if needs == "mitre":
            parts.append(_listed("**Tactics:**", c("mitre")["tactics"], lambda t: F.concat(F.lit("- "), t["name"], F.lit(" ("), t["id"], F.lit(")"))))
            techniques = _listed("**Techniques:**", c("mitre")["techniques"], lambda t: F.concat(F.lit("- ["), t["id"], F.lit("] "), t["name"], F.lit(" — "), t["url"]))
            parts.append(F.concat(F.lit("\n"), techniques))
    return df.select("id", F.concat_ws("\n", *parts).alias("report"))


def incident_trail(trail: DataFrame) -> DataFrame:
    """Lines of the activity trail (id, changed_at, line) from ``with_ack_trail`` rows."""
    note = F.when(F.coalesce("change_note", F.lit("")) != "", F.concat(F.lit(" — "), F.col("change_note"))).otherwise(F.lit(""))
    text = F.concat(
        F.lit("- "), F.coalesce("changed_by", F.lit("unknown")), F.lit(": "), F.col("from_state"), F.lit(" → "), F.col("to_state"),
        F.lit(" ("), F.date_format("changed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(")"), note)
    return trail.filter("change_id is not null").select("id", "changed_at", "change_id", text.alias("line"))


def write_reports(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").option("lineSep", "\n\n").text(path)
