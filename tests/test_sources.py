"""Reading and writing files."""

import datetime as dt
import gzip
import json
import shutil

import pytest
from pyspark.sql import functions as F

from flowsieve import fixed
from flowsieve.operators import enrich, packets as K, standardize as Z, triage
from flowsieve.plans import driver_tables as D
from flowsieve.sources import readers, sinks


def test_flow_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow Duration ,Dst Port, Source IP\n12,80,1.1.1.1\nInfinity,abc,2.2.2.2\n")
    df = readers.read_flow_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Flow Duration", "Dst Port", "Source IP"]
    got = Z.ensure_features(Z.clean(df), keep=["Source IP"]).orderBy("Source IP").collect()
    assert [r["Flow Duration"] for r in got] == [12.0, 0.0] and got[0]["Dst Port"] == 80 and len(got[0]) == 71 and got[0]["Idle Max"] == 0


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_flow_records_round_trip(spark, sf, tmp_path, fmt):
    f = K.build_flows(D.packets(spark, sf), active_ms=None, close_on_flags=False)
    f = f.select(*[F.col(x.name).cast(x.dataType) for x in readers.FLOW.fields])
    path = str(tmp_path / fmt)
    writer = f.write.option("header", True) if fmt == "csv" else f.write
    writer.format(fmt).save(path)
    back = readers.read_flow_records(spark, path, fmt)
    assert back.columns == [x.name for x in readers.FLOW.fields] and len(back.columns) == 56
    assert back.agg(F.sum("bidirectional_bytes")).first() == f.agg(F.sum("bidirectional_bytes")).first()
    assert back.exceptAll(f).count() == 0
    assert "Down/Up Ratio" in Z.to_features(back).columns


def test_corpus_conversion(spark, tmp_path):
    good = tmp_path / "monday.csv"
    good.write_text(" Destination Port,Flow Duration,Fwd Header Length,Fwd Header Length.1,Other, Label\n80,1.5,20,99,x,BENIGN\n443,Infinity,40,98,y,Bot\n7,too,many,cells,in,this,line\n21\n22,abc,60,97,z,DoS Hulk\n")
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    out = str(tmp_path / "out")
    paths = [str(good), str(tmp_path / "none.csv")]
    assert readers.corpus_to_parquet(spark, paths, out) == [f"{out}/monday.parquet"]
    df = spark.read.parquet(f"{out}/monday.parquet")
    assert dict(df.dtypes) == {"Dst Port": "float", "Flow Duration": "float", "Fwd Header Length": "float", "Label": "string"}
    rows = [tuple(r) for r in df.select("Dst Port", "Fwd Header Length", "Label").orderBy("Dst Port").collect()]
    assert rows == [(21.0, None, None), (22.0, 60.0, "DoS Hulk"), (80.0, 20.0, "BENIGN"), (443.0, 40.0, "Bot")]
    good.write_text("changed\n")
    assert readers.corpus_to_parquet(spark, [str(good)], out) == [f"{out}/monday.parquet"] and spark.read.parquet(f"{out}/monday.parquet").count() == 4


def test_alert_file(spark, tmp_path):
    (tmp_path / "alerts.json").write_text('{"src_addr":"1.1.1.1","src_port":5,"dst_addr":"2.2.2.2","dst_port":80,"proto":"TCP","sid":7}\nnot json\n\n')
    got = readers.read_alerts(spark, str(tmp_path / "alerts.json")).collect()
    assert len(got) == 1 and got[0].flow_key == "1.1.1.1:5-2.2.2.2:80-TCP"


def test_manual_records(spark):
    got = readers.flows_from_records(spark, [{"proto": "tcp", "dsport": 443, "dur": 1.5, "sbytes": 100, "spkts": 3, "srcip": "1.1.1.1"}, {"proto": "17"}]).collect()
    assert (got[0]["Protocol"], got[0]["Dst Port"], got[0]["Flow Duration"], got[0]["Subflow Fwd Bytes"], got[0]["Subflow Fwd Packets"]) == (6, 443, 1500, 100, 3)
    assert got[1]["Protocol"] == 17 and got[1]["Flow Duration"] == 0 and len(got[0]) == 73


def test_knowledge_base_file(spark, tmp_path):
    doc = {"version": "1", "mappings": {c: {"description": t, "tactics": [{"id": i, "name": n, "techniques": [{"id": k, "name": m, "url": fixed.technique_url(k)} for k, m in ks]} for i, n, ks in ts]} for c, t, ts in fixed.ATTACK_KB}}
    (tmp_path / "kb.json").write_text(json.dumps(doc, indent=1))
    read = readers.read_attack_kb(spark, str(tmp_path / "kb.json"))
    assert sorted(map(str, read.collect())) == sorted(map(str, enrich.default_kb(spark).collect()))


def test_queue_table_is_partitioned_and_batches_are_stored_once(spark, sf, tmp_path):
    rows = D.fresh_predictions(spark, sf)
    path = str(tmp_path / "q")
    for _ in range(2):
        sinks.append_predictions(rows, path, D.as_of(), batch_id=3)
    back = sinks.read_stored(spark, path)
    assert back.count() == rows.count()
    assert back.filter("snort_sid = 0 or snort_msg = ''").count() == 0 and back.filter("snort_sid is null").count() > 0
    kept = triage.retain_days(back, 5, D.as_of())
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flow_date" in plan
    plain = str(tmp_path / "plain")
    for _ in range(2):
        sinks.append_predictions(rows, plain, D.as_of())
    assert spark.read.parquet(plain).count() == 2 * rows.count()


def test_exports(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 10)
    row = ("p1", t, "1.1.1.1", "2.2.2.2", 1, 2, "TCP", 10, 1.5, "Malicious", "DoS", "DoS-Hulk", "confirmed", 0.125, None, 7, 'say "hi", you', None)
    df = spark.createDataFrame([row], "id string, flow_timestamp timestamp, source_ip string, destination_ip string, source_port int, destination_port int, protocol string, packet_size int, duration double, prediction string, family string, attack_type string, source string, confidence double, severity string, snort_sid int, snort_msg string, ack_state string").coalesce(1)
    sinks.export_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == ",".join(fixed.EXPORT_COLUMNS)
    assert text[1] == '2024-01-01T10:00:00,1.1.1.1,2.2.2.2,1,2,TCP,10,1.5,Malicious,DoS,DoS-Hulk,confirmed,0.13,N/A,7,"say ""hi"", you",new'
    sinks.export_json(df.withColumn("mitre", F.lit(None).cast("struct<confidence_band:string,tactics:array<string>,unmapped:boolean,attack_type:string,description:string>")), str(tmp_path / "json"))
    got = json.loads(next((tmp_path / "json").glob("*.json")).read_text())
    assert got["sourceIp"] == "1.1.1.1" and "stage2_probs" not in got


def test_incident_report(spark, sf, tmp_path):
    p = D.predictions(spark, sf).filter("mitre is not null and snort_sid <> 0 and ack_state <> 'new'")
    r = sinks.incident_reports(enrich.with_usernames(p, D.users(spark, sf)))
    text = r.orderBy("id").first().report
    for part in ("# Incident Report", "## Flow", "## Model output", "## Snort signature", "## MITRE ATT&CK", "**Techniques:**", "## Acknowledgement", "- **By:**", "- **Acknowledged at:**"):
        assert part in text
    sinks.write_reports(r, str(tmp_path / "r"))
    assert any((tmp_path / "r").glob("*.txt"))


def test_traffic_log(spark, tmp_path):
    df = spark.createDataFrame([("1.1.1.1", 5, "drop me")], "src_ip string, sport int, extra string").coalesce(1)
    sinks.write_traffic_log(df, str(tmp_path / "t"))
    lines = next((tmp_path / "t").glob("*.csv")).read_text().splitlines()
    assert lines[0].split(",") == fixed.TRAFFIC_LOG_COLUMNS and lines[1].count(",") == 34 and lines[1].startswith(",1.1.1.1,,5")


def test_attack_window_offset(spark):
    df = spark.createDataFrame([(0, "a", dt.date(2017, 7, 5), "09:47:00", "10:10:00")], "ord int, name string, day date, start string, end string")
    r = readers.attack_windows(df, -3).first()
    assert r.start_ms == int(dt.datetime(2017, 7, 5, 12, 47, tzinfo=dt.timezone.utc).timestamp() * 1000) and r.end_ms - r.start_ms == 23 * 60_000


def test_days_are_put_together_and_interrupted_runs_repaired(spark, sf, tmp_path):
    path, rows = str(tmp_path / "q"), D.fresh_predictions(spark, sf)
    o = F.substring_index("id", "_", -1).cast("long")
    for k in range(3):
        sinks.append_predictions(rows.filter(o % 3 == k), path, D.as_of(), batch_id=k)
    sinks.append_predictions(rows.filter(o % 3 == 1), path, D.as_of(), batch_id=1)
    ids = lambda: sorted(r.id for r in sinks.read_stored(spark, path).select("id").collect())
    want = sorted(r.id for r in rows.select("id").collect())
    assert ids() == want
    folder = next(p for p in (tmp_path / "q").glob("flow_date=*") if len(list(p.iterdir())) == 3)
    day = folder.name.removeprefix("flow_date=")
    kept = tmp_path / "kept"
    shutil.copytree(folder / "batch=2", kept)
    assert sinks.compact_day(spark, path, day) == 3 and [p.name for p in folder.iterdir()][0].startswith("batch=c") and len(list(folder.iterdir())) == 1
    assert ids() == want
    # interrupted between the list and the removal: the old batch is there again, readers leave it out, the next run removes it
    shutil.copytree(kept, folder / "batch=2")
    assert ids() == want
    sinks.compact_day(spark, path, day)
    assert len(list(folder.iterdir())) == 1 and ids() == want
    week = sinks.read_stored(spark, path, "2024-01-08", "2024-01-14")
    text = week._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "flow_date" in text.split("PartitionFilters: [")[1][:120]
    assert week.count() == rows.filter("to_date(flow_timestamp) BETWEEN '2024-01-08' AND '2024-01-14'").count()
    assert sinks.compact_day(spark, path, "1999-01-01") == 0


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.csv").write_text(" Flow Duration,Label\n77,Bot\n")
    (d / "b.csv").write_text('"Label",Flow Duration,Dst Port\nBENIGN,5,80\n"x, y",6,81\n')
    (d / "c.csv").write_text("")
    (d / "d e.csv").write_text("\nFlow Duration,Label,Label\r\n8,Bot,second\r\n")
    with gzip.open(d / "f.csv.gz", "wt") as f:
        f.write("Dst Port,Label,Flow Duration\n443,DDoS,9\n")
    got = sorted((r["Flow Duration"], r["Label"], r["Dst Port"]) for r in readers.read_flow_csv(spark, str(d)).collect())
    assert got == [("5", "BENIGN", "80"), ("6", "x, y", "81"), ("77", "Bot", None), ("8", "Bot", None), ("9", "DDoS", "443")]
    out = readers.corpus_to_parquet(spark, [str(d)], str(tmp_path / "out"))
    corpus = sorted((r["Flow Duration"], r["Label"]) for r in spark.read.parquet(*out).collect())
    assert corpus == [(5.0, "BENIGN"), (6.0, "x, y"), (8.0, "Bot"), (9.0, "DDoS"), (77.0, "Bot")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("")
    assert readers.read_flow_csv(spark, str(tmp_path / "none")).columns == []
