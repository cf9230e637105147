"""Bringing flow records of any vocabulary to the model's features, and model output to queue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.functions import times as TM
from flowsieve.operators import enrich
from flowsieve.operators.distributed import previous_by_time
from flowsieve.session import literal_table


def _q(name: str) -> Column:
    """Column by its exact name, dots and slashes included."""
    return F.col(f"`{name}`")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One projection that renames columns; of several that end up with the same name the first one stays."""
    seen, out = set(), []
    for c in df.columns:
        target = names.get(c, c)
        if target not in seen:
            seen.add(target)
            out.append(_q(c).alias(target))
    return df.select(*out)


def normalize_columns(df: DataFrame, year: int | None = None) -> DataFrame:
    """Canonical column names of a labelled corpus: blanks trimmed, aliases of that year and of all years applied."""
    aliases = {**fixed.CORPUS_ALIASES, **(fixed.CORPUS_ALIASES_2017 if year == 2017 else {})}
    return renamed(df, {c: aliases.get(c.strip(), c.strip()).strip() for c in df.columns})


def number(c: Column) -> Column:
    """Any value as a finite double; text that is no number, null, NaN and infinities become 0."""
    v = c.cast("string").try_cast("double") if isinstance(c, Column) else c
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def _number_of(df: DataFrame, name: str) -> Column:
    """``number`` without the detour over text for columns that are numbers already."""
    t = df.schema[name].dataType
    c = _q(name)
    if isinstance(t, T.NumericType):
        v = c.cast("double")
        return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)
    return number(c)


def ensure_features(df: DataFrame, features: Sequence[str] = fixed.FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """The ordered features (0 where missing) after the columns in ``keep``."""
    have = set(df.columns)
    return df.select(*[_q(c) for c in keep], *[_q(f) if f in have else F.lit(0.0).alias(f) for f in features])


def clean(df: DataFrame, features: Sequence[str] = fixed.FEATURES) -> DataFrame:
    """Features become finite doubles; null and infinite values of other numeric columns become 0; texts stay."""
    out = []
    for f in df.schema.fields:
        if f.name in features:
            out.append(_number_of(df, f.name).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            bad = _q(f.name).isNull() | F.isnan(_q(f.name)) | (F.abs(_q(f.name)) == float("inf"))
            out.append(F.when(bad, F.lit(0.0)).otherwise(_q(f.name)).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.NumericType):
            out.append(F.coalesce(_q(f.name), F.lit(0).cast(f.dataType)).alias(f.name))
        else:
            out.append(_q(f.name))
    return df.select(*out)


def to_features(df: DataFrame) -> DataFrame:
    """Flow-meter records under feature names, with the features derived from them."""
    return derive_batch(renamed(df, fixed.METER_NAMES), df)


def derive_batch(named: DataFrame, raw: DataFrame) -> DataFrame:
    """Derived features of the batch path; each needs only its own inputs to be there.

    A flow without forward packets divides by 1, and all eight flag totals are counted.
    """
    have = set(named.columns)
    new: dict[str, Column] = {}

    def add(target: str, needs: Sequence[str], value) -> None:
        if all(n in have for n in needs):
            new[target] = value()

    add("Packet Length Variance", ["Packet Length Std"], lambda: _q("Packet Length Std") * _q("Packet Length Std"))
    for target, source in (
        ("Fwd Segment Size Avg", "Fwd Packet Length Mean"), ("Bwd Segment Size Avg", "Bwd Packet Length Mean"),
        ("Average Packet Size", "Packet Length Mean"), ("Fwd Seg Size Min", "Fwd Packet Length Min"),
        ("Fwd Act Data Pkts", "Subflow Fwd Packets"),
        ("Fwd PSH Flags", "src2dst_psh_packets"), ("Bwd PSH Flags", "dst2src_psh_packets"),
        ("Fwd URG Flags", "src2dst_urg_packets"), ("Bwd URG Flags", "dst2src_urg_packets"),
    ):
        add(target, [source], lambda source=source: _q(source))
    for flag in fixed.TCP_FLAGS:
        pair = [f"src2dst_{flag}_packets", f"dst2src_{flag}_packets"]
        add(f"{flag.upper()} Flag Count", pair, lambda pair=pair: _q(pair[0]) + _q(pair[1]))
    for way in ("Fwd", "Bwd"):
        add(f"{way} Header Length", [f"Subflow {way} Packets"], lambda way=way: _q(f"Subflow {way} Packets") * 20)
    fwd = _q("Subflow Fwd Packets")
    add("Down/Up Ratio", ["Subflow Fwd Packets", "Subflow Bwd Packets"],
        lambda: _q("Subflow Bwd Packets") / F.when(fwd == 0, 1).otherwise(fwd))
    kept = [_q(c) for c in named.columns if c not in new]
    return named.select(*kept, *[v.alias(k) for k, v in new.items()])


def derive_live(df: DataFrame) -> DataFrame:
    """Rates, ratio, variance, header bytes and flag totals of the live path, under the names of the flow hash.

    Rates divide by the duration in seconds plus 1e-9; without forward packets the ratio is 0.
    """
    secs = F.coalesce(F.col("bidirectional_duration_ms"), F.lit(0)) / F.lit(1000.0) + F.lit(1e-9)
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    fwd, bwd = z("src2dst_packets"), z("dst2src_packets")
    flags = {
        f"{f}_flag_count": z(f"src2dst_{f}_packets") + z(f"dst2src_{f}_packets") for f in fixed.TCP_FLAGS if f"src2dst_{f}_packets" in df.columns
    }
    return df.withColumns({
        "flow_bytes_per_sec": z("bidirectional_bytes") / secs, "flow_packets_per_sec": z("bidirectional_packets") / secs,
        "fwd_packets_per_sec": fwd / secs, "bwd_packets_per_sec": bwd / secs,
        "down_up_ratio": F.when(fwd > 0, F.try_divide(bwd, fwd)).otherwise(F.lit(0.0)),
        "packet_length_variance": z("bidirectional_stddev_ps") * z("bidirectional_stddev_ps"),
        "fwd_header_length": fwd * 20, "bwd_header_length": bwd * 20,
        **flags,
    })


def derive_flow_features(df: DataFrame, batch: bool = False) -> DataFrame:
    return to_features(df) if batch else derive_live(df)


def short_to_features(df: DataFrame) -> DataFrame:
    """Records of the second-based extractor under feature names, times in milliseconds."""
    scaled = [
        (F.coalesce(_q(c).cast("string").try_cast("double"), F.lit(0.0)) * 1000.0).alias(c) if c in fixed.SHORT_SECONDS else _q(c)
        for c in df.columns
    ]
    return renamed(df.select(*scaled), fixed.SHORT_NAMES)


def hash_to_features(df: DataFrame, features: Sequence[str] = fixed.FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """All-text flow hashes to features: the hash name if it has a value, else the feature name, else 0."""
    have, by_feature = set(df.columns), {v: k for k, v in fixed.HASH_NAMES.items()}

    def value(feature: str) -> Column:
        short = by_feature.get(feature, feature)
        options = []
        if short in have:
            options.append(F.nullif(_q(short).cast("string"), F.lit("")))
        if feature in have and feature != short:
            options.append(_q(feature).cast("string"))
        return number(F.coalesce(*options, F.lit("0"))).alias(feature)

    return df.select(*[_q(c) for c in keep], *[value(f) for f in features])


def connection_state(protocol: Column, src_flags: Column, dst_flags: Column) -> Column:
    """State of a connection from the flags both sides sent."""
    fin, syn, rst, ack = 1, 2, 4, 16
    on = lambda c, bit: c.bitwiseAND(F.lit(bit)) != 0
    return (
        F.when(protocol != 6, "CON")
        .when(on(src_flags, rst) | on(dst_flags, rst), "RST")
        .when(on(src_flags, fin) & on(dst_flags, fin), "FIN")
        .when(on(src_flags, syn) & on(dst_flags, syn) & on(dst_flags, ack), "CON")
        .when(on(src_flags, syn) & ~on(dst_flags, syn), "REQ")
        .otherwise("CON")
    )


def connection_state_by_bytes(protocol: Column, src_bytes: Column, dst_bytes: Column) -> Column:
    return (
        F.when(protocol.isin(17, 1), "CON").when((src_bytes > 0) & (dst_bytes > 0), "CON")
        .when(src_bytes > 0, "REQ").otherwise("INT")
    )


def derive_conn_features(df: DataFrame) -> DataFrame:
    """Load in bits per second, mean packet sizes, handshake times and state of short connection records.

    Needs dur (seconds), sbytes, dbytes, spkts, dpkts, proto; handshake times and flags are used where present.
    """
    have = set(df.columns)
    ratio = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))
    c = F.col
    new = {
        "sload": ratio(c("sbytes") * 8, c("dur")), "dload": ratio(c("dbytes") * 8, c("dur")),
        "smeansz": ratio(c("sbytes"), c("spkts")), "dmeansz": ratio(c("dbytes"), c("dpkts")),
    }
    if {"syn_time", "synack_time", "ack_time"} <= have:
        new["synack"] = c("synack_time") - c("syn_time")
        new["ackdat"] = c("ack_time") - c("synack_time")
        new["tcprtt"] = (c("synack_time") - c("syn_time")) + (c("ack_time") - c("synack_time"))
    if {"src_flags", "dst_flags"} <= have:
        new["state"] = connection_state(c("proto"), c("src_flags"), c("dst_flags"))
    else:
        new["state"] = connection_state_by_bytes(c("proto"), c("sbytes"), c("dbytes"))
    return df.withColumns(new)


def jitter(packets: DataFrame, keys: Sequence[str], ts: str = "ts_ms", tie: Sequence[str] = ()) -> DataFrame:
    """Mean absolute change between successive gaps of a key in milliseconds, 0 below three packets."""
    one = previous_by_time(packets.select(*keys, ts, *tie), keys, ts, [ts], tie)
    two = previous_by_time(one, keys, ts, [f"prev_{ts}"], tie)
    change = F.abs((F.col(ts) - F.col(f"prev_{ts}")) - (F.col(f"prev_{ts}") - F.col(f"prev_prev_{ts}")))
    total, n = F.sum(change), F.count(change)
    return two.groupBy(*keys).agg(F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0)).alias("jitter_ms"))


# ---- queue rows ---------------------------------------------------------------------------------------------------

def first_of(df: DataFrame, names: Sequence[str], default) -> Column:
    """First non-null of the columns in ``names`` that exist; NaN counts as missing."""
    have = {f.name: f.dataType for f in df.schema.fields}
    found = [
        F.nanvl(_q(n), F.lit(None).cast("double")) if isinstance(have[n], (T.DoubleType, T.FloatType)) else _q(n)
        for n in names if n in have
    ]
    last = F.lit(default)
    if len({type(have[n]) for n in names if n in have}) > 1:
        found, last = [c.cast("string") for c in found], last.cast("string")
    return F.coalesce(*found, last)


def event_time(df: DataFrame, as_of: Column, day_first: bool = True) -> Column:
    """Time of a flow: first-seen milliseconds if positive, else the timestamp column, else ``as_of``. Dates with slashes are read day first, as the corpora
    write them; with ``day_first=False`` month first."""
    options = []
    if "bidirectional_first_seen_ms" in df.columns:
        ms = _q("bidirectional_first_seen_ms").cast("string").try_cast("double")
        options.append(F.when(ms > 0, F.timestamp_millis(ms.cast("long"))))
    text = [n for n in ("Timestamp", "timestamp") if n in df.columns]
    if text:
        options.append(TM.parse_any(F.coalesce(*[_q(n).cast("string") for n in text]), day_first))
    return F.coalesce(*options, as_of)


def display_protocol(df: DataFrame) -> Column:
    named = F.nullif(first_of(df, ["protocol_name"], None).cast("string"), F.lit(""))
    usable = F.when(~named.isin("nan", "0"), named)
    return F.coalesce(usable, N.protocol_name(first_of(df, ["Protocol", "protocol"], None).cast("string"), wide=True))


ML_FEATURE_NAMES = ["sbytes", "dbytes", "dur", "spkts", "dpkts", "sload", "dload", "ct_srv_dst", "sttl", "dttl"]


def format_predictions(judged: DataFrame, kb: DataFrame, as_of: Column, model_version: str, id_column: str = "flow_id") -> DataFrame:
    """Queue rows from flows that were scored, correlated (struct ``alert``) and judged, attack knowledge included."""
    d = judged
    alert = F.col("alert")
    have = set(d.columns)
    features = []
    for n in ML_FEATURE_NAMES:
        features += [F.lit(n), F.coalesce(_q(n).cast("double"), F.lit(0.0)) if n in have else F.lit(0.0)]
    rows = d.select(
        _q(id_column).alias("id"), event_time(d, as_of).alias("flow_timestamp"),
        first_of(d, ["src_ip", "Source IP", "Src IP"], "N/A").cast("string").alias("source_ip"),
        first_of(d, ["dst_ip", "Destination IP", "Dst IP"], "N/A").cast("string").alias("destination_ip"),
        first_of(d, ["src_port", "Source Port", "Src Port"], 0).cast("int").alias("source_port"),
        first_of(d, ["Dst Port", "dst_port", "Destination Port"], 0).cast("int").alias("destination_port"),
        display_protocol(d).alias("protocol"),
        first_of(d, ["bidirectional_bytes", "Total Length of Fwd Packets"], 0).cast("double").cast("int").alias("packet_size"),
        first_of(d, ["Flow Duration", "bidirectional_duration_ms", "duration"], 0).cast("double").alias("duration"),
        "prediction", "attack_type", "family", F.col("attack_type").alias("subtype"), "confidence", "severity",
        "stage1_p", "stage2_p", "stage3_p", "stage2_probs", "stage3_probs",
        F.create_map(*features).alias("ml_features"), "source", F.lit(model_version).alias("model_version"),
        F.coalesce(alert["snort_msg"], F.lit("")).alias("snort_msg"),
        F.coalesce(alert["snort_sid"], F.lit(0)).alias("snort_sid"),
        F.coalesce(alert["snort_classtype"], F.lit("")).alias("snort_classtype"),
        F.coalesce(alert["snort_priority"], F.lit(0)).alias("snort_priority"),
        F.lit("new").alias("ack_state"), F.lit(None).cast("timestamp").alias("ack_at"), F.lit(None).cast("string").alias("ack_note"),
    )
    return enrich.enrich_attack(rows, kb)


def queue_defaults(df: DataFrame, as_of: Column) -> DataFrame:
    """Nulls and defaults a queue row gets when it is stored: empty alert fields become null, missing basics their default."""
    fill = {
        "source_ip": "N/A", "destination_ip": "N/A", "source_port": 0, "destination_port": 0, "protocol": "N/A",
        "packet_size": 0, "duration": 0.0, "prediction": "Normal", "confidence": 0.0, "ack_state": "new",
    }
    new = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in fill.items() if c in df.columns}
    for c in ("source_ip", "destination_ip", "protocol", "prediction", "ack_state"):
        if c in df.columns:
            new[c] = F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(fill[c]))
    new["flow_timestamp"] = F.coalesce(F.col("flow_timestamp"), as_of)
    for c in ("snort_msg", "snort_classtype"):
        new[c] = F.nullif(F.col(c), F.lit(""))
    for c in ("snort_sid", "snort_priority"):
        new[c] = F.nullif(F.col(c), F.lit(0))
    return df.withColumns(new)


FULL_NAMES = {
    "flow_timestamp": "timestamp", "first_seen_at": "firstSeenAt", "source_ip": "sourceIp", "destination_ip": "destinationIp",
    "source_port": "sourcePort", "destination_port": "destinationPort", "packet_size": "packetSize", "ml_features": "mlFeatures",
}
HEAVY = ("stage2_probs", "stage3_probs", "ml_features", "first_seen_at")


def full_view(df: DataFrame) -> DataFrame:
    """Everything of a queue row under the names readers use; missing alert fields are empty."""
    blank = {"snort_msg": "", "snort_classtype": "", "snort_sid": 0, "snort_priority": 0}
    return df.select(*[
        (F.coalesce(F.col(c), F.lit(blank[c])) if c in blank else F.col(c)).alias(FULL_NAMES.get(c, c)) for c in df.columns
    ])


def summary_view(df: DataFrame) -> DataFrame:
    """The list form: no probability maps and features, and of the attack knowledge only band and tactics."""
    slim = df.select(*[c for c in df.columns if c not in HEAVY])
    if "mitre" in slim.columns:
        m = F.col("mitre")
        short = F.struct(*[m[n].alias(n) for n in ("confidence_band", "tactics", "unmapped", "attack_type", "description")])
        slim = slim.withColumn("mitre", F.when(m.isNotNull(), short))
    return full_view(slim)


def live_to_queue(events: DataFrame) -> DataFrame:
    """Live events as queue rows; sizes, durations and features are not part of an event."""
    return events.select(
        "id", F.col("timestamp").alias("flow_timestamp"), F.col("src_ip").alias("source_ip"), F.col("dst_ip").alias("destination_ip"),
        F.col("src_port").alias("source_port"), F.col("dst_port").alias("destination_port"), "protocol",
        F.lit(0).alias("packet_size"), F.lit(0.0).alias("duration"), "prediction", "attack_type", "family",
        F.coalesce(F.nullif("subtype", F.lit("")), "attack_type").alias("subtype"), "confidence", "severity",
        "stage1_p", "stage2_p", "stage3_p", "stage2_probs", "stage3_probs",
        F.lit(None).cast("map<string,double>").alias("ml_features"), "source", "model_version",
        "snort_msg", "snort_sid", "snort_classtype", "snort_priority", F.lit("new").alias("ack_state"),
        F.lit(None).cast("timestamp").alias("ack_at"), F.lit(None).cast("string").alias("ack_note"), "mitre",
    )


def build_events(joined: DataFrame, model_version: str, flow_key: str = "flow_key") -> DataFrame:
    """Live events from a flow key, a struct ``alert`` and a struct ``model`` (either may be null).

    Address fields come from the alert where it has them, else from the key.
    """
    parts = N.parse_flow_key(flow_key)
    a, m = F.col("alert"), F.col("model")
    has = lambda c, empty: F.nullif(c, F.lit(empty))
    from flowsieve.functions import scoring as S

    d = joined.withColumn("_p", parts).withColumn(
        "source", S.verdict(a.isNotNull(), m["prediction"] == "Malicious"))
    label = F.coalesce(m["prediction"], F.when(a.isNotNull(), "Snort-Only").otherwise("Normal"))
    headline = S.overridden(F.col("source"), label, m["severity"], F.coalesce(m["confidence"], F.lit(0.0)), m["stage2_p"], m["stage3_p"])
    text = lambda n: F.coalesce(a[n], F.lit("")).alias(n)
    whole = lambda n: F.coalesce(a[n], F.lit(0)).alias(n)
    seen = [text(n) for n in ("snort_action", "snort_timestamp") if n in joined.schema["alert"].dataType.fieldNames()]
    return d.select(
        *[c for c in joined.columns if c not in ("alert", "model", flow_key)], F.col(flow_key).alias("flow_key"),
        F.coalesce(has(a["src_ip"], ""), F.col("_p.src_ip")).alias("src_ip"),
        F.coalesce(has(a["dst_ip"], ""), F.col("_p.dst_ip")).alias("dst_ip"),
        F.coalesce(has(a["src_port"], 0), F.col("_p.src_port")).alias("src_port"),
        F.coalesce(has(a["dst_port"], 0), F.col("_p.dst_port")).alias("dst_port"),
        F.coalesce(has(a["protocol"], ""), F.col("_p.protocol")).alias("protocol"),
        headline["prediction"].alias("prediction"), S.round_to(headline["confidence"]).alias("confidence"),
        headline["severity"].alias("severity"), m["attack_type"].alias("attack_type"), m["family"].alias("family"),
        m["attack_type"].alias("subtype"), S.round_to(F.coalesce(m["stage1_p"], F.lit(0.0))).alias("stage1_p"),
        m["stage2_p"].alias("stage2_p"), m["stage2_probs"].alias("stage2_probs"), m["stage3_p"].alias("stage3_p"),
        m["stage3_probs"].alias("stage3_probs"), "source", F.lit(model_version).alias("model_version"),
        text("snort_msg"), whole("snort_sid"), text("snort_classtype"), whole("snort_priority"), *seen,
    )


def apply_mode(events: DataFrame, mode: str) -> DataFrame:
    """View of one detector. ``ml`` hides what only the signature side found, ``snort`` what only the model found; a
    confirmed event is relabelled to the detector that stays. ``hybrid`` changes nothing."""
    if mode == "ml":
        keep, new = "signature_only", "ml_only"
        blank = {c: F.lit("") for c in ("snort_msg", "snort_classtype", "snort_action", "snort_timestamp")}
        blank |= {c: F.lit(0) for c in ("snort_sid", "snort_priority")}
    elif mode == "snort":
        keep, new = "ml_only", "signature_only"
        blank = {c: F.lit(None) for c in ("stage1_p", "stage2_p", "stage2_probs", "stage3_p", "stage3_probs")}
    else:
        return events
    types = {f.name: f.dataType for f in events.schema.fields}
    changed = {c: v.cast(types[c]) for c, v in blank.items() if c in types}
    changed["source"] = F.when(F.col("source") == "confirmed", new).otherwise(F.col("source"))
    return events.filter(F.coalesce(F.col("source") != keep, F.lit(True))).withColumns(changed)


# ---- alerts -------------------------------------------------------------------------------------------------------

ALERT_JSON = T.StructType([
    T.StructField(n, T.StringType()) for n in (
        "timestamp", "seconds", "action", "class", "priority", "msg", "sid", "gid", "rev", "src_addr", "src_port", "src_ap",
        "dst_addr", "dst_port", "dst_ap", "proto", "rule")
])


def normalize_alerts(df: DataFrame, line: str = "value") -> DataFrame:
    """Alert JSON lines to alert rows.

    Each side's address comes from its split fields, or from its combined one. Lines that are no JSON or lack an address are
    dropped. The signature id comes from ``sid`` or from the middle of ``rule``.
    """
    j = df.withColumn("_j", F.from_json(F.trim(F.col(line)), ALERT_JSON)).withColumns({
        "_s": N.split_addr_port("_j.src_ap"), "_d": N.split_addr_port("_j.dst_ap")})
    from_split, to_split = F.col("_j.src_addr").isNotNull(), F.col("_j.dst_addr").isNotNull()
    port = lambda n: F.coalesce(F.col(f"_j.{n}").try_cast("int"), F.lit(0))
    rule_sid = F.try_element_at(F.split("_j.rule", ":"), F.lit(2)).try_cast("int")
    out = j.withColumns({
        "src_ip": F.when(from_split, F.col("_j.src_addr")).otherwise(F.col("_s.addr")),
        "dst_ip": F.when(to_split, F.col("_j.dst_addr")).otherwise(F.col("_d.addr")),
        "src_port": F.when(from_split, port("src_port")).otherwise(F.coalesce("_s.port", F.lit(0))),
        "dst_port": F.when(to_split, port("dst_port")).otherwise(F.coalesce("_d.port", F.lit(0))),
        "protocol": F.upper(F.coalesce("_j.proto", F.lit("TCP"))),
    }).filter((F.col("src_ip") != "") & (F.col("dst_ip") != ""))
    text = lambda n: F.coalesce(F.col(f"_j.{n}"), F.lit(""))
    return out.select(
        *[c for c in df.columns if c != line],
        N.flow_key("src_ip", "dst_ip", "src_port", "dst_port", "protocol").alias("flow_key"),
        "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
        F.coalesce(F.when(F.col("_j.sid").isNotNull(), F.col("_j.sid").try_cast("int")).otherwise(rule_sid), F.lit(0)).alias("snort_sid"),
        text("msg").alias("snort_msg"), text("class").alias("snort_classtype"),
        F.coalesce(F.col("_j.priority").try_cast("int"), F.lit(0)).alias("snort_priority"),
        text("action").alias("snort_action"), text("timestamp").alias("snort_timestamp"),
    )


def joinable_alerts(df: DataFrame, line: str = "value", year: int | None = None) -> DataFrame:
    """Normalised alert lines with what the joins with flows need: ``alert_ms``, a protocol number where the name has one, and ``event_id``, an order of
    simultaneous alerts that does not depend on how files are read."""
    j = F.from_json(F.trim(F.col(line)), ALERT_JSON)
    timed = df.withColumns({"alert_ms": TM.alert_millis(j["timestamp"], j["seconds"], year), "event_id": F.xxhash64(F.trim(F.col(line)))})
    rows = normalize_alerts(timed, line)
    number = N.lookup(F.col("protocol"), {name: n for n, name in fixed.KEY_PROTOCOLS.items()}, F.col("protocol").try_cast("int"))
    return rows.withColumn("protocol", number)


# ---- corpora and input checks ---------------------------------------------------------------------------------------

def validate_flows(df: DataFrame) -> DataFrame:
    """Adds ``reasons``: everything wrong with an input record, in a fixed order; an empty array means valid."""
    have = set(df.columns)
    v4 = lambda c: F.nullif(F.col(c), F.lit(""))
    tests: list[tuple[str, Column]] = []
    for c, label in (("sport", "Source Port"), ("dsport", "Destination Port")):
        if c in have:
            tests.append((f"{label} out of range", ~F.col(c).between(0, 65535)))
    if "proto" in have:
        tests.append(("Protocol not supported", ~F.lower("proto").isin("tcp", "udp", "icmp")))
    for c, label in (("srcip", "Source IP"), ("dstip", "Destination IP")):
        if c in have:
            tests.append((f"{label} not IPv4", v4(c).isNotNull() & N.ipv4_number(c).isNull()))
    for c in fixed.NON_NEGATIVE_FIELDS:
        if c in have:
            tests.append((f"{c} negative", F.col(c) < 0))
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(t, F.lit(r)) for r, t in tests])))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = validate_flows(df)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def downcast(df: DataFrame) -> DataFrame:
    """Doubles to floats and longs to ints; a long that does not fit stops the job instead of being cut."""
    small = {T.DoubleType: "float", T.LongType: "int"}
    return df.select(*[_q(f.name).cast(small.get(type(f.dataType), f.dataType)).alias(f.name) for f in df.schema.fields])


def label_table(spark) -> DataFrame:
    corrected = fixed.LABEL_SPELLINGS_CORRECTED
    known = {**{k: corrected.get(v, v) for k, v in fixed.LABEL_SPELLINGS.items()}, **corrected}
    return literal_table(spark, list(known.items()), "_spelling string, _label string")


def normalize_labels(df: DataFrame, label: str = "Label") -> DataFrame:
    """Canonical label names; unknown spellings stay as they are. The spelling table is fixed (about 50 rows)."""
    d = df.withColumn(label, F.trim(F.col(label)))
    j = d.join(F.broadcast(label_table(df.sparkSession)), F.col(label) == F.col("_spelling"), "left")
    return j.withColumn(label, F.coalesce("_label", label)).drop("_spelling", "_label")


def unmapped_labels(df: DataFrame, label: str = "Label", allowed: Sequence[str] = tuple(fixed.LEAVES)) -> DataFrame:
    """Labels outside the allowed set with their row counts."""
    return df.filter(~F.col(label).isin(*allowed)).groupBy(label).agg(F.count("*").alias("rows"))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all there and finite."""
    good = F.lit(True)
    for c in columns:
        good = good & _q(c).isNotNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            good = good & ~F.isnan(_q(c)) & (F.abs(_q(c)) != float("inf"))
    return df.filter(good)


def union_corpora(a: DataFrame, b: DataFrame, features: Sequence[str] = fixed.FEATURES, extra: Sequence[str] = ("Label", "__source")) -> DataFrame:
    """Both corpora on the features they share, label and source kept."""
    common = [f for f in features if f in a.columns and f in b.columns]
    cols = [_q(c) for c in [*common, *extra]]
    return a.select(*cols).unionByName(b.select(*cols))


def dedup(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per combination of ``columns``: the first in ``order``. Copies are folded before the shuffle, so a row
    with very many copies costs no more than any other."""
    rest = [c for c in df.columns if c not in columns]
    keep = F.min_by(F.struct(*[_q(c) for c in rest]), F.struct(*[_q(c) for c in order])).alias("_r")
    folded = df.groupBy(*[_q(c) for c in columns]).agg(keep)
    return folded.select(*[(_q(c) if c in columns else F.col("_r")[c].alias(c)) for c in df.columns])


def feature_coverage(a: DataFrame, b: DataFrame, features: Sequence[str] = fixed.FEATURES) -> dict[str, list[str]]:
    """Features either side lacks."""
    return {"missing_left": [f for f in features if f not in a.columns], "missing_right": [f for f in features if f not in b.columns]}


def value_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column the number of null and of not finite values: one pass, one row per column."""
    parts = []
    for c in columns:
        v = _q(c).cast("double")
        parts += [F.count_if(v.isNull()).alias(f"n|{c}"), F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"i|{c}")]
    one = df.agg(*parts)
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), _q(f"n|{c}").alias("nulls"), _q(f"i|{c}").alias("not_finite")) for c in columns])
    return one.select(F.explode(entries).alias("e")).select("e.*")
