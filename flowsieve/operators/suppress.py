"""Suppression rules: kinds sid, flow_key, src_ip, src_cidr in this order of precedence, newest rule first."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsieve import fixed
from flowsieve.functions import network as N
from flowsieve.session import literal_table

#: Up to so many active rules are fetched, and shipped with the plan.
BROADCAST_RULES = 10_000
_TEXTS = ("sid", "flow_key", "src_ip")


def active_rules(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules that have not run out, newest first."""
    return _alive(rules, as_of).orderBy(F.col("created_at").desc(), F.col("id"))


def _alive(rules: DataFrame, as_of: Column) -> DataFrame:
    return rules.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of))


def check_cidr(value: str) -> str:
    """Canonical network text; a malformed one raises ValueError."""
    return str(ipaddress.ip_network(value, strict=False))


def intervals(networks: Iterable[tuple[int, int, tuple]]) -> list[tuple[int, tuple | None]]:
    """Networks (first address, first address behind, rule) cut into disjoint intervals: (start, smallest rule that covers it or None), in order. Networks are nested or apart."""
    out: list[tuple[int, tuple | None]] = []
    open_: list[tuple[int, tuple]] = []  # where the networks around end, and the best rule inside each

    def mark(start: int, rule: tuple | None) -> None:
        if out and out[-1][0] == start:
            out.pop()
        if not out or out[-1][1] != rule:
            out.append((start, rule))

    def close(until: int | None) -> None:
        while open_ and (until is None or open_[-1][0] <= until):
            end, _ = open_.pop()
            mark(end, open_[-1][1] if open_ else None)

    for low, high, rule in sorted(networks, key=lambda n: (n[0], -n[1])):
        close(low)
        best = min(rule, open_[-1][1]) if open_ else rule
        open_.append((high, best))
        mark(low, best)
    close(None)
    return out


def _newest(rules: DataFrame, keys: list[Column]) -> DataFrame:
    """One rule per key, the newest; the id decides between rules of one instant."""
    order = F.struct(-F.unix_micros("created_at"), "id")
    return rules.groupBy(*keys).agg(F.min_by(F.struct("id", "kind", "value", "created_at"), order).alias("rule"))


@dataclass
class Rules:
    """Active rules, ready to be matched any number of times: per kind of text one rule per value, and the networks, either as sorted disjoint intervals (start, number of the owner) with
    their owners, or, if there are too many rules to fetch, one per family, length and leading bits."""

    texts: dict[str, DataFrame]
    starts: list[str]
    owners: list[int]
    rules: DataFrame | None
    prefixes: DataFrame | None


def prepare(rules: DataFrame, as_of: Column) -> Rules:
    """Reads the rules once. Up to ``BROADCAST_RULES`` active ones come to the driver; the size of what is shipped is known."""
    named = _alive(rules, as_of).select("id", "kind", "value", "created_at")
    net = {"_bits": N.address_bits(F.substring_index("value", "/", 1)), "_len": N.network_length("value")}
    few = named.withColumn("_micros", F.unix_micros("created_at")).withColumns({k: F.when(F.col("kind") == "src_cidr", v) for k, v in net.items()}).limit(BROADCAST_RULES + 1).drop("created_at").collect()
    if len(few) > BROADCAST_RULES:
        texts = {k: _newest(named.filter(F.col("kind") == k), [F.col("value").alias("_v")]) for k in _TEXTS}
        cidr = named.filter("kind = 'src_cidr'").withColumns(net).filter("_bits is not null and _len is not null")
        return Rules(texts, [], [], None, _newest(cidr, [F.length("_bits").alias("_all"), F.col("_len"), F.expr("substring(_bits, 1, _len)").alias("_head")]))
    spark = rules.sparkSession
    order = lambda r: (r["_micros"] is not None, -(r["_micros"] or 0), r["id"])
    best: dict[tuple, object] = {}
    nets: dict[str, list] = {"4": [], "6": []}
    for n, r in enumerate(few):
        if r["kind"] in _TEXTS:
            key = (r["kind"], r["value"])
            if key not in best or order(r) < order(few[best[key]]):
                best[key] = n
        elif r["_bits"] is not None and r["_len"] is not None:
            bits, size = r["_bits"], r["_len"]
            low = int(bits[:size].ljust(len(bits), "0"), 2)
            nets["4" if len(bits) == 32 else "6"].append((low, low + (1 << (len(bits) - size)), (*order(r), n)))
    starts, owners = [], []
    for family, digits in (("4", 8), ("6", 32)):
        for start, rule in intervals(nets[family]):
            if start < 1 << digits * 4:
                starts.append(f"{family}{start:0{digits}x}")
                owners.append(-1 if rule is None else rule[-1])
        # the next family begins without an owner
        starts.append(f"{chr(ord(family) + 1)}")
        owners.append(-1)
    kind = rules.schema["id"].dataType
    shape = T.StructType([T.StructField("_n", T.IntegerType()), T.StructField("id", kind), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("_micros", T.LongType())])

    def table(numbers) -> DataFrame:
        t = literal_table(spark, [(n, few[n]["id"], few[n]["kind"], few[n]["value"], few[n]["_micros"]) for n in numbers], shape)
        return t.select("_n", F.struct("id", "kind", "value", F.timestamp_micros("_micros").alias("created_at")).alias("rule"))

    texts = {k: table([n for (kind_, _), n in best.items() if kind_ == k]).select(F.col("rule.value").alias("_v"), "rule") for k in _TEXTS if any(kind_ == k for kind_, _ in best)}
    used = sorted({n for n in owners if n >= 0})
    return Rules(texts, starts if used else [], owners if used else [], table(used) if used else None, None)


def _place(key: Column, starts: list[str]) -> Column:
    """How many of the sorted ``starts`` are not above ``key``: binary search in a literal array."""
    array = F.split(F.lit(",".join(starts)), ",")
    steps = F.array(*[F.lit(1 << k) for k in range(len(starts).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) <= key, at + step).otherwise(at))


def match_prepared(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds ``rule``: the winning rule's struct, null where none matches. No row is repeated.

    Fetched rules leave the rows where they are: texts are broadcast joins, a network is found by binary search among disjoint intervals, whatever the number of prefix lengths and
    families. Otherwise texts are equi-joins, and the distinct addresses, spread over the lengths in use, meet the networks in one.
    """
    key = {
        "sid": F.col("snort_sid").cast("string"),
        "flow_key": N.flow_key("source_ip", "destination_ip", "source_port", "destination_port", "protocol"),
        "src_ip": F.col("source_ip"),
    }
    fetched = rules.prefixes is None
    out, matched = df, {}
    for kind, side in rules.texts.items():
        side = side.select(F.col("_v").alias(f"_v_{kind}"), F.col("rule").alias(f"_r_{kind}"))
        out = out.join(F.broadcast(side) if fetched else side, key[kind] == F.col(f"_v_{kind}"), "left").drop(f"_v_{kind}")
        matched[kind] = F.col(f"_r_{kind}")
    if rules.starts:
        owners = F.split(F.lit(",".join(map(str, rules.owners))), ",")
        owner = F.get(owners, _place(N.address_key("source_ip"), rules.starts) - 1).cast("int")
        side = rules.rules.select(F.col("_n").alias("_owner"), F.col("rule").alias("_r_src_cidr"))
        out = out.withColumn("_place", owner).join(F.broadcast(side), F.col("_place") == F.col("_owner"), "left")
        matched["src_cidr"] = F.col("_r_src_cidr")
    elif not fetched:
        nets = rules.prefixes
        lengths = nets.groupBy("_all").agg(F.collect_set("_len").alias("_lens"))  # two rows, 33 and 129 lengths at most
        asked = df.select(F.col("source_ip").alias("_ip")).distinct().withColumn("_bits", N.address_bits("_ip")).withColumn("_all", F.length("_bits"))
        asked = asked.join(F.broadcast(lengths), "_all").select("_ip", "_all", "_bits", F.explode("_lens").alias("_len")).withColumn("_head", F.expr("substring(_bits, 1, _len)"))
        met = asked.join(nets, ["_all", "_len", "_head"]).groupBy("_ip").agg(F.min_by("rule", F.struct(-F.unix_micros("rule.created_at"), "rule.id")).alias("_r_src_cidr"))
        out = out.join(met, F.col("source_ip") == F.col("_ip"), "left")
        matched["src_cidr"] = F.col("_r_src_cidr")
    found = [matched[k] for k in fixed.SUPPRESSION_KINDS if k in matched]
    none = F.lit(None).cast("struct<id:string,kind:string,value:string,created_at:timestamp>")
    return out.select(*df.columns, (F.coalesce(*found) if found else none).alias("rule"))


def match_rules(df: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """``match_prepared`` with the rules as they are now."""
    return match_prepared(df, prepare(rules, as_of))


def suppress(df: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Rows no active rule matches."""
    return match_rules(df, rules, as_of).filter("rule is null").drop("rule")


def rule_hits(df: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules with their hit totals raised by the rows of this batch each of them suppressed."""
    new = match_rules(df, rules, as_of).filter("rule is not null").groupBy(F.col("rule.id").alias("id")).agg(F.count("*").alias("_new"))
    return rules.join(new, "id", "left").withColumn("hits", F.col("hits") + F.coalesce("_new", F.lit(0))).drop("_new")
