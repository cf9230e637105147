"""Column expressions for addresses, protocols and flow keys, all JVM-side."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsieve import fixed

PRIVATE_V4 = r"^(10\.|192\.168\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
PRIVATE_V6 = r"^(::1|fe80)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(key: Column, table: dict, otherwise: Column) -> Column:
    """A short literal table as one CASE expression."""
    out = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(otherwise)


def protocol_name(protocol: str | Column, wide: bool = False) -> Column:
    """Protocol number (or text) to name.

    The narrow table serves flow keys: names are upper-cased, unknown numbers stay numbers. The wide table serves display
    columns, where text is kept as it is and a missing value becomes ``N/A``.
    """
    text = _col(protocol).cast("string")
    number = text.try_cast("double").try_cast("int")
    if wide:
        named = lookup(number, fixed.DISPLAY_PROTOCOLS, text)
        return F.when(text.isNull(), F.lit("N/A")).when(number.isNull(), text).otherwise(named)
    return F.when(number.isNull(), F.upper(text)).otherwise(lookup(number, fixed.KEY_PROTOCOLS, text))


def flow_key(src_ip, dst_ip, src_port, dst_port, protocol) -> Column:
    """``src:port-dst:port-PROTO``, direction-sensitive."""
    return F.concat(
        _col(src_ip), F.lit(":"), _col(src_port).cast("string"), F.lit("-"),
        _col(dst_ip), F.lit(":"), _col(dst_port).cast("string"), F.lit("-"), protocol_name(protocol),
    )


# address, port, address, port, protocol; the greedy address keeps the colons of IPv6
_KEY_PATTERN = r"^(.*):(\d+)-([^-]*):(\d+)-([^-]*)$"


def parse_flow_key(key: str | Column) -> Column:
    """Parts of a flow key as a struct; a text that is no flow key gives ``N/A`` addresses and TCP."""
    c = _col(key)
    ok = F.coalesce(c.rlike(_KEY_PATTERN), F.lit(False))

    def part(i: int, default, to: str) -> Column:
        value = F.regexp_extract(c, _KEY_PATTERN, i)
        value = value.try_cast(to) if to != "string" else value
        return F.when(ok, F.coalesce(value, F.lit(default))).otherwise(F.lit(default))

    return F.struct(
        part(1, "N/A", "string").alias("src_ip"), part(3, "N/A", "string").alias("dst_ip"),
        part(2, 0, "int").alias("src_port"), part(4, 0, "int").alias("dst_port"),
        part(5, "TCP", "string").alias("protocol"),
    )


def split_addr_port(text: str | Column) -> Column:
    """``1.2.3.4:80`` or ``[::1]:443`` as struct(addr, port); without a usable port the whole text is the address."""
    c = _col(text)
    bracket = c.startswith("[")
    b_addr = F.regexp_extract(c, r"^\[(.*)\]", 1)
    b_port = F.regexp_extract(c, r"\]:(\d+)$", 1).try_cast("int")
    p_port = F.regexp_extract(c, r":([^:]*)$", 1).try_cast("int")
    p_addr = F.when(p_port.isNotNull(), F.regexp_extract(c, r"^(.*):[^:]*$", 1)).otherwise(c)
    return F.struct(
        F.when(bracket, b_addr).otherwise(p_addr).alias("addr"),
        F.coalesce(F.when(bracket, b_port).otherwise(p_port), F.lit(0)).alias("port"),
    )


def ipv4_number(addr: str | Column) -> Column:
    """IPv4 text as a number, null if it is not four octets."""
    c = _col(addr)
    part = F.split(c, r"\.")
    octet = [F.try_element_at(part, F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    good = c.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    for o in octet:
        good = good & (o <= 255)
    number = octet[0] * 16777216 + octet[1] * 65536 + octet[2] * 256 + octet[3]
    return F.when(good, number)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` written and computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ipv6_hex(c: Column) -> Column:
    """The 32 hexadecimal digits of IPv6 text, null if it is none. A zone is ignored, the last four bytes may be written as IPv4."""
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")

    def with_hex_tail(bare: Column) -> Column:
        tail = _let(ipv4_number(F.substring_index(bare, ":", -1)), lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535))))))
        return F.when(bare.contains("."), F.concat(F.regexp_replace(bare, "[^:]*$", ""), tail)).otherwise(bare)

    def filled(p: Column) -> Column:
        known = F.size(p["left"]) + F.size(p["right"])
        zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - known))
        every = F.when(p["short"], F.concat(p["left"], zeros, p["right"])).otherwise(p["left"])
        return F.when(F.when(p["short"], known < 8).otherwise(known == 8), F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    def digits(plain: Column) -> Column:
        short = plain.contains("::")
        right = F.when(short, groups(F.substring_index(plain, "::", -1))).otherwise(F.array().cast("array<string>"))
        parts = F.struct(short.alias("short"), groups(F.substring_index(plain, "::", 1)).alias("left"), right.alias("right"))
        good = plain.rlike("^[0-9a-f]{0,4}(:[0-9a-f]{0,4}){2,8}$") & ~plain.rlike(":::|::.*::|^:[^:]|[^:]:$")
        return F.when(good, _let(parts, filled))

    return _let(_let(F.lower(F.regexp_replace(c, "%.*$", "")), with_hex_tail), digits)


def address_bits(addr: str | Column) -> Column:
    """An address as text of its bits, 32 or 128 of them; null if it is no address."""
    half = lambda d, at: F.lpad(F.conv(F.substring(d, at, 16), 16, 2), 64, "0")
    six = lambda c: _let(_ipv6_hex(c), lambda d: F.concat(half(d, 1), half(d, 17)))
    return _let(_col(addr), lambda c: F.when(c.contains(":"), six(c)).otherwise(F.lpad(F.bin(ipv4_number(c)), 32, "0")))


def network_length(network: str | Column) -> Column:
    """Leading bits of a network text: behind the slash as a number, a netmask or a host mask; all bits without a slash. Null if malformed."""
    c = _col(network)
    whole = F.when(c.contains(":"), 128).otherwise(32)
    mask = F.substring_index(c, "/", -1)
    number = ipv4_number(mask)
    ones = F.bit_count(number)
    netmask = F.when(number + F.pow(F.lit(2), 32 - ones) == 1 << 32, ones)
    hostmask = F.when(number + 1 == F.pow(F.lit(2), ones), 32 - ones)
    length = F.when(~c.contains("/"), whole).when(mask.rlike("^[0-9]+$"), mask.try_cast("int")).when(~c.contains(":"), F.coalesce(netmask, hostmask))
    return F.when(length.between(0, whole), length)


def address_key(addr: str | Column) -> Column:
    """An address as text that sorts by family and number: a digit for the family and 8 or 32 hexadecimal digits; null if it is no address."""
    four = lambda c: F.concat(F.lit("4"), F.lpad(F.lower(F.hex(ipv4_number(c))), 8, "0"))
    return _let(_col(addr), lambda c: F.when(c.contains(":"), F.concat(F.lit("6"), _ipv6_hex(c))).otherwise(four(c)))


def in_cidr(addr: str | Column, cidr: str) -> Column:
    """Whether the address lies in the network. Host bits in ``cidr`` are allowed, a malformed one raises ValueError."""
    network = ipaddress.ip_network(cidr, strict=False)
    if network.version == 4:
        shift = 32 - network.prefixlen
        return F.coalesce(
            F.shiftright(ipv4_number(addr), shift) == F.lit(int(network.network_address) >> shift), F.lit(False)
        )
    low, high = (f"6{int(a):032x}" for a in (network.network_address, network.broadcast_address))
    return F.coalesce(_let(_col(addr), lambda c: F.when(c.contains(":"), address_key(c).between(low, high))), F.lit(False))


def is_private_ip(addr: str | Column) -> Column:
    """Internal address (private, loopback, link-local); a missing address counts as internal."""
    c = _col(addr)
    return F.when(c.isNull() | (c == ""), F.lit(True)).otherwise(c.rlike(PRIVATE_V4) | c.rlike(PRIVATE_V6))
