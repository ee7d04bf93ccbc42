"""IP addresses as fixed-width upper-case hex keys: 8 digits for IPv4, 32 for IPv6.

Keys of one width sort in address order, so a network is a plain string range.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"

# The networks that count as private.
PRIVATE_NETWORKS = (
    "0.0.0.0/32", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "224.0.0.0/4", "255.255.255.255/32", "fe80::/10", "fc00::/7", "ff00::/8", "::1/128", "::",
)


_SHORT = r"[0-9A-Fa-f]{1,4}"
_V6 = rf"^(?:{_SHORT}(?::{_SHORT})*)?(?:::(?:{_SHORT}(?::{_SHORT})*)?)?$"


def _v4_hex(c: Column) -> Column:
    part = F.split(c, r"\.")
    n = F.lit(0).cast("bigint")
    for i in range(4):
        n = n * 256 + F.get(part, i).try_cast("bigint")
    return F.lpad(F.hex(n), 8, "0")


def _plain_v6(c: Column) -> Column:
    """Without a zone, and with a dotted tail as its two groups."""
    bare = F.regexp_replace(c, r"%[^%]+$", "")
    tail = _v4_hex(F.regexp_extract(bare, rf":({_V4})$", 1))
    head = F.regexp_extract(bare, rf"^(.*:){_V4}$", 1)
    dotted = F.concat(head, F.regexp_replace(tail, "^(....)", "$1:"))
    return F.when(bare.contains("."), dotted).otherwise(bare)


def _v6_hex(c: Column) -> Column:
    """Write out ``::`` as the groups it stands for and pad every group."""
    plain = _plain_v6(c)
    given = F.length(F.regexp_replace(F.regexp_replace(plain, _SHORT, "x"), ":", ""))
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), (F.lit(8) - given).cast("int")))
    groups = F.split(F.trim(F.regexp_replace(plain, F.lit("::"), zeros), F.lit(":")), ":")
    made = F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
    whole = F.when(plain.contains("::"), given <= 7).otherwise(given == 8)
    return F.when(plain.rlike(_V6) & whole, F.upper(made))


def ip_hex(c: Column) -> Column:
    """Hex key of an address; NULL when it is not one."""
    return F.when(c.rlike(rf"^{_V4}$"), _v4_hex(c)).when(c.contains(":"), _v6_hex(c))


def network_ranges(networks: Iterable[str]) -> list[tuple[str, str]]:
    """(low, high) keys of literal networks; host bits are ignored, bad networks skipped."""
    out = []
    for text in networks:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        width = 8 if net.version == 4 else 32
        out.append(
            (f"{int(net.network_address):0{width}X}", f"{int(net.broadcast_address):0{width}X}")
        )
    return out


def in_networks(key: Column, networks: Iterable[str]) -> Column:
    """Whether a hex key lies in any of the networks; false for a NULL key."""
    hit = F.lit(False)
    for width in (8, 32):
        same = [(lo, hi) for lo, hi in network_ranges(networks) if len(lo) == width]
        if not same:
            continue
        inside = None
        for lo, hi in same:
            test = key == lo if lo == hi else key.between(lo, hi)
            inside = test if inside is None else inside | test
        hit = hit | ((F.length(key) == width) & inside)
    return F.coalesce(hit, F.lit(False))


def with_bounds(table: DataFrame, network: str) -> DataFrame:
    """Add ``low`` and ``high`` keys and ``prefix`` length of networks such as ``10.0.0.0/8``.

    Host bits are ignored; a bad network gets a NULL prefix. The columns are added step by step, as
    each is read several times by the next.
    """
    text = F.col(network)
    whole, rest = F.floor(F.col("prefix") / 4).cast("int"), F.col("prefix") % 4
    ones = F.call_function("shiftright", F.lit(15), rest)
    kept = F.col("__base").substr(F.lit(1), whole)

    def bound(digit: Column, fill: str) -> Column:
        short = F.when(rest == 0, kept).otherwise(F.concat(kept, F.hex(digit)))
        return F.when(F.col("prefix").isNotNull(), F.rpad(short, F.length("__base").cast("int"), fill))

    width = F.length("__base") * 4
    asked = F.when(text.contains("/"), F.substring_index(text, "/", -1).try_cast("int")).otherwise(width)
    return (
        table.withColumn("__base", ip_hex(F.substring_index(text, "/", 1)))
        .withColumn("prefix", asked)
        .withColumn("prefix", F.when(F.col("prefix").between(0, width), F.col("prefix")))
        .withColumn("__digit", F.conv(F.col("__base").substr(whole + 1, F.lit(1)), 16, 10).cast("int"))
        .withColumn("low", bound(F.col("__digit").bitwiseAND(F.lit(15) - ones), "0"))
        .withColumn("high", bound(F.col("__digit").bitwiseOR(ones), "F"))
        .drop("__base", "__digit")
    )
