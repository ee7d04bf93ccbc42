"""Enrichment from tables. Every lookup is a row-preserving left join on a unique key."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave import paths
from logweave.frame import EventFrame, Ref
from logweave.functions.ip import in_networks, ip_hex, with_bounds
from logweave.functions.spread import SPREAD
from logweave.functions.text import template
from logweave.pipeline import Operator, named

if TYPE_CHECKING:
    from logweave.operators.intervals import IntervalTable

BROADCAST_BYTES = 64 << 20
NO_KEY = "\ufdd1"
"""Begins the stand-in for a missing key; a noncharacter, with which no key of a table may begin."""


class Lookup:
    """A table with a ``key`` column and one or more value columns, one row per key.

    Of several rows of one key the one with the greatest ``order`` is taken, without ``order`` the one with the least
    values. A table whose size is given and at most ``BROADCAST_BYTES`` is broadcast, else the plan's own statistics
    decide. No size is measured by a job of its own. Rows without a key get stand-ins from the number of the row, so they spread over all
    tasks instead of meeting in one; keys that hold many rows are split by adaptive execution.
    """

    def __init__(
        self,
        table: DataFrame,
        key: str = "key",
        values: Iterable[str] | None = None,
        order: str | None = None,
        size: int | None = None,
        unique: bool = False,
    ):
        self.values = list(values) if values is not None else [c for c in table.columns if c not in (key, order)]
        self.small = size is not None and size <= BROADCAST_BYTES
        named = F.col(key).cast("string")
        kept = table.filter(named.isNotNull() & ~named.startswith(NO_KEY))
        if unique:
            self.table = kept.select(named.alias("key"), F.struct(*self.values).alias("row"))
        else:
            row = F.struct(*self.values)
            best = F.max_by(row, F.struct(order, row)) if order else F.min(row)
            self.table = kept.groupBy(named.alias("key")).agg(best.alias("row"))

    def join(self, df: DataFrame, key: Column, tag: Column, out: str) -> DataFrame:
        """Add column ``out``: the matching table row as a struct, NULL without a match; ``tag`` spreads rows without a key.

        Keys of the table are never NULL. They are compared with ``<=>``, for which the planner does not trace the key back
        through all the expressions it came from, as it does for ``=`` in search of partitioned tables: behind a few lookups
        on parsed fields that trace grows without end.
        """
        right = self.table.select(F.col("key").alias(f"{out}_k"), F.col("row").alias(out))
        if self.small:
            return df.join(F.broadcast(right), key.eqNullSafe(F.col(f"{out}_k")), "left").drop(f"{out}_k")
        stand_in = F.concat(F.lit(NO_KEY), F.pmod(tag, F.lit(SPREAD)).cast("string"))
        left = df.withColumn(f"{out}_l", F.coalesce(key, stand_in))
        return left.join(right, F.col(f"{out}_l").eqNullSafe(F.col(f"{out}_k")), "left").drop(f"{out}_k", f"{out}_l")


def join_row(f: EventFrame, lookup: Lookup, key: Ref) -> Ref:
    """Run a lookup for the rows of the current block; returns the matched struct."""
    cond = f.guard()
    if cond is not None:
        key = f.lift(lambda k, c: F.when(c, k), key, cond, dtype="string", cost=5)
    out = f.new_column()
    after = f.add_step([key, f.row_tag()], lambda df, k, tag: lookup.join(df, k, tag, out))
    return Ref(F.col(out), "struct", after, 1, f.block)


def translate(source: str, target: str, dictionary: Lookup | None, fallback: str | None = None) -> Operator:
    """Exact dictionary lookup of a field's text; without a dictionary every text is a miss, and nothing is joined.

    A hit overwrites ``target``. A miss writes ``fallback``, in which references to missing fields
    stay as written, or changes nothing without one.
    """

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        text = f.bind(text)
        there = f.lift(lambda c: c.isNotNull(), text, dtype="boolean")
        if dictionary is None:
            hit = f.literal(None, "string")
        else:
            row = join_row(f, dictionary, text)
            value_name = dictionary.values[0]
            hit = f.lift(lambda r: r[value_name].cast("string"), row, dtype="string")
        if fallback is None:
            made = hit
            there = f.lift(lambda c: c.isNotNull(), made, dtype="boolean")
        else:
            miss = template(f, fallback, keep_unresolved=True)
            made = f.lift(
                lambda t, h, m: F.when(t, F.coalesce(h, m)), there, hit, miss, dtype="string"
            )
        if f.notes is not None:
            old = f.bind(f.exists(target))
            f.note("fields_modified", target, f.both(there, old))
            f.note("fields_added", target, f.both(there, f.negate(old)))
        f.put(target, made)

    return named("translate", run)


def cidr(address: str, networks: Iterable[str] | NetworkTable | IntervalTable, add_tag: str) -> Operator:
    """Tag rows whose address lies in any of the networks: a literal list, or a table of them."""

    def run(f: EventFrame) -> None:
        text = f.text(address)
        if text is None:
            return
        key = f.address_key(text, ip_hex)
        if hasattr(networks, "find"):
            row = networks.find(f, key)
            hit = f.lift(lambda r: r.isNotNull(), row, dtype="boolean")
        else:
            listed = list(networks)
            hit = f.lift(lambda k: in_networks(k, listed), key, dtype="boolean", cost=30, repeat=0)
        f.add_tag(add_tag, f.bind(hit))

    return named("cidr", run)


class NetworkTable:
    """Networks with attributes, ready for longest-prefix lookup by equality joins.

    Each network is filed under a block of addresses that it lies in, and each block holds a short list of networks,
    longest prefix first. A tier is the number of hex digits that name its blocks: 4 or 6 for IPv4 (up to /23, from /24),
    an even number from 4 to 32 for IPv6, the most that the prefix holds. So a block holds the networks of at most eight
    neighbouring prefix lengths that lie in it, 511 at most, however dense the table. A network wider than the first
    block is filed under every block it covers.

    An address is looked up by one block key per tier, so an event row stays one row: no range join, no row explosion,
    no window. Tiers that hold nothing are not joined; ``tiers`` names those that do, else one small job finds them. Of
    several records of one network the one with the least attributes is taken.
    """

    def __init__(
        self,
        table: DataFrame,
        network: str = "network",
        attributes: Iterable[str] | None = None,
        tiers: Iterable[int] | None = None,
        size: int | None = None,
    ):
        self.attributes = (
            list(attributes) if attributes is not None else [c for c in table.columns if c != network]
        )
        v4 = F.length("low") == 8
        tier = F.when(v4, F.when(F.col("prefix") < 24, 4).otherwise(6)).otherwise(
            F.greatest(F.lit(4), 2 * F.floor(F.col("prefix") / 8).cast("int"))
        )
        digits = F.col("tier")
        first = F.col("low").substr(F.lit(1), digits)
        span = F.sequence(  # of the first tier's blocks
            F.conv(F.col("low").substr(1, 4), 16, 10).cast("bigint"),
            F.conv(F.col("high").substr(1, 4), 16, 10).cast("bigint"),
        )
        blocks = F.when(
            F.col("tier") == 4, F.transform(span, lambda n: F.lpad(F.hex(n), 4, "0"))
        ).otherwise(F.array(first))
        item = F.struct((-F.col("prefix")).alias("rank"), "low", "high", *self.attributes)
        self.networks = (
            with_bounds(table.select(network, *[c for c in self.attributes if c != network]), network)
            .filter("prefix IS NOT NULL")
            .groupBy("low", "high").agg(F.min("prefix").alias("prefix"), _least(self.attributes))
            .select("low", "high", "prefix", *(F.col(f"least.{c}").alias(c) for c in self.attributes))
        )
        filed = (
            self.networks
            .withColumn("tier", tier)
            .select("tier", F.length("low").alias("width"), F.explode(blocks).alias("block"), item.alias("item"))
        )
        self.packed = filed.groupBy("tier", F.concat("width", F.lit(":"), "block").alias("key")).agg(
            F.array_sort(F.collect_list("item")).alias("nets")
        )
        self._filed, self._tiers, self._size = filed, tiers, size

    @cached_property
    def tiers(self) -> list[tuple[int, Lookup]]:
        """Lookups of the tiers that hold networks, longest prefixes first."""
        there = self._tiers if self._tiers is not None else [r.tier for r in self._filed.select("tier").distinct().collect()]
        return [
            (t, Lookup(self.packed.filter(F.col("tier") == t), "key", ["nets"], size=self._size, unique=True))
            for t in sorted(there, reverse=True)
        ]

    def find(self, f: EventFrame, key: Ref) -> Ref:
        """The longest network holding an address key, as a struct; NULL without one."""
        found: list[Ref] = []
        for tier, lookup in self.tiers:
            block = f.lift(lambda k, t=tier: block_of(k, t), key, dtype="string", cost=4)
            row = join_row(f, lookup, block)
            found.append(
                f.lift(
                    lambda r, k: find_row(r["nets"], lambda n: k.between(n["low"], n["high"])),
                    row, key, dtype="struct", cost=20,
                )
            )
        if not found:
            return f.literal(None, "struct<rank:int>")
        if len(found) == 1:
            return f.bind(found[0])
        return f.bind(f.lift(lambda *c: F.coalesce(*c), *found, dtype="struct"))


def find_row(nets: Column, meets: Callable[[Column], Column]) -> Column:
    """The first of a block's networks, longest prefix first, that meets a condition."""
    return F.get(F.filter(nets, meets), 0)


def _least(attributes: list[str]) -> Column:
    return F.min(F.struct(*attributes) if attributes else F.struct(F.lit(0))).alias("least")


def block_of(key: Column, tier: int) -> Column:
    named = F.concat(F.length(key).cast("string"), F.lit(":"), key.substr(1, tier))
    return named if tier <= 6 else F.when(F.length(key) == 32, named)


# Attributes of a geographic record.
GEO_FIELDS = (
    "country_name", "country_code2", "country_code3", "continent_code", "city_name", "postal_code",
    "latitude", "longitude", "timezone",
)


def geo_table(table: DataFrame, network: str = "network", **options) -> NetworkTable:
    """A table of networks with any of the geographic attributes; country_code3 is country_code2."""
    if "country_code3" not in table.columns and "country_code2" in table.columns:
        table = table.withColumn("country_code3", F.col("country_code2"))
    kept = [c for c in GEO_FIELDS if c in table.columns]
    return NetworkTable(table, network, kept, **options)


def geoip(source: str, table: NetworkTable | IntervalTable, target: str = "geoip") -> Operator:
    """Attributes of the longest network holding the address, each written where it has a value."""

    def run(f: EventFrame) -> None:
        text = f.text(source)
        if text is None:
            return
        row = table.find(f, f.address_key(text, ip_hex))
        prefix = paths.leaf(target)
        f.note("fields_added", target, f.lift(lambda r: r.isNotNull(), row, dtype="boolean"))
        for name in table.attributes:
            path = {"latitude": "location.lat", "longitude": "location.lon"}.get(name, name)
            kind = "double" if name in ("latitude", "longitude") else "string"
            value = f.lift(lambda r, n=name, k=kind: r[n].cast(k), row, dtype=kind, cost=2)
            if kind == "string":
                value = f.lift(lambda c: F.nullif(c, F.lit("")), value, dtype="string")
            f.put(f"{prefix}.{path}", value)

    return named("geoip", run)


def dns(
    hosts: Lookup | None = None, reverse: Iterable[str] = (), resolve: Iterable[str] = (), addresses: Lookup | None = None
) -> Operator:
    """Replace addresses by host names (``reverse``) or names by addresses (``resolve``).

    ``hosts`` is keyed by address, ``addresses`` by name; a name or address that its table lacks stays as it is.
    """
    asked = [(field, hosts) for field in reverse] + [(field, addresses) for field in resolve]
    if any(table is None for _, table in asked):
        raise ValueError("reverse needs hosts, a table keyed by address; resolve needs addresses, one keyed by name")

    def run(f: EventFrame) -> None:
        for field, known in asked:
            text = f.text(field)
            if text is None:
                continue
            row = join_row(f, known, text)
            name = known.values[0]
            made = f.lift(lambda r, n=name: r[n].cast("string"), row, dtype="string")
            there = f.lift(lambda c: c.isNotNull(), made, dtype="boolean")
            if f.notes is not None:
                old = f.exists(field)
                f.note("fields_modified", field, f.both(there, old))
            f.put(field, made)

    return named("dns", run)


def interface_alias(
    table: DataFrame,
    hostname: str = "log.syslog.hostname",
    interface: str = "interface.name",
) -> Operator:
    """Alias and network name by firewall host and interface.

    ``table`` has ``hostname, interface, alias, network`` and an optional ``pattern``: a row with a
    pattern matches interface names by regex, others by equality; of several matching rows the last
    by ``position`` wins. Hosts in the table without a matching row fall back to the
    interface name. Rows are folded to one record per host, so the join key is the host alone.
    """
    columns = ["interface", "alias", "network"]
    if "pattern" not in table.columns:
        table = table.withColumn("pattern", F.lit(None).cast("string"))
    if "position" not in table.columns:
        table = table.withColumn("position", F.lit(0))
    hosts = Lookup(
        table.groupBy("hostname").agg(
            F.array_sort(F.collect_list(F.struct("position", *columns, "pattern"))).alias("rows")
        ),
        "hostname",
        ["rows"],
        unique=True,
    )

    def run(f: EventFrame) -> None:
        host, name = f.text(hostname), f.text(interface)
        if host is None or name is None:
            return
        name = f.bind(name)
        row = join_row(f, hosts, host)

        def pick(r: Column, n: Column) -> Column:
            hit = F.filter(
                r["rows"],
                lambda e: F.when(e["pattern"].isNotNull(), F.call_function("rlike", n, e["pattern"])).otherwise(
                    e["interface"] == n
                ),
            )
            return F.when(r.isNotNull() & n.isNotNull(), F.coalesce(
                F.get(F.reverse(hit), 0),
                F.struct(
                    F.lit(0).alias("position"), n.alias("interface"), n.alias("alias"),
                    n.alias("network"), F.lit(None).cast("string").alias("pattern"),
                ),
            ))

        found = f.bind(f.lift(pick, row, name, dtype="struct", cost=60, repeat=0))
        for source, target in (("alias", "interface.alias"), ("network", "network.name")):
            value = f.lift(lambda r, s=source: r[s], found, dtype="string")
            f.note("fields_added", target, f.lift(lambda c: c.isNotNull(), value, dtype="boolean"))
            f.put(target, value)

    return named("interface", run)

