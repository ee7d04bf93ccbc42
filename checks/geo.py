"""Queries for networks as sorted intervals and for places of all addresses of an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.core import pick, run
from checks.registry import query, table
from logweave.operators import cidr, geoip
from logweave.operators.intervals import IntervalTable
from logweave.operators.lookup import NetworkTable, geo_table
from logweave.plans import enrich

_B = "(user_id + event_id) % 40"
"""Second part of an address; from 25 on no nation has it."""


def _nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nested, adjacent and repeated networks of both families."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")

    def of(network: str, name: str, rows: DataFrame = nation) -> DataFrame:
        return rows.select(F.expr(network).alias("network"), F.expr(name).alias("country_name"))

    return (
        of("concat('10.', n_nationkey, '.0.0/16')", "n_name").union(of("concat('10.', n_nationkey, '.0.7/16')", "concat('zz', n_name)"))
        .union(of("concat('10.', n_nationkey, '.1.0/24')", "concat(n_name, ' one')")).union(of("concat('10.', n_nationkey, '.2.0/24')", "concat(n_name, ' two')"))
        .union(of("concat('10.', n_nationkey, '.2.128/25')", "concat(n_name, ' deep')", nation.filter("n_nationkey < 9")))
        .union(of("'2001:db8::/32'", "'doc'", region.limit(1))).union(of("concat('2001:db8:', r_regionkey, '::/48')", "r_name", region))
        .union(of("'no network'", "'bad'", region))
    )


def _owners(spark: SparkSession, sf: str) -> NetworkTable:
    nation = table(spark, sf, "nation")
    wide = nation.limit(1).select(F.lit("10.0.0.0/8").alias("network"), F.lit("AS8").alias("as_name"))
    return NetworkTable(wide.union(nation.select(F.expr("concat('10.', n_nationkey, '.2.0/23')"), F.expr("concat('AS', n_nationkey)"))))


_ADDRESS = f"""CASE WHEN event_id % 6 < 4 THEN concat('10.', {_B}, '.', event_id % 4, '.', event_id % 256)
    WHEN event_id % 6 = 4 THEN concat('2001:DB8:', event_id % 7, '::', {L.v6_groups('user_id')}) END"""
_COUNTRY = """CASE WHEN kind < 4 THEN CASE WHEN c = 1 THEN n_name || ' one' WHEN c = 2 AND b < 9 AND d >= 128 THEN n_name || ' deep' WHEN c = 2 THEN n_name || ' two' ELSE n_name END
    WHEN kind = 4 THEN coalesce(r_name, 'doc') END"""
_OWNER = "CASE WHEN kind < 4 THEN CASE WHEN n_name IS NOT NULL AND c >= 2 THEN 'AS' || CAST(b AS VARCHAR) ELSE 'AS8' END END"
_EVENTS = f"""WITH e AS (SELECT event_id, {_B} AS b, event_id % 4 AS c, event_id % 256 AS d, event_id % 6 AS kind, event_id % 7 AS g FROM events)"""
_JOINED = "FROM e LEFT JOIN nation ON kind < 4 AND n_nationkey = b LEFT JOIN region ON kind = 4 AND r_regionkey = g"


@query("lookup_interval_table", f"""{_EVENTS}
    SELECT event_id, {_COUNTRY} AS country, {_OWNER} AS owner, CASE WHEN kind < 5 THEN 'known' END AS tags {_JOINED}""")
def lookup_interval_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two tables as one list of intervals, in pages of four."""
    both = IntervalTable(geo_table(_nations(spark, sf)), _owners(spark, sf), page=4)
    df = table(spark, sf, "events").select("event_id", F.expr(_ADDRESS).alias("ip"))
    return pick(run(df, geoip("ip", both, "geo"), cidr("ip", both, "known")), "event_id", "tags", country="geo.country_name", owner="geo.as_name")


_PRIVATE = "b < 25 AND b % 5 = 0"
_FOUR = {"source": "20", "destination": "21", "client": "22", "vpn": "23"}


def _four_sql() -> str:
    known = ", ".join(
        f"CASE WHEN kind < 4 AND NOT ({_PRIVATE}) THEN n_name || ' {at}' WHEN kind = 4 THEN r_name END AS {name},"
        f" CASE WHEN kind < 4 AND NOT ({_PRIVATE}) AND n_name IS NOT NULL THEN 'AS' || CAST(b AS VARCHAR) END AS {name}_owner"
        for name, at in _FOUR.items()
    )
    ends = {"source": "Source", "destination": "Destination", "client": "Proxy", "vpn": "OpenVPN"}
    done = {"source": "GeoIP_Source", "destination": "GeoIP_Destination", "client": "GeoIP_Source", "vpn": "GeoIP_Client_OpenVPN"}
    tags = " || ".join(
        f"CASE WHEN kind = 5 THEN '' WHEN kind < 4 AND {_PRIVATE} THEN ',IP_Private_{ends[n]}' ELSE '{'' if n == 'client' else ',' + done[n]}' END" for n in _FOUR
    )
    return f"{_EVENTS} SELECT event_id, {known}, 'pfelk,nginx,openvpn' || {tags} AS tags {_JOINED}"


@query("places_all", _four_sql())
def places_all(spark: SparkSession, sf: str) -> DataFrame:
    """All four addresses: known, unknown, private, of the newer family, and none; every table is joined once for each address."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    city = asn = None
    for at in _FOUR.values():
        rows = nation.select(F.expr(f"concat('{at}.', n_nationkey, '.0.0/16')").alias("network"), F.expr(f"concat(n_name, ' {at}')").alias("country_name"))
        own = nation.select(F.expr(f"concat('{at}.', n_nationkey, '.0.0/17')").alias("network"), F.expr("concat('AS', n_nationkey)").alias("as_name"))
        city, asn = (rows, own) if city is None else (city.union(rows), asn.union(own))
    city = city.union(region.select(F.expr("concat('2001:db8:', r_regionkey, '::/48')"), F.col("r_name")))

    def address(at: str) -> str:
        return f"""CASE WHEN event_id % 6 < 4 AND {_B} < 25 AND {_B} % 5 = 0 THEN concat('192.168.', event_id % 256, '.1') WHEN event_id % 6 < 4 THEN concat('{at}.', {_B}, '.', event_id % 4, '.9')
            WHEN event_id % 6 = 4 THEN concat('2001:db8:', event_id % 7, '::', {L.v6_groups('user_id')}) END"""

    fields = {"source": "source.ip", "destination": "destination.ip", "client": "client.ip", "vpn": "openvpn.client.ip"}
    tags = F.array(*(F.lit(t) for t in ("pfelk", "nginx", "openvpn"))).alias("tags")
    df = table(spark, sf, "events").select("event_id", *(F.expr(address(_FOUR[n])).alias(field) for n, field in fields.items()), tags)
    out = run(df, *enrich.places(geo_table(city), NetworkTable(asn)))
    places = {"source": "source.geo", "destination": "destination.geo", "client": "client.geo", "vpn": "openvpn.client.geo"}
    return pick(out, "event_id", "tags", **{n: f"{p}.country_name" for n, p in places.items()}, **{f"{n}_owner": f"{p}.as_name" for n, p in places.items()})
