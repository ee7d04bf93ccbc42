"""Queries for keys that nobody declared, hard lookups, long lines and enrichment stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.core import networks, pick, run
from checks.registry import query, table
from logweave.frame import to_nested
from logweave.operators import geoip, grok, json, kv, mutate, translate
from logweave.operators.lookup import Lookup, NetworkTable, geo_table
from logweave.plans import apps, enrich
from logweave.predicates import contains_text, lacks_text
from logweave.pipeline import branch
from logweave.sources import as_events
from checks.domain import chain_of


@query("json_all_keys", """
    SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS cust, o_orderpriority AS deep FROM orders""")
def json_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"), F.struct(F.col("o_orderpriority").alias("b")).alias("a")))
    out = run(table(spark, sf, "orders").select("o_orderkey", text.alias("line")), json("line", fields={"status": "string"}))
    rest = F.col("line_json")
    return out.select("o_orderkey", "status", F.try_variant_get(rest, "$.cust", "string").alias("cust"), F.try_variant_get(rest, "$.a.b", "string").alias("deep"))


@query("kv_all_keys", """
    SELECT o_orderkey, o_orderstatus AS status, CAST(o_custkey + 1 AS VARCHAR) AS cust, 2 + CAST(o_orderkey % 2 AS BIGINT) AS keys FROM orders""")
def kv_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    text = "concat('status=', o_orderstatus, ' noise cust=', o_custkey, ' cust=', o_custkey + 1, CASE WHEN o_orderkey % 2 = 1 THEN ' odd=1' ELSE '' END)"
    out = run(table(spark, sf, "orders").select("o_orderkey", F.expr(text).alias("line")), kv("line", ["status"]))
    return out.select("o_orderkey", "status", F.col("line_pairs")["cust"].alias("cust"), F.size("line_pairs").cast("long").alias("keys"))


@query("nested_scalar_parent", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS whole, CASE WHEN event_id % 2 = 1 THEN event_type END AS leaf FROM events""")
def nested_scalar_parent(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr("CASE WHEN event_id % 2 = 0 THEN event_type END").alias("user.os"),
                                           F.expr("CASE WHEN event_id % 2 = 1 THEN event_type END").alias("user.os.name"))
    return to_nested(df).select("event_id", F.col("user.os._value").alias("whole"), F.col("user.os.name").alias("leaf"))


@query("squid_json_all_keys", f"SELECT event_id, {L.SOURCE_IP} AS client_ip, CAST(user_id AS VARCHAR) AS extra FROM events")
def squid_json_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    body = L.text(f"""concat('{{"client":{{"ip":"', {L.SOURCE_IP}, '"}},"more":{{"user":', CAST(user_id AS VARCHAR(9)), '}}}}')""")
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(f"concat({L.header('(squid-1)')}, {body})")), "line", preset="syslog")
    out = chain_of(*apps.squid()).apply(df)
    return out.select("event_id", F.col("`client.ip`").alias("client_ip"), F.try_variant_get("filter_message_json", "$.more.user", "string").alias("extra"))


def _urls(spark: SparkSession, sf: str, keep: bool) -> DataFrame:
    df = table(spark, sf, "pages").select("page_id", F.expr("concat('http://u', page_id, ':s3@h.example:8080/a')").alias("url.original"))
    return run(df, *enrich.urls(keep))


@query("url_stage", "SELECT page_id, concat('u', CAST(page_id AS VARCHAR)) AS client_user_name, 's3' AS kept, false AS dropped_is_there FROM pages")
def url_stage(spark: SparkSession, sf: str) -> DataFrame:
    kept, dropped = _urls(spark, sf, True), _urls(spark, sf, False)
    return pick(kept, "page_id", "client.user.name", kept="client.user.password").withColumn("dropped_is_there", F.lit("client.user.password" in dropped.columns))


@query("lookup_duplicate_keys", """
    SELECT event_id, max(c_name) AS last, min(c_name) AS least FROM events LEFT JOIN customer ON c_nationkey = user_id GROUP BY event_id""")
def lookup_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    entries = table(spark, sf, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("value"), F.col("c_name").alias("place"))
    df = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("k"))
    out = run(df, translate("k", "last", Lookup(entries, order="place")), translate("k", "least", Lookup(entries.drop("place"))))
    return pick(out, "event_id", "last", "least")


@query("lookup_networks_duplicate", "SELECT event_id, CASE WHEN user_id % 256 < 25 THEN 'a' END AS country FROM events")
def lookup_networks_duplicate(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "nation").select(F.expr("concat('10.', n_nationkey, '.0.0/16')").alias("network"), F.lit("b").alias("country_name"))
    other = table(spark, sf, "nation").select(F.expr("concat('10.', n_nationkey, '.0.7/16')").alias("network"), F.lit("a").alias("country_name"))
    df = table(spark, sf, "events").select("event_id", F.expr(L.text(L.SOURCE_IP)).alias("ip"))
    return pick(run(df, geoip("ip", geo_table(one.union(other)), "geo")), "event_id", country="geo.country_name")


@query("lookup_geo_v6_dense", """
    SELECT event_id, CASE WHEN user_id % 8192 IN (SELECT c_custkey % 8192 FROM customer) THEN concat('n', CAST(user_id % 8192 AS VARCHAR)) END AS country FROM events""")
def lookup_geo_v6_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Many /29 and /61 networks under one 16-bit block; blocks stay short."""
    n = table(spark, sf, "customer").select((F.col("c_custkey") % 8192).alias("n")).distinct()
    wide = n.select(F.expr("concat('2001:', lower(hex(n * 8)), '::/29')").alias("network"), F.lit("wide").alias("country_name"))
    near = n.select(F.expr("concat('2001:', lower(hex(n * 8)), ':0:', '8::/61')").alias("network"), F.expr("concat('n', n)").alias("country_name"))
    nets = NetworkTable(wide.union(near))
    address = F.expr("concat('2001:', lower(hex((user_id % 8192) * 8)), ':0:9::1')")
    return pick(run(table(spark, sf, "events").select("event_id", address.alias("ip")), geoip("ip", nets, "geo")), "event_id", country="geo.country_name")


_LONG = r".*(\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\]\s+%{LOGLEVEL:[log][level]}:\s+%{GREEDYDATA:payload})"


@query("grok_long_lines", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '7' END AS pgid, CASE WHEN doc_id % 2 = 0 THEN 'end' END AS payload,
      CASE WHEN doc_id % 2 = 0 THEN '' ELSE '_grokparsefailure' END AS tags FROM documents""")
def grok_long_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as one line, with and without a match behind them; half of the others hold what looks like its start."""
    line = "concat(regexp_replace(text, '[\\\\n\\\\r\\\\x{85}\\\\x{2028}\\\\x{2029}]', ' '), CASE WHEN doc_id % 2 = 0 THEN ' [7:1] info: end' WHEN doc_id % 4 = 1 THEN ' [7:1] info' ELSE '' END)"
    df = table(spark, sf, "documents").select("doc_id", F.expr(line).alias("line"))
    out = pick(run(df, grok("line", _LONG)), "doc_id", "tags", "payload", pgid="process.pgid")
    return out.withColumn("tags", F.coalesce("tags", F.lit("")))


@query("text_conditions", """
    SELECT event_id, CASE WHEN contains(event_type, 'e') THEN 'has' ELSE 'lacks' END AS letter FROM events""")
def text_conditions(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.col("event_type").alias("kind"))
    out = run(df, branch((contains_text("kind", "e"), [mutate(add_field={"letter": "has"})])), branch((lacks_text("kind", "e"), [mutate(add_field={"letter": "lacks"})])))
    return pick(out, "event_id", "letter")


@query("convert_float", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS DOUBLE) / 4 END AS n, CASE WHEN event_id % 2 = 1 THEN 'x' END AS raw FROM events")
def convert_float(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr("CASE WHEN event_id % 2 = 0 THEN CAST(CAST(event_id AS DOUBLE) / 4 AS STRING) ELSE 'x' END")
    return pick(run(table(spark, sf, "events").select("event_id", text.alias("n")), mutate(convert={"n": "float"})), "event_id", "n", raw="n_raw")


@query("interface_stage", """
    SELECT event_id, CASE WHEN user_id % 3 = 2 THEN NULL WHEN event_id % 2 = 0 THEN 'Loop' ELSE 'em0' END AS alias,
      CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 'inbound' ELSE 'in' END AS direction,
      CASE WHEN user_id % 3 = 0 AND event_id % 2 = 0 THEN 'ipv4' ELSE '4' END AS type FROM events""")
def interface_stage(spark: SparkSession, sf: str) -> DataFrame:
    known = enrich.interface_table(spark, [("fw0", "lo0", "Loop", None), ("fw1", "^lo.$", "Loop", "Net")])
    df = table(spark, sf, "events").select("event_id", F.expr(L.text(L.HOST)).alias("log.syslog.hostname"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'lo0' ELSE 'em0' END").alias("interface.name"),
                                           F.lit("in").alias("network.direction"), F.lit("4").alias("network.type"))
    return pick(run(df, *enrich.interfaces(known, ["fw0"])), "event_id", alias="interface.alias", direction="network.direction", type="network.type")


@query("host_name_stage", """
    SELECT event_id, coalesce(c_name, CAST(user_id AS VARCHAR)) AS source_domain, CAST(user_id AS VARCHAR) AS source_ip FROM events LEFT JOIN customer ON c_custkey = user_id""")
def host_name_stage(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ip"), F.col("c_name").alias("host"))
    df = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("source.ip"))
    return pick(run(df, *enrich.host_names(Lookup(hosts, "ip", ["host"]))), "event_id", "source.domain", "source.ip")


_KEA = f"[hwtype=1 ', {L.MAC}, '], cid=[01:02], tid=0x1f"
_KEA_TEXT = f"""CASE event_id % 5 WHEN 0 THEN 'INFO [t.1] DHCP4_QUERY_LABEL received query' WHEN 1 THEN concat('REBOOT {_KEA}: moved to ', {L.SOURCE_IP})
    WHEN 2 THEN concat('ADVERT {_KEA}: lease ', {L.SOURCE_IP}) WHEN 3 THEN concat('ALLOC {_KEA}: lease ', {L.SOURCE_IP}, ' for x 3600') ELSE 'EXECUTE all' END"""


@query("kea_dhcp4_forms", f"""
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'DHCP4_QUERY_LABEL' WHEN 1 THEN 'REBOOT' WHEN 2 THEN 'ADVERT' WHEN 3 THEN 'ALLOC' ELSE 'EXECUTE' END AS operation,
      CASE WHEN event_id % 5 BETWEEN 1 AND 3 THEN {L.MAC} END AS mac, CASE WHEN event_id % 5 BETWEEN 1 AND 3 THEN {L.SOURCE_IP} END AS ip,
      CASE WHEN event_id % 5 BETWEEN 1 AND 3 THEN '0x1f' END AS lease, CASE event_id % 5 WHEN 0 THEN 'received query' END AS message,
      CASE event_id % 5 WHEN 4 THEN ' all' END AS executed FROM events""")
def kea_dhcp4_forms(spark: SparkSession, sf: str) -> DataFrame:
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(L.text(f"concat({L.header('kea-dhcp4')}, {_KEA_TEXT})"))), "line", preset="syslog")
    k = "kea.dhcp."
    return pick(chain_of(*apps.kea_dhcp()).apply(df), "event_id", operation=k + "operation", mac=k + "client.mac", ip=k + "client.ip", lease=k + "lease.id",
                message=k + "message", executed="kea.message")


@query("kea_dhcp6", "SELECT event_id, concat('any text ', CAST(event_id AS VARCHAR)) AS filter_message, 'pfelk,firewall_raw,kea-dhcp,dhcp6' AS tags, 'pfelk.kea-dhcp6' AS dataset FROM events")
def kea_dhcp6(spark: SparkSession, sf: str) -> DataFrame:
    line = f"concat({L.header('kea-dhcp6')}, 'any text ', event_id)"
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(line)), "line", preset="syslog")
    return pick(chain_of(*apps.kea_dhcp()).apply(df), "event_id", "filter_message", "tags", dataset="event.dataset")


_LEASES = f"""CASE event_id % 7 WHEN 0 THEN concat('DHCPDISCOVER from ', {L.MAC}, ' (box) via igb1') WHEN 1 THEN concat('DHCPREQUEST for ', {L.SOURCE_IP}, ' from ', {L.MAC}, ' via igb1')
    WHEN 2 THEN concat('DHCPRELEASE of ', {L.SOURCE_IP}, ' from ', {L.MAC}, ' via igb1 (found)') WHEN 3 THEN concat('DHCPDECLINE of ', {L.SOURCE_IP}, ' from ', {L.MAC}, ' via igb1')
    WHEN 4 THEN concat('DHCPNACK on ', {L.SOURCE_IP}, ' to ', {L.MAC}, ' via igb1') WHEN 5 THEN concat('DHCPINFORM from ', {L.SOURCE_IP}, ' via igb1')
    ELSE 'Reply NA: address 2001:db8::5 to client with duid 00:01 iaid = 7 valid for 3600 seconds' END"""


@query("dhcp_patterns", f"""
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'DISCOVER' WHEN 1 THEN 'REQUEST' WHEN 2 THEN 'RELEASE' WHEN 3 THEN 'DECLINE' WHEN 4 THEN 'NACK' WHEN 5 THEN 'INFORM' END AS operation,
      CASE WHEN event_id % 7 < 5 THEN {L.MAC} END AS mac, CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN {L.SOURCE_IP} END AS ip, CASE WHEN event_id % 7 < 6 THEN 'igb1' END AS interface,
      CASE event_id % 7 WHEN 0 THEN 'box' END AS hostname, CASE event_id % 7 WHEN 6 THEN 'Reply' END AS v6, CASE event_id % 7 WHEN 6 THEN '2001:db8::5' END AS v6_ip,
      CASE event_id % 7 WHEN 6 THEN '3600' END AS seconds FROM events""")
def dhcp_patterns(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.expr(L.text(_LEASES)).alias("line"))
    return pick(run(df, grok("line", "%{DHCPD}")), "event_id", operation="dhcp.operation", mac="dhcpv4.client.mac", ip="dhcpv4.client.ip", interface="interface.name",
                hostname="dhcpv4.option.hostname", v6="dhcpv6.operation", v6_ip="dhcpv6.client.ip", seconds="dhcpv6.lease.duration")


@query("user_agent_stage", """
    SELECT event_id, CASE WHEN event_id % 2 = 1 THEN 'Linux' END AS os, CASE WHEN event_id % 2 = 0 THEN 'Linux' END AS os_full,
      CASE WHEN event_id % 2 = 0 THEN 'phone' END AS device_name, CAST(7 AS BIGINT) AS length FROM events""")
def user_agent_stage(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.lit("agent 1").alias("user_agent.original"), F.lit("Linux").alias("user_agent.os"), F.lit("phone").alias("user_agent.device"),
                                           F.expr("CASE WHEN event_id % 2 = 0 THEN 'true' END").alias("@metadata.ua_parse"))
    return pick(run(df, *enrich.user_agents()), "event_id", os="user_agent.os", os_full="user_agent.os.full", device_name="user_agent.device.name", length="user_agent.meta.total_length")
