"""The complete chain: mixed lines to finished records, with every enrichment table given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.core import pick
from checks.domain import BLOCK, BLOCK_TAG, rules
from checks.registry import query, table
from logweave.operators.lookup import Lookup, NetworkTable, geo_table
from logweave.plans import enrich
from logweave.plans.full import Tables, complete_records
from logweave.sources import literal_table

S, T, SP, PORT = L.SOURCE_IP, L.TARGET_IP, L.SOURCE_PORT, L.PORT


def every_table(spark: SparkSession, sf: str) -> Tables:
    """Rules, ports, private hosts, host names, interfaces, places and owners; each with hits and misses."""
    ports = Lookup(literal_table(spark, [("22", "ssh"), ("53", "domain")], ["key", "value"]))
    hosts = table(spark, sf, "customer").select(F.expr("concat('10.', c_custkey % 40, '.0.', c_custkey % 256)").alias("key"), F.col("c_name").alias("value"))
    names = table(spark, sf, "nation").select(F.expr("concat('203.0.113.', n_nationkey)").alias("ip"), F.expr("concat('host-', n_name)").alias("host"))
    city = geo_table(literal_table(spark, [
        ("203.0.113.0/25", "Lowland", "LO", "Lowtown"), ("203.0.113.128/26", "Highland", "HI", "Hightown"), ("203.0.113.160/27", "Highland", "HI", "Deepdale"),
    ], ["network", "country_name", "country_code2", "city_name"]))
    asn = NetworkTable(literal_table(spark, [("203.0.113.64/26", "AS64"), ("203.0.113.240/28", "AS240")], ["network", "as_name"]))
    known = enrich.interface_table(spark, [("fw0", "igb0", "LAN", "lan net"), ("fw1", "^igb[12]$", "OPT", None)])
    return Tables(
        rule_names=rules(spark), port_names=ports, private_hosts=Lookup(hosts), host_names=Lookup(names, "ip", ["host"]), interfaces=known,
        city=city, asn=asn, home={"[client][geo][city_name]": "Home"},
    )


_D = "event_id % 256"
_HOST = "user_id % 3"
_PORT_NAME = f"CASE {PORT} WHEN '22' THEN 'ssh' WHEN '53' THEN 'domain' ELSE 'port-' || {PORT} END"
_REVERSE = f"CASE WHEN {_D} < 25 THEN 'host-' || (SELECT n_name FROM nation WHERE n_nationkey = {_D}) ELSE {T} END"
_CLIENT_NAME = f"lower(coalesce((SELECT min(c_name) FROM customer WHERE '10.' || CAST(c_custkey % 40 AS VARCHAR) || '.0.' || CAST(c_custkey % 256 AS VARCHAR) = {S}), {S}))"
_ALIAS = f"""CASE WHEN {_HOST} = 0 THEN CASE WHEN user_id % 4 = 0 THEN 'LAN' ELSE {L.INTERFACE} END
    WHEN {_HOST} = 1 THEN CASE WHEN user_id % 4 IN (1, 2) THEN 'OPT' ELSE {L.INTERFACE} END END"""
_NETWORK = f"""CASE WHEN {_HOST} = 0 THEN CASE WHEN user_id % 4 = 0 THEN 'lan net' ELSE {L.INTERFACE} END
    WHEN {_HOST} = 1 THEN CASE WHEN user_id % 4 IN (1, 2) THEN NULL ELSE {L.INTERFACE} END END"""
_COUNTRY = f"CASE WHEN {_D} < 128 THEN 'Lowland' WHEN {_D} < 192 THEN 'Highland' END"
_CODE = f"CASE WHEN {_D} < 128 THEN 'LO' WHEN {_D} < 192 THEN 'HI' END"
_CITY = f"CASE WHEN {_D} < 128 THEN 'Lowtown' WHEN {_D} BETWEEN 160 AND 191 THEN 'Deepdale' WHEN {_D} < 192 THEN 'Hightown' END"
_OWNER = f"CASE WHEN {_D} BETWEEN 64 AND 127 THEN 'AS64' WHEN {_D} >= 240 THEN 'AS240' END"
_PLACE = {"destination.geo.country_name": _COUNTRY, "destination.geo.country_code3": _CODE, "destination.geo.city_name": _CITY, "destination.geo.as_name": _OWNER}
_BOTH = {"source.ip": S, "source.domain": S, "destination.ip": T, "destination.domain": _REVERSE, "source.port": SP, "destination.port": PORT, **_PLACE}
_CLIENT = {"client.ip": S, "client.subdomain": _CLIENT_NAME, "client.geo.city_name": "'Home'"}

# What each log type's records hold, besides the columns that all have.
_OF: dict[str, dict[str, str]] = {
    "filterlog": {
        "tags": f"concat('pfelk,firewall_raw,firewall', {BLOCK_TAG}, ',IP_Private_Source,GeoIP_Destination')", "rule.id": "CAST(event_id % 7 AS VARCHAR)", "rule.uuid": L.RULE_UUID,
        "rule.description": f"CASE {L.RULE_UUID} WHEN '1000000101' THEN 'first rule' WHEN '1000000102' THEN 'second, later' WHEN '1000000103' THEN 'third rule' ELSE concat('Rule ID: ', {L.RULE_UUID}) END",
        "interface.name": L.INTERFACE, "interface.alias": _ALIAS, "network.name": _NETWORK, "event.reason": "'match'", "event.action": L.ACTION,
        "network.direction": "CASE WHEN event_id % 2 = 0 THEN 'ingress' ELSE 'out' END", "network.type": "'ipv4'", "network.protocol": L.PROTOCOL,
        "network.iana_number": "CASE WHEN event_id % 5 < 3 THEN '6' ELSE '17' END", "pf.tos": "'0x0'", "pf.ttl": "'64'", "pf.id": "'0'", "pf.offset": "'0'", "pf.flags": "'DF'",
        "pf.tcp.flags": f"CASE WHEN event_id % 5 < 3 THEN {L.FLAGS} END", "pf.block_reason": BLOCK, "pf.tcp.window": "CASE WHEN event_id % 5 < 3 THEN '1024' END",
        "pf.tcp.options": "CASE WHEN event_id % 5 < 3 THEN 'mss,TS' END",
        "pf.tcp.sequence_number": "CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 10 = 0 THEN event_id ELSE 1 END END",
        "pf.tcp.sequence_number_range_end": "CASE WHEN event_id % 10 = 0 THEN event_id + 9 END",
        "source.bytes": "CASE WHEN event_id % 2 = 0 THEN '0' END", "source.packets": "CASE WHEN event_id % 2 = 0 THEN '60' END",
        "destination.bytes": "CASE WHEN event_id % 2 = 1 THEN '0' END", "destination.packets": "CASE WHEN event_id % 2 = 1 THEN '60' END",
        "source.service.name": f"'port-' || {SP}", "destination.service.name": _PORT_NAME, **_BOTH,
    },
    "unbound": {
        "tags": "'pfelk,firewall_raw,unbound,Private_Client_IP'", **_CLIENT, "log.level": "'info'", "process.pgid": "CAST(user_id AS VARCHAR)", "process.thread.id": "'0'",
        "dns.question.name": f"concat({L.DOMAIN}, '.')", "dns.question.type": "'A'", "dns.question.class": "'IN'", "dns.return_code": "'NOERROR'", "dns.timing": "'0.000123'",
        "dns.from_cache": "CAST(event_id % 2 AS VARCHAR)", "dns.response_size": "CAST(40 + event_id % 100 AS VARCHAR)",
        "dns.question.registered_domain": "concat('site', CAST(event_id % 50 AS VARCHAR), '.example')", "dns.question.top_level_domain": "'example'",
    },
    "sshd": {
        "tags": "concat('pfelk,firewall_raw,sshd', CASE WHEN event_id % 3 = 2 THEN ',_grokparsefailure' ELSE ',IP_Private_Source' END)",
        "event.reason": "CASE WHEN event_id % 3 = 0 THEN 'Authentication error' WHEN event_id % 3 = 2 THEN 'kex reset' END", "user.name": f"CASE WHEN event_id % 3 < 2 THEN {L.USER} END",
        "source.ip": f"CASE WHEN event_id % 3 < 2 THEN {S} END", "source.domain": f"CASE WHEN event_id % 3 < 2 THEN {S} END", "event.auth_method": "CASE WHEN event_id % 3 = 1 THEN 'publickey' END",
        "event.outcome": "CASE WHEN event_id % 3 = 1 THEN 'success' ELSE 'failure' END", "event.action": "CASE WHEN event_id % 3 = 1 THEN 'authentication_success' ELSE 'authentication_failure' END",
        "log.level": "CASE WHEN event_id % 3 = 2 THEN 'error' END", "event.category": "'authentication'",
    },
    "php-fpm": {
        "tags": """concat('pfelk,firewall_raw,web_portal', CASE WHEN event_id % 3 = 0 THEN ',authentication_failure,auth_error,IP_Private_Source'
            WHEN event_id % 3 = 1 THEN ',authentication_success,IP_Private_Source' ELSE '' END)""",
        "pf.app.action": "CASE WHEN event_id % 3 = 0 THEN 'webconfigurator authentication error' WHEN event_id % 3 = 1 THEN 'successful login' ELSE 'page viewed' END",
        "url.path": "CASE WHEN event_id % 3 = 2 THEN '/status.php' ELSE '/index.php' END", "user.name": f"CASE WHEN event_id % 3 < 2 THEN {L.USER} END",
        "source.ip": f"CASE WHEN event_id % 3 < 2 THEN {S} END", "source.domain": f"CASE WHEN event_id % 3 < 2 THEN {S} END",
        "event.action": "CASE WHEN event_id % 3 = 0 THEN 'authentication_failure' WHEN event_id % 3 = 1 THEN 'authentication_success' ELSE 'web_portal_activity' END",
        "event.outcome": "CASE WHEN event_id % 3 = 0 THEN 'failure' WHEN event_id % 3 = 1 THEN 'success' END", "event.category": "'web_application'",
        "event.severity": "CAST(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS BIGINT)",
    },
    "sshguard": {
        "tags": "'pfelk,firewall_raw,sshguard,IP_Private_Source'", "event.action": "CASE WHEN event_id % 2 = 0 THEN 'attack' ELSE 'blocking' END", "source.ip": S, "source.domain": S,
        "sshguard.service": "CASE WHEN event_id % 2 = 0 THEN 'unknown service' END", "sshguard.block_duration": "CASE WHEN event_id % 2 = 1 THEN CAST(120 AS BIGINT) END",
        "sshguard.attack_count": "CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 9 AS VARCHAR) END", "event.category": "'intrusion_detection'",
    },
    "kea-dhcp4": {
        "tags": "'pfelk,firewall_raw,kea-dhcp,dhcp4,Private_Client_IP'", "log.level": "'INFO'", "client.geo.city_name": "'Home'", "client.subdomain": _CLIENT_NAME, "kea.dhcp.client.ip": S,
        "kea.dhcp.client.mac": L.MAC, "kea.dhcp.operation": "CASE WHEN event_id % 2 = 0 THEN 'DHCP4_PACKET_RECEIVED' ELSE 'DHCP4_LEASE_ALLOC' END", "kea.dhcp.transaction.id": "'0x1f'",
        "interface.name": f"CASE WHEN event_id % 2 = 0 THEN {L.INTERFACE} END", "interface.alias": f"CASE WHEN event_id % 2 = 0 THEN {_ALIAS} END",
        "network.name": f"CASE WHEN event_id % 2 = 0 THEN {_NETWORK} END",
    },
    "snort": {
        "tags": "'pfelk,firewall_raw,snort,IP_Private_Source,GeoIP_Destination'", "rule.uuid": "'1'", "rule.reference": "CAST(2000 + event_id % 6 AS VARCHAR)", "rule.version": "'7'",
        "vulnerability.description": "'SCAN probe'", "event.severity": "1 + event_id % 3", "network.transport": "'TCP'", "agent.type": "'snort'", "event.category": "'intrusion_detection'", **_BOTH,
    },
    "(squid-1)": {
        "tags": "'pfelk,firewall_raw,squid,Private_Client_IP'", **_CLIENT, "labels.request_status": "'TCP_MISS'", "http.response.body.status_code": "'200'",
        "http.response.bytes": "CAST(100 + event_id % 900 AS VARCHAR)", "http.request.method": "'GET'", "url.scheme": "'http'", "url.domain": L.DOMAIN, "url.port": "'8080'",
        "url.path": "concat('p', CAST(event_id % 5 AS VARCHAR))", "destination.address": T, "http.response.mime_type": "'text/html'",
    },
    "nginx": {
        "tags": "'pfelk,firewall_raw,nginx,IP_Private_Proxy'", "client.ip": S, "nginx.access.user_name": L.USER, "nginx.access.response_code": "'200'",
        "nginx.access.url": "concat('/p', CAST(event_id % 5 AS VARCHAR))", "nginx.access.agent": "'agent x'",
    },
    "haproxy": {
        "tags": "'pfelk,firewall_raw,haproxy,IP_Private_Proxy'", "client.ip": S, "client.port": "CAST(1024 + event_id % 60000 AS BIGINT)", "haproxy.frontend_name": "'front'",
        "haproxy.server_name": "'srv'", "haproxy.bytes_read": "100 + event_id % 900", "http.response.status_code": "CAST(200 AS BIGINT)", "http.request.method": "'GET'",
        "http.mode": "concat('/p', CAST(event_id % 5 AS VARCHAR))",
    },
    "dpinger": {"tags": "'pfelk,firewall_raw,dpinger'"},
}

_SETS = ("firewall", "unbound", "sshd", "webportal", "sshguard", "kea-dhcp4", "snort", "squid", "nginx", "haproxy", "dpinger")
_SPACES = ("firewall", "unbound", "sshd", "firewall_services", "sshguard", "kea-dhcp", "snort", "squid", "nginx", "haproxy", "firewall_services")
_NAMES = ("firewall", "unbound", "sshd", "php-fpm", "sshguard", "kea-dhcp", "snort", "squid", "nginx", "haproxy", "dpinger")


def _by_type(values: dict[str, str]) -> str:
    """One value for each program of the mixed stream."""
    return "CASE " + " ".join(f"WHEN event_id % 20 < {u} THEN {values.get(p, 'NULL')}" for u, p in L.MIX) + " END"


def _fixed(names: tuple[str, ...], form: str = "'{}'") -> str:
    return _by_type({p: form.format(n) for (_, p), n in zip(L.MIX, names, strict=True)})


_COLUMNS = list(dict.fromkeys(c for columns in _OF.values() for c in columns))
_COMMON = {
    "log.syslog.priority": "'134'", "log.syslog.version": "'1'", "log.syslog.timestamp": "strftime(ts, '%Y-%m-%dT%H:%M:%S')", "log.syslog.hostname": L.HOST,
    "log.syslog.procid": "CAST(event_id AS VARCHAR)", "log.syslog.appname": _fixed(_NAMES), "event.dataset": _fixed(_SETS, "'pfelk.{}'"),
    "data_stream.dataset": _fixed(_SETS, "'pfelk.{}'"), "data_stream.namespace": _fixed(_SPACES),
}


def _name(path: str) -> str:
    return path.replace(".", "_")


_SQL = "SELECT event_id, " + ", ".join(
    [f"{sql} AS {_name(c)}" for c, sql in _COMMON.items()] + [f"{_by_type({p: own[c] for p, own in _OF.items() if c in own})} AS {_name(c)}" for c in _COLUMNS]
) + " FROM events"


@query("full_chain", _SQL)
def full_chain_query(spark: SparkSession, sf: str) -> DataFrame:
    """All log types through every stage; more than a hundred columns of the finished records."""
    out = complete_records(spark, L.mixed_lines(spark, sf), every_table(spark, sf))
    return pick(out, "event_id", *_COMMON, *_COLUMNS)
