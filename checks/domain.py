"""Queries for whole log types, views, audit, routing, and the complete chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.core import SSHD, networks, pick, run
from checks.registry import query, table
from logweave import Chain, flatten, stage, to_nested
from logweave.operators import mutate
from logweave.operators.lookup import Lookup, geo_table
from logweave.pipeline import dispatch
from logweave.plans import apps, audit, cleanup, dns_server, enrich, firewall, intrusion, unwrap, views
from logweave.plans.full import parse_chain
from logweave.plans.sample import sample_chain
from logweave.sinks import route
from logweave.sources import as_events, literal_table


def chain_of(*cases) -> Chain:
    return Chain([stage("unwrap", *unwrap.unwrap()), stage("type", dispatch(*cases))])


def parsed(spark: SparkSession, sf: str, program: str, *cases) -> DataFrame:
    return chain_of(*cases).apply(L.program_lines(spark, sf, program))


S, T, SP, PORT = L.SOURCE_IP, L.TARGET_IP, L.SOURCE_PORT, L.PORT

# ---- wrappers ----------------------------------------------------------------------------


@query("unwrap_suricata", f"""
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '13' END AS priority, CASE WHEN event_id % 2 = 0 THEN 'Feb 20 00:27:24' END AS stamp,
      CASE WHEN event_id % 2 = 0 THEN {L.HOST} END AS host, '{{"event_type":"alert"}}' AS body FROM events""")
def unwrap_suricata(spark: SparkSession, sf: str) -> DataFrame:
    text = L.text(f"CASE WHEN event_id % 2 = 0 THEN concat('<13>Feb 20 00:27:24 ', {L.HOST}, ' suricata: {{\"event_type\":\"alert\"}}')"
                  " ELSE '{\"event_type\":\"alert\"}' END")
    out = run(as_events(L.events(spark, sf).withColumn("m", F.expr(text)), "m", preset="suricata"), *unwrap.unwrap())
    return pick(out, "event_id", priority="log.syslog.priority", stamp="log.syslog.timestamp", host="log.syslog.hostname", body="filter_message")


def _unbound_input(spark: SparkSession, sf: str) -> DataFrame:
    inner = "CASE WHEN event_id % 2 = 0 THEN concat(stamp, 'Z fw unbound 77 - - ') ELSE '' END"
    text = L.text(f"concat('<30>1 ', stamp, 'Z ', {L.HOST}, ' unbound 77 - [meta sequenceId=\"', CAST(event_id AS VARCHAR(9)), '\"] ', {inner}, {L.unbound_text()})")
    return as_events(L.events(spark, sf).withColumn("m", F.expr(text)), "m", preset="unbound").drop("stamp")


UNBOUND = (f"concat('[', CAST(user_id AS VARCHAR(9)), ':0] info: ', {S}, ' ', {L.DOMAIN}, '. A IN NOERROR"
           " 0.000123 ', CAST(event_id % 2 AS VARCHAR(9)), ' ', CAST(40 + event_id % 100 AS VARCHAR(9)))")


@query("unwrap_unbound", f"SELECT event_id, CAST(event_id AS VARCHAR) AS sequence, {L.HOST} AS host, {UNBOUND} AS body FROM events WHERE event_id % 2 = 0 "
       f"UNION ALL SELECT event_id, CAST(event_id AS VARCHAR), {L.HOST}, concat('<30>1 ', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z ', {L.HOST}, ' unbound 77 - [meta sequenceId=\"', CAST(event_id AS VARCHAR(9)), '\"] ', {UNBOUND}) FROM events WHERE event_id % 2 = 1")
def unwrap_unbound(spark: SparkSession, sf: str) -> DataFrame:
    return pick(run(_unbound_input(spark, sf), *unwrap.unwrap()), "event_id", sequence="event.sequence", host="log.syslog.hostname", body="filter_message")


# ---- packet filter -----------------------------------------------------------------------

BLOCK = (f"CASE WHEN event_id % 5 >= 3 THEN NULL WHEN {L.FLAGS} IN ('FA', 'PA') THEN 'TCP Out-of-State (Harmless)'"
         f" WHEN {L.FLAGS} = 'S' AND event_id % 3 = 0 THEN 'New Connection Attempt (Blocked)' END")
BLOCK_TAG = (f"CASE WHEN event_id % 5 >= 3 THEN '' WHEN {L.FLAGS} IN ('FA', 'PA') THEN ',out_of_state'"
             f" WHEN {L.FLAGS} = 'S' AND event_id % 3 = 0 THEN ',unauthorized_attempt' ELSE '' END")


def _filterlog_sql(source: str, target: str, kind: str, size: str) -> str:
    return f"""
    SELECT event_id, CAST(event_id % 7 AS VARCHAR) AS rule_id, {L.RULE_UUID} AS rule_uuid, {L.INTERFACE} AS interface_name, {L.ACTION} AS event_action,
      CASE WHEN event_id % 2 = 0 THEN 'ingress' ELSE 'out' END AS network_direction, '{kind}' AS network_type, {L.PROTOCOL} AS network_protocol,
      {source} AS source_ip, {target} AS destination_ip, {SP} AS source_port, {PORT} AS destination_port,
      CASE WHEN event_id % 5 < 3 THEN {L.FLAGS} END AS pf_tcp_flags, {BLOCK} AS pf_block_reason,
      CASE WHEN event_id % 2 = 0 THEN '0' END AS source_bytes, CASE WHEN event_id % 2 = 0 THEN '60' END AS source_packets,
      CASE WHEN event_id % 2 = 1 THEN '0' END AS destination_bytes, CASE WHEN event_id % 2 = 1 THEN '60' END AS destination_packets,
      '{size}' AS ttl, concat('pfelk,firewall_raw,firewall', {BLOCK_TAG}) AS tags, 'pfelk.firewall' AS event_dataset, 'firewall' AS data_stream_namespace FROM events"""


FILTERLOG = ("rule.id", "rule.uuid", "interface.name", "event.action", "network.direction", "network.type", "network.protocol",
             "source.ip", "destination.ip", "source.port", "destination.port", "pf.tcp.flags", "pf.block_reason", "source.bytes",
             "source.packets", "destination.bytes", "destination.packets", "tags", "event.dataset", "data_stream.namespace")


@query("filterlog_v4", _filterlog_sql(S, T, "ipv4", "64"))
def filterlog_v4(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "filterlog", *firewall.filterlog()), "event_id", *FILTERLOG, ttl="pf.ttl")


@query("filterlog_v6", _filterlog_sql(L.V6_SOURCE, "'fe80::1'", "ipv6", "64"))
def filterlog_v6(spark: SparkSession, sf: str) -> DataFrame:
    line = f"concat({L.header('filterlog')}, {L.filterlog_text(6)})"
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(line)), "line", preset="syslog")
    return pick(chain_of(*firewall.filterlog()).apply(df), "event_id", *FILTERLOG, ttl="pf.hoplimit")


def rules(spark: SparkSession) -> Lookup:
    """Names of three rules, one of them given twice."""
    rows = [("1000000101", "first rule", 0), ("1000000102", "second", 1), ("1000000102", "second, later", 2), ("1000000103", "third rule", 3)]
    return Lookup(literal_table(spark, rows, ["key", "value", "place"]), order="place")


@query("firewall_blocked_by_rule", f"""
    SELECT {L.RULE_UUID} AS rule_uuid, CASE {L.RULE_UUID} WHEN '1000000101' THEN 'first rule' WHEN '1000000102' THEN 'second, later' WHEN '1000000103' THEN 'third rule'
        ELSE concat('Rule ID: ', {L.RULE_UUID}) END AS rule_description, {S} AS source_ip, count(*) AS lines
    FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0 AND event_id % 5 < 3 GROUP BY ALL""")
def firewall_blocked_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    chain = chain_of(*firewall.filterlog()) + Chain([stage("rules", *enrich.rule_names(rules(spark)))])
    out = route(chain.apply(L.program_lines(spark, sf, "filterlog")))
    view = views.firewall_view(out)
    hits = view.filter((F.col("action") == "BLOCK") & (F.col("direction") == "INGRESS") & (F.col("protocol") == "TCP"))
    return hits.groupBy("rule_uuid", "rule_description", "source_ip").agg(F.count("*").alias("lines"))


# ---- services ----------------------------------------------------------------------------


@query("captive_portal", f"SELECT event_id, 'LAN' AS alias, 'zone1' AS zone, 'ACCEPT' AS event_action, {L.USER} AS client_user_name, {L.MAC} AS client_mac, {S} AS client_ip, 'pfelk,firewall_raw,captive' AS tags, 'captiveportal' AS appname FROM events")
def captive_portal(spark: SparkSession, sf: str) -> DataFrame:
    line = f"concat({L.header('logportalauth')}, {L.captive_text()})"
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(line)), "line", preset="syslog")
    return pick(chain_of(*apps.captive_portal()).apply(df), "event_id", "event.action", "client.user.name", "client.mac", "client.ip", "tags",
                alias="observer.ingress.interface.alias", zone="observer.ingress.zone", appname="log.syslog.appname")


@query("haproxy", f"SELECT event_id, {S} AS client_ip, CAST(1024 + event_id % 60000 AS BIGINT) AS client_port, 'front' AS front, 'srv' AS server, CAST(event_id % 4 AS VARCHAR) AS time_request, CAST(200 AS BIGINT) AS status, 100 + event_id % 900 AS bytes_read, 'GET' AS method, concat('/p', CAST(event_id % 5 AS VARCHAR)) AS http_mode, '1.1' AS http_version, 'haproxy' AS namespace FROM events")
def haproxy(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "haproxy", *apps.haproxy()), "event_id", "client.ip", "client.port", "http.mode", "http.version",
                front="haproxy.frontend_name", server="haproxy.server_name", time_request="haproxy.time_request", status="http.response.status_code",
                bytes_read="haproxy.bytes_read", method="http.request.method", namespace="data_stream.namespace")


@query("nginx", f"SELECT event_id, {S} AS client_ip, {L.USER} AS who, 'GET' AS method, concat('/p', CAST(event_id % 5 AS VARCHAR)) AS url, '200' AS code, CAST(100 + event_id % 900 AS VARCHAR) AS bytes, 'agent x' AS agent, '01/Jan/2024:00:00:07 +0000' AS timestamp FROM events")
def nginx(spark: SparkSession, sf: str) -> DataFrame:
    a = "nginx.access."
    return pick(parsed(spark, sf, "nginx", *apps.nginx()), "event_id", "client.ip", "timestamp", who=a + "user_name", method=a + "method", url=a + "url",
                code=a + "response_code", bytes=a + "body_sent.bytes", agent=a + "agent")


@query("plain_services", """SELECT event_id, concat('pfelk,firewall_raw,', CASE event_id % 4 WHEN 0 THEN 'dpinger' WHEN 1 THEN 'ntpd' WHEN 2 THEN 'bind9' ELSE 'openvpn' END) AS tags,
    CASE event_id % 4 WHEN 0 THEN 'pfelk.dpinger' WHEN 1 THEN 'pfelk.ntpd' WHEN 2 THEN 'pfelk.bind9' ELSE 'pfelk.openvpn' END AS event_dataset,
    CASE event_id % 4 WHEN 3 THEN 'openvpn' ELSE 'firewall_services' END AS data_stream_namespace, CASE event_id % 4 WHEN 0 THEN 'dpinger' WHEN 1 THEN 'ntpd' WHEN 2 THEN 'named' ELSE 'openvpn' END AS appname FROM events""")
def plain_services(spark: SparkSession, sf: str) -> DataFrame:
    cases = " ".join(f"WHEN event_id % 4 = {i} THEN {L.header(n)}" for i, n in enumerate(("dpinger", "ntpd", "named", "openvpn_server")))
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(f"concat(CASE {cases} END, 'text')")), "line", preset="syslog")
    return pick(chain_of(*apps.dpinger(), *apps.ntpd(), *apps.named_server(), *apps.openvpn()).apply(df), "event_id", "tags", "event.dataset",
                "data_stream.namespace", appname="log.syslog.appname")


@query("snort", f"SELECT event_id, '1' AS rule_uuid, CAST(2000 + event_id % 6 AS VARCHAR) AS rule_reference, '7' AS rule_version, 'SCAN probe' AS description, 'Misc' AS classification, 1 + event_id % 3 AS event_severity, 'TCP' AS network_transport, {S} AS source_ip, {SP} AS source_port, {T} AS destination_ip, {PORT} AS destination_port, 'snort' AS agent_type FROM events")
def snort(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "snort", *apps.snort()), "event_id", "rule.uuid", "rule.reference", "rule.version", "event.severity", "network.transport",
                "source.ip", "source.port", "destination.ip", "destination.port", "agent.type", description="vulnerability.description", classification="vulnerability.classification")


@query("squid_plain", f"SELECT event_id, {S} AS client_ip, 'TCP_MISS' AS status, '200' AS code, CAST(100 + event_id % 900 AS VARCHAR) AS bytes, 'GET' AS method, 'http' AS url_scheme, {L.DOMAIN} AS url_domain, '8080' AS url_port, concat('p', CAST(event_id % 5 AS VARCHAR)) AS url_path, {T} AS destination_address, 'text/html' AS mime, 'pfelk,firewall_raw,squid' AS tags, 'squid' AS appname FROM events")
def squid_plain(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "(squid-1)", *apps.squid()), "event_id", "client.ip", "url.scheme", "url.domain", "url.port", "url.path", "destination.address",
                "tags", status="labels.request_status", code="http.response.body.status_code", bytes="http.response.bytes", method="http.request.method",
                mime="http.response.mime_type", appname="log.syslog.appname")


@query("squid_json", f"SELECT event_id, {S} AS client_ip, concat('http://', {L.DOMAIN}, ':8080/p') AS url_original, concat({L.DOMAIN}, ':8080') AS url_domain, '/p' AS url_path, CAST(200 AS BIGINT) AS status, 'pfelk,firewall_raw,squid' AS tags FROM events")
def squid_json(spark: SparkSession, sf: str) -> DataFrame:
    body = L.text(f"""concat('{{"client":{{"ip":"', {S}, '"}},"url":{{"original":"http://', {L.DOMAIN}, ':8080/p"}},"http":{{"response":{{"body":{{"status_code":200}}}}}}}}')""")
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(f"concat({L.header('(squid-1)')}, {body})")), "line", preset="syslog")
    return pick(chain_of(*apps.squid()).apply(df), "event_id", "client.ip", "url.original", "url.domain", "url.path", "tags", status="http.response.status_code")


@query("sshd", f"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Authentication error' WHEN event_id % 3 = 2 THEN 'kex reset' END AS event_reason,
    CASE WHEN event_id % 3 < 2 THEN {L.USER} END AS user_name, CASE WHEN event_id % 3 < 2 THEN {S} END AS source_ip, CASE WHEN event_id % 3 = 1 THEN 'publickey' END AS event_auth_method,
    CASE WHEN event_id % 3 = 1 THEN 'success' ELSE 'failure' END AS event_outcome, CASE WHEN event_id % 3 = 1 THEN 'authentication_success' ELSE 'authentication_failure' END AS event_action,
    CASE WHEN event_id % 3 = 2 THEN 'error' END AS log_level, concat('pfelk,firewall_raw,sshd', CASE WHEN event_id % 3 = 2 THEN ',_grokparsefailure' ELSE '' END) AS tags FROM events""")
def sshd(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "sshd", *apps.sshd()), "event_id", "event.reason", "user.name", "source.ip", "event.auth_method", "event.outcome", "event.action", "log.level", "tags")


UNBOUND_COLUMNS = f"""CAST(user_id AS VARCHAR) AS process_pgid, '0' AS thread, 'info' AS log_level, {S} AS client_ip, concat({L.DOMAIN}, '.') AS name, 'A' AS qtype, 'IN' AS class,
    'NOERROR' AS dns_return_code, '0.000123' AS dns_timing, CAST(event_id % 2 AS VARCHAR) AS dns_from_cache, CAST(40 + event_id % 100 AS VARCHAR) AS dns_response_size,
    concat('site', CAST(event_id % 50 AS VARCHAR), '.example') AS domain, 'example' AS tld"""
UNBOUND_PICK = dict(thread="process.thread.id", name="dns.question.name", qtype="dns.question.type", domain="dns.question.registered_domain", tld="dns.question.top_level_domain")
UNBOUND_PICK["class"] = "dns.question.class"
UNBOUND_NAMES = ("event_id", "process.pgid", "log.level", "client.ip", "dns.return_code", "dns.timing", "dns.from_cache", "dns.response_size")


@query("unbound_queries", f"SELECT event_id, {UNBOUND_COLUMNS}, 'pfelk,firewall_raw,unbound' AS tags FROM events")
def unbound_queries(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "unbound", *dns_server.unbound()), *UNBOUND_NAMES, "tags", **UNBOUND_PICK)


@query("unbound_wrapped", f"SELECT event_id, {UNBOUND_COLUMNS}, 'pfelk,unbound_raw,unbound' AS tags FROM events")
def unbound_wrapped(spark: SparkSession, sf: str) -> DataFrame:
    return pick(chain_of(*dns_server.unbound()).apply(_unbound_input(spark, sf)), *UNBOUND_NAMES, "tags", **UNBOUND_PICK)


_MESSAGES = (
    ("Verified that A response is VALIDATION_SUCCESS", "validation", "dnssec_validation"),
    ("NSEC3s for the referral proved no DS.", "proof", "dnssec_proof"),
    ("validation failure bad.example. A IN", "validation_failure", "dnssec_failure"),
    ("failed to prime trust anchor: could not fetch DNSKEY", "trust_anchor", "dnssec_anchor"),
    ("sendto failed: Network unreachable", None, "network_error"),
    ("query response was nodata ANSWER", None, None),
    ("resolving x.site.example. AAAA IN", None, None),
    ("gibberish", None, None),
)
_KIND = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{k}'" for i, (_, k, _) in enumerate(_MESSAGES) if k) + " END"
_TAG = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN ',{t}'" for i, (_, _, t) in enumerate(_MESSAGES) if t) + " WHEN 7 THEN ',grok_fail_35_unbound_inline_resolving' ELSE '' END"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    body = "CASE event_id % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, (m, _, _) in enumerate(_MESSAGES)) + " END"
    line = f"concat({L.header('unbound')}, '[9:1] info: ', {body})"
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(line)), "line", preset="syslog")
    return chain_of(*dns_server.unbound()).apply(df)


@query("unbound_messages", f"""SELECT event_id, {_KIND} AS dnssec_message_type, CASE event_id % 8 WHEN 0 THEN 'VALIDATION_SUCCESS' END AS state, CASE event_id % 8 WHEN 1 THEN 'NSEC3s' END AS proof,
    CASE event_id % 8 WHEN 1 THEN 'the referral' END AS target, CASE event_id % 8 WHEN 1 THEN 'proved no DS.' END AS result, CASE event_id % 8 WHEN 3 THEN 'failed to prime trust anchor' END AS action,
    CASE event_id % 8 WHEN 3 THEN 'could not fetch DNSKEY' END AS details, CASE event_id % 8 WHEN 4 THEN 'Network unreachable' END AS network_error,
    CASE event_id % 8 WHEN 2 THEN 'failure' WHEN 4 THEN 'failure' END AS event_outcome, CASE event_id % 8 WHEN 5 THEN 'nodata' END AS status, CASE event_id % 8 WHEN 5 THEN 'response_status' END AS dns_message_type,
    CASE event_id % 8 WHEN 2 THEN 'bad.example.' WHEN 6 THEN 'x.site.example.' END AS name, CASE event_id % 8 WHEN 6 THEN 'site.example' END AS domain, CASE event_id % 8 WHEN 6 THEN 'resolving' END AS dns_action,
    concat('pfelk,firewall_raw,unbound', {_TAG}) AS tags FROM events""")
def unbound_messages(spark: SparkSession, sf: str) -> DataFrame:
    return pick(_messages(spark, sf), "event_id", "dnssec.message_type", "network.error", "event.outcome", "dns.message_type", "dns.action", "tags", state="dnssec.validation_state",
                proof="dnssec.proof_type", target="dnssec.target", result="dnssec.result", action="dnssec.action", details="dnssec.details", status="dns.response_status",
                name="dns.question.name", domain="dns.question.registered_domain")


@query("kea_dhcp4", f"""SELECT event_id, 'INFO' AS log_level, CASE WHEN event_id % 2 = 0 THEN 'DHCP4_PACKET_RECEIVED' ELSE 'DHCP4_LEASE_ALLOC' END AS operation, {L.MAC} AS mac, '01:02' AS client_id, '0x1f' AS tid,
    {S} AS client_ip, CASE WHEN event_id % 2 = 0 THEN 'DHCPREQUEST' END AS message_type, CASE WHEN event_id % 2 = 0 THEN '255.255.255.255' END AS server_ip, CASE WHEN event_id % 2 = 0 THEN {L.INTERFACE} END AS interface_name,
    CASE WHEN event_id % 2 = 1 THEN 'has been allocated' END AS lease, 'pfelk,firewall_raw,kea-dhcp,dhcp4' AS tags, 'kea-dhcp' AS appname FROM events""")
def kea_dhcp4(spark: SparkSession, sf: str) -> DataFrame:
    k = "kea.dhcp."
    return pick(parsed(spark, sf, "kea-dhcp4", *apps.kea_dhcp()), "event_id", "log.level", "interface.name", "tags", operation=k + "operation", mac=k + "client.mac", client_id=k + "client.id",
                tid=k + "transaction.id", client_ip=k + "client.ip", message_type=k + "message_type", server_ip=k + "server.ip", lease=k + "lease.message", appname="log.syslog.appname")


PORTAL = f"""CASE WHEN event_id % 3 = 0 THEN 'webconfigurator authentication error' WHEN event_id % 3 = 1 THEN 'successful login' ELSE 'page viewed' END AS pf_app_action,
    CASE WHEN event_id % 3 = 2 THEN '/status.php' ELSE '/index.php' END AS url_path, CASE WHEN event_id % 3 < 2 THEN {L.USER} END AS user_name, CASE WHEN event_id % 3 < 2 THEN {S} END AS source_ip,
    CASE WHEN event_id % 3 = 0 THEN 'authentication_failure' WHEN event_id % 3 = 1 THEN 'authentication_success' ELSE 'web_portal_activity' END AS event_action,
    CASE WHEN event_id % 3 = 0 THEN 'failure' WHEN event_id % 3 = 1 THEN 'success' END AS event_outcome, CAST(CASE WHEN event_id % 3 = 0 THEN 3 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS BIGINT) AS event_severity"""


@query("web_portal", f"SELECT event_id, {PORTAL}, concat('pfelk,firewall_raw,web_portal', CASE WHEN event_id % 3 = 0 THEN ',authentication_failure,auth_error' WHEN event_id % 3 = 1 THEN ',authentication_success' ELSE '' END) AS tags FROM events")
def web_portal(spark: SparkSession, sf: str) -> DataFrame:
    return pick(parsed(spark, sf, "php-fpm", *apps.web_portal()), "event_id", "pf.app.action", "url.path", "user.name", "source.ip", "event.action", "event.outcome", "event.severity", "tags")


def _eve(spark: SparkSession, sf: str) -> DataFrame:
    df = as_events(L.events(spark, sf).withColumn("line", F.expr(L.eve_text())), "line", preset="suricata")
    return chain_of(*intrusion.suricata()).apply(df)


@query("suricata_eve", f"SELECT event_id, {S} AS source_ip, {T} AS destination_ip, {SP} AS source_port, {PORT} AS destination_port, concat({S}, ' /p', CAST(event_id % 5 AS VARCHAR)) AS indicator, 'pfelk,suricata_json_stream,suricata' AS tags, 'suricata' AS appname FROM events")
def suricata_eve(spark: SparkSession, sf: str) -> DataFrame:
    return pick(_eve(spark, sf), "event_id", "source.ip", "destination.ip", "source.port", "destination.port", "tags", indicator="threatintel.indicator.ip", appname="log.syslog.appname")


@query("suricata_fast", f"SELECT event_id, '1' AS uuid, CAST(2000 + event_id % 6 AS VARCHAR) AS id, 'SCAN probe ' AS description, 'Misc' AS category, CAST(1 + event_id % 3 AS VARCHAR) AS priority, 'TCP' AS network_transport, {S} AS source_ip, {SP} AS source_port, {T} AS destination_ip, {PORT} AS destination_port FROM events")
def suricata_fast(spark: SparkSession, sf: str) -> DataFrame:
    r = "suricata.rule."
    return pick(parsed(spark, sf, "suricata", *intrusion.suricata()), "event_id", "network.transport", "source.ip", "source.port", "destination.ip", "destination.port",
                uuid=r + "uuid", id=r + "id", description=r + "description", category=r + "category", priority="suricata.priority")


@query("sshguard", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'attack' ELSE 'blocking' END AS event_action, 'denied' AS event_type, {S} AS source_ip, CASE WHEN event_id % 2 = 0 THEN 'unknown service' END AS service,
    CASE WHEN event_id % 2 = 0 THEN event_id % 70 END AS danger, CASE WHEN event_id % 2 = 1 THEN CAST(120 AS BIGINT) END AS block_duration, CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 9 AS VARCHAR) END AS attack_count,
    CASE WHEN event_id % 2 = 1 THEN '30' END AS abuse_timeframe FROM events""")
def sshguard(spark: SparkSession, sf: str) -> DataFrame:
    g = "sshguard."
    return pick(parsed(spark, sf, "sshguard", *apps.sshguard()), "event_id", "event.action", "event.type", "source.ip", service=g + "service", danger=g + "danger",
                block_duration=g + "block_duration", attack_count=g + "attack_count", abuse_timeframe=g + "abuse_timeframe")


# ---- views -------------------------------------------------------------------------------


@query("view_header", f"SELECT event_id, 'sshd' AS log_type, {L.HOST} AS hostname, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, concat('<134>1 ', strftime(ts, '%Y-%m-%dT%H:%M:%S'), ' ', {L.HOST}, ' sshd ', CAST(event_id AS VARCHAR), ' - - ', {SSHD}) AS raw_message FROM events")
def view_header(spark: SparkSession, sf: str) -> DataFrame:
    return views.header_view(parsed(spark, sf, "sshd", *apps.sshd()), ("event_id",)).drop("tags")


@query("view_firewall", f"SELECT event_id, {S} AS source_ip, {SP} AS source_port, concat('port-', {PORT}) AS destination_service, upper({L.PROTOCOL}) AS protocol, 'IPV4' AS network_type, upper({L.ACTION}) AS action, CASE WHEN event_id % 2 = 0 THEN 'INGRESS' ELSE 'OUT' END AS direction, {L.INTERFACE} AS interface, {L.HOST} AS hostname FROM events")
def view_firewall(spark: SparkSession, sf: str) -> DataFrame:
    chain = chain_of(*firewall.filterlog()) + Chain([stage("ports", *enrich.port_names(None))])
    view = views.firewall_view(chain.apply(L.program_lines(spark, sf, "filterlog")), ("event_id",))
    return view.select("event_id", "source_ip", "source_port", "destination_service", "protocol", "network_type", "action", "direction", "interface", "hostname")


@query("view_suricata", f"SELECT event_id, concat('sig ', CAST(event_id % 6 AS VARCHAR)) AS signature, CAST(1 + event_id % 3 AS VARCHAR) AS severity, 'cat' AS category, 'alert' AS event_type, {S} AS source_ip, {T} AS destination_ip, 'N/A' AS protocol, 'N/A' AS timestamp FROM events")
def view_suricata(spark: SparkSession, sf: str) -> DataFrame:
    return views.suricata_view(_eve(spark, sf), ("event_id",))


@query("view_dns", """SELECT event_id, CASE event_id % 8 WHEN 5 THEN 'NODATA' END AS response_status, CASE event_id % 8 WHEN 2 THEN 'bad.example.' WHEN 6 THEN 'x.site.example.' END AS query_name,
    CASE event_id % 8 WHEN 2 THEN 'N/A' WHEN 6 THEN 'AAAA' END AS query_type, CASE event_id % 8 WHEN 0 THEN 'DNSSEC Validation' WHEN 1 THEN 'DNSSEC Proof' WHEN 2 THEN 'DNSSEC Failure' WHEN 3 THEN 'DNSSEC Information' END AS dnssec_title,
    CASE event_id % 8 WHEN 4 THEN 'Network unreachable' END AS network_error, '9:1' AS process, 'INFO' AS log_level FROM events""")
def view_dns(spark: SparkSession, sf: str) -> DataFrame:
    return views.dns_view(_messages(spark, sf), ("event_id",)).select("event_id", "response_status", "query_name", "query_type", "dnssec_title", "network_error", "process", "log_level")


@query("view_dhcp", f"SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'ACK' WHEN 1 THEN 'NACK' ELSE 'DISCOVER' END AS operation, CASE event_id % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' ELSE 'info' END AS operation_class, CASE WHEN event_id % 3 < 2 THEN {S} ELSE 'N/A' END AS client_ip, {L.MAC} AS client_mac, CASE event_id % 3 WHEN 0 THEN 'phone' ELSE 'N/A' END AS client_hostname FROM events")
def view_dhcp(spark: SparkSession, sf: str) -> DataFrame:
    from logweave.operators import grok

    body = L.text(f"CASE event_id % 3 WHEN 0 THEN concat('DHCPACK on ', {S}, ' to ', {L.MAC}, ' (phone) via igb1') WHEN 1 THEN concat('DHCPNACK on ', {S}, ' to ', {L.MAC}, ' via igb1') ELSE concat('DHCPDISCOVER from ', {L.MAC}, ' via igb1') END")
    out = run(L.events(spark, sf).select("event_id", F.expr(body).alias("message")), grok("message", "%{DHCPD}"))
    return views.dhcp_view(out, ("event_id",)).select("event_id", "operation", "operation_class", "client_ip", "client_mac", "client_hostname")


@query("view_openvpn", f"SELECT event_id, 'connect' AS event, {L.USER} AS user, {S} AS client_ip, 'N/A' AS hostname, 'N/A' AS timestamp FROM events")
def view_openvpn(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.lit("connect").alias("event.action"), F.lit("").alias("user.name"), F.expr(L.text(L.USER)).alias("openvpn.user"), F.expr(L.text(S)).alias("client.ip"))
    return views.openvpn_view(df, ("event_id",))


@query("view_sshguard", f"""SELECT event_id, CASE WHEN event_id % 2 = 1 THEN '120' END AS block_duration, CASE WHEN event_id % 2 = 1 THEN CAST(event_id % 9 AS VARCHAR) END AS attack_count, CASE WHEN event_id % 2 = 0 THEN {S} END AS attacker_ip,
    CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 70 AS VARCHAR) END AS danger, CASE WHEN event_id % 2 = 1 THEN NULL WHEN event_id % 70 >= 50 THEN 'Critical' WHEN event_id % 70 >= 30 THEN 'High' WHEN event_id % 70 >= 10 THEN 'Medium' ELSE 'Low' END AS danger_label FROM events""")
def view_sshguard(spark: SparkSession, sf: str) -> DataFrame:
    return views.sshguard_view(parsed(spark, sf, "sshguard", *apps.sshguard()), ("event_id",)).select("event_id", "block_duration", "attack_count", "attacker_ip", "danger", "danger_label")


@query("view_web_portal", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Authentication Failed' WHEN event_id % 3 = 1 THEN 'Authentication Successful' ELSE 'Web Portal Activity' END AS status, CASE WHEN event_id % 3 < 2 THEN {L.USER} ELSE 'Unknown User' END AS user, CASE WHEN event_id % 3 < 2 THEN {S} ELSE 'N/A' END AS client_ip, 'web_application' AS category, CASE WHEN event_id % 3 = 0 THEN '3' WHEN event_id % 3 = 1 THEN '0' ELSE '1' END AS severity FROM events")
def view_web_portal(spark: SparkSession, sf: str) -> DataFrame:
    return views.web_portal_view(parsed(spark, sf, "php-fpm", *apps.web_portal()), ("event_id",)).select("event_id", "status", "user", "client_ip", "category", "severity")


@query("view_system", "SELECT doc_id, CASE WHEN text = '' THEN 'N/A' ELSE concat(substring(text, 1, 100), CASE WHEN length(text) > 100 THEN '...' ELSE '' END) END AS message FROM documents")
def view_system(spark: SparkSession, sf: str) -> DataFrame:
    return views.system_view(table(spark, sf, "documents").select("doc_id", F.col("text").alias("message")), ("doc_id",)).select("doc_id", "message")


# ---- everything together -----------------------------------------------------------------

_TYPES = "CASE " + " ".join(
    f"WHEN event_id % 20 < {u} THEN '{t}'" for (u, _), t in zip(
        L.MIX, ("firewall", "dns", "system", "web_portal", "sshguard", "dhcp", "system", "squid", "system", "haproxy", "system"), strict=True)) + " END"
_SETS = "CASE " + " ".join(
    f"WHEN event_id % 20 < {u} THEN 'pfelk.{t}'" for (u, _), t in zip(
        L.MIX, ("firewall", "unbound", "sshd", "webportal", "sshguard", "kea-dhcp4", "snort", "squid", "nginx", "haproxy", "dpinger"), strict=True)) + " END"


@query("event_types", f"SELECT event_id, {_TYPES} AS event_type FROM events")
def event_types(spark: SparkSession, sf: str) -> DataFrame:
    return views.with_event_type(parse_chain().apply(L.mixed_lines(spark, sf))).select("event_id", "event_type")


@query("route_totals", f"SELECT 'logs' AS stream_type, {_SETS} AS stream_dataset, count(*) AS lines FROM events GROUP BY ALL")
def route_totals(spark: SparkSession, sf: str) -> DataFrame:
    chain = parse_chain() + Chain([stage("clean", *cleanup.cleanup())])
    return route(chain.apply(L.mixed_lines(spark, sf))).groupBy("stream_type", "stream_dataset").agg(F.count("*").alias("lines"))


@query("route_fallback", "SELECT event_id, 'pfelk.unknown' AS stream_dataset, 'generic' AS stream_namespace, 'pfelk,firewall_raw,grok_fail_00_input_firewall_rfc5424,pfelk_routing_fallback' AS tags, concat('odd ', event_type) AS original FROM events")
def route_fallback(spark: SparkSession, sf: str) -> DataFrame:
    df = as_events(table(spark, sf, "events").select("event_id", F.concat(F.lit("odd "), "event_type").alias("m")), "m", preset="syslog")
    out = route((Chain([stage("unwrap", *unwrap.unwrap())]) + Chain([stage("clean", *cleanup.cleanup())])).apply(df))
    return pick(out, "event_id", "stream_dataset", "stream_namespace", "tags", original="event.original")


@query("export_json_text", """SELECT event_id, concat('{"event":{"type":"', event_type, '"},"user":{"id":', CAST(user_id AS VARCHAR), ',"name":{"first":"a"}}}') AS record FROM events""")
def export_json_text(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "events").select("event_id", F.col("event_type").alias("event.type"), F.col("user_id").alias("user.id"), F.lit("a").alias("user.name.first"), F.lit(None).cast("string").alias("user.gone"))
    return to_nested(df).select("event_id", F.to_json(F.struct("event", "user")).alias("record"))


@query("private_clients", f"""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lower(coalesce(c_name, ip)) ELSE coalesce(c_name, ip) END AS client_subdomain, CASE WHEN event_id % 2 = 0 THEN 'City' END AS city,
    CASE WHEN event_id % 2 = 0 THEN 'unbound,Private_Client_IP' ELSE 'unbound' END AS tags FROM (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN concat('10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) ELSE concat('8.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR)) END AS ip FROM events)
    LEFT JOIN customer ON c_custkey = user_id AND event_id % 2 = 0""")
def private_clients(spark: SparkSession, sf: str) -> DataFrame:
    def private(number: str) -> str:  # 10.0.0.0/16 has 65,536 addresses; numbers beyond get private ones of the newer family
        return f"CASE WHEN {number} < 65536 THEN concat('10.0.', {number} div 256, '.', {number} % 256) ELSE concat('fc00::', {L.v6_groups(number)}) END"

    hosts = table(spark, sf, "customer").select(F.expr(private("c_custkey")).alias("key"), F.col("c_name").alias("value"))
    address = f"CASE WHEN event_id % 2 = 0 THEN {private('user_id')} ELSE concat('8.0.', user_id div 256, '.', user_id % 256) END"
    df = table(spark, sf, "events").select("event_id", F.expr(address).alias("client.ip"), F.array(F.lit("unbound")).alias("tags"))
    return pick(run(df, *enrich.private_clients(Lookup(hosts), {"[client][geo][city_name]": "City"})), "event_id", "client.subdomain", "tags", city="client.geo.city_name")


@query("places_of_events", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN NULL WHEN event_id % 5 = 4 THEN r_name WHEN b < 9 AND event_id % 256 >= 128 THEN n_name || ' near' WHEN n_name IS NOT NULL THEN n_name WHEN b < 128 THEN 'WIDE' END AS country,
    concat('pfelk', CASE WHEN event_id % 2 = 0 THEN ',IP_Private_Source' ELSE ',GeoIP_Source' END) AS tags FROM (SELECT *, user_id % 256 AS b FROM events) LEFT JOIN nation ON event_id % 2 = 1 AND event_id % 5 <> 4 AND n_nationkey = b LEFT JOIN region ON event_id % 2 = 1 AND event_id % 5 = 4 AND r_regionkey = event_id % 7""")
def places_of_events(spark: SparkSession, sf: str) -> DataFrame:
    nets = networks(spark, sf).withColumn("network", F.regexp_replace("network", r"^10[.]", "20."))
    address = ("CASE WHEN event_id % 2 = 0 THEN concat('10.', user_id % 256, '.0.', event_id % 256)"
               f" WHEN event_id % 5 = 4 THEN concat('2001:db8:', event_id % 7, '::', {L.v6_groups('user_id')})"
               " ELSE concat('20.', user_id % 256, '.0.', event_id % 256) END")
    df = table(spark, sf, "events").select("event_id", F.expr(address).alias("source.ip"), F.array(F.lit("pfelk")).alias("tags"))
    return pick(run(df, *enrich.places(geo_table(nets))), "event_id", "tags", country="source.geo.country_name")


@query("sample_filterlog", f"SELECT event_id, event_id % 7 AS rule_num, {L.ACTION} AS action, {S} AS src_ip, 1024 + event_id % 60000 AS src_port, CAST({PORT} AS BIGINT) AS dst_port, 'firewall' AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def sample_filterlog(spark: SparkSession, sf: str) -> DataFrame:
    df = L.events(spark, sf).select("event_id", F.expr(f"concat({L.header('filterlog').replace('CAST(event_id AS STRING)', 'CAST(event_id + 1 AS STRING)')}, {L.filterlog_text()})").alias("message"))
    out = sample_chain().apply(df)
    return out.select("event_id", "rule_num", "action", "src_ip", "src_port", "dst_port", "event_type", F.date_format("@timestamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


# ---- audit -------------------------------------------------------------------------------


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    from logweave import branch
    from logweave import predicates as P

    df = table(spark, sf, "events").select("event_id", "event_type", F.array(F.lit("x")).alias("tags"))
    return Chain([
        stage("first", mutate(add_field={"a": "1"}, add_tag=["x", "y"], rename={"event_type": "kind"})),
        stage("second", branch((P.eq("kind", "error"), [mutate(replace={"a": "2"}, remove_tag="x")]))),
    ]).apply(df, audit=True)


@query("audit_totals", """
    WITH n AS (SELECT count(*) AS c, count(*) FILTER (event_type = 'error') AS e FROM events)
    SELECT 'first' AS stage, 2 * c AS fields_added, 0 * c AS fields_modified, c AS fields_removed, c AS tags_added, 0 * c AS tags_removed FROM n
    UNION ALL SELECT 'second', 0, e, 0, 0, e FROM n UNION ALL SELECT NULL, 2 * c, e, c, c, e FROM n""")
def audit_totals(spark: SparkSession, sf: str) -> DataFrame:
    return audit.change_totals(_audited(spark, sf))


@query("audit_labels", """SELECT event_id, 'Fields Added, Fields Removed, Tags Added' AS first, CASE WHEN event_type = 'error' THEN 'Fields Modified, Tags Removed' ELSE 'No Changes' END AS second, event_type = 'error' AS ran FROM events""")
def audit_labels(spark: SparkSession, sf: str) -> DataFrame:
    a = F.col("audit")
    return _audited(spark, sf).select("event_id", a[0]["changes"].alias("first"), a[1]["changes"].alias("second"), a[1]["executed"].alias("ran"))


@query("audit_run_summary", "SELECT 2 AS stages, count(*) + count(*) FILTER (event_type = 'error') AS steps, count(*) + count(*) FILTER (event_type = 'error') AS successful_steps, 4 AS fields FROM events")
def audit_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.run_summary(_audited(spark, sf))


@query("audit_row_diff", "SELECT event_id, 'kind' AS added, CASE WHEN event_type = 'error' THEN 'value' ELSE '' END AS modified, 'event_type' AS removed FROM events")
def audit_row_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "events").select("event_id", "event_type", "value")
    after = before.select("event_id", F.col("event_type").alias("kind"), F.expr("CASE WHEN event_type = 'error' THEN value + 1 ELSE value END").alias("value"))
    diff = audit.row_diff(before, after, ["event_id"])
    return diff.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("added", "modified", "removed")])


