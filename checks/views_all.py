"""Every column of the firewall and resolver views, and every branch of the sample chain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import lines as L
from checks.complete import _ALIAS, _PORT_NAME, _REVERSE, every_table
from checks.core import pick
from checks.domain import _messages, chain_of
from checks.registry import query
from logweave import Chain, stage
from logweave.operators.lookup import geo_table
from logweave.plans import enrich, firewall, views
from logweave.plans.sample import sample_chain
from logweave.sources import literal_table

S, T, SP, PORT = L.SOURCE_IP, L.TARGET_IP, L.SOURCE_PORT, L.PORT
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"


@query("view_firewall_all", f"""SELECT event_id, {S} AS source_ip, {S} AS source_domain, {SP} AS source_port, 'port-' || {SP} AS source_service, {T} AS destination_ip, {_REVERSE} AS destination_domain,
    {PORT} AS destination_port, {_PORT_NAME} AS destination_service, upper({L.PROTOCOL}) AS protocol, 'IPV4' AS network_type, upper({L.ACTION}) AS action,
    CASE WHEN event_id % 2 = 0 THEN 'INGRESS' ELSE 'OUT' END AS direction, {L.INTERFACE} AS interface, {_ALIAS} AS alias, CAST(event_id % 7 AS VARCHAR) AS rule_id, {L.RULE_UUID} AS rule_uuid,
    CASE {L.RULE_UUID} WHEN '1000000101' THEN 'first rule' WHEN '1000000102' THEN 'second, later' WHEN '1000000103' THEN 'third rule' ELSE concat('Rule ID: ', {L.RULE_UUID}) END AS rule_description,
    {L.HOST} AS hostname, {_STAMP} AS timestamp FROM events""")
def view_firewall_all(spark: SparkSession, sf: str) -> DataFrame:
    known = every_table(spark, sf)
    chain = chain_of(*firewall.filterlog()) + Chain([
        stage("interfaces", *enrich.interfaces(known.interfaces)), stage("rules", *enrich.rule_names(known.rule_names)), stage("ports", *enrich.port_names(known.port_names)),
        stage("names", *enrich.host_names(known.host_names)),
    ])
    return views.firewall_view(chain.apply(L.program_lines(spark, sf, "filterlog")), ("event_id",))


def _kinds(**values: str) -> str:
    """A value for some of the eight kinds of resolver messages."""
    return "CASE event_id % 8 " + " ".join(f"WHEN {k[1:]} THEN '{v}'" for k, v in values.items()) + " END"


@query("view_dns_all", f"""SELECT event_id, {_kinds(k5='NODATA')} AS response_status, {_kinds(k5='ANSWER')} AS response_type, {_kinds(k5='response_status')} AS message_type,
    {_kinds(k2='bad.example.', k6='x.site.example.')} AS query_name, {_kinds(k2='N/A', k6='AAAA')} AS query_type, {_kinds(k2='N/A', k6='IN')} AS query_class, CAST(NULL AS VARCHAR) AS response_code,
    {_kinds(k6='resolving')} AS dns_action, {_kinds(k0='DNSSEC Validation', k1='DNSSEC Proof', k2='DNSSEC Failure', k3='DNSSEC Information')} AS dnssec_title,
    {_kinds(k0='validation', k1='proof', k2='validation_failure', k3='trust_anchor')} AS dnssec_message_type, {_kinds(k0='VALIDATION_SUCCESS')} AS dnssec_state, {_kinds(k0='A')} AS dnssec_response_type,
    {_kinds(k1='NSEC3s')} AS dnssec_proof_type, {_kinds(k1='the referral')} AS dnssec_target, {_kinds(k1='proved no DS.')} AS dnssec_result,
    {_kinds(k3='failed to prime trust anchor')} AS dnssec_action, {_kinds(k3='could not fetch DNSKEY')} AS dnssec_details, {_kinds(k4='Network unreachable')} AS network_error,
    '9:1' AS process, 'INFO' AS log_level, CAST(NULL AS VARCHAR) AS client_ip, {L.HOST} AS hostname, {_STAMP} AS timestamp FROM events""")
def view_dns_all(spark: SparkSession, sf: str) -> DataFrame:
    return views.dns_view(_messages(spark, sf), ("event_id",))


@query("sample_programs", f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'firewall' WHEN 1 THEN 'dhcp' ELSE 'vpn' END AS event_type, CASE WHEN event_id % 3 = 0 THEN {S} END AS src_ip,
    CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 256 < 8 THEN 'Low' WHEN user_id % 256 < 16 THEN 'Mid' END END AS country,
    CASE WHEN event_id % 3 = 2 THEN {S} END AS vpn_client_ip, CASE WHEN event_id % 3 = 2 THEN {SP} END AS vpn_client_port, CASE WHEN event_id % 3 = 2 THEN {L.USER} END AS vpn_client_name,
    CASE WHEN event_id % 3 = 2 THEN 'peer up' END AS vpn_message, CASE event_id % 3 WHEN 0 THEN 'filterlog' WHEN 1 THEN 'dhcpd' ELSE 'openvpn' END AS program,
    CASE WHEN event_id % 3 = 1 THEN '_grokparsefailure' ELSE '' END AS tags, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def sample_programs(spark: SparkSession, sf: str) -> DataFrame:
    """All three programs with time and place. The declared DHCP form never matches: its word would begin within one."""

    def head(program: str) -> str:
        return L.header(program).replace("CAST(event_id AS STRING)", "CAST(event_id + 1 AS STRING)")

    line = f"""CASE event_id % 3 WHEN 0 THEN concat({head('filterlog')}, {L.filterlog_text()}) WHEN 1 THEN concat({head('dhcpd')}, 'DHCPACK on ', {L.text(S)}, ' to ', {L.MAC}, ' (phone) via igb1')
        ELSE concat({head('openvpn')}, {L.text(S)}, ':', {L.text(SP)}, ' [', {L.text(L.USER)}, '] peer up') END"""
    places = geo_table(literal_table(spark, [("10.0.0.0/13", "Low"), ("10.8.0.0/13", "Mid")], ["network", "country_name"]))
    out = sample_chain(places).apply(L.events(spark, sf).select("event_id", F.expr(line).alias("message")))
    found = pick(out, "event_id", "event_type", "src_ip", "vpn_client_ip", "vpn_client_port", "vpn_client_name", "vpn_message", "tags", country="geoip.country_name", program="syslog_program", at="@timestamp")
    return found.withColumn("stamp", F.date_format("at", "yyyy-MM-dd HH:mm:ss")).drop("at").withColumn("tags", F.coalesce("tags", F.lit("")))
