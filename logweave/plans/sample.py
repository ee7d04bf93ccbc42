"""A small chain: syslog header, packet-filter values, DHCP and VPN lines, time and place."""

from __future__ import annotations

from logweave.operators import csv, date, geoip, grok, mutate
from logweave.operators.lookup import NetworkTable
from logweave.pipeline import Chain, branch, stage
from logweave.predicates import eq, matches

# Columns of a packet-filter line, and line formats.
COLUMNS = [
    "rule_num", "sub_rule", "anchor", "tracker", "interface", "reason", "action", "direction",
    "ip_version", "tos", "ecn", "ttl", "id", "offset", "flags", "proto_id", "proto", "length",
    "src_ip", "dst_ip", "src_port", "dst_port", "data_length", "tcp_flags", "sequence", "ack",
    "window", "urg", "options",
]
HEADER = (
    "<%{POSINT:syslog_pri}>%{NONNEGINT:syslog_version} %{TIMESTAMP_ISO8601:syslog_timestamp}"
    " %{SYSLOGHOST:syslog_hostname} %{SYSLOGPROG:syslog_program} %{POSINT:syslog_pid} - -"
    " %{GREEDYDATA:syslog_message}"
)
DHCP = r"DHCP%{WORD:dhcp_action} on %{IP:dhcp_ip} to %{MAC:dhcp_mac}( \(%{DATA:dhcp_hostname}\))?"
VPN = (
    r"%{IP:vpn_client_ip}:%{POSINT:vpn_client_port} \[%{DATA:vpn_client_name}\]"
    " %{GREEDYDATA:vpn_message}"
)


def sample_chain(places: NetworkTable | None = None) -> Chain:
    source = "syslog_message"
    integers = dict.fromkeys(("src_port", "dst_port", "rule_num"), "integer")
    return Chain([
        stage("header", grok("message", HEADER)),
        stage(
            "programs",
            branch((
                eq("[syslog_program]", "filterlog"),
                [csv(source, COLUMNS), mutate(add_field={"event_type": "firewall"}, convert=integers)],
            )),
            branch((
                eq("[syslog_program]", "dhcpd"),
                [grok(source, DHCP), mutate(add_field={"event_type": "dhcp"})],
            )),
            branch((
                matches("[syslog_program]", "^openvpn"),
                [grok(source, VPN), mutate(add_field={"event_type": "vpn"})],
            )),
        ),
        stage("time", date("syslog_timestamp", "ISO8601", target="@timestamp")),
        *([stage("place", geoip("src_ip", places))] if places is not None else []),
    ])
