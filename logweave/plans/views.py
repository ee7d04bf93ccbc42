"""Event classification and one summary view per event type.

Views read finished events (flat leaf columns) and select only what they show, so column pruning
removes the parsing of everything else. Missing and empty values read ``N/A``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.frame import flatten
from logweave.paths import parts, quoted
from logweave.plans.fixed import PRODUCT

NA = "N/A"


class Fields:
    """Read access to the leaves of a finished event table."""

    def __init__(self, df: DataFrame):
        self.df = flatten(df)
        self.types = dict(self.df.dtypes)

    def raw(self, name: str) -> Column:
        if name in self.types:
            return F.col(quoted(name))
        path = parts(name)
        for n in range(len(path) - 1, 0, -1):
            head = ".".join(path[:n])
            if self.types.get(head) == "variant":
                where = "$" + "".join(f"['{p}']" for p in path[n:])
                return F.try_variant_get(F.col(quoted(head)), where, "string")
        return F.lit(None).cast("string")

    def text(self, *names: str) -> Column:
        """First of the fields that is neither missing nor empty."""
        found = [F.nullif(self.raw(n).cast("string"), F.lit("")) for n in names]
        return found[0] if len(found) == 1 else F.coalesce(*found)

    def show(self, *names: str, default: str = NA) -> Column:
        return F.coalesce(self.text(*names), F.lit(default))

    def tag(self, name: str) -> Column:
        if "tags" not in self.types:
            return F.lit(False)
        return F.coalesce(F.array_contains("tags", name), F.lit(False))

    def under(self, root: str) -> Column:
        """Whether the event has anything under a root field."""
        names = [n for n in self.types if n == root or n.startswith(root + ".")]
        out = F.lit(False)
        for n in names:
            out = out | F.col(quoted(n)).isNotNull()
        return out


def event_type(f: Fields) -> Column:
    """Type of an event by program, tags, or the root fields it has; the first test that holds."""
    app = F.coalesce(f.raw("log.syslog.appname"), F.lit(""))

    def by(name: str, tag: str | None = None) -> Column:
        return (app == name) | f.tag(tag or name)

    portal = (
        by("php-fpm", "web_portal") | f.tag("authentication_failure") | f.tag("authentication_success")
    )
    return (
        F.when(by("suricata") | f.under("suricata"), "suricata")
        .when(by("unbound") | f.under("dns"), "dns")
        .when(app.contains("dhcp") | f.tag("dhcp"), "dhcp")
        .when(by("openvpn"), "openvpn")
        .when(by("sshguard"), "sshguard")
        .when(portal, "web_portal")
        .when(by("haproxy"), "haproxy")
        .when(app.contains("squid") | f.tag("squid"), "squid")
        .when(by("firewall") | f.under("pf"), "firewall")
        .otherwise("system")
    )


def with_event_type(df: DataFrame) -> DataFrame:
    f = Fields(df)
    return f.df.withColumn("event_type", event_type(f))


def _common(f: Fields) -> dict[str, Column]:
    return {
        "hostname": f.show("log.syslog.hostname"),
        "timestamp": f.show("log.syslog.timestamp", "@timestamp"),
    }


def _select(f: Fields, columns: dict[str, Column], keep: tuple[str, ...]) -> DataFrame:
    return f.df.select(
        *[F.col(quoted(k)) for k in keep], *[c.alias(name) for name, c in columns.items()]
    )


def header_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    return _select(f, {
        "log_type": f.show("log.syslog.appname", "type", default="Unknown"),
        **_common(f),
        "tags": F.coalesce(f.raw("tags").cast("array<string>"), F.array().cast("array<string>")),
        "raw_message": f.show("event.original", "message"),
    }, keep)


def firewall_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    sides = {}
    for side in ("source", "destination"):
        sides |= {
            f"{side}_ip": f.show(f"{side}.ip"),
            f"{side}_domain": f.text(f"{side}.domain"),
            f"{side}_port": f.show(f"{side}.port"),
            f"{side}_service": f.text(f"{side}.service.name"),
        }
    return _select(f, {
        **sides,
        "protocol": F.upper(f.show("network.protocol")),
        "network_type": F.upper(f.show("network.type")),
        "action": F.upper(f.show("event.action")),
        "direction": F.upper(f.show("network.direction")),
        "interface": f.show("interface.name"),
        "alias": f.text("interface.alias"),
        "rule_id": f.show("rule.id"),
        "rule_uuid": f.show("rule.uuid"),
        "rule_description": f.text("rule.description"),
        **_common(f),
    }, keep)


def suricata_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    alert = "suricata.eve.alert."
    return _select(f, {
        "signature": f.show(alert + "signature"),
        "severity": F.coalesce(F.nullif(f.text(alert + "severity"), F.lit("0")), F.lit(NA)),
        "category": f.show(alert + "category"),
        "event_type": f.show("suricata.eve.event_type"),
        "source_ip": f.show("source.ip"),
        "destination_ip": f.show("destination.ip"),
        "protocol": F.upper(f.show("network.protocol")),
        "timestamp": _common(f)["timestamp"],
    }, keep)


def dns_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Response status, question, DNSSEC, network error and process details; a part that does not
    apply to an event is NULL."""
    f = Fields(df)
    status = F.coalesce(f.raw("dns.message_type") == "response_status", F.lit(False))
    question = ~status & f.under("dns.question")
    dnssec = f.raw("dnssec.message_type").isNotNull()

    def part(test: Column, value: Column) -> Column:
        return F.when(test, value)

    title = (
        F.when(f.tag("dnssec_validation"), "DNSSEC Validation")
        .when(f.tag("dnssec_proof"), "DNSSEC Proof")
        .when(f.tag("dnssec_failure"), "DNSSEC Failure")
        .otherwise("DNSSEC Information")
    )
    thread = f.text("process.thread.id")
    return _select(f, {
        "response_status": part(status, F.upper(f.show("dns.response_status"))),
        "response_type": part(status, F.upper(f.show("dns.response_type"))),
        "message_type": part(status, f.raw("dns.message_type")),
        "query_name": part(question, f.show("dns.question.name")),
        "query_type": part(question, F.upper(f.show("dns.question.type"))),
        "query_class": part(question, F.upper(f.show("dns.question.class"))),
        "response_code": part(question, F.upper(f.text("dns.return_code"))),
        "dns_action": part(question, f.text("dns.action")),
        "dnssec_title": part(dnssec, title),
        "dnssec_message_type": part(dnssec, f.show("dnssec.message_type")),
        "dnssec_state": part(dnssec, F.upper(f.text("dnssec.validation_state"))),
        "dnssec_response_type": part(dnssec, f.text("dnssec.response_type")),
        "dnssec_proof_type": part(dnssec, f.text("dnssec.proof_type")),
        "dnssec_target": part(dnssec, f.text("dnssec.target")),
        "dnssec_result": part(dnssec, f.text("dnssec.result")),
        "dnssec_action": part(dnssec, f.text("dnssec.action")),
        "dnssec_details": part(dnssec, f.text("dnssec.details")),
        "network_error": part(f.tag("network_error"), f.text("network.error")),
        "process": F.concat(
            f.text("process.pgid"), F.coalesce(F.concat(F.lit(":"), thread), F.lit(""))
        ),
        "log_level": F.upper(f.show("log.level")),
        "client_ip": f.text("source.ip", "client.ip"),
        **_common(f),
    }, keep)


# Class of each DHCP operation; others are informational.
DHCP_CLASSES = {
    "OFFER": "warning", "RELEASE": "warning", "ACK": "success", "ACKNOWLEDGEMENT": "success",
    "NACK": "failure", "NAK": "failure", "DECLINE": "failure",
}


def dhcp_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    operation = F.upper(f.show("dhcp.operation", "event.action", default="UNKNOWN"))
    grade = F.lit("info")
    for name, value in DHCP_CLASSES.items():
        grade = F.when(operation == name, value).otherwise(grade)
    return _select(f, {
        "operation": operation,
        "operation_class": grade,
        "client_ip": f.show("dhcpv4.client.ip", "dhcpv6.client.ip"),
        "client_mac": f.show("dhcpv4.client.mac", "dhcpv6.client.mac"),
        "client_hostname": f.show("dhcpv4.option.hostname", "dhcpv6.option.hostname"),
        "dataset": f.show("event.dataset", default=f"{PRODUCT}.dhcp"),
        **_common(f),
    }, keep)


def openvpn_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    return _select(f, {
        "event": f.show("event.action"),
        "user": f.show("user.name", "openvpn.user"),
        "client_ip": f.show("source.ip", "client.ip"),
        **_common(f),
    }, keep)


def danger_label(danger: Column) -> Column:
    level = danger.try_cast("double")
    return (
        F.when(level >= 50, "Critical").when(level >= 30, "High").when(level >= 10, "Medium")
        .otherwise("Low")
    )


def sshguard_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocking statistics for blocked hosts, danger level for attacks."""
    f = Fields(df)
    blocked = F.coalesce(f.raw("event.action") == "blocking", F.lit(False))

    def count(name: str) -> Column:
        return F.when(blocked, f.show(f"sshguard.{name}", default="0"))

    danger = f.show("sshguard.danger", default="0")
    return _select(f, {
        "blocked_target": F.when(blocked, f.show("sshguard.blocked_target")),
        "block_duration": count("block_duration"),
        "attack_count": count("attack_count"),
        "attack_timeframe": count("attack_timeframe"),
        "abuse_count": count("abuse_count"),
        "abuse_timeframe": count("abuse_timeframe"),
        "attacker_ip": F.when(~blocked, f.show("source.ip")),
        "service": F.when(~blocked, f.show("sshguard.service")),
        "danger": F.when(~blocked, danger),
        "danger_label": F.when(~blocked, danger_label(danger)),
        **_common(f),
    }, keep)


def web_portal_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    outcome = f.raw("event.outcome")
    failed = F.coalesce(outcome == "failure", F.lit(False)) | f.tag("authentication_failure")
    passed = F.coalesce(outcome == "success", F.lit(False)) | f.tag("authentication_success")
    return _select(f, {
        "status": F.when(failed, "Authentication Failed").when(passed, "Authentication Successful")
        .otherwise("Web Portal Activity"),
        "user": f.show("user.name", "pf.app.user", default="Unknown User"),
        "client_ip": f.show("source.ip", "pf.remote.ip"),
        "page": f.show("url.path", "pf.app.page"),
        "action": f.text("event.action"),
        "category": f.show("event.category", default="Web Application"),
        "severity": f.raw("event.severity").cast("string"),
        **_common(f),
    }, keep)


def system_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    f = Fields(df)
    message = f.show("message")
    long = F.coalesce(F.length(f.raw("message")) > 100, F.lit(False))
    return _select(f, {
        "log_type": f.show("log.syslog.appname", "type", default="Unknown"),
        **_common(f),
        "message": F.concat(F.substring(message, 1, 100), F.when(long, "...").otherwise("")),
    }, keep)
