"""Services that log through syslog: portals, proxies, VPN, name and time servers, sshd, DHCP.

Each function gives its cases: the rows it is for, and what to do with them.
"""

from __future__ import annotations

from collections.abc import Mapping

from logweave.operators import grok, json, mutate
from logweave.pipeline import Operator, branch
from logweave.plans.fixed import routed
from logweave.predicates import Condition, eq, has, lacks, matches, missing

Case = tuple[Condition, list[Operator]]

APP = "[log][syslog][appname]"
TEXT = "filter_message"

# JSON fields of a proxy line that become event fields.
SQUID_JSON = {
    "url.original": "string",
    "http.response.body.status_code": "string",
    "http.request.method": "string",
    "http.request.referrer": "string",
    "http.response.bytes": "string",
    "http.response.mime_type": "string",
    "client.ip": "string",
    "destination.ip": "string",
    "user.name": "string",
    "user_agent.original": "string",
}


def _service(prefix: str, tag: str, dataset: str, namespace: str, *after: Operator, **edits) -> Case:
    """Lines of one program: tag and route them, then run its own operators."""
    replace = {**routed(dataset, namespace), **edits.pop("replace", {})}
    return (
        matches(APP, f"^{prefix}"),
        [mutate(add_tag=tag, replace=replace, **edits), *after],
    )


def captive_portal() -> list[Case]:
    renamed = matches(APP, "^logportalauth")
    mine, block = _service(
        "captiveportal", "captive", "captive", "captiveportal",
        grok("captiveportalmessage", "%{CAPTIVEPORTAL}"),
        rename={TEXT: "captiveportalmessage"},
    )
    return [(mine | renamed, [branch((renamed, [mutate(replace={APP: "captiveportal"})])), *block])]


def dpinger() -> list[Case]:
    return [_service("dpinger", "dpinger", "dpinger", "firewall_services")]


def haproxy() -> list[Case]:
    return [_service("haproxy", "haproxy", "haproxy", "haproxy", grok(TEXT, "%{HAPROXY}"))]


def nginx() -> list[Case]:
    return [
        _service(
            "nginx", "nginx", "nginx", "nginx", grok(TEXT, "%{NGINX}"), replace={APP: "nginx"}
        )
    ]


def openvpn() -> list[Case]:
    return [
        _service(
            "openvpn", "openvpn", "openvpn", "openvpn",
            branch((has("openvpn"), [mutate(replace={APP: "openvpn"})])),
        )
    ]


def named_server() -> list[Case]:
    return [_service("named", "bind9", "bind9", "firewall_services")]


def ntpd() -> list[Case]:
    return [_service("ntpd", "ntpd", "ntpd", "firewall_services")]


def snort() -> list[Case]:
    return [
        _service(
            "snort", "snort", "snort", "snort",
            grok(TEXT, "%{SNORT}"),
            mutate(convert={"[event][severity]": "integer"}),
            add_field={"[event][category]": "intrusion_detection", "[agent][type]": "snort"},
        )
    ]


def squid(json_fields: Mapping[str, str] | None = None) -> list[Case]:
    """Proxy lines, JSON or plain. Root keys taken from JSON are declared in ``json_fields``."""
    return [
        (
            eq(APP, "(squid-1)"),
            [
                mutate(replace={APP: "squid", **routed("squid", "squid")}),
                branch((
                    matches(TEXT, r"^{.*}$"),
                    [json(TEXT, fields=json_fields or SQUID_JSON, add_tag="squid_json")],
                )),
                branch((lacks("squid_json"), [grok(TEXT, "%{SQUID}")])),
                branch((
                    has("squid_json"),
                    [
                        grok(
                            "[url][original]",
                            "%{URIPROTO}://%{URIHOST:referer_domain}%{GREEDYDATA:[url][path]}",
                        ),
                        mutate(rename={
                            "[http][response][body][status_code]": "[http][response][status_code]",
                            "referer_domain": "[url][domain]",
                        }),
                        mutate(convert={"[http][response][status_code]": "integer"}),
                    ],
                )),
                mutate(remove_tag="squid_json", add_tag="squid"),
            ],
        )
    ]


# Forms of sshd lines, each written out whole.
SSHD_FAILURE = r"(?:error: )?PAM: (?<[event][reason]>.*?) for (?<[user][name]>[\w\-\.]+) from (?<[source][ip]>[\d\.]+)"
SSHD_OTHER = r"(?<[log][level]>\w+):\s*(?<[event][reason]>.*)"
SSHD_SUCCESS = (
    r"(?<[event][auth_method]>publickey|password|gssapi-with-mic|keyboard-interactive) for (?<[user][name]>[\w\-\.]+) from (?<[source][ip]>[\d\.]+)"
)


def sshd() -> list[Case]:
    return [
        _service(
            "sshd", "sshd", "sshd", "sshd",
            branch(
                (
                    matches(TEXT, "authentication failure|Authentication failure|failed|error"),
                    [
                        grok(TEXT, SSHD_FAILURE),
                        branch((
                            missing("[event][reason]"),
                            [grok(TEXT, SSHD_OTHER)],
                        )),
                        mutate(replace={
                            "[event][outcome]": "failure",
                            "[event][action]": "authentication_failure",
                        }),
                    ],
                ),
                (
                    matches(TEXT, "[Aa]ccept|success"),
                    [
                        grok(TEXT, SSHD_SUCCESS),
                        mutate(replace={
                            "[event][outcome]": "success",
                            "[event][action]": "authentication_success",
                        }),
                    ],
                ),
            ),
            add_field={"[event][category]": "authentication"},
        )
    ]


def kea_dhcp() -> list[Case]:
    def server(version: str) -> Case:
        return (
            matches(APP, f"^kea-dhcp{version}$"),
            [
                mutate(
                    add_tag=["kea-dhcp", f"dhcp{version}"],
                    replace={**routed(f"kea-dhcp{version}", "kea-dhcp"), APP: "kea-dhcp"},
                ),
                grok(TEXT, f"%{{KEADHCP{version}}}"),
            ],
        )

    return [server("4"), server("6")]


def web_portal() -> list[Case]:
    def outcome(word: str, action: str, result: str, severity: int, tags: list[str]) -> Operator:
        return branch((
            matches("[pf][app][action]", word),
            [mutate(
                add_tag=tags,
                add_field={
                    "[event][action]": action,
                    "[event][outcome]": result,
                    "[event][type]": "authentication",
                    "[event][severity]": severity,
                },
            )],
        ))

    return [
        _service(
            "php-fpm", "web_portal", "webportal", "firewall_services",
            grok(TEXT, "%{PF_APP} %{PF_APP_DATA}"),
            # lower-casing comes after renaming inside one block; the two do not touch one field
            mutate(
                lowercase="[pf][app][action]",
                rename={
                    "[pf][app][user]": "[user][name]",
                    "[pf][remote][ip]": "[source][ip]",
                    "[pf][app][page]": "[url][path]",
                },
            ),
            outcome(
                "authentication error", "authentication_failure", "failure", 3,
                ["authentication_failure", "auth_error"],
            ),
            outcome("login", "authentication_success", "success", 0, ["authentication_success"]),
            branch((
                missing("[event][action]"),
                [mutate(add_field={
                    "[event][action]": "web_portal_activity",
                    "[event][type]": "web_application",
                    "[event][severity]": 1,
                })],
            )),
            add_field={"[event][category]": "web_application"},
        )
    ]


def sshguard() -> list[Case]:
    counts = ("block_duration", "attack_count", "attack_timeframe", "abuse_count", "abuse_timeframe")
    return [
        _service(
            "sshguard", "sshguard", "sshguard", "sshguard",
            grok(TEXT, "%{SSHGUARD}"),
            branch((
                matches(TEXT, "^Blocking"),
                [
                    mutate(
                        add_field={"[event][action]": "blocking", "[event][type]": "denied"},
                        gsub=[("blocked_target", r"/\d+$", "")],
                    ),
                    mutate(rename={
                        "blocked_target": "[source][ip]",
                        **{name: f"[sshguard][{name}]" for name in counts},
                    }),
                ],
            )),
            branch((
                matches(TEXT, "^Attack from"),
                [mutate(
                    add_field={"[event][action]": "attack", "[event][type]": "denied"},
                    rename={
                        "source_ip": "[source][ip]",
                        "sshguard_service": "[sshguard][service]",
                        "sshguard_danger": "[sshguard][danger]",
                    },
                )],
            )),
            add_field={"[event][category]": "intrusion_detection"},
        )
    ]


def services(json_fields: Mapping[str, str] | None = None) -> list[Case]:
    """The simple services, in order."""
    return [
        *captive_portal(), *dpinger(), *haproxy(), *nginx(), *openvpn(), *named_server(), *ntpd(),
        *snort(), *squid(json_fields),
    ]
