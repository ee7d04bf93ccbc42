"""Enrichment stages: interfaces, networks and places, names, URLs, private clients."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from logweave.functions.ip import PRIVATE_NETWORKS
from logweave.operators import (
    cidr, dns, geoip, interface_alias, mutate, translate, url_parts, user_agent_length,
)
from logweave.operators.intervals import IntervalTable
from logweave.operators.lookup import Lookup, NetworkTable
from logweave.pipeline import Operator, branch
from logweave.plans.fixed import PRODUCT
from logweave.predicates import eq, exists, has, lacks, matches, one_of
from logweave.sources.dictionary import literal_table


def interface_table(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Rows of host name, interface, alias and network as a table; a name written as a regex becomes a pattern."""
    made = [
        (host, None if name.startswith("^") else name, alias, network,
         name if name.startswith("^") else None, i)
        for i, (host, name, alias, network) in enumerate(rows)
    ]
    return literal_table(
        spark, made, ["hostname", "interface", "alias", "network", "pattern", "position"]
    )


def interfaces(table: DataFrame, hosts: Iterable[str] = ()) -> list[Operator]:
    """Alias and network name; loopback lines of the listed hosts also get rewritten direction and type."""
    if not list(hosts):
        return [interface_alias(table)]
    loopback = one_of("[log][syslog][hostname]", list(hosts)) & matches("[interface][name]", "^lo0$")
    return [
        interface_alias(table),
        branch((
            loopback,
            [mutate(update={
                "[network][direction]": "%{[network][direction]}bound",
                "[network][type]": "ipv%{[network][type]}",
            })],
        )),
    ]


def _place(address: str, private_tag: str, done_tag: str, target: str, known: IntervalTable | None) -> Operator:
    lookups = [] if known is None else [geoip(address, known, target)]
    return branch((
        exists(address),
        [
            cidr(address, PRIVATE_NETWORKS, private_tag),
            branch((lacks(private_tag), [*lookups, mutate(add_tag=done_tag)])),
        ],
    ))


def places(
    city: NetworkTable | IntervalTable | None = None,
    asn: NetworkTable | None = None,
    targets: dict[str, str] | None = None,
) -> list[Operator]:
    """Private-network test, then place and network owner of public addresses.

    Both tables become one list of intervals (or are given as one, in ``city``), so each address costs one join. Source
    and destination get their own targets; pass ``targets`` to choose others.
    """
    given = [t for t in (city, asn) if t is not None]
    if len(given) == 1 and isinstance(given[0], IntervalTable):
        known = given[0]
    else:
        known = IntervalTable(*given) if given else None
    to = {
        "source": "source.geo", "destination": "destination.geo", "client": "client.geo",
        "vpn": "openvpn.client.geo", **(targets or {}),
    }
    return [
        branch((
            has(PRODUCT),
            [
                _place("[source][ip]", "IP_Private_Source", "GeoIP_Source", to["source"], known),
                _place(
                    "[destination][ip]", "IP_Private_Destination", "GeoIP_Destination",
                    to["destination"], known,
                ),
            ],
        )),
        branch((
            has("haproxy") | has("nginx"),
            [_place("[client][ip]", "IP_Private_Proxy", "GeoIP_Source", to["client"], known)],
        )),
        branch((
            has("openvpn"),
            [_place(
                "[openvpn][client][ip]", "IP_Private_OpenVPN", "GeoIP_Client_OpenVPN", to["vpn"], known
            )],
        )),
    ]


def rule_names(dictionary: Lookup | None) -> list[Operator]:
    return [
        branch((
            has("firewall") & exists("[rule][uuid]"),
            [translate(
                "[rule][uuid]", "[rule][description]", dictionary, "Rule ID: %{[rule][uuid]}"
            )],
        ))
    ]


def port_names(dictionary: Lookup | None) -> list[Operator]:
    return [
        branch((
            has("firewall"),
            [
                branch((
                    exists(f"[{side}][port]"),
                    [translate(
                        f"[{side}][port]", f"[{side}][service][name]", dictionary,
                        f"port-%{{[{side}][port]}}",
                    )],
                ))
                for side in ("destination", "source")
            ],
        ))
    ]


def user_agents() -> list[Operator]:
    """Length of the user agent, and names for fields of an agent parsed before."""
    ua = "[user_agent]"
    return [
        branch((
            exists(f"{ua}[original]"),
            [
                user_agent_length(),
                branch((
                    eq("[@metadata][ua_parse]", "true"),
                    [
                        branch((
                            exists(f"{ua}[os_major]") & exists(f"{ua}[os_minor]") & exists(f"{ua}[patch]"),
                            [mutate(
                                convert={f"{ua}[{n}]": "string" for n in ("os_major", "os_minor", "patch")},
                                remove_field=f"{ua}[os][version]",
                            )],
                        )),
                        mutate(
                            rename={
                                f"{ua}[os]": f"{ua}[os][full]",
                                f"{ua}[os_name]": f"{ua}[os][name]",
                                f"{ua}[device]": f"{ua}[device][name]",
                            },
                            remove_field=[f"{ua}[os][major]", f"{ua}[os][minor]", f"{ua}[patch]"],
                        ),
                    ],
                )),
            ],
        ))
    ]


def urls(keep_password: bool = False) -> list[Operator]:
    return [branch((exists("[url][original]"), [url_parts(keep_password=keep_password)]))]


def private_clients(hostnames: Lookup | None, home: dict[str, str] | None = None) -> list[Operator]:
    """Host name of the client address, and the fields of ``home`` (path to value) for private ones."""

    def name(address: str) -> Operator:
        return branch((
            exists(address),
            [
                translate(address, "[client][subdomain]", hostnames, f"%{{{address}}}"),
                cidr(address, PRIVATE_NETWORKS, "Private_Client_IP"),
            ],
        ))

    return [
        branch((has("unbound") | has("squid"), [name("[client][ip]")])),
        branch((has("kea-dhcp"), [name("[kea][dhcp][client][ip]")])),
        branch((has("dhcp"), [name("[dhcpv6][client][ip]")])),
        branch((
            has("Private_Client_IP"),
            [mutate(add_field=home or {}, lowercase="[client][subdomain]")],
        )),
    ]


def host_names(hosts: Lookup) -> list[Operator]:
    return [
        branch((
            exists(f"[{side}][ip]"),
            [
                mutate(copy={f"[{side}][ip]": f"[{side}][domain]"}),
                dns(hosts, reverse=[f"[{side}][domain]"]),
            ],
        ))
        for side in ("source", "destination")
    ]

