"""Packet-filter lines: comma-separated values whose meaning depends on IP version and protocol."""

from __future__ import annotations

from logweave.operators import mutate
from logweave.pipeline import Operator, branch
from logweave.plans.fixed import routed
from logweave.predicates import Condition, eq, matches, one_of

# Field at each position.
COMMON = (
    "[rule][id]", "[pf][rule][subid]", "[pf][anchor]", "[rule][uuid]", "[interface][name]",
    "[event][reason]", "[event][action]", "[network][direction]", "[network][type]",
)
V4 = (
    "[pf][tos]", "[pf][ecn]", "[pf][ttl]", "[pf][id]", "[pf][offset]", "[pf][flags]",
    "[network][iana_number]", "[network][protocol]", "[pf][packet][length]", "[source][ip]",
    "[destination][ip]",
)
V6 = (
    "[pf][class]", "[pf][flow]", "[pf][hoplimit]", "[network][protocol]", "[network][iana_number]",
    "[pf][packet][length]", "[source][ip]", "[destination][ip]",
)
TCP = (
    "[source][port]", "[destination][port]", "[pf][data_length]", "[pf][tcp][flags]",
    "[pf][tcp][sequence_number]", "[pf][tcp][ack]", "[pf][tcp][window]", "[pf][tcp][urg]",
    "[pf][tcp][options]",
)
UDP = TCP[:3]

_PARTS = "pfelk_csv"


def _columns(fields: tuple[str, ...], start: int) -> Operator:
    return mutate(
        add_field={name: f"%{{[{_PARTS}][{start + i}]}}" for i, name in enumerate(fields)}
    )


def _version(number: str, fields: tuple[str, ...]) -> tuple:
    start = len(COMMON)
    after = start + len(fields)
    return (
        eq("[network][type]", number),
        [
            _columns(fields, start),
            branch((eq("[network][protocol]", "tcp"), [_columns(TCP, after)])),
            branch((eq("[network][protocol]", "udp"), [_columns(UDP, after)])),
        ],
    )


def filterlog(fix_egress: bool = False) -> list[tuple[Condition, list[Operator]]]:
    """Parse packet-filter lines. ``fix_egress`` also maps direction ``out`` to ``egress``; without
    it, the test is on the network type, as declared, and never holds."""
    outbound = "[network][direction]" if fix_egress else "[network][type]"
    sizes = {"out": "destination", "in": "source"}
    return [
        (
            matches("[log][syslog][appname]", "^filterlog$"),
            [
                mutate(
                    add_tag="firewall",
                    replace={**routed("firewall", "firewall"), "[log][syslog][appname]": "firewall"},
                    copy={"filter_message": _PARTS},
                ),
                mutate(strip=_PARTS, split={_PARTS: ","}),
                _columns(COMMON, 0),
                branch(_version("4", V4)),
                branch(_version("6", V6)),
                branch(
                    (
                        one_of("[pf][tcp][flags]", ["FPA", "FA", "RA", "PA"]),
                        [mutate(
                            add_field={"[pf][block_reason]": "TCP Out-of-State (Harmless)"},
                            add_tag="out_of_state",
                        )],
                    ),
                    (
                        eq("[pf][tcp][flags]", "S") & eq("[event][action]", "block"),
                        [mutate(
                            add_field={"[pf][block_reason]": "New Connection Attempt (Blocked)"},
                            add_tag="unauthorized_attempt",
                        )],
                    ),
                ),
                *[
                    branch((
                        matches("[network][direction]", f"^{word}$"),
                        [mutate(rename={
                            "[pf][data_length]": f"[{side}][bytes]",
                            "[pf][packet][length]": f"[{side}][packets]",
                        })],
                    ))
                    for word, side in sizes.items()
                ],
                branch((eq("[network][type]", "4"), [mutate(update={"[network][type]": "ipv4"})])),
                branch((eq("[network][type]", "6"), [mutate(update={"[network][type]": "ipv6"})])),
                branch((
                    matches("[network][direction]", "^in$"),
                    [mutate(update={"[network][direction]": "ingress"})],
                )),
                branch((matches(outbound, "^out$"), [mutate(update={outbound: "egress"})])),
            ],
        )
    ]
