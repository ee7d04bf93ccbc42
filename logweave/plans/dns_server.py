"""Unbound resolver lines: queries, answers, DNSSEC messages, network errors."""

from __future__ import annotations

from logweave.operators import grok, mutate
from logweave.pipeline import Operator, branch
from logweave.plans.fixed import PRODUCT, routed
from logweave.plans.unwrap import INNER_HEADERS
from logweave.predicates import Condition, eq, exists, has, matches, missing

TEXT = "filter_message"

# Line formats and failure tags, each written out whole.
INNER_SYSLOG = r"<%{INT}>%{INT}\s+%{TIMESTAMP_ISO8601}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{GREEDYDATA:filter_message}"
PAYLOAD = r".*(\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\]\s+%{LOGLEVEL:[log][level]}:\s+%{GREEDYDATA:unbound_payload})"
REBUILT = "[%{[process][pgid]}:%{[process][thread][id]}] %{[log][level]}: %{unbound_payload}"
QUERY = (
    r"\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\] %{LOGLEVEL:[log][level]}: %{IP:[client][ip]} %{NOTSPACE:[dns][question][name]} %{WORD:[dns][question][type]}"
    r" %{WORD:[dns][question][class]}( %{WORD:[dns][return_code]} %{NUMBER:[dns][timing]} %{INT:[dns][from_cache]} %{INT:[dns][response_size]})?"
)
RESOLVING = (
    r"\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\] %{LOGLEVEL:[log][level]}: resolving"
    r" %{NOTSPACE:[dns][question][name]} %{WORD:[dns][question][type]} %{WORD:[dns][question][class]}"
)
STATUS = r"\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\] %{LOGLEVEL:[log][level]}: query response was %{WORD:[dns][response_status]} %{WORD:[dns][response_type]}"
REGISTERED = r"(\.)?(?<[dns][question][registered_domain]>[^.]+\.[^.]+)\.?$"
TOP_LEVEL = r"(\.)?(?<[dns][question][top_level_domain]>[^.]+)\.?$"
_HEAD = r"\[%{INT:[process][pgid]}:%{INT:[process][thread][id]}\] %{LOGLEVEL:[log][level]}: "
_FAIL = "grok_fail_35_unbound_"


def registered_domain() -> list[Operator]:
    """Last two labels and last label of the question name.

    A name with a leading dot and one without are one pattern here, so both failure tags go together.
    """
    name = "[dns][question][name]"
    return [
        grok(
            name, REGISTERED,
            tag_on_failure=[_FAIL + "registered_domain_first", _FAIL + "registered_domain_second"],
        ),
        grok(
            name, TOP_LEVEL, tag_on_failure=_FAIL + "tld"
        ),
        mutate(remove_tag="unbound-registered_domain"),
    ]


def canonical() -> list[Operator]:
    """Strip inner headers and rebuild the message as ``[pid:tid] level: payload``."""
    return [
        branch((missing(TEXT) & exists("message"), [mutate(copy={"message": TEXT})])),
        branch((
            matches(TEXT, r"^<\d+>\d+\s+"),
            [grok(TEXT, INNER_SYSLOG, tag_on_failure=_FAIL + "strip_inner_rfc5424")],
        )),
        branch((
            matches(TEXT, r"^\d{4}-\d{2}-\d{2}T"),
            [grok(TEXT, INNER_HEADERS[TEXT], tag_on_failure=_FAIL + "strip_inner_timestamp")],
        )),
        grok(TEXT, PAYLOAD, tag_on_failure=_FAIL + "payload_extract"),
        branch((
            exists("unbound_payload"),
            [
                mutate(replace={TEXT: REBUILT}),
                mutate(remove_field="unbound_payload"),
            ],
        )),
    ]


def _special(word: str, body: str, fail: str, tag: str, fields: dict[str, str]) -> tuple:
    return (
        matches(TEXT, word),
        [
            grok(TEXT, _HEAD + body, tag_on_failure=_FAIL + fail),
            mutate(add_field=fields, add_tag=tag),
        ],
    )


def unbound() -> list[tuple[Condition, list[Operator]]]:
    kind = "[dnssec][message_type]"
    queries = ["%{UNBOUND}", "%{UNBOUND_RESOLVING}", QUERY, RESOLVING]
    return [
        (
            eq("[type]", "unbound") | matches("[log][syslog][appname]", "^unbound"),
            [
                *canonical(),
                mutate(
                    add_tag="unbound",
                    replace={"[log][syslog][appname]": "unbound", **routed("unbound", "unbound")},
                ),
                branch(
                    _special(
                        "Verified that",
                        "Verified that %{WORD:[dnssec][response_type]} response is"
                        " %{WORD:[dnssec][validation_state]}",
                        "dnssec_validation", "dnssec_validation", {kind: "validation"},
                    ),
                    _special(
                        "NSEC3?s? ",
                        "%{WORD:[dnssec][proof_type]} for %{DATA:[dnssec][target]}"
                        " (?<[dnssec][result]>proved .+)$",
                        "dnssec_proof", "dnssec_proof", {kind: "proof"},
                    ),
                    _special(
                        "validation failure",
                        "validation failure %{NOTSPACE:[dns][question][name]}",
                        "dnssec_validation_failure", "dnssec_failure",
                        {kind: "validation_failure", "[event][outcome]": "failure"},
                    ),
                    _special(
                        "prime trust anchor",
                        "%{DATA:[dnssec][action]}: %{GREEDYDATA:[dnssec][details]}",
                        "dnssec_trust_anchor", "dnssec_anchor", {kind: "trust_anchor"},
                    ),
                    _special(
                        "sendto failed",
                        "sendto failed: %{GREEDYDATA:[network][error]}",
                        "sendto_failed", "network_error", {"[event][outcome]": "failure"},
                    ),
                    (
                        matches(TEXT, "query response was"),
                        [
                            grok(
                                TEXT, STATUS, tag_on_failure=_FAIL + "query_response_status",
                            ),
                            mutate(add_field={"[dns][message_type]": "response_status"}),
                        ],
                    ),
                    otherwise=[
                        grok(TEXT, queries, tag_on_failure=_FAIL + "inline_resolving"),
                        *registered_domain(),
                        branch((
                            has("unbound"),
                            [mutate(replace={
                                "[event][dataset]": f"{PRODUCT}.unbound",
                                "[data_stream][dataset]": f"{PRODUCT}.unbound",
                            })],
                        )),
                    ],
                ),
            ],
        )
    ]
