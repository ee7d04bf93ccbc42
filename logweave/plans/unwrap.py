"""Syslog wrappers: header fields out, inner message into ``filter_message``."""

from __future__ import annotations

from logweave.operators import grok, mutate
from logweave.pipeline import Operator, branch
from logweave.predicates import eq, matches, not_matches

# Header formats, each written out whole.
SURICATA_HEADER = (
    r"<%{INT:[log][syslog][priority]}>%{SYSLOGTIMESTAMP:[log][syslog][timestamp]}\s+%{HOSTNAME:[log][syslog][hostname]}"
    r"\s+suricata:\s+%{GREEDYDATA:filter_message}"
)
UNBOUND_HEADER = (
    r"<%{INT:[log][syslog][priority]}>%{INT:[log][syslog][version]}\s+%{NOTSPACE:[log][syslog][timestamp]}"
    r"\s+%{NOTSPACE:[log][syslog][hostname]}\s+%{NOTSPACE:[log][syslog][appname]}"
    r"\s+%{NOTSPACE:[log][syslog][procid]}\s+%{NOTSPACE:[log][syslog][msgid]}"
    r'\s+\[meta sequenceId="%{INT:[event][sequence]}"\]\s+%{GREEDYDATA:filter_message}'
)
FIREWALL_HEADER = (
    r"<%{INT:[log][syslog][priority]}>%{INT:[log][syslog][version]} %{NOTSPACE:[log][syslog][timestamp]}"
    r" %{NOTSPACE:[log][syslog][hostname]} %{NOTSPACE:[log][syslog][appname]}"
    r" %{NOTSPACE:[log][syslog][procid]} %{NOTSPACE:[log][syslog][msgid]}"
    r" %{NOTSPACE:[log][syslog][structured_data]} %{GREEDYDATA:filter_message}"
)
# A dated header within a line, with and without a second identifier; by the field that takes the rest.
INNER_HEADERS = {
    "message": [
        r"%{TIMESTAMP_ISO8601}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+-\s+-\s+%{NOTSPACE}\s+-\s+-\s+%{GREEDYDATA:message}",
        r"%{TIMESTAMP_ISO8601}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+-\s+-\s+%{GREEDYDATA:message}",
    ],
    "filter_message": [
        r"%{TIMESTAMP_ISO8601}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+-\s+-\s+%{NOTSPACE}\s+-\s+-\s+%{GREEDYDATA:filter_message}",
        r"%{TIMESTAMP_ISO8601}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+%{NOTSPACE}\s+-\s+-\s+%{GREEDYDATA:filter_message}",
    ],
}


def unwrap() -> list[Operator]:
    """Take the syslog wrapper off; which one depends on the input type."""
    return [
        branch(
            (
                eq("[type]", "suricata"),
                [
                    mutate(copy={"message": "filter_message"}),
                    branch((
                        not_matches("filter_message", r"^\{.*\}$"),
                        [grok(
                            "filter_message", SURICATA_HEADER,
                            tag_on_failure="grok_fail_00_input_suricata_syslog_wrap",
                        )],
                    )),
                ],
            ),
            (
                eq("[type]", "unbound"),
                [
                    mutate(copy={"message": "[@metadata][raw_message]"}),
                    grok(
                        "message", UNBOUND_HEADER,
                        tag_on_failure="grok_fail_00_input_unbound_outer",
                    ),
                    branch((
                        matches("filter_message", r"^\d{4}-\d{2}-\d{2}T"),
                        [grok(
                            "filter_message", INNER_HEADERS["message"],
                            tag_on_failure="grok_fail_00_input_unbound_inner",
                        )],
                    )),
                    mutate(copy={"message": "filter_message"}, strip="filter_message"),
                ],
            ),
            otherwise=[
                grok(
                    "message", FIREWALL_HEADER,
                    tag_on_failure="grok_fail_00_input_firewall_rfc5424",
                ),
                mutate(replace={"type": "firewall"}),
            ],
        )
    ]
