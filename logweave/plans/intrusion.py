"""Suricata events: JSON records and fast-log lines."""

from __future__ import annotations

from logweave.operators import grok, json, mutate
from logweave.pipeline import Operator, branch
from logweave.plans.fixed import routed
from logweave.predicates import Condition, eq, exists, lacks, matches, missing

TEXT = "filter_message"


def suricata() -> list[tuple[Condition, list[Operator]]]:
    eve = "[suricata][eve]"

    def fill(key: str, target: str, more: dict[str, str] | None = None) -> Operator:
        """Copy an address or port from the record unless the event has one."""
        return branch((
            exists(f"{eve}[{key}]") & missing(target),
            [mutate(add_field={target: f"%{{{eve}[{key}]}}", **(more or {})})],
        ))

    return [
        (
            eq("[type]", "suricata") | matches("[log][syslog][appname]", "^suricata$"),
            [
                branch((
                    matches(TEXT, r"^{.*}$"), [json(TEXT, target=eve, add_tag="suricata_json")]
                )),
                fill("src_ip", "[source][ip]"),
                fill("dest_ip", "[destination][ip]"),
                fill("src_port", "[source][port]"),
                fill(
                    "dest_port", "[destination][port]",
                    {"[threatintel][indicator][ip]": f"%{{[source][ip]}} %{{{eve}[http][url]}}"},
                ),
                branch((lacks("suricata_json"), [grok(TEXT, "%{SURICATA}")])),
                mutate(
                    remove_tag="suricata_json",
                    add_tag="suricata",
                    replace={"[log][syslog][appname]": "suricata", **routed("suricata", "suricata")},
                ),
            ],
        )
    ]
