"""Last stage before the sink: one route per event, raw message back, working fields gone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.frame import EventFrame
from logweave.functions.text import leading_int
from logweave.operators import mutate
from logweave.pipeline import Operator, branch, named
from logweave.plans.fixed import FALLBACK_TAG, PRODUCT
from logweave.predicates import Condition, exists

_ROUTE = ("[event][dataset]", "[data_stream][dataset]", "[data_stream][namespace]")


def first_choice(values: Column) -> Column:
    """One value of a list: the first that is not ``firewall``, else the last; NULL if all are blank."""
    filled = F.filter(values, lambda v: v.isNotNull() & v.rlike(r"\S"))
    return F.coalesce(
        F.get(F.filter(filled, lambda v: v != "firewall"), 0), F.get(F.reverse(filled), 0)
    )


def normalize_lists(fields: tuple[str, ...] = _ROUTE) -> Operator:
    """Reduce list values to one; a list of blanks, which has nothing to offer, becomes NULL."""

    def run(f: EventFrame) -> None:
        for field in fields:
            found = f.get(field)
            if found is not None and found.dtype.startswith("array<"):
                f.set(field, f.lift(first_choice, found, dtype="string", cost=10))

    return named("normalize", run)


def _blank(ref: str) -> Condition:
    def build(f: EventFrame):
        found = f.text(ref)
        if found is None:
            return f.literal(True, "boolean")
        return f.lift(
            lambda c: F.coalesce(~c.rlike(r"\S"), F.lit(True)), found, dtype="boolean", cost=10
        )

    return Condition(build)


def sequence_range(
    field: str = "[pf][tcp][sequence_number]", end: str = "[pf][tcp][sequence_number_range_end]"
) -> Operator:
    """``a:b`` into two integers, a lone number into one; text without digits reads as 0."""

    def run(f: EventFrame) -> None:
        found = f.get(field)
        if found is None or found.dtype != "string":
            return
        found = f.bind(found)
        pieces = f.bind(f.lift(lambda c: F.split(c, ":"), found, dtype="array<string>", cost=30))
        ranged = f.bind(f.lift(lambda c: F.coalesce(c.contains(":"), F.lit(False)), found, dtype="boolean"))
        last = f.lift(
            lambda p: leading_int(F.coalesce(F.get(p, 1), F.lit(""))), pieces, dtype="bigint", cost=20
        )
        first = f.lift(
            lambda c, p: F.when(c.isNotNull(), leading_int(F.get(p, 0))), found, pieces,
            dtype="bigint", cost=20,
        )
        there = f.lift(lambda c: c.isNotNull(), found, dtype="boolean")
        f.note("fields_modified", field, there)
        f.note("fields_added", end, ranged)
        f.put(end, f.lift(lambda r, v: F.when(r, v), ranged, last, dtype="bigint"))
        f.set(field, first)

    return named("sequence", run)


def cleanup() -> list[Operator]:
    dataset = _blank("[data_stream][dataset]") & _blank("[event][dataset]")
    return [
        normalize_lists(),
        branch((
            exists("[event][dataset]"),
            [mutate(replace={"[data_stream][dataset]": "%{[event][dataset]}"})],
        )),
        branch((
            dataset | _blank("[data_stream][namespace]"), [mutate(add_tag=FALLBACK_TAG)]
        )),
        branch((
            exists("[@metadata][raw_message]"),
            [
                mutate(replace={"message": "%{[@metadata][raw_message]}"}),
                mutate(remove_field="[@metadata][raw_message]"),
            ],
        )),
        mutate(
            remove_field=["filter_message", PRODUCT, f"{PRODUCT}_csv"],
            split={
                "[pf][tcp][options]": ";",
                "[openvpn][client][sso]": ",",
                "[openvpn][client][ciphers]": ":",
            },
            rename={"message": "[event][original]"},
        ),
        sequence_range(),
    ]
