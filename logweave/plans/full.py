"""All stages in order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.frame import CHAIN_LIMIT, EventFrame, common_type
from logweave.functions.shared import new_folder
from logweave.operators.lookup import Lookup, NetworkTable
from logweave.pipeline import Chain, dispatch, ordered, stage
from logweave.plans import apps, cleanup, dns_server, enrich, firewall, intrusion, unwrap


@dataclass
class Tables:
    """Lookup tables of the enrichment stages; what is not given is left out."""

    rule_names: Lookup | None = None
    port_names: Lookup | None = None
    private_hosts: Lookup | None = None
    host_names: Lookup | None = None
    interfaces: DataFrame | None = None
    loopback_hosts: tuple[str, ...] = ()
    home: dict[str, str] | None = None
    keep_passwords: bool = True
    """Whether the password of a URL becomes a field; it stays in the URL itself either way."""
    city: NetworkTable | None = None
    asn: NetworkTable | None = None


def _cases(fix_egress: bool) -> tuple[list, tuple, tuple]:
    """What each log type is told by and what it does: types told by the program name, resolver lines, intrusion alerts.

    A program name that one type rewrites is never one that a later type tests for, except that resolver and intrusion
    lines, picked by input type, are closed to the types after them.
    """
    [resolver], [alerts] = dns_server.unbound(), intrusion.suricata()
    late = [*apps.kea_dhcp(), *apps.web_portal()]
    by_program = [
        *firewall.filterlog(fix_egress),
        *apps.services(),
        *apps.sshd(),
        *[(cond & ~resolver[0], block) for cond, block in late],
        *[(cond & ~resolver[0] & ~alerts[0], block) for cond, block in apps.sshguard()],
    ]
    return by_program, resolver, alerts


def parse_chain(fix_egress: bool = False) -> Chain:
    """Unwrap and parse every known log type; no lookups.

    Log types are told apart by the program name and input type as they are after unwrapping.
    """
    by_program, resolver, alerts = _cases(fix_egress)
    return Chain(ordered({
        "00-unwrap": unwrap.unwrap(),
        "20-log-types": [dispatch(*by_program, resolver, alerts, disjoint=len(by_program))],
    }))


def enrich_chain(spark: SparkSession, tables: Tables) -> Chain:
    """Lookups and derived fields."""
    files = {
        "70-places": enrich.places(tables.city, tables.asn),
        "75-rule-names": enrich.rule_names(tables.rule_names),
        "76-port-names": enrich.port_names(tables.port_names),
        "77-user-agents": enrich.user_agents(),
        "78-urls": enrich.urls(tables.keep_passwords),
        "79-private-clients": enrich.private_clients(tables.private_hosts, tables.home),
    }
    if tables.interfaces is not None:
        files["65-interfaces"] = enrich.interfaces(tables.interfaces, tables.loopback_hosts)
    if tables.host_names is not None:
        files["85-host-names"] = enrich.host_names(tables.host_names)
    return Chain(ordered(files))


def full_chain(spark: SparkSession, tables: Tables | None = None, fix_egress: bool = False) -> Chain:
    """From raw lines to finished records, ready for the sink."""
    last = Chain(ordered({"99-cleanup": cleanup.cleanup()}))
    return parse_chain(fix_egress) + enrich_chain(spark, tables or Tables()) + last


KIND = "log_kind"
_NONE, _SEVERAL = "none", "several"


def unwrapped_by_type(lines: DataFrame, fix_egress: bool = False) -> DataFrame:
    """Lines without their wrappers, and in ``log_kind`` the one log type that each is of, ``none``, or ``several``."""
    f = EventFrame(lines)
    for op in unwrap.unwrap():
        f.run(op)
    by_program, resolver, alerts = _cases(fix_egress)
    tests = [f.share(cond.build(f)) for cond, _ in (*by_program, resolver, alerts)]

    def kind(*tests: Column) -> Column:
        first = F.coalesce(*(F.when(t, F.lit(f"type{i:02d}")) for i, t in enumerate(tests)), F.lit(_NONE))
        number = sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests[1:]), F.coalesce(tests[0], F.lit(False)).cast("int"))
        return F.when(number > 1, _SEVERAL).otherwise(first)

    return f.to_df({KIND: f.lift(kind, *tests, dtype="string", cost=CHAIN_LIMIT)})


def united(parts: list[DataFrame], columns: dict[str, str] | None = None) -> DataFrame:
    """Rows of events of different types as one table: all columns of any of them, a column of several types in their common one.

    ``columns`` (name to type) fixes what columns there are, in that order.
    """
    frames = [EventFrame(p) for p in parts]
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, ref in f.fields.items():
            kinds.setdefault(name, set()).add(ref.dtype)
    wanted = columns or {name: common_type(found) for name, found in kinds.items()}

    def aligned(f: EventFrame) -> DataFrame:
        return f.df.select(*(
            (f.to_type(f.fields[n], kind).col if n in f.fields else F.lit(None).cast(kind)).alias(n) for n, kind in wanted.items()
        ))

    out = aligned(frames[0])
    for f in frames[1:]:
        out = out.union(aligned(f))
    return out


def complete_records(
    spark: SparkSession, lines: DataFrame, tables: Tables | None = None, fix_egress: bool = False,
    columns: dict[str, str] | None = None, staged: str | None = None,
) -> DataFrame:
    """From raw lines to finished records, each log type by a plan of its own: the rows of ``full_chain``.

    The unwrapped lines are written once, in a folder for each type, to ``staged`` or below the shared folder; then each type
    that occurs is read alone and parsed, enriched and cleaned by a chain that knows no other type. So no row meets the
    conditions of other types, and a plan is as long as its type needs. Columns are those of the types that occur, or
    ``columns``. For batches; a stream takes ``full_chain``.
    """
    path = staged or new_folder(spark, "by-type")
    kept = unwrapped_by_type(lines, fix_egress)
    kept.write.mode("overwrite").partitionBy(KIND).parquet(path)
    stage_one = spark.read.schema(kept.schema).parquet(path)
    there = sorted(r[0] for r in stage_one.select(KIND).distinct().collect())  # no more than there are log types
    by_program, resolver, alerts = _cases(fix_egress)
    cases = [*by_program, resolver, alerts]
    rest = enrich_chain(spark, tables or Tables()) + Chain(ordered({"99-cleanup": cleanup.cleanup()}))
    parts = []
    for kind in there:
        if kind == _SEVERAL:
            own = Chain([stage(kind, dispatch(*cases, disjoint=len(by_program)))])
        else:
            own = Chain([] if kind == _NONE else [stage(kind, *cases[int(kind[4:])][1])])
        mine = stage_one.filter(F.col(KIND) == kind).drop(KIND)
        parts.append((own + rest).apply(mine))
    return united(parts or [rest.apply(stage_one.drop(KIND))], columns)
