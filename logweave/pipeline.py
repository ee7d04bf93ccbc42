"""Chains of stages, guarded blocks, and per-stage audit records."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.frame import CHAIN_LIMIT, EventFrame, Note, Ref
from logweave.predicates import Condition

Operator = Callable[[EventFrame], None]

KINDS = ("fields_added", "fields_modified", "fields_removed", "tags_added", "tags_removed")
LABELS = ("Fields Added", "Fields Modified", "Fields Removed", "Tags Added", "Tags Removed")


def branch(*cases: tuple[Condition, Iterable[Operator]], otherwise: Iterable[Operator] = ()) -> Operator:
    """if / else-if / else: the first condition that holds picks the block.

    Conditions are evaluated once, on entry; a block may rewrite the very fields its condition
    reads without changing which rows it covers.
    """
    listed = [(cond, list(block)) for cond, block in cases]
    rest = list(otherwise)

    def run(f: EventFrame) -> None:
        cases, taken = [], None
        for cond, block in listed:
            hit = f.share(cond.build(f))
            mine = hit if taken is None else f.share(f.both(hit, f.negate(taken)))
            cases.append((mine, block))
            taken = hit if taken is None else f.lift(
                lambda a, b: a | b, taken, hit, dtype="boolean", limit=CHAIN_LIMIT
            )
        if rest:
            cases.append((f.share(f.negate(taken)), rest))
        f.run_blocks(cases, disjoint=len(cases))

    run.is_block = True
    return run


def dispatch(*cases: tuple[Condition, Iterable[Operator]], disjoint: int = 0) -> Operator:
    """Independent ifs whose conditions are all evaluated on entry, in one round.

    Same as one ``branch`` after the other when no block writes what a later condition reads.
    ``disjoint`` is the number of leading cases of which no row meets two, as with tests for
    different texts of one field; such a block need not look at what the others wrote.
    """
    listed = [(cond, list(block)) for cond, block in cases]

    def run(f: EventFrame) -> None:
        f.run_blocks([(f.share(cond.build(f)), block) for cond, block in listed], disjoint)

    run.is_block = True
    return run


def named(kind: str, run: Operator) -> Operator:
    """Give an operator the name its audit records carry."""
    run.kind = kind
    return run


def drop() -> Operator:
    """Remove the rows of the current block."""

    def run(f: EventFrame) -> None:
        gone = f.guard() or f.literal(True, "boolean")
        f.add_step([gone], lambda df, c: df.filter(~c))

    return named("drop", run)


@dataclass(frozen=True)
class Stage:
    """A named list of operators, or a plain DataFrame function as the escape hatch."""

    name: str
    operators: tuple[Operator, ...] = ()
    transform: Callable[[DataFrame], DataFrame] | None = None


def stage(name: str, *operators: Operator, transform: Callable[[DataFrame], DataFrame] | None = None) -> Stage:
    return Stage(name, tuple(operators), transform)


class Chain:
    """An ordered list of stages. ``apply`` works on batch and streaming DataFrames alike."""

    def __init__(self, stages: Iterable[Stage]):
        self.stages = list(stages)

    def __add__(self, other: Chain) -> Chain:
        return Chain([*self.stages, *other.stages])

    def apply(self, df: DataFrame, audit: bool = False, snapshots: bool = False) -> DataFrame:
        """Run the stages. ``audit`` adds an ``audit`` array column, one entry per operator, run or
        skipped; ``snapshots`` puts the event before and after each operator into the entries."""
        f = EventFrame(df)
        records: list[Ref] = []
        for s in self.stages:
            if s.transform is not None:
                carried = {"audit": _as_array(f, records)} if records else {}
                f = EventFrame(s.transform(f.to_df(carried)))
                records = [f.fields.pop("audit")] if carried else []
            if audit:
                f.recorder = lambda op, s=s, f=f: records.append(_record(f, s.name, op, snapshots))
            for op in s.operators:
                f.run(op)
        return f.to_df({"audit": _as_array(f, records)} if records else None)


def ordered(files: dict[str, list[Operator]]) -> list[Stage]:
    """Stages from named blocks, in order of their leading number, then name."""

    def key(name: str) -> tuple[int, str]:
        digits = name[: len(name) - len(name.lstrip("0123456789"))]
        return (int(digits) if digits else 1 << 31, name)

    return [stage(name, *files[name]) for name in sorted(files, key=key)]


# ---- audit -----------------------------------------------------------------------------


def _record(f: EventFrame, name: str, op: Operator, snapshots: bool) -> Ref:
    """Apply one operator and build its audit entry: what it changed in this row."""
    everywhere = f.literal(True, "boolean")
    executed = f.guard() or everywhere
    before = f.bind(f.snapshot()) if snapshots else None
    f.notes = []
    op(f)
    notes, f.notes = f.notes, None
    after = f.bind(f.snapshot()) if snapshots else None
    inside, f.block = f.block, None
    lists: list[Ref] = []
    for kind in KINDS:
        mine = [n for n in notes if n.kind == kind]

        def gather(*conds: Column, mine=mine) -> Column:
            return F.filter(
                F.array(*[F.when(c, F.lit(n.name)) for c, n in zip(conds, mine, strict=True)]),
                lambda x: x.isNotNull(),
            )

        if mine:
            lists.append(f.lift(gather, *[n.when or everywhere for n in mine], dtype="array<string>"))
        else:
            lists.append(Ref(F.array().cast("array<string>"), "array<string>"))
    failed = f.literal(False, "boolean")
    for n in notes:
        if n.kind == "error":
            failed = f.lift(lambda a, b: a | b, failed, n.when or everywhere, dtype="boolean")
    views = [before, after] if snapshots else []

    def entry(done: Column, bad: Column, *cols: Column) -> Column:
        changed, shots = cols[: len(KINDS)], cols[len(KINDS) :]
        return F.struct(
            F.lit(name).alias("stage"),
            F.lit(getattr(op, "kind", "custom")).alias("filter"),
            done.alias("executed"),
            change_label(bad, *changed).alias("changes"),
            *[c.alias(k) for k, c in zip(KINDS, changed, strict=True)],
            *[c.alias(k) for k, c in zip(("before", "after"), shots)],
        )

    bound = [f.bind(x) for x in lists]
    made = f.bind(f.lift(entry, executed, failed, *bound, *views, dtype="struct", cost=50))
    f.block = inside
    return made


def change_label(failed: Column, *lists: Column) -> Column:
    """Comma-joined kinds of change; ``Error`` for a failed parse, ``No Changes`` for none."""
    joined = F.concat_ws(
        ", ", *[F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(lists, LABELS, strict=True)]
    )
    return F.when(failed, "Error").when(joined == "", "No Changes").otherwise(joined)


def _as_array(f: EventFrame, records: list[Ref]) -> Ref:
    if len(records) == 1 and records[0].dtype.startswith("array"):
        return records[0]
    head = [r for r in records if r.dtype.startswith("array")]
    rest = [r for r in records if not r.dtype.startswith("array")]
    new = f.lift(lambda *c: F.array(*c), *rest, dtype="array<struct>")
    return f.lift(lambda a, b: F.concat(a, b), head[0], new, dtype="array<struct>") if head else new
