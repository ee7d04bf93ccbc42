"""Plan-time view of an event table.

An :class:`EventFrame` maps every field path to the Column expression that currently produces it.
Operators read and write that map; nothing touches the data until :meth:`EventFrame.to_df`.

Three rules keep the resulting plan small and its rows narrow:

* Cheap expressions are inlined, so a chain of field edits ends up in one projection.
* A costly expression (a regex, a split, an IP key) is *bound*: it becomes a helper column computed
  once. Helper columns are laid out in rounds, one projection per round, where a round holds
  everything whose inputs are ready. The plan depth is the longest dependency chain.
* A guarded block works on its own copy of the map, as if all rows were its own. When it ends, the
  fields it changed become ``CASE WHEN guard THEN new ELSE old``. Blocks that exclude each other
  share helper columns: one ``CASE`` column serves them all, and a row only pays for its own block.

Lookups are left joins that add one helper column to a round, so the wide output projection is
written once, after all of them. Column pruning removes whatever a reader does not select.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave import paths
from logweave.functions.spread import source_tag

INLINE_LIMIT = 9
CHAIN_LIMIT = 120
SHARE_LIMIT = 4
REPEAT_LIMIT = 40
TAGS = "tags"
STRING_ARRAY = "array<string>"


@dataclass(frozen=True, eq=False)
class Ref:
    """An expression, its Spark type, the first round it can run in, its rough size, and the block
    it was made in: outside that block its value means nothing.

    ``made_of`` is the expression behind a helper column. ``adds_to`` is the value that this one
    equals in all rows outside its block.
    """

    col: Column
    dtype: str
    round: int = 0
    size: int = 1
    home: Block | None = None
    made_of: Ref | None = None
    adds_to: Ref | None = None


@dataclass(frozen=True, eq=False)
class Block:
    """Rows that a list of operators is for.

    ``top`` is the condition of the block that shares helper columns with the blocks it excludes,
    numbered by ``slot``; ``local`` narrows it further (or is the whole condition without a slot).
    """

    local: Ref | None
    top: Ref | None = None
    slot: tuple[int, int] | None = None


@dataclass
class Round:
    columns: dict[str, Column] = field(default_factory=dict)
    shared: dict[str, list[tuple[Column, Column]]] = field(default_factory=dict)
    steps: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)


@dataclass(frozen=True)
class Note:
    """One possible change of one field or tag, and the rows in which it happens."""

    kind: str
    name: str
    when: Ref | None


def flatten(df: DataFrame) -> DataFrame:
    """Turn struct columns into one flat column per leaf."""

    def walk(schema: T.StructType, names: list[str]):
        for f in schema.fields:
            here = [*names, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, here)
            else:
                yield ".".join(paths.quoted(n) for n in here), ".".join(here)

    if not any(isinstance(f.dataType, T.StructType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(src).alias(name) for src, name in walk(df.schema, [])])


OWN_VALUE = "_value"


def to_nested(df: DataFrame, drop_metadata: bool = True) -> DataFrame:
    """Build nested structs from the flat leaf columns, once, at the sink.

    A struct whose leaves are all NULL becomes NULL. ``@metadata`` working fields are left out.
    A scalar that is also the parent of other leaves is written as their neighbour ``_value``; in a row it is set or they
    are, not both.
    """
    tree: dict = {}
    for name in df.columns:
        node = tree
        names = name.split(".")
        if drop_metadata and names[0] == "@metadata":
            continue
        for part in names[:-1]:
            child = node.get(part)
            if not isinstance(child, dict):
                child = node[part] = {} if child is None else {OWN_VALUE: child}
            node = child
        if isinstance(node.get(names[-1]), dict):
            node[names[-1]][OWN_VALUE] = F.col(paths.quoted(name))
        else:
            node[names[-1]] = F.col(paths.quoted(name))

    def build(node: dict) -> tuple[Column, Column]:
        built = {k: build(v) if isinstance(v, dict) else (v, v.isNotNull()) for k, v in node.items()}
        present = None
        for _, there in built.values():
            present = there if present is None else present | there
        return F.when(present, F.struct(*[c.alias(k) for k, (c, _) in built.items()])), present

    return df.select(*[(build(v)[0] if isinstance(v, dict) else v).alias(k) for k, v in tree.items()])


NOTHING = Ref(F.lit, "void")
TagEdit = tuple[bool, str, "Ref | None"]


@dataclass
class Outcome:
    """What a block left behind: its rows, its fields, and all tag edits up to its end."""

    cond: Ref
    fields: dict[str, Ref]
    edits: list[TagEdit]


def common_type(kinds: set[str]) -> str:
    """A column has one type: text joins an array as one element, otherwise text is common to all."""
    if len(kinds) == 1:
        return next(iter(kinds))
    if STRING_ARRAY in kinds:
        return STRING_ARRAY
    return "double" if kinds == {"bigint", "double"} else "string"


class EventFrame:
    """Field path → current expression, over one DataFrame."""

    def __init__(self, df: DataFrame):
        self.df = flatten(df)
        self.fields: dict[str, Ref] = {
            name: Ref(F.col(paths.quoted(name)), dtype) for name, dtype in self.df.dtypes
        }
        self.block: Block | None = None
        self.notes: list[Note] | None = None
        self.recorder: Callable[[Callable], None] | None = None
        self._rounds: list[Round] = []
        self._bound: dict[int, tuple[Ref, Ref]] = {}
        self._keys: dict[int, tuple[Ref, Ref]] = {}
        self._slots: dict[tuple, int] = {}
        self._tag_edits: list[TagEdit] = []
        self._counter = 0
        self._row_tag: Ref | None = None

    def row_tag(self) -> Ref:
        """A number per row, made once from a column of the source, that lookups spread rows without a key by.

        It is all that a lookup reads besides its key, so what nobody selects is pruned behind lookups too.
        """
        if self._row_tag is None:
            name = self.new_column()
            self._round(0).columns[name] = source_tag(self.df)
            self._row_tag = Ref(F.col(name), "bigint", 1, 1)
        return self._row_tag

    def run(self, operator: Callable[[EventFrame], None]) -> None:
        """Apply an operator; under audit, single operators go through the recorder."""
        if self.recorder is None or getattr(operator, "is_block", False):
            operator(self)
        else:
            self.recorder(operator)

    # ---- expressions -------------------------------------------------------------------

    def literal(self, value, dtype: str) -> Ref:
        return Ref(F.lit(value).cast(dtype) if value is None else F.lit(value), dtype)

    def lift(
        self,
        fn: Callable[..., Column],
        *refs: Ref,
        dtype: str,
        cost: int = 1,
        limit: int = INLINE_LIMIT,
        repeat: int = REPEAT_LIMIT,
    ) -> Ref:
        """Apply ``fn`` to the expressions behind ``refs``, binding the ones too big to inline.

        Where ``fn`` reads its arguments often, a small ``repeat`` keeps it to helper columns.
        """
        ready = self._early([self.bind(r) if r.size > limit else r for r in refs], repeat)
        return Ref(
            fn(*[r.col for r in ready]),
            dtype,
            max((r.round for r in ready), default=0),
            cost + sum(r.size for r in ready),
            self.block,
        )

    def _early(self, refs: list[Ref], repeat: int = REPEAT_LIMIT) -> list[Ref]:
        """Repeat small expressions instead of reading their helper columns, if that saves a round."""
        last = max((r.round for r in refs), default=0)
        late = [r for r in refs if r.round == last]
        if any(r.made_of is None or r.made_of.size > repeat for r in late):
            return refs
        return [r.made_of if r.round == last else r for r in refs]

    def bind(self, ref: Ref) -> Ref:
        """Make ``ref`` a helper column, computed once however often it is read."""
        if ref.size <= 1:
            return ref
        known = self._bound.get(id(ref))
        if known is None:
            known = self._bound[id(ref)] = (ref, self._bind(ref))
        return known[1]

    def _bind(self, ref: Ref) -> Ref:
        """Lay out a helper column.

        A costly one holds a test that is always true but that the optimizer must not move, so a
        later filter on parsed fields reads the column instead of repeating its expression below.
        """
        home, parts = ref.home, [ref]
        heavy = ref.size > INLINE_LIMIT
        if home is not None and home.local is not None and heavy:
            parts.append(home.local)
        if home is not None and home.slot is not None:
            parts.append(home.top)
        if len(parts) > 1:
            guards = self._early(parts[1:]) if max(p.round for p in parts[1:]) > ref.round else parts[1:]
            parts = [ref, *guards]
        at = max(p.round for p in parts)
        expr = ref.col
        if heavy:
            once = F.spark_partition_id() >= 0
            if home is not None and home.local is not None:
                once = parts[1].col & once
            expr = F.when(once, expr)
        if home is None or home.slot is None:
            name = self.new_column()
            self._round(at).columns[name] = expr
            return Ref(F.col(name), ref.dtype, at + 1, 1, home, ref)
        group, case = home.slot
        place = (group, at, ref.dtype)
        index = self._slots.get((*place, case), 0)
        self._slots[(*place, case)] = index + 1
        number = self._slots.get((*place, "column", index))
        if number is None:
            number = self._slots[(*place, "column", index)] = self._next()
        name = f"__v{number}"
        self._round(at).shared.setdefault(name, []).append((parts[-1].col, expr))
        return Ref(F.col(name), ref.dtype, at + 1, 1, home, ref)

    def share(self, ref: Ref) -> Ref:
        """Bind an expression that is about to be read several times, unless it is trivial."""
        return self.bind(ref) if ref.size > SHARE_LIMIT else ref

    def add_step(self, inputs: list[Ref], step: Callable[..., DataFrame]) -> int:
        """Run ``step(df, *columns)`` once its inputs are ready; returns the round after it.

        The step must keep every row and every column it is given; it may add helper columns
        or remove rows for good (a filter).
        """
        ready = [self.bind(r) for r in inputs]
        at = max((r.round for r in ready), default=0)
        self._round(at).steps.append(lambda df: step(df, *[r.col for r in ready]))
        return at + 1

    def new_column(self) -> str:
        """Name for a helper column."""
        return f"__v{self._next()}"

    def _next(self) -> int:
        self._counter += 1
        return self._counter

    def _round(self, index: int) -> Round:
        while len(self._rounds) <= index:
            self._rounds.append(Round())
        return self._rounds[index]

    def address_key(self, text: Ref, make: Callable[[Column], Column]) -> Ref:
        """Hex key of an address field, shared by everything that reads the same value."""
        text = self.share(text)
        known = self._keys.get(id(text))
        if known is None:
            key = self.bind(replace(self.lift(make, text, dtype="string", cost=60, repeat=0), home=text.home))
            known = self._keys[id(text)] = (text, key)
        return known[1]

    # ---- blocks ------------------------------------------------------------------------

    def run_blocks(self, cases: list[tuple[Ref, list[Callable]]], disjoint: int) -> None:
        """Run operators for the rows of each condition; the first ``disjoint`` exclude each other."""
        outer = self.block
        apart, rest = cases[:disjoint], cases[disjoint:]
        group = self._next() if len(apart) > 1 and (outer is None or outer.slot is None) else None
        if apart:
            self._finish([self._inside(c, ops, group, i) for i, (c, ops) in enumerate(apart)])
        for cond, ops in rest:
            self._finish([self._inside(cond, ops, None, 0)])

    def _inside(self, cond: Ref, operators: list[Callable], group: int | None, index: int) -> Outcome:
        outer, fields, edits = self.block, self.fields, self._tag_edits
        if outer is None:
            whole = cond
        else:
            whole = self.share(self.both(outer.local, cond))
        if group is not None:
            self.block = Block(None, self.bind(whole), (group, index))
        elif outer is None:
            self.block = Block(whole)
        else:
            self.block = Block(whole, outer.top, outer.slot)
        self.fields, self._tag_edits = dict(fields), list(edits)
        for op in operators:
            self.run(op)
        out = Outcome(cond, self.fields, self._tag_edits)
        self.block, self.fields, self._tag_edits = outer, fields, edits
        return out

    def _finish(self, outcomes: list[Outcome]) -> None:
        """Fold what the blocks did into the map of the surrounding block."""
        base_edits = list(self._tag_edits)
        if any(o.fields.get(TAGS) is not self.fields.get(TAGS) for o in outcomes):
            # a block replaced the whole tag array: fold all edits into arrays first
            old = self.tags()
            for o in outcomes:
                full = self._folded_tags(o.fields.get(TAGS), o.edits)
                o.fields.pop(TAGS, None)
                if full is not None:
                    o.fields[TAGS] = full
                o.edits = []
            if old is not None:
                self.fields[TAGS] = old
            self._tag_edits = []
        else:
            for o in outcomes:
                for add, tag, cond in o.edits[len(base_edits):]:
                    self._tag_edits.append((add, tag, self.share(self.both(o.cond, cond))))
        names = dict.fromkeys([n for o in outcomes for n in o.fields] + list(self.fields))
        for name in names:
            old = self.fields.get(name)
            changed = [(o.cond, o.fields.get(name)) for o in outcomes if o.fields.get(name) is not old]
            if len(changed) == 1 and changed[0][1] is not None and changed[0][1].adds_to is (old or NOTHING):
                self.fields[name] = replace(changed[0][1], home=self.block, adds_to=None)
            elif changed:
                self.fields[name] = self._case(changed, old)

    def _case(self, changed: list[tuple[Ref, Ref | None]], old: Ref | None) -> Ref:
        kinds = {r.dtype for _, r in changed if r is not None} | ({old.dtype} if old is not None else set())
        dtype = common_type(kinds)
        conds = [self.share(c) for c, _ in changed]
        values = [
            self.literal(None, dtype) if v is None else self.to_type(v, dtype) for _, v in changed
        ]
        last = [] if old is None else [self.to_type(old, dtype)]

        def build(*cols: Column) -> Column:
            n = len(conds)
            out = F.when(cols[0], cols[n])
            for c, v in zip(cols[1:n], cols[n + 1 : 2 * n]):
                out = out.when(c, v)
            return out.otherwise(cols[2 * n]) if last else out

        return self.lift(build, *conds, *values, *last, dtype=dtype, limit=CHAIN_LIMIT)

    # ---- conditions --------------------------------------------------------------------

    def both(self, a: Ref | None, b: Ref | None) -> Ref | None:
        if a is None or b is None:
            return a or b
        return self.lift(lambda x, y: x & y, a, b, dtype="boolean")

    def guard(self, extra: Ref | None = None) -> Ref | None:
        """Condition for the rows of the current block, narrowed by ``extra``; None for every row."""
        if self.block is None:
            return extra
        return self.both(self.both(self.block.top, self.block.local), extra)

    def negate(self, cond: Ref) -> Ref:
        return self.lift(lambda c: ~c, cond, dtype="boolean")

    # ---- reading -----------------------------------------------------------------------

    def get(self, ref: str) -> Ref | None:
        """Expression for a field, or None if no row can have it.

        A path may reach into an array (by position) or into a parsed JSON value.
        """
        names = paths.parts(ref)
        for n in range(len(names), 0, -1):
            name, rest = ".".join(names[:n]), names[n:]
            if name == TAGS:
                found = self.tags()
            else:
                found = self.fields.get(name)
            if found is None:
                continue
            if not rest:
                return found
            if found.dtype.startswith("array<") and len(rest) == 1 and rest[0].isdigit():
                index = int(rest[0])
                return self.lift(lambda c: F.get(c, index), found, dtype=found.dtype[6:-1])
            if found.dtype == "variant":
                path = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in rest)
                return self.lift(
                    lambda c: F.try_variant_get(c, path, "string"), found, dtype="string", cost=3
                )
        return None

    def text(self, ref: str) -> Ref | None:
        """A field as text."""
        found = self.get(ref)
        return None if found is None else self.as_text(found)

    def as_text(self, ref: Ref) -> Ref:
        if ref.dtype == "string":
            return ref
        if ref.dtype.startswith("array<"):
            return self.lift(lambda c: F.array_join(c, ","), ref, dtype="string")
        if ref.dtype == "variant":
            return self.lift(F.to_json, ref, dtype="string")
        return self.lift(lambda c: c.cast("string"), ref, dtype="string")

    def children(self, ref: str) -> list[str]:
        prefix = paths.leaf(ref) + "."
        return [n for n in self.fields if n.startswith(prefix)]

    def exists(self, ref: str) -> Ref:
        """True where the field, or any leaf under it, has a value."""
        found = self.get(ref)
        present = [found] if found is not None else []
        present += [self.fields[n] for n in self.children(ref)]
        if not present:
            return self.literal(False, "boolean")

        def any_set(*cols: Column) -> Column:
            out = cols[0].isNotNull()
            for c in cols[1:]:
                out = out | c.isNotNull()
            return out

        return self.lift(any_set, *present, dtype="boolean")

    # ---- writing -----------------------------------------------------------------------

    def set(self, ref: str, value: Ref, when: Ref | None = None) -> None:
        """Write a field in all rows of the block, or those that meet ``when``."""
        name = paths.leaf(ref)
        if name == TAGS:
            self._settle_tags()
        if when is None:
            self.fields[name] = value
        else:
            self.fields[name] = self._case([(when, value)], self.fields.get(name))
        self._make_room(name, when)

    def put(self, ref: str, value: Ref, only_here: bool = False) -> None:
        """Write ``value`` where it is not NULL and keep the old value elsewhere.

        ``only_here`` tells that the value is NULL in rows outside the current block.
        """
        name = paths.leaf(ref)
        if name == TAGS:
            self._settle_tags()
        old = self.fields.get(name)
        own = only_here and self.block is not None and self.block.local is not None
        if old is None and own:
            value = replace(value, adds_to=NOTHING)
        elif old is not None:
            dtype = common_type({old.dtype, value.dtype})
            known = old.adds_to if old.adds_to is not None and old.home is self.block else old
            same = own and dtype == known.dtype
            value = self.lift(
                lambda v, o: F.coalesce(v, o), self.to_type(value, dtype), self.to_type(old, dtype),
                dtype=dtype, limit=CHAIN_LIMIT,
            )
            value = replace(value, adds_to=known if same else None)
        self.fields[name] = value
        if self._neighbours(name):
            self._make_room(name, self.lift(lambda v: v.isNotNull(), value, dtype="boolean"))

    def _neighbours(self, name: str) -> list[str]:
        """Fields that cannot hold a value next to this one: scalar parents and nested leaves."""
        names = name.split(".")
        above = [".".join(names[:n]) for n in range(1, len(names))]
        return [
            n for n in above if n in self.fields and self.fields[n].dtype != "variant"
        ] + self.children(name)

    def _make_room(self, name: str, when: Ref | None) -> None:
        for other in self._neighbours(name):
            self.remove_leaf(other, when)

    def to_type(self, ref: Ref, dtype: str) -> Ref:
        if ref.dtype == dtype:
            return ref
        if dtype == STRING_ARRAY:
            return self.as_array(ref)
        if dtype == "string":
            return self.as_text(ref)
        return self.lift(lambda c: c.cast(dtype), ref, dtype=dtype)

    def as_array(self, ref: Ref) -> Ref:
        if ref.dtype == STRING_ARRAY:
            return ref
        text = self.share(self.as_text(ref))
        return self.lift(lambda c: F.when(c.isNotNull(), F.array(c)), text, dtype=STRING_ARRAY)

    def remove_leaf(self, ref: str, when: Ref | None = None) -> None:
        """Remove a field but not what lies under it."""
        name = paths.leaf(ref)
        if name == TAGS:
            self._settle_tags()
        if name not in self.fields:
            return
        if when is None:
            del self.fields[name]
        else:
            self.fields[name] = self._case([(when, None)], self.fields[name])

    def remove(self, ref: str) -> None:
        """Remove a field and everything under it."""
        for name in [paths.leaf(ref), *self.children(ref)]:
            self.remove_leaf(name)

    def _settle_tags(self) -> None:
        now = self.tags()
        self._tag_edits = []
        if now is not None:
            self.fields[TAGS] = now

    # ---- tags --------------------------------------------------------------------------
    # Tag edits are kept as a list of (add?, tag, rows) and only folded into one array when the
    # array itself is read. Membership tests on a tag then need just the edits of that tag.

    def add_tag(self, tag: str, when: Ref | None = None) -> None:
        self._edit_tag(True, tag, when)

    def remove_tag(self, tag: str, when: Ref | None = None) -> None:
        self._edit_tag(False, tag, when)

    def _edit_tag(self, add: bool, tag: str, when: Ref | None) -> None:
        when = None if when is None else self.share(when)
        if self.notes is not None:
            there = self.has_tag(tag)
            kind = "tags_added" if add else "tags_removed"
            change = self.both(when, self.negate(there) if add else there)
            self.notes.append(Note(kind, tag, self.guard(change)))
        self._tag_edits.append((add, tag, when))

    def has_tag(self, tag: str) -> Ref:
        return self._tag_state(self.fields.get(TAGS), self._tag_edits, tag)

    def _tag_state(self, base: Ref | None, edits: list[TagEdit], tag: str) -> Ref:
        if base is None:
            state = self.literal(False, "boolean")
        else:
            state = self.lift(
                lambda c: F.coalesce(F.array_contains(c, tag), F.lit(False)),
                self.as_array(base),
                dtype="boolean",
                cost=3,
            )
        for add, name, cond in edits:
            if name != tag:
                continue
            if cond is None:
                state = self.literal(add, "boolean")
            elif add:
                state = self.lift(lambda s, c: s | c, state, cond, dtype="boolean", limit=CHAIN_LIMIT)
            else:
                state = self.lift(lambda s, c: s & ~c, state, cond, dtype="boolean", limit=CHAIN_LIMIT)
        return state

    def tags(self) -> Ref | None:
        """The tag array: tags kept from the input, then added ones in the order they were added."""
        return self._folded_tags(self.fields.get(TAGS), self._tag_edits)

    def _folded_tags(self, base: Ref | None, edits: list[TagEdit]) -> Ref | None:
        kept = None if base is None else self.as_array(base)
        if not edits:
            return kept
        added: list[Ref] = []
        for i, (add, tag, cond) in enumerate(edits):
            if not add:
                continue
            before = self._tag_state(base, edits[:i], tag)
            keep = self.both(cond, self.negate(before))
            for later_add, later_tag, later in edits[i + 1 :]:
                if not later_add and later_tag == tag:
                    keep = self.literal(False, "boolean") if later is None else self.both(
                        keep, self.negate(later)
                    )
            added.append(
                self.lift(lambda k, t=tag: F.when(k, F.lit(t)), keep, dtype="string", limit=CHAIN_LIMIT)
            )
        for add, tag, cond in edits:
            if add or kept is None:
                continue
            if cond is None:
                kept = self.lift(lambda b, t=tag: F.array_remove(b, t), kept, dtype=STRING_ARRAY)
            else:
                kept = self.lift(
                    lambda b, c, t=tag: F.when(c, F.array_remove(b, t)).otherwise(b),
                    self.share(kept), cond, dtype=STRING_ARRAY,
                )
        if not added:
            return kept
        # array_except drops the empty places; the places that are left hold different tags
        extra = self.bind(self.lift(
            lambda *cols: F.array_except(F.array(*cols), F.array(F.lit(None).cast("string"))),
            *added, dtype=STRING_ARRAY, limit=CHAIN_LIMIT,
        ))
        if kept is None:
            return self.lift(lambda e: F.when(F.size(e) > 0, e), extra, dtype=STRING_ARRAY)
        return self.lift(
            lambda k, e: F.when(
                k.isNotNull() | (F.size(e) > 0),
                F.concat(F.coalesce(k, F.array().cast(STRING_ARRAY)), e),
            ),
            self.bind(kept), extra, dtype=STRING_ARRAY,
        )

    # ---- audit -------------------------------------------------------------------------

    def note(self, kind: str, ref: str, when: Ref | None = None) -> None:
        """Record a field change for the audit of the running stage."""
        if self.notes is not None:
            self.notes.append(Note(kind, paths.bracketed(ref), self.guard(when)))

    # ---- result ------------------------------------------------------------------------

    def snapshot(self) -> Ref:
        """Every field that has a value, as a map from path to text."""
        named = [(n, self.as_text(r)) for n, r in self.fields.items() if n != TAGS]
        tags = self.tags()
        if tags is not None:
            named.append((TAGS, self.as_text(tags)))

        def build(*cols: Column) -> Column:
            pairs = [x for (n, _), c in zip(named, cols, strict=True) for x in (F.lit(n), c)]
            return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

        return self.lift(build, *[r for _, r in named], dtype="map<string,string>")

    def to_df(self, extra: dict[str, Ref] | None = None) -> DataFrame:
        """The DataFrame: rounds of helper columns and lookups, then one output projection."""
        out = dict(self.fields)
        final_tags = self.tags()
        if final_tags is not None:
            out[TAGS] = final_tags
        out.update(extra or {})
        df = self.df
        for r in self._rounds:
            columns = dict(r.columns)
            for name, cases in r.shared.items():
                made = F.when(*cases[0])
                for cond, value in cases[1:]:
                    made = made.when(cond, value)
                columns[name] = made
            if columns:
                df = df.select("*", *[c.alias(n) for n, c in columns.items()])
            for step in r.steps:
                df = step(df)
        return df.select(*[r.col.alias(name) for name, r in out.items()])
