"""Networks as one sorted list of intervals: the longest network of each of several tables by a single join."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.frame import EventFrame, Ref
from logweave.functions.shared import shared_table
from logweave.operators.lookup import Lookup, NetworkTable, block_of, find_row, join_row

PAGE = 256
"""Intervals of one page at most; a page is one row of the join."""
_START, _AFTER = " ", "~"
"""End the key of a place at an address and right after it; one sorts before all hex digits, the other behind them."""
_WIDTHS = {"4": 10, "6": 34}
"""Length of a key by its first letter, the family."""


def _key(address: Column, end: str | Column = _START) -> Column:
    """Sort key of a place: family, address in hex, and whether it is at the address or after it."""
    return F.concat(F.when(F.length(address) == 8, "4").otherwise("6"), address, F.lit(end) if isinstance(end, str) else end)


def last_not_after(at: Callable[[Column], Column], key: Column, count: int) -> Column:
    """Index (from 0) of the last of ``count`` sorted keys that is not greater, by halving steps; -1 if there is none.

    ``at`` gives the key of an index, NULL beyond the last.
    """
    steps = F.array(*(F.lit(1 << n) for n in range(max(count, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(-1), lambda i, step: F.when(at(i + step) <= key, i + step).otherwise(i))


class IntervalTable:
    """Nested networks of one or more tables, flattened when built to intervals that do not overlap.

    The intervals begin where a network begins or right after one ends; each holds the attributes of the longest network
    of every table there, so a table of places and one of owners cost one join together. Intervals are sorted and cut into
    pages of ``page``; an address finds its page by halving steps in the list of the pages' first keys, then its
    interval in the page in the same way. So there is one join, whatever prefix lengths the tables hold.

    Building joins the table's own places to the blocks of ``NetworkTable`` and is written once to ``path``, or to the
    session's shared folder; ``read`` takes a table that was built before. The list of first keys is a constant of the
    plan: one key of 10 or 34 bytes for each page and 16-bit block, about a megabyte for ten million networks.
    """

    def __init__(self, *tables: NetworkTable, page: int = PAGE, path: str | None = None, size: int | None = None):
        self.attributes = [a for t in tables for a in t.attributes]
        if len({a.lower() for a in self.attributes}) < len(self.attributes):
            raise ValueError("tables of one list of intervals need attributes of different names")
        self._tables, self._page, self._path, self._size = tables, page, path, size
        self._read: DataFrame | None = None

    @classmethod
    def read(cls, pages: DataFrame, size: int | None = None) -> IntervalTable:
        """A table of pages that was built before."""
        made = cls(size=size)
        made._read = pages
        kind = pages.schema["values"].dataType.elementType
        made.attributes = kind.fieldNames()
        return made

    def intervals(self) -> DataFrame:
        """A row for each interval: ``key`` of its first place, and ``value``, NULL where no network is."""
        places = None
        packed = [shared_table(t.packed) for t in self._tables]
        for t in self._tables:
            n = t.networks.select("low", "high")
            mine = n.select(F.col("low").alias("at"), F.lit(False).alias("after")).union(n.select("high", F.lit(True)))
            places = mine if places is None else places.union(mine)
        places = places.distinct()
        found = []
        for i, t in enumerate(self._tables):
            tiers = sorted((r.tier for r in packed[i].select("tier").distinct().collect()), reverse=True)
            for tier in tiers:
                right = packed[i].filter(F.col("tier") == tier).select(F.col("key").alias(f"__k{i}_{tier}"), F.col("nets").alias(f"__n{i}_{tier}"))
                places = places.join(right, block_of(F.col("at"), tier) == F.col(f"__k{i}_{tier}"), "left")
            rows = [
                find_row(F.col(f"__n{i}_{tier}"), lambda n: (n["low"] <= F.col("at")) & (
                    (n["high"] > F.col("at")) | ((n["high"] == F.col("at")) & ~F.col("after"))
                )) for tier in tiers
            ]
            found.append(F.coalesce(*rows) if rows else None)
        values = [
            (F.lit(None).cast(t.networks.schema[a].dataType) if row is None else row[a]).alias(a)
            for t, row in zip(self._tables, found, strict=True) for a in t.attributes
        ]
        there = F.lit(False)
        for row in found:
            there = there if row is None else there | row.isNotNull()
        key = _key(F.col("at"), F.when(F.col("after"), _AFTER).otherwise(_START))
        return places.select(key.alias("key"), F.when(there, F.struct(*values)).alias("value"))

    @cached_property
    def pages(self) -> DataFrame:
        """``first`` (key of the first interval), ``keys`` and ``values`` of the intervals of a page."""
        if self._read is not None:
            return self._read
        block = F.substring("key", 1, 5)
        order = Window.partitionBy("block").orderBy("key")
        numbered = self.intervals().withColumn("block", block).withColumn("page", F.floor((F.row_number().over(order) - 1) / self._page))
        each = F.array_sort(F.collect_list(F.struct("key", "value")))
        pages = numbered.groupBy("block", "page").agg(F.min("key").alias("first"), each.alias("each"))
        return shared_table(pages.select("first", F.col("each.key").alias("keys"), F.col("each.value").alias("values")), self._path)

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.pages, "first", ["keys", "values"], size=self._size, unique=True)

    @cached_property
    def firsts(self) -> dict[str, bytes]:
        """The first keys of all pages, sorted, by family."""
        found = sorted(r.first for r in self.pages.select("first").collect())
        return {family: "".join(k for k in found if k[0] == family).encode() for family in _WIDTHS}

    def find(self, f: EventFrame, key: Ref) -> Ref:
        """The attributes at an address key, as a struct; NULL where no network is."""

        def page(k: Column) -> Column:
            out = None
            for family, width in _WIDTHS.items():
                listed = self.firsts[family]
                if not listed:
                    continue

                def at(i: Column, listed=F.lit(listed), width=width) -> Column:
                    found = F.substring(listed, i * width + 1, F.lit(width))
                    return F.when(F.length(found) > 0, found)

                mine = last_not_after(at, _key(k).cast("binary"), len(listed) // width)
                first = F.nullif(F.substring(F.lit(listed), mine * width + 1, F.lit(width)).cast("string"), F.lit(""))
                test = (F.length(k) == (8 if family == "4" else 32)) & (mine >= 0)
                out = F.when(test, first) if out is None else out.when(test, first)
            return F.lit(None).cast("string") if out is None else out

        row = join_row(f, self.lookup, f.lift(page, key, dtype="string", cost=60, repeat=0))

        def pick(r: Column, k: Column) -> Column:
            return F.get(r["values"], last_not_after(lambda i: F.get(r["keys"], i), _key(k), self._page))

        return f.bind(f.lift(pick, row, key, dtype="struct", cost=60, repeat=0))
