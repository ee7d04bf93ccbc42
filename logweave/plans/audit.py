"""Change tracking: snapshot differences, and totals over audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.frame import flatten
from logweave.paths import quoted
from logweave.pipeline import KINDS


def map_diff(before: Column, after: Column) -> Column:
    """Keys added, modified and removed between two maps of field to text."""
    old, new = F.map_keys(before), F.map_keys(after)
    kept = F.array_intersect(new, old)
    return F.struct(
        F.array_sort(F.array_except(new, old)).alias("added"),
        F.array_sort(F.filter(kept, lambda k: ~before[k].eqNullSafe(after[k]))).alias("modified"),
        F.array_sort(F.array_except(old, new)).alias("removed"),
    )


def leaves(value: Column, path: str | Column, depth: int) -> Column:
    """The leaves of a variant as entries of path and JSON text; objects more than ``depth`` levels down count as leaves.

    Members of an array are no paths of their own: arrays are compared whole.
    """
    path = F.lit(path) if isinstance(path, str) else path
    whole = F.array(F.struct(path.alias("key"), F.to_json(value).alias("value")))
    if depth == 0:
        return whole
    members = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
    below = F.flatten(F.transform(members, lambda e: leaves(e["value"], F.concat(path, F.lit("."), e["key"]), depth - 1)))
    return F.when(F.size(members) > 0, below).otherwise(whole)


def nested_diff(before: Column, after: Column, name: str, depth: int = 4) -> Column:
    """Paths added, modified and removed between two variants, below ``name``; a missing value has no paths."""

    def flat(value: Column) -> Column:
        none = F.create_map().cast("map<string,string>")
        return F.when(value.isNotNull(), F.map_from_entries(leaves(value, name, depth))).otherwise(none)

    return map_diff(flat(before), flat(after))


def row_diff(before: DataFrame, after: DataFrame, keys: list[str], depth: int = 0) -> DataFrame:
    """Per key: the fields added, modified and removed between two versions of a table.

    The versions are joined on their unique ``keys``; a row missing on one side has no fields there. With ``depth`` fields
    that are variants or maps are compared leaf by leaf, that many levels down.
    """

    def packed(df: DataFrame, name: str) -> DataFrame:
        flat = flatten(df)
        kinds = dict(flat.dtypes)
        nested = [c for c in flat.columns if depth and c not in keys and kinds[c].startswith(("variant", "map<"))]
        body = [c for c in flat.columns if c not in keys and c not in nested]
        pairs = [x for c in body for x in (F.lit(c), _text(flat, c))]
        parts = [F.create_map(*pairs).cast("map<string,string>")]
        for c in nested:
            value = F.col(quoted(c)) if kinds[c] == "variant" else F.parse_json(F.to_json(quoted(c)))
            parts.append(F.when(value.isNotNull(), F.map_from_entries(leaves(value, c, depth))).otherwise(F.create_map().cast("map<string,string>")))
        return flat.select(*keys, F.map_filter(F.map_concat(*parts), lambda k, v: v.isNotNull()).alias(name))

    empty = F.create_map().cast("map<string,string>")
    both = packed(before, "old").join(packed(after, "new"), keys, "full")
    diff = map_diff(F.coalesce("old", empty), F.coalesce("new", empty))
    return both.select(*keys, diff.alias("diff")).select(*keys, "diff.*")


def _text(df: DataFrame, name: str) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(quoted(name))
    return F.to_json(c) if kind.startswith(("array", "map", "variant")) else c.cast("string")


def change_totals(audited: DataFrame, by: str = "stage") -> DataFrame:
    """Numbers of added, modified and removed fields and tags, per stage and in all."""
    steps = audited.select(F.explode("audit").alias("step"))
    sizes = [F.sum(F.size(f"step.{k}")).alias(k) for k in KINDS]
    return steps.rollup(F.col(f"step.{by}").alias(by)).agg(*sizes)


def run_summary(audited: DataFrame) -> DataFrame:
    """Per run: stages, operators run, operators that did not fail, and distinct fields with a value."""
    body = [c for c in audited.columns if c != "audit"]
    filled = [F.max(F.col(quoted(c)).isNotNull().cast("int")) for c in body]
    total = filled[0]
    for c in filled[1:]:
        total = total + c
    ran = F.filter("audit", lambda s: s["executed"])
    return audited.agg(
        F.max(F.size(F.array_distinct(F.transform("audit", lambda s: s["stage"])))).alias("stages"),
        F.sum(F.size(ran)).alias("steps"),
        F.sum(F.size(F.filter(ran, lambda s: s["changes"] != "Error"))).alias("successful_steps"),
        total.cast("bigint").alias("fields"),
    )


def candidate_count(payloads: DataFrame) -> DataFrame:
    """How many payloads were kept."""
    return payloads.agg(F.count("*").alias("candidates"))
