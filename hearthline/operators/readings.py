"""Several readings of one text merged through their schema.

Readings of the same notice by several tools are rows with one struct of terms. The merge is made from that struct's schema: a scalar is voted on (all that
are known agree, or most of them do; else it is null and a conflict), an array is the union of what was read in the order of the tools, a member whose name is in `either` is true if any tool
found it, a struct is merged member by member, and an array of structs with a key (tiers) is matched by key and each element voted on as a whole, since halves of two readings may not fit
each other. What is decided otherwise than by agreement is logged with its path. A second rendition fills what is missing, or is compared, by the same walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StructType

LOG = "array<struct<path: string, how: string>>"
AGREED, FILLED, MAJORITY, CONFLICT, UNION, EITHER = "agreed", "filled", "majority", "conflict", "union", "either"


def vote(values: Column) -> Column:
    """struct(value, how) of an array of readings, null for what a tool didn't read."""
    known = F.filter(values, lambda v: v.isNotNull())
    different = F.array_distinct(known)
    counted = F.transform(different, lambda d: F.struct(F.size(F.filter(known, lambda v: v.eqNullSafe(d))).alias("n"), d.alias("value")))
    most = F.array_max(F.transform(counted, lambda c: c["n"]))
    leaders = F.filter(counted, lambda c: c["n"] == most)
    how = (
        F.when(F.size(different) == 1, F.when(F.size(known) == F.size(values), AGREED).otherwise(FILLED)).when(F.size(known) == 0, AGREED)
        .when((most >= 2) & (F.size(leaders) == 1), MAJORITY).otherwise(CONFLICT)
    )
    value = F.when(F.size(different) == 1, F.get(different, F.lit(0))).when((most >= 2) & (F.size(leaders) == 1), F.get(leaders, F.lit(0))["value"])
    return F.struct(value.alias("value"), how.alias("how"))


def _member_of(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: v[name])


class _Walk:
    """Merges a member, and collects the log's entries. either: names of truths that one tool is enough for; keys: of arrays of structs, by name, the member that tells elements apart."""

    def __init__(self, either: set[str], keys: dict[str, str]):
        self.either, self.keys = either, keys
        self.single: list[Column] = []
        self.lists: list[Column] = []

    def merged(self, values: Column, kind: DataType, path: str) -> Column:
        """values: array of a member's readings in the order of the tools."""
        name = path.rsplit(".", 1)[-1]
        if isinstance(kind, StructType):
            return F.struct(*[self.merged(_member_of(values, f.name), f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields])
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and name in self.keys:
            return self._by_key(values, path, self.keys[name])
        if isinstance(kind, ArrayType):
            known = F.filter(values, lambda v: v.isNotNull())
            self.log(path, F.when(F.size(F.array_distinct(known)) > 1, UNION).otherwise(AGREED), (UNION,))
            return F.when(F.size(known) > 0, F.array_distinct(F.flatten(known)))
        if isinstance(kind, BooleanType) and name in self.either:
            found = F.exists(values, lambda v: F.coalesce(v, F.lit(False)))
            self.log(path, F.when(found & ~F.forall(values, lambda v: F.coalesce(v, F.lit(False))), EITHER).otherwise(AGREED), (EITHER,))
            return F.when(found, True).when(F.exists(values, lambda v: v.isNotNull()), False)
        voted = vote(values)
        self.log(path, voted["how"], (FILLED, MAJORITY, CONFLICT))
        return voted["value"]

    def _by_key(self, values: Column, path: str, key: str) -> Column:
        """Elements by key: each key that a tool read, with the vote on the elements that have it."""
        readings = F.transform(values, lambda v: F.coalesce(v, F.slice(v, 1, 0)))
        every = F.array_distinct(F.flatten(F.transform(F.filter(readings, lambda v: v.isNotNull()), lambda v: F.transform(v, lambda e: e[key]))))
        own = lambda k: F.transform(readings, lambda v: F.get(F.filter(v, lambda e: e[key].eqNullSafe(k)), F.lit(0)))
        voted = F.transform(every, lambda k: F.struct(k.alias("key"), vote(own(k)).alias("r")))
        entry = lambda x: F.struct(F.concat(F.lit(f"{path}["), F.coalesce(x["key"].cast("string"), F.lit("")), F.lit("]")).alias("path"), x["r"]["how"].alias("how"))
        self.lists.append(F.transform(F.filter(voted, lambda x: x["r"]["how"] != AGREED), entry))
        return F.when(F.exists(values, lambda v: v.isNotNull()), F.transform(F.filter(voted, lambda x: x["r"]["value"].isNotNull()), lambda x: x["r"]["value"]))

    def log(self, path: str, how: Column, only: tuple[str, ...]) -> None:
        self.single.append(F.when(how.isin(*only), F.struct(F.lit(path).alias("path"), how.alias("how"))))

    def entries(self) -> Column:
        single = F.filter(F.array(*self.single), lambda x: x.isNotNull()) if self.single else F.array().cast(LOG)
        return F.concat(single, *[F.coalesce(x, F.array().cast(LOG)) for x in self.lists])


def merge(readings: DataFrame, key: str, tool: str, terms: str, tools: list[str], either: tuple[str, ...] = (), keys: dict[str, str] | None = None) -> DataFrame:
    """key, terms, log: one row for each key. tools: in the order in which what they read is listed; a tool that hasn't read a key has unknown terms."""
    kind = readings.schema[terms].dataType
    assert isinstance(kind, StructType)
    one = [F.first(F.when(F.col(tool) == t, F.col(terms)), ignorenulls=True).alias(f"__{i}") for i, t in enumerate(tools)]
    side = readings.groupBy(key).agg(*one).select(key, F.array(*[F.col(f"__{i}") for i in range(len(tools))]).alias("__r"))
    walk = _Walk(set(either), keys or {})
    members = [walk.merged(_member_of(F.col("__r"), f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]
    return side.select(key, F.struct(*members).alias(terms), walk.entries().alias("log"))


def _leaves(kind: StructType, path: tuple[str, ...] = ()) -> Iterator[tuple[str, ...]]:
    for f in kind.fields:
        if isinstance(f.dataType, StructType):
            yield from _leaves(f.dataType, (*path, f.name))
        else:
            yield (*path, f.name)


def filled(first: Column, second: Column, kind: StructType) -> Column:
    """first with what it hasn't from second: leaves that are null, never others."""
    def member(a: Column, b: Column, k: DataType) -> Column:
        return F.struct(*[member(a[f.name], b[f.name], f.dataType).alias(f.name) for f in k.fields]) if isinstance(k, StructType) else F.coalesce(a, b)

    return member(first, second, kind)


def differing(first: Column, second: Column, kind: StructType) -> Column:
    """Paths of the leaves that both have and that differ."""
    of = lambda c, path: reduce(lambda x, n: x[n], path, c)
    return F.array_compact(F.array(*[F.when(of(first, p) != of(second, p), ".".join(p)) for p in _leaves(kind)]))
