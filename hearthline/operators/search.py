"""Constraint search over a table of facts: pass, fail or unknown for each constraint, reasons, ranking and relaxation.

Constraints are a driver-side list and become columns; the data is read once whatever their number. The reason of a row that
is left out is its first failing required constraint, in list order.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraint:
    key: str
    column: str
    value: Any
    required: bool = True
    weight: float = 3.0

    def state(self) -> Column:
        c, v = F.col(self.column), self.value
        test = {
            "max": lambda: c <= v + 1e-9, "min": lambda: c >= v, "range": lambda: (c >= v[0]) & (c < v[1]), "between": lambda: (c >= v[0]) & (c <= v[1]),
            "in": lambda: c.isin(list(v)), "not_in": lambda: ~c.isin(list(v)),
        }[self.key]()
        return F.when(c.isNull(), "unknown").when(test, "pass").otherwise("fail")

    def relaxed(self) -> Constraint | None:
        """The constraint one notch looser; None: left out."""
        v = self.value
        if self.key == "max":
            return replace(self, value=round(v * 1.1, 1))
        if self.key == "min":
            return replace(self, value=round(v * 0.7))
        if self.key == "between":
            return replace(self, value=(v[0] - 15, v[1] + 15))
        return None


def evaluate(facts: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """facts and: result (ok, unsure, excluded), reason, misses, score."""
    required = [c for c in constraints if c.required]
    states = F.array(*[F.struct(F.lit(f"{c.key}:{c.column}").alias("name"), c.state().alias("state")) for c in required]) if required else F.array()
    score = sum((F.when(c.state() == "pass", c.weight).when(c.state() == "fail", -c.weight).otherwise(0.0) for c in constraints if not c.required), F.lit(0.0))
    has = lambda s: F.exists("states", lambda x: x["state"] == s)
    fails = F.filter("states", lambda x: x["state"] == "fail")
    out = facts.withColumn("states", states).withColumn("score", score)
    return out.withColumns({
        "result": F.when(has("fail"), "excluded").when(has("unknown"), "unsure").otherwise("ok"),
        "reason": F.get(fails, F.lit(0))["name"], "misses": F.size(fails),
    }).drop("states")


def exclusion_reasons(found: DataFrame) -> DataFrame:
    return found.where("result = 'excluded'").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def relaxation_counts(facts: DataFrame, constraints: list[Constraint], key: str, most: int = 6) -> DataFrame:
    """relaxed, n: different keys left if one required constraint is loosened; only those with any. One pass over facts."""
    required = [c for c in constraints if c.required]
    options = []
    for i, c in enumerate(required):
        loose = c.relaxed()
        others = [x.state() != "fail" for j, x in enumerate(required) if j != i] + ([loose.state() != "fail"] if loose else [])
        options.append((f"{c.key}:{c.column}", sum((o.cast("int") for o in others), F.lit(0)) == len(others)))
    counts = facts.agg(*[F.count_distinct(F.when(ok, F.col(key))).alias(f"n{i}") for i, (_, ok) in enumerate(options)])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(name).alias("relaxed"), F.col(f"n{i}").alias("n")) for i, (name, _) in enumerate(options)])).alias("o"))
    return rows.select("o.*").where("n > 0").orderBy("i").limit(most).drop("i")


def closest_misses(found: DataFrame, group: str, order: list[Column], n: int = 3) -> DataFrame:
    """The n excluded groups with the fewest failing constraints, one row a group. order must be total."""
    keys = F.struct("misses", *order)
    best = found.where("result = 'excluded'").groupBy(group).agg(F.min_by(F.struct("*"), keys).alias("r"))
    return best.select("r.*").orderBy("misses", *order).limit(n)


def perspectives(found: DataFrame, by: dict[str, tuple[str, Column]], key: str) -> DataFrame:
    """view, key: the first row under each of several orders, in one aggregate. by: view -> (min or max, order)."""
    pick = {"min": F.min_by, "max": F.max_by}
    row = found.agg(*[pick[how](key, order).alias(view) for view, (how, order) in by.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("key")) for v in by])).alias("o")).select("o.*")
