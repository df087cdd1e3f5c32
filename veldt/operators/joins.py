"""Joins, with the strategy left to Catalyst or asked for by a hint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner", strategy: str | None = None) -> DataFrame:
    """strategy: hash (a shuffled hash join with the right side built), merge, broadcast, or
    None. Broadcast is for a side whose size has been checked. Conditions may be of any form:
    equalities become keys, the rest is tested on each match."""
    hints = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}
    side = right.hint(hints[strategy]) if strategy else right
    return left.join(side, on, KINDS[how])


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.crossJoin(right)


def natural(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.crossJoin(right)
    return left.join(right, shared, KINDS[how])


def null_safe(left: Column, right: Column) -> Column:
    """Equality for which NULL equals NULL."""
    return left.eqNullSafe(right)


SALT = "__veldt_salt"


def _salted(big: DataFrame, salts: int) -> DataFrame:
    """The salt depends on the row and its partition alone, so a stage that is run again after an
    executor was lost deals its rows as before."""
    hashed = [f.name for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    return big.withColumn(SALT, F.pmod(F.xxhash64(*hashed) + F.spark_partition_id(), F.lit(salts)).cast("int"))


def _copied(small: DataFrame, salts: int, name: str = SALT) -> DataFrame:
    """To be merged, never broadcast: Catalyst takes the size of ``small`` for that of all its
    copies, and the driver would gather them."""
    return small.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")


def or_join(left: DataFrame, right: DataFrame, arms: list[list[Column]], residual: Column | None = None, how: str = "inner", salts: list[int] | None = None) -> DataFrame:
    """Join on (a1 AND a2 ...) OR (b1 AND ...) OR ..., each arm with an equality, as a union of
    equi-joins: Spark would take a nested loop over all pairs.

    Arm i takes the pairs that no earlier arm has taken, so the arms are disjoint and rows
    keep their multiplicity without row ids. An earlier arm that is NULL for a pair hasn't
    taken it. LEFT adds the rows without a match by one anti join for each arm.

    salts: for each arm, to how many tasks left's rows of one key are dealt, as in spread_join; 1
    leaves the arm to Catalyst. It is for keys of few values: their pairs grow with the square of
    the rows, and else meet in one task a key, or one a file where right is broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError("an or_join is inner or left")
    if salts is not None and len(salts) != len(arms):
        raise ValueError("each arm has its salts")

    def meet(own: DataFrame, n: int, on: Column, kind: str) -> DataFrame:
        if n == 1:
            return own.join(right, on, kind)
        other = f"{SALT}_copy"
        return _salted(own, n).join(_copied(right, n, other), on & (F.col(SALT) == F.col(other)), kind).drop(SALT, other)

    conditions = [reduce(lambda a, b: a & b, arm) for arm in arms]
    rest = residual if residual is not None else F.lit(True)
    salts = salts or [1] * len(arms)
    parts = []
    for i, (own, n) in enumerate(zip(conditions, salts, strict=True)):
        free = [~F.coalesce(other, F.lit(False)) for other in conditions[:i]]
        parts.append(meet(left, n, reduce(lambda a, b: a & b, [own, *free, rest]), "inner"))
    matched = reduce(DataFrame.unionAll, parts)
    if how == "inner":
        return matched
    alone = left
    for own, n in zip(conditions, salts, strict=True):
        alone = meet(alone, n, own & rest, "left_anti")
    fill = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields]
    return matched.unionAll(alone.select("*", *fill))


def not_in(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """left's rows whose column is NOT IN right's, as in SQL: no rows if right holds a NULL, all
    if it is empty, and else those whose value isn't NULL and isn't there.

    Spark's own NOT IN broadcasts the right side whatever its size. Here the sides meet in an
    anti join of any strategy; only one row of counts is broadcast.
    """
    values = right.select(F.col(right_col).alias("__value"))
    facts = values.agg(F.count(F.lit(1)).alias("__n"), F.count("__value").alias("__k"))
    own = F.col(left_col)
    rest = left.join(values.where("__value IS NOT NULL").distinct(), own == F.col("__value"), "left_anti")
    return rest.join(F.broadcast(facts), (F.col("__n") == 0) | ((F.col("__n") == F.col("__k")) & own.isNotNull())).select(*(rest[c] for c in left.columns))


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join in which each key of ``big`` is dealt to ``salts`` tasks and ``small`` is
    copied to all of them: for a key that holds much of the rows, where AQE can't split it.
    """
    if how not in ("inner", "left", "semi", "anti"):
        raise ValueError("the salted side must be the one that is kept")
    return _salted(big, salts).join(_copied(small, salts), [*keys, SALT], KINDS[how]).drop(SALT)
