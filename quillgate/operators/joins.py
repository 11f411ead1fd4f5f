"""Joins that a very frequent key does not bring down."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is hot; there are fewer hot keys than its inverse.
HOT_KEYS = 1000


def equal_keys(keys: list[str], names: list[str]) -> Column:
    """Null-safe equality of the columns `keys` of one side with `names` of the other."""
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """rows with the columns of the group of their keys; nulls are equal.  `groups` has each combination of keys once,
    and in `weight` the number of rows that have it.

    Groups of more than a thousandth of all rows, fewer than HOT_KEYS, are broadcast to their rows; the others meet
    theirs by a shuffle.  A row belongs to one of the two joins by whether its key is among the hot ones.
    """
    names = [f"__g{i}" for i in range(len(keys))]
    table = groups.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in groups.columns if c not in keys])
    limit = groups.agg(F.greatest(F.floor(F.sum(weight) / HOT_KEYS), F.lit(1))).scalar()
    hot, cold = table.filter(F.col(weight) > limit), table.filter(F.col(weight) <= limit)
    on = equal_keys(keys, names)
    first = rows.join(F.broadcast(hot), on, "inner").drop(*names)
    rest = rows.join(F.broadcast(hot.select(*names)), on, "left_anti").join(cold, on, how).drop(*names)
    return first.unionByName(rest)
