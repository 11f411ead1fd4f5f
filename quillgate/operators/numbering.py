"""Places of rows within groups, without a task that holds a whole group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks into which the order is cut, as coarse times fine ones; a group's blocks, not its rows, meet in one task.
COARSE, FINE = 32, 32


def order_bounds(df: DataFrame, order: str) -> list[float]:
    """Values that cut `order` into COARSE * FINE blocks of about as many rows, however its values lie."""
    n = COARSE * FINE
    found = df.approxQuantile(order, [i / n for i in range(1, n)], 1 / (8 * n))
    return sorted(set(found))


def _block(order: str, bounds: list[float]) -> Column:
    """The number of bounds that a value reaches: among every FINE-th one first, then among those that follow."""
    rows = [bounds[i : i + FINE] for i in range(0, len(bounds), FINE)]
    if not rows:
        return F.lit(0)
    lead = F.array(*[F.lit(float(r[0])) for r in rows])
    table = F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    value = F.col(order).cast("double")
    at = F.size(F.filter(lead, lambda x: x <= value))
    within = F.size(F.filter(F.coalesce(F.get(table, at - 1), F.array().cast("array<double>")), lambda x: x <= value))
    return F.when(F.col(order).isNotNull(), F.when(at == 0, 0).otherwise((at - 1) * FINE + within)).cast("int")


def number_within(df: DataFrame, keys: list[str], order: str, out: str = "nth", first: str | None = None, bounds: list[float] | None = None) -> DataFrame:
    """df with `out`, each row's 1-based place by the number `order` among the rows of equal keys, and `first`,
    the smallest order of the group, if named.

    Rows are ranked in blocks of the order that hold about as many rows each, whether ids are dense, sparse or hashes;
    the rows before a block come from the blocks' counts.  The bounds are found by a pass over df's order unless given.
    Null keys are one group, null orders come first, equal orders get places in no stated order, an empty table stays
    empty.
    """
    columns = df.columns
    cut = _block(order, order_bounds(df, order) if bounds is None else bounds)
    rows = df.withColumn("__block", cut).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys, "__block").orderBy(order)))
    counts = df.groupBy(*keys, cut.alias("__b")).agg(F.count("*").alias("__n"), F.min(order).alias("__least"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        "__b",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"),
        F.min("__least").over(group).alias("__of_group"),
    )
    on: list[Column] = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__block").eqNullSafe(F.col("__b"))]
    joined = rows.join(starts, reduce(lambda a, b: a & b, on))
    place = (F.col("__start") + F.col("__rank")).cast("long").alias(out)
    return joined.select(*columns, place, *([F.col("__of_group").alias(first)] if first else []))
