"""Operator 3: mixing sources to target weights by entropy balancing.

Every word of the corpus is a unit; the mix is the one nearest to the corpus in relative entropy whose words
meet the token constraints (one for each value of each margin column).  Its dual is convex and smooth, and its
solution tilts each document's rate exponentially: exp(sum of the multipliers of its margins).  Newton steps
find the multipliers; each step's gradient and Hessian are sums over the corpus made by Spark.  Rates then
become whole copies, largest documents first, so that what rounding takes or leaves over cancels out.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, look_up, prepare

# Weights by rank of the source, the most copies of a document, words.
WEIGHTS, MOST, WORD = (1, 2, 3), 3, r"[^\x20\x09-\x0D]+"
#: Documents that round together; bounds a task's memory, however large a source is.
ROUND_TOGETHER = 1024
STEPS, NEAR = 60, 1e-10


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key(c: Column) -> Column:
    """A text for each value, null apart from all others."""
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), c.cast("string")))


def targets(sizes: dict[str, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> dict[str, float]:
    """Shares of all words by source key (code point order, null last, weights repeating); a target stops at
    `most` times its source's size, and the excess is shared again by weight until none is above."""
    order = sorted(k for k in sizes if k != "n") + [k for k in sizes if k == "n"]
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        unit = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if unit * weight[k] > most * sizes[k]]
        if not full:
            out |= {k: unit * weight[k] for k in open_}
            break
        for k in full:
            out[k] = float(most * sizes[k])
            left -= out[k]
        left, open_ = max(left, 0.0), [k for k in open_ if k not in out]
    return out


def balance(cells: DataFrame, margins: list[str], size: str, goals: list[dict[str, float]]) -> list[dict[str, float]]:
    """Multipliers of each margin's values.  `cells` has one row for each combination of margin values, with
    its words.  A goal of 0 has the multiplier -inf.  Each Newton step sums gradient and Hessian over the cells
    in Spark; the driver holds one number for each constraint (and, with several margins, for each pair)."""
    spark = cells.sparkSession
    index = {(m, k): i for i, (m, k) in enumerate((m, k) for m, g in enumerate(goals) for k, t in g.items() if t > 0)}
    want = np.array([goals[m][k] for m, k in index])
    lam = np.zeros(len(index))
    for _ in range(STEPS):
        rows = cells
        for m, name in enumerate(margins):
            now = [(k, float(lam[index[m, k]]), index[m, k]) for k in goals[m] if (m, k) in index]
            part = spark.createDataFrame(now, f"`{name}` string, __l{m} double, __i{m} int") if now else spark.createDataFrame([], f"`{name}` string, __l{m} double, __i{m} int")
            rows = look_up(rows, part, [name], len(now), "inner")
        tilt = F.exp(sum((F.col(f"__l{m}") for m in range(1, len(margins))), F.col("__l0")))
        mass = rows.withColumn("__w", F.col(size) * tilt)
        gradient, hessian = -want, np.zeros((len(index),) * 2) if len(margins) > 1 else np.zeros(len(index))
        for a in range(len(margins)):
            for i, w in mass.groupBy(f"__i{a}").agg(F.sum("__w")).collect():
                gradient[i] += w
                if len(margins) > 1:
                    hessian[i, i] += w
                else:
                    hessian[i] += w
            for b in range(a):
                for i, j, w in mass.groupBy(f"__i{a}", f"__i{b}").agg(F.sum("__w")).collect():
                    hessian[i, j] += w
                    hessian[j, i] += w
        if not len(index) or np.all(np.abs(gradient) <= NEAR * np.maximum(want, 1)):
            break
        # Margins share one degree of freedom, so the least-squares step; long steps are cut for safety.
        step = gradient / np.maximum(hessian, 1e-300) if hessian.ndim == 1 else np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
        lam -= np.clip(step, -2.0, 2.0)
    else:
        warnings.warn(f"entropy balancing stopped after {STEPS} steps, off by {np.abs(gradient).max():.3g} words: the margins may contradict each other", stacklevel=2)
    return [{k: float(lam[index[m, k]]) if (m, k) in index else -math.inf for k in g} for m, g in enumerate(goals)]


def round_rates(size: np.ndarray, rate: np.ndarray, most: int = MOST) -> np.ndarray:
    """Whole copies, each rate rounded down or up, so that the words taken stay near the words wanted."""
    low = np.minimum(np.floor(rate + 1e-9), most).astype(np.int64)
    part = np.clip(rate - low, 0.0, 1.0)
    part[part < 1e-9] = 0.0
    copies, ahead = low.copy(), 0.0
    for i in np.argsort(-size, kind="stable").tolist():
        if part[i] and low[i] < most:
            up = abs(ahead + (1 - part[i]) * size[i]) < abs(ahead - part[i] * size[i])
            copies[i] += up
            ahead += (up - part[i]) * size[i]
    return copies


def _plan(docs: DataFrame) -> tuple[DataFrame, int]:
    """Sources' keys, sizes, targets, rates, and the number of parts that round apart; and how many sources.
    The driver holds a row for each source, as the mix's weights do."""
    spark = docs.sparkSession
    cells = cut(docs.groupBy("__source").agg(F.sum("__size").alias("__words"), F.count("*").alias("__docs")))
    rows = cells.collect()
    sizes = {r[0]: int(r[1]) for r in rows}
    goal = targets(sizes)
    lam = balance(cells, ["__source"], "__words", [goal])[0]
    rate = {k: min(float(MOST), math.exp(lam[k]) if lam[k] > -math.inf else 0.0) for k in sizes}
    plan = [(r[0], sizes[r[0]], goal[r[0]], rate[r[0]], max(1, -(-r[2] // ROUND_TOGETHER))) for r in rows]
    schema = "__source string, source_size bigint, target double, rate double, __parts bigint"
    return spark.createDataFrame(plan, schema), len(plan)


def _with_copies(df: DataFrame, tie: Column) -> DataFrame:
    """df (with __source and __size) and its source's figures, and the copies taken of each row."""
    plan, n = _plan(df.select("__source", "__size"))
    parted = look_up(df, plan, ["__source"], n, "inner").withColumn("__part", F.pmod(tie, F.col("__parts")))
    out = parted.withColumn("copies", F.lit(0).cast("long")).drop("__tie")
    names = out.columns

    def take(t: pa.Table) -> pa.Table:
        size, rate = t["__size"].to_numpy(), t["rate"].to_numpy()
        order = np.lexsort((t["__tie"].to_numpy(), -size))
        t = t.take(pa.array(order))
        copies = round_rates(size[order], rate[order])
        return t.drop_columns(["__tie"]).append_column("copies", pa.array(copies, pa.int64())).select(names)

    tied = parted.withColumn("__tie", tie)
    return tied.groupBy("__source", "__part").applyInArrow(take, out.schema)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each row of df: doc_id, size, source_size, target, rate, copies, taken.

    A null text has no words; a null source is a source of its own, last in order; a null id is kept.  Reruns
    agree: ties of equal size are settled by a hash of the id.  An empty table gives no rows.
    """
    prepare(df.sparkSession)
    docs = cut(df.select(df[doc_id].alias("doc_id"), words(df[text]).alias("__size"), _key(df[source]).alias("__source")))
    rows = _with_copies(docs, F.xxhash64("doc_id"))
    return rows.select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target", "rate", "copies", (F.col("copies") * F.col("__size")).alias("taken")
    )


def take_mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with df's columns.  Null texts have no words and are
    taken at their source's rate; a null source is a source of its own; repeated rows count each; ties of size are
    settled by a hash of the id; an empty table gives no rows."""
    prepare(df.sparkSession)
    packed = df.select(
        F.struct(*[df[c] for c in df.columns]).alias("__row"),
        df[doc_id].alias("__id"),
        words(df[text]).alias("__size"),
        _key(df[source]).alias("__source"),
    )
    rows = _with_copies(packed, F.xxhash64("__id"))
    return rows.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("__row.*")
