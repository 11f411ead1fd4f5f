"""Operator 12: ordered funnels counted by regular expressions over strings of time-ordered symbols.

Rows of one client and time become one symbol, the set of their kinds, so that rows of equal time have no order among
them.  A client's time is cut into slices; each slice also gets the symbols that follow within the window, as context
in which no attempt starts, so that no attempt needs a second slice and a client with very many rows is many short
strings.  One overlapped search of the `regex` module goes over the joined strings: at every first step a lookahead
captures the earliest later symbols of the next kinds, with no excluded kind on the way.  The captured positions give
the times, and these the window's limit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, prepare

MICRO = 1_000_000
#: Microseconds of a slice of a client's time.
SLICE = 900 * MICRO
#: Symbols are sets of kinds: 2 to this power of them, twice.
MAX_KINDS = 12
#: Steps' times are counted by bins of this many microseconds first, then one by one within a bin.
BIN = 1 << 14


@dataclass(frozen=True)
class Funnel:
    """Steps in order, and the kinds that may not lie between two of them."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()


FUNNELS = (
    Funnel("A", ("view", "click", "view", "purchase"), ("error",)),
    Funnel("B", ("signup", "view", "click", "purchase"), ("error",)),
    Funnel("C", ("click", "click", "purchase", "view"), ("signup",)),
)
WINDOW = 300 * MICRO


def micros(ts: Column, kind: str) -> Column:
    """Microseconds of a timestamp; one without a zone is taken as it is written, whatever the session's zone."""
    if kind == "timestamp":
        return F.unix_micros(ts)
    since = (ts.cast("timestamp_ntz") - F.lit("1970-01-01").cast("timestamp_ntz")).cast("interval second")
    return (since.cast("decimal(18,6)") * MICRO).cast("long")


class Symbols:
    """The alphabet: one character for each set of kinds, and one more for the same set as context."""

    BREAK, FIRST = 0x20, 0x100

    def __init__(self, kinds: Sequence[str]):
        if len(kinds) > MAX_KINDS:
            raise ValueError(f"at most {MAX_KINDS} kinds")
        self.bit = {k: 1 << i for i, k in enumerate(kinds)}
        self.context = 1 << len(kinds)

    def some(self, having: int, without: int, context: bool = True) -> str:
        """The class of all symbols with one of the kinds `having` (0: any) and none of `without`; an empty class never matches."""
        codes = [c for c in range(1, self.context) if (c & having or not having) and not c & without]
        codes += [c | self.context for c in codes] if context else []
        return "[" + "".join(map(chr, (self.FIRST + c for c in codes))) + "]" if codes else r"(?!)"

    def pattern(self, funnel: Funnel) -> regex.Pattern:
        """A first step that is no context; a lookahead captures the position of each further step, as far as they go."""
        bad = reduce(int.__or__, (self.bit[k] for k in funnel.excluded), 0)
        rest = ""
        for kind in reversed(funnel.steps[1:]):
            wanted = self.bit[kind]
            between = self.some(0, wanted | bad)
            rest = f"(?:(?:{between})*+({self.some(wanted, bad)}){rest})?"
        return regex.compile(f"{self.some(self.bit[funnel.steps[0]], 0, context=False)}(?={rest})")


def _symbols(rows: DataFrame, client: str, kind: str, time: str, symbols: Symbols, window: int, slice_us: int) -> DataFrame:
    """(client, slice, t, mask): one row for each client, time and slice that needs it; context is marked in the mask."""
    clean = rows.select(
        rows[client].alias("client"),
        micros(rows[time], dict(rows.dtypes)[time]).alias("t"),
        reduce(lambda a, k: a.when(rows[kind] == k, symbols.bit[k]), list(symbols.bit)[1:], F.when(rows[kind] == next(iter(symbols.bit)), 1)).alias("bit"),
    ).filter("client is not null and t is not null and bit is not null")
    own = F.floor(F.col("t") / slice_us)
    # An attempt of an earlier slice may reach this row: all slices of which the window's end is not before it.
    back = F.floor((F.col("t") - window) / slice_us)
    dealt = clean.select("client", "t", "bit", own.alias("own"), F.explode(F.sequence(back, own)).alias("slice")).repartition("client", "slice")
    sets = dealt.groupBy("client", "slice", "t", "own").agg(F.bit_or("bit").alias("mask"))
    return sets.select("client", "slice", "t", F.col("mask").bitwiseOR(F.when(F.col("own") != F.col("slice"), symbols.context).otherwise(0)).cast("int").alias("mask"))


def attempts(
    rows: DataFrame, funnels: Sequence[Funnel] = FUNNELS, window: int = WINDOW, client: str = "client_id", kind: str = "kind", time: str = "arrived_at", slice_us: int = SLICE
) -> DataFrame:
    """One row for each attempt and step that it reaches: funnel (its number), client, step (from 1), gap
    (microseconds from the previous step; null at step 1).

    Rows that are null in one of the three columns don't count; rows repeated count once; kinds that no funnel names
    are left out.  Rows of equal time are not later than each other.  Further columns, whatever their names, are not
    read.  An empty table gives no rows.  A task holds one client's slice of time at once, however many rows the
    client has; a search looks no further than the end of its slice and window.
    """
    prepare(rows.sparkSession)
    kinds = list(dict.fromkeys(k for f in funnels for k in (*f.steps, *f.excluded)))
    symbols = Symbols(kinds)
    slices = _symbols(rows, client, kind, time, symbols, window, slice_us).sortWithinPartitions("client", "slice", "t")
    kind_of = dict(slices.dtypes)["client"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(symbols.pattern(f), len(f.steps)) for f in funnels]
        for clients, at, t, mask in _whole_slices(batches):
            for i, (pattern, steps) in enumerate(found):
                for step, where, gap in _search(pattern, steps, at, t, mask, symbols, window):
                    n = len(where)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, i, np.int32)), clients.take(pa.array(where)), pa.array(np.full(n, step, np.int32)), gap],
                        names=["funnel", "client", "step", "gap"],
                    )

    return slices.mapInArrow(run, f"funnel int, client {kind_of}, step int, gap long")


def _whole_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(clients, begins, times, masks) of sorted rows, cut where a slice ends; `begins` marks each slice's first row."""
    rest: list[pa.RecordBatch] = []

    def parts(held: pa.Table):
        client, slices = held.column(0).combine_chunks(), held.column(1).to_numpy()
        code = client.dictionary_encode().indices.to_numpy()
        begins = np.concatenate([[True], (code[1:] != code[:-1]) | (slices[1:] != slices[:-1])])
        return client, begins, held.column(2).to_numpy(), held.column(3).to_numpy()

    for batch in batches:
        if not batch.num_rows:
            continue
        # A batch within the slice that the held rows began only joins them.
        if rest and (rest[-1].column(0)[0], rest[-1].column(1)[0]) == (batch.column(0)[-1], batch.column(1)[-1]):
            rest.append(batch)
            continue
        held = pa.Table.from_batches([*rest, batch])
        client, begins, t, mask = parts(held)
        last = int(np.flatnonzero(begins)[-1])
        rest = held.slice(last).to_batches()
        if last:
            yield client.slice(0, last), begins[:last], t[:last], mask[:last]
    if rest:
        yield parts(pa.Table.from_batches(rest))


def _search(pattern: regex.Pattern, steps: int, begins: np.ndarray, t: np.ndarray, mask: np.ndarray, symbols: Symbols, window: int):
    """(step, rows of the attempts that reach it, gaps) for each step."""
    starts = np.flatnonzero(begins)
    codes = np.insert(mask.astype(np.uint32) + np.uint32(symbols.FIRST), starts, symbols.BREAK)
    row = np.insert(np.arange(len(t)), starts, -1)
    text = codes.astype("<u4").tobytes().decode("utf-32-le")
    regs = [m.regs for m in pattern.finditer(text, overlapped=True)]
    if not regs:
        return
    at = np.array(regs, np.int64)[:, :, 0]  # (attempts, steps): where each captured step begins, or -1
    first = row[at[:, 0]]
    yield 1, first, pa.nulls(len(first), pa.int64())
    going, before = np.ones(len(first), bool), t[first]
    for k in range(1, steps):
        going = going & (at[:, k] >= 0)
        now = t[row[np.where(going, at[:, k], at[:, 0])]]
        going = going & (now - t[first] <= window)
        if not going.any():
            return
        yield k + 1, first[going], pa.array((now - before)[going])
        before = now


def quantiles(gaps: DataFrame, keys: list[str], value: str, weight: str, percent: int) -> DataFrame:
    """keys, t: the ceil(percent * n / 100)-th smallest value of each group of weighted, not negative whole numbers.

    Selected in two steps, by bins of BIN values and then within the bin met, so that no task sorts a group: a group
    has no more bins than its largest value divided by BIN, and a bin no more values than BIN.
    """
    bins = gaps.groupBy(*keys, F.floor(F.col(value) / BIN).alias("bin")).agg(F.sum(weight).alias("n"))
    group = Window.partitionBy(*keys)
    run = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.select(*keys, "bin", "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(group).alias("__n"))
    ranked = ranked.withColumn("wanted", F.expr(f"(__n * {int(percent)} + 99) div 100"))
    met = ranked.filter("wanted <= upto and wanted > upto - n").select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("wanted"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys], F.floor(F.col(value) / BIN) == F.col("__bin"))
    # Merged, never broadcast: there are as many bins met as groups.
    inside = gaps.join(met.hint("merge"), same).groupBy(*keys, "wanted", value).agg(F.sum(weight).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return inside.withColumn("upto", upto).filter("wanted <= upto and wanted > upto - n").select(*keys, F.col(value).alias("t"))


def funnels(
    rows: DataFrame, funnels: Sequence[Funnel] = FUNNELS, window: int = WINDOW, percent: int = 25, client: str = "client_id", kind: str = "kind", time: str = "arrived_at", slice_us: int = SLICE
) -> DataFrame:
    """One row for each funnel and client that attempts it: funnel, the client, n1 and on (attempts that reach each
    step), deepest, t2 and on (percentile of the times from the previous step, null if no attempt reaches it),
    same_depth (clients of the funnel that get as far).  Funnels have equal numbers of steps.

    Odd rows fare as in `attempts`; an empty table gives no rows.  All counts are summed before they are shuffled, so
    a client with a third of all rows is no hot key.
    """
    if len({len(f.steps) for f in funnels}) > 1:
        raise ValueError("funnels must have equal numbers of steps")
    steps = len(funnels[0].steps)
    found = attempts(rows, funnels, window, client, kind, time, slice_us)
    counts = cut(found.groupBy("funnel", "client", "step", "gap").agg(F.count("*").alias("n")))
    reached = counts.groupBy("funnel", "client").agg(
        *[F.coalesce(F.sum(F.when(F.col("step") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(1, steps + 1)], F.max("step").alias("deepest")
    )
    times = quantiles(counts.filter("step > 1"), ["funnel", "client", "step"], "gap", "n", percent)
    times = times.groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == k, F.col("t"))).alias(f"t{k}") for k in range(2, steps + 1)])
    both = cut(reached.join(times.hint("merge"), ["funnel", "client"], "left"))
    depths = both.groupBy(F.col("funnel").alias("__f"), F.col("deepest").alias("__d")).agg(F.count("*").alias("same_depth"))
    # A row for each funnel and step at most, whatever the input.
    out = both.join(F.broadcast(depths), (F.col("funnel") == F.col("__f")) & (F.col("deepest") == F.col("__d")))
    names = F.array(*[F.lit(f.name) for f in funnels])
    return out.select(
        F.get(names, F.col("funnel")).alias("funnel"), F.col("client").alias(client),
        *[f"n{k}" for k in range(1, steps + 1)], "deepest", *[f"t{k}" for k in range(2, steps + 1)], "same_depth",
    )
