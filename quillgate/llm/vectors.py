"""Operator 7: near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are vectors of the corpus that lie well apart.  Every vector is described by its NAMED
nearest pivots.  Vectors that share at least two of them are candidates, so the inverted lists are kept by pairs of
pivots: a list holds the vectors that name both.  Pairs that occur grow in number with the pivots and with how many
lie near each other, so lists stay some fifty times shorter than those of single pivots.  A candidate's cosine is
verified in double precision, in the list of the two least pivots that both name, so it counts once and no pair is ever
emitted: a list returns only each vector's number of links and a spanning forest of them.  Lists longer than BLOCK are
dealt out as pairs of blocks to as many tasks.  Equal vectors are one entry with a weight.

The pivots are chosen from a sample (of about 16 times the square root of the distinct vectors, at most
4 * MOST_PIVOTS, by a hash of the vector); every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest, least_of_components
from .runtime import cut, join_skewed, prepare

COSINE = 0.95
#: Pivots named by each vector, most pivots, cosine under which pivots lie apart.
NAMED, MOST_PIVOTS, APART = 6, 16_384, 0.7
BLOCK = 1024


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision, from a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Rows of the sample, in order, that lie apart from those chosen before."""
    open_, chosen = np.ones(len(sample), bool), []
    for i in range(len(sample)):
        if open_[i]:
            chosen.append(i)
            if len(chosen) == most:
                break
            open_ &= sample @ sample[i] < APART
    return sample[chosen]


def nearest(x: np.ndarray, pivots: np.ndarray, named: int = NAMED) -> np.ndarray:
    """The nearest pivots of each row, nearest first."""
    near = np.empty((len(x), min(named, len(pivots))), np.int64)
    for a in range(0, len(x), 2048):
        s = x[a : a + 2048] @ pivots.T
        top = np.argpartition(-s, near.shape[1] - 1, 1)[:, : near.shape[1]]
        near[a : a + 2048] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable"), 1)
    return near


def _pairs(near: np.ndarray) -> np.ndarray:
    """Names of the lists of each row: each pair of its pivots, or the one pivot that there is, twice."""
    near = np.sort(near, 1)
    i, j = np.triu_indices(near.shape[1], 1) if near.shape[1] > 1 else (np.array([0]), np.array([0]))
    return near[:, i] << 32 | near[:, j]


def _meet(pair: int, left: tuple, right: tuple | None, cosine: float):
    """Links between the two blocks of a list (or within one): mask over left x right."""
    x, near = left
    y, near2 = right if right is not None else left
    first, second = pair >> 32, pair & 0xFFFFFFFF
    linked = x @ y.T >= cosine
    if not linked.any():
        return linked
    names = np.unique(np.concatenate([near.ravel(), near2.ravel()]))
    names = names[(names < second) & (names != first)]

    def marks(n):
        m = np.zeros((len(n), len(names) + 1), np.float32)
        at = np.searchsorted(names, n)
        known = np.zeros(n.shape, bool) if not len(names) else names[np.minimum(at, len(names) - 1)] == n
        m[np.arange(len(n))[:, None], np.where(known, at, len(names))] = 1
        return m[:, :-1]

    # The list is that of the two least pivots that both name: they share no other below the second.
    return linked & (marks(near) @ marks(near2).T == 0) if len(names) else linked


def _index(rep: DataFrame, size: int, cosine: float) -> DataFrame:
    """rep (node, copies, embedding) of one dimension -> rows (kind, a, b): 0 links of a node, 1 a link."""
    spark = rep.sparkSession
    n = rep.count()
    most = int(min(MOST_PIVOTS, max(16, 4 * n**0.5)))
    sample = rep.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(4 * most).toArrow()
    shared_pivots = spark.sparkContext.broadcast(choose_pivots(_matrix(sample.column(0)), most))  # at most MOST_PIVOTS rows

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                near = nearest(_matrix(b.column(2)), shared_pivots.value)
                listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), t)) for v, t in ((near, pa.int32()), (_pairs(near), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*b.columns, *listed], names=[*b.schema.names, "near", "pairs"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rep.schema.fields)
    named = cut(rep.mapInArrow(name, f"{fields}, near array<int>, pairs array<bigint>"))
    # Names of lists alone are counted first: vectors travel only to lists that hold another one.
    entries = named.select("node", F.explode("pairs").alias("pair"))
    lists = cut(entries.groupBy("pair").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")))
    entries = join_skewed(entries, lists, "pair", "n")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node", "pair"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    entries = entries.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")
    lists = entries.join(named.select("node", "copies", "embedding", "near"), "node")

    # Lists come one after another in sorted partitions; a task holds one list's (two) blocks at a time.
    columns = ["pair", "low", "high", "block", "node", "copies", "near", "embedding"]
    parted = lists.select(*columns).repartition("pair", "low", "high").sortWithinPartitions("pair", "low", "high")
    return parted.mapInArrow(_verify(cosine), "kind int, a bigint, b bigint")


def _verify(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(pa.Table.from_batches([batch]))
            t = pa.concat_tables(held).combine_chunks()
            starts = _starts(t)
            if len(starts) > 1:
                yield _links(t.slice(0, starts[-1]), starts[:-1], cosine)
                t = t.slice(starts[-1])
            held = [t]
        if held:
            yield _links(held[0].combine_chunks(), _starts(held[0]), cosine)

    return run


def _starts(t: pa.Table) -> np.ndarray:
    """Rows at which a list, or pair of its blocks, starts."""
    change = np.zeros(len(t), bool)
    change[:1] = True
    for name in ("pair", "low", "high"):
        x = t[name].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


def _links(t: pa.Table, starts: np.ndarray, cosine: float) -> pa.RecordBatch:
    """Rows (kind, a, b) of whole lists: links of a node in kind 0, a spanning forest of the links in kind 1."""
    node, copies, block = (t[c].to_numpy() for c in ("node", "copies", "block"))
    pairs, lows, highs = (t[c].to_numpy() for c in ("pair", "low", "high"))
    x = _matrix(t["embedding"])
    near = t["near"].combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    kind, a, b = [], [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
        i = j = np.arange(s, e)
        if lows[s] != highs[s]:
            i, j = i[block[s:e] == lows[s]], j[block[s:e] == highs[s]]
        if not len(i) or not len(j) or e - s < 2:
            continue
        found = _meet(int(pairs[s]), (x[i], near[i]), (x[j], near[j]), cosine)
        if lows[s] == highs[s]:
            np.fill_diagonal(found, False)
        if not found.any():
            continue
        linked = np.zeros((e - s, e - s), bool)
        linked[np.ix_(i - s, j - s)] = found
        linked |= linked.T
        n = linked @ copies[s:e] if lows[s] != highs[s] else found @ copies[s:e]
        has, edges = np.flatnonzero(n), forest(linked)
        kind += [0] * len(has) + [1] * len(edges)
        a += [*node[s:e][has].tolist(), *(int(node[s + p]) for p, _ in edges)]
        b += [*n[has].tolist(), *(int(node[s + q]) for _, q in edges)]
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE
) -> DataFrame:
    """One row for each row of df: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of
    different lengths neither.  n_links counts all other rows within the cosine, copies included; repeated rows
    count each.  component_id is the least id reached, kept whether the row's own id is that; a null id is never
    kept.  An empty table gives no rows.
    """
    prepare(df.sparkSession)
    rows = df.select(df[vec_id].alias("vec_id"), df[embedding].alias("embedding"))
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    fit = F.coalesce(F.forall("embedding", number) & F.exists("embedding", lambda v: v != 0), F.lit(False))
    # Equal vectors by 128 bits of hash, so that no vector is a shuffle key.
    key = F.concat_ws("-", F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding"))
    good = rows.filter(fit).withColumn("key", key)
    rep = good.groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
    rep = cut(rep.withColumn("node", F.monotonically_increasing_id()))
    found = None
    for (size,) in rep.select(F.size("embedding")).distinct().collect():  # one index for each length of vectors
        part = cut(_index(rep.filter(F.size("embedding") == size).select("node", "copies", "embedding"), size, cosine))
        found = part if found is None else found.union(part)
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if found is None:
        return alone.withColumn("kept", F.col("vec_id").isNotNull())
    links = found.filter("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    roots = components(found.filter("kind = 1").select("a", "b"))
    joined = rep.select("node", "key", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
    joined = cut(joined.select("key", "least", "copies", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    named = cut(least_of_components(joined, "least"))
    out = join_skewed(good.select("vec_id", "key"), named, "key", "copies").select("vec_id", "n_links", "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
