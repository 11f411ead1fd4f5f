"""Operator 13: a Merkle manifest of a dataset, one tree a group and one tree over the groups' roots.

Nodes are events.  A partial parent gathers the digests of its children by their place; how many it waits for follows
from its level's size.  With the last one it becomes an event itself, so a digest climbs as far as the rows of its
block allow.  A block's top is the frontier that nothing there can resolve: it goes on to the next shuffle, by the
block above, until each group has one root.  On the way back the links from children to parents give every node its
siblings, and the path of the block above goes on where the block's own ends.

A block is at most FAN ** STRIDE nodes whatever the group's size, so a group with a third of all rows is many blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import SMALL_ROWS, cut, prepare

FAN, STRIDE = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def fold(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value as a leaf states it: its length in UTF-8, a colon and itself, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


# places -----------------------------------------------------------------------------------------------------------


def numbered(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df with `idx`, each row's place from 0 in the order of the columns `order` among the rows of its group (no nulls),
    and `n`, the group's rows.  Rows that agree in all of these get places in no stated order.

    Rows are dealt out by ranges and counted along each partition; a partition's rows of a group come after those of
    the partitions before it.  No task holds a group: there is a row for each partition and group only.
    """
    names = df.columns
    # The row's own number parts rows that agree, so that they need not meet in one task; df is materialised, so it stays.
    tied = cut(df.withColumn("__tie", F.monotonically_increasing_id()))
    parts = max(tied.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    ranged = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    at = names.index(group)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            code = b.column(at).dictionary_encode().indices.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            place = np.arange(b.num_rows) - np.repeat(begins, np.diff(np.append(begins, b.num_rows)))
            if b.column(at)[0] == last:
                place[: begins[1] if len(begins) > 1 else b.num_rows] += seen
            last, seen = b.column(at)[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(place)], names=[*names, "__k"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = cut(ranged.mapInArrow(count, f"{schema}, __k long").withColumn("__part", F.spark_partition_id()))
    runs = placed.groupBy("__part", F.col(group).alias("__g")).agg(F.count("*").alias("__rows"))
    groups = Window.partitionBy("__g")
    before = groups.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = cut(runs.select(F.col("__part").alias("__p"), "__g", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"), F.sum("__rows").over(groups).alias("n")))
    small = F.broadcast(runs) if runs.count() <= SMALL_ROWS else runs
    out = placed.join(small, (F.col("__part") == F.col("__p")) & (F.col(group) == F.col("__g")))
    return out.select(*names, (F.col("__before") + F.col("__k")).alias("idx"), "n")


# blocks -----------------------------------------------------------------------------------------------------------


def height(n: int, fan: int = FAN) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fan), levels + 1
    return levels


class Block:
    """The part of a tree above up to FAN ** STRIDE neighbouring nodes of one level, which has n nodes."""

    def __init__(self, n: int, stride: int = STRIDE, fan: int = FAN):
        self.sizes, self.fan = [n], fan
        while len(self.sizes) <= stride and self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // fan))
        self.partial: dict[tuple[int, int], dict[int, str]] = {}
        self.parent: dict[tuple[int, int], dict[int, str]] = {}  # of each resolved parent the children, by place
        self.top: str | None = None

    def arity(self, level: int, idx: int) -> int:
        """How many children a node has: all but the last one of a level have `fan`."""
        return min(self.fan, self.sizes[level - 1] - idx * self.fan)

    def event(self, level: int, idx: int, digest: str) -> None:
        """A digest is known.  It joins its parent, and resolves that if it is the last one missing."""
        while level + 1 < len(self.sizes):
            up = (level + 1, idx // self.fan)
            held = self.partial.setdefault(up, {})
            held[idx % self.fan] = digest
            if len(held) < self.arity(*up):
                return
            self.parent[up] = self.partial.pop(up)
            level, idx = up
            digest = fold(*(self.parent[up][k] for k in range(len(held))))
        self.top = digest

    def path(self, idx: int) -> list[dict[str, str]]:
        """Of the nodes from a bottom node to the block's top: the siblings to the left and to the right, each joined."""
        out = []
        for level in range(1, len(self.sizes)):
            place, idx = idx % self.fan, idx // self.fan
            held = self.parent[level, idx]
            out.append({"l": "".join(held[k] for k in range(place)), "r": "".join(held[k] for k in range(place + 1, len(held)))})
        return out


SPAN = FAN**STRIDE
#: A path: for each level from the bottom, the siblings to the left and to the right, each joined.
PATH = "array<struct<l:string,r:string>>"


def _block(t: pa.Table) -> Block:
    n, idx = t["n"][0].as_py(), t["idx"].to_pylist()
    block = Block(n)
    for i, d in zip(idx, t["digest"].to_pylist()):
        block.event(0, i, d)
    if block.top is None:
        raise ValueError("a block lacks nodes")
    return block


def _keyed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"idx div {SPAN}"))


def _up(nodes: DataFrame) -> DataFrame:
    """nodes (g, idx, n, digest) of a level -> those STRIDE levels above.  A group's root (n = 1) stays as it is."""

    def combine(t: pa.Table) -> pa.Table:
        one = {"g": t["g"].slice(0, 1), "idx": pa.array([t["idx"][0].as_py() // SPAN]), "n": pa.array([-(-t["n"][0].as_py() // SPAN)])}
        return pa.table(one | {"digest": pa.array([_block(t).top])})

    rows = _keyed(nodes.select("g", "idx", "n", "digest"))
    return rows.groupBy("g", "block").applyInArrow(combine, "g string, idx long, n long, digest string")


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (g, idx, n, digest) that begin a stride of levels: the leaves first, the groups' roots last."""
    levels = [leaves]
    while not levels[-1].filter("n > 1").isEmpty():
        levels.append(cut(_up(levels[-1])))
    return levels


def _down(nodes: DataFrame, above: DataFrame, names: list[str], subroot: bool = False) -> DataFrame:
    """nodes (g, idx, n, digest, names) and the paths (g, idx, path) of their blocks' tops -> g, idx, path of the nodes,
    names, and the group's root where wanted."""

    def work(t: pa.Table) -> pa.Table:
        block, upper = _block(t), t["path"][0].as_py()
        paths = [block.path(i) + upper for i in t["idx"].to_pylist()]
        out = {c: t[c] for c in ("g", "idx", *names)} | {"path": pa.array(paths, pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())])))}
        if subroot:
            root = t["digest"][0].as_py()
            for s in paths[0][: height(t["n"][0].as_py())]:
                root = fold(s["l"], root, s["r"])
            out["subroot"] = pa.array([root] * t.num_rows)
        return pa.table(out)

    kinds = dict(nodes.dtypes)
    schema = ", ".join(["g string", "idx long", *(f"{c} {kinds[c]}" for c in names), f"path {PATH}", *(["subroot string"] if subroot else [])])
    tops = above.select(F.col("g").alias("__g"), F.col("idx").alias("__block"), "path").hint("merge")
    rows = _keyed(nodes).join(tops, (F.col("g") == F.col("__g")) & (F.col("block") == F.col("__block"))).drop("__g", "__block")
    return rows.groupBy("g", "block").applyInArrow(work, schema)


def descend(levels: list[DataFrame], top: DataFrame, names: list[str], subroot: bool = False) -> DataFrame:
    """What `_down` gives of the leaves.  top (g, path): what lies above each group's root."""
    above = top.select("g", F.lit(0).cast("long").alias("idx"), "path")
    for nodes in reversed(levels[1:-1]):
        above = cut(_down(nodes, above, []))
    return _down(levels[0], above, names, subroot)


# manifests ----------------------------------------------------------------------------------------------------------


def manifest(rows: DataFrame, digest: str = "leaf", group: str = "source", order: Sequence[str] = ("doc_id",), keep: Sequence[str] = ("doc_id", "leaf")) -> DataFrame:
    """One row for each row: the columns `keep`, subroot (its group's root), root (the tree's over the groups in their
    order, null first) and path, for each level from the row's own up to the root the digests to the left and the right.

    digest: a column of 64 hex digits, no nulls.  A group's rows lie in the order of the columns `order`, nulls first,
    then of the digest, so that rows of equal order, repeated ones too, give the same tree on every run.  A null group is
    a group of its own.  Other columns, whatever their names, are not read.  An empty table gives no rows.
    """
    prepare(rows.sparkSession)
    own = {c: f"k{i}" for i, c in enumerate(keep)}
    asked = rows.select(
        field(rows[group]).alias("g"), *[rows[c].alias(f"o{i}") for i, c in enumerate(order)], rows[digest].alias("digest"), *[rows[c].alias(k) for c, k in own.items()]
    )
    leaves = cut(numbered(asked, "g", [*[f"o{i}" for i in range(len(order))], "digest"]).drop(*[f"o{i}" for i in range(len(order))]))
    levels = climb(leaves)
    named = levels[-1].select(F.lit("").alias("g"), F.col("g").alias("member"), F.when(F.col("g") != "-", F.regexp_replace("g", "^[0-9]+:", "")).alias("o"), "digest")
    groups = climb(cut(numbered(named, "g", ["o"])))
    root = groups[-1].select("digest").first()  # the one digest of the whole tree
    start = rows.sparkSession.createDataFrame([("", [])], f"g string, path {PATH}")
    top = cut(descend(groups, start, ["member"]).select(F.col("member").alias("g"), "path"))
    found = descend(levels, top, list(own.values()), subroot=True)
    return found.select(*[F.col(k).alias(c) for c, k in own.items()], "subroot", F.lit(root and root.digest).cast("string").alias("root"), "path")


def siblings(path: Column) -> Column:
    """All siblings of a path joined, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of its path."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["l"], d, s["r"]), 256))
