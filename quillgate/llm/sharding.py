"""Operator 5: sharding by longest-processing-time scheduling.

Groups of equal texts stay together.  Sorted by size, each goes to the least-loaded shard through a heap.  The
schedule depends on sizes alone, so the driver gets only how many groups, of how many bytes, each class of sizes has:
sizes that agree in their first bits, at most 32,000 classes whatever the corpus.  Groups of a class are dealt in bulk
at their mean size; which of them goes where is settled by their rank by a hash of the text, which executors work out,
so that what single sizes are off the mean cancels out.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut, join_skewed, look_up, prepare

#: Rows that are ranked together, and bits of a size that tell its class.
RANK_TOGETHER, BITS = 20_000, 11


def size_class(size: str) -> Column:
    """Sizes under 2 ** BITS are classes of their own; larger ones lose their lowest bits, so that a class spans a
    thousandth of its size and there are 1,024 for each doubling, 32,000 up to a terabyte, however many sizes there are."""
    low = f"greatest(length(bin({size})) - {BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({size}, {low}), {low})")


def schedule(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """For sizes in falling order and their numbers of groups: how many of each size go to each shard under
    longest processing time first; of equally loaded shards the lowest is taken."""
    loads = np.zeros(shards, np.int64)
    out = np.zeros((len(sizes), shards), np.int64)
    for r, (s, c) in enumerate(zip(sizes.tolist(), counts.tolist())):
        if c > 2 * shards:
            # As many as fill every shard up to a common level go at once; the rest by the heap.
            low, high = int(loads.min()), int(loads.max()) + s * (c // shards + 1)
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if _below(loads, s, level).sum() <= c else (low, level - 1)
            bulk = _below(loads, s, low)
            out[r] += bulk
            loads += bulk * s
            c -= int(bulk.sum())
        heap = [(int(x), j) for j, x in enumerate(loads.tolist())] if c else []
        heapq.heapify(heap)
        for _ in range(c):
            x, j = heap[0]
            heapq.heapreplace(heap, (x + s, j))
            out[r, j] += 1
            loads[j] += s
    return out


def _below(loads: np.ndarray, s: int, level: int) -> np.ndarray:
    """Groups of size s that each shard takes while its load is under the level."""
    return np.maximum(0, -((loads - level) // s))


def shard(df: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size is the text's bytes and 16 more.  Null texts form one group, empty ones another; the CRC of a null
    text is 0, as of an empty one.  Repeated rows each have a slot, and however many there are they are dealt out over
    all parts in which a shard's slots are counted; slots follow the rows as they are read.  An empty table gives no rows.
    """
    prepare(df.sparkSession)
    spark, t = df.sparkSession, df[text].cast("string")
    rows = cut(
        df.select(
            df[doc_id].alias("doc_id"),
            (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 16).alias("size"),
            F.coalesce(F.crc32(t.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(t, 256)), F.lit("null").cast("binary")).alias("key"),
            F.monotonically_increasing_id().alias("row"),  # tells repeated rows apart; it is written with them
        )
    )
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("total"), F.count("*").alias("rows")).withColumn("class", size_class("total")))
    hist = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("total").alias("bytes"), F.sum("rows").alias("rows")).toPandas()
    hist = hist.sort_values("class", ascending=False)
    n_rows, counts = int(hist["rows"].sum()), hist["n"].to_numpy(np.int64)
    quota = schedule(hist["bytes"].to_numpy(np.int64) // np.maximum(counts, 1), counts, shards).cumsum(1)
    classes, parts = hist["class"].to_numpy(np.int64), np.maximum(1, -(-counts // RANK_TOGETHER))
    until = pa.ListArray.from_arrays(pa.array(np.arange(len(classes) + 1) * shards, pa.int32()), pa.array(quota.ravel(), pa.int64()))
    table = F.broadcast(spark.createDataFrame(pa.table({"class": classes, "parts": parts, "until": until})))  # a row for each class
    dealt = groups.select("key", "class", "rows").join(table, "class").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    if (parts > 1).any():
        # Sizes of very many groups are ranked in parts; each part starts where those before it end.
        starts = dealt.filter("parts > 1").groupBy("class", "part").agg(F.count("*").alias("n"))
        before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        starts = starts.select("class", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        dealt = look_up(dealt, starts, ["class", "part"], int(parts[parts > 1].sum()))
    else:
        dealt = dealt.withColumn("start", F.lit(0))
    rank = F.coalesce(F.col("start"), F.lit(0)) + F.row_number().over(Window.partitionBy("class", "part").orderBy("key")) - 1
    dealt = dealt.withColumn("rank", rank).select("key", "rows", F.size(F.filter("until", lambda u: u <= F.col("rank"))).alias("shard"))
    parts = max(8, -(-n_rows // (shards * RANK_TOGETHER)))
    placed = cut(
        join_skewed(rows, cut(dealt), "key", "rows").select("doc_id", "size", "text_crc32", "shard", "row", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    )
    starts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    slot = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    numbered = look_up(placed.withColumn("at", slot), starts, ["shard", "part"], shards * parts)
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
