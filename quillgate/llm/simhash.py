"""Operator 4: SimHash near-duplicates, candidates pruned by pigeonring.

The 64 bits lie on a ring of segments.  If two fingerprints differ in at most `limit` bits, some segment starts
a chain whose first l segments differ in at most floor(l * limit / segments) bits, for every l.  Such a chain has
equal segments at known places near its start; they make the keys under which fingerprints meet.  Whoever meets
must pass the whole chain from that start before the full Hamming check.

Fingerprints that meet in a bucket give a spanning forest of their links, not all pairs.  Buckets of a key with
more than BUCKET fingerprints are not compared: each of their fingerprints lists the words
within half the limit of it, and those that list a word are linked with the least of them.  Two fingerprints
within the limit share such a word, and two that share one are within the limit, so no link's component is lost
and the work grows in proportion to the fingerprints.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest, least_of_components
from .runtime import cut, join_skewed, map_texts, prepare, stored

SHINGLE, SEED, LIMIT = 4, 42, 4
SEGMENTS, EQUAL = 7, 3
BUCKET = 2048
#: Rows of keys that may be broadcast (a long each).
KEY_ROWS = 200_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """As a signed 64-bit integer; no words: 0."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    start = np.concatenate([[0], np.cumsum(size + 1)])
    a, b = start[:n].tolist(), (start[min(shingle, len(words)) :][:n] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[i:j], seed) for i, j in zip(a, b)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, keep, text: str = "text") -> DataFrame:
    return map_texts(df, keep, text, "fp bigint", lambda texts: {"fp": [fingerprint(t) for t in texts]})


class Ring:
    """Segments, budgets, masks and key tables for a limit."""

    def __init__(self, limit: int = LIMIT, segments: int = SEGMENTS, equal: int = EQUAL):
        if limit % 2 or not 0 <= limit <= segments - equal:
            raise ValueError(f"limit must be even and at most {segments - equal}, so that {equal} segments are equal and large buckets have words half way")
        self.limit, self.segments = limit, segments
        cuts = [64 * i // segments for i in range(segments + 1)]
        self.mask = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
        self.budget = [l * limit // segments for l in range(1, segments + 1)]
        # Of a chain's first l segments at least l - budget are equal: the last place of its k-th equal one.
        last = [min(l for l in range(segments) if l + 1 - self.budget[l] > k) for k in range(equal)]
        places = [p for p in itertools.combinations(range(segments), equal) if p[0] == 0 and all(x <= y for x, y in zip(p, last))]
        self.tables = [(s, tuple((s + x) % segments for x in p)) for s in range(segments) for p in places]

    def keys(self, fp: Column) -> Column:
        """An array of one key for each table: its number above the bits of its equal segments."""
        return F.array(*[F.xxhash64(F.lit(t), fp.bitwiseAND(F.lit(_signed(sum(self.mask[x] for x in on))))) for t, (_, on) in enumerate(self.tables)])

    def passes(self, difference: Column) -> Column:
        """Does some chain keep within its budgets all the way, and the whole within the limit?"""
        chains = []
        for s in range(self.segments):
            held, mask = [], 0
            for l in range(self.segments - 1):
                mask |= self.mask[(s + l) % self.segments]
                held.append(F.bit_count(difference.bitwiseAND(F.lit(_signed(mask)))) <= self.budget[l])
            chains.append(_all(held))
        return _any(chains) & (F.bit_count(difference) <= self.limit)


    def pairs(self, difference: np.ndarray) -> np.ndarray:
        """`passes` for an array of differences."""
        count = [np.bitwise_count(difference & np.uint64(m)) for m in self.mask]
        kept = np.zeros(difference.shape, bool)
        for s in range(self.segments):
            total, chain = np.zeros(difference.shape, np.int16), np.ones(difference.shape, bool)
            for l in range(self.segments):
                total = total + count[(s + l) % self.segments]
                chain &= total <= self.budget[l]
            kept |= chain
        return kept


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _all(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _any(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def spanning(bucket: list[int], ring: Ring) -> list[tuple[int, int]]:
    """Of the links within a bounded bucket, those that hold its components together."""
    x = np.array(bucket, np.int64).view(np.uint64)
    linked = np.zeros((len(x), len(x)), bool)
    for a in range(0, len(x), 256):
        linked[a : a + 256] = ring.pairs(x[a : a + 256, None] ^ x[None, :])
    np.fill_diagonal(linked, False)
    return [(bucket[i], bucket[j]) for i, j in forest(linked)]


def links(distinct: DataFrame, ring: Ring | None = None, bucket: int = BUCKET) -> DataFrame:
    """distinct (fp) -> (a, b): links whose components are those of all pairs within the limit."""
    ring = ring or Ring()
    keyed = distinct.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"))
    met = cut(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    pair = met.filter("n = 2").select("a", "b")
    few, many = (met.agg(F.count_if((F.col("n") > 2) & (F.col("n") <= bucket)), F.count_if(F.col("n") > bucket))).first()

    def of(which, rows: int) -> DataFrame:
        keys = met.filter(which).select("key")
        return keyed.join(F.broadcast(keys) if rows <= KEY_ROWS else keys, "key", "left_semi")

    found = pair.filter(ring.passes(F.col("a").bitwiseXOR(F.col("b"))))
    if few:
        lists = of((F.col("n") > 2) & (F.col("n") <= bucket), few).groupBy("key").agg(F.collect_list("fp").alias("all")).select("all")

        def join(batches):
            for batch in batches:
                edges = [e for x in batch.column(0).to_pylist() for e in spanning(x, ring)]
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

        found = found.union(lists.mapInArrow(join, "a bigint, b bigint"))
    if many:
        half = ring.limit // 2
        flips = [0, *(_signed(sum(1 << x for x in c)) for r in range(1, half + 1) for c in itertools.combinations(range(64), r))]
        spark = distinct.sparkSession
        hot = cut(of(F.col("n") > bucket, many).select("fp").distinct())
        table = F.broadcast(spark.createDataFrame([(flips,)], "flips array<bigint>"))  # a fixed number of words
        near = hot.join(table).select("fp", F.explode("flips").alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
        hubs = near.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("word", "hub")
        star = near.join(hubs, "word").filter("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()
        found = found.union(star)
    return found.distinct()


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", ring: Ring | None = None, bucket: int = BUCKET) -> DataFrame:
    """One row for each row of df: doc_id, fp, component_id.

    Null and wordless texts have fingerprint 0, linked like any other.  component_id is the least id among the
    rows of all fingerprints reached; a null id takes no part in that, but its row has a component_id, null only
    if no row of the component has an id.  Repeated rows stay.  An empty table gives no rows.
    """
    prepare(df.sparkSession)
    rows = cut(fingerprints(df.select(df[doc_id].alias("doc_id"), df[text].alias("__t")), ["doc_id"], "__t"))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(distinct.select("fp"), ring, bucket)).withColumnRenamed("node", "fp")
    rooted = cut(distinct.join(roots, "fp", "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")))
    named = cut(least_of_components(rooted, "least"))
    return join_skewed(rows, named, "fp", "copies").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without all but one row of each component: of the rows that have the component's least id one, whichever
    document of the component that names, so that no component loses all its rows, nor keeps two.

    An id that several texts share counts for each of them: a component is told by its fingerprints, not by ids.  Of rows
    of the least id the one of the least digest of all columns stays; rows equal in every column are one.  Components in
    which no row has an id keep the row of the least digest.  Null and wordless texts are one component; an empty table
    stays empty; other columns, whatever their names, stay as they are.
    """
    prepare(df.sparkSession)
    # A row's own number, written with it, tells rows apart that agree in every column.
    packed = stored(df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), F.monotonically_increasing_id().alias("__id")))
    own = [F.col("__row")[c] for c in df.columns]
    plain = [F.to_json(F.struct(c)) if re.search("map|variant", kind) else c for c, (_, kind) in zip(own, df.dtypes)]
    digest = F.xxhash64(*[x for i, c in enumerate(plain) for x in (F.lit(i), c)])  # a null is told by its place
    rows = packed.select("__id", F.col("__row")[doc_id].alias("__doc"), digest.alias("__order"), F.col("__row")[text].cast("string").alias("__text"))
    rows = cut(fingerprints(rows, ["__id", "__doc", "__order"], "__text"))
    # Of each fingerprint its first row is enough, so copies are gone before components form; nulls of the id come last.
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("__doc").isNull().alias("none"), "__doc", "__order", "__id")).alias("first"))
    distinct = cut(first)
    roots = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "first")
    kept = cut(rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__id").alias("__id")))
    return packed.join(kept, "__id", "left_semi").select("__row.*")
