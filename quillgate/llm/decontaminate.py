"""Operator 11: benchmark decontamination, in DataFrame functions throughout.

The test items' windows of words are a hash set that is broadcast, in blocks of a bounded size.  The windows of a text
are hashed where the text is scanned; a window of an equal hash is a hit only if its words are equal too.  The hits of
a text come together as spans of words, which are counted, or cut out of the text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare, stored

WINDOW = 10
#: Bytes of the hash set that one scan broadcasts; a larger set is several blocks and as many scans.
BLOCK_BYTES = 64 << 20
#: What is neither a word's character nor to be lower-cased; the second keeps capitals as a word's characters.
_WORD, _ANY_CASE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text, A to Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), F.lit(_WORD), F.lit(0))


def _slices(w: Column, k: int) -> Column:
    """Of each window of k words its place, from 1, its length and its hash.  A text of fewer words has none."""
    n = F.size(w) - k + 1
    window = lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.xxhash64(F.slice(w, i, F.lit(k))).alias("hash"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), window))


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once a row, however often they are named: a generator of one row holds them."""
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(packed).alias("__s")).select(*df.columns, "__s.*")


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """hash, len, words, items: each distinct window of the items with the distinct ids, as strings, of the items that hold
    it.  An item of fewer words than a window, but not none, is one window.  An item without an id hits but is not named."""
    rows = _settled(benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("t")), w=words(F.col("t"))).filter(F.size("w") > 0)
    whole = F.array(F.struct(F.lit(1).alias("pos"), F.size("w").alias("len"), F.xxhash64("w").alias("hash")))
    each = rows.select("item", "w", F.explode(F.when(F.size("w") < window, whole).otherwise(_slices(F.col("w"), window))).alias("x"))
    found = each.select("item", "x.hash", "x.len", F.slice("w", F.col("x.pos"), F.col("x.len")).alias("words"))
    return found.groupBy("hash", "len", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def find(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns `keep` of each row of docs, n_words, spans (its windows that occur in the benchmark: start, from 0, and
    stop, in words, in order; windows of several items once) and items (ids of the items met, as strings in order).

    Null and wordless texts have no words and no spans; null ids and repeated rows are rows like any other; an empty
    table gives no rows; an empty benchmark hits nothing.  Other columns, whatever their names, are not read.  No row
    meets another, so texts that very many rows share are no hot key; a window that occurs everywhere is a row of the
    hash set all the same.
    """
    prepare(docs.sparkSession)
    known = cut(windows(benchmark, item, item_text, window))
    lengths = [r.len for r in known.select("len").distinct().orderBy("len").collect()]  # `window` numbers at most
    size = known.agg(F.sum(F.lit(64) + F.octet_length(F.array_join("words", " ")) * 2 + F.octet_length(F.array_join("items", " ")) * 2)).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    own = {c: f"k{i}" for i, c in enumerate(keep)}
    rows = _settled(docs.select(*[docs[c].alias(k) for c, k in own.items()], docs[text].alias("t")), w=words(F.col("t"))).drop("t")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # A row of its own, which hits nothing, brings each text through.
    none = F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("hash")))
    at = reduce(lambda a, k: F.concat(a, F.coalesce(_slices(F.col("w"), k), F.array_compact(F.array(F.when(F.lit(False), none[0]))))), lengths, none)
    scanned = rows.select("*", F.explode(at).alias("x"))

    def scan(b: int) -> DataFrame:
        part = known.filter(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else known
        part = part.select(F.col("hash").alias("__h"), F.col("len").alias("__len"), F.col("words").alias("__words"), "items")
        met = scanned.join(F.broadcast(part), F.col("x.hash") == F.col("__h"), "left")
        hit = (F.col("__len") == F.col("x.len")) & (F.col("__words") == F.slice("w", F.col("x.pos"), F.col("x.len")))
        hit = F.coalesce(hit, F.lit(False)) & (F.col("x.pos") > 0)
        span = F.when(hit, F.struct((F.col("x.pos") - 1).alias("start"), (F.col("x.pos") + F.col("x.len") - 1).alias("stop")))
        kept = met.filter(hit | (F.col("x.pos") == 0))
        return kept.select("row", *own.values(), F.size("w").cast("long").alias("n_words"), span.alias("span"), F.when(hit, F.col("items")).alias("items"))

    hits = reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)])
    found = hits.groupBy("row", *own.values(), "n_words").agg(F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return found.select(*[F.col(k).alias(c) for c, k in own.items()], "n_words", "spans", "items")


def n_hit(spans: Column) -> Column:
    """Words that lie in any of the ordered spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("reach"))
    one = lambda a, s: F.struct(
        (a["total"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["reach"]))).alias("total"), F.greatest(a["reach"], s["stop"]).alias("reach")
    )
    return F.aggregate(spans, start, one, lambda a: a["total"])


def _merged(spans: Column) -> Column:
    """Ordered spans, those that touch or overlap as one."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def one(a, s):
        last = F.try_element_at(a, F.lit(-1))
        grown = F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.when(s["start"] <= last["stop"], grown).otherwise(F.concat(a, F.array(s)))

    return F.aggregate(spans, empty, one)


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without what occurs in the benchmark: the documents themselves (remove="documents"), or of their texts the
    words hit, each with what stands between it and the next word (remove="spans").

    The columns stay as they are, whatever their names; texts without a hit stay as they are, nulls too; repeated rows fare
    alike; an empty table stays empty.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    packed = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), docs[text].alias("__text"), F.monotonically_increasing_id().alias("__id")))
    found = find(packed, benchmark, ["__id"], "__text", item, item_text, window).filter(F.size("spans") > 0)
    if remove == "documents":
        return packed.join(found.select("__id"), "__id", "left_anti").select("__row.*")
    hit = found.select("__id", _merged(F.col("spans")).alias("__spans"))
    pieces = F.regexp_extract_all("__text", F.lit(f"{_ANY_CASE}[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]*"), F.lit(0))
    lead = F.regexp_extract("__text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    rows = _settled(packed.join(hit, "__id", "left"), __pieces=F.when(F.col("__spans").isNotNull(), pieces))
    # What lies between one span's stop and the next one's start stays.
    stops = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["stop"]))
    starts = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.size("__pieces")))
    left = F.transform(F.arrays_zip(stops.alias("a"), starts.alias("b")), lambda g: F.array_join(F.slice("__pieces", g["a"] + 1, g["b"] - g["a"]), ""))
    cleaned = F.when(F.col("__spans").isNotNull(), F.concat(lead, F.array_join(left, ""))).otherwise(F.col("__text"))
    return rows.select(*[(cleaned.cast(docs.schema[c].dataType) if c == text else F.col("__row")[c]).alias(c) for c in docs.columns])
