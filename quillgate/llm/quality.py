"""Operator 2: quality rules by tokeniser fertility.

A public vocabulary measures each whole text: characters per token, the share of tokens that hold a broken
piece of a character (byte fallback), and the entropy of the tokens in bits.  The bands of acceptance are
those of the text's language, of its script where too few texts share the language, or else of the corpus,
among texts with a like number of tokens, or the next lengths where too few have it: median, and distance to the
nearer quartile, over distinct texts.  Junk of up to a third lies on one side and stretches only that.  Entropy grows with length, so its bands are of what is left after that trend.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .runtime import cut, look_up, map_texts, stored

#: Half a band's width in standard deviations (of the nearer quartile's distance), and at least: a share of the
#: median for characters per token, bits for entropy, a share of all tokens for byte fallback.
WIDTH, LEAST_FERTILITY, LEAST_ENTROPY, LEAST_FALLBACK = 4.0, 0.05, 0.4, 0.05
#: Distinct texts that a band needs.
BAND_TEXTS = 30
#: Base rules: fewest words, and the share in % of words in repeated windows.
LEAST_WORDS, REPEATED, WINDOW = 20, 30, 8

# First code points of script ranges, and their scripts.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0F00, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_FIRST = np.array([a for a, _ in SCRIPTS], np.uint32)
_NAMES = sorted({n for _, n in SCRIPTS})
_KIND = np.array([_NAMES.index(n) for _, n in SCRIPTS])

_BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
_FERTILITY = "script string, n_tokens bigint, fertility double, fallback double, entropy double"


def script_of(text: str) -> str:
    """The script of most characters beyond punctuation; latin for ASCII."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points[points > 0x40]
    counts = np.bincount(_KIND[np.searchsorted(_FIRST, points, "right") - 1], minlength=len(_NAMES))
    return _NAMES[int(counts.argmax())] if len(points) else "latin"


@lru_cache(2)
def _fallback_tokens(path: str) -> np.ndarray:
    def broken(b: bytes) -> bool:
        try:
            b.decode()
        except UnicodeDecodeError:
            return True
        return False

    return np.array([broken(b) for b in bpe.vocabulary(path).bytes])


def _fertility(texts: list[str | None], path: str) -> dict:
    ids = bpe.encode_batch(texts, path)
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64)
    doc = np.repeat(np.arange(len(ids)), n)
    fallback = np.bincount(doc, _fallback_tokens(path)[flat], minlength=len(ids))
    key, count = np.unique(doc << 32 | flat, return_counts=True)
    of = key >> 32
    share = count / n[of]
    entropy = -np.bincount(of, share * np.log2(share), minlength=len(ids)) if len(key) else np.zeros(len(ids))
    size = np.array([len(t) if t else 0 for t in texts])
    return {
        "script": [script_of(t) if t else None for t in texts],
        "n_tokens": n,
        "fertility": size / np.maximum(n, 1),
        "fallback": fallback / np.maximum(n, 1),
        "entropy": np.maximum(entropy, 0.0) + 0.0,
    }


# White space between words, and the characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"


class _Numbers(dict):
    """word -> its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        return i


def _repeated(words: list[list[bytes]], window: int) -> np.ndarray:
    """Words of each text that lie in a window of `window` words found twice or more in that text."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(_Numbers().__getitem__, itertools.chain.from_iterable(words)), np.int64, int(n.sum()))
    start = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(words)), n)
    at = np.flatnonzero(start[doc + 1] - np.arange(len(ids)) >= window)  # windows that end inside their text
    out = np.zeros(len(words), np.int64)
    if not len(at):
        return out
    # Exact ranks of windows by doubling: two windows share a rank only if all their words are equal.
    rank, span = ids, 1
    key = doc
    for bit in bin(window)[3:]:
        rank, span = _pair(rank, span), span * 2
        if bit == "1":
            rank, span = _pair(rank, 1, ids, span), span + 1
    _, back, count = np.unique(key[at] * (int(rank.max()) + 1) + rank[at], return_inverse=True, return_counts=True)
    again = at[count[back] > 1]
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc, covered, minlength=len(words)).astype(np.int64)


def _pair(rank: np.ndarray, span: int, other: np.ndarray | None = None, shift: int | None = None) -> np.ndarray:
    """Ranks of spans joined with the span (or word) that follows them; what runs off the end joins with 0."""
    other, shift = (rank, span) if other is None else (other, shift)
    ahead = np.zeros_like(rank)
    ahead[: len(rank) - shift] = other[shift:] + 1
    return np.unique(rank * (int(ahead.max()) + 1) + ahead, return_inverse=True)[1].astype(np.int64)


def _base(texts: list[str | None]) -> dict:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]  # bytes.split: ASCII white space
    chars = [len(t) - sum(map(t.count, SPACE)) if t else 0 for t in texts]
    lines = [[x for x in t.split("\n") if x.strip(SPACE)] if t else [] for t in texts]
    return {
        "n_words": list(map(len, words)),
        "word_chars": chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) if t else 0 for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": _repeated(words, WINDOW),
    }


def measure(df: DataFrame, keep, text: str = "text", vocabulary: str | None = None, base: bool = True) -> DataFrame:
    """Columns of `keep`, then the base figures and those of fertility, of whole texts; no shuffle."""
    path = vocabulary or bpe.default_vocabulary()
    schema = f"{_BASE}, {_FERTILITY}" if base else _FERTILITY
    return map_texts(df, keep, text, schema, lambda texts: (_base(texts) if base else {}) | _fertility(texts, path))


def _keys(lang):
    """Band keys of a row, in the order in which they are asked."""
    return F.concat(F.lit("lang "), lang), F.concat(F.lit("script "), F.col("script")), F.lit("all")


def _room():
    return F.when(F.col("n_tokens") > 0, F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int"))


def _shortness():
    """Entropy falls about in proportion to it; in 1/10,000, so that sums are exact and reruns agree."""
    return F.round(10_000 / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("long")


def _pools(cells: DataFrame) -> DataFrame:
    """(key, room, near, slope): whose texts make the band of a key and room.  That is its own room with
    BAND_TEXTS texts, else also the next shorter and longer ones, until there are as many.  Keys with fewer
    texts give none, but for the whole corpus.  `slope` is the key's trend of entropy by shortness, 0 at most."""
    whole = Window.partitionBy("key")
    n, x, y, xx, xy = (F.sum(c).over(whole).cast("double") for c in ("texts", "x", "y", "xx", "xy"))
    slope = F.coalesce(F.least(F.try_divide(n * xy - x * y, n * xx - x * x) / 1000, F.lit(0.0)), F.lit(0.0))
    known = cells.select("key", "room", "texts", n.alias("total"), slope.alias("slope")).filter((F.col("total") >= BAND_TEXTS) | (F.col("key") == "all"))
    near = known.select("key", F.col("room").alias("near"), "texts")
    off = F.abs(F.col("room") - F.col("near"))
    closer = F.sum("texts").over(Window.partitionBy("key", "room").orderBy("off").rangeBetween(Window.unboundedPreceding, -1))
    pairs = known.drop("texts").join(near, "key").withColumn("off", off).withColumn("closer", F.coalesce(closer, F.lit(0)))
    return pairs.filter(F.col("closer") < BAND_TEXTS).select("key", "room", "near", "slope")


def bands(measured: DataFrame, lang: str | None = "lang") -> DataFrame:
    """One row for each key (language, script, corpus) and power of two of tokens: median and half width of each
    figure over distinct texts (rows with equal figures count once, so copies weigh nothing)."""
    lang_col = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    rows = cut(
        measured.filter("n_tokens > 0")
        .select(F.explode(F.array(*_keys(lang_col))).alias("key"), _room().alias("room"), "n_tokens", "fertility", "fallback", "entropy")
        .filter("key is not null")
        .distinct()
    )
    x, y = _shortness(), F.round(1000 * F.col("entropy")).cast("long")
    sums = {"x": x, "y": y, "xx": x * x, "xy": x * y}
    pools = cut(_pools(cut(rows.groupBy("key", "room").agg(F.count("*").alias("texts"), *(F.sum(c).alias(n) for n, c in sums.items())))))
    held = look_up(rows.withColumnRenamed("room", "near"), pools, ["key", "near"], pools.count(), "inner")
    # Exact quartiles of figures to three places: reruns agree, and a group's table of values stays small.
    quartiles = lambda c: F.percentile(F.round(c, 3), [0.25, 0.5, 0.75]).alias(c)
    held = held.withColumn("entropy", F.col("entropy") - F.col("slope") * _shortness())
    out = held.groupBy("key", "room", "slope").agg(*map(quartiles, ("fertility", "fallback", "entropy")))
    width = lambda c: F.least(F.col(c)[2] - F.col(c)[1], F.col(c)[1] - F.col(c)[0]) / 0.6745 * WIDTH
    return out.select(
        "key",
        "room",
        "slope",
        (F.col("fertility")[1] - F.greatest(width("fertility"), F.col("fertility")[1] * LEAST_FERTILITY)).alias("low_fertility"),
        (F.col("fertility")[1] + F.greatest(width("fertility"), F.col("fertility")[1] * LEAST_FERTILITY)).alias("high_fertility"),
        (F.col("fallback")[1] + F.greatest(width("fallback"), F.lit(LEAST_FALLBACK))).alias("high_fallback"),
        (F.col("entropy")[1] - F.greatest(width("entropy"), F.lit(LEAST_ENTROPY))).alias("low_entropy"),
    )


def judge(measured: DataFrame, limits: DataFrame, n_limits: int, lang: str | None = "lang") -> DataFrame:
    """`measured` with base_failed, the reason of a rejection by fertility (or null), and kept."""
    lang_col = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    names = ("lang", "script", "all")
    rows = measured.withColumns({"__room": _room()} | {f"__{name}": key for name, key in zip(names, _keys(lang_col))})
    for name in names:
        one = limits.select(
            F.col("key").alias(f"__{name}"), F.col("room").alias("__room"), F.struct("slope", "low_fertility", "high_fertility", "high_fallback", "low_entropy").alias(f"__by_{name}")
        )
        rows = look_up(rows, one, [f"__{name}", "__room"], n_limits)
    b = F.coalesce(*(F.col(f"__by_{name}") for name in names))
    reason = (
        F.when(F.col("fertility") < b["low_fertility"], "few characters per token")
        .when(F.col("fertility") > b["high_fertility"], "many characters per token")
        .when(F.col("fallback") > b["high_fallback"], "byte fallback")
        .when(F.col("entropy") - b["slope"] * _shortness() < b["low_entropy"], "low token entropy")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    return (
        rows.withColumns({"base_failed": failed, "reason": reason})
        .withColumn("kept", ~F.col("base_failed") & F.col("reason").isNull())
        .drop("__room", *(f"__{name}" for name in names), *(f"__by_{name}" for name in names))
    )


def quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """One row for each row of df: its id, the figures, base_failed, reason, kept.

    Null and empty texts have no words, so they fail the base rules.  A text whose language is null or rare
    is held against its script, and where that has under BAND_TEXTS distinct texts too, against the corpus.
    Repeated rows are judged alike.  Nothing is cut short: all figures are of whole texts.
    """
    lang = lang if lang in df.columns else None
    one = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), *([df[lang].alias("lang")] if lang else []))
    measured = cut(measure(one, ["doc_id", *(["lang"] if lang else [])], "text", vocabulary))
    limits = cut(bands(measured, "lang" if lang else None))
    return judge(measured, limits, limits.count(), "lang" if lang else None)


def keep_good(df: DataFrame, text: str = "text", lang: str | None = "lang", vocabulary: str | None = None) -> DataFrame:
    """The rows of df that the rules keep, with df's columns.  Each text is measured once: rows and figures are written
    down together, the bands come from the figures alone, and no text is shuffled.

    Null and empty texts go; repeated rows fare alike; an empty table gives no rows.
    """
    lang = lang if lang in df.columns else None
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), *([df[lang].alias("__l")] if lang else []), df[text].cast("string").alias("__t"))
    measured = stored(measure(packed, ["__row", *(["__l"] if lang else [])], "__t", vocabulary))
    limits = cut(bands(measured, "__l" if lang else None))
    return judge(measured, limits, limits.count(), "__l" if lang else None).filter("kept").select("__row.*")
