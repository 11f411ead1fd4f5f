"""Operator 9: language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit a binary classifier over hashed letter n-grams says which
side a text is on; its weights are the log odds of the n-grams between the languages whose bit is set and the
others, every language weighing alike.  Decoding takes the codeword with the least loss over all bits, each bit
weighted by how far its two sides lie apart, and calls a text ambiguous if the runner-up is close.
The counts behind the weights are of all labelled texts: one pass, summed by language and n-gram.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_texts, prepare, slices

#: Hashed n-grams, smoothing, bits for more than 7 languages, gap of losses under which a text is ambiguous.
FEATURES, SMOOTH, WIDE_BITS, CLOSE = 1 << 14, 0.5, 31, 0.2
#: Characters and texts at a time; bounds the table of counts of a batch.
SLICE, SLICE_TEXTS = 500_000, 128


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Texts x FEATURES counts of the hashed pairs and triples of letters (a run of others is one space), and
    the number of letters of each text."""
    lower = [(" " + t.lower() + " ") if t else "  " for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, lower), np.int64, len(lower))
    doc = np.repeat(np.arange(len(lower)), n)
    letter = _letters()[points]
    count = np.bincount(doc, letter, minlength=len(lower)).astype(np.int64)
    first = np.concatenate([[True], doc[1:] != doc[:-1]])
    use = letter | first | np.concatenate([[False], letter[:-1]])  # of a run of others the first only
    c, d = np.where(letter, points, 32)[use].astype(np.uint64), doc[use]
    one = c * np.uint64(0x9E3779B97F4A7C15)
    two = (one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F))) * np.uint64(0x165667B19E3779F9)
    three = (two[:-1] ^ (c[2:] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9FB21C651E98DF25)
    out = np.zeros(len(lower) * FEATURES, np.float64)
    for h, width in ((two, 1), (three, 2)):
        if len(h):
            same = d[width:] == d[:-width]
            at = (h >> np.uint64(50)).astype(np.int64)
            out += np.bincount(d[width:][same] * FEATURES + at[same], minlength=len(out))
    return out.reshape(len(lower), FEATURES), count


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1.  Up to 7 languages: every way to part them in two.  More: of random codes of
    WIDE_BITS bits (seeded), the one whose closest two words lie farthest apart."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 7:
        return np.array([[1, *p] for p in itertools.product((-1, 1), repeat=n - 1) if -1 in p]).T.astype(float)
    rng, best, far = np.random.default_rng(7), None, -1
    bits = max(WIDE_BITS, 2 * int(np.ceil(np.log2(n))) + 1)
    for _ in range(200):
        code = rng.choice((-1.0, 1.0), (n, bits))
        agree = code @ code.T
        np.fill_diagonal(agree, -bits)
        gap = (bits - agree.max()) / 2
        if gap > far and (np.abs(code.sum(0)) < n).all():
            best, far = code, gap
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    trust: np.ndarray  # bits

    def predict(self, texts: list[str | None]) -> dict:
        x, letters = features(texts)
        n = len(texts)
        if not self.languages:
            return {"lang_pred": ["und"] * n, "score": np.zeros(n), "ambiguous": np.ones(n, bool), "errors": np.zeros(n, np.int64)}
        grams = np.maximum(x.sum(1, keepdims=True), 1)
        margin = x @ self.weights / np.sqrt(grams)
        loss = np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], 1)
        best = loss.argmin(1)
        share = np.exp(-(loss - loss.min(1, keepdims=True)))
        score = 1 / share.sum(1)
        if len(self.languages) > 1:
            close = np.partition(loss, 1, 1)[:, 1] - loss.min(1) < CLOSE
        else:
            close = np.zeros(n, bool)
        none = letters == 0
        return {
            "lang_pred": np.where(none, "und", np.array(self.languages, object)[best]).tolist(),
            "score": np.where(none, 0.0, np.clip(score, 0.0, 1.0)),
            "ambiguous": close | none,
            "errors": (np.sign(margin) != self.code[best]).sum(1).astype(np.int64),
        }


def train(labelled: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with a language and a text.  What reaches the driver is one count for each
    language and hashed n-gram, however many rows there are.  No rows: a model without languages."""
    prepare(labelled.sparkSession)
    rows = labelled.select(labelled[lang].cast("string").alias("lang"), labelled[text].cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, texts = b.column(0).to_pylist(), b.column(1)
            for i, j in slices(pc.binary_length(texts).to_pylist(), SLICE, SLICE_TEXTS):
                x, _ = features(texts.slice(i, j - i).to_pylist())
                own = np.array(langs[i:j], object)
                for name in set(langs[i:j]):
                    sums[name] = sums.get(name, 0) + x[own == name].sum(0)
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(s[at])], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(run, "lang string, gram int, n double").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique())
    share = np.zeros((len(languages), FEATURES))
    share[np.searchsorted(np.array(languages, object), counts["lang"].to_numpy(object)) if languages else [], counts["gram"].to_numpy(np.int64)] = counts["n"]
    share = (share + SMOOTH) / (share + SMOOTH).sum(1, keepdims=True)
    code = codewords(len(languages))
    weights, trust = np.zeros((FEATURES, code.shape[1])), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        yes, no = share[code[:, b] > 0].mean(0), share[code[:, b] < 0].mean(0)
        weights[:, b] = np.log(yes) - np.log(no)
        trust[b] = ((yes - no) * weights[:, b]).sum()
    return Model(languages, code, weights, trust / max(trust.max(initial=0), 1e-12))


def identify(df: DataFrame, model: Model, keep=("doc_id",), text: str = "text") -> DataFrame:
    """Columns of `keep`, then lang_pred, score (0 to 1), ambiguous, and errors (bits that the codeword
    corrected), from the whole text alone.  A text that is null or has no letter is `und`, score 0."""
    prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x bits and n-grams x bits: a fixed size

    def work(texts: list[str | None]) -> dict:
        sizes = [len(t) if t else 0 for t in texts]
        parts = [shared.value.predict(texts[a:b]) for a, b in slices(sizes, SLICE, SLICE_TEXTS)]
        return {k: [y for p in parts for y in p[k]] for k in parts[0]}

    return map_texts(df, keep, text, "lang_pred string, score double, ambiguous boolean, errors bigint", work)


def held_out(doc_id: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4.  A null id: false."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows that are not held out (a null id trains nothing), then identify all rows: one row for each row of
    df.  A null text, or one without a letter, is `und`; a null lang trains nothing; repeated rows are identified alike;
    texts as near to two languages get the first by name; an empty table gives no rows."""
    one = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), df[lang].alias("lang"))
    model = train(one.filter(F.col("doc_id").isNotNull() & ~held_out()))
    return identify(one.select("doc_id", "text").withColumn("held_out", held_out()), model, ["doc_id", "held_out"])


def keep_identified(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of df whose language is found without ambiguity, with df's columns.  Null texts and those without a letter
    go; repeated rows fare alike; an empty table, or one without labels to learn from, gives no rows."""
    one = df.select(df[doc_id].alias("doc_id"), df[text].alias("text"), df[lang].alias("lang"))
    model = train(one.filter(F.col("doc_id").isNotNull() & ~held_out()))
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), df[text].cast("string").alias("__t"))
    return identify(packed, model, ["__row"], "__t").filter("not ambiguous").select("__row.*")
