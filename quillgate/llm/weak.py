"""Operator 6: a quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text.  Expectation-maximisation over the counts of
all vote patterns (at most 3 to the number of labellers, however many texts) estimates each labeller's accuracy on
good texts and on several kinds of bad ones, and the kinds' shares.  The posteriors of the patterns then label a bounded sample of distinct
texts, on which a linear scorer over hashed character-shape n-grams is trained; it scores every whole text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import SPACE, SYMBOLS, _repeated
from .runtime import cut, map_texts, prepare, slices

#: Hashed features; texts of the training sample at most (about); score from which a text is kept.
FEATURES, SAMPLE, KEEP = 2048, 4000, 0.5
ROUNDS, STEPS, RATE, DECAY = 200, 300, 2.0, 1e-4
#: Kinds of texts that the model tells apart at most, good ones and several ways of being bad.
KINDS = 6


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, minlength=n)


def words_of(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray]:
    """Words of each text, and of each text the number of words that equal the word before."""
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    return words, np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words], np.float64)


def votes(texts: list[str | None], words: list[list[bytes]] | None = None, again: np.ndarray | None = None) -> np.ndarray:
    """texts x labellers: 1 good, -1 bad, 0 no opinion."""
    if words is None:
        words, again = words_of(texts)
    n = np.fromiter(map(len, words), np.int64, len(words))
    some = np.maximum(n, 1)
    size = np.array([len(t) if t else 0 for t in texts])
    kinds = np.zeros((len(texts), 6))  # of each text: its capitals, letters, symbols, spaces
    for a, b in slices(size.tolist(), 500_000, 512):
        code = _shape()[np.frombuffer("".join(t or "" for t in texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        doc = np.repeat(np.arange(b - a), size[a:b])
        for i, hit in enumerate((code == 2, (code == 1) | (code == 2), _IS_SYMBOL[code], (code == 4) | (code == 5))):
            kinds[a:b, i] = _sums(doc, hit, b - a)
    chars = np.maximum(size - kinds[:, 3], 1)
    symbols, upper = kinds[:, 2] / chars, kinds[:, 0] / np.maximum(kinds[:, 1], 1)
    flat = [w for x in words for w in x]
    doc = np.repeat(np.arange(len(words)), n)
    last = np.frombuffer(b"".join(w[-1:] for w in flat), np.uint8)
    marks, loud = _sums(doc, _IS_MARK[last], len(words)) / some, _sums(doc, last == ord("!"), len(words)) / some
    # Words that are a lone mark or end in a symbol.
    lone = _sums(doc, ((np.fromiter(map(len, flat), np.int64, len(flat)) == 1) & ~_IS_ALNUM[last]) | _IS_SYMBOL[10 + last.astype(np.int64)], len(words)) / some
    again = again / some
    windows = _repeated(words, 8) / some
    mean = chars / some

    def vote(good, bad):
        return np.where(bad, -1, np.where(good, 1, 0))

    out = np.stack(
        [
            vote(n >= 20, n < 5),
            vote(symbols < 0.01, symbols > 0.05),
            vote(lone < 0.02, lone > 0.1),
            vote(upper < 0.25, upper > 0.5),
            vote(again < 0.03, again > 0.2),
            vote((marks > 0.02) & (marks < 0.4) & (loud < 0.1), (marks > 0.6) | (loud > 0.3)),
            vote(windows < 0.1, windows > 0.3),
            vote((mean > 3) & (mean < 8), (mean < 2) | (mean > 15)),
        ],
        1,
    )
    return np.where(n[:, None] > 0, out, -1)


def _fit(patterns: np.ndarray, counts: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation from a first guess (patterns x kinds): log likelihood, shares, for each kind and
    labeller the rate of good votes among its votes, and the kinds' weights.  One vote of each sort is added to every count."""
    said, good = (patterns != 0).astype(float), (patterns > 0).astype(float)
    for _ in range(ROUNDS):
        w = counts[:, None] * share
        weight = (w.sum(0) + 1) / (counts.sum() + share.shape[1])
        rate = (w.T @ good + 1) / (w.T @ said + 2)
        at = np.log(weight) + good @ np.log(rate).T + (said - good) @ np.log(1 - rate).T
        top = at.max(1, keepdims=True)
        whole = top + np.log(np.exp(at - top).sum(1, keepdims=True))
        new, share = share, np.exp(at - whole)
        if np.abs(new - share).max() < 1e-9:
            break
    return float((counts * whole[:, 0]).sum()), share, rate, weight


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of `good` for each pattern, each labeller's accuracies on good and on bad texts, share of good.

    A latent-class model: good texts and up to KINDS - 1 other kinds, as each labeller may know a way of being bad that
    the others do not; how many there are is settled by the Bayesian criterion.  The majority names the kinds: a kind
    is bad if some labeller calls most of its texts bad.  Nothing else ties the estimates.  If all are bad by that, the
    kind with most good votes is the good one.
    """
    said, good = patterns != 0, patterns > 0
    total = counts.sum()
    seeds, best = [int(counts.argmax())], None
    for kinds in range(1, KINDS + 1):
        far = np.abs(patterns[:, None, :] - patterns[None, seeds, :]).sum(2)
        # Starts: nearness to the seeds; the same, with bad votes leading away from the first; the plain majority.
        away = far + np.where(np.arange(kinds) == 0, 4 * (said & ~good).any(1)[:, None], 0)
        starts = [np.exp(-far.astype(float)), np.exp(-away.astype(float))]
        if kinds == 2:
            starts.append(np.stack([good.sum(1) + 1, (said & ~good).sum(1) + 1], 1).astype(float))
        for start in starts:
            fit = _fit(patterns, counts, start / start.sum(1, keepdims=True))
            score = fit[0] - 0.5 * (kinds - 1 + kinds * patterns.shape[1]) * np.log(max(total, 2))
            if best is None or score > best[0]:
                best = (score, *fit[1:])
        gain = counts * far.min(1)
        if gain.max() <= 0:
            break
        seeds.append(int(gain.argmax()))
    _, share, rate, weight = best
    fine = (rate >= 0.5).all(1)
    if not fine.any():
        fine[rate.mean(1).argmax()] = True
    posterior = share[:, fine].sum(1)
    w, v = counts * posterior, counts * (1 - posterior)
    right = np.stack([((w[:, None] * (said & good)).sum(0) + 1) / ((w[:, None] * said).sum(0) + 2), ((v[:, None] * (said & ~good)).sum(0) + 1) / ((v[:, None] * said).sum(0) + 2)])
    return posterior, right, float(w.sum() / total)


@lru_cache(1)
def _shape() -> np.ndarray:
    """Character classes: lower and other letters, capitals, digits, space, line feed; marks stand for themselves."""
    out = np.full(0x110000, 7, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if c < 128 and not ch.isalnum():
            out[c] = 10 + c
        elif ch.isalpha():
            out[c] = 1 if not ch.isupper() else 2
        elif ch.isdigit():
            out[c] = 3
    out[[9, 11, 12, 13, 32]] = 4
    out[10] = 5
    return out


# Marks at words' ends that labellers look at.
MARKS = ".,!?;:"
_IS_MARK, _IS_ALNUM, _IS_SYMBOL = (np.zeros(n, bool) for n in (256, 256, 266))
_IS_MARK[[ord(c) for c in MARKS]] = True
_IS_ALNUM[[c for c in range(128) if chr(c).isalnum()]] = True
_IS_SYMBOL[[10 + ord(c) for c in SYMBOLS]] = True  # by character class


def shapes(texts: list[str | None], words: list[list[bytes]] | None = None, again: np.ndarray | None = None) -> np.ndarray:
    """texts x FEATURES: square roots of the shares of hashed shape pairs and triples (runs of a class, cut at two),
    and of words that equal the word before."""
    if words is None:
        words, again = words_of(texts)
    out = np.zeros((len(texts), FEATURES), np.float32)
    for a, b in slices([len(t) if t else 0 for t in texts], 500_000, 512):
        lines = [t or "" for t in texts[a:b]]
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        c = _shape()[np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.int64)
        doc = np.repeat(np.arange(len(lines)), n)
        fresh = np.ones(len(c), bool)
        fresh[2:] = (c[2:] != c[1:-1]) | (c[1:-1] != c[:-2]) | (doc[2:] != doc[:-2])
        c, doc = c[fresh], doc[fresh]
        for width in (2, 3):
            if len(c) < width:
                continue
            h = c[: len(c) - width + 1] * 0
            for k in range(width):
                h = h * 1_000_003 + c[k : len(c) - width + 1 + k]
            at = ((h * 0x9E3779B1) >> 7) % (FEATURES - 8)
            same = doc[width - 1 :] == doc[: len(doc) - width + 1]
            grid = np.bincount(doc[width - 1 :][same] * FEATURES + at[same], minlength=len(lines) * FEATURES).reshape(len(lines), FEATURES)
            out[a:b] += grid / np.maximum(grid.sum(1, keepdims=True), 1)
    n = np.fromiter(map(len, words), np.int64, len(words))
    out[:, FEATURES - 1] = 4 * again / np.maximum(n, 1)
    out[:, FEATURES - 2] = 1 / (1 + n)
    return np.sqrt(out)


def train(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Weights and, last, the bias of a logistic scorer on soft labels.  Both classes weigh alike if each has a text's
    worth of labels; of a class with less the weight fades."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    weight = good / max(good.sum(), 1.0) + (1 - good) / max((1 - good).sum(), 1.0)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        speed = 0.9 * speed - RATE * (x.T @ (weight * (p - good)) + DECAY * w)
        w = w + speed
    return w


def score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, label (posterior of the votes), score (0 to 1), kept.

    Null and wordless texts score 0 and go.  Repeated rows score alike, and count once in the training sample; an
    empty table gives no rows.  If no text has a word, there is nothing to train on and the posteriors are the scores.
    """
    prepare(df.sparkSession)
    spark = df.sparkSession
    one = df.select(df[doc_id].alias("doc_id"), df[text].cast("string").alias("text"))

    codes_of = lambda texts, *parts: ((votes(texts, *parts) + 1) * 3 ** np.arange(8)).sum(1)

    def in_parts(work):
        """`work` on a few texts at a time: their words and features are what fills a worker's memory."""

        def run(texts):
            done = [work(texts[a:b]) for a, b in slices([len(t) if t else 0 for t in texts], 500_000, 512)]
            return {k: np.concatenate([d[k] for d in done]) for k in done[0]} if done else work([])

        return run

    voted = cut(map_texts(one.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], "text", "pattern bigint", in_parts(lambda texts: {"pattern": codes_of(texts)})))
    rows = voted.groupBy("pattern").count().collect()  # 3**8 rows at most
    if not rows:
        return one.select("doc_id", F.lit(0.0).alias("label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    codes = np.array([r[0] for r in rows])
    share, _, _ = estimate(codes[:, None] // 3 ** np.arange(8) % 3 - 1, np.array([r[1] for r in rows], float))
    posterior = dict(zip(codes.tolist(), share.tolist()))
    # About SAMPLE distinct texts whatever the corpus, drawn by a hash of the text; the rest of the hash orders them.
    distinct = voted.select("h").distinct().count()
    most = (1 << 63) - 1
    limit = most if distinct <= SAMPLE else most // distinct * SAMPLE
    sample = one.filter((F.shiftrightunsigned(F.xxhash64("text"), 1) <= limit) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")).dropDuplicates(["text"])

    def draw(texts):
        parts = words_of(texts)
        return {"x": list(shapes(texts, *parts)), "pattern": codes_of(texts, *parts)}

    drawn = map_texts(sample.withColumn("one", F.lit(1)), ["one"], "text", "x array<float>, pattern bigint", draw).toArrow()
    x = drawn.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    good = np.array([posterior[p] for p in drawn.column("pattern").to_pylist()])
    model = spark.sparkContext.broadcast((train(x, good) if len(x) else None, posterior))

    def judge(texts):
        w, known = model.value
        parts = words_of(texts)
        label = np.array([known[p] for p in codes_of(texts, *parts).tolist()])
        s = label if w is None else 1 / (1 + np.exp(-np.clip(shapes(texts, *parts) @ w[:-1].astype(np.float32) + w[-1], -60, 60)))
        s = np.where(np.array([bool(x) for x in parts[0]], bool), s, 0.0)
        return {"label": label, "score": s, "kept": s >= KEEP}

    return map_texts(one, ["doc_id"], "text", "label double, score double, kept boolean", in_parts(judge))
