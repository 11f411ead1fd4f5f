"""Byte-level BPE over a public vocabulary: speculative encoding, decoding, and prefix counts.

A list of tokens is the BPE encoding of its bytes exactly if every adjacent pair is *compatible*:
replaying both tokens' merges in rank order, no merge across the boundary would have come first.
Encoding proposes tokens by greedy longest match, checks all adjacent pairs of a batch of words at
once with numpy, and sends only the words with an incompatible pair through exact merging.

Prefix counting uses the same test the other way round: among the tokens that end at a position,
just one is compatible with the encoding of what precedes it, so a table over positions holds the
last token and the exact token count of every prefix of a word.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
#: Words that a worker's tables hold before they start afresh; bounds a worker's memory.
CACHE_WORDS = 400_000
#: Longer words take the scalar way through the prefix table.
WIDE = 48

# The pre-tokenizer's pattern, in the standard library's dialect.
SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(1)
def odd_characters() -> re.Pattern:
    """Characters on which SPLIT may differ from the tokenizer's own classes: numbers that are no digits,
    the four separators that count as white space in Python only, and what newer Unicode versions added
    or moved.  Texts with one of them are split by the library's pre-tokenizer."""
    old, runs, start = unicodedata.ucd_3_2_0.category, [], None
    for c in range(0x110001):
        ch = chr(c) if c < 0x110000 else None
        odd = ch is not None and (
            0x1C <= c <= 0x1F or (k := unicodedata.category(ch)) in ("Nl", "No", "Cn") or old(ch)[0] != k[0]
        )
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            runs.append((start, c - 1))
            start = None
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


@lru_cache(1)
def _odd_latin() -> bytes:
    return bytes(i for i in range(256) if odd_characters().match(chr(i)))


def has_odd(text: str) -> bool:
    """Has the text an odd character?  Texts within Latin-1 are asked by their bytes, which is quicker."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return odd_characters().search(text) is not None
    return len(raw.translate(None, _odd_latin())) != len(raw)


class Vocabulary:
    """Tables of one byte-level BPE file in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, ids = spec["model"], spec["model"]["vocab"]
        # The alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for t, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in t)
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.left = np.arange(size, dtype=np.int64)
        self.right = np.arange(size, dtype=np.int64)
        self.rank = np.full(size, -1, np.int64)
        pairs = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            t = ids[a + b]
            pairs.setdefault((ids[a], ids[b]), (r, t))
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, ids[a], ids[b]
        self.pairs = pairs
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.pair_key = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_rank = np.append(np.array([r for r, _ in pairs.values()], np.int64)[order], 0)
        single = np.zeros(256, np.int64)
        for i in ids.values():
            if len(self.bytes[i]) == 1:
                single[self.bytes[i][0]] = i
        self.single, self.single_list = single, single.tolist()
        # Only tokens that merging can reach are proposed: their own two parts must meet unhindered.
        made = np.flatnonzero(self.rank >= 0)
        reachable = self.compatible(self.left[made], self.right[made], self.rank[made])
        usable = set(made[reachable].tolist()) | set(single.tolist())
        self.of = {self.bytes[i]: i for i in usable}
        self.longest = max(map(len, self.of))
        # The longest token that starts with the same four bytes bounds the greedy search.
        self.reach: dict[bytes, int] = {}
        for t in self.of:
            if len(t) > 3:
                self.reach[t[:4]] = max(self.reach.get(t[:4], 4), len(t))
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({len(t) for t in self.of if len(t) <= WIDE}):
            own = [t for t in self.of if len(t) == n]
            rows = np.frombuffer(b"".join(own), np.uint8).reshape(-1, n)
            h = _hash(rows)
            o = np.argsort(h, kind="stable")
            self.by_length[n] = (h[o], np.array([self.of[t] for t in own], np.int64)[o], rows[o])
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library = None

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: does BPE keep the boundary between them?  Undo the younger of the two
        tokens until both are bytes; a cross merge older than what was undone breaks the boundary."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 39, np.int64) if limit is None else limit.copy()
        while len(live):
            broken = self.merge_rank(a, b) < limit
            good[live[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            undo_a = ra > rb
            # Of equal ranks the leftmost merge comes first, so undoing the right token admits its own rank.
            limit = np.where(undo_a, ra, rb + 1)
            a = np.where(undo_a, self.right[a], a)
            b = np.where(undo_a, b, self.left[b])
        return good

    def words(self, text: str) -> list[str]:
        """The pre-tokenizer's words of a text without special tokens."""
        if has_odd(text):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def pieces(self, text: str) -> list[str]:
        """Words of a whole text; strings of special tokens stand as pieces of their own."""
        if self.special_split is None or not any(s in text for s in self.special):
            return self.words(text)
        out: list[str] = []
        for i, part in enumerate(self.special_split.split(text)):
            if i % 2:
                out.append("\0special " + part)
            elif part:
                out += self.words(part)
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        t = self.of.get(word)
        if t is not None:
            return [t]
        out, i, n, of, reach = [], 0, len(word), self.of, self.reach
        while i < n:
            j = min(n, i + reach.get(word[i : i + 4], 3))
            while (t := of.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: lowest rank first, leftmost of equals; long words over a linked list and a heap."""
        tok = list(map(self.single_list.__getitem__, word))
        n, pairs = len(tok), self.pairs
        if n <= 32:
            none, get = (1 << 40, -1), pairs.get
            ranks = [get(x, none) for x in zip(tok, tok[1:])]
            while ranks and (best := min(ranks)) is not none:
                i = ranks.index(best)
                tok[i : i + 2] = [best[1]]
                del ranks[i]
                if i:
                    ranks[i - 1] = get((tok[i - 1], tok[i]), none)
                if i < len(ranks):
                    ranks[i] = get((tok[i], tok[i + 1]), none)
            return tok
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := pairs.get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := pairs.get((made, tok[k])):
                    heapq.heappush(heap, (m[0], i, made, tok[k], m[1]))
            if (h := before[i]) >= 0 and (m := pairs.get((tok[h], made))):
                heapq.heappush(heap, (m[0], h, tok[h], made, m[1]))
        return [t for t in tok if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of all words in a row, tokens of each, and how many words needed exact merging."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sets = [
            [self.special[w[9:]]] if w.startswith("\0special ") and w[9:] in self.special else self.propose(r)
            for w, r in zip(words, raw)
        ]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.fromiter((t for s in sets for t in s), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(sets)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        bad = inner[~self.compatible(flat[inner], flat[inner + 1])]
        failing = np.unique(owner[bad])
        if len(failing):
            for i in failing.tolist():
                sets[i] = self.merge(raw[i])
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.fromiter((t for s in sets for t in s), np.int64, int(n.sum()))
        return flat, n, len(failing)

    # prefix tables -----------------------------------------------------------------------------------------

    def prefix_counts(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For all words in a row: the exact token count at every byte prefix (1 up to the whole word), and
        the bytes of each word.  A special token counts one at its whole length, and one before."""
        raw = [
            b"\0" * len(w[9:].encode()) if w.startswith("\0special ") and w[9:] in self.special else w.encode("utf-8", "surrogatepass")
            for w in words
        ]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(start[-1]), np.int32)
        for i, w in enumerate(words):
            if w.startswith("\0special ") and w[9:] in self.special:
                out[start[i] : start[i + 1]] = 1
                n[i] = -n[i]
        for i in np.flatnonzero(n > WIDE).tolist():
            out[start[i] : start[i + 1]] = self._prefix_scalar(raw[i])
        for lo, hi in ((0, 8), (8, 16), (16, WIDE)):
            some = np.flatnonzero((n > lo) & (n <= hi))
            if len(some):
                width = int(n[some].max())
                grid = np.zeros((len(some), width), np.uint8)
                inside = np.arange(width) < n[some, None]
                grid[inside] = np.frombuffer(b"".join(raw[i] for i in some.tolist()), np.uint8)
                count = self._prefix_grid(grid, n[some])
                out[(start[some][:, None] + np.arange(width))[inside]] = count[inside]
        return out, np.abs(n)

    def _prefix_grid(self, grid: np.ndarray, n: np.ndarray) -> np.ndarray:
        rows, width = grid.shape
        rolling = np.zeros((rows, width + 1), np.uint64)
        for i in range(width):
            rolling[:, i + 1] = rolling[:, i] * _BASE + grid[:, i] + np.uint64(1)
        last = np.full((rows, width + 1), -1, np.int64)
        count = np.zeros((rows, width + 1), np.int32)
        for i in range(1, width + 1):
            open_ = np.flatnonzero(n >= i)
            for size in sorted((k for k in self.by_length if k <= i), reverse=True):
                if not len(open_):
                    break
                h, ids, texts = self.by_length[size]
                want = rolling[open_, i] - rolling[open_, i - size] * _POWERS[size]
                at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                hit = np.flatnonzero(h[at] == want)
                if not len(hit):
                    continue
                r, t = open_[hit], ids[at[hit]]
                ok = (texts[at[hit]] == grid[r, i - size : i]).all(1)
                if i > size:
                    ok &= self.compatible(last[r, i - size], t)
                r, t = r[ok], t[ok]
                last[r, i], count[r, i] = t, count[r, i - size] + 1
                open_ = np.delete(open_, hit[ok])
        return count[:, 1:]

    def _prefix_scalar(self, word: bytes) -> np.ndarray:
        n = len(word)
        last, count = np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int32)
        verdicts: dict[tuple[int, int], bool] = {}
        for i in range(1, n + 1):
            for size in range(min(i, self.longest), 0, -1):
                t = self.of.get(word[i - size : i])
                if t is None:
                    continue
                if size < i:
                    key = (int(last[i - size]), t)
                    if key not in verdicts:
                        verdicts[key] = bool(self.compatible(np.array([key[0]]), np.array([t]))[0])
                    if not verdicts[key]:
                        continue
                last[i], count[i] = t, count[i - size] + 1
                break
        return count[1:]

    def decode(self, ids: np.ndarray) -> str:
        """What the library's decoder returns with special tokens kept."""
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(WIDE + 1, _BASE, np.uint64)]), dtype=np.uint64)


def _hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        h = h * _BASE + rows[:, i] + np.uint64(1)
    return h


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Index(dict):
    """word -> number; new words get the next number and wait in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


class Cached:
    """Values of a varying length for each distinct word, worked out once for a batch of new words."""

    def __init__(self, vocab: Vocabulary, fill):
        self.vocab, self.fill = vocab, fill
        self.clear()

    def clear(self) -> None:
        self.index = _Index()
        self.pool = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row, and the words of each text."""
        if len(self.index) > CACHE_WORDS:
            self.clear()
        pieces = [self.vocab.pieces(t) if t else [] for t in texts]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        get = self.index.__getitem__
        words = np.concatenate([np.zeros(0, np.int64), *[np.fromiter(map(get, p), np.int64, len(p)) for p in pieces]])
        if self.index.new:
            flat, size = self.fill(self.index.new)[:2]
            self.start = np.concatenate([self.start, len(self.pool) + np.concatenate([[0], np.cumsum(size)[:-1]])])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, flat.astype(np.int32)])
            self.index.new = []
        return words, n

    def values(self, words: np.ndarray) -> np.ndarray:
        """The values of the given words in a row."""
        size = self.size[words]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.pool[np.repeat(self.start[words] - end + size, size) + np.arange(total)]


@lru_cache(4)
def encoder(path: str) -> Cached:
    v = vocabulary(path)
    return Cached(v, v.encode_words)


@lru_cache(4)
def prefix_table(path: str) -> Cached:
    v = vocabulary(path)
    return Cached(v, v.prefix_counts)


def encode_batch(texts: list[str | None], path: str) -> list[np.ndarray]:
    """Token ids (uint32) of each text; null as an empty text."""
    e = encoder(path)
    words, n = e.look_up([t or "" for t in texts])
    ids = e.values(words).astype("<u4")
    per_word = np.concatenate([[0], np.cumsum(e.size[words])])
    cuts = per_word[np.concatenate([[0], np.cumsum(n)])]
    return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
