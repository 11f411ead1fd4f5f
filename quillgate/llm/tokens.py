"""Operators 1 and 10: BPE encoding and decoding, and exact token counts at every prefix."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .runtime import map_texts


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(
    df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """The columns of `keep`, then n_tokens long and ids array<int>, for each row; no shuffle.

    Ids equal those of the tokenizers library without added special tokens; strings of special tokens
    inside a text become their ids, as by the library's default.  Null and empty texts have no ids.
    Texts are taken whole however long; repeated rows and other columns don't matter.
    """
    path = vocabulary or bpe.default_vocabulary()

    def work(texts: list[str | None]) -> dict:
        ids = bpe.encode_batch(texts, path)
        return {"n_tokens": [len(x) for x in ids], "ids": _list_array(ids)}

    return map_texts(df, keep, text, "n_tokens bigint, ids array<int>", work)


def decode(
    df: DataFrame, keep: Iterable[str] = ("doc_id",), ids: str = "ids", vocabulary: str | None = None
) -> DataFrame:
    """The columns of `keep`, then the text that the ids stand for, special tokens kept.  Null ids decode to
    an empty text; bytes that form no character become U+FFFD.  Repeated rows decode alike; an empty table gives no rows."""
    path = vocabulary or bpe.default_vocabulary()
    keep = list(keep)
    kept = df.select(*keep, df[ids].cast("array<int>").alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = bpe.vocabulary(path)
        for b in batches:
            texts = [v.decode(np.array(x or [], np.int64)) for x in b.column(len(keep)).to_pylist()]
            cols = [*(b.column(i) for i in range(len(keep))), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "text"])

    return kept.mapInArrow(run, f"{schema}, text string" if schema else "text string")


def round_trip(
    df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """Encode and decode every text in one pass; n_tokens, and SHA-256 (lowercase hex) of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8.  A null text is an empty one; repeated rows
    give equal rows; an empty table gives no rows."""
    path = vocabulary or bpe.default_vocabulary()

    def work(texts: list[str | None]) -> dict:
        v, ids = bpe.vocabulary(path), bpe.encode_batch(texts, path)
        return {
            "n_tokens": [len(x) for x in ids],
            "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids],
        }

    return map_texts(df, keep, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", work)


class PrefixCounts:
    """Exact token counts of the prefixes of one text, from the prefix table and without re-encoding.

    Positions are bytes of the text in UTF-8 within, characters in `at` and `fit`.  `words` are the text's word
    numbers in the table; they are copied out of it, as later look-ups may empty the table.
    """

    def __init__(self, text: str, vocabulary: str | None = None, words: np.ndarray | None = None):
        self.raw = text.encode("utf-8", "surrogatepass")
        self.table = bpe.prefix_table(vocabulary or bpe.default_vocabulary())
        if words is None:
            words, _ = self.table.look_up([text])
        self.size = self.table.size[words]
        self.values = self.table.values(words)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.before = np.concatenate([[0], np.cumsum(self.values[self.start[1:] - 1])]).astype(np.int64) if len(words) else np.zeros(1, np.int64)

    def _exact(self, byte: int) -> int:
        """Tokens of the text's first bytes.  Only the last two words before the cut can be split otherwise than in
        the whole text; their counts come from the table."""
        if byte <= 0:
            return 0
        if byte >= len(self.raw):
            return int(self.before[-1])
        i = max(0, int(np.searchsorted(self.start, byte, "left")) - 2)
        tail, _ = self.table.look_up([self.raw[int(self.start[i]) : byte].decode("utf-8", "surrogatepass")])
        ends = self.table.start[tail] + self.table.size[tail] - 1
        return int(self.before[i] + self.table.pool[ends].sum())

    def _byte(self, chars: int) -> int:
        """The byte at which a character starts."""
        return len(self.raw.decode("utf-8", "surrogatepass")[:chars].encode("utf-8", "surrogatepass"))

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        return self._exact(self._byte(chars)) if chars > 0 else 0

    def fit_bytes(self, budget: int) -> int:
        """Bytes of the longest prefix, in whole characters, of at most `budget` tokens.

        The table's entries are exact inside words of letters or digits.  A cut inside other words may split contractions
        and strings of special tokens otherwise, up to their thirteenth character, and white space may join with
        the space that starts the next word; there the cut is counted anew.
        """
        if self.before[-1] <= budget:
            return len(self.raw)
        w = int(np.searchsorted(self.before, max(budget, 0), "right")) - 1
        at = int(self.start[w + 1])
        if self._blank(w):  # it may join with the start of the next word
            at = self._back(at, 2)
        while at > 0:
            i = int(np.searchsorted(self.start, at, "left")) - 1
            begin, end = int(self.start[i]), int(self.start[i + 1])
            sure = self._sure_from(i, begin, end)
            if at > sure:
                lead = np.frombuffer(self.raw[sure + 1 : at + 1] + (b"a" if at == len(self.raw) else b""), np.uint8) & 0xC0 != 0x80
                good = np.flatnonzero((self.values[sure:at] <= budget - int(self.before[i])) & lead)
                if len(good):
                    return sure + 1 + int(good[-1])
                at = sure
                while at > 0 and self.raw[at] & 0xC0 == 0x80:
                    at -= 1
                continue
            if self._exact(at) <= budget:
                return at
            at -= 1
            while at > 0 and self.raw[at] & 0xC0 == 0x80:
                at -= 1
        return 0

    def _blank(self, i: int) -> bool:
        return i >= 0 and self.raw[int(self.start[i]) : int(self.start[i + 1])].decode("utf-8", "surrogatepass").isspace()

    def _sure_from(self, i: int, begin: int, end: int) -> int:
        """Cuts of word i beyond this byte count as the table says."""
        space = self.raw[begin : begin + 1] == b" "
        first = self.raw[begin + space : begin + space + 4].decode("utf-8", "ignore")[:1]
        if first.isalnum():
            return begin + 1 if space and self._blank(i - 1) else begin
        return end if self.raw[begin:end].startswith(b"<|") else min(begin + 12, end)

    def _back(self, byte: int, chars: int) -> int:
        """The end of so many characters from a byte on."""
        for _ in range(chars):
            if byte < len(self.raw):
                byte += 1
                while byte < len(self.raw) and self.raw[byte] & 0xC0 == 0x80:
                    byte += 1
        return byte

    def fit(self, budget: int) -> int:
        """The most characters that a prefix of at most `budget` tokens has."""
        return len(self.raw[: self.fit_bytes(budget)].decode("utf-8", "surrogatepass"))


def prefix_tokens(
    df: DataFrame, lengths: str, keep: Iterable[str] = ("doc_id",), text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """The columns of `keep`, then n_tokens array<bigint>: the exact counts of the text's prefixes of so many
    characters as column `lengths` (array<int>) asks for, in its order.

    Lengths under 0 count as 0, over the text's as the whole text, null lengths give null.  A null text counts as an
    empty one, null lengths as none.  No text is encoded; no shuffle.
    """
    path, keep = vocabulary or bpe.default_vocabulary(), list(keep)
    kept = df.select(*keep, df[text].cast("string").alias("__text"), df[lengths].cast("array<int>").alias("__at"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, asked in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist()):
                p = PrefixCounts(t or "", path)
                out.append([None if n is None else p.at(n) for n in asked or []])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(out, pa.list_(pa.int64()))], names=[*keep, "n_tokens"])

    return kept.mapInArrow(run, f"{schema}, n_tokens array<bigint>" if schema else "n_tokens array<bigint>")


def count(
    df: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", limit: int = 1024, vocabulary: str | None = None
) -> DataFrame:
    """Exact counts of whole texts from the prefix table: n_bytes (UTF-8), n_tokens, over_limit
    (n_tokens > limit), and fit_bytes, the bytes of the longest prefix in whole characters of at most `limit` tokens.

    Null and empty texts count zero.  Texts are taken whole; repeated rows count alike; no shuffle.
    """
    path = vocabulary or bpe.default_vocabulary()

    def work(texts: list[str | None]) -> dict:
        table = bpe.prefix_table(path)
        words, n = table.look_up([t or "" for t in texts])
        last = table.pool[table.start[words] + table.size[words] - 1].astype(np.int64)
        tokens = np.concatenate([[0], np.cumsum(last)])
        size = np.concatenate([[0], np.cumsum(table.size[words])])
        cut = np.concatenate([[0], np.cumsum(n)])
        total, n_bytes = tokens[cut[1:]] - tokens[cut[:-1]], size[cut[1:]] - size[cut[:-1]]
        fit = n_bytes.copy()
        over = np.flatnonzero(total > limit).tolist()
        # All are made before the first is asked: asking may empty the table.
        known = [PrefixCounts(texts[i], path, words[cut[i] : cut[i + 1]]) for i in over]
        for i, p in zip(over, known):
            fit[i] = p.fit_bytes(limit)
        return {"n_bytes": n_bytes, "n_tokens": total, "over_limit": total > limit, "fit_bytes": fit}

    return map_texts(df, keep, text, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_bytes bigint", work)


def truncate(
    df: DataFrame, budget: int, keep: Iterable[str] = ("doc_id",), text: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """The columns of `keep`, then fit_text: the longest prefix of each text of at most `budget` tokens, in whole
    characters.  A null text gives an empty one; no text is encoded; no shuffle."""
    path = vocabulary or bpe.default_vocabulary()

    def work(texts: list[str | None]) -> dict:
        return {"fit_text": [t[: PrefixCounts(t, path).fit(budget)] if t else "" for t in texts]}

    return map_texts(df, keep, text, "fit_text string", work)
