"""A small algebra of text predicates that compiles to a Spark Column or to DuckDB SQL.

Detectors are data: words, substrings and patterns joined by and, or, not.  One alternation per list keeps each
predicate a single pass.  Every pattern names literals of which a match must hold one; a single automaton looks for all
literals of all rules in one pass over a batch of texts, and a pattern runs only on texts that hold one of its own.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache, wraps

import ahocorasick
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.session import prepare

_ATOM = re.compile(r"\\[dDsSwWbB]|\\.|\[(?:\\.|[^\]\\])*\]|\(\?<[=!]|\(\?[=!]|\(\?[a-zA-Z-]+\)|\(\?(?:[a-zA-Z-]*:)|\(|\)|\||[*+?]|\{\d*,?\d*\}|.", re.S)


_PRIVATE = re.compile("[\ue000-\uf8ff]")
#: Texts that are Python strings at a time.
_TEXTS = 256


@lru_cache(None)
def triggers(pattern: str) -> frozenset[str] | None:
    """Lower-case literals of which every match of the pattern holds at least one; None if there are none.

    `contains` over a few literals is far cheaper than the pattern, and most texts hold none of them.
    """
    atoms = _ATOM.findall(pattern)
    found, end = _needed(atoms, 0)
    if end != len(atoms):
        raise ValueError(f"unbalanced pattern: {pattern}")
    return found


def _better(a: frozenset | None, b: frozenset | None) -> frozenset | None:
    """The set whose shortest literal is longer; of those alike the smaller."""
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))


def _needed(atoms: list[str], i: int) -> tuple[frozenset[str] | None, int]:
    """Literals needed by the alternatives from place i on, up to the parenthesis that closes them."""
    branches: list[frozenset | None] = []
    best, run = None, ""

    def flush() -> None:
        nonlocal best, run
        if len(run) > 1 or (run and ord(run[0]) > 127):
            best = _better(best, frozenset([run]))
        run = ""

    while i < len(atoms) and atoms[i] != ")":
        atom, inner, group = atoms[i], None, False
        i += 1
        if atom == "|":
            flush()
            branches.append(best)
            best = None
            continue
        if atom.startswith("(") and not atom.endswith(")"):
            inner, i = _needed(atoms, i)
            i += 1
            group = True
            if atom[:3] in ("(?=", "(?!", "(?<"):
                inner = None
        # What may be left out is not needed; a repeated literal ends its run.
        quantifier = atoms[i] if i < len(atoms) and (atoms[i] in ("*", "+", "?") or re.fullmatch(r"\{\d*,?\d*\}", atoms[i])) else ""
        if quantifier:
            i += 1
            if i < len(atoms) and atoms[i] in ("?", "+"):
                i += 1
        optional = quantifier in ("*", "?") or quantifier.startswith(("{0", "{,"))
        literal = atom[1:] if len(atom) == 2 and atom[0] == "\\" and not atom[1].isalnum() else atom if len(atom) == 1 and atom not in ".^$" else ""
        if literal and not quantifier:
            run += literal.lower()
            continue
        flush()
        if literal and not optional:
            run = literal.lower()
            flush()
        if group and not optional:
            best = _better(best, inner)
    flush()
    branches.append(best)
    return (frozenset().union(*branches) if all(branches) else None), i


def _least(words: Iterable[str]) -> list[str]:
    """Without literals that hold another one: they ask nothing new."""
    return sorted(w for w in words if not any(o != w and o in w for o in words))


class Hits:
    """The literals of many patterns, and columns that tell which of them a text holds."""

    def __init__(self, patterns: Iterable[str]):
        self.words = sorted({w for p in patterns for w in _least(triggers(p) or ())})
        self.place = {w: i for i, w in enumerate(self.words)}

    def read(self, text: Column, looks: tuple[str, str]) -> Column:
        """struct<folded, hits> of cleaned texts: the compatibility form of those beyond ASCII, its look-alike letters replaced, and
        places of the literals that its lower-cased form holds; null for null.  Both come from one Python worker.

        Private-use signs are passed over, so that hits hold for the text with and without them."""
        prepare()
        words, letters, alike = tuple(self.words), str.maketrans(dict(zip(*looks))), re.compile(f"[{looks[0]}]")

        def one(t: str) -> tuple[str | None, list[int]]:
            folded = None if t.isascii() else unicodedata.normalize("NFKC", t)
            if folded is not None and alike.search(folded):
                folded = folded.translate(letters)
            low = (t if folded is None else _PRIVATE.sub("", folded)).lower()
            return folded, sorted({i for _, held in _machine(words).iter(low) for i in held})

        @F.arrow_udf("folded string, hits array<smallint>")
        def found(texts: pa.Array) -> pa.Array:
            parts = []
            for at in range(0, len(texts), _TEXTS):
                rows = [(None, None) if t is None else one(t) for t in texts[at : at + _TEXTS].to_pylist()]
                folded, hits = [r[0] for r in rows], [r[1] for r in rows]
                parts.append(pa.StructArray.from_arrays([pa.array(folded, pa.string()), pa.array(hits, pa.list_(pa.int16()))], ["folded", "hits"]))
            return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("folded", pa.string()), ("hits", pa.list_(pa.int16()))]))

        return found(text)

    def every(self) -> Column:
        """The places of all literals, for texts that were not looked through: all patterns run on these."""
        return F.expr("array(" + ", ".join(f"{i}S" for i in range(len(self.words))) + ")")

    def may_match(self, hits: Column, pattern: str) -> Column | None:
        words = triggers(pattern)
        if not words:
            return None
        places = ", ".join(f"{self.place[w]}S" for w in _least(words))
        return F.arrays_overlap(hits, F.expr(f"array({places})"))  # one call to the JVM, not two a word


def once(build):
    """A function of plain arguments that builds columns, called once for each Spark context and arguments.

    A column is many calls to the JVM; hundreds of patterns are tens of thousands, some seconds for each query anew.
    Columns name their inputs and so serve every table that has these.
    """
    held: dict = {}

    @wraps(build)
    def columns(*args):
        context = SparkContext._active_spark_context
        if held.get("context") is not context:
            held.clear()
            held["context"] = context
        if args not in held:
            held[args] = build(*args)
        return held[args]

    return columns


@lru_cache(4)
def _machine(words: tuple[str, ...]):
    """An Aho-Corasick automaton; each of its words gives its place and those of the words within it."""
    machine = ahocorasick.Automaton()
    for i, w in enumerate(words):
        machine.add_word(w, (i,))
    machine.make_automaton()
    return machine


def _escape(phrase: str) -> str:
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", phrase)


@dataclass(frozen=True)
class Match:
    """A pattern on `text` or `lower`.  `re2` is the pattern for engines without look-around, where that
    finds matches in the same texts; None if there is no such pattern."""

    pattern: str
    on: str = "text"
    re2: str | None = None

    def column(self, cols: dict) -> Column:
        """cols: text, lower, hits (a column of Hits.find) and rules (its Hits)."""
        hit, gate = cols[self.on].rlike("(?Ud)" + self.pattern), cols["rules"].may_match(cols["hits"], self.pattern)
        return hit if gate is None else gate & hit

    def patterns(self) -> list[str]:
        return [self.pattern]

    def sql(self, cols: dict[str, str]) -> str:
        p = self.re2 if self.re2 is not None else self.pattern
        return f"regexp_matches({cols[self.on]}, '{p.replace(chr(39), chr(39) * 2)}')"


@dataclass(frozen=True)
class Join:
    kind: str  # "AND", "OR"
    parts: tuple

    def column(self, cols):
        out = self.parts[0].column(cols)
        for p in self.parts[1:]:
            out = (out & p.column(cols)) if self.kind == "AND" else (out | p.column(cols))
        return out

    def patterns(self) -> list[str]:
        return [x for p in self.parts for x in p.patterns()]

    def sql(self, cols):
        return "(" + f" {self.kind} ".join(p.sql(cols) for p in self.parts) + ")"


@dataclass(frozen=True)
class Not:
    part: object

    def column(self, cols):
        return ~self.part.column(cols)

    def patterns(self) -> list[str]:
        return self.part.patterns()

    def sql(self, cols):
        return f"(NOT {self.part.sql(cols)})"


def phrases(words: list[str]) -> Match:
    """Any of the phrases between neighbours that are no ASCII letters or digits, ignoring case."""
    alternatives = "|".join(_escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return bounded(f"(?:{alternatives})")


def bounded(pattern: str, on: str = "lower") -> Match:
    return Match(f"(?<![a-z0-9]){pattern}(?![a-z0-9])", on, f"(?:^|[^a-z0-9]){pattern}(?:[^a-z0-9]|$)")


def substrings(words: list[str], on: str = "text") -> Match:
    return Match("|".join(map(_escape, words)), on)


def pattern(p: str, on: str = "text", re2: str | None = None) -> Match:
    return Match(p, on, re2)


def patterns(ps: list[str], on: str = "text") -> Match:
    return Match("|".join(f"(?:{p})" for p in ps), on)


def any_of(*parts) -> Join:
    return Join("OR", tuple(parts))


def all_of(*parts) -> Join:
    return Join("AND", tuple(parts))


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with the columns, worked out once for each row.

    A generator of one row keeps the optimiser from copying the expressions into every place that names them and
    from pushing filters on them below, which would multiply hundreds of patterns.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
