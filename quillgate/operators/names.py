"""File names for captures: the first free one of a slug, whatever came before, without a task that holds a slug.

Captures come in order.  Each takes its slug, or else the slug with the least number from 2 on that is free; free is what no
log names and no earlier capture took.  A slug that itself looks like a numbered one (`a_2` beside `a`) competes with it:
whoever comes first has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import equal_keys
from .lineage import cut
from .numbering import number_within

_c = F.col
_KEY = ["issue", "slug"]
_NUMBERED = r"^(.+)_([2-9]|[1-9][0-9]{1,8})$"


def _parts(stem: Column) -> list[Column]:
    """The slug and number that a stem is of, if it ends in one."""
    found = stem.rlike(_NUMBERED)
    return [F.when(found, F.regexp_extract(stem, _NUMBERED, 1)).alias("slug"), F.when(found, F.regexp_extract(stem, _NUMBERED, 2).cast("long")).alias("n")]


def _on(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which nulls are equal; the right side's keys go."""
    names = [f"__{k}" for k in keys]
    other = right.select(*[_c(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    return left.join(other, equal_keys(keys, names), how).drop(*names)


def _places(captures: DataFrame, blocked: DataFrame) -> DataFrame:
    """captures (issue, slug, at, k: their rank in their slug) with `number`: the k-th number from 1 that is not blocked.

    The j-th blocked number b has b - j free ones before it, so it lies before the captures of a higher rank; a capture's
    place among captures and blocked numbers is its number."""
    ranked = number_within(blocked.select(*_KEY, "n"), _KEY, "n", "j")
    none = F.lit(None).cast(dict(captures.dtypes)["at"])
    rows = captures.select(*_KEY, "at", (_c("k") * 2).alias("key")).unionByName(ranked.select(*_KEY, none.alias("at"), ((_c("n") - _c("j")) * 2 + 1).alias("key")))
    return number_within(rows, _KEY, "key", "number").filter(F.pmod("key", F.lit(2)) == 0).select(*_KEY, "at", "number")


def _blocked_below(probes: DataFrame, blocked: DataFrame) -> DataFrame:
    """probes (issue, slug, n) with `below`: how many numbers under n are blocked."""
    alone = number_within(probes.select(*_KEY, "n"), _KEY, "n", "rank")
    both = probes.select(*_KEY, (_c("n") * 2).alias("key")).unionByName(blocked.select(*_KEY, (_c("n") * 2 + 1).alias("key")))
    among = number_within(both, _KEY, "key", "place").filter(F.pmod("key", F.lit(2)) == 0).select(*_KEY, (_c("key") / 2).cast("long").alias("n"), "place")
    return _on(alone, among, [*_KEY, "n"], "inner").select(*_KEY, "n", (_c("place") - _c("rank")).alias("below"))


def free_names(captures: DataFrame, taken: DataFrame) -> DataFrame:
    """captures (issue, slug, at) with `stem`, the name that each takes in the order of `at`, a number that no two of an
    issue share.  taken (issue, stem): names that are not free.  Null issues are one issue; no captures give no rows.

    Who has a name for which two slugs compete is found in rounds, from all such names at once: each round settles at least
    those that depend on settled ones only, and the rounds end when nothing changes.
    """
    rows = cut(number_within(captures.select(*_KEY, "at"), _KEY, "at", "k"))
    logged = cut(taken.select("issue", "stem").distinct())
    slugs = rows.groupBy(*_KEY).agg(F.min("at").alias("first"))
    by_number = logged.select("issue", *_parts(_c("stem"))).filter("n is not null")
    by_base = _on(slugs.select(*_KEY), logged.select("issue", _c("stem").alias("slug")), _KEY, "left_semi").withColumn("n", F.lit(1).cast("long"))
    fixed = cut(_on(by_number, slugs.select(*_KEY), _KEY, "left_semi").unionByName(by_base))
    # A slug that is another one's numbered name, and that no log has.
    rivals = slugs.select("issue", _c("slug").alias("child"), "first", *_parts(_c("slug"))).filter("n is not null")
    rivals = _on(rivals, slugs.select(*_KEY), _KEY, "left_semi")
    rivals = cut(_on(rivals, fixed.select(*_KEY, "n"), [*_KEY, "n"], "left_anti").withColumn("child_has", F.lit(True)))
    contested = not rivals.isEmpty()
    while True:
        won = rivals.filter("child_has").select(*_KEY, "n")
        lost = rivals.filter("not child_has").select("issue", _c("child").alias("slug"), F.lit(1).cast("long").alias("n"))
        blocked = cut(fixed.unionByName(won).unionByName(lost))
        if not contested:
            break
        below = _blocked_below(rivals, blocked)
        asked = _on(rivals, below, [*_KEY, "n"], "inner").withColumn("k", _c("n") - _c("below"))
        met = _on(asked, rows.select(*_KEY, "k", _c("at").alias("parent_at")), [*_KEY, "k"], "left")
        now = cut(met.select("issue", "child", "first", "slug", "n", (~F.coalesce(_c("parent_at") < _c("first"), F.lit(False))).alias("child_has")))
        same = _on(now, rivals.select("issue", "child", "child_has"), ["issue", "child", "child_has"], "left_anti").isEmpty()
        rivals = now
        if same:
            break
    found = _places(rows, blocked)
    return found.select(*_KEY, "at", F.concat("slug", F.when(_c("number") > 1, F.concat(F.lit("_"), _c("number").cast("string"))).otherwise("")).alias("stem"))
