"""Decontamination, funnels and Merkle manifests against brute force, and their odd rows."""

import collections
import datetime
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quillgate.llm import decontaminate, funnel, merkle, oracle, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name,tables", [("op11_decontamination", ["documents", "benchmark"]), ("op12_funnel", ["clicks"]), ("op13_merkle", ["documents"])])
def test_queries_equal_their_sql(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, df.select(*names).rdd.map(tuple).collect())) == sorted(map(repr, cur.fetchall()))


# decontamination ----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "naïve", "x9", "日本", "d", "e", "f"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(10)), (3, "beta, d!"), (4, None), (5, "..."), (6, text(12)), (6, text(11)), (None, "only nameless words of a test item that are ten words long"), (7, "beta d")]
    docs = [(1, items[0][1].upper()), (2, f"start {items[0][1]} middle {items[1][1]} {items[1][1]} end"), (3, None), (4, ""), (5, "–- ?"), (None, items[5][1]), (6, items[5][1]), (6, items[5][1])]
    docs += [(7, items[7][1]), (8, "clean words only"), (9, "Beta -- D. Then beta."), (10, " ".join(items[0][1].split()[1:11])), (11, " ".join(items[0][1].split()[:9])), (12, text(40_000))]
    docs += [(20 + i, text(rng.randrange(200))) for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for c in ("w", "t", "row", "spans", "items", "n_words", "hash", "item_id", "__row", "k0"):
        d = d.withColumn(c, F.col("doc_id"))
    return d, spark.createDataFrame(items, "item_id long, text string"), docs, items


def hits(text, items):
    words, hit, ids = WORD.findall(lower(text)), set(), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        for i in range(max(1, len(w) - 9)) if w else ():
            win = w[i : i + 10]
            for at in range(len(words) - len(win) + 1):
                if words[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    ids |= {str(item)} if item is not None else set()
    return len(words), hit, sorted(ids)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 3000])
def test_decontamination_by_brute_force(leaks, block_bytes):
    d, b, docs, items = leaks
    rows = decontaminate.find(d, b, ["doc_id", "text"], block_bytes=block_bytes).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hit, ids = hits(r.text, items)
        assert r.n_words == n and r["items"] == ids
        assert hit == {p for s in r.spans for p in range(s.start, s.stop)}
    assert decontaminate.find(d.limit(0), b, ["doc_id"]).count() == 0
    assert all(not r.spans and not r["items"] for r in decontaminate.find(d, b.limit(0), ["doc_id"]).collect())


def test_n_hit_and_cleaning(leaks):
    d, b, docs, items = leaks
    want = collections.Counter()
    for i, t in docs:
        n, hit, _ = hits(t, items)
        pieces = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", t or "")
        lead = re.match(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", t or "")[0]
        want[i, t if not hit else lead + "".join(p for k, p in enumerate(pieces) if k not in hit)] += 1
    spans = decontaminate.clean(d, b)
    assert spans.columns == d.columns
    assert collections.Counter((r.doc_id, r.text) for r in spans.collect()) == want
    left = decontaminate.clean(d, b, remove="documents")
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, t in docs if not hits(t, items)[1])
    counts = decontaminate.find(d, b, ["text"]).select("text", decontaminate.n_hit(F.col("spans")).alias("n")).collect()
    assert all(r.n == len(hits(r.text, items)[1]) for r in counts)
    assert decontaminate.clean(d.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        decontaminate.clean(d, b, remove="words")


# funnels ------------------------------------------------------------------------------------------------------------


def brute(events, funnels, window):
    """events: distinct (client, kind, time)."""
    by = collections.defaultdict(lambda: collections.defaultdict(list))
    for c, k, t in sorted(events, key=lambda e: e[2]):
        by[c][k].append(t)
    out = {}
    for f in funnels:
        for c, kinds in by.items():
            reached, gaps = [0] * len(f.steps), [[] for _ in f.steps]
            for first in kinds[f.steps[0]]:
                reached[0] += 1
                at = first
                for k, kind in enumerate(f.steps[1:], 1):
                    after = [t for t in kinds[kind] if t > at]
                    if not after or after[0] - first > window or any(at < x <= after[0] for e in f.excluded for x in kinds[e]):
                        break
                    gaps[k].append(after[0] - at)
                    at = after[0]
                    reached[k] += 1
            if reached[0]:
                quarter = [sorted(g)[-(-25 * len(g) // 100) - 1] if g else None for g in gaps[1:]]
                out[f.name, c] = (*reached, max(k + 1 for k, n in enumerate(reached) if n), *quarter)
    depth = collections.Counter((name, x[len(funnels[0].steps)]) for (name, _), x in out.items())
    return {k: (*x, depth[k[0], x[len(funnels[0].steps)]]) for k, x in out.items()}


def test_funnels_by_brute_force(spark):
    rng = random.Random(5)
    base = datetime.datetime(2024, 3, 10, 1, 58)  # across a change to summer time, which a timestamp without a zone has none of
    kinds = ["view", "view", "click", "click", "purchase", "signup", "error", "scroll", None]
    rows = []
    for client, n, span in [(1, 900, 4000), (2, 300, 200), (3, 30, 90), (None, 20, 100), (4, 1, 1), (5, 2000, 9_000)]:
        for _ in range(n):
            t = base + datetime.timedelta(microseconds=rng.randrange(span) * 1_000_000 + rng.choice([0, 0, 0, 1, 250_000]))
            rows.append((client, rng.choice(kinds), rng.choice([t] * 30 + [None])))
    rows += rows[:50] + [(9, "view", base), (9, "click", base + datetime.timedelta(minutes=5)), (8, "view", base), (8, "click", base + datetime.timedelta(minutes=5, microseconds=1))]
    df = spark.createDataFrame(rows, "client_id long, kind string, arrived_at timestamp_ntz")
    for c in ("client", "t", "slice", "own", "mask", "bit", "n", "gap", "step", "funnel"):
        df = df.withColumn(c, F.lit("x"))
    epoch = datetime.datetime(1970, 1, 1)
    events = {(c, k, (t - epoch) // datetime.timedelta(microseconds=1)) for c, k, t in rows if None not in (c, k, t)}
    want = brute(events, funnel.FUNNELS, funnel.WINDOW)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        for slice_us in (funnel.SLICE, 40_000_000):  # slices longer and shorter than the window
            got = {(r.funnel, r.client_id): tuple(r)[2:] for r in funnel.funnels(df, slice_us=slice_us).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    short = [funnel.Funnel("two", ("view", "view"), ("view",)), funnel.Funnel("any", ("error", "click"))]
    got = {(r.funnel, r.client_id): tuple(r)[2:] for r in funnel.funnels(df, short, window=60_000_000).collect()}
    assert got == brute(events, short, 60_000_000)
    assert funnel.funnels(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        funnel.funnels(df, [short[0], funnel.FUNNELS[0]])


def test_quantiles_beyond_one_bin(spark):
    rng = random.Random(6)
    values = [("a", rng.randrange(10 * funnel.BIN), rng.randrange(1, 4)) for _ in range(3000)] + [("b", 5, 1)]
    got = {r.k: r.t for r in funnel.quantiles(spark.createDataFrame(values, "k string, v long, w long"), ["k"], "v", "w", 25).collect()}
    every = sorted(v for k, v, w in values if k == "a" for _ in range(w))
    assert got == {"a": every[-(-25 * len(every) // 100) - 1], "b": 5}


# Merkle manifests ---------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and each leaf's path."""
    paths, where, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for p, i in zip(paths, where):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            p.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes, where = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in where]
    return nodes[0], paths


def test_manifest_by_brute_force(spark):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    sizes = {"one": 1, "two": 2, "ü": 3, "four": 4, None: 5, "-": 7, "": 2, "wide": merkle.SPAN, "more": merkle.SPAN + 1, "hot": 3 * merkle.SPAN + 100}
    rng = random.Random(7)
    rows = [(rng.randrange(10**9), s, None if i % 5 else "en", i, f"text {i}\nof {s}" if i % 7 else None) for s, n in sizes.items() for i in range(n)]
    rows += [rows[-1]] * 3 + [(None, "hot", "en", None, "no id"), (None, "hot", "en", None, "no id"), (rows[-2][0], "hot", "de", 1, "same id, other text")]
    names = "doc_id long, source string, lang string, n_chars long, text string"
    df = spark.createDataFrame(rows, names).repartition(5)
    leaves = df.select("*", merkle.leaf(*[df[c] for c in merkle.FIELDS]).alias("leaf"))
    for c in ("g", "idx", "n", "digest", "path", "block", "k0", "o0", "__tie", "subroot", "root"):
        leaves = leaves.withColumn(c, F.lit("x"))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(((r[0] is not None, r[0] or 0), H(*map(field, r))))
    trees = {s: (sorted(x), *tree([h for _, h in sorted(x)])) for s, x in by.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    root, above = tree([trees[s][1] for s in order])
    want = collections.Counter()
    for s, up in zip(order, above):
        held, sub, paths = trees[s]
        want.update((h, s, sub, root, tuple(p + up)) for (_, h), p in zip(held, paths))
    found = merkle.manifest(leaves, keep=["doc_id", "source", "leaf"])
    got = found.withColumn("proof", F.sha2(merkle.siblings(F.col("path")), 256)).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).collect()
    assert collections.Counter((r.leaf, r.source, r.subroot, r.root, tuple((s.l, s.r) for s in r.path)) for r in got) == want
    assert all(r.again == root and r.proof == H(*(s.l + s.r for s in r.path)) for r in got)
    assert merkle.manifest(leaves.limit(0)).count() == 0


def test_tampering_is_found(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op13_merkle(spark, sf).collect():
        changed = zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (docs[r.doc_id].text or "")
        assert r.verified == (not changed) and r.verified == (r.folded_root == r.root)
