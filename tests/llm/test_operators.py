"""Edge cases and brute force for the ten operators."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillgate.llm import bpe, components, html, langid, mixing, quality, sharding, simhash, tokens, vectors

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile("[^\x20\x09-\x0D]+")
ODD = [
    "", " ", "\n\n  \t", "Hello  world, it's  fine", "<|endoftext|>hi <|endoftext|>  x", "x²³ Ⅷ½ 一二三 4", "a\x1cb \x85", "😀🧪 ½",
    "naïve café çà", "a" * 3000, "=" * 700 + " x", "​ zero", "'re 'r I'll", "word " * 4000, "Ünïcode　space",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeated rows, long texts, and columns whose names clash with the operators' own."""
    base = "the quick brown fox jumps over the lazy dog near a quiet river bank while rain falls softly on green hills tonight again"
    rows = [(i, t, "en", f"s{i % 3}", 7) for i, t in enumerate(ODD)]
    rows += [(100, None, "en", "s0", 1), (101, base, None, None, 1), (101, base, None, None, 1), (102, base + " indeed", "en", None, 2), (None, base, "en", "s1", 3), (103, base, "en", "s2", 4)]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, names)
    for c in ("n_tokens", "ids", "kept", "reason", "fp", "component_id", "copies", "rate", "shard", "size", "key", "script", "lang_pred"):
        df = df.withColumn(c, df.n_chars)
    return df


def empty(df):
    return df.limit(0)


def test_encoding(odd, library):
    for r in tokens.round_trip(odd, ["doc_id", "text"]).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = tokens.decode(tokens.encode(odd, ["doc_id", "text"]).withColumnRenamed("text", "was"), ["was"])
    assert all((r.was or "") == r.text for r in back.collect())
    assert tokens.encode(empty(odd)).count() == 0


def test_encoding_fuzz(library):
    rng = random.Random(1)
    parts = [*"aeiotnsrhl  \n\t'’éßñü一½²\x1c\x85　😀_-=*#0129.,!?ABΩж", "<|endoftext|>", "'re", "   ", "aaaa", "====", "ing"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(800)]
    for t, ids in zip(texts, bpe.encode_batch(texts, PATH)):
        assert library.encode(t, add_special_tokens=False).ids == ids.tolist(), t


def test_every_token_is_reached():
    v = bpe.vocabulary(PATH)
    assert len(v.of) == 50256


def test_prefix_counts(odd, library):
    for t in ["Hello  world, it's  fine\n\n we'll see<|endoftext|>  ok 123 ...  x", "a  b   \n c", "naïve½ 'r", "b" * 90]:
        p = tokens.PrefixCounts(t)
        assert [p.at(k) for k in range(len(t) + 1)] == [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        assert p.fit(3) == max(k for k in range(len(t) + 1) if p.at(k) <= 3)
    for r in tokens.truncate(odd, 2, ["text"]).collect():
        t = r.text or ""
        assert r.fit_text == t[: tokens.PrefixCounts(t).fit(2)]
    asked = odd.selectExpr("text", "array(0, 1, 3, 100000, null, -1) as at")
    for r in tokens.prefix_tokens(asked, "at", ["text"]).collect():
        count = lambda k, t=r.text or "": len(library.encode(t[: max(k, 0)], add_special_tokens=False).ids)
        assert r.n_tokens == [None if k is None else count(k) for k in (0, 1, 3, 100000, None, -1)]
    for r in tokens.count(odd, ["text"]).collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 1024) and r.fit_bytes <= r.n_bytes
    assert tokens.count(empty(odd)).count() == 0


def test_longest_prefix_in_a_budget(library):
    """Against the library for every prefix: longest in tokens, whole characters, whitespace and contractions that a cut splits otherwise."""
    rng = random.Random(3)
    parts = [*"aeiotnsrhl  \n\t'’éßñü一½²\x1c\x85　😀_-=*#0129.,!?ABΩж", "<|endoftext|>", "'re", "'ll", "   ", " " * 10, "aaaa", "====", "ing", "ationalization", "<|end"]
    for _ in range(300):
        t = "".join(rng.choices(parts, k=rng.randint(0, 60)))
        n = [len(library.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)]
        p = tokens.PrefixCounts(t)
        assert [p.at(k) for k in range(len(t) + 1)] == n, t
        for budget in (0, 1, 2, 3, rng.randint(0, max(n) + 1)):
            assert p.fit(budget) == max(k for k in range(len(t) + 1) if n[k] <= budget), (t, budget)
            assert p.fit_bytes(budget) == len(t[: p.fit(budget)].encode())


def test_quality(odd, spark, sf):
    got = quality.quality(odd).collect()
    assert len(got) == odd.count() and all(r.base_failed for r in got if r.n_words < 20)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.quality(docs).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if WORD.search(x):
                dup += x in seen
                seen.add(x)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.base_failed or not r.kept)
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.quality(empty(odd)).count() == 0 and quality.keep_good(empty(odd)).count() == 0


def test_quality_bands(spark):
    rng = random.Random(3)
    syllables = ["ing", "the", "an", "re", "on", "er", "at", "en", "ti", "es"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(100, 120))), "xx") for i in range(80)]
    rows += [(200, " ".join(w + "$%&" for w in (word() for _ in range(45))), "xx"), (201, " ".join(rng.choice(["a", "b"]) for _ in range(200)), "xx")]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not got[200] and not got[201] and sum(got[i] for i in range(80)) >= 78


def _prose(rng, n, end=""):
    syllables = ["ing", "the", "an", "re", "on", "er", "at", "en", "ti", "es"]
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) + end for _ in range(n))


def test_quality_bands_at_every_length(spark):
    """Thin cells borrow the language's next lengths; rare languages the script's or the corpus' texts."""
    rng = random.Random(7)
    rows = [(i, _prose(rng, rng.randint(100, 400)), "xx") for i in range(80)] + [(90 + i, _prose(rng, 6000), "xx") for i in range(2)]
    rows += [(100, _prose(rng, 30), "xx"), (101, _prose(rng, 150), "yy"), (102, _prose(rng, 150), None)]
    rows += [(200, _prose(rng, 4000, "$%&"), "xx"), (201, _prose(rng, 30, "$%&"), "xx"), (202, _prose(rng, 150, "$%&"), "yy"), (203, _prose(rng, 4000, "\u0416$%&\u0416\u0416"), "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(got[i].kept for i in (90, 91, 100, 101, 102)) and sum(got[i].kept for i in range(80)) >= 78
    assert not any(r.kept or r.base_failed for i, r in got.items() if i >= 200)
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == sorted(i for i, r in got.items() if r.kept)


def test_quality_bands_with_a_third_of_junk(spark):
    rng = random.Random(11)
    rows = [(i, _prose(rng, rng.randint(150, 190)), "xx") for i in range(120)]
    rows += [(200 + i, " ".join(w + rng.choice(["", "$%&", "##*"]) for w in _prose(rng, rng.randint(80, 95)).split()), "xx") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i] for i in range(120)) >= 117 and sum(got[200 + i] for i in range(60)) <= 3


def test_mixing(odd, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix(docs).collect())
    texts = {r.doc_id: r for r in docs.collect()}
    sources = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for r in rows:
        d = texts[r["doc_id"]]
        assert r["size"] == len(WORD.findall(d.text)) and r["taken"] <= 3 * r["size"]
        s = sources[d.source]
        s[0] += r["size"]
        s[1] += r["taken"]
        s[2], s[3] = r["target"], r["source_size"]
    assert abs(sum(s[2] for s in sources.values()) - sum(s[0] for s in sources.values())) < 1e-6 * sum(s[0] for s in sources.values())
    assert all(s[0] == s[3] and s[2] <= 3 * s[0] + 1e-6 and abs(s[1] - s[2]) <= 0.1 * s[2] for s in sources.values())
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.take_mix(odd).columns == odd.columns and mixing.mix(empty(odd)).count() == 0 and mixing.take_mix(empty(odd)).count() == 0


def test_targets_and_margins(spark):
    got = mixing.targets({"va": 100, "vb": 1, "vc": 50, "n": 10})
    assert got["vb"] == 3 and abs(sum(got.values()) - 161) < 1e-9 and got["va"] < got["vc"]
    cells = spark.createDataFrame([("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40)], "s string, l string, w long")
    lam = mixing.balance(cells, ["s", "l"], "w", [{"a": 60.0, "b": 40.0}, {"x": 50.0, "y": 50.0}])
    take = {(s, l): w * np.exp(lam[0][s] + lam[1][l]) for s, l, w in [("a", "x", 10), ("a", "y", 30), ("b", "x", 20), ("b", "y", 40)]}
    assert abs(take["a", "x"] + take["a", "y"] - 60) < 1e-6 and abs(take["a", "x"] + take["b", "x"] - 50) < 1e-6


def test_simhash(odd, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for bucket in (simhash.BUCKET, 2):  # the second sends nearly all buckets the way of large ones
        got = simhash.near_duplicates(docs, bucket=bucket).collect()
        fp = np.array([r.fp for r in got], np.int64).view(np.uint64)
        ids, root = [r.doc_id for r in got], list(range(len(got)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(fp)):
            for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 4):
                a, b = sorted((find(i), find(int(j))), key=lambda k: ids[k])
                root[b] = a
        assert [ids[find(i)] for i in range(len(fp))] == [r.component_id for r in got]
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    one = {r.doc_id: r.component_id for r in got}
    assert one[101] == one[103] and one[0] == one[100] == 0  # wordless texts have fingerprint zero
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and [r.doc_id for r in kept.filter("doc_id = 101").collect()] == [101]
    assert simhash.near_duplicates(empty(odd)).count() == 0 and simhash.keep_one(empty(odd)).count() == 0


def test_fingerprint_by_hand():
    def slow(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if not w:
            return 0
        shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    for t in [*ODD, None, "One two", "A b C d E f", "ÀB cD"]:
        assert simhash.fingerprint(t) % (1 << 64) == slow(t)


def test_pigeonring_loses_nothing():
    rng, ring = np.random.default_rng(0), simhash.Ring()
    for k in range(5):
        flips = [sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for _ in range(400)]
        x = np.array(flips, np.uint64)
        assert ring.pairs(x).all()
        for f in flips:  # some table's segments are untouched
            assert any(not any(f & ring.mask[s] for s in on) for _, on in ring.tables)
    assert not ring.pairs(np.array([0b11111], np.uint64)).any()


def test_ring_refuses_what_it_cannot_do():
    for limit in (-2, 1, 3, 5, 6):
        with pytest.raises(ValueError):
            simhash.Ring(limit)


def test_components_of_hubs(spark):
    """A hub of most links, and a component of most nodes: broadcast, not shuffled, and the same result."""
    from quillgate.llm import runtime

    links = spark.range(1, 6000).selectExpr("if(id < 5000, 7000, id) as a", "if(id < 5000, id, id + 10000) as b")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert all(got[i] == 1 for i in (*range(1, 5000), 7000)) and all(got[i] == i for i in range(5000, 6000) if i != 7000)
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'hot', cast(id as string)) as k", "id")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("n") * 2)
    joined = runtime.join_skewed(rows, table, "k", "n")
    assert joined.columns == ["k", "id", "v"] and joined.count() == 3000 and joined.filter("k = 'hot' and v = 2000").count() == 1000


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 40), 100 + rng.randint(0, 40)) for _ in range(30)] + [(200, 200), (300, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and 200 not in got and 300 not in got
    for a, b in links[60:90]:
        assert a == b or got[a] == got[b]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(odd, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df, n in ((docs, 40), (odd, 3)):
        got = sharding.shard(df, n).collect()
        assert len(got) == df.count()
        slots, homes = collections.defaultdict(list), collections.defaultdict(set)
        texts = {r.doc_id: r.text for r in df.collect()}
        for r in got:
            t = texts[r.doc_id]
            slots[r.shard].append(r.slot)
            homes[t].add(r.shard)
            assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())
    assert sharding.shard(empty(odd)).count() == 0


def test_schedule_is_the_heaps():
    import heapq

    rng = np.random.default_rng(0)
    for _ in range(60):
        k, n = int(rng.integers(1, 20)), int(rng.integers(1, 9))
        sizes = np.sort(rng.choice(np.arange(1, 200), k, replace=False))[::-1]
        counts = rng.integers(1, 200, k)
        heap, want = [(0, i) for i in range(n)], np.zeros((k, n), int)
        for r, (s, c) in enumerate(zip(sizes, counts)):
            for _ in range(c):
                load, i = heap[0]
                heapq.heapreplace(heap, (load + int(s), i))
                want[r, i] += 1
        assert (sharding.schedule(sizes, counts, n) == want).all()


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 16))
    x[1:120] = x[0] + 0.12 * rng.normal(size=(119, 16))  # one large group
    x[130] = x[131] = x[132]
    x[140] = 3 * x[141]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(800, None), (801, []), (802, [0.0] * 16), (803, [float("nan")] * 16), (804, [None] + [1.0] * 15), (805, [1.0, 2.0]), (806, [2.0, 4.0]), (None, rows[300][1])]
    monkeypatch.setattr(vectors, "BLOCK", 16)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    degree = linked.sum(1) - 1
    degree[300] += 1
    found = sum(got[i].n_links for i in range(700))
    assert found >= 0.9 * degree.sum() and all(got[i].n_links <= degree[i] for i in range(700))
    assert got[130].n_links == 2 and got[131].component_id == 130 and got[140].component_id == got[141].component_id == 140
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (800, 801, 802, 803, 804))
    assert got[806].component_id == 805 and not got[806].kept and not got[None].kept
    none = vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.columns == ["vec_id", "n_links", "component_id", "kept"] and none.count() == 0


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header><h1>Site</h1></header>"
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>{n}</a></li></ul></nav><div class=\"ad\">Buy {n}</div>{body}"
    "<aside>more</aside><section class='comments'><p>nice {n}</p></section><form>mail <input></form><footer>&copy; {n}</footer></body></html>"
)


def test_html(spark):
    def page(n, paragraphs, tag="article"):
        inner = "".join(f"<p>{p}</p>" for p in paragraphs)
        return PAGE.format(n=n, body=f"<{tag} class='post'><h2>Title {n}</h2><p class='hint'>Share this story</p>{inner}</{tag}>")

    rows = [(i, f"https://Site{i % 2}.example/{i}", page(i, [f"Text &amp; more {i} {j}." for j in range(1 + i % 4)], ("article", "div")[i % 2])) for i in range(12)]
    rows += [(50, None, page(50, ["No host"])), (51, "https://x.example", None), (52, "https://x.example", ""), (53, "https://site0.example", "<article><p><b>a<br><p>b  c</p>"), (0, rows[0][1], rows[0][2])]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):  # a paragraph of the article is content even if all pages share it
        assert got[i].text == "\n\n".join([f"Title {i}", "Share this story", *(f"Text & more {i} {j}." for j in range(1 + i % 4))]) and got[i].n_chars == len(got[i].text)
    assert got[50].text == "Title 50\n\nShare this story\n\nNo host" and got[51].text == got[52].text == "" and got[53].text == "a\n\nb c"
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _main(pages):
    whole = None
    for h in pages:
        one = html.generalise(html.parse(h))
        whole = one if whole is None else html.align(whole, one)
    text = html.dump(whole, len(pages))
    return [html.extract(h, text) for h in pages]


def test_html_copies_and_shared_paragraphs_stay(spark):
    long = "A long paragraph of the only article, " * 8
    page = f"<body><nav>{{}}</nav><article><h1>Headline</h1><p>{long.strip()}</p><p>First.</p><p>Second.</p></article></body>"
    want = f"Headline\n\n{long.strip()}\n\nFirst.\n\nSecond."
    rows = [(i, "https://copies.example", page.format("a")) for i in range(5)] + [(10 + i, "https://nav.example", page.format(i)) for i in range(5)]
    other = "<body><main><h1>Title {0}</h1><p>Words {0}.</p></main></body>"  # one page has an article, the others do not
    rows += [(20, "https://mixed.example", page.format("a"))] + [(21 + i, "https://mixed.example", other.format(i)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in (1, 4):
        got = {r.page_id: r.text for r in html.main_text(df.repartition(parts)).collect()}
        assert all(got[i] == want for i in (*range(5), *range(10, 15), 20))
        assert all(got[21 + i] == f"Title {i}\n\nWords {i}." for i in range(4))
    for lead in ("Shared lead.", "Shared lead, part of the story. " * 9):  # whatever its length and the number of pages
        shared = f"<body><article><h1>T</h1><p class='lead'>{lead}</p><section><p>{lead}</p></section><p>Body {{0}}.</p></article></body>"
        for n in (1, 2, 3, 9):
            assert _main([shared.format(i) for i in range(n)]) == [f"T\n\n{lead.strip()}\n\n{lead.strip()}\n\nBody {i}." for i in range(n)]


def _places(h):
    """Brute force for small hosts: every text of a page with its path of tags and places, no folding, no alignment."""
    out, stack = {}, [(html.parse(h), ())]
    while stack:
        node, path = stack.pop()
        for i, k in enumerate(node.kids):
            if isinstance(k, html.Text):
                out[(*path, i)] = k.text
            else:
                stack.append((k, (*path, (i, k.tag))))
    return out


def test_html_wrapper_finds_what_no_tag_names():
    """Pages of plain `div`s of one layout: a text is content if it stands in the block whose texts vary most, which
    brute force finds by comparing the pages place by place.  A page alone can't tell."""
    rng = random.Random(2)
    pages, menu = [], "Home of all the news that we ever printed, and of all that we may print some day, in every town"
    for n in range(12):
        paras = "".join(f"<p>{_prose(rng, rng.randint(5, 40))}</p>" for _ in range(3))
        pages.append(f"<body><div>{menu}</div><div>{_prose(rng, 3)}</div><div><h1>{_prose(rng, 4)}</h1>{paras}</div><div>All rights of the house are held. {menu}</div></body>")
    at = [_places(p) for p in pages]
    varying = collections.Counter()
    for place in at[0]:
        if len({x[place] for x in at}) > 1:
            varying[place[:2]] += sum(len(x[place]) for x in at)
    top = varying.most_common(1)[0][0]
    want = ["\n\n".join(t for place, t in sorted(x.items(), key=lambda i: [p if isinstance(p, int) else p[0] for p in i[0]]) if place[:2] == top) for x in at]
    assert _main(pages) == want
    assert [html.extract(p) for p in pages] != want  # the wrapper decides


def test_html_furniture_by_evidence():
    """A name that is no proof: the block goes where the host's pages all have the same in it, or a trifle."""
    rng = random.Random(4)
    body = lambda: "".join(f"<p>{_prose(rng, 40)}</p>" for _ in range(4))
    own = [_prose(rng, 60) for _ in range(4)]
    pages = [f"<body><article><h1>{n}</h1>{body()}<div class='notice'><p>Cookies are in use.</p></div><div class='search-theory'><p>{own[n]}</p></div></article></body>" for n in range(4)]
    got = _main(pages)
    assert all("Cookies" not in g and own[n] in g for n, g in enumerate(got))


@pytest.mark.parametrize("depth", [55, 70, 30_000])
def test_html_at_any_depth(depth):
    def page(n):
        inner = "<div>" * depth + f"<p>Deep {n}.</p><nav><p>Menu {n}</p></nav><div class=ad><p>Buy {n}</p></div>" + "</div>" * depth
        return f"<body><div id=wrap><article><h1>Head {n}</h1>{inner}<p>After {n}.</p></article><div><p>Beside {n}.</p></div></div></body>"

    assert _main([page(n) for n in range(4)]) == [f"Head {n}\n\nDeep {n}.\n\nAfter {n}." for n in range(4)]
    below = "<div>" * depth + "<div><p>Beside</p></div><article><p>Below.</p></article>" + "</div>" * depth
    assert _main([below]) == ["Below."]
    assert html.extract("<div>" * depth + "<p>Plain text.</p>" + "</div>" * depth) == "Plain text."


def test_html_everyday_words():
    prose = "This section tells at length what was said, who said it, and why it matters to all who read about it. " * 3
    kept = f"<h2 id='how-to-register-a-domain'>Register {{0}}</h2><section id='discussion'><p>Talk {{0}}.</p></section><p id='search-results-explained'>Found {{0}}.</p>"
    kept += f"<div class='notice'><p>{prose}{{0}}</p></div><p class='alert'>Mind {{0}}.</p>"
    gone = "<div class='share'><a href=/x>Share {0}</a></div><div class='related'><ul>" + "<li><a href=/y>Some other story that is linked from here {0}</a></li>" * 9
    kept += "<div class='notice'><p>Short {0}</p></div>"  # a plain name without evidence, however short
    gone += f"</ul></div><div class='comments'><p>{prose}by {{0}}</p></div><div class='login register'><p>{prose}</p></div>"
    want = "Head {0}\n\nRegister {0}\n\nTalk {0}.\n\nFound {0}.\n\n" + prose + "{0}\n\nMind {0}.\n\nShort {0}"
    pages = [f"<body><article><h1>Head {{0}}</h1>{kept}{gone}</article></body>".format(n) for n in range(4)]
    assert _main(pages) == [want.format(n) for n in range(4)]
    once = f"<section class='discussion'><p>{prose.strip()}</p></section>"  # on one page only: no constant of the host
    assert _main([p.replace("</article>", once + "</article>") if n == 2 else p for n, p in enumerate(pages)])[2] == want.format(2) + "\n\n" + prose.strip()


FRAGMENTS = [
    '<div class="search-theory">A thought of {0}.</div>', '<section class="discussion"><h2>Discussion {0}</h2><p>We discuss {0}.</p></section>', '<div class="notice-of-intent">Intent {0}</div>',
    '<blockquote class="social-history">Quote {0}</blockquote>', '<ul class="related-work"><li>Work {0}</li></ul>', '<ol><li class="register-office">Office {0}</li></ol>',
    '<table class="form-of-verbs"><tr><td>go {0}</td></tr></table>', '<section class="comments-on-method"><p>Method {0}</p></section>', '<div class="how-to-respond">Respond {0}</div>', '<figure class="ad-1920">In the year {0}</figure>',
]


@pytest.mark.parametrize("tag", ["article", "div"])
@pytest.mark.parametrize("n", [1, 2, 8, 20, 60])
def test_html_keeps_whatever_its_share(tag, n):
    """Names that hold a word of furniture drop no text, be it most of the article or little of it, on a host or alone."""
    for fragment in FRAGMENTS:
        prose = "".join(f"<p>Paragraph {i} of {{0}} says what no other page says.</p>" for i in range(n))
        pages = [f"<body><nav><a href='/'>Home</a></nav><{tag}><h1>Title {{0}}</h1>{prose}{fragment}</{tag}><footer>The same</footer></body>".format(u) for u in ("alpha", "beta", "gamma")]
        for u, h, text in zip(("alpha", "beta", "gamma"), pages, _main(pages)):
            want = re.sub("<[^>]+>", " ", fragment.format(u)).split()
            for got in (text, html.extract(h)):
                assert got.split()[-len(want) :] == want and "Home" not in got


def test_html_agreements():
    rng = random.Random(8)
    for names, most in (("abcde", 40), ("abcdefghijklmnopqrstuvwxyz", 60)):
        for _ in range(200):
            a, b = ([rng.choice(names) for _ in range(rng.randrange(most))] for _ in range(2))
            got = html._agreements(a, b)
            assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
            assert len(got) == len(html._longest(a, b))
    # Beyond a window's pairs: still in order, and what is equal but for a few strangers is met whole.
    a = [rng.choice("abcdefg") for _ in range(3000)]
    b = [x for x in a for _ in range(1)]
    for at in sorted(rng.sample(range(3000), 20), reverse=True):
        b.insert(at, "stranger")
    assert len(html._agreements(a, b)) == len(a)
    c = [rng.choice("abcdefg") for _ in range(2500)]
    got = html._agreements(a, c)
    assert all(a[i] == c[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:])) and len(got) > 1200


@pytest.mark.parametrize("kind", ["unlike", "mixed"])
def test_html_many_siblings(kind):
    """Thirty thousand siblings, on two pages that differ: nothing is lost, and time and memory stay small."""
    rng, n = random.Random(9), 30_000
    name = lambda u, i: u + "".join(chr(97 + int(d)) for d in str(i)) if kind == "unlike" else rng.choice("pqrstuv")
    pages = ["<body><article>" + "".join(f"<div class={name(u, i)}>Text {u} {i}</div>" for i in range(n)) + "</article></body>" for u in ("k", "m")]
    began = time.monotonic()
    for u, text in zip(("k", "m"), _main(pages)):
        assert text == "\n\n".join(f"Text {u} {i}" for i in range(n))
    assert time.monotonic() - began < 120

def test_wrapper_is_union_free():
    a = html.generalise(html.parse("<div><p>x</p><p>y</p><h2>same</h2></div>"))
    b = html.generalise(html.parse("<div><ul><li>1</li></ul><p>z</p><h2>same</h2></div>"))
    e = html.expression(html.align(a, b))
    assert e == "<><div>(<ul><li>1</li></ul>)?(<p>#TEXT</p>)+<h2>same</h2></div></>"


def test_language(spark, sf, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows} == {True}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = langid.languages(odd).collect()
    assert len(got) == odd.count() and {r.lang_pred for r in got if r.doc_id in (0, 1, 2, 100)} == {"und"}
    assert langid.languages(odd.filter("lang is null")).first().lang_pred == "und"
    assert langid.keep_identified(odd).columns == odd.columns and langid.languages(empty(odd)).count() == 0
    for n in (2, 4, 7, 12):
        code = langid.codewords(n)
        assert all((code[i] != code[j]).any() for i in range(n) for j in range(i))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and 0 < out.count() <= 3 * docs.count()
    assert out.filter("n_tokens <> size(ids)").count() == 0


def test_weak_labels(spark, sf, odd):
    from quillgate.llm import weak

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = weak.score(docs).collect()
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    good = [r.kept for r in got if quality_of.get(r.doc_id) == 1 and words[r.doc_id] >= 20]
    bad = [r.kept for r in got if quality_of.get(r.doc_id) == 0 and words[r.doc_id] >= 20]
    assert len(got) == docs.count() and sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad)
    assert all(0 <= r.score <= 1 for r in got)
    rows = weak.score(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.doc_id in (0, 1, 2, 100))
    assert weak.score(empty(odd)).count() == 0


def test_expectation_maximisation():
    from quillgate.llm import weak

    rng = np.random.default_rng(4)
    truth = rng.random(5000) < 0.8
    said = np.stack([np.where(truth, np.where(rng.random(5000) < 0.998, 1, -1), np.where(rng.random(5000) < 0.6, -1, 1)) for _ in range(5)], 1)
    patterns, back, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    share, right, prior = weak.estimate(patterns, counts.astype(float))
    assert ((share[back.ravel()] > 0.5) == truth).mean() > 0.97 and abs(prior - 0.8) < 0.03 and np.abs(right[1] - 0.6).max() < 0.1


@pytest.mark.parametrize("accuracy", [(0.9, 0.8), (0.8, 0.8), (0.998, 0.6)])
def test_expectation_maximisation_is_no_worse_than_the_majority(accuracy):
    from quillgate.llm import weak

    rng, n = np.random.default_rng(4), 20_000
    truth = rng.random(n) < 0.8
    said = np.stack([np.where(truth, np.where(rng.random(n) < accuracy[0], 1, -1), np.where(rng.random(n) < accuracy[1], -1, 1)) for _ in range(8)], 1)
    patterns, back, counts = np.unique(said, axis=0, return_inverse=True, return_counts=True)
    share, right, prior = weak.estimate(patterns, counts.astype(float))
    agree, majority = ((share[back.ravel()] > 0.5) == truth).mean(), ((said.sum(1) > 0) == truth).mean()
    assert agree >= majority - 0.001 and abs(prior - 0.8) < 0.02
    assert np.abs(right[0] - accuracy[0]).max() < 0.02 and np.abs(right[1] - accuracy[1]).max() < 0.05


def test_weak_labels_of_copies(spark):
    """Sixty thousand rows of four distinct texts: the sample counts texts, and the scorer agrees with the posteriors."""
    from quillgate.llm import weak

    good = ["The council met on Monday to discuss the new bridge, and most members spoke in favour of it after a long and quiet debate.",
            "Rain is expected in the north tomorrow, while the south stays dry and warm with light winds from the west until the evening.",
            "She opened the window, looked at the garden for a while, and then went back to the letter that she had not yet finished writing."]
    bad = "BUY $$$ NOW!!! ### WIN %%% CASH!!! $$$ NOW!!! ### BUY $$$ NOW!!! ### WIN %%% CASH!!! $$$ NOW!!! ### BUY $$$"
    rows = spark.range(60_000).selectExpr("id as doc_id", f"case when id % 2 = 0 then '{bad}' else element_at(array({', '.join(map(repr, good))}), cast(id % 3 + 1 as int)) end as text")
    got = weak.score(rows).groupBy("kept", F.expr("doc_id % 2 = 0")).count().collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(False, True, 30_000), (True, False, 30_000)]
    junk = spark.range(5_000).selectExpr("id as doc_id", f"if(id < 4990, '{bad}', '{good[0]}') as text")
    assert {r.doc_id >= 4990 for r in weak.score(junk).filter("kept").collect()} <= {True}
    clean = spark.range(300).selectExpr("id as doc_id", f"concat('{good[1]}', ' It was day ', id, '.') as text")
    assert weak.score(clean).filter("not kept").count() == 0  # no bad class is made up
    blank = spark.createDataFrame([(1, None), (2, " "), (3, "")], "doc_id long, text string")
    assert weak.score(blank).filter("kept or score > 0").count() == 0


def test_keep_one_by_brute_force(spark):
    """Repeated and null ids: each component of equal or near texts keeps one row, that of the least id."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(4000)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(16)]
    rows = [(i % 2, base[i % 16], "a") for i in range(16)] + [(1, base[0], "a"), (1, base[5], "b"), (None, base[3], "a"), (None, "alone and without an id", "c"), (None, "alone and without an id", "c"), (7, None, "x"), (8, "", "y"), (1, base[2] + " end", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for c in ("fp", "component_id", "__id", "__row", "first", "root"):
        df = df.withColumn(c, F.lit(1))
    fps = [simhash.fingerprint(t) for _, t, _ in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    held = {}
    for (i, t, s), c in zip(rows, comp):
        held.setdefault(c, []).append((i is None, i or 0, t, s))
    for parts in (1, 5):
        kept = simhash.keep_one(df.repartition(parts))
        got = [(r.doc_id, r.text, r.source) for r in kept.collect()]
        assert kept.columns == df.columns and len(got) == len(held) and len({t or "" for _, t, _ in got}) == len(got)
        for i, t, s in got:
            mine = next(h for h in held.values() if (i is None, i or 0, t, s) in h)
            assert (i is None, i or 0) == min(h[:2] for h in mine)
    assert simhash.keep_one(df.limit(0)).count() == 0
