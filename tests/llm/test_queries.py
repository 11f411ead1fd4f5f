"""The registered queries and pipeline stages: their columns and figures against brute force, and odd tables."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from quillgate.llm import quality, queries

WORD = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_op1_and_op10(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {r.doc_id: r for r in queries.op10_token_counts(spark, sf).collect()}
    rows = queries.op1_bpe(spark, sf).collect()
    assert len(rows) == len(counts) == len(docs)
    for r in rows:
        t = docs[r.doc_id].text or ""
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        c = counts[r.doc_id]
        assert (c.n_bytes, c.n_tokens, c.over_limit) == (len(t.encode()), len(ids), len(ids) > 1024)
        fit = t.encode()[: c.fit_bytes].decode()  # ends between characters
        assert len(library.encode(fit, add_special_tokens=False).ids) <= 1024 and (c.over_limit or fit == t)


def test_op2(spark, sf, docs):
    rows = queries.op2_quality(spark, sf).collect()
    assert len(rows) == len(docs) and rows[0].asDict().keys() >= {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    assert all(r.n_words == len(WORD.findall(docs[r.doc_id].text or "")) and not (r.base_failed and r.kept) for r in rows)
    # The stage measures once and keeps the same rows.
    kept = quality.keep_good(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.kept)


def test_op3_and_op5(spark, sf, docs):
    mixed = queries.op3_mixing(spark, sf).collect()
    assert len(mixed) == len(docs) and all(r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.taken <= 3 * r.size for r in mixed)
    rows = queries.op5_sharding(spark, sf).collect()
    loads, slots = np.zeros(40, int), {}
    for r in rows:
        loads[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and r.size == len((docs[r.doc_id].text or "").encode()) + 16
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in rows:
        homes.setdefault(docs[r.doc_id].text, set()).add(r.shard)
    groups = {}
    for r in rows:
        groups[docs[r.doc_id].text] = groups.get(docs[r.doc_id].text, 0) + r.size
    # Longest processing time: no shard is above the mean by more than the largest group.
    assert all(len(h) == 1 for h in homes.values()) and loads.max() <= loads.mean() + max(groups.values())


def test_op4(spark, sf, docs):
    rows = queries.op4_simhash(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows[::20]:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), docs[r.doc_id].text or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)):016x}"
    fp = np.array([int(r.fingerprint, 16) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    least = np.array([r.doc_id for r in rows])
    for _ in rows:
        new = np.where(near, least[None, :], 1 << 60).min(1)
        if (new == least).all():
            break
        least = new
    assert [r.component_id for r in rows] == least.tolist()


def test_op6_op7_op8_op9(spark, sf, docs):
    scored = queries.op6_weak_labels(spark, sf).collect()
    assert len(scored) == len(docs) and all(r.kept == (r.score >= 0.5) for r in scored)
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    rows = queries.op7_embeddings(spark, sf).collect()
    assert len(rows) == len(vectors) and all(r.kept == (r.vec_id == r.component_id) for r in rows)
    unit = np.array([vectors[r.vec_id] / np.linalg.norm(vectors[r.vec_id]) for r in rows])
    links = (unit @ unit.T >= 0.95).sum(1) - 1
    found = np.array([r.n_links for r in rows])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    texts = queries.op8_html(spark, sf).collect()
    assert len(texts) == len(pages)
    for r in texts:  # by hand: all that the pages' one article element holds
        body = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        import html

        assert " ".join(r.text.split()) == " ".join(html.unescape(re.sub("<[^>]+>", " ", body)).split()) and r.n_chars == len(r.text)
    named = queries.op9_language(spark, sf).collect()
    held = [r for r in named if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert len(named) == len(docs) and sum(docs[r.doc_id].lang == r.lang_pred for r in held) >= 0.95 * len(held)


@pytest.fixture(scope="module")
def odd(spark):
    base = "the quick brown fox jumps over the lazy dog near a quiet river bank while rain falls softly on green hills tonight again"
    rows = [(1, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, None, None, 0), (3, "", "en", "a", 0), (4, " \n\t", "en", "b", 3), (None, base + " indeed", "en", "b", 2), (5, "word " * 30_000, "en", "b", 5)]
    rows += [(10 + i, f"{base} with number {i} and the same words as before but for this", "en", "ab"[i % 2], 9) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("kept", "reason", "fp", "component_id", "copies", "ids", "script", "__row_", "lang_pred"):
        df = df.withColumn(c, df.n_chars)
    return df


def test_stages_of_odd_and_empty_tables(spark, odd, tmp_path):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for df in (odd, odd.limit(0)):
            out = stage(spark, df, str(tmp_path))
            n = out.count()
            assert n <= 3 * odd.count() and (n == 0 or df is odd), name
            assert name == "BPE encoding" or out.columns == odd.columns, name
    odd.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r.n_tokens == len(r.ids) > 0 for r in out) and not {2, 3, 4} & {r.doc_id for r in out}
