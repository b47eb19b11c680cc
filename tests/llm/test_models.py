"""Trained operators, archives, top-k search and the pipeline."""

import math
import re
import struct
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F

from nextrail.llm.common import crc_third
from nextrail.llm import bpe, langid, lines, quality, queries, simhash, topk, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"


def counted(rows):
    return Counter(map(tuple, rows))


# ---- toxicity


def test_expressions_are_bytes_with_what_precedes_them_in_the_word():
    keys, words = toxicity.expressions("Ab, abcdefghé \x00".encode())
    want, starts = [], []
    for word in (b"ab ", "abcdefghé ".encode(), ):
        starts.append(len(want))
        want += [int.from_bytes(word[max(0, i - 6) : i + 1], "big") for i in range(len(word))]
    assert keys.tolist() == want and words.tolist() == starts
    assert toxicity.expressions(b"")[0].tolist() == toxicity.expressions(b" .,\n")[0].tolist() == []


def plain_ratios(texts, labels, every):
    """Log ratios by word, worked out with dictionaries."""
    grams = [Counter(), Counter()]
    kinds = set()

    def of(text):
        return toxicity.expressions(text.encode())[0].tolist()

    for text, label in zip(texts, labels, strict=True):
        grams[label].update(of(text))
    for text in every:
        kinds.update(of(text))
    four = Counter(k & 0xFFFFFFFF for k in kinds)
    two = Counter(k & 0xFFFF for k in four)

    def backoff(key):
        def level(counts, gram, below):
            after = [n for g, n in counts.items() if g >> 8 == gram >> 8]
            return (counts[gram] - 0.75) / sum(after) + 0.75 * len(after) / sum(after) * below

        return level(four, key & 0xFFFFFFFF, level(two, key & 0xFFFF, 1 / 256))

    def value(key):
        logs = []
        seen = any(g[key] for g in grams)
        for g in grams:
            after = [n for k, n in g.items() if k >> 8 == key >> 8]
            mass = sum(min(n, 2) for n in after) / sum(after) if after else 1.0
            own = max(g[key] - 2, 0) / sum(after) if after else 0.0
            logs.append(math.log(own + mass * backoff(key)) if seen else math.log(mass))
        return logs[1] - logs[0]

    def ratio(text):
        out = []
        for word in toxicity._CLEAN and text.encode().translate(toxicity._CLEAN).split():
            total = sum(map(value, of(word.decode())))
            out.append(math.log1p(toxicity.MIXED * math.expm1(min(total, 50))))
        return sum(out) / len(out) if out else 0.0

    return ratio


def labelled_rows():
    random = np.random.default_rng(1)
    plain = ["the", "of", "and", "tree", "house", "water", "stone", "Éclair"]
    rows = []
    for i in range(120):
        words = list(random.choice(plain, 25))
        if i % 3 == 0:
            words[3:3] = ["idiot", "scum", "idiots"]
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_toxicity_equals_plain_counts(spark):
    rows = labelled_rows()
    docs = brute.frame(spark, [(i, t) for i, t, _ in rows] + [(900, "an unlabelled text of water")])
    labels = brute.frame(spark, [(i, y) for i, _, y in rows], "doc_id long, toxic int")
    tables = toxicity.fit(docs, labels)
    import zlib

    taught = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    ratio = plain_ratios([t for t, _ in taught], [y for _, y in taught], [t for _, t, _ in rows] + ["an unlabelled text of water"])
    for text in ("the idiot", "idiotic water stones", "unknown qqq", "", "tree house"):
        assert tables.ratio(text.encode(), 2) == pytest.approx(ratio(text), rel=1e-3, abs=1e-6)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert (got[i].score >= 0.7) == bool(y)


def test_toxicity_hard_rows(spark):
    rows = labelled_rows()
    labels = brute.frame(spark, [(i, y) for i, _, y in rows] + [(None, 1), (3, None), (4, 0), (4, 1)], "doc_id long, toxic int")
    docs = brute.frame(spark, brute.HARD + [(100 + i, t) for i, t, _ in rows])
    scored = toxicity.toxicity(docs, labels).collect()
    assert len(scored) == len(brute.HARD) + len(rows) and all(0 <= r.score <= 1 for r in scored)
    for chosen in (labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, chosen).collect())
    assert toxicity.toxicity(brute.frame(spark, []), labels).count() == 0


def test_long_texts_are_scored_in_parts(monkeypatch):
    text = (b"some words and idiots " * 50).strip()
    random = np.random.default_rng(0)
    tables = toxicity.Tables(
        random.normal(size=(1, 1 << toxicity.EXPRESSION_BITS)).astype(np.float32), np.zeros(1 << toxicity.EXPRESSION_BITS, np.uint16),
        random.normal(size=(1, 1 << toxicity.CONTEXT_BITS)).astype(np.float32), np.zeros(1 << toxicity.CONTEXT_BITS, np.uint16),
    )
    whole = tables.ratio(text, 0)
    monkeypatch.setattr(toxicity, "STEP_BYTES", 37)
    assert tables.ratio(text, 0) == pytest.approx(whole)


@pytest.mark.parametrize("bits", [1, 12])
def test_every_counted_expression_is_scored_as_such(spark, monkeypatch, bits):
    """Tables that begin too small for the expressions grow; rare ones are not pushed out by frequent ones."""
    monkeypatch.setattr(toxicity, "EXPRESSION_BITS", bits)
    monkeypatch.setattr(toxicity, "CONTEXT_BITS", bits)
    rows = [(i, f"{t} rare{i} word{i * i}", y) for i, t, y in labelled_rows()]
    labels = brute.frame(spark, [(i, y) for i, _, y in rows], "doc_id long, toxic int")
    tables = toxicity.fit(brute.frame(spark, [(i, t) for i, t, _ in rows]), labels)
    taught = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    keys = np.unique(np.concatenate([toxicity.expressions(t.encode())[0] for t, _ in taught]))
    assert (toxicity._find(keys, tables.seen_keys) >= 0).all() and (toxicity._find(keys >> 8, tables.context_keys) >= 0).all()
    assert (tables.seen_keys != 0).sum() == len(keys) and (tables.context_keys != 0).sum() == len(np.unique(keys >> 8))
    ratio = plain_ratios([t for t, _ in taught], [y for _, y in taught], [t for _, t, _ in rows])
    for text in ("rare3 word9 idiots", "the tree rare0", "scum rare5", rows[0][1], rows[1][1]):
        assert tables.ratio(text.encode(), 2) == pytest.approx(ratio(text), rel=1e-3, abs=1e-6)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([4, 24, 56]))
def test_hash_tables_hold_every_key_and_no_other(n, least_bits, seed, width):
    random = np.random.default_rng(seed)
    keys = np.unique(random.integers(0, 1 << width, n))
    random.shuffle(keys)
    table, slots = toxicity._place(keys, least_bits)
    assert (toxicity._find(keys, table) == slots).all() and len(set(slots.tolist())) == len(keys)
    others = np.setdiff1d(random.integers(0, 1 << width, 3000), keys)
    assert (toxicity._find(others, table) == -1).all()


def test_op3_query_finds_held_out_toxic_documents(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    rows = queries.op3_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.01


# ---- language


def test_subwords_stay_within_words():
    one, two = langid.subwords(b"ab cd"), langid.subwords(b"cd, AB")
    assert (one == two).all() and one.sum() == 6  # per word: with one border, and with both
    long = b"abc def " * 400_000
    assert langid.subwords(long).sum() >= 400_000 * 4


def test_language_rows(spark):
    docs = brute.frame(spark, brute.HARD).withColumn("lang", F.lit("xx"))
    got = langid.identify(docs).collect()
    assert len(got) == len(brute.HARD)
    for r in got:
        assert r.lang_pred in ("xx", "und") and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 14)} == {"und"}
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def plain_subwords(text):
    """Slots of the byte 3- and 4-grams of a text's words with a border on either side."""
    out = []
    clean = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]", b" ", text.lower())
    clean = b" " + clean + b" "
    for size in (3, 4):
        for i in range(len(clean) - size + 1):
            gram = clean[i : i + size]
            if b" " in gram[1:-1]:
                continue
            mixed = 0
            for byte in gram:
                mixed = (mixed * 0x01000193 ^ byte) & 0xFFFFFFFF
            out.append(((mixed ^ size) * 0x85EBCA6B & 0xFFFFFFFF) >> 18)
    return out


def plain_model(texts, labels):
    """The model trained step by step over lists of subwords: returns the embeddings and the softmax."""
    languages = sorted(set(labels))
    weight = {x: len(labels) / (len(languages) * labels.count(x)) for x in languages}
    random = np.random.default_rng(0)
    embedding, output = random.normal(0, 0.1, (langid.ROWS, langid.WIDTH)), np.zeros((langid.WIDTH, len(languages)))
    held = [i % 10 == 9 and len(texts) >= 100 for i in range(len(texts))]
    fitted = np.array([i for i in range(len(texts)) if not held[i]])
    for epoch in range(langid.EPOCHS):
        rate = langid.RATE * (1 - epoch / langid.EPOCHS)
        for i in random.permutation(fitted):
            slots = texts[i]
            mean = sum((embedding[s] for s in slots), np.zeros(langid.WIDTH)) / max(1, len(slots))
            p = np.exp(mean @ output - (mean @ output).max())
            error = p / p.sum() - np.array([x == labels[i] for x in languages])
            error = error * min(4.0, weight[labels[i]])
            back = output @ error
            output -= rate * np.outer(mean, error)
            for s in slots:
                embedding[s] -= rate * 0.1 * langid.ROWS**0.5 * back / len(slots)
    return languages, embedding, output


def test_language_model_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 2)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"), "lang")
    model = langid.fit(docs, crc_third(F.col("doc_id")) != 1)
    # The same rows in the same order: all of a table this small, by their hash.
    rows = docs.where((crc_third(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("order", F.xxhash64("doc_id", "text")).orderBy("order").collect()
    texts = [plain_subwords(r.text.encode()) for r in rows]
    languages, embedding, output = plain_model(texts, [r.lang for r in rows])
    assert languages == model.languages and len(languages) > 2
    assert np.allclose(embedding @ output, model.scores, atol=1e-9)
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.collect():
        slots = plain_subwords((r.text or "").encode())
        if not any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == "und"
            continue
        z = np.mean([embedding[s] for s in slots] or [np.zeros(langid.WIDTH)], axis=0) @ output / model.temperature
        p = np.exp(z - z.max())
        assert got[r.doc_id].score == pytest.approx(p.max() / p.sum(), abs=1e-9)
        assert got[r.doc_id].lang_pred == languages[int(z.argmax())]


def test_every_language_is_learnt(spark, monkeypatch):
    """However many there are, each keeps some rows."""
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 40)
    rows = [(i, f"{'abcdefghij'[i % 10] * 3}{'klmnop'[i // 10 % 6] * 3} word", f"l{i % 60:02d}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    assert len(model.languages) == 60


def test_op6_query_is_right_on_held_out_documents(spark):
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = queries.op6_language_id(spark, SMALL).join(truth, "doc_id").where("held_out and lang is not null").collect()
    right = [r.lang_pred == r.lang for r in rows]
    assert np.mean(right) > 0.97
    sure = [x for x, r in zip(right, rows, strict=True) if not r.rejected]
    assert len(sure) > 0.8 * len(rows) and np.mean(sure) >= np.mean(right)


# ---- archives


def pages_of(rows, spark):
    return brute.frame(spark, rows, "page_id long, url string, html string")


def plain_records(rows):
    first = {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(first.get(data, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page_id
        out.append((None if page_id is None else str(page_id), len(data), brute.sha(data), "revisit" if revisit else "response", str(other) if revisit else None))
    return out


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    long = "<p>" + "copy " * 100
    rows = [(i, f"http://x/{i}", f"<html>page {i} {'word ' * (i % 50)}</html>") for i in range(200)]
    rows += [(500, None, None), (501, "", ""), (502, "http://é/ %41\r\n x", "é" * 60), (503, "u", long), (504, "u", long), (504, "u", long), (None, "u", long), (505, "u", "x" * 99), (506, "u", "x" * 99), (507, "u", "WARC/1.1\r\n\r\n" * 20), (508, "u", "z" * 300_000)]
    got = warc.round_trip(pages_of(rows, spark)).collect()
    assert not [r.error for r in got if r.error]
    assert counted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == counted(plain_records(rows))
    whole = {r.page_id: r for r in got}
    assert whole["502"].url == "http://é/ %41\r\n x" and whole["500"].url is None and bytes(whole["508"].payload) == b"z" * 300_000
    assert whole["504"].payload is None and len({r.archive for r in got}) > 1
    assert warc.round_trip(pages_of([], spark)).count() == 0


def test_op8_query(spark):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    got = queries.op8_warc(spark, SMALL).collect()
    want = [(int(i), n, d, kind, None if o is None else int(o)) for i, n, d, kind, o in plain_records(pages)]
    assert counted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == counted(want)


def test_damaged_archives_are_found():
    records = [warc.record(i, "u", b"text %d " % i * 40, brute.sha(b"text %d " % i * 40)) for i in range(40)]
    data = warc.archive(records)
    size = struct.unpack_from("<I", data, 4)[0]
    assert struct.unpack_from("<I", data)[0] == warc.SKIPPABLE and size > 0
    found = list(warc.frames(data))
    assert [r for _, r in found] == records
    plain = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])  # a dictionary may also stand there as it is
    bare = struct.pack("<II", warc.SKIPPABLE, len(plain)) + plain + data[8 + size :]
    assert [r for _, r in warc.frames(bare)] == records
    for bad in (data[:-3], data[: 8 + size // 2], data[: found[3][0] + 6] + b"\xff\xff" + data[found[3][0] + 8 :]):
        with pytest.raises(ValueError):
            list(warc.frames(bad))
    good = records[1]
    for bad in (
        good.replace(b"WARC/1.1", b"WARC/9", 1), good + b" ", good.replace(b"WARC-Type: response\r\n", b""),
        good.replace(b"text 1", b"text 2", 1), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), b"", b"WARC/1.1\r\n\r\n",
    ):
        with pytest.raises(ValueError):
            warc.parse(bad)


# ---- top-k


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(1, 6), st.integers(1, 12), st.integers(0, 10**6), st.sampled_from([2, 50, 1000]))
def test_sorted_lists_give_the_exact_best(n, dims, k, seed, spread):
    random = np.random.default_rng(seed)
    vectors = random.integers(-spread, spread + 1, (n, dims))
    ids = random.permutation(n * 2)[:n].astype(np.int64)
    query = random.integers(-spread, spread + 1, dims)
    skip = int(ids[0])
    found, scores, read = topk.SortedLists(ids, vectors).top(query, k, skip)
    assert 0 <= read <= 1
    want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != skip)[:k]
    assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(1, 5), st.integers(1, 6), st.integers(1, 90), st.integers(0, 10**6), st.sampled_from([2, 1000]))
def test_blocks_give_the_exact_best(n, dims, k, block_rows, seed, spread):
    random = np.random.default_rng(seed)
    vectors = random.integers(-spread, spread + 1, (n, dims))
    ids = random.permutation(n * 2)[:n].astype(np.int64)
    query = random.integers(-spread, spread + 1, dims)
    found, scores, _ = topk.Blocks(ids, vectors, block_rows).top(query, k, int(ids[-1]))
    want = sorted((-int(v @ query), int(i)) for i, v in zip(ids, vectors, strict=True) if i != ids[-1])[:k]
    assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want


def test_bounds_leave_candidates_out():
    """On clustered vectors the lists aren't read to the end."""
    random = np.random.default_rng(0)
    centres = random.normal(size=(30, 64))
    vectors = np.floor(200 * (centres[random.integers(30, size=12_000)] + 0.3 * random.normal(size=(12_000, 64)))).astype(np.int64)
    blocks = topk.Blocks(np.arange(12_000), vectors)
    read = []
    for i in range(0, 12_000, 600):
        found, scores, share = blocks.top(vectors[i], 10, i)
        read.append(share)
        exact = vectors @ vectors[i]
        exact[i] = np.iinfo(np.int64).min
        assert scores.tolist() == np.sort(exact)[::-1][:10].tolist()
    print("mean depth", np.mean(read))
    assert np.mean(read) < 0.8


def test_top_k_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, None), (6, [inf, 0.0]), (None, [9.0, 9.0]), (7, [-0.0004, -1.0]), (100, [0.25, 0.25])]
    table = brute.frame(spark, rows, "vec_id long, embedding array<float>")
    vectors = table.select("vec_id", topk.quantised(F.col("embedding"), 1024).alias("vector")).where("vector is not null")
    for block_rows in (1, 3, 100):
        got = topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 3, block_rows)
        quantised = {i: [math.floor(1024 * float(np.float32(x))) for x in v] for i, v in rows if i in (0, 1, 2, 7, 100)}
        want = []
        for q in (0, 100):
            scored = sorted((-(np.dot(quantised[q], v)), i) for i, v in quantised.items() if i != q)[:3]
            want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)]
        assert counted(got.collect()) == counted(want)
    assert topk.top_k(vectors.where("false"), vectors.where("vec_id = 0"), 3).count() == 0
    assert topk.top_k(vectors, vectors.where("false"), 3).count() == 0


def test_unreadable_records_end_the_query(spark, monkeypatch):
    broken = spark.createDataFrame([(1, 0, "", "response", None, "a cut frame")], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")
    monkeypatch.setattr(warc, "round_trip", lambda pages: broken)
    with pytest.raises(Exception, match="a cut frame"):
        queries.op8_warc(spark, SMALL).collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_agree_with_sql(spark, name):
    from compare import database, difference

    got = queries.QUERIES[name](spark, SMALL).toPandas()
    want = database(SMALL).execute(queries.ORACLE_SQL[name]).df()
    assert difference(got, want) is None


# ---- pipeline


def test_pipeline_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    clean = steps["toxicity"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    scored = {r.doc_id for r in queries.op3_toxicity(spark, SMALL).where("predicted = 0").collect()}
    assert {i for i, _ in rows(clean)} == scored
    good = steps["quality_rules"](spark, docs, SMALL)
    assert good.schema == docs.schema
    kept = rows(docs.join(quality.quality(docs).where("kept").select("doc_id"), "doc_id"))
    assert counted(rows(good)) == counted((i, "\n".join(x for x in t.split("\n") if not brute.plain_fails(x))) for i, t in kept)
    less = steps["line_dedup"](spark, good, SMALL)
    assert less.columns == docs.columns
    before = rows(good)
    assert counted(rows(less)) == counted((i, kept) for (i, _), (_, _, kept) in zip(before, brute.line_dedup(before, 10, 1), strict=True))
    few = steps["simhash_near_dedup"](spark, less, SMALL)
    assert few.columns == docs.columns
    before = rows(less)
    roots = brute.components([brute.simhash(t, 3) for _, t in before], 2)
    least = {}
    for (i, t), root in zip(before, roots, strict=True):
        least[root] = min(least.get(root, (i, t)), (i, t))
    assert counted(rows(few)) == counted(least.values())
    packed = steps["best_fit_packing"](spark, few, SMALL)
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in least.values()}


def test_pipeline_runs_on_hard_rows(spark):
    docs = brute.frame(spark, brute.HARD).withColumn("n_chars", F.length("text").cast("long"))
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.where("false"), FOLDER).count() == 0, name
        assert step(spark, docs, FOLDER).count() >= 0, name
    assert corpus_pipeline.run(spark, FOLDER).count() > 0




@pytest.mark.parametrize("held", [40, 2_500_000])
def test_toxicity_counts_by_slot(spark, monkeypatch, held):
    monkeypatch.setattr(toxicity, "HELD", held)
    rows = [(text, slot) for i, (_, text) in enumerate(brute.HARD) for slot in ({0, i % 5}) if slot or i % 2]
    want = {}
    for text, slot in rows:
        for key in toxicity.expressions((text or "").encode())[0].tolist():
            want.setdefault(key, [0] * 4)
            if slot:
                want[key][slot - 1] += 1
    counted = toxicity._counts(spark.createDataFrame(rows, "text string, slot int").repartition(2))
    assert {r.key: [r.c1, r.c2, r.c3, r.c4] for r in counted.collect()} == want and counted.count() == len(want)


def test_counting_lets_other_operators_memory_go(spark, monkeypatch):
    tasks = []
    rows = spark.createDataFrame([("one two three", 0)], "text string, slot int")
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: tasks.append(run) or spark.createDataFrame([], schema))
    toxicity._counts(rows)
    bpe.word_bpe(bpe.read_spec(queries.WORD_BPE))
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three"]), pa.array([0], pa.int32())], ["text", "slot"])
    (found,) = tasks[0](iter([batch]))
    assert found.num_rows == len(set(toxicity.expressions(b"one two three")[0].tolist()))
    assert bpe.word_bpe.cache_info().currsize == 0
