"""Document operators against plain versions, on hard rows and on whole small tables."""

import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

from nextrail.llm import bpe, lines, packing, quality, queries, simhash, wordpiece  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(queries.WORD_BPE)
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def coder():
    return bpe.WordBpe(bpe.read_spec(queries.WORD_BPE))


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]


def counted(rows):
    return Counter(map(tuple, rows))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbeéÉ́̈Σσİi't's \n\x85 中1²!.,<|endoftext|>")), max_size=4))
def test_bpe_equals_the_library(coder, library, texts):
    for text, ids in zip(texts, coder.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_forgets_without_changing_results(coder, library, documents, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 10)
    for _, text in documents[:20]:
        assert np.frombuffer(coder.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, library):
    got = bpe.encode(brute.frame(spark, brute.HARD), queries.WORD_BPE, decoded=True)
    want = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in brute.HARD]
    decoded = {tuple(ids): library.decode(ids, skip_special_tokens=False) for _, ids in want}
    rows = [(r.doc_id, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in got.collect()]
    assert counted(rows) == counted((i, tuple(ids), decoded[tuple(ids)]) for i, ids in want)
    again = bpe.decode(got.select("doc_id", "ids"), queries.WORD_BPE)
    assert counted(again.collect()) == counted((i, d) for i, _, d in rows)
    assert bpe.encode(brute.frame(spark, []), queries.WORD_BPE).count() == 0


def test_op10_query(spark, library, documents):
    got = {r.doc_id: r for r in queries.op10_bpe(spark, FOLDER).collect()}
    assert len(got) == len(documents)
    for i, text in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == brute.sha(np.array(ids, "<u4").tobytes())
        assert got[i].decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False).encode())


def sequences(rows, size):
    """Checks each sequence's places; returns the number of sequences."""
    found = defaultdict(list)
    for r in rows:
        found[r.sequence_id].append((r.offset, r.length))
    for places in found.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length >= 1
            at += length
        assert at <= size
    return len(found)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sum_of_squares_picks_the_smallest_sum(lengths):
    size, gaps = 20, []  # gaps of the bins, in order
    bins, offsets = packing.sum_of_squares(np.array(lengths, np.int64), size)
    for length, chosen, offset in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):

        def total(gap, length=length):
            left = Counter(g for g in gaps if g)
            left[gap] -= 1
            left[gap - length] += 1
            return sum(n * n for g, n in left.items() if g)

        fitting = [g for g in gaps if g >= length]
        if fitting:
            assert total(gaps[chosen]) == min(map(total, fitting))
        else:
            assert chosen == len(gaps)
            gaps.append(size)
        assert offset == size - gaps[chosen]
        gaps[chosen] -= length


def test_packing_rows(spark, library):
    pieces = packing.token_pieces(brute.frame(spark, brute.HARD), queries.WORD_BPE, 64)
    rows = packing.pack(pieces, 64, group_rows=20).collect()
    want = []
    for i, text in brute.HARD:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, at // 64, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for at in range(0, len(ids), 64)]
    assert counted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == counted(want)
    sequences(rows, 64)
    assert packing.pack(packing.token_pieces(brute.frame(spark, []), queries.WORD_BPE, 64), 64).count() == 0


def test_op2_query_needs_few_sequences(spark, library, documents):
    rows = queries.op2_best_fit_packing(spark, FOLDER).collect()
    tokens = sum(1 + len(library.encode(t or "", add_special_tokens=False).ids) for _, t in documents)
    assert sum(r.length for r in rows) == tokens
    assert sequences(rows, 2048) <= -(-tokens // 2048) + 1


def test_line_dedup_rows(spark):
    for min_docs, min_length in ((10, 1), (2, 0), (2, 5)):
        got = lines.drop_common_lines(brute.frame(spark, brute.HARD), min_docs, min_length)
        rows = [(r.doc_id, r._n_lines, r._n_dropped, r._kept) for r in got.collect()]
        want = brute.line_dedup(brute.HARD, min_docs, min_length)
        assert counted(rows) == counted((i, *w) for (i, _), w in zip(brute.HARD, want, strict=True))
    assert {"a b`c", "key", "text"} <= set(got.columns)
    assert lines.drop_common_lines(brute.frame(spark, []), 2, 1).count() == 0


def test_quality_rows(spark, documents):
    rows = brute.HARD + documents
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = quality.quality(brute.frame(spark, rows)).collect()
    assert counted((r.doc_id, *(r[n] for n in names)) for r in got) == counted((i, *brute.base_rules(t)) for i, t in rows)
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.quality(brute.frame(spark, [])).count() == 0


def test_quality_lines(spark):
    prose = "This is a sentence of plain prose that says something and ends well."
    cases = [
        (prose, False), ("He said “stop.”", False), ("A long heading without any end but with more than eight words in it", False),
        ("Home | About | Contact | Login", True), ("Read more", True), ("All rights reserved.", True), ("short title", True),
        ("WOW!! BUY!! NOW!! GO!!", True), ("a%%% b$$$ c### d&&& e*** f%%% g$$$ h###", True),
        ("We put the privacy policy up for a vote in the long meeting that was held on the last day of the old year, and nobody of us came to read it.", False),
    ]
    table = spark.createDataFrame([(i, line) for i, (line, _) in enumerate(cases)], "i int, line string")
    got = {r.i: r.fails for r in table.select("i", quality.line_fails(table.line).alias("fails")).collect()}
    assert [got[i] for i in range(len(cases))] == [bad for _, bad in cases]
    texts = [
        (1, "\n".join(f"Sentence number {i} of text {i * i} says thing {i + 7} plainly." for i in range(9))),
        (2, "\n".join(f"menu{i} | item{i} | go{i} | more{i}" for i in range(40))),
    ]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(brute.frame(spark, texts)).collect()}
    assert kept == {1: (False, True), 2: (False, False)}


def test_failed_lines_are_removed(spark, documents):
    mixed = "Home | About | Contact\n\n \nThis is a sentence of plain prose that ends well.\r\nRead more\n  Another one, kept with its spaces.  \n"
    rows = brute.HARD + documents + [(10_001, mixed), (10_002, "Read more"), (10_003, "\n\n")]
    got = quality.remove_failures(brute.frame(spark, rows)).collect()
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append(None if text is None else "\n".join(x for x in text.split("\n") if not brute.plain_fails(x)))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append(r._cleaned)
    key = lambda x: (x is not None, x or "")
    assert {i: sorted(x, key=key) for i, x in found.items()} == {i: sorted(x, key=key) for i, x in want.items()}
    assert found[10_001] == ["\n \nThis is a sentence of plain prose that ends well.\r\n  Another one, kept with its spaces.  \n"]
    # What is gone is what the operator counts.
    chars = lambda t: sum(c not in quality.SPACES for c in t or "")
    lost = counted((r.doc_id, chars(r.text) - chars(r._cleaned)) for r in got)
    assert lost == counted((r.doc_id, r.lost_chars) for r in quality.quality(brute.frame(spark, rows)).collect())


def test_kept_documents_are_cleaned_in_one_pass(spark, documents):
    rows = brute.HARD + documents + [(10_001, "Read more\n" + "Plain prose with some words that ends well. " * 12)]
    docs = brute.frame(spark, rows).withColumn("_cleaned", F.lit(1))
    kept = quality.keep_good(brute.frame(spark, rows)).collect()
    got = quality.clean_good(docs)
    assert got.columns == docs.columns
    want = [(r.doc_id, r.text, "\n".join(x for x in r.text.split("\n") if not brute.plain_fails(x))) for r in kept]
    assert counted((r.doc_id, r.text, r._cleaned) for r in got.collect()) == counted(want)
    assert any(text != clean for _, text, clean in want)
    assert quality.clean_good(docs.where("false")).count() == 0
    # The rules stand in the plan once.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lorem ipsum") == 1


def test_pipeline_hands_on_no_failed_line(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality_rules", "line_dedup", "simhash_near_dedup", "best_fit_packing"]
    docs = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "/root/testdata/sf0.01")
    rows = docs.collect()
    assert len(rows) > 500 and not any(brute.plain_fails(x) for r in rows for x in r.text.split("\n"))
    assert all(r.n_chars == len(r.text) for r in rows)
    assert docs.schema.names == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").schema.names


def test_clean_documents_are_kept(spark):
    labelled = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1").select("doc_id")
    got = queries.op9_quality_rules(spark, FOLDER).join(labelled, "doc_id").where("not base_failed")
    assert got.where("kept").count() == got.count() > 0


def test_gray_index_finds_all_pairs(monkeypatch):
    random = np.random.default_rng(5)
    base = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = np.uint64(1) << random.integers(0, 64, (40, 12), dtype=np.uint64)
    codes = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), random.integers(0, 1 << 63, 500, dtype=np.uint64)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    query, leaf = simhash.GrayIndex(codes).search(codes, 2)
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2
    assert set(zip(query.tolist(), leaf.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(near)), strict=True))


def test_gray_ranks_follow_the_gray_code(spark):
    ranks = np.arange(1 << 10, dtype=np.uint64)
    assert (simhash.gray_rank(ranks ^ (ranks >> np.uint64(1))) == ranks).all()
    codes = [-1, 0, 1, -(1 << 63), (1 << 63) - 1, 12345]
    got = spark.createDataFrame([(c,) for c in codes], "code long").select(simhash.gray_rank_column(F.col("code")).alias("r"))
    want = simhash.gray_rank(np.array(codes, np.int64).view(np.uint64)) ^ np.uint64(1 << 63)
    assert [r.r for r in got.collect()] == want.view(np.int64).tolist()


@pytest.mark.parametrize("group", [8, 1 << 16])
def test_links_join_what_is_near(spark, monkeypatch, group):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    random = np.random.default_rng(3)
    base = random.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = [int(b) for b in base]
    for b in base[:10]:  # chains: each step two bits further
        for _ in range(6):
            b ^= np.uint64((1 << int(random.integers(64))) | (1 << int(random.integers(64))))
            codes.append(int(b))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "code long")
    roots = {r.node: r.root for r in simhash.stars(simhash.links(table, 2)).collect()}
    got = [roots.get(c, c) for c in signed]
    want = brute.components(codes, 2)
    pairs = {(a, b) for a, b in zip(got, want, strict=True)}
    assert len(pairs) == len(set(got)) == len(set(want))


def near_copies(rows):
    codes = [brute.simhash(t, 3) for _, t in rows]
    of = defaultdict(list)
    for (i, _), root in zip(rows, brute.components(codes, 2), strict=True):
        of[root].append(i)
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in of.items()}
    return [(i, f"{c:016x}", least[r]) for (i, _), c, r in zip(rows, codes, brute.components(codes, 2), strict=True)]


def test_simhash_rows(spark):
    got = simhash.near_duplicates(brute.frame(spark, brute.HARD))
    assert counted(got.collect()) == counted(near_copies(brute.HARD))
    assert simhash.near_duplicates(brute.frame(spark, [])).count() == 0
    kept = simhash.keep_one(brute.frame(spark, brute.HARD)).collect()
    roots = brute.components([brute.simhash(t, 3) for _, t in brute.HARD], 2)
    least = dict(zip(roots, (c for _, _, c in near_copies(brute.HARD)), strict=True))
    assert counted((r.doc_id,) for r in kept) == counted((x,) for x in least.values())


def test_op7_query(spark, documents):
    assert counted(queries.op7_simhash(spark, FOLDER).collect()) == counted(near_copies(documents))


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text(st.sampled_from("abc"), min_size=2, max_size=5)), st.text(st.sampled_from("abc"), max_size=30))
def test_longest_match_counts(extra, word):
    entries = {bytes([b]) for b in range(256)} | {e.encode() for e in extra}
    assert wordpiece.LongestMatch(sorted(entries)).length(word.encode()) == brute.greedy_pieces(word.encode(), entries)


def test_token_count_rows(spark, documents):
    entries = set(wordpiece.byte_entries(bpe.read_spec(queries.BYTE_BPE)))
    rows = [r for r in brute.HARD if r[0] != 5] + documents[:40] + [(99, "z" * 2000 + " the " * 500)]
    got = wordpiece.token_counts(brute.frame(spark, rows), queries.BYTE_BPE)
    want = ((i, len(brute.words(t)), sum(brute.greedy_pieces(b" " + w, entries) for w in brute.words(t))) for i, t in rows)
    assert counted(got.collect()) == counted(want)
    assert queries.op5_token_counts(spark, FOLDER).count() == len(documents)
    assert wordpiece.token_counts(brute.frame(spark, []), queries.BYTE_BPE).count() == 0
