"""SimHash near-dedup with a hierarchical index in Gray order (operator 7).

Sorted by Gray rank (the place of a fingerprint, read as a Gray code), fingerprints that share many bits stand
together. Each run of ``FAN`` neighbours gets an upper node with the bits that all of them share; a child keeps only
the bits its parent doesn't have. A search adds up differences on the way down and leaves a whole subtree as soon as
they exceed the limit.

Spread over Spark: distinct fingerprints are dealt to groups, ranges of the Gray rank. The shared bits of
the groups are the leaves of a top index, by which each fingerprint finds the groups that can hold a partner. Each group
builds its own index, lets the fingerprints sent to it pass, and gives a spanning set of links, never all pairs. The
links are joined to components by alternating star contractions, all as DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.llm.common import small_batches, text_of, utf8
from nextrail.sources.tables import stage

#: Children of an index node; fingerprints in a group, and groups at most (beyond that groups grow): the top index
#: that all tasks get is at most 65 536 nodes of 16 bytes and their parents.
FAN, GROUP, MOST_GROUPS = 16, 1 << 16, 1 << 16
#: Fingerprints searched for at once.
CHUNK = 512
SEED = 42
#: Bytes of row numbers up to which the rows to be dropped are broadcast.
SHARED_BYTES = 32 << 20


def fingerprint(text: bytes, shingle: int) -> int:
    """The SimHash of a text's word shingles; 0 without words."""
    words = text.lower().split()  # bytes: A-Z alone is lower-cased, ASCII white space alone splits
    if not words:
        return 0
    width = min(shingle, len(words))
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    total = len(words) - width + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, total)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The rank at which each 64-bit word appears in the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def gray_rank_column(code: Column) -> Column:
    """``gray_rank`` of a long, as a long that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Masked bit patterns in Gray order under a tree of the bits that they share."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None) -> None:
        """``patterns`` in Gray order; ``masks`` marks the bits that are known, all by default."""
        masks = np.full(len(patterns), ~np.uint64(0)) if masks is None else masks
        levels = [(patterns & masks, masks)]
        while len(levels[-1][0]) > FAN:
            pattern, mask = levels[-1]
            starts = np.arange(0, len(pattern), FAN)
            ones = np.bitwise_and.reduceat(pattern, starts)
            any_one = np.bitwise_or.reduceat(pattern, starts)
            mask = np.bitwise_and.reduceat(mask, starts) & (ones | ~any_one)
            levels.append((ones & mask, mask))
        # A node keeps the bits that its parent doesn't have already.
        self._levels = []
        for depth, (pattern, mask) in enumerate(levels):
            own = mask
            if depth + 1 < len(levels):
                own = mask & ~levels[depth + 1][1][np.arange(len(mask)) // FAN]
            self._levels.append((pattern, own))

    def search(self, codes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``codes``, place of a leaf) with at most ``limit`` differences in the known bits."""
        top = len(self._levels[-1][0])
        query, node = np.repeat(np.arange(len(codes)), top), np.tile(np.arange(top), len(codes))
        differ = np.zeros(len(query), np.uint8)
        for depth in range(len(self._levels) - 1, -1, -1):
            pattern, own = self._levels[depth]
            differ = differ + np.bitwise_count((codes[query] ^ pattern[node]) & own[node])
            near = np.flatnonzero(differ <= limit)
            query, node, differ = query[near], node[near], differ[near]
            if depth:
                child = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = np.flatnonzero(child < len(self._levels[depth - 1][0]))
                query, node, differ = np.repeat(query, FAN)[real], child[real], np.repeat(differ, FAN)[real]
        return query, node


class Sets:
    """Disjoint sets over 0..n-1, joined by arrays of pairs; each is known by its smallest member."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(self.root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while True:
                shorter = self.root[self.root]
                if (shorter == self.root).all():
                    break
                self.root = shorter


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, code``: the fingerprint of every whole text as a long; null texts have no words, their code is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            codes = np.array([fingerprint(t, shingle) for t in utf8(batch, "text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], ["doc_id", "code"])

    rows = text_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, code long")


def links(codes: DataFrame, max_bits: int) -> DataFrame:
    """``a, b``: links between distinct codes that differ in at most ``max_bits`` bits.

    Codes are connected by these links exactly if they are by all such pairs; there are at most as many links as
    codes and searches.
    """
    distinct = stage(codes.select("code").distinct())
    groups = min(MOST_GROUPS, max(1, -(-distinct.count() // GROUP)))
    rank = gray_rank_column(F.col("code"))
    ordered = distinct.repartitionByRange(groups, rank).sortWithinPartitions(rank)
    ordered = stage(ordered.withColumn("home", F.spark_partition_id()))
    # One row per group: the bits that all its fingerprints have or lack.
    nodes = ordered.groupBy("home").agg(F.bit_and("code").alias("ones"), F.bit_or("code").alias("any")).orderBy("home").toArrow()
    ones, some = (nodes.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("ones", "any"))
    homes = nodes.column("home").to_numpy()
    top = codes.sparkSession.sparkContext.broadcast((GrayIndex(ones, ones | ~some), homes))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, homes = top.value
            mine, code = batch.column("home").to_numpy(), batch.column("code").to_numpy()
            for at in range(0, len(code), CHUNK):
                query, node = index.search(code[at : at + CHUNK].view(np.uint64), max_bits)
                target = homes[node]
                later = target > mine[at + query]  # each two groups meet once
                query, target = query[later], target[later]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(target.astype(np.int32)), pa.array(np.ones(len(query), np.int8)), pa.array(code[at + query])],
                    ["home", "guest", "code"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held, index, sets, own = None, [], None, None, None

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        def settle() -> None:
            """All of a group's fingerprints are there: build its index and link them among themselves."""
            nonlocal index, sets, own
            own = np.concatenate(held).view(np.uint64)
            own = own[np.argsort(gray_rank(own))]
            index, sets = GrayIndex(own), Sets(len(own))
            for at in range(0, len(own), CHUNK):
                query, leaf = index.search(own[at : at + CHUNK], max_bits)
                sets.join(at + query, leaf)

        def close() -> Iterator[pa.RecordBatch]:
            if held and index is None:
                settle()
            if index is not None:
                linked = np.flatnonzero(sets.root != np.arange(len(own)))
                yield found(own[linked], own[sets.root[linked]])

        for batch in batches:
            at_home, guest, code = (batch.column(c).to_numpy() for c in ("home", "guest", "code"))
            borders = np.flatnonzero((at_home[1:] != at_home[:-1]) | (guest[1:] != guest[:-1])) + 1
            for start, end in zip([0, *borders], [*borders, len(code)], strict=True):
                if start == end:
                    continue
                if at_home[start] != home:
                    yield from close()
                    home, held, index = at_home[start], [], None
                if not guest[start]:
                    held.append(code[start:end])
                    continue
                if index is None:
                    settle()
                for at in range(start, end, CHUNK):
                    passing = code[at : min(end, at + CHUNK)].view(np.uint64)
                    query, leaf = index.search(passing, max_bits)
                    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else query
                    # All partners of one guest belong together; the guest is linked to one of them.
                    of = np.repeat(leaf[first], np.diff(np.r_[first, len(query)]))
                    sets.join(of, leaf)
                    yield found(passing[query[first]], own[leaf[first]])
        yield from close()

    sent = ordered.select("home", "code").mapInArrow(send, "home int, guest byte, code long")
    here = ordered.select("home", F.lit(0).cast("byte").alias("guest"), "code")
    met = here.unionByName(sent).repartitionById(groups, "home").sortWithinPartitions("home", "guest", "code")
    return met.mapInArrow(meet, "a long, b long")


def stars(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge (``a, b``) that isn't the smallest of its component.

    Large and small stars by turns: all larger neighbours of a node, then all smaller ones, are linked to the
    smallest of them, until nothing changes. A node's neighbours are never gathered; each turn is written once.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        least = stage(pairs.groupBy("a").agg(F.min("b").alias("m")))
        return pairs.join(least, "a").withColumn("m", F.least("a", "m"))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    now = mark(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a <> b").distinct())
        small = smallest(large)
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct())
        before, now = now, mark(edges)
        if now == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: 16 hex digits, and the smallest id reachable by links.

    Texts are linked if their fingerprints differ in at most ``max_bits`` bits; texts without words (null, empty)
    all have fingerprint 0 and are linked like any other. Repeated rows are linked to each other. Null ids never name a
    component unless all its ids are null. An empty table gives an empty one.
    """
    coded = stage(fingerprints(docs, shingle, id_col, text_col))
    roots = stars(links(coded, max_bits))
    least = coded.groupBy("code").agg(F.min("doc_id").alias("least"))
    rooted = stage(
        least.join(roots, least["code"] == roots["node"], "left").select("code", "least", F.coalesce("root", "code").alias("root"))
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(rooted.join(names, "root").select("code", "component_id"))
    return coded.join(named, "code").select(
        "doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: of its smallest id, null ids last, the first such row."""
    kept = stage(docs.withColumn("__simhash_uid", F.monotonically_increasing_id()))
    named = near_duplicates(kept, shingle, max_bits, "__simhash_uid", text_col).select(F.col("doc_id").alias("__simhash_uid"), F.col("component_id").alias("_of"))
    ids = kept.select("__simhash_uid", kept[id_col].alias("_id")).join(named, "__simhash_uid")
    several = ids.groupBy("_of").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "__simhash_uid")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    rest = ids.join(stage(several.where("_n > 1")), "_of").where(F.col("__simhash_uid") != F.col("_first.__simhash_uid"))
    rest = stage(rest.select("__simhash_uid"))
    # What goes is the smaller part as a rule: few enough rows are sent to the texts, not the texts to them.
    rest = F.broadcast(rest) if rest.count() * 8 <= SHARED_BYTES else rest
    return kept.join(rest, "__simhash_uid", "left_anti").drop("__simhash_uid")
