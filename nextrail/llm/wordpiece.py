"""Token counts by a linear longest-match automaton (operator 5).

Greedy word pieces: from the left, the longest vocabulary entry is taken, again and again. The automaton reads each
byte once. Its states are the nodes of the vocabulary's trie; where a node has no child for the next byte, its
failure link leads to the node for what is left after the pieces that are certain by then are popped, and what
is kept of these pieces is only their number. So the length of a text in pieces is found without making a piece.

The vocabulary is that of a byte-level file: every byte is an entry, so nothing is unknown. A word is taken with
the space before it, as such vocabularies write it.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from nextrail.llm.bpe import byte_symbols, read_spec
from nextrail.llm.common import small_batches, text_of, utf8

#: Words whose piece count a Python worker remembers.
MEMO_WORDS = 500_000


class LongestMatch:
    """The automaton of a set of entries, among them every single byte."""

    def __init__(self, entries: list[bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for entry in entries:
            node = 0
            for byte in entry:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ends.append(False)
                node = children[node][byte]
            ends[node] = True
        if len(children[0]) < 256 or not all(ends[n] for n in children[0].values()):
            raise ValueError("every byte must be an entry")
        #: By node: where to go on if no child fits, and how many pieces that pops.
        fail, popped = [0] * len(children), [0] * len(children)
        queue = deque((0, byte, node) for byte, node in children[0].items())
        while queue:
            parent, byte, node = queue.popleft()
            if ends[node]:
                popped[node] = 1  # the whole way is the longest piece
            else:
                # As the parent, then on by the byte; at the root every byte has a child.
                at, popped[node] = fail[parent], popped[parent]
                while byte not in children[at]:
                    popped[node] += popped[at]
                    at = fail[at]
                fail[node] = children[at][byte]
            queue.extend((node, b, n) for b, n in children[node].items())
        #: Pieces left to pop when a word ends at a node: failure links lead to nodes nearer the root.
        rest = [0] * len(children)
        order = deque(children[0].values())
        while order:
            node = order.popleft()
            rest[node] = popped[node] + rest[fail[node]]
            order.extend(children[node].values())
        self._children, self._fail, self._popped, self._rest = children, fail, popped, rest
        self._memo: dict[bytes, int] = {}

    def length(self, word: bytes) -> int:
        """The number of greedy pieces of a string."""
        children, fail, popped = self._children, self._fail, self._popped
        node = count = 0
        for byte in word:
            step = children[node].get(byte)
            while step is None:
                count += popped[node]
                node = fail[node]
                step = children[node].get(byte)
            node = step
        return count + self._rest[node]

    def lengths(self, text: bytes) -> tuple[int, int]:
        """The number of words of a text and of their pieces."""
        words, memo = text.split(), self._memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words):
            if word not in memo:
                memo[word] = self.length(b" " + word)
        return len(words), sum(map(memo.__getitem__, words))


def byte_entries(spec: str) -> list[bytes]:
    """The entries of a byte-level tokenizer file (its JSON text), added tokens left out."""
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    file = json.loads(spec)
    added = {t["content"] for t in file.get("added_tokens", [])}
    return [bytes(to_byte[c] for c in name) for name in file["model"]["vocab"] if name not in added]


@lru_cache(maxsize=2)
def _automaton(spec: str) -> LongestMatch:
    return LongestMatch(byte_entries(spec))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens`` (long) of every whole text, words being what ASCII white space separates.

    Null and empty texts have none. Every row gives one row, repeated rows and null ids too; other columns are left
    out. One pass, no shuffle; a word of any length is read once, in memory that doesn't grow with it.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(spec.value)
        for batch in small_batches(batches, "text"):
            words, tokens = zip(*map(automaton.lengths, utf8(batch, "text")), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                ["doc_id", "n_words", "n_tokens"],
            )

    rows = text_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long")
