"""Byte-pair encoding and decoding by a traversal of the distinct words' prefix trie (operator 10).

A sequence of tokens is what byte-pair merging makes of its text exactly if each two neighbours are: no merge
across their border comes before the merges that build them. So the last token of every prefix of a word says all
there is to know about that prefix: the encoding is found by stepping back token by token. The distinct words of a
batch form a trie; its depth-first order is their sorted order, and the states along the current path are a stack.
What two words share as a prefix is worked out once. A step down costs one lookup: an automaton over the vocabulary knows
the longest entry that a prefix ends with, and each entry the next shorter one.

Rules of the tokenizer file that are followed: added tokens are cut out first, then Unicode NFC, lower case
character by character, the file's splitting pattern, bytes as symbols, the last one marked with the word end.
White space never belongs to a word, so texts are first cut at ASCII white space, and what such a piece gives is
remembered in two generations: when the young one holds ``MEMO_PIECES`` pieces or ``MEMO_BYTES``, it becomes the old one,
whose pieces are forgotten unless they come up again. That bounds a worker's memory and changes no result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame

from nextrail.llm.common import KEEPERS, small_batches, text_of, utf8

#: Pieces, and bytes of them and their ids, in a generation of a worker's memory; a piece costs about 200 bytes.
MEMO_PIECES, MEMO_BYTES = 250_000, 24 << 20
#: Pairs of neighbours, and steps of the automaton beyond its trie, that a worker remembers.
MEMO_STEPS = 400_000
#: The supported layout of a tokenizer file.
WORD_END = "</w>"
#: Lengths to try where no longer token has the ending.
_SHORT = (2, 1)
#: The bytes that characters below U+0300 are written with.
_PLAIN = bytes(range(0xCC))


def byte_symbols() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in set(shown))
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for one tokenizer file (its JSON text); ``memo_pieces``: see ``MEMO_PIECES``."""

    def __init__(self, spec: str, memo_pieces: int | None = None) -> None:
        self._most = memo_pieces
        file = json.loads(spec)
        model, added = file["model"], file.get("added_tokens", [])
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or file.get("decoder"):
            raise ValueError("only byte-level BPE files with the word end </w> and without a decoder are supported")
        split = next(p for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._pattern = regex.compile(split["pattern"]["Regex"])
        vocab = model["vocab"]
        self.names = [""] * (1 + max([*vocab.values(), *(t["id"] for t in added)]))
        for name, token in vocab.items():
            self.names[token] = name
        for t in added:
            self.names[t["id"]] = t["content"]
        self._special = {t["content"]: t["id"] for t in added}
        found = "|".join(re.escape(s) for s in sorted(self._special, key=len, reverse=True))
        self._cut = re.compile(f"({found})") if found else None
        self._rare = [s.encode() for s in self._special]

        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self._rank[vocab[left], vocab[right]] = rank
            self._parts.setdefault(vocab[left + right], (vocab[left], vocab[right]))
        self._borders: list[dict[int, bool]] = [{} for _ in self.names]
        self._known = 0
        self._spines: dict[int, list[tuple[int, float]]] = {}

        to_byte = {c: b for b, c in enumerate(byte_symbols())}
        self._inner: dict[bytes, int] = {}  # tokens within a word
        self._last: dict[bytes, int] = {}  # tokens that end a word
        self._size = [0] * len(self.names)
        for name, token in vocab.items():
            if token in self._parts and not self._reachable(token):
                continue
            ends = name.endswith(WORD_END) and name != WORD_END
            text = bytes(to_byte[c] for c in (name[: -len(WORD_END)] if ends else name))
            (self._last if ends else self._inner)[text] = token
            self._size[token] = len(text)
        self._size.append(0)  # what stands for no token, number -1
        self._last_sizes = _sizes(self._last)
        self._grow()
        self._id4 = [i.to_bytes(4, "little") for i in range(len(self.names))]
        self._young: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}
        self._held = 0

    def _grow(self) -> None:
        """The automaton over the tokens within words: trie, failure links, longest token at a node, next shorter token."""
        edges, nodes, token_at = {}, [(0, 0)], {}
        for text, token in self._inner.items():
            node = 0
            for byte in text:
                key = node << 8 | byte
                if (child := edges.get(key)) is None:
                    child = edges[key] = len(nodes)
                    nodes.append((node, byte))
                node = child
            token_at[node] = token
        self._edges, self._moves = edges, {}
        self._fail, self._longest = [0] * len(nodes), [-1] * len(nodes)
        self._shorter = [-1] * len(self.names)
        depth = [0] * len(nodes)
        for node in range(1, len(nodes)):
            depth[node] = depth[nodes[node][0]] + 1
        for node in sorted(range(1, len(nodes)), key=depth.__getitem__):
            parent, byte = nodes[node]
            fail = self._fail[node] = self._step(self._fail[parent], byte) if parent else 0
            token = token_at.get(node)
            self._longest[node] = self._longest[fail] if token is None else token
            if token is not None:
                self._shorter[token] = self._longest[fail]

    def _step(self, node: int, byte: int) -> int:
        """Where the automaton goes from ``node``, by its trie and failure links."""
        while (found := self._edges.get(node << 8 | byte)) is None and node:
            node = self._fail[node]
        return found or 0

    def _move(self, key: int) -> int:
        if len(self._moves) > MEMO_STEPS:
            self._moves.clear()
        found = self._moves[key] = self._step(key >> 8, key & 255)
        return found

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens on the left (0) or right (1) edge of ``token``, each with the rank of the merge that ends it."""
        key = token << 1 | side
        edge = self._spines.get(key)
        if edge is None:
            edge, until = [(token, float("inf"))], token
            while (parts := self._parts.get(until)) is not None:
                edge.append((parts[side], self._rank[parts]))
                until = parts[side]
            self._spines[key] = edge
        return edge

    def _crossed(self, left: int, right: int, before: float) -> bool:
        """Whether a merge across the border of two tokens comes first; of equal ranks the leftmost merge wins."""
        rank_of, rights = self._rank.get, self._spine(right, 0)
        for a, a_ends in self._spine(left, 1):
            for b, b_ends in rights:
                rank = rank_of((a, b))
                if rank is not None and rank < a_ends and rank <= b_ends and rank < before:
                    return True
        return False

    def _reachable(self, token: int) -> bool:
        """Whether merging a vocabulary entry's own text ends in that entry."""
        parts = self._parts.get(token)
        return parts is None or (
            all(map(self._reachable, parts)) and not self._crossed(*parts, self._rank[parts])
        )

    def _neighbours(self, left: int, right: int) -> bool:
        if self._known > MEMO_STEPS:
            for known in self._borders:
                known.clear()
            self._known = 0
        self._known += 1
        fits = self._borders[left][right] = not self._crossed(left, right, float("inf"))
        return fits

    def _encode_sorted(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Distinct sorted words to ids: a depth-first walk through their trie, ``path`` being the way to the node.

        ``path[end]`` is the token in which the encoding of ``word[:end]`` ends: the one vocabulary entry that the
        prefix ends with and that can follow what the shorter prefix before it ends in. ``nodes[end]`` is where the
        automaton is after the same prefix.
        """
        path, nodes, before, out = [-1], [0], b"", {}
        size_of, id4, borders, fits = self._size, self._id4, self._borders, self._neighbours
        moves, move, longest, shorter = self._moves, self._move, self._longest, self._shorter
        last, last_sizes = self._last, self._last_sizes
        for word in words:
            length = len(word)
            shared, most = 0, min(len(before), length - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1 :], nodes[shared + 1 :]
            node = nodes[-1]
            for end in range(shared + 1, length):
                key = node << 8 | word[end - 1]
                node = moves.get(key)
                if node is None:
                    node = move(key)
                token = longest[node]
                while (size := size_of[token]) != end:
                    if not size:
                        raise ValueError("the vocabulary lacks a byte")
                    left = path[end - size]
                    known = borders[left].get(token)
                    if known or known is None and fits(left, token):
                        break
                    token = shorter[token]
                path.append(token)
                nodes.append(node)
            # The last symbol carries the word end; what it gives is no state of a prefix, so no longer word goes on from it.
            for size in last_sizes.get(word[-3:], _SHORT):
                if size > length or (token := last.get(word[length - size :])) is None:
                    continue
                if size == length:
                    break
                left = path[length - size]
                known = borders[left].get(token)
                if known or known is None and fits(left, token):
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            at, ids = length, []
            while True:
                ids.append(id4[token])
                at -= size_of[token]
                if not at:
                    break
                token = path[at]
            ids.reverse()
            out[word] = b"".join(ids)
            before = word
        return out

    def _words(self, piece: bytes) -> list[bytes | int]:
        """The words (as bytes) and added tokens (as ids) in a piece without ASCII white space."""
        if piece.isalpha():
            return [piece.lower()]
        if piece[:-1].isalpha() and piece[-1:] in (b".", b","):
            return [piece[:-1].lower(), piece[-1:]]
        text, out = piece.decode(), []
        if not piece.translate(None, _PLAIN) and (lower := text.lower()).isalpha():
            return [lower.encode()]
        for i, part in enumerate(self._cut.split(text) if self._cut else [text]):
            if i % 2:
                out.append(self._special[part])
            elif part:
                part = unicodedata.normalize("NFC", part)
                part = "".join(map(str.lower, part)) if "Σ" in part else part.lower()
                if part.isalpha():
                    out.append(part.encode())
                elif part[-1] in ".," and part[:-1].isalpha():
                    out += [part[:-1].encode(), part[-1].encode()]
                else:
                    out += [w.encode() for w in self._pattern.findall(part)]
        return out

    def _lower(self, text: bytes) -> bytes:
        """The text in lower case if it has only characters below U+0300, which no normalisation changes or joins."""
        if text.translate(None, _PLAIN):
            return text
        lower = text.lower() if text.isascii() else text.decode().lower().encode()
        return text if any(name in lower for name in self._rare) else lower

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        if len(self._young) > (self._most or MEMO_PIECES) or self._held > MEMO_BYTES:
            self._old, self._young, self._held = self._young, {}, 0
        young, old = self._young, self._old
        # Lower case first where that can't change anything else, so that fewer pieces differ.
        cut = [self._lower(t).split() for t in texts]
        whole, parts = [], {}
        for piece in set().union(*cut).difference(young):
            if (known := old.get(piece)) is not None:
                young[piece] = known
            elif piece.isalpha() and piece.islower():
                whole.append(piece)
            else:
                parts[piece] = self._words(piece)
        words = {w for ws in parts.values() for w in ws if not isinstance(w, int)}
        ids = self._encode_sorted(sorted(words.union(whole)))
        for piece in whole:
            young[piece] = ids[piece]
        for piece, found in parts.items():
            young[piece] = b"".join([self._id4[w] if isinstance(w, int) else ids[w] for w in found])
            self._held += len(piece) + len(young[piece])
        self._held += 5 * sum(map(len, whole))  # ids of four bytes, one a byte at most
        return [b"".join(map(young.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        """The tokens' names joined by spaces, which is how a file without a decoder is decoded."""
        numbers = memoryview(ids).cast("I")
        if len(numbers) < 2:
            return "".join(self.names[i] for i in numbers)
        return " ".join(itemgetter(*numbers)(self.names))


def _sizes(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """For each ending of three bytes the lengths of the tokens that have it, longest first, shorter ones after."""
    found: dict[bytes, set[int]] = {}
    for text in tokens:
        found.setdefault(text[-3:], {1, 2}).add(len(text))
    return {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in found.items()}


@lru_cache(maxsize=2)
def word_bpe(spec: str, memo_pieces: int | None = None) -> WordBpe:
    """One encoder per file and Python worker, until the worker's next operator asks to ``forget``."""
    return WordBpe(spec, memo_pieces)


KEEPERS.append(word_bpe.cache_clear)


def read_spec(path: str) -> str:
    """The tokenizer file, read on the driver and sent to the tasks (some MB, whatever the input)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """``doc_id, ids``: the ids of every whole text, as little-endian unsigned 32-bit integers.

    With ``decoded`` also the column ``decoded``: what those ids decode to, worked out in the same pass. A null text
    counts as empty and has no ids. Every row gives one row, repeated and null ids too; other columns are left out.
    No shuffle; memory holds a batch and the bounded memory of pieces, which a worker keeps for its next tasks.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))
    names = ["doc_id", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(spec.value)
        for batch in small_batches(batches, "text"):
            ids = coder.encode(utf8(batch, "text"))
            columns = [batch.column("doc_id"), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(coder.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = text_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, decoded``: the text that the ``ids`` of each row stand for. Null ids count as none."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(spec.value)
        for batch in small_batches(batches, "ids"):
            texts = pa.array(map(coder.decode, utf8(batch, "ids")), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
