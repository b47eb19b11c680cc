"""Plain versions of the document operators, and rows that are hard to handle."""

import hashlib
import itertools
import re
from collections import Counter

import xxhash

from nextrail.llm import quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = "deep " * 3000 + "x" * 30000 + "\n" + "ünï códe. " * 500

#: (doc_id, text): nulls, empty and odd texts, ties, repeated rows.
HARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "One line."), (4, "One line."), (4, "Another text under the same id."),
    (None, "One line."), (None, None), (5, LONG), (6, "a"), (7, "a b"), (8, "a b c"), (9, "A B C"),
    (10, "Straße ÉCOLE İstanbul ΑΣ naïve é Å \x85 \xa0 \x1c <|endoftext|> it's"), (11, "\x00 zero \x00"),
    (12, "one two three one two three. " * 30), (13, "日本語 の テキスト"), (14, "!!!! ### |||"),
    *((20 + i, f"Shared line here\nown line {i}\n SHARED LINE HERE\t\n\nend {i}") for i in range(12)),
]


def frame(spark, rows, schema="doc_id long, text string", clash=True):
    """The rows as a table, with further columns whose names operators might use themselves."""
    table = spark.createDataFrame(rows, schema)
    if clash:
        for name in ("key", "score", "code", "_uid", "length", "a b`c", "_text", "ids", "slot", "group"):
            table = table.withColumn(name, table[table.columns[0]].cast("string"))
    return table


def words(text):
    return WORD.findall((text or "").encode())


def simhash(text, shingle):
    found = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    if not found:
        return 0
    width = min(shingle, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + width]), 42) for i in range(len(found) - width + 1)]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def components(codes, max_bits):
    """Root (smallest place) of each place, for codes linked within ``max_bits``."""
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= max_bits:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(codes))]


def line_dedup(rows, min_docs, min_length):
    """(n_lines, n_dropped, kept text) per row."""

    def key(line):
        line = line.strip(" \t\n\x0b\f\r")
        return "".join(c.lower() if c.isascii() else c for c in line)

    ids = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_length:
                ids.setdefault(key(line), set()).add(doc_id)
    common = {k for k, found in ids.items() if len(found) >= min_docs}
    out = []
    for _, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in common]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def base_rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    found = [w.decode() for w in words(text)]
    lines = [line for line in (text or "").split("\n") if words(line)]
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    times = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    n = len(found)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return n, sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(repeated), n < 50 or 100 * len(repeated) > 50 * n


def greedy_pieces(word, entries):
    count = at = 0
    while at < len(word):
        at = next(end for end in range(len(word), at, -1) if word[at:end] in entries)
        count += 1
    return count


def sha(data):
    return hashlib.sha256(data).hexdigest()


def plain_fails(line):
    """The line rules of quality.py, written out for one line."""
    bare = line.strip(quality.SPACES)
    if not bare:
        return False
    n_words = len(words(bare))
    symbols, separators = (sum(c in some for c in bare) for some in ("#*$%&|<>", "|»›>"))
    shouted = bare.count("!!")
    prose = re.search("[.!?…:;,。！？]['\"”’»)\\]]*\\Z", bare)
    return (
        symbols >= 2 and symbols * 100 >= 5 * len(bare)
        or separators >= 2 and separators * 4 >= n_words
        or shouted >= 2 and shouted * 100 >= 30 * n_words
        or n_words <= 25 and any(p in bare.lower() for p in quality.PHRASES)
        or n_words <= 8 and not prose
    )
