"""Quality rules, line first (operator 9). DataFrame functions only, no shuffle.

Each line is held against rules on its end, on navigation and on boilerplate; lines that fail go (``remove_failures``, ``clean_good``),
and a document is rejected that loses too much of its text (``keep_good``). Before that, a document must have enough
words and must not consist of repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.llm.common import SPACES, quoted

#: What ``n_symbols`` counts.
SYMBOLS = "#*$%&|<>"
WHITE = "[\\x20\\x09-\\x0D]+"
#: Limits of the base rules: words at least, and percent of words in repeated windows at most.
MIN_WORDS, MAX_REPEATED = 50, 50
#: A document is rejected if more than this percent of its word characters stood in failing lines.
MAX_LOST = 50
#: Percent of symbols, and of words that end in "!!", in a line from which on it fails.
MAX_SYMBOLS, MAX_SHOUTED = 5, 30
#: A line of prose ends so, before closing quotes and brackets; short lines without such an end fail.
PROSE_END = "[.!?…:;,。！？]['\"”’»)\\]]*\\z"
SHORT_LINE = 8
#: Phrases (lower case) of menus and of boilerplate; a line with one fails if it is short, as prose may quote it.
PHRASES = (
    "lorem ipsum", "cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "enable javascript", "skip to content", "sign in", "log in", "read more", "click here", "share on",
    "released under the", "subscribe to our",
)
PHRASE_LINE = 25


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _words(text: Column) -> Column:
    """The words of a text; the empty array if it has none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE, -1)).otherwise(F.array().cast("array<string>"))


def _repeated(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more, each word counted once.

    Windows are compared by a 64-bit hash. Most texts repeat none, which a set's size tells; else the hashes are
    sorted with their places, and equal neighbours show the places.
    """
    size = F.size(words)

    def places(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            pairs,
            lambda p: F.size(
                F.array_distinct(
                    F.flatten(
                        F.transform(
                            F.filter(
                                p,
                                lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) & (k > 0) | F.coalesce(F.get(p, k + 1)["h"] == x["h"], F.lit(False)),
                            ),
                            lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2),
                        )
                    )
                )
            ),
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(places(hashes))

    hashes = F.transform(
        F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(size < 4, F.lit(0)).otherwise(let(hashes, counted))


def line_fails(line: Column) -> Column:
    """Whether a line (with a word) fails the punctuation, navigation or boilerplate rules."""
    return let(F.btrim(line, F.lit(SPACES)), _bare_fails)


def _bare_fails(bare: Column) -> Column:
    n_words = F.regexp_count(bare, F.lit(WHITE)) + 1
    symbols = F.length(bare) - F.length(without(bare, SYMBOLS))
    separators = F.length(bare) - F.length(without(bare, "|»›>"))
    shouted = (F.length(bare) - F.length(F.replace(bare, F.lit("!!"), F.lit("")))) / 2
    lower = F.lower(bare)
    phrase = reduce(lambda a, b: a | b, (F.contains(lower, F.lit(p)) for p in PHRASES))
    return (
        (symbols * 100 >= F.length(bare) * MAX_SYMBOLS) & (symbols >= 2)
        | (separators >= 2) & (separators * 4 >= n_words)
        | (shouted >= 2) & (shouted * 100 >= n_words * MAX_SHOUTED)
        | (n_words <= PHRASE_LINE) & phrase
        | (n_words <= SHORT_LINE) & ~F.rlike(bare, F.lit(PROSE_END))
    )


def judged(text: Column) -> Column:
    """The lines of a text, not null, in order: ``line``, ``has_word``, and ``fails``; each is trimmed and judged once."""

    def one(line: Column) -> Column:
        def of(bare: Column) -> Column:
            has_word = F.length(bare) > 0
            return F.struct(line.alias("line"), has_word.alias("has_word"), (has_word & _bare_fails(bare)).alias("fails"))

        return let(F.btrim(line, F.lit(SPACES)), of)

    return F.transform(F.split(text, "\n", -1), one)


def _kept_lines(rows: Column) -> Column:
    return F.array_join(F.transform(F.filter(rows, lambda x: ~x["fails"]), lambda x: x["line"]), "\n")


def cleaned(text: Column) -> Column:
    """The text without its failing lines, the others as they are and in order, blank ones too; null stays null."""
    return let(text.cast("string"), lambda t: F.when(t.isNotNull(), _kept_lines(judged(t))))


def measures(text: Column, with_cleaned: bool = False) -> Column:
    """A struct with the base counts and the verdicts for a text; null counts as a text without words.

    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long), ``n_failed_lines, lost_chars`` (long),
    ``base_failed, kept`` (boolean), and if asked for ``cleaned``, the kept text's own lines without the failing ones
    (null where the text is not kept).
    """

    def of(text: Column) -> Column:
        chars = F.length(without(text, SPACES))

        def verdicts(base: Column) -> Column:
            base_failed = (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEATED * base["n_words"])
            kept = ~base_failed & (base["lost_chars"] * 100 <= base["word_chars"] * MAX_LOST)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "lost_chars")
            found = [*(base[n].cast("long").alias(n) for n in names), base_failed.alias("base_failed"), kept.alias("kept")]
            if with_cleaned:
                found.append(F.when(kept, _kept_lines(base["rows"])).alias("cleaned"))
            return F.struct(*found)

        def base(parts: Column) -> Column:
            found = [
                F.size(parts["words"]).alias("n_words"),
                chars.alias("word_chars"),
                (F.length(text) - F.length(without(text, SYMBOLS))).alias("n_symbols"),
                (F.size(parts["lines"]) - F.size(F.array_distinct(parts["lines"]))).alias("n_dup_lines"),
                _repeated(parts["words"]).alias("n_repeat_words"),
                F.size(parts["failed"]).alias("n_failed_lines"),
                F.length(without(F.array_join(parts["failed"], ""), SPACES)).alias("lost_chars"),
            ]
            return F.struct(*found, *[parts["rows"].alias("rows")] * with_cleaned)

        def split(rows: Column) -> Column:
            lines = F.transform(F.filter(rows, lambda x: x["has_word"]), lambda x: x["line"])
            failed = F.transform(F.filter(rows, lambda x: x["fails"]), lambda x: x["line"])
            found = [_words(text).alias("words"), lines.alias("lines"), failed.alias("failed")]
            return F.struct(*found, *[rows.alias("rows")] * with_cleaned)

        return let(let(let(judged(text), split), base), verdicts)

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the columns of ``measures`` for every row, repeated rows and null ids too.

    Other columns are left out; an empty table gives an empty one.
    """
    found = docs.select(docs[id_col].alias("doc_id"), measures(docs[text_col]).alias("found"))
    return found.select("doc_id", "found.*")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all columns as they are; null and empty texts are not kept."""
    return docs.where(measures(docs[text_col])["kept"])


def clean_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``keep_good`` plus ``_cleaned``, their text without failing lines; each text is judged once.

    A text counts as it came, so one that is kept may have lost up to ``MAX_LOST`` percent of its characters. A column
    ``_cleaned`` is replaced. An array of one cleaned text, or of none, is exploded: a filter would judge anew.
    """
    one = let(measures(docs[text_col], with_cleaned=True), lambda m: F.when(m["kept"], F.array(m["cleaned"])))
    return docs.select(*(docs[quoted(c)] for c in docs.columns if c != "_cleaned"), F.explode(one).alias("_cleaned"))


def remove_failures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, plus ``_cleaned``, the text without failing lines; a column of that name is replaced.

    Null texts stay null and empty ones empty.
    """
    return docs.withColumn("_cleaned", cleaned(docs[text_col]))


def oracle() -> str:
    """DuckDB SQL for ``quality`` over the table ``documents``."""
    space, word = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
    end = PROSE_END.replace("'", "''")
    bare = f"regexp_replace(line, '^{space}+|{space}+$', '', 'g')"

    def count(characters: str) -> str:
        return f"len(regexp_extract_all(bare, '{characters}'))"

    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '{word}+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM texts
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM parts)
), repeated AS (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS place
  FROM (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1)
), repeats AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM repeated GROUP BY doc_id
), lines AS (
  SELECT doc_id, {bare} AS bare FROM (SELECT doc_id, unnest(lines) AS line FROM parts)
), measured AS (
  SELECT *, {count(space + '+')} + 1 AS n_words, {count('[#*$%&|<>]')} AS symbols, {count('[|»›>]')} AS separators,
    {count('!!')} AS shouted
  FROM lines
), failed AS (
  SELECT doc_id, count(*) AS n, sum(length(regexp_replace(bare, '{space}', '', 'g'))) AS chars FROM measured
  WHERE symbols * 100 >= length(bare) * {MAX_SYMBOLS} AND symbols >= 2
    OR separators >= 2 AND separators * 4 >= n_words
    OR shouted >= 2 AND shouted * 100 >= n_words * {MAX_SHOUTED}
    OR n_words <= {PHRASE_LINE} AND regexp_matches(lower(bare), '{'|'.join(PHRASES)}')
    OR n_words <= {SHORT_LINE} AND NOT regexp_matches(bare, '{end}')
  GROUP BY doc_id
), base AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, coalesce(f.n, 0) AS n_failed_lines, coalesce(f.chars, 0)::BIGINT AS lost_chars
  FROM parts LEFT JOIN repeats r USING (doc_id) LEFT JOIN failed f USING (doc_id)
), judged AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST} AS kept FROM judged
"""
