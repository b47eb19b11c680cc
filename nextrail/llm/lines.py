"""Line dedup: lines that many documents share go, everywhere (operator 4). DataFrame functions only.

Normalised lines are exploded as digests, distinct documents are counted per digest, and the places of the lines
over the threshold are gathered per text; what is left is put together by place. Only digests, ids and places are
grouped or joined on the way; texts meet the dropped places in one join on the text's own digest.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.llm.common import SPACES
from nextrail.sources.tables import stage

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` is quicker and does the same where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def digest(text: Column) -> Column:
    """128 bits, so that no two of 10^13 lines meet by chance."""
    return F.unhex(F.md5(text.cast("binary")))


def split_lines(text: Column) -> Column:
    """The lines of a text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _digests(text: Column, min_length: int) -> Column:
    """The keys' digests by line, null where the key is shorter than ``min_length`` code points."""
    keys = split_lines(ascii_lower(F.coalesce(text, F.lit(""))))
    return F.transform(keys, lambda x: F.when(F.length(line_key(x)) >= min_length, digest(line_key(x))))


def drop_common_lines(
    docs: DataFrame, min_docs: int, min_length: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """All columns of ``docs``, plus ``_n_lines``, ``_n_dropped`` (long) and ``_kept``, the text without common lines.

    A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of at least
    ``min_length`` code points found in at least ``min_docs`` documents (distinct ids; all null ids count as one)
    lose all their lines in every document. A null or empty text is one empty line; if no line is left, ``_kept``
    is the empty text. Every row gives one row, repeated rows too. Columns with one of the added names are replaced.
    """
    docs = docs.drop("_n_lines", "_n_dropped", "_kept", "_digest", "_places")
    text = docs[text_col].cast("string")
    of_text = digest(F.coalesce(text, F.lit("")))
    lines = docs.select(docs[id_col].alias("id"), of_text.alias("_digest"), F.posexplode(_digests(text, min_length)).alias("place", "key"))
    lines = stage(lines.where(F.col("key").isNotNull()))
    # Once per document first, so that a hot key's rows are spread before they are counted.
    common = lines.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs)
    # Equal texts lose the same lines, so places are gathered per distinct text.
    # Written, so that the rows of a hot key can be split where they meet it.
    common = stage(common.select("key"))
    places = lines.join(common, "key", "left_semi").select("_digest", "place").distinct()
    places = places.groupBy("_digest").agg(F.collect_list("place").alias("_places"))
    joined = docs.withColumn("_digest", of_text).join(places, "_digest", "left").drop("_digest")
    rows = split_lines(F.col(text_col).cast("string"))
    joined = joined.withColumn("_n_lines", F.size(rows).cast("long"))
    joined = joined.withColumn("_n_dropped", F.coalesce(F.size("_places"), F.lit(0)).cast("long"))
    joined = joined.withColumn("_n_dropped", F.greatest("_n_dropped", F.lit(0)))
    # The lines are split once and handed on as a lambda's variable; array_except looks places up by hash.
    kept_of = F.transform(
        F.array(rows),
        lambda r: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(r) - 1), F.col("_places")), lambda i: F.get(r, i)),
            "\n",
        ),
    )
    whole = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return joined.withColumn("_kept", F.when(F.col("_places").isNull(), whole).otherwise(F.get(kept_of, F.lit(0)))).drop("_places")


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.place) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
