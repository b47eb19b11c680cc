"""A training-data pipeline over ``documents``: toxicity, quality rules, line dedup, near-dedup, packing.

Each stage takes (spark, docs, folder of the tables) and works on all that the one before kept. All but the last return
the columns of ``documents``; rows with nulls, empty texts and repeated rows pass as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nextrail.llm import lines, packing, quality, simhash, toxicity
from nextrail.llm.common import quoted, table
from nextrail.llm.queries import COMMON_LINE_DOCS, SEQUENCE, TOXIC, WORD_BPE
from nextrail.sources.tables import stage

#: Pieces that a worker remembers while packing; few, as it may hold the models of the first stage too.
MEMO_PIECES = 60_000


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below ``TOXIC``; the models learn from the documents given and the table ``labels``.

    Null and empty texts are scored like any other.
    """
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.classify(docs, model, "text", docs.columns).where(F.col("_score") < TOXIC).drop("_score")


def drop_poor(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality rules keep, without their failing lines; null and empty texts go."""
    found = quality.clean_good(docs)
    found = found.withColumn("text", F.col("_cleaned")).withColumn("n_chars", F.length("_cleaned").cast("long"))
    return found.select(*map(quoted, docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document without the lines that ``COMMON_LINE_DOCS`` or more share; a null text becomes empty."""
    found = lines.drop_common_lines(docs, COMMON_LINE_DOCS, 1)
    found = found.withColumn("text", F.col("_kept")).withColumn("n_chars", F.length("_kept").cast("long"))
    return found.select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies; texts without words are one group."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The places of the documents' token pieces in sequences; a null or empty text is its closing token alone."""
    pieces = packing.token_pieces(docs, WORD_BPE, SEQUENCE, memo_pieces=MEMO_PIECES)
    return packing.pack(pieces, SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_poor),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack),
]

#: No SQL can train and apply the first stage's models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over the whole table, each written to the shared folder and read again."""
    docs = table(spark, folder, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, folder)
        docs = docs if i == len(STAGES) - 1 else stage(docs)
    return docs


QUERIES = {"pipeline": run}
