"""One epoch of training batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from nextrail.config import SequenceConfig
from nextrail.operators.sequences import (
    assign_batches,
    build_examples,
    index_histories,
    vocabulary,
)
from nextrail.operators.skew import heavy_keys
from nextrail.sources.tables import stage


def training_examples(
    events: DataFrame,
    items: DataFrame,
    config: SequenceConfig = SequenceConfig(),
    epoch: int = 0,
    *,
    with_texts: bool = True,
    heavy: Sequence | None = None,
    heavy_items: Sequence | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The batched examples of one epoch, and the vocabulary.

    The indexed histories serve four joins and are staged once. ``heavy`` and ``heavy_items`` are the heavy
    users and items of the log, if they are known.
    """
    heavy = heavy_keys(events, "user_id") if heavy is None else heavy
    vocab = stage(vocabulary(items))
    histories = stage(index_histories(events, vocab, heavy=heavy, heavy_items=heavy_items))
    examples = build_examples(
        histories, vocab, vocab.count(), config, epoch, with_texts=with_texts, heavy=heavy
    )
    return assign_batches(stage(examples), config, epoch), vocab
