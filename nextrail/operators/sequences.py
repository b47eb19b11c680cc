"""Training sequences with sampled positions, positives and negatives.

Everything is kept as one row per position until a sequence has been cut to its ``max_seq_length``, and
joined on (user, place), which spreads the longest history over all tasks. Arrays hold one sequence.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nextrail.config import SequenceConfig
from nextrail.functions.sampling import choose, choose_repeating, draw, shuffled
from nextrail.functions.text import safe_ratio
from nextrail.operators.skew import default_parts, heavy_keys, in_key_order, join_lookup, running_totals
from nextrail.schemas import ACTIVITY
from nextrail.sources.tables import stage

ROLES = ("history", "pos", "neg")


def vocabulary(items: DataFrame) -> DataFrame:
    """``item_idx`` 1..n per item, 0 being the padding.

    The order is that of a hash of the id: any order serves, and this one needs no global sort.
    """
    numbered = in_key_order(items, draw(F.col("item_id")), "item_idx", ties=["item_id"])
    return numbered.withColumn("item_idx", F.col("item_idx") + 1)


def index_histories(
    events: DataFrame,
    vocab: DataFrame,
    *,
    heavy: Sequence | None = None,
    heavy_items: Sequence | None = None,
) -> DataFrame:
    """Train events of known items by place in their user's history, cut after the last positive.

    ``hits`` counts the positives up to and including the row, ``total_hits`` those of the user. Users
    without a positive have no rows (B13).
    """
    order = [c for c in ACTIVITY if c != "item_text"]
    train = events.where("is_train").select("user_id", *order)
    known = join_lookup(
        train, vocab.select("item_id", "item_idx"), "item_id", "inner", heavy=heavy_items
    )
    known = known.withColumn("label", F.coalesce("label", F.lit(False)))
    placed = running_totals(
        known, "user_id", order, {"step": F.lit(1), "hit": F.col("label").cast("int")}, heavy=heavy
    )
    return placed.where(F.col("hit_before") < F.col("hit_total")).select(
        "user_id",
        F.col("step_before").alias("pos"),
        "item_id",
        "item_idx",
        "label",
        (F.col("hit_before") + F.col("label").cast("bigint")).alias("hits"),
        F.col("hit_total").alias("total_hits"),
    )


def copies_of(histories: DataFrame, max_seq_length: int) -> DataFrame:
    """Each user as often as its history holds ``max_seq_length`` places, rounded up."""
    lengths = histories.groupBy("user_id").agg(F.count(F.lit(1)).alias("length"))
    last = F.expr(f"cast((length - 1) div {max_seq_length} as bigint)")
    # Blocks of copies are spread first: the longest history is no single task's work, and no single array. Their number of
    # partitions is given, since adaptive execution would put blocks, which are few bytes, into one task with all that is drawn for them.
    n_blocks = F.expr(f"((length - 1) div {max_seq_length}) div 4096")
    blocks = lengths.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks)))
    blocks = blocks.repartition(default_parts(histories), "user_id", "block")
    return blocks.select(
        "user_id",
        "length",
        F.explode(
            F.sequence(F.col("block") * 4096, F.least(last, F.col("block") * 4096 + 4095))
        ).alias("copy"),
    )


def sample_positions(copies: DataFrame, config: SequenceConfig, epoch: int = 0) -> DataFrame:
    """``places``: ascending sample of the places before the last one, all of them if they are few."""
    limit = F.lit(config.max_seq_length).cast("bigint")
    open_places = F.col("length") - 1
    drawn = choose(
        open_places,
        F.least(open_places, limit),
        F.lit("place"), F.lit(config.seed), F.lit(epoch), F.col("user_id"), F.col("copy"),
    )
    return copies.withColumn("places", F.array_sort(drawn))


def sample_positives(
    samples: DataFrame, histories: DataFrame, config: SequenceConfig, epoch: int = 0
) -> DataFrame:
    """One row per sampled place with its item and a drawn later positive, 0 if there is none.

    The positives of a user are numbered, so the later ones are a range of numbers and the choice is a
    number: the item follows by a join on it. Both sides of the joins are as long as the log, so none is sent whole to all tasks,
    however small the samples or the histories look before they are laid out as rows.
    """
    slots = samples.select(
        "user_id", "copy", "length", F.posexplode("places").alias("slot", "pos")
    )
    places = histories.select(
        "user_id", "pos", F.col("item_idx").alias("history_item_idx"), "hits", "total_hits"
    )
    slots = slots.join(places.hint("merge"), ["user_id", "pos"])
    if config.pos_lookahead > 0:
        ends = histories.select("user_id", F.col("pos").alias("end"), F.col("hits").alias("to"))
        end = F.least(F.col("pos") + config.pos_lookahead, F.col("length") - 1)
        slots = slots.withColumn("end", end).join(ends.hint("merge"), ["user_id", "end"]).drop("end")
    else:
        slots = slots.withColumn("to", F.col("total_hits"))
    later = F.col("to") - F.col("hits")
    pick = F.pmod(
        draw(
            F.lit("positive"), F.lit(config.seed), F.lit(epoch),
            F.col("user_id"), F.col("copy"), F.col("pos"),
        ),
        later,
    )
    chosen = slots.withColumn("nth", F.when(later > 0, F.col("hits") + 1 + pick))
    positives = histories.where("label").select(
        "user_id", F.col("hits").alias("nth"), F.col("item_idx").alias("pos_item_idx")
    )
    # A row without a choice keeps its user and a number no positive has, so it stays spread by (user, place).
    chosen = chosen.withColumn("nth", F.coalesce("nth", -F.col("pos") - 1))
    return chosen.join(positives.hint("merge"), ["user_id", "nth"], "left").select(
        "user_id", "copy", "slot", "pos", "history_item_idx",
        F.coalesce("pos_item_idx", F.lit(0)).cast("bigint").alias("pos_item_idx"),
    )


def sample_negatives(
    samples: DataFrame,
    histories: DataFrame,
    n_items: int,
    config: SequenceConfig,
    epoch: int = 0,
    *,
    heavy: Sequence | None = None,
) -> DataFrame:
    """As many items per sequence as it has places, uniform over those not in the history.

    Without replacement if enough items are left, else with; over all items if none is left. The draw is a
    number r among the items left, and the r-th item left is r plus the number of seen items below it, so
    neither the catalogue nor its difference to a history is ever listed per user.
    """
    seen = running_totals(
        histories.select("user_id", "item_idx").distinct(),
        "user_id",
        ["item_idx"],
        {"seen": F.lit(1)},
        heavy=heavy,
        spread=True,
    )
    # By the user, as the totals are: no further shuffle.
    n_seen = seen.groupBy("user_id").agg(F.max("seen_total").alias("n_seen"))

    key = (F.lit("negative"), F.lit(config.seed), F.lit(epoch), F.col("user_id"), F.col("copy"))
    wanted = F.size("places").cast("bigint")
    left = F.lit(n_items) - F.col("n_seen")
    pool = F.when(left > 0, left).otherwise(F.lit(n_items)).cast("bigint")
    ranks = (
        F.when(pool >= wanted, shuffled(choose(pool, F.least(wanted, pool), *key), F.lit("order"), *key))
        .otherwise(choose_repeating(pool, wanted, *key))
    )
    draws = join_lookup(samples, n_seen, "user_id", "inner", heavy=heavy).select(
        "user_id", "copy", (left > 0).alias("skips_seen"), F.posexplode(ranks).alias("slot", "rank")
    )

    # Seen item number k (from 0) at ordinal s lies below s - 1 - k unseen ones: it precedes every rank from there on.
    marks = seen.select(
        "user_id",
        (F.col("item_idx") - 1 - F.col("seen_before")).alias("rank"),
        F.lit(0).alias("is_draw"),
        F.lit(None).cast("bigint").alias("copy"),
        F.lit(None).cast("int").alias("slot"),
        F.col("item_idx").alias("seen_idx"),
    )
    asked = draws.where("skips_seen").select(
        "user_id", "rank", F.lit(1).alias("is_draw"), "copy", "slot",
        F.lit(None).cast("bigint").alias("seen_idx"),
    )
    merged = running_totals(
        marks.unionByName(asked), "user_id", ["rank", "is_draw"], {"mark": 1 - F.col("is_draw")}, heavy=heavy
    )
    found = merged.where("is_draw = 1").select(
        "user_id", "copy", "slot", (F.col("rank") + 1 + F.col("mark_before")).alias("neg_item_idx")
    )
    whole = draws.where("NOT skips_seen").select(
        "user_id", "copy", "slot", (F.col("rank") + 1).alias("neg_item_idx")
    )
    return found.unionByName(whole)


def build_examples(
    histories: DataFrame,
    vocab: DataFrame,
    n_items: int,
    config: SequenceConfig = SequenceConfig(),
    epoch: int = 0,
    *,
    with_texts: bool = True,
    heavy: Sequence | None = None,
) -> DataFrame:
    """One row per user and copy: aligned lists of history, positive and negative items and texts.

    ``histories`` is read several times; pass a staged table. A history of one item gives empty lists.
    The text of a missing positive is NULL.
    """
    heavy = heavy_keys(histories, "user_id") if heavy is None else heavy
    # Staged, because they are read three times and drawing them costs more than reading them.
    samples = stage(sample_positions(copies_of(histories, config.max_seq_length), config, epoch))
    positives = sample_positives(samples, histories, config, epoch)
    negatives = sample_negatives(samples, histories, n_items, config, epoch, heavy=heavy)
    slots = positives.join(negatives, ["user_id", "copy", "slot"]).select(
        "user_id", "copy", "slot", *[f"{role}_item_idx" for role in ROLES]
    )
    if with_texts:
        # Staged, because the join looks at the items first.
        slots = _attach_texts(stage(slots), vocab)

    columns = [f"{role}_item_idx" for role in ROLES]
    columns += [f"{role}_item_text" for role in ROLES] if with_texts else []
    entry = F.struct("slot", *columns)
    lists = slots.groupBy("user_id", "copy").agg(F.sort_array(F.collect_list(entry)).alias("slots"))
    full = samples.select("user_id", "copy").join(lists, ["user_id", "copy"], "left")
    none = F.array().cast(lists.schema["slots"].dataType)
    return full.withColumn("slots", F.coalesce("slots", none)).select(
        "user_id", "copy", *[F.col("slots").getField(c).alias(c) for c in columns]
    )


def _attach_texts(slots: DataFrame, vocab: DataFrame) -> DataFrame:
    """All three items of a slot take their text in one join."""
    role = F.explode(
        F.array(
            *[
                F.struct(F.lit(r).alias("role"), F.col(f"{r}_item_idx").alias("item_idx"))
                for r in ROLES
            ]
        )
    )
    items = slots.select("user_id", "copy", "slot", role.alias("item")).select(
        "user_id", "copy", "slot", "item.role", "item.item_idx"
    )
    texts = join_lookup(items, vocab.select("item_idx", "item_text"), "item_idx")
    picked = []
    for r in ROLES:
        mine = F.col("role") == r
        picked.append(F.max(F.when(mine, F.col("item_idx"))).alias(f"{r}_item_idx"))
        picked.append(F.max(F.when(mine, F.col("item_text"))).alias(f"{r}_item_text"))
    return texts.groupBy("user_id", "copy", "slot").agg(*picked)


def assign_batches(
    examples: DataFrame, config: SequenceConfig = SequenceConfig(), epoch: int = 0
) -> DataFrame:
    """``batch_id``: the examples in a drawn order, ``batch_size`` at a time."""
    key = draw(F.lit("batch"), F.lit(config.seed), F.lit(epoch), F.col("user_id"), F.col("copy"))
    # Only the keys are numbered, in as many ranges as keep each small; the lists and texts join them by key.
    names = examples.select("user_id", "copy")
    ordered = in_key_order(names, key, "ordinal", ties=["user_id", "copy"])
    batch = F.expr(f"ordinal div {config.batch_size}").alias("batch_id")
    return examples.join(ordered.select("user_id", "copy", batch), ["user_id", "copy"])


def pad_batches(batched: DataFrame) -> DataFrame:
    """Item lists filled with 0 up to the longest of the batch."""
    longest = F.max(F.size("history_item_idx")).over(Window.partitionBy("batch_id"))
    out = batched.withColumn("seq_len", longest)
    for role in ROLES:
        items = F.col(f"{role}_item_idx")
        padding = F.array_repeat(F.lit(0).cast("bigint"), F.col("seq_len") - F.size(items))
        out = out.withColumn(f"{role}_item_idx", F.concat(items, padding))
    return out


def batch_stats(batched: DataFrame) -> DataFrame:
    """Shape and fill of each batch before padding."""
    filled = F.size("history_item_idx")
    hits = F.size(F.filter("pos_item_idx", lambda idx: idx != 0))
    shape = batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("size"),
        F.max(filled).cast("bigint").alias("seq_len"),
        F.sum(filled).alias("attention_non_zero"),
        F.sum(hits).alias("positive_non_zero"),
    )
    return shape.withColumn("numel", F.col("size") * F.col("seq_len")).withColumns(
        {
            "attention_density": safe_ratio(F.col("attention_non_zero"), F.col("numel")),
            "positive_density": safe_ratio(F.col("positive_non_zero"), F.col("attention_non_zero")),
        }
    )
