"""Toxicity by class-conditional Kneser-Ney models over the bytes of words (operator 3).

An expression is a byte with up to six bytes before it in its word. Per class (toxic, ordinary) the probability of
a byte after such a context is the discounted share in that class plus the discounted mass times a backoff that both
classes share: a Kneser-Ney model of continuation counts (in how many longer expressions does a shorter one
end?), taken from *all* documents, of orders 4 and 2. A word's probability is the product over its bytes and its end. As
the backoff is shared, an expression that neither class has seen adds only the ratio of the discounted masses of
its context, and one in a context that neither has seen adds nothing.

Toxic texts are ordinary prose for the most part, so the toxic likelihood of a word mixes the ordinary class's with a small share of
the toxic class's. Without that, what differs between the classes by chance, such as their share of languages, outweighs a few
toxic words (held out, an area under the curve of 0.75 instead of 0.98). A text's figure is the difference of its
log-likelihoods by its number of words.

Counts are Spark aggregates; no text is shuffled. What the tasks need for scoring are two hash tables with whole keys:
every expression and every context of the rows learnt from, in as many slots as they ask for. Two folds of the labelled rows give two models, and each scores the other's rows; the logistic curve through
those scores turns the final model's figures into probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nextrail.llm.common import crc_third, forget, give_back, quoted, small_batches, utf8
from nextrail.sources.tables import stage

#: Labelled rows of each class to learn from, at most (more are thinned out by a hash of the id): the labels that
#: are sent to all tasks are at most twice as many rows of 16 bytes.
LABELS_PER_CLASS = 30_000
#: Slots of the tables of expressions and of contexts at the least; twice the keys if that is more. A slot has 20 bytes.
EXPRESSION_BITS, CONTEXT_BITS = 21, 19
#: Bytes of text that are turned into arrays at once, and expressions of all slots that a task holds before it passes them on.
STEP_BYTES, HELD = 1 << 20, 2_500_000
#: Kneser-Ney discounts of the continuation counts and of a class's counts: what a class has once or twice tells nothing.
DISCOUNT, CLASS_DISCOUNT = 0.75, 2.0
#: Share of the toxic class's own model in a toxic text.
MIXED = 0.005
#: Bytes of an expression.
ORDER = 7

#: Words are cut at ASCII that is neither letter nor digit.
_CLEAN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(ORDER + 1)], np.int64)


def expressions(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The expressions of a text, in order, and the places among them where words begin.

    An expression is an integer: the byte itself lowest, those before it above, 0 before the word. ASCII letters
    are lower-cased; each word is closed by one space.
    """
    buffer = np.frombuffer(text.lower().translate(_CLEAN) + b" ", np.uint8)
    space = buffer == 32
    index = np.arange(len(buffer), dtype=np.int64)
    last = np.empty(len(buffer), np.int64)  # where the space before each byte is
    last[0] = -1
    np.maximum.accumulate(np.where(space, index, -1)[:-1], out=last[1:])
    depth = index - last
    keys = buffer.astype(np.int64)
    for back in range(1, min(ORDER, len(buffer))):
        keys[back:] |= buffer[:-back].astype(np.int64) << (8 * back)
    keys &= _MASKS[np.minimum(depth, ORDER)]
    of_word = ~space | (depth > 1)
    return keys[of_word], np.flatnonzero(depth[of_word] == 1)


def _home(stored: np.ndarray, bits: int) -> np.ndarray:
    """The slot from which on a stored key is looked for."""
    mixed = (stored.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _place(keys: np.ndarray, least_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash table of distinct keys and each one's slot: the first free one from its home on.

    A slot holds the key plus 1, or 0 if it is free. At most half of the 2^bits slots are taken; those after them
    take what the last ones push on, and the last of all is free.
    """
    bits = max(least_bits, (2 * len(keys)).bit_length())
    stored = keys.astype(np.int64) + 1
    home = _home(stored, bits)
    order = np.argsort(home, kind="stable")
    count = np.arange(len(keys))
    slots = np.empty(len(keys), np.int64)
    slots[order] = count + np.maximum.accumulate(home[order] - count)
    table = np.zeros(max(1 << bits, int(slots.max(initial=0)) + 2), np.int64)
    table[slots] = stored
    return table, slots


def _find(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for those that the table does not hold."""
    stored = keys + 1
    at = _home(stored, len(table).bit_length() - 1)
    there = table[at]
    hit = there == stored
    found = np.where(hit, at, -1)
    going = np.flatnonzero(~hit & (there != 0))
    at, stored = at[going], stored[going]
    while len(going):
        at = at + 1
        there = table[at]
        hit = there == stored
        found[going[hit]] = at[hit]
        on = ~hit & (there != 0)
        going, at, stored = going[on], at[on], stored[on]
    return found


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces; a word is never cut."""
    start = 0
    while len(text) - start > STEP_BYTES:
        end = text.find(b" ", start + STEP_BYTES)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


@dataclass
class Tables:
    """Log ratios (toxic over ordinary) by slot, one row per model, with the keys; and the curve's coefficients."""

    seen: np.ndarray
    seen_keys: np.ndarray
    context: np.ndarray
    context_keys: np.ndarray
    curve: tuple[float, float, float] = (1.0, 0.0, 0.0)

    def ratio(self, text: bytes, model: int) -> float:
        """The difference of the two log-likelihoods over the number of words; 0 for a text without words."""
        total, length = 0.0, 0
        for part in _parts(text):
            keys, words = expressions(part)
            if not len(words):
                continue
            slot = _find(keys, self.seen_keys)
            values = self.seen[model, slot]
            unknown = np.flatnonzero(slot < 0)
            slot = _find(keys[unknown] >> 8, self.context_keys)
            values[unknown] = np.where(slot >= 0, self.context[model, slot], 0)
            own = np.add.reduceat(values.astype(np.float64), words)
            total += float(np.log1p(MIXED * np.expm1(np.minimum(own, 50.0))).sum())
            length += len(words)
        return total / length if length else 0.0

    def score(self, ratio: float) -> float:
        scale, slope, base = self.curve
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, slope * math.asinh(ratio / scale) + base))))


def _labelled(labels: DataFrame, keep: Column, id_col: str, label_col: str) -> tuple[DataFrame, dict[int, float]]:
    """A bounded sample of the rows to learn from, one per id, and the share taken of each class."""
    rows = (
        labels.select(labels[id_col].alias("_id"), labels[label_col].cast("int").alias("_label"))
        .where(keep & F.col("_id").isNotNull() & F.col("_label").isin(0, 1))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    found = {r["_label"]: r["count"] for r in rows.groupBy("_label").count().collect()}
    shares = {k: min(1.0, LABELS_PER_CLASS / n) for k, n in found.items()}
    drawn = F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1_000_000)) / 1_000_000
    limit = F.when(F.col("_label") == 1, shares.get(1, 1.0)).otherwise(shares.get(0, 1.0))
    return rows.where(drawn < limit), shares


def _counts(rows: DataFrame) -> DataFrame:
    """``key, c1..c4``: expressions with their counts per slot (1-4: toxic/ordinary of folds A and B) over all texts."""

    def merged(slot: int, parts: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray | None]:
        """Distinct keys, sorted, with the sums of their counts, which slot 0 needs none of; empties ``parts``."""
        if len(parts) == 1:
            return parts.pop()
        keys = np.concatenate([k for k, _ in parts])
        n = np.concatenate([n for _, n in parts]) if slot else None
        parts.clear()
        if slot:
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
        else:
            keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first) if slot else None

    def passed_on(held: dict[int, list[tuple[np.ndarray, np.ndarray | None]]]) -> Iterator[pa.RecordBatch]:
        """A row for each key of a span of keys, of which slots have as many as there are rows at most; empties ``held``."""
        found = {slot: merged(slot, parts) for slot, parts in held.items()}
        held.clear()
        largest = max((keys for keys, _ in found.values()), key=len)
        ends = [*largest[200_000::200_000].tolist(), None]
        for start, end in zip([None, *ends], ends, strict=False):
            spans = {}
            for slot, (keys, n) in found.items():
                span = slice(0 if start is None else np.searchsorted(keys, start), len(keys) if end is None else np.searchsorted(keys, end))
                spans[slot] = keys[span], n[span] if slot else None
            every = np.unique(np.concatenate([keys for keys, _ in spans.values()]))
            counts = np.zeros((4, len(every)), np.int64)
            for slot, (keys, n) in spans.items():
                if slot:
                    counts[slot - 1, np.searchsorted(every, keys)] = n
            yield pa.RecordBatch.from_arrays([pa.array(every), *map(pa.array, counts)], ["key", "c1", "c2", "c3", "c4"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held: dict[int, list[tuple[np.ndarray, np.ndarray | None]]] = {}
        for batch in small_batches(batches, "text", STEP_BYTES):
            by_slot: dict[int, list[bytes]] = {}
            for text, slot in zip(utf8(batch, "text"), batch.column("slot").to_pylist(), strict=True):
                by_slot.setdefault(slot, []).append(text)
            for slot, texts in by_slot.items():
                for part in _parts(b" ".join(texts)):
                    keys, n = np.unique(expressions(part)[0], return_counts=True)
                    if len(keys):
                        held.setdefault(slot, []).append((keys, n if slot else None))
            if sum(len(keys) for parts in held.values() for keys, _ in parts) > HELD:
                held = {slot: [merged(slot, parts)] for slot, parts in held.items()}
                if sum(len(parts[0][0]) for parts in held.values()) > HELD // 2:
                    yield from passed_on(held)
        if held:
            yield from passed_on(held)
        give_back()

    found = rows.select("text", "slot").mapInArrow(run, "key long, c1 long, c2 long, c3 long, c4 long")
    return found.groupBy("key").agg(*(F.sum(c).alias(c) for c in ("c1", "c2", "c3", "c4")))


def _shared(grams: DataFrame) -> DataFrame:
    """``g4, backoff``: the shared Kneser-Ney probability, orders 4 and 2 over a uniform byte.

    A window here holds the bytes after one context, 256 at most.
    """

    def level(counts: DataFrame, gram: str, below: Column) -> Column:
        context = Window.partitionBy(F.shiftright(gram, 8))
        total, kinds = F.sum("n").over(context), F.count(F.lit(1)).over(context)
        return (F.col("n") - DISCOUNT) / total + DISCOUNT * kinds / total * below

    four = grams.groupBy(F.col("key").bitwiseAND(0xFFFFFFFF).alias("g4")).agg(F.count(F.lit(1)).alias("n"))
    two = four.groupBy(F.col("g4").bitwiseAND(0xFFFF).alias("g2")).agg(F.count(F.lit(1)).alias("n"))
    two = two.select("g2", level(two, "g2", F.lit(1 / 256)).alias("below"))
    four = four.withColumn("g2", F.col("g4").bitwiseAND(0xFFFF)).join(two, "g2")
    return four.select("g4", level(four, "g4", F.col("below")).alias("backoff"))


def _tables(grams: DataFrame) -> Tables:
    """Log ratios of the models of fold A, fold B and both, for every expression and context that was counted."""
    models = {"a": ("c1", "c2"), "b": ("c3", "c4"), "ab": ("c1 + c3", "c2 + c4")}
    seen = grams.where("c1 + c2 + c3 + c4 > 0")
    context = Window.partitionBy(F.shiftright("key", 8))
    rows = seen.withColumn("g4", F.col("key").bitwiseAND(0xFFFFFFFF)).join(_shared(grams), "g4")
    ratios, masses = [], []
    for m, pair in models.items():
        probability, mass = [], []
        for c in pair:
            count = F.expr(c)
            total = F.sum(count).over(context)
            lost = F.sum(F.least(count, F.lit(CLASS_DISCOUNT))).over(context)
            mass.append(F.when(total > 0, lost / total).otherwise(1.0))
            own = F.when(count > CLASS_DISCOUNT, (count - CLASS_DISCOUNT) / total).otherwise(0.0)
            probability.append(own + mass[-1] * F.col("backoff"))
        ratios.append(F.log(probability[0] / probability[1]).alias(f"r_{m}"))
        masses.append(F.log(mass[0] / mass[1]).alias(f"m_{m}"))
    rows = stage(rows.select("key", *ratios, *masses))
    by_context = rows.groupBy(F.shiftright("key", 8).alias("key")).agg(*(F.first(f"m_{m}").alias(f"r_{m}") for m in models))
    names = [f"r_{m}" for m in models]
    return Tables(*_slotted(rows, EXPRESSION_BITS, names), *_slotted(by_context, CONTEXT_BITS, names))


def _slotted(rows: DataFrame, least_bits: int, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values by slot, and the table of keys. The driver gets every row, 20 bytes each."""
    found = rows.select("key", *(F.col(n).cast("float").alias(n) for n in names)).toArrow()
    table, slots = _place(found.column("key").to_numpy(), least_bits)
    values = np.zeros((len(names), len(table)), np.float32)
    for i, name in enumerate(names):
        values[i, slots] = found.column(name).to_numpy()
    return values, table


def _curve(ratios: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Scale, slope and base of a logistic curve over asinh(ratio / scale), by Newton steps with a little ridge.

    The scale is the usual size of an ordinary text's ratio; the slope is never negative.
    """
    scale = float(np.median(np.abs(ratios[labels == 0]))) or 1.0
    x = np.stack([np.arcsinh(ratios / scale), np.ones_like(ratios)], axis=1)
    beta, weights = np.zeros(2), weights / weights.mean()
    ridge = np.array([0.01, 1e-6]) * len(labels) ** 0.5
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (labels - p)) - ridge * beta
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(bend, gradient)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return scale, max(0.0, float(beta[0])), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Tables:
    """The model, learnt from labelled rows whose ``crc_third`` is not 1, with backoff counts from all of ``docs``.

    Rows with null ids or labels teach nothing; of several labels of an id the largest counts. With labels of one
    class only, or none, every text gets that class's smoothed share, (n + 1/2) / (all + 1).
    """
    known, shares = _labelled(labels, crc_third(labels[id_col]) != 1, id_col, label_col)
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "_id", "left")
    fold = F.when(crc_third(F.col("_id")) == 0, 0).otherwise(2)
    rows = rows.withColumn("slot", F.when(F.col("_label").isNull(), 0).otherwise(fold + 2 - F.col("_label")))
    grams = stage(_counts(rows))
    tables = _tables(grams)
    spread = docs.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", STEP_BYTES):
            slots = batch.column("slot").to_pylist()
            # Slots 1 and 2 are fold A, which model B (1) scores; the others are scored by model A (0).
            ratios = [
                spread.value.ratio(text, 1 if slot < 3 else 0)
                for text, slot in zip(utf8(batch, "text"), slots, strict=True)
            ]
            toxic = pa.array([slot % 2 for slot in slots], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ratios, pa.float64()), toxic], ["ratio", "toxic"])

    # At most twice LABELS_PER_CLASS rows of two numbers, unless the documents repeat ids.
    scored = rows.where("slot > 0").select("text", "slot").mapInArrow(run, "ratio double, toxic int")
    scored = scored.groupBy("ratio", "toxic").count().toArrow()
    spread.unpersist()  # the folds are scored; ``classify`` sends what it needs
    ratios, toxic = (scored.column(c).to_numpy() for c in ("ratio", "toxic"))
    times = scored.column("count").to_numpy()
    share = np.where(toxic == 1, shares.get(1, 1.0), shares.get(0, 1.0))
    if len(set(toxic.tolist())) < 2:
        n, most = float((toxic * times).sum()), float(times.sum())
        tables.curve = (1.0, 0.0, math.log((n + 0.5) / (most - n + 0.5)))
    else:
        order = np.lexsort((toxic, ratios))
        tables.curve = _curve(ratios[order], toxic[order], (times / share)[order])
    return tables


def classify(docs: DataFrame, tables: Tables, text_col: str, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and ``_score``, the probability that the whole text is toxic; null counts as empty."""
    final = Tables(tables.seen[2:], tables.seen_keys, tables.context[2:], tables.context_keys, tables.curve)
    spread = docs.sparkSession.sparkContext.broadcast(final)
    # Numbered while in Python, so that columns can have any name; the text is sent once.
    names = [f"c{i}" for i in range(len(columns))]
    kept = docs.select(*(docs[quoted(c)].alias(n) for c, n in zip(columns, names, strict=True)), docs[text_col].cast("string").alias("text"))
    out = "".join(f"{n} {kept.schema[n].dataType.simpleString()}, " for n in names)
    text = "text"
    if text_col in columns and dict(docs.dtypes)[text_col] == "string":
        text = names[columns.index(text_col)]
        kept = kept.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text, STEP_BYTES):
            model = spread.value
            scores = [model.score(model.ratio(t, 0)) for t in utf8(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores, pa.float64())], [*names, "score"])

    return kept.mapInArrow(run, f"{out}score double").toDF(*columns, "_score")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score`` for every row; repeated rows get equal scores, an empty table an empty one.

    Null and empty texts get the score of a text that tells nothing. A null id counts as the empty text for ``held_out``.
    """
    tables = fit(docs, labels, id_col, text_col, label_col)
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    scored = classify(slim, tables, "text", ["doc_id"])
    return scored.select("doc_id", (crc_third(F.col("doc_id")) == 1).alias("held_out"), F.col("_score").alias("score"))
