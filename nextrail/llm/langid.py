"""Language identification: averaged hashed subword embeddings under a linear softmax (operator 6).

A text is the average of the embeddings of its subwords, byte 3- and 4-grams within words and their borders, hashed
to a fixed number of rows. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled rows. Part of the sample is held back to find the temperature that makes probabilities honest and
the probability under which a prediction is rejected.

As averaging and the linear layer commute, prediction adds up one row of class scores for each subword.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nextrail.llm.common import crc_third, small_batches, text_of, utf8
from nextrail.sources.tables import stage

#: Rows that the model is fitted on, thinned out evenly per language, and rows that each language keeps at least.
SAMPLE_ROWS, LEAST_ROWS = 4000, 10
#: Rows of the embedding table, its width, and passes over the sample.
ROWS, WIDTH, EPOCHS, RATE = 1 << 14, 16, 8, 0.5
#: Share of held-back predictions that may be wrong among those not rejected.
WRONG = 0.01
STEP_BYTES = 1 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII that isn't a letter is taken as a border.
_CLEAN = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def subwords(text: bytes) -> np.ndarray:
    """How often each hashed subword occurs in a text: byte n-grams that hold no border but at their ends."""
    counts = np.zeros(ROWS, np.int64)
    for at in range(0, len(text), STEP_BYTES):
        part = np.frombuffer(b" " + text[max(0, at - 3) : at + STEP_BYTES].lower().translate(_CLEAN) + b" ", np.uint8)
        border = part == 32
        code = part.astype(np.uint32)
        for size in (3, 4):
            n = len(part) - size + 1
            if n <= 0:
                continue
            mixed = np.zeros(n, np.uint32)
            for i in range(size):
                mixed = mixed * np.uint32(0x01000193) ^ code[i : i + n]
            mixed = (mixed ^ np.uint32(size)) * np.uint32(0x85EBCA6B)
            inside = np.zeros(n, bool)
            for i in range(1, size - 1):
                inside |= border[i : i + n]
            counts += np.bincount(mixed[~inside] >> np.uint32(18), minlength=ROWS)
    return counts


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text.decode()) is not None


@dataclass
class Model:
    """Class scores per subword, the languages in order, the temperature and the rejection limit."""

    scores: np.ndarray
    languages: list[str]
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Class scores of a text, given how often which subwords occur."""
        return counts @ self.scores[slots] / max(1, counts.sum())

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether to reject it."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        counts = subwords(text)
        slots = np.flatnonzero(counts)
        z = self.logits(slots, counts[slots]) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        score = float(p[best] / p.sum())
        return self.languages[best], score, score < self.limit


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 0) -> Model:
    """A model of the texts' subwords (slots, counts); every tenth text is held back for calibration if there are enough."""
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(np.zeros((ROWS, len(languages))), languages)
    target = np.array([languages.index(x) for x in labels])
    rows = [slots for slots, _ in texts]
    shares = [counts / max(1, counts.sum()) for _, counts in texts]
    held = np.arange(len(rows)) % 10 == 9 if len(rows) >= 100 else np.zeros(len(rows), bool)
    weight = len(target) / (len(languages) * np.bincount(target, minlength=len(languages)))
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (ROWS, WIDTH))
    output = np.zeros((WIDTH, len(languages)))
    fitted = np.flatnonzero(~held)
    scale = 0.1 * ROWS**0.5  # subwords share a step, so rows move by their small shares
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in random.permutation(fitted):
            mean = shares[i] @ embedding[rows[i]]
            z = mean @ output
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            p *= min(4.0, weight[target[i]])
            back = output @ p
            output -= rate * np.outer(mean, p)
            embedding[rows[i]] -= rate * scale * np.outer(shares[i], back)
    model = Model(embedding @ output, languages)
    check = np.flatnonzero(held) if held.any() else fitted
    z = np.array([model.logits(*texts[i]) for i in check])
    model.temperature = min(np.geomspace(0.02, 5, 60), key=lambda t: _loss(z / t, target[check]))
    p = _softmax(z / model.temperature)
    right = p.argmax(axis=1) == target[check]
    order = np.argsort(-p.max(axis=1), kind="stable")
    fine = np.flatnonzero(np.cumsum(~right[order]) <= WRONG * np.arange(1, len(order) + 1))
    model.limit = float(p.max(axis=1)[order[fine[-1]]]) if len(fine) else 1.0
    if right.mean() >= 1 - WRONG:  # nothing needs rejecting but what is less sure than all held-back texts
        model.limit = min(model.limit, 1 / len(languages) + 0.5 * (1 - 1 / len(languages)))
    return model


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _loss(z: np.ndarray, target: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(z)[np.arange(len(target)), target], 1e-12)).mean())


def fit(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the rows with a language and a text for which ``where`` holds.

    About ``SAMPLE_ROWS`` rows, by a hash of the id, as many of each language if they are there; every language found keeps about
    ``LEAST_ROWS``, so the sample and the model grow with the number of languages only. The driver gets the sample's subword
    counts, not its texts.
    """
    rows = docs.where(where & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(
        docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")
    )
    drawn = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "lang"), F.lit(1_000_000)) / 1_000_000
    counts = stage(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")))
    each = max(LEAST_ROWS, SAMPLE_ROWS // max(1, counts.count()))
    shares = counts.select("lang", F.least(F.lit(1.0), F.lit(float(each)) / F.col("rows")).alias("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", STEP_BYTES):
            counts = [subwords(t) for t in utf8(batch, "text")]
            used = [np.flatnonzero(c) for c in counts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    batch.column("order"),
                    pa.array([u.astype(np.int32).tobytes() for u in used], pa.binary()),
                    pa.array([c[u].astype(np.int32).tobytes() for c, u in zip(counts, used, strict=True)], pa.binary()),
                ],
                ["lang", "order", "slots", "counts"],
            )

    sample = rows.join(shares, "lang").where(drawn < F.col("share")).select("text", "lang", F.xxhash64("doc_id", "text").alias("order"))
    sample = sample.mapInArrow(run, "lang string, order long, slots binary, counts binary").toArrow()
    got = sorted(zip(*(sample.column(c).to_pylist() for c in ("order", "lang", "slots", "counts")), strict=True))
    texts = [(np.frombuffer(slots, np.int32), np.frombuffer(counts, np.int32)) for _, _, slots, counts in got]
    return train(texts, [lang for _, lang, _, _ in got])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for the whole text of every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if there was no language to learn.
    ``rejected`` marks predictions under the calibrated limit; their language is named all the same.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [spread.value.predict(t) for t in utf8(batch, "text")]
            languages, scores, rejected = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(languages), pa.array(scores, pa.float64()), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    rows = text_of(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``predict`` with ``held_out``, by a model learnt from the rows whose ``crc_third`` is not 1.

    Repeated rows get equal predictions; an empty table gives an empty one.
    """
    model = fit(docs, crc_third(docs[id_col]) != 1, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).withColumn("held_out", crc_third(F.col("doc_id")) == 1)
