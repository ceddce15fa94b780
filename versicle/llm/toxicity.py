"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Every document is scored on its whole text. Features are the presence of words, neighbouring
word pairs, and pairs that skip one word, hashed into ``2 ** BITS`` coordinates. The model
learns from at most ``TRAIN_ROWS`` labelled documents outside the held-out fold, the ones
with the smallest hash of their id, up to ``TRAIN_BYTES`` of features: a bounded sample, which one
task reads ``EPOCHS`` times in hash order. Weights have at most ``2 ** BITS`` coordinates, and L1
leaves few of them, so what reaches the driver and is broadcast is bounded at any corpus size.

Defined cases: null and empty texts have no features and score the bias; where no labelled
row may be learnt from, all score 0.5 less the least step (not toxic); conflicting labels of
an id count as toxic; null labels don't count; of rows with one id, the one whose text hashes
least is learnt from and each gets a score; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import PieceCache, bound_batches, held_out, one_row_each, thrifty
from versicle.llm.ftrl import Ftrl, sigmoid, sparse

BITS = 20
TRAIN_ROWS = 20_000
TRAIN_BYTES = 256 << 20
EPOCHS = 4
#: The rate and L1 of the least loss in three-fold cross-validation within the rows that may be learnt from, of rates 0.5 to 8 and L1 1 to 10.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.05
#: Odd multipliers that tell the kinds of features apart.
_PAIR, _SKIP, _NEXT = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
_WORD = re.compile(r"\w+")


def _hashed(piece: str) -> bytes:
    return np.array([zlib.crc32(w.encode()) for w in _WORD.findall(piece.lower())], "<u4").tobytes()


class Features:
    """Hashed features of a batch of texts: ``(row, coordinate)`` of every occurrence."""

    def __init__(self, bits: int = BITS):
        self._shift, self._cache = np.uint32(32 - bits), PieceCache(_hashed)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        cache = self._cache
        parts = [b"".join([cache[p] for p in text.split()]) if text else b"" for text in texts]
        words = np.frombuffer(b"".join(parts), "<u4")
        rows = np.repeat(np.arange(len(parts)), [len(p) // 4 for p in parts])
        with np.errstate(over="ignore"):
            kinds = [(rows, words * _PAIR)]
            for gap, first in ((1, _SKIP), (2, _NEXT)):
                one = rows[gap:] == rows[:-gap]
                kinds.append((rows[:-gap][one], (words[:-gap][one] * first + words[gap:][one] * _PAIR) * _PAIR))
        return np.concatenate([r for r, _ in kinds]), np.concatenate([(h ^ (h >> np.uint32(15))) * _SKIP >> self._shift for _, h in kinds])


def _packed(bits: int):
    """The distinct coordinates of each labelled row, as 32-bit numbers."""

    def made(batches):
        features = Features(bits)
        for batch in batches:
            rows, at = features(batch["text"].to_pylist())
            keys = np.unique((rows.astype(np.int64) << bits) | at)
            bounds = np.searchsorted(keys >> bits, np.arange(batch.num_rows + 1))
            at = (keys & ((1 << bits) - 1)).astype("<u4")
            parts = [at[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["rank"], batch["label"], pa.array(parts, pa.binary())], ["rank", "label", "at"])

    return made


def _fitted(bits: int, epochs: int, most_bytes: int):
    """All epochs of learning in the one task that holds the bounded sample; only weights that are not zero leave it."""

    def made(batches):
        labels, rows, held = [], [], 0
        for batch in batches:
            for label, at in zip(batch["label"].to_pylist(), batch["at"].to_pylist(), strict=True):
                held += len(at)
                if held <= most_bytes or not rows:
                    labels.append(label)
                    rows.append(np.frombuffer(at, "<u4"))
        if not rows:
            return
        model = Ftrl(1 << bits, ALPHA, BETA, L1, L2)
        for _ in range(epochs):
            for at, label in zip(rows, labels, strict=True):
                model.learn(at, 1.0, float(label))
        at, weights = sparse(model.weights(slice(0, 1 << bits)))
        yield pa.RecordBatch.from_arrays([pa.array([model.bias()]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([weights.astype("<f4").tobytes()], pa.binary())], ["bias", "at", "weights"])

    return made


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, epochs: int = EPOCHS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates, weights and bias learnt from labelled rows that are not held out."""
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    usable = usable.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(train_rows)
    # At most train_rows rows of three numbers: bounded, whatever the corpus.
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = one_row_each(texts.join(F.broadcast(usable), "id"), ["id", "rank", "label"]).select("rank", "label", "text")
    rows = rows.mapInArrow(thrifty(_packed(bits)), "rank long, label int, at binary").repartition(1).sortWithinPartitions("rank")
    found = rows.mapInArrow(thrifty(_fitted(bits, epochs, train_bytes)), "bias double, at binary, weights binary").collect()
    if not found:
        return np.empty(0, np.int32), np.empty(0, np.float32), -1e-6
    return np.frombuffer(found[0].at, "<i4"), np.frombuffer(found[0].weights, "<f4"), found[0].bias


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], kept: list[str], text_col: str, bits: int) -> DataFrame:
    """Columns ``kept`` of every row as ``k0, k1, ...`` and its ``score``, so that no name of the table can clash."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], *([] if text_col in kept else [F.col(text_col).alias("__text")]))
    text = names[kept.index(text_col)] if text_col in kept else "__text"
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def made(batches):
        at, weights, bias = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[at] = weights
        known = dense != 0
        features = Features(bits)
        for batch in batches:
            rows, coordinates = features(batch[text].to_pylist())
            met = known[coordinates]
            keys = np.unique((rows[met].astype(np.int64) << bits) | coordinates[met])
            total = np.bincount(keys >> bits, dense[keys & ((1 << bits) - 1)], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sigmoid(total + bias))], [*names, "score"])

    return rows.mapInArrow(thrifty(made), f"{fields}, score double")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """``id_col, score double`` (or ``keep`` and ``score``) of every row by its whole text."""
    kept = keep or [id_col]
    return _scored(docs, model, kept, text_col, bits).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "score")


def rows_where(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], passes: Callable[[Column], Column], text_col: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score passes."""
    found = _scored(docs, model, docs.columns, text_col, bits).where(passes(F.col("score")))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
