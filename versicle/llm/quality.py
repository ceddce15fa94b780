"""Quality by co-training of a text-content view and a page-metadata view.

Two logistic classifiers see disjoint features: the shapes, words and repetitions of the text;
and language, source and length. Both start from labelled rows. The unlabelled documents are
dealt to ``ROUNDS`` rounds by a hash of their id; in its round each is scored by both views, and
of each class each view hands the ``HANDED`` documents it is surest of to the other, so that every
unlabelled document is offered once, at any corpus size. Each view is calibrated on a fold of
labelled rows that it has not learnt from, and their calibrated log-odds, less the prior counted
twice, score every document on its whole text.

What is fitted is bounded: at most ``TRAIN_ROWS`` labelled rows outside the held-out fold, those
with the smallest hash of their id, and ``4 * HANDED`` handed ones a round, up to ``TRAIN_BYTES`` of
features in hash order. One task fits them; the models have at most ``2 ** BITS`` coordinates each.

Defined cases: null and empty texts have only the features of an empty text; where no labelled
row of each class may be learnt from, all score 0.5 and are kept; conflicting labels of an id
count as good; of rows with one id, one is learnt from (the one whose columns hash least) and
each gets a score; rows without an id are scored but not offered; of equally sure documents those
with the smaller hash go first; missing metadata columns are one value, like nulls, and infinite
numbers another; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versicle.llm.common import ListTable, PieceCache, bound_batches, cut, held_out, one_row_each, thrifty
from versicle.llm.ftrl import Ftrl, sigmoid, sparse

BITS = 18
TRAIN_ROWS = 8_000
TRAIN_BYTES = 256 << 20
ROUNDS = 3
#: Documents of each class that a view hands over in a round, and the confidence they need.
HANDED, CONFIDENT = 200, 0.9
EPOCHS, ALPHA, L1, L2 = 3, 0.5, 0.5, 0.1
META_COLUMNS = ("lang", "source", "n_chars")


def shape_of(piece: str) -> str:
    """``a``, ``A`` and ``0`` for runs of small letters, capitals and digits; any other run as its character."""
    out = []
    for c in piece:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:8])


def _pieces(pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word and of the shape of each piece; an empty piece has none."""
    numbers, ends = [], []
    for piece in pieces.to_pylist():
        if piece:
            numbers += [zlib.crc32(piece.lower().encode()), zlib.crc32(b"shape " + shape_of(piece).encode())]
        ends.append(len(numbers))
    return np.array(numbers, "<u4"), np.array(ends, np.int64)


class Content:
    """Distinct coordinates and values of the text view for a batch of texts."""

    def __init__(self, bits: int = BITS):
        self._bits, self._table = bits, ListTable(_pieces, "<u4")
        tell = lambda t: zlib.crc32(t.encode()) & ((1 << bits) - 1)
        self._repeats = np.array([tell(f"repeats {k}") for k in range(11)])
        self._distinct = np.array([tell(f"distinct {k}") for k in range(-1, 11)])
        self._empty = np.array([tell("empty False"), tell("empty True")])

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's features begin (and the last's end), their coordinates, and their values."""
        bits, n = self._bits, len(texts)
        lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        pieces = lists.flatten().dictionary_encode()
        flat, starts = self._table.lists(pieces.dictionary, pieces.indices.to_numpy(zero_copy_only=False))
        offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.diff(starts[offsets - offsets[0]] // 2)
        rows, least = np.repeat(np.arange(n), total), np.maximum(1, total)
        words, shapes = flat[0::2], flat[1::2]
        again = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
        repeats = np.bincount(rows[1:][again], minlength=n) / np.maximum(1, total - 1)
        counted = lambda hashes: np.unique((rows << bits) | (hashes & np.uint32((1 << bits) - 1)).astype(np.int64), return_counts=True)
        word_keys, n_word = counted(words)
        shape_keys, n_shape = counted(shapes)
        different = np.bincount(word_keys >> bits, minlength=n)
        tells = [self._repeats[np.ceil(10 * repeats).astype(int)], self._distinct[np.where(total > 20, (10 * different / least).astype(int) + 1, 0)], self._empty[(total == 0).astype(int)]]
        keys = np.concatenate([shape_keys, word_keys, *[(np.arange(n) << bits) | t for t in tells]])
        values = np.concatenate([2 * np.sqrt(n_shape / least[shape_keys >> bits]), np.sqrt(n_word / least[word_keys >> bits]), np.ones(3 * n)])
        keys, where = np.unique(keys, return_inverse=True)
        return np.searchsorted(keys >> bits, np.arange(n + 1)), keys & ((1 << bits) - 1), np.bincount(where, values, minlength=len(keys))


def _told(name: str, value) -> str:
    if isinstance(value, (int, float)) and value == value and abs(value) != math.inf:
        value = int(math.log2(max(1, value)))
    return f"{name}={value}"


def meta_features(row: dict, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and values of the metadata view: each column, and the pairs with the first column."""
    told = [_told(k, v) for k, v in row.items()]
    told += [f"{told[0]} {x}" for x in told[1:]]
    return np.unique(np.array([zlib.crc32(t.encode()) & ((1 << bits) - 1) for t in told], np.uint32)), 1.0


def _plain_values(batch: pa.RecordBatch, names: list[str]):
    """A tuple of the metadata of each row; what isn't a number or a string is told as text."""
    plain = lambda v: v if v is None or isinstance(v, (int, float, str)) else str(v)
    return zip(*[map(plain, batch[c].to_pylist()) for c in names], strict=True)


def _platt(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn logits into log-odds, by Newton steps with smoothed targets."""
    good, bad = labels.sum(), (1 - labels).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    x = np.stack([logits, np.ones_like(logits)])
    for _ in range(50):
        p = sigmoid(a * logits + b)
        gradient = x @ (p - target) + 1e-3 * np.array([a - 1, b])
        hessian = (x * (p * (1 - p))) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return float(max(0.0, a)), float(b)


class View:
    """One view's classifier over the rows of the sample."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], bits: int = BITS):
        self.rows, self.size = rows, 1 << bits
        self.learnt: tuple[np.ndarray, float] = (np.zeros(self.size), 0.0)

    def fit(self, which: np.ndarray, labels: np.ndarray) -> None:
        model = Ftrl(self.size, alpha=ALPHA, l1=L1, l2=L2)
        rng = np.random.default_rng(7)
        share = max(1e-9, labels[which].mean()), max(1e-9, 1 - labels[which].mean())
        for _ in range(EPOCHS):
            for row in rng.permutation(which).tolist():
                at, values = self.rows[row]
                model.learn(at, values, labels[row], weight=0.5 / (share[0] if labels[row] else share[1]))
        self.learnt = model.weights(slice(0, self.size)), model.bias()

    def logits(self, which: np.ndarray) -> np.ndarray:
        weights, bias = self.learnt
        return np.array([float((weights[self.rows[r][0]] * self.rows[r][1]).sum()) + bias for r in which.tolist()])


def learn_views(content: list, meta: list, labels: np.ndarray, givers: list[str], calibration: np.ndarray, bits: int = BITS) -> dict | None:
    """Weights and calibration of both views. A row's giver is the view that handed it to the other; a labelled row has none."""
    giver = np.array(givers, object)
    own = giver == ""
    known, held = np.flatnonzero(own & ~calibration), np.flatnonzero(own & calibration)
    if not len(known) or labels[known].min() == labels[known].max():
        return None
    if not len(held):
        held = known
    prior = (labels[known].sum() + 1) / (len(known) + 2)
    out = {"prior": float(np.log(prior / (1 - prior)))}
    for name, other, rows in (("content", "meta", content), ("meta", "content", meta)):
        view = View(rows, bits)
        view.fit(np.union1d(known, np.flatnonzero(giver == other)), labels.astype(float))
        weights, bias = view.learnt
        at, some = sparse(weights)
        out[name] = (at, some, bias, *_platt(view.logits(held), labels[held].astype(float)))
    return out


def _featured(bits: int, meta: list[str]):
    def made(batches):
        content, of_meta = Content(bits), PieceCache(lambda key: meta_features(dict(zip(meta, key, strict=True)), bits)[0].astype("<u4").tobytes())
        for batch in batches:
            bounds, at, values = content(batch["__text"])
            at, values = at.astype("<u4"), values.astype("<f4")
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch["__rank"],
                    batch["__label"],
                    batch["__giver"],
                    batch["__calibrates"],
                    pa.array([at[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([of_meta[key] for key in _plain_values(batch, meta)], pa.binary()),
                ],
                ["rank", "label", "giver", "calibrates", "at", "value", "meta"],
            )

    return made


_FEATURES = "rank long, label int, giver string, calibrates boolean, at binary, value binary, meta binary"


def _fitted(bits: int, most_bytes: int):
    def made(batches):
        labels, givers, calibrates, content, meta, held = [], [], [], [], [], 0
        for batch in batches:
            for label, giver, calibrating, at, value, told in zip(*[batch[c].to_pylist() for c in ("label", "giver", "calibrates", "at", "value", "meta")], strict=True):
                held += len(at) + len(value) + len(told)
                if held > most_bytes and labels:
                    continue
                labels.append(label)
                givers.append(giver)
                calibrates.append(calibrating)
                content.append((np.frombuffer(at, "<u4"), np.frombuffer(value, "<f4")))
                meta.append((np.frombuffer(told, "<u4"), 1.0))
        model = learn_views(content, meta, np.array(labels, np.int64), givers, np.array(calibrates, bool), bits) if labels else None
        if model is not None:
            for name in ("content", "meta"):
                at, weights, bias, slope, shift = model[name]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([json.dumps([model["prior"], bias, slope, shift])]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([weights.astype("<f4").tobytes()], pa.binary())],
                    ["view", "numbers", "at", "weights"],
                )

    return made


def _learnt(train: DataFrame, bits: int, most_bytes: int) -> dict | None:
    """The model of the bounded table of features; its weights, at most ``2 ** bits`` a view, come to the driver."""
    one = train.repartition(1).sortWithinPartitions("rank", "giver", "label")
    found = {r.view: r for r in one.mapInArrow(thrifty(_fitted(bits, most_bytes)), "view string, numbers string, at binary, weights binary").collect()}
    if not found:
        return None
    model: dict = {}
    for name, row in found.items():
        model["prior"], bias, slope, shift = json.loads(row.numbers)
        model[name] = (np.frombuffer(row.at, "<i4"), np.frombuffer(row.weights, "<f4"), bias, slope, shift)
    return model


def _told_columns(docs: DataFrame, meta_cols) -> dict[str, str]:
    """The metadata columns that the table has, by the names under which they are features."""
    return {f"m_{c}": c for c in meta_cols if c in docs.columns}


def surest(scored: DataFrame, handed: int = HANDED, confident: float = CONFIDENT) -> DataFrame:
    """``__id, __hash, __giver, __label``: of each class the ``handed`` rows each view is surest of, from ``__id, __hash, content_score, meta_score``.

    Parts of the rows are ranked apart first, so that no task sees more than its part and the best of the others.
    """
    side = lambda view, p: F.struct(F.lit(view).alias("giver"), (p >= 0.5).cast("int").alias("label"), F.greatest(p, 1 - p).alias("sure"))
    sides = [side(view, F.col(f"{view}_score")) for view in ("content", "meta")]
    rows = scored.select("__id", "__hash", F.explode(F.array(*sides)).alias("s")).select("__id", "__hash", "s.giver", "s.label", "s.sure").where(F.col("sure") >= confident)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(64)))
    order = [F.desc("sure"), F.xxhash64("__id"), F.asc("__id"), F.asc("__hash")]
    for by in (["giver", "label", "part"], ["giver", "label"]):
        rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= handed)
    return rows.select("__id", "__hash", F.col("giver").alias("__giver"), F.col("label").alias("__label"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols=META_COLUMNS, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES, handed: int = HANDED, rounds: int = ROUNDS, bits: int = BITS) -> dict | None:
    """The calibrated views, or None where nothing can be learnt."""
    bound_batches(docs.sparkSession)
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    usable = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("__label"))
    learn = usable.where(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    told = _told_columns(docs, meta_cols)
    meta = list(told) or ["__none"]
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), *([F.col(c).alias(n) for n, c in told.items()] or [F.lit(None).cast("string").alias("__none")]))
    rows = rows.withColumn("__hash", F.xxhash64("__text", *meta))

    def features(chosen: DataFrame) -> DataFrame:
        told = chosen.withColumns({"__rank": F.xxhash64("__id"), "__calibrates": F.crc32(F.col("__id").cast("string")) % 5 == 1})
        return told.select("__rank", "__label", "__giver", "__calibrates", "__text", *meta).mapInArrow(thrifty(_featured(bits, meta)), _FEATURES)

    # Both joins are with bounded tables of ids: train_rows at most, and 4 * handed.
    train = cut(features(one_row_each(rows.join(F.broadcast(learn), "__id"), ["__id"]).withColumn("__giver", F.lit(""))))
    model = _learnt(train, bits, train_bytes)
    for turn in range(rounds if model is not None else 0):
        offered = rows.where(F.col("__id").isNotNull() & (F.pmod(F.xxhash64("__id", F.lit(2)), F.lit(rounds)) == turn))
        scored = _scored(offered, model, ["__id", "__hash"], "__text", {n: n for n in told}, bits).withColumnsRenamed({"k0": "__id", "k1": "__hash"})
        sure = scored.where((F.abs(F.col("content_score") - 0.5) >= CONFIDENT - 0.5) | (F.abs(F.col("meta_score") - 0.5) >= CONFIDENT - 0.5))
        chosen = cut(surest(sure.join(usable.select("__id"), "__id", "left_anti"), handed))
        met = one_row_each(offered.join(F.broadcast(chosen), ["__id", "__hash"]), ["__id", "__hash", "__giver"])
        train = cut(train.unionByName(features(met)))
        model = _learnt(train, bits, train_bytes)
    return model


def _scored(docs: DataFrame, model: dict | None, kept: list[str], text_col: str, told: dict[str, str], bits: int) -> DataFrame:
    """Columns ``kept`` of every row as ``k0, k1, ...`` and its three scores, so that no name of the table can clash."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, meta = [f"k{i}" for i in range(len(kept))], list(told) or ["__none"]
    metas = [F.col(c).alias(n) for n, c in told.items()] or [F.lit(None).cast("string").alias("__none")]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(kept, names, strict=True)], *metas, *([] if text_col in kept else [F.col(text_col).alias("__text")]))
    text = names[kept.index(text_col)] if text_col in kept else "__text"
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    def made(batches):
        views, content = {}, Content(bits)
        if shared.value is not None:
            for name in ("content", "meta"):
                at, weights, bias, slope, shift = shared.value[name]
                dense = np.zeros(1 << bits)
                dense[at] = weights
                views[name] = dense, bias, slope, shift
        prior = shared.value["prior"] if views else 0.0
        of_meta = PieceCache(lambda key: float(views["meta"][0][meta_features(dict(zip(meta, key, strict=True)), bits)[0]].sum()))
        for batch in batches:
            odds = {name: np.zeros(batch.num_rows) for name in ("content", "meta")}
            if views:
                bounds, at, values = content(batch[text])
                dense, bias, slope, shift = views["content"]
                odds["content"] = slope * (np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(bounds)), dense[at] * values, minlength=batch.num_rows) + bias) + shift
                _, bias, slope, shift = views["meta"]
                odds["meta"] = slope * (np.array([of_meta[key] for key in _plain_values(batch, meta)]) + bias) + shift
            scores = [sigmoid(odds["content"]), sigmoid(odds["meta"]), sigmoid(odds["content"] + odds["meta"] - prior)]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], *map(pa.array, scores)], [*names, "content_score", "meta_score", "score"])

    return rows.mapInArrow(thrifty(made), f"{fields}, content_score double, meta_score double, score double")


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", meta_cols=META_COLUMNS, bits: int = BITS, keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (or ``keep``), ``content_score``, ``meta_score`` and their combined ``score``, 0 to 1, for every row."""
    kept = keep or [id_col]
    return _scored(docs, model, kept, text_col, _told_columns(docs, meta_cols), bits).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "content_score", "meta_score", "score")


def rows_where(docs: DataFrame, model: dict | None, passes: Callable[[Column], Column], text_col: str = "text", meta_cols=META_COLUMNS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose score passes."""
    found = _scored(docs, model, docs.columns, text_col, _told_columns(docs, meta_cols), bits).where(passes(F.col("score")))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
