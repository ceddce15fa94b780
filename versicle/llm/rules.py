"""Quality rules: base counts of every text, and its divergence from language references.

A document's histograms of character classes and of common words are compared with those of
its language by the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1).
The references are the mean histograms over all documents of a language that pass the base
rules and are long enough, computed in one aggregation with a row for each language that has
a word list, and one for the rest. Short texts are guarded: histograms of few characters or words
say nothing, so texts below the minimum lengths are not judged by them.

Defined cases: a null or empty text has no words and fails the base rules; a language without
a word list, or null, is judged by character classes alone, against all such documents; where
no document can serve as a reference, nothing is judged; every row gets a row, equal ids too;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import PieceCache, bound_batches, cut

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Characters and words from which a histogram is judged.
MIN_CHARS, MIN_COMMON = 150, 20
#: The distance that rejects, and what is added, over the root of the length, for the noise of short texts.
MAX_CHAR_DISTANCE, CHAR_SLACK = 0.22, 1.2
MAX_WORD_DISTANCE, WORD_SLACK = 0.2, 1.2

# Common words of four languages.
COMMON = {
    "en": "the of and to in is it that was for are as with be by on at this or an".split(),
    "de": "der die das und ist nicht von mit zu den für auf ein eine in sich dem des als im".split(),
    "fr": "le la les de des et en un une que qui pour dans du sur pas au ou il est".split(),
    "es": "el la los las de que y en un una por con para se del no es al lo su".split(),
}
#: Classes of UTF-8 bytes; a continuation byte belongs to the character before it.
CLASSES = ["small", "capital", "digit", "space", "line", "stop", "mark", "symbol", "two", "three", "four"]
_SPACES = "\t\n\x0b\x0c\r "


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 0x80:
        return -1 if byte < 0xC0 else 8 if byte < 0xE0 else 9 if byte < 0xF0 else 10
    if c.isalpha():
        return 0 if c.islower() else 1
    if c.isdigit():
        return 2
    return 3 if c in "\t\x0b\x0c " else 4 if c in "\r\n" else 5 if c in ".,;:?" else 6 if c in "\"'()[]-" else 7


_CLASS = np.array([_class_of(b) for b in range(256)])
_EDGES = re.compile(r"^[\"'(\[]+|[.,;:?!\"')\]]+$")


def common_index(piece: str) -> bytes:
    """For each language, which of its common words a piece is, else the number of them: one byte each."""
    word = _EDGES.sub("", piece)
    word = word[:1].lower() + word[1:]
    return bytes(words.index(word) if word in words else len(words) for words in COMMON.values())


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that are found twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    codes = ids  # exact: windows are numbered anew at each length, so that pairs of numbers fit 64 bits
    for k in range(1, window):
        codes = np.unique(codes[:-1] * (len(number) + 1) + ids[k:], return_inverse=True)[1]
    twice = np.flatnonzero(np.bincount(codes)[codes] > 1)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + window, -1)
    return int((np.cumsum(change) > 0).sum())


def base_counts(text: str, words: list) -> tuple[int, int, int, int, int]:
    lines = [line for line in text.split("\n") if line.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, the base counts, ``language`` (null: no word list), ``chars`` and ``common`` histograms, not normalised."""
    bound_batches(df.sparkSession)
    lang = F.col(lang_col) if lang_col in df.columns else F.lit(None).cast("string")
    lang = F.when(lang.isin(*COMMON), lang)
    rows = df.select(F.col(id_col).alias("id"), lang.alias("language"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = {name: k for k, name in enumerate(COMMON)}
    bins = max(map(len, COMMON.values())) + 1

    def made(batches):
        cache = PieceCache(common_index)
        for batch in batches:
            counts, chars, common = [], [], []
            for text, language in zip(batch["text"].to_pylist(), batch["language"].to_pylist(), strict=True):
                raw = text.encode()
                words = raw.split()
                counts.append(base_counts(text, words))
                by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                chars.append(np.bincount(_CLASS[_CLASS >= 0], by_byte[_CLASS >= 0], minlength=len(CLASSES)).astype(np.int32))
                if language is None:
                    common.append(np.zeros(bins, np.int32))
                else:
                    found = np.frombuffer(b"".join([cache[p] for p in text.split()]), np.uint8).reshape(-1, len(COMMON))
                    common.append(np.bincount(found[:, place[language]], minlength=bins).astype(np.int32))
            base = np.array(counts, np.int64).reshape(-1, len(_BASE))
            lists = [pa.array(list(chain(x)), pa.list_(pa.int32())) for x in (chars, common)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["language"], *(pa.array(base[:, k]) for k in range(len(_BASE))), *lists], ["id", "language", *_BASE, "chars", "common"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, language string, {', '.join(f'{c} long' for c in _BASE)}, chars array<int>, common array<int>"
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(made, schema).withColumn("base_failed", failed).withColumnRenamed("id", id_col)


def _total(column: str, size: int) -> Column:
    return sum((F.get(column, F.lit(k)) for k in range(1, size)), F.get(column, F.lit(0)))


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances between rows of counts and rows of shares; NaN where either is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = counts / counts.sum(axis=1, keepdims=True), reference
        middle = (p + q) / 2
        part = lambda x: np.where(x > 0, x * np.log2(x / middle), np.where(np.isnan(x), np.nan, 0.0)).sum(axis=1)
        return np.sqrt(np.maximum(0.0, (part(p) + part(q)) / 2))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, base counts, ``base_failed``, both distances (null: not judged) and ``kept``."""
    rows = cut(measured(df, id_col, text_col, lang_col))
    n_chars, n_common = len(CLASSES), max(map(len, COMMON.values())) + 1
    long = rows.where(~F.col("base_failed") & (F.col("n_words") >= 2 * MIN_COMMON)).withColumns({"tc": _total("chars", n_chars), "tw": _total("common", n_common)})
    shares = [F.avg(F.get("chars", F.lit(k)) / F.nullif("tc", F.lit(0))).alias(f"c{k}") for k in range(n_chars)]
    shares += [F.avg(F.get("common", F.lit(k)) / F.nullif("tw", F.lit(0))).alias(f"w{k}") for k in range(n_common)]
    # A row for each language that has a word list, and one for the rest.
    means = long.groupBy("language").agg(*shares)
    # At most one row for each word list and one more: bounded.
    references = {r.language: ([r[f"c{k}"] for k in range(n_chars)], [r[f"w{k}"] for k in range(n_common)]) for r in means.collect()}
    nothing = [np.nan] * n_chars, [np.nan] * n_common

    def judged(batches):
        for batch in batches:
            known = [references.get(x, nothing) for x in batch["language"].to_pylist()]
            base = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("n_words", "word_chars", "base_failed")}
            distances = []
            for k, (name, size, least, of, most, slack) in enumerate((("chars", n_chars, MIN_CHARS, "word_chars", MAX_CHAR_DISTANCE, CHAR_SLACK), ("common", n_common, MIN_COMMON, "n_words", MAX_WORD_DISTANCE, WORD_SLACK))):
                counts = batch[name].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                reference = np.array([x[k] for x in known], float).reshape(-1, size)
                found = np.where(base[of] >= least, distance(counts, reference), np.nan)
                distances.append((found, found > most + slack / np.sqrt(np.maximum(1, base[of]))))
            kept = ~(base["base_failed"].astype(bool) | distances[0][1] | distances[1][1])
            columns = [pa.array(d, mask=np.isnan(d)) for d, _ in distances]
            yield pa.RecordBatch.from_arrays([batch["id"], *(batch[c] for c in _BASE), batch["base_failed"], *columns, pa.array(kept)], ["id", *_BASE, "base_failed", "char_distance", "word_distance", "kept"])

    named = rows.withColumnRenamed(id_col, "id")
    schema = f"id {named.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, char_distance double, word_distance double, kept boolean"
    return named.mapInArrow(judged, schema).withColumnRenamed("id", id_col)
