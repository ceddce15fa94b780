"""Pieces that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.sources.shared import BATCH_BYTES, BATCH_ROWS, bound_batches, checkpoint_dir, cut, drop_folder, thrifty

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "ListTable", "PieceCache", "bound_batches", "checkpoint_dir", "cut", "drop_folder", "gather", "held_out", "one_row_each", "split_words", "thrifty"]


class PieceCache(dict):
    """A bounded memo of ``encode`` over repeated short strings.

    Two generations approximate least-recently-used: when the young one fills, it becomes
    the old one, and what is met again moves back. Strings over ``longest`` are never kept.
    """

    def __init__(self, encode: Callable[[str], object], limit: int = 150_000, longest: int = 64):
        super().__init__()
        self._encode, self._half, self._longest, self._old = encode, max(1, limit // 2), longest, {}

    def __missing__(self, piece):
        value = self._old.get(piece)
        if value is None:
            value = self._encode(piece)
        if len(piece) <= self._longest:
            self._room()
            self[piece] = value
        return value

    def _room(self) -> None:
        if len(self) >= self._half:
            self._old = dict(self)
            self.clear()


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the one whose other columns hash least, so that it does not depend on their order."""
    rest = [c for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__least"))
    return least.select(*keys, *[F.col("__least")[c].alias(c) for c in rest])


def split_words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, pa.StringArray]:
    """Words between ASCII white space: where each text's begin and end among all, each word's number, and the distinct words.

    A null text has no words. The empty word stands before leading and after trailing white space.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten().dictionary_encode()
    bounds = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return bounds - bounds[0], words.indices.to_numpy(zero_copy_only=False), words.dictionary


def gather(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists ``numbers`` of the lists in ``flat`` that end at ``ends``, one after the other, and where each begins (and the last ends)."""
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    own = (ends - starts)[numbers]
    to = np.cumsum(own)
    at = np.arange(to[-1] if len(to) else 0)
    at += np.repeat(starts[numbers] - to + own, own)
    return flat[at], np.concatenate([[0], to])


class ListTable:
    """A bounded memo from strings to lists of numbers that is looked up a whole array at a time.

    When it holds more than ``limit`` strings, the half used least recently goes.
    """

    def __init__(self, encode: Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]], dtype: str, limit: int = 150_000, longest: int = 64):
        """``encode`` gives the numbers of distinct strings and where each string's end."""
        self._encode, self._limit, self._longest = encode, limit, longest
        self._keys, self._flat, self._ends = pa.array([], pa.string()), np.empty(0, dtype), np.empty(0, np.int64)
        self._used, self._clock = np.empty(0, np.int64), 0

    def lists(self, strings: pa.StringArray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``strings[n]`` for each of ``numbers``, and where each begins (and the last ends)."""
        self._clock += 1
        places = pc.fill_null(pc.index_in(strings, self._keys), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = np.flatnonzero(places < 0)
        flat, ends = self._flat, self._ends
        self._used[places[places >= 0]] = self._clock
        if len(lacking):
            new = strings.take(pa.array(lacking))
            more, until = self._encode(new)
            places[lacking] = len(ends) + np.arange(len(lacking))
            flat = np.concatenate([flat, more.astype(flat.dtype)])
            ends = np.concatenate([ends, until + (ends[-1] if len(ends) else 0)])
        out = gather(flat, ends, places[numbers])
        if len(lacking):
            short = np.concatenate([np.ones(len(self._keys), bool), (pc.utf8_length(new).to_numpy(zero_copy_only=False) <= self._longest)])
            self._keys = pa.concat_arrays([self._keys, new])
            self._used = np.concatenate([self._used, np.full(len(new), self._clock)])
            keep = np.flatnonzero(short)
            if len(keep) > self._limit:
                keep = np.sort(keep[np.argsort(-self._used[keep], kind="stable")[: self._limit // 2]])
            if len(keep) < len(self._keys):
                self._keys, self._used = self._keys.take(pa.array(keep)), self._used[keep]
                flat, bounds = gather(flat, ends, keep)
                ends = bounds[1:]
            self._flat, self._ends = flat, ends
        return out


def held_out(id_col: str, folds: int = 5):
    """True for rows whose crc32 of the id, as text, is divisible by ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(folds) == 0, F.lit(True))
