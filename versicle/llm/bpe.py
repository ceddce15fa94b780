"""Byte-level BPE encoding and decoding with overlapping chunks.

A text of up to ``chunk_chars`` is encoded where it is read. A longer one is cut into chunks
that overlap; tasks anywhere in the cluster pre-tokenise and encode the chunks, and one task
per text stitches them: from a position that is a pre-token boundary in both neighbours on,
both would split the text alike, because the pattern never looks back. Where an overlap holds
no common boundary (a run of letters longer than the overlap), the chunks of the stretch are
gathered and encoded again as one, so results never depend on the chunking.

Defined cases: a null or empty text has no ids; decoding null gives empty bytes; a repeated
row or id gives a result for each row; an empty table gives no rows; all other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import PieceCache, bound_batches

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: The end of a chunk may split a contraction or a run of spaces; boundaries this close to it do not count.
EDGE = 3


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    """The merge ranks of a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


@lru_cache(maxsize=4)
def _vocabulary(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in _ranks(path).items()}


class Encoder:
    """Encodes the matches of ``pattern`` one by one, keeping the ids of frequent ones."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        self._pattern = regex.compile(pattern)
        whole = tiktoken.Encoding("versicle", pat_str=r"(?s:.+)", mergeable_ranks=_ranks(ranks_path), special_tokens={})
        self._cache = PieceCache(lambda piece: np.array(whole.encode_ordinary(piece), "<i4").tobytes())

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        cache = self._cache
        return b"".join([cache[piece] for piece in self._pattern.findall(text)])

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Where each pre-token starts, how many ids it has, and all ids."""
        starts, parts = [], []
        for match in self._pattern.finditer(text):
            starts.append(match.start())
            parts.append(self._cache[match.group()])
        return np.array(starts, np.int64), np.array([len(p) // 4 for p in parts], np.int64), b"".join(parts)


@lru_cache(maxsize=4)
def _encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def cut_text(text: str, chunk: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping chunks of ``text`` with the positions where they start."""
    return [(max(0, at - overlap), text[max(0, at - overlap) : at + chunk + overlap]) for at in range(0, len(text), chunk)]


def stitch(chunks: list[tuple[int, str, np.ndarray, np.ndarray, bytes]], encoder: Encoder) -> bytes:
    """The ids of a text from its chunks ``(offset, text, starts, counts, ids)`` in order."""
    if not chunks:
        return b""
    out, begin = [], 0
    offset, text, starts, counts, ids = chunks[0]

    def emit(upto: int | None) -> None:
        lo = np.searchsorted(starts, begin - offset)
        hi = len(starts) if upto is None else np.searchsorted(starts, upto - offset)
        out.append(ids[4 * int(counts[:lo].sum()) : 4 * int(counts[:hi].sum())])

    at = 1
    while at < len(chunks):
        right = chunks[at]
        last = offset + len(text) - EDGE
        common = np.intersect1d(starts + offset, right[2] + right[0], assume_unique=True)
        common = common[(common >= begin) & (common <= last)]
        if len(common):
            cut = int(common[len(common) // 2])
            emit(cut)
            begin, (offset, text, starts, counts, ids) = cut, right
            at += 1
            continue
        # The stretch is at least doubled before it is encoded again, so a run of any length costs its length.
        parts, end = [text[begin - offset :]], offset + len(text)
        goal = 2 * len(parts[0])
        while at < len(chunks) and sum(map(len, parts)) <= goal:
            parts.append(chunks[at][1][end - chunks[at][0] :])
            end = chunks[at][0] + len(chunks[at][1])
            at += 1
        offset, text = begin, "".join(parts)
        starts, counts, ids = encoder.spans(text)
    emit(None)
    return b"".join(out)


def _ids_array(parts: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(
    df: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """``id_col, ids array<int>`` for each row of ``df``."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    is_long = F.length("text") > chunk_chars

    def whole(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            parts = [encoder.ids(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], _ids_array(parts)], ["id", "ids"])

    def chunked(batches):
        for batch in batches:
            for key, text, ident in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), batch["id"], strict=True):
                chunks = cut_text(text, chunk_chars, overlap_chars)
                for first in range(0, len(chunks), 64):
                    some = chunks[first : first + 64]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([key] * len(some), pa.int64()),
                            pa.array([ident.as_py()] * len(some), batch["id"].type),
                            pa.array([o for o, _ in some], pa.int64()),
                            pa.array([t for _, t in some], pa.string()),
                        ],
                        ["key", "id", "offset", "text"],
                    )

    def spans(batches):
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            found = [encoder.spans(text) for text in batch["text"].to_pylist()]
            columns = [pa.array([x[k] if k == 2 else x[k].astype("<i4").tobytes() for x in found], pa.binary()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["id"], batch["offset"], batch["text"], *columns],
                ["key", "id", "offset", "text", "starts", "counts", "ids"],
            )

    def joined(table: pa.Table) -> pa.Table:
        encoder = _encoder(ranks_path, pattern)
        table = table.sort_by("offset")
        numbers = lambda column: [np.frombuffer(x, "<i4").astype(np.int64) for x in table[column].to_pylist()]
        chunks = zip(table["offset"].to_pylist(), table["text"].to_pylist(), numbers("starts"), numbers("counts"), table["ids"].to_pylist(), strict=True)
        return pa.table([table["id"].combine_chunks()[:1], _ids_array([stitch(list(chunks), encoder)])], ["id", "ids"])

    short = rows.where(~is_long).mapInArrow(whole, f"id {id_type}, ids array<int>")
    chunks = (
        rows.where(is_long)
        .withColumn("key", F.monotonically_increasing_id())
        .mapInArrow(chunked, f"key long, id {id_type}, offset long, text string")
        .repartition("key", "offset")
        .mapInArrow(spans, f"key long, id {id_type}, offset long, text string, starts binary, counts binary, ids binary")
    )
    long = chunks.groupBy("key").applyInArrow(joined, f"id {id_type}, ids array<int>")
    return short.unionByName(long).withColumnRenamed("id", id_col)


def decode(df: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, ids_col, bytes binary``: the bytes of the ids, one token after the other; an unknown id is an error."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))

    def raw(batches):
        token = _vocabulary(ranks_path).__getitem__
        for batch in batches:
            texts = [b"".join(map(token, _values(ids))) for ids in batch["ids"]]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["ids"], pa.array(texts, pa.binary())], ["id", "ids", "bytes"])

    made = rows.mapInArrow(raw, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, bytes binary")
    return made.withColumnsRenamed({"id": id_col, "ids": ids_col})


def _values(scalar: pa.ListScalar) -> list[int]:
    return scalar.values.to_numpy(zero_copy_only=False).tolist()


def digests(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """Token counts and SHA-256 digests of the ids and of the decoded bytes of ``encode``'s result."""
    joined = F.expr("replace(substring(cast(ids AS string), 2, length(cast(ids AS string)) - 2), ', ', ' ')")
    return decode(encoded, ranks_path, id_col).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2(F.col("bytes"), 256).alias("decoded_sha256"),
    )
