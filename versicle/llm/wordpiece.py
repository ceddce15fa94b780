"""Token counts by linear greedy longest-match over a vocabulary trie with failure links.

A word is matched left to right, always by the longest piece: at its start by an initial piece,
then by continuation pieces. Each trie node stores a failure link, the node where matching goes
on when no child fits, and the number of pieces that are popped on the way; so a word is read
once, and the pieces themselves are never built. A word that cannot be covered is one unknown
token.

Words are runs of letters and digits; any other character that isn't white space is a word of
its own. Defined cases: null and empty texts have no words and no tokens; there is no limit on
the length of a word or a text; every row gets a row, equal ids too; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import PieceCache, bound_batches

_WORD = re.compile(r"[^\W_]+|\S")
_NONE = -1


class Automaton:
    """The trie of ``initial`` and ``continuation`` pieces, as byte strings."""

    def __init__(self, initial: set[bytes], continuation: set[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]
        piece_end = [False, False]
        for root, pieces in ((0, initial), (1, continuation)):
            for piece in pieces:
                at = root
                for byte in piece:
                    if byte not in self.children[at]:
                        self.children[at][byte] = len(self.children)
                        self.children.append({})
                        piece_end.append(False)
                    at = self.children[at][byte]
                piece_end[at] = piece_end[at] or bool(piece)
        self.fail, self.popped = [_NONE] * len(self.children), [0] * len(self.children)
        level = [0, 1]
        while level:
            below = []
            for parent in level:
                for byte, node in self.children[parent].items():
                    below.append(node)
                    if piece_end[node]:  # the whole path is a piece
                        self.fail[node], self.popped[node] = 1, 1
                        continue
                    at, pops = self.fail[parent], self.popped[parent]
                    while at != _NONE and byte not in self.children[at]:
                        at, pops = self.fail[at], pops + self.popped[at]
                    if at != _NONE:
                        self.fail[node], self.popped[node] = self.children[at][byte], pops
            level = below

    def count(self, word: bytes) -> int:
        """Pieces of a non-empty word; 0 if it can't be covered."""
        children, fail, popped = self.children, self.fail, self.popped
        at, pieces = 0, 0
        for byte in word:
            while byte not in children[at]:
                if fail[at] == _NONE:
                    return 0
                pieces += popped[at]
                at = fail[at]
            at = children[at][byte]
        while at != 1:  # what has been read but not popped
            if fail[at] == _NONE:
                return 0
            pieces += popped[at]
            at = fail[at]
        return pieces


def pieces_of_ranks(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces from a rank file of byte-level tokens: those after a space start words; single bytes may, too."""
    with open(path, "rb") as lines:
        tokens = [base64.b64decode(line.split()[0]) for line in lines if line.strip()]
    continuation = {t for t in tokens if not t.startswith(b" ")}
    return {t[1:] for t in tokens if t.startswith(b" ") and len(t) > 1} | {t for t in continuation if len(t) == 1}, continuation


@lru_cache(maxsize=2)
def _automaton(path: str) -> Automaton:
    return Automaton(*pieces_of_ranks(path))


def token_counts(df: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown`` (long) of each row's whole text."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def made(batches):
        count = _automaton(ranks_path).count

        def of(piece: str) -> tuple[int, int, int]:
            found = [count(word.encode()) for word in _WORD.findall(piece)]
            unknown = found.count(0)
            return len(found), sum(found) + unknown, unknown

        cache = PieceCache(of)
        for batch in batches:
            totals = []
            for text in batch["text"].to_pylist():
                found = [cache[piece] for piece in text.split()] if text else []
                totals.append(np.array(found, np.int64).sum(axis=0) if found else np.zeros(3, np.int64))
            columns = np.array(totals, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(columns[:, k]) for k in range(3))], ["id", "n_words", "n_tokens", "n_unknown"])

    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long, n_unknown long"
    return rows.mapInArrow(made, schema).withColumnRenamed("id", id_col)
