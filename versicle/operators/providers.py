"""Models behind plain interfaces, with deterministic stand-ins that need no network.

A provider is built once for each Python worker, by a factory that Spark ships; texts reach it in
Arrow batches. Model columns are marked non-deterministic so that the optimizer neither repeats nor moves them.
"""

from __future__ import annotations

import hashlib
import html
import json
import math
import re
import time
import urllib.error
import urllib.request
import weakref
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 64
TASKS = {"document": "passage: ", "query": "query: ", "similarity": "sentence: "}
RERANK_TIMEOUT, RERANK_RETRIES, RERANK_DELAY = 10.0, 1, 1.0
#: Seconds between questions of an evaluation, for services that allow ten calls a minute.
EVAL_PAUSE = 6.0


class RerankUnavailable(RuntimeError):
    """The reranker gave no usable order."""


class ModelMismatch(RuntimeError):
    """An installed model isn't the pinned one."""


@lru_cache(maxsize=100_000)
def _hashed(word: str) -> tuple[int, float]:
    """A word's number, whose remainder is its coordinate, and its sign."""
    digest = hashlib.sha256(word.encode()).digest()
    return int.from_bytes(digest[:4], "big"), 1.0 if digest[4] % 2 else -1.0


class HashingEmbedder:
    """Vectors from hashed words: equal texts have equal vectors, texts that share words are near each other."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], task: str) -> list[list[float]]:
        if task not in TASKS:
            raise ValueError(f"unknown task: {task}")
        out = []
        for text in texts:
            vector = [0.0] * self.dim
            for word in re.findall("[a-z0-9]+", text.lower()):
                number, sign = _hashed(word)
                vector[number % self.dim] += sign
            norm = math.sqrt(sum(x * x for x in vector))
            out.append([x / norm for x in vector] if norm else vector)
        return out


class OverlapReranker:
    """Orders documents by the share of a question's words that they hold; ties keep their order."""

    def rank(self, question: str, documents: list[str], top_n: int) -> list[int]:
        asked = set(re.findall("[a-z0-9]+", question.lower()))
        score = [len(asked & set(re.findall("[a-z0-9]+", d.lower()))) for d in documents]
        return sorted(range(len(documents)), key=lambda k: (-score[k], k))[:top_n]


class HttpReranker:
    """A rerank service: one retry on network errors, 429 and 5xx; anything else is unavailable at once."""

    def __init__(self, url: str, key: str, model: str, post: Callable | None = None, sleep: Callable = time.sleep):
        self.url, self.key, self.model, self._post, self._sleep = url, key, model, post or self._send, sleep

    def _send(self, body: bytes) -> bytes:
        request = urllib.request.Request(self.url, body, {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=RERANK_TIMEOUT) as answer:
            return answer.read()

    def rank(self, question: str, documents: list[str], top_n: int) -> list[int]:
        if not documents:
            return []
        body = json.dumps({"model": self.model, "query": question, "documents": documents, "top_n": top_n}).encode()
        for left in range(RERANK_RETRIES, -1, -1):
            try:
                results = json.loads(self._post(body))["results"]
                return [r["index"] for r in sorted(results, key=lambda r: -r["relevance_score"])]
            except urllib.error.HTTPError as error:
                if not left or not (error.code == 429 or error.code >= 500):
                    raise RerankUnavailable(f"status {error.code}") from error
            except OSError as error:
                if not left:
                    raise RerankUnavailable(str(error)) from error
            except (ValueError, KeyError, TypeError) as error:
                raise RerankUnavailable("unreadable answer") from error
            self._sleep(RERANK_DELAY)
        raise RerankUnavailable("no answer")


class ExtractiveGenerator:
    """Answers with the first sentence of the first passages, as JSON of the answer schema."""

    def generate(self, prompt: str, system: str | None = None, schema: dict | None = None) -> str:
        claims = [{"text": html.unescape(body).strip().split(". ")[0], "chunk_id": html.unescape(name)} for name, body in re.findall(r'<source id="([^"]*)"[^>]*>\n(.*?)\n</source>', prompt, re.S)[:3]]
        return json.dumps({"status": "answered" if claims else "not_in_sources", "claims": claims})


def check_pin(installed: dict[str, str], model: str, pin: str) -> None:
    """An error unless the model's digest begins with its pin."""
    digest = installed.get(model, "").removeprefix("sha256:")
    if not pin or not digest.startswith(pin):
        raise ModelMismatch(f"{model}: digest {digest[:12] or 'none'} isn't the pinned {pin or 'none'}")


def embed(text: Column, factory: Callable = HashingEmbedder, task: str = "document", dim: int | None = None) -> Column:
    """A vector for each text; null texts have none. A vector of another length than ``dim`` is an error."""
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            out: list = [None] * len(batch)
            at = [k for k, t in enumerate(batch) if t is not None]
            for first in range(0, len(at), BATCH):
                some = at[first : first + BATCH]
                for k, vector in zip(some, model.embed([batch.iloc[k] for k in some], task), strict=True):
                    if dim is not None and len(vector) != dim:
                        raise ValueError(f"a vector of {len(vector)} numbers, not {dim}")
                    out[k] = vector
            yield pd.Series(out, dtype=object)

    return vectors.asNondeterministic()(text)


def valid_order(order: Column, n: Column) -> Column:
    """Indices within ``n``, each once, as first given."""
    return F.array_distinct(F.filter(order, lambda k: (k >= 0) & (k < n)))


def rerank(question: Column, documents: Column, factory: Callable | None, keep: int = 3) -> Column:
    """``order array<int>, reranked boolean``: at most ``keep`` places of ``documents``, best first.

    Without a reranker, where it is unavailable, or gives no valid place, the first ``keep`` stand.
    """
    first = F.when(F.size(documents) > 0, F.sequence(F.lit(0), F.least(F.size(documents), F.lit(keep)) - 1)).otherwise(F.array().cast("array<int>"))
    if factory is None:
        return F.struct(first.alias("order"), F.lit(False).alias("reranked"))

    @F.pandas_udf("array<int>")
    def orders(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for questions, several in batches:
            out = []
            for asked, texts in zip(questions, several, strict=True):
                try:
                    out.append(model.rank(asked or "", list(texts if texts is not None else []), keep))
                except RerankUnavailable:
                    out.append(None)
            yield pd.Series(out, dtype=object)

    order = F.slice(valid_order(orders.asNondeterministic()(question, documents), F.size(documents)), 1, keep)
    real = F.coalesce(F.size(order) > 0, F.lit(False))
    return F.struct(F.when(real, order).otherwise(first).alias("order"), real.alias("reranked"))


def generate(prompts: DataFrame, prompt_col: str = "prompt", factory: Callable = ExtractiveGenerator, schema_col: str | None = None, system_col: str | None = None, systems: dict[str, str] | None = None) -> DataFrame:
    """``prompts`` with the model's ``raw`` answers; a null prompt asks nothing and has none.

    ``schema_col`` has the JSON schema of each answer, as text; ``system_col`` names one of ``systems``, the instructions.
    """

    @F.pandas_udf("string")
    def said(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for prompts, schemas, names in batches:
            rows = zip(prompts, schemas, names, strict=True)
            yield pd.Series([None if p is None else model.generate(p, system=(systems or {}).get(n), schema=json.loads(s) if s else None) for p, s, n in rows], dtype=object)

    optional = lambda c: F.col(c) if c else F.lit(None).cast("string")
    return prompts.withColumn("raw", said.asNondeterministic()(F.col(prompt_col), optional(schema_col), optional(system_col)))


def pace(reranker: Callable | None, seconds: float = EVAL_PAUSE, sleep: Callable = time.sleep) -> None:
    """Between the batches of an evaluation: waits only where a reranker is called, whose service counts its calls."""
    if reranker is not None and seconds > 0:
        sleep(seconds)


class Examples:
    """Route examples embedded once for each embedder that is alive: an embedder's own, and never a dead one's."""

    def __init__(self, lookup: list[str], compare: list[str]):
        self._texts = [("lookup", t) for t in lookup] + [("compare", t) for t in compare]
        self._known: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    def vectors(self, embedder) -> list[tuple[str, list[float]]]:
        """``kind, vector`` of each example."""
        if embedder not in self._known:
            vectors = embedder.embed([t for _, t in self._texts], "similarity")
            self._known[embedder] = [(kind, v) for (kind, _), v in zip(self._texts, vectors, strict=True)]
        return self._known[embedder]
