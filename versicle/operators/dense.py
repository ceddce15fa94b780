"""Exact vector search by cosine, batched over questions, as products of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from versicle.operators.blocks import array_of, id_order, meet, near_best, parts, ranked

TOP_K = 20
#: What a task holds of the questions and of the vectors they meet, and the questions of one product.
QUESTION_PART, VECTOR_PART, QUESTION_BLOCK = 8192, 16384, 128


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a vector is null, empty or zero, or lengths differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    fit = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(F.coalesce(fit, F.lit(False)), _dot(a, b) / norms).otherwise(0.0)


def _unit(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors of ``dim`` numbers at length 1, as rows; others, those without direction, and those that hold a null or a number that isn't finite, as zeros."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    fit = np.flatnonzero(lengths == dim)
    out = np.zeros((len(lists), dim))
    if dim and len(fit):
        out[fit] = lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        out[~np.isfinite(out).all(axis=1)] = 0.0
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    return out


def _best(top_k: int, schema: pa.Schema):
    """The best of a part of the vectors for each question of a part; what rounding may tie with the last of them is kept."""

    def made(asked: pa.Table, held: pa.Table) -> pa.Table:
        asked, held = asked.combine_chunks(), held.combine_chunks()
        questions, vectors = (array_of(t["vector"]) for t in (asked, held))
        dims = questions.value_lengths().to_numpy(zero_copy_only=False)
        found, order = [], id_order(array_of(held["id"]))
        units: dict[int, np.ndarray] = {int(dim): _unit(vectors, int(dim)) for dim in np.unique(dims)} if len(held) else {}
        for first in range(0, len(asked) if len(held) else 0, QUESTION_BLOCK):
            some, of = questions.slice(first, QUESTION_BLOCK), dims[first : first + QUESTION_BLOCK]
            similarity = np.zeros((len(of), len(held)))
            for dim in np.unique(of):
                similarity[of == dim] = _unit(some, int(dim))[of == dim] @ units[int(dim)].T
            q, v = np.nonzero(near_best(similarity, top_k, order))
            found.append(pa.table({"qid": array_of(asked["qid"]).take(pa.array(q + first)), "id": array_of(held["id"]).take(pa.array(v)), "similarity": similarity[q, v]}))
        return pa.concat_tables(found).cast(schema) if found else schema.empty_table()

    return made


def dense_topk(questions: DataFrame, vectors: DataFrame, top_k: int = TOP_K, target_col: str | None = None) -> DataFrame:
    """``qid, id, similarity, rank`` from ``questions(qid, vector[, target])`` and ``vectors(id, vector[, target])``.

    The stated questions meet every vector, with targets those of their own: parts of the questions meet
    parts of the vectors, a task holds one of each, and only a part's best leave it. Similarities are rounded
    to six digits; ties go to the least id. A vector without direction, or of another length, is at 0 to any other.
    """
    key = "__key"
    numbers = "array<float>" if all(df.schema["vector"].dataType.simpleString() == "array<float>" for df in (questions, vectors)) else "array<double>"

    def side(df: DataFrame, name: str) -> DataFrame:
        # A name of its own on each side: both may come from one table.
        return df.select((F.col(target_col) if target_col else F.lit(0)).alias(key), name, F.coalesce(F.col("vector").cast(numbers), F.array().cast(numbers)).alias("vector"))

    asked, held = side(questions, "qid"), side(vectors, "id")
    schema = StructType([StructField("qid", questions.schema["qid"].dataType), StructField("id", vectors.schema["id"].dataType), StructField("similarity", DoubleType())])
    met = meet(asked, held, key, parts(asked, key, QUESTION_PART, "n_asked"), parts(held, key, VECTOR_PART, "n_held"), F.xxhash64("qid"), F.xxhash64("id"), _best(top_k, to_arrow_schema(schema)), schema)
    return ranked(met.withColumn("similarity", F.round("similarity", 6)), ["qid"], [F.desc("similarity"), F.asc("id")], top_k)
