"""Embedding near-duplicates by Euclidean p-stable hashing with exact cosine checks.

Unit vectors are projected on random Gaussian directions; each projection is shifted and cut
into steps of ``WIDTH``, and several together name a bucket in each of several tables. The
collision probabilities of the family give the numbers of projections and tables: unrelated
vectors (at right angles) should meet ``STRAY`` others in a table, and a pair just at the
threshold should meet in some table with probability ``RECALL``. Only buckets that hold
two vectors or more are joined with the vectors, and every pair in one is checked by its cosine
in double precision.

Equal vectors are one class with a multiplicity. A bucket over ``BLOCK`` classes is dealt out
as pairs of blocks, so that no task holds more than two blocks. No pair leaves a task: it
returns how many vectors each class links to, and a spanning forest of the links. A pair
counts in the first table where it meets.

Defined cases: vectors that are null, empty, zero, or have null or non-finite components link
with nothing and are their own component; vectors of different lengths don't link; each row
gets a result, rows with equal ids too; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from versicle.llm.common import bound_batches, cut
from versicle.llm.components import components

THRESHOLD = 0.95
WIDTH = 2.0
RECALL = 0.99
STRAY = 1 / 32
BLOCK = 512
SEED = 20_011


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one projection puts two points at ``distance`` in the same step."""
    if distance <= 0:
        return 1.0
    r = width / distance
    normal = 0.5 * (1 + math.erf(-r / math.sqrt(2)))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def sizes(n: int, threshold: float = THRESHOLD, recall: float = RECALL, width: float = WIDTH) -> tuple[int, int]:
    """Projections in a table, and tables, for ``n`` classes."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold)), width), collision(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(2.0, n / STRAY)) / -math.log(far)))
    meet = near**k
    return k, 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log1p(-meet))


class Hasher:
    """The buckets of vectors; the same on every executor for the same arguments."""

    def __init__(self, k: int, tables: int, width: float = WIDTH, seed: int = SEED):
        self._k, self._tables, self._width, self._seed, self._by_dim = k, tables, width, seed, {}

    def __call__(self, unit: np.ndarray) -> np.ndarray:
        """``len(unit) x tables`` signed 64-bit bucket names."""
        dim = unit.shape[1]
        if dim not in self._by_dim:
            rng = np.random.default_rng([self._seed, dim])
            self._by_dim[dim] = (
                rng.standard_normal((dim, self._tables * self._k)),
                rng.uniform(0, self._width, self._tables * self._k),
                rng.integers(1, 1 << 63, self._k, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            )
        directions, shifts, mix = self._by_dim[dim]
        steps = np.floor((unit @ directions + shifts) / self._width).astype(np.int64).view(np.uint64)
        with np.errstate(over="ignore"):
            mixed = (steps.reshape(len(unit), self._tables, self._k) * mix).sum(axis=2, dtype=np.uint64)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(dim)
        return mixed.view(np.int64)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    # Scaled first: squares of very large or small components would leave the range of doubles.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _prepared(kind: str):
    """Each row with the digest of its vector, or null if the vector can't link."""

    def made(batches):
        for batch in batches:
            keys, raws = [], []
            for value in batch["vec"]:
                raw = None
                if value.is_valid and len(value.values) and not value.values.null_count:
                    x = value.values.to_numpy(zero_copy_only=False).astype(kind) + 0.0  # -0.0 is 0.0
                    raw = x.tobytes() if np.isfinite(x).all() and x.any() else None
                raws.append(raw)
                keys.append(None if raw is None else hashlib.blake2b(raw, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.binary()), pa.array(raws, pa.binary())], ["id", "key", "raw"])

    return made


def _bucketed(hasher: Hasher, kind: str, tables: int):
    def made(batches):
        for batch in batches:
            raws = batch["raw"].to_pylist()
            for length in sorted({len(r) for r in raws}):
                rows = np.array([i for i, r in enumerate(raws) if len(r) == length])
                names = hasher(_unit([raws[i] for i in rows], kind))
                of = np.repeat(rows, tables)
                yield pa.RecordBatch.from_arrays(
                    [batch["node"].take(pa.array(of)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(names.ravel())],
                    ["node", "tab", "bucket"],
                )

    return made


def spanning_forest(u: np.ndarray, v: np.ndarray) -> list[tuple]:
    """Edges of ``u - v`` that a union-find needs."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return kept


def _pairs(group: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within runs of equal ``group`` that block sides allow (-1: any; else one of each side)."""
    left, right, step = [], [], 1
    start = np.arange(len(group))
    while len(start):
        start = start[start + step < len(group)]
        start = start[group[start] == group[start + step]]
        ok = start[(side[start] < 0) | (side[start] != side[start + step])]
        left.append(ok)
        right.append(ok + step)
        step += 1
    return np.concatenate([np.empty(0, np.int64), *left]), np.concatenate([np.empty(0, np.int64), *right])


def _checked(hasher: Hasher, kind: str, threshold: float):
    """Counts and forests of the links in buckets. Rows come sorted by bucket; one that goes on in the next batch waits."""

    def links(table: pa.Table):
        names = table["group"].to_numpy()
        ids, mult = table["node"].to_numpy(), table["n"].to_numpy()
        tabs, sides = table["tab"].to_numpy(), table["side"].to_numpy()
        raws = table["raw"].to_pylist()
        dims = np.array([len(r) for r in raws])
        links_u, links_v = [], []
        for length in np.unique(dims):
            at = np.flatnonzero(dims == length)
            unit = _unit([raws[i] for i in at], kind)
            a, b = _pairs(names[at], sides[at])
            for first in range(0, len(a), 100_000):
                p, q = a[first : first + 100_000], b[first : first + 100_000]
                close = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[close], q[close]
                if len(p):
                    some, where = np.unique(np.concatenate([p, q]), return_inverse=True)
                    own = hasher(unit[some])
                    same = own[where[: len(p)]] == own[where[len(p) :]]
                    now = same.argmax(axis=1) == tabs[at[p]]
                    links_u.append(at[p[now]])
                    links_v.append(at[q[now]])
        if not links_u:
            return None
        u, v = np.concatenate(links_u), np.concatenate(links_v)
        who, where = np.unique(np.concatenate([ids[u], ids[v]]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([mult[v], mult[u]])).astype(np.int64)
        forest = spanning_forest(ids[u], ids[v])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([who, np.array([e[0] for e in forest], ids.dtype)])),
                pa.array(np.concatenate([np.full(len(who), -1, ids.dtype), np.array([e[1] for e in forest], ids.dtype)])),
                pa.array(np.concatenate([counts, np.zeros(len(forest), np.int64)])),
            ],
            ["u", "v", "links"],
        )

    def made(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            names = batch["group"].to_numpy()
            if sum(b.num_rows for b in waiting) < 4 * BLOCK or names[0] == names[-1]:
                continue
            table = pa.Table.from_batches(waiting)
            whole = table.num_rows - int((names[::-1] != names[-1]).argmax())
            if (found := links(table.slice(0, whole))) is not None:
                yield found
            waiting = table.slice(whole).to_batches()
        if waiting and (found := links(pa.Table.from_batches(waiting))) is not None:
            yield found

    return made


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``id_col, n_links long, component_id long, kept boolean`` for every row; ids are integers."""
    spark = df.sparkSession
    bound_batches(spark)
    element = df.schema[vec_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(T.ArrayType(T.FloatType() if kind == "<f4" else T.DoubleType())).alias("vec"))
    rows = cut(source.mapInArrow(_prepared(kind), "id long, key binary, raw binary"))
    classes = cut(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("raw").alias("raw")).withColumn("node", F.monotonically_increasing_id()))
    k, tables = sizes(classes.count(), threshold, recall)
    hasher = Hasher(k, tables)
    light = cut(classes.select("node", "raw").mapInArrow(_bucketed(hasher, kind, tables), "node long, tab int, bucket long"))
    counts = light.groupBy("tab", "bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Block i meets every block j; a pair of one block with itself has no sides.
    met = light.join(counts, ["tab", "bucket"]).withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = met.select(
        "node",
        "tab",
        F.xxhash64("tab", "bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("group"),
        F.when(F.col("mine") == F.col("other"), -1).otherwise((F.col("mine") < F.col("other")).cast("int")).alias("side"),
    )
    full = groups.join(classes.select("node", "n", "raw"), "node")
    full = full.repartition("group").sortWithinPartitions("group", "node")
    found = cut(full.select("node", "n", "tab", "group", "side", "raw").mapInArrow(_checked(hasher, kind, threshold), "u long, v long, links long"))
    degree = found.where("links > 0").groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "node")
    named = classes.select("node", "key", "rep", "n")
    comps = components(found.where("links = 0").select("u", "v"))
    least = comps.join(named, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(degree, "node", "left").join(comps.join(least, "component").select("node", "component_id"), "node", "left")
    named = named.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    result = rows.select("id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
