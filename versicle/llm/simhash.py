"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` differing bits are linked. The 64 bits are grouped into
partitions of correlated bits; partition i is probed with threshold t_i, and a pair within
``distance`` agrees to t_i bits on some partition whenever the thresholds sum to
``distance - partitions + 1`` (-1: not probed). Dynamic programming picks the thresholds, and
with them the number of partitions, by the candidate counts that a bounded sample of distinct
fingerprints predicts. The sample steers cost only: any allocation finds every link.

Copies share a fingerprint and are one node. Keys with few fingerprints are verified pair by
pair. A key with many is never expanded into pairs: two fingerprints are within two bits if
and only if some 64-bit value is within one bit of both, so each fingerprint under such a key
names the values within ``distance / 2`` bits of it, and those that meet at a value, at most a
few dozen, are linked to one of them. Both ways are exact.

Defined cases: null and empty texts have fingerprint zero and are linked like any other;
fewer words than a shingle make one shingle; a text without words has fingerprint zero;
rows with equal ids each get a row, and of these one stays for each group they stand for;
null ids never name a component unless all are null; distances are even, an odd one is an
error; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import bound_batches, cut, thrifty
from versicle.llm.components import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 3
DISTANCE = 2
#: Distinct fingerprints that steer the partitioning, and the most that are compared pair by pair under one key.
SAMPLE = 4000
PAIRWISE = 32
#: Fingerprints with more than this part of all rows are joined by broadcast.
CROWDS = 1000


def fingerprint_of(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of a whole text over its word shingles, repeats included."""
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not tokens:
        return 0
    buffer = b" ".join(tokens)
    ends, at = [], -1
    for token in tokens:
        at += len(token) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest, total, counts = xxhash.xxh64_digest, 0, np.zeros(BITS, np.int64)
    spans = list(zip(starts, ends[words - 1 :], strict=False)) or [(0, len(buffer))]
    for first in range(0, len(spans), 50_000):  # bounded memory for very long texts
        hashes = b"".join([digest(buffer[a:b], seed) for a, b in spans[first : first + 50_000]])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
        total += len(bits)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``id_col, fp long`` (the bits as a signed number)."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def made(batches):
        for batch in batches:
            found = np.array([fingerprint_of(t, words, seed) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(found.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(thrifty(made), f"id {rows.schema['id'].dataType.simpleString()}, fp long").withColumnRenamed("id", id_col)


# ---- the plan: partitions and thresholds -----------------------------------------------------


def group_bits(sample: np.ndarray, partitions: int) -> list[list[int]]:
    """Bits in groups of nearly equal size, correlated ones together, grown greedily from the strongest pair left."""
    bits = (sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
    centred = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    norm = np.sqrt((centred**2).sum(axis=0))
    tie = (centred.T @ centred) / np.maximum(np.outer(norm, norm), 1e-9)
    strength = np.abs(np.nan_to_num(tie))
    np.fill_diagonal(strength, 0)
    left, groups = set(range(BITS)), []
    for k in range(partitions):
        size = (BITS - sum(map(len, groups))) // (partitions - k)
        rest = sorted(left)
        group = [max(rest, key=lambda b: (strength[b, rest].max(), -b))]
        while len(group) < size:
            group.append(max((b for b in rest if b not in group), key=lambda b: (strength[b, group].sum(), -b)))
        groups.append(sorted(group))
        left -= set(group)
    return groups


def _near_pairs(sample: np.ndarray, group: list[int], most: int) -> list[float]:
    """Pairs of the sample within 0, 1, ... ``most`` bits on ``group``, but no true links: those don't grow with its square."""
    mask = np.uint64(sum(1 << b for b in group))
    pairs = np.zeros(most + 1)
    for first in range(0, len(sample), 500):
        differ = sample[first : first + 500, None] ^ sample[None, :]
        apart = np.bitwise_count(differ) > most
        near = np.bitwise_count(differ & mask)
        pairs += [((near <= t) & apart).sum() for t in range(most + 1)]
    return list(pairs / 2)


def _signatures(bits: int, threshold: int) -> int:
    """Rows that a fingerprint sends for one partition."""
    ways, n = 0, 1
    for t in range(threshold + 1):
        ways += n
        n = n * (bits - t) // (t + 1)
    return ways


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up that sum to ``total`` at the least cost; ``costs[i][t + 1]`` is partition i's at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for partition in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for index, more in enumerate(partition):
                at = spent + index - 1
                if at not in step or cost + more < step[at][0]:
                    step[at] = (cost + more, [*chosen, index - 1])
        best = step
    return best.get(total, (float("inf"), []))


@lru_cache(maxsize=8)
def _plan(sample: tuple[int, ...], n: int, distance: int) -> tuple[tuple[tuple[int, ...], int], ...]:
    values = np.array(sample, np.int64).view(np.uint64)
    scale = (n / max(1, len(values))) ** 2
    plans = []
    for partitions in range(1, distance + 3):
        groups = group_bits(values, partitions)
        costs = []
        for group in groups:
            pairs = _near_pairs(values, group, distance)
            random = n * n / 2 / 2.0 ** len(group)  # what a sample is too small to see
            costs.append([0.0] + [n * _signatures(len(group), t) + max(scale * pairs[t], random * _signatures(len(group), t)) for t in range(distance + 1)])
        cost, thresholds = allocate(costs, distance - partitions + 1)
        plans.append((cost, [(tuple(g), t) for g, t in zip(groups, thresholds, strict=True) if t >= 0]))
    return tuple(min(plans, key=lambda p: p[0])[1])


def plan(distinct: DataFrame, n: int, distance: int = DISTANCE, sample: int = SAMPLE) -> list[tuple[tuple[int, ...], int]]:
    """``(bits, threshold)`` of the partitions to probe for ``n`` distinct fingerprints in column ``fp``."""
    some = distinct.orderBy(F.xxhash64("fp")).limit(sample).collect()
    return list(_plan(tuple(r.fp for r in some), n, distance))


# ---- links ------------------------------------------------------------------------------------


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _flips(bits: tuple[int, ...] | range, most: int) -> list[int]:
    """Signed masks that flip at most ``most`` of ``bits``."""
    return [_signed(sum(1 << b for b in some)) for k in range(most + 1) for some in combinations(bits, k)]


def _masks(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def links(distinct: DataFrame, distance: int = DISTANCE, pairwise: int = PAIRWISE) -> DataFrame:
    """``u, v``: edges whose components are those of all pairs within ``distance`` bits.

    Each edge joins two fingerprints within ``distance`` (an even number); each pair within it
    is an edge or joined through such edges. ``distinct`` has distinct values ``fp``.
    """
    if distance % 2:
        raise ValueError(f"the distance must be even, not {distance}: crowded keys meet halfway")
    parts = plan(distinct, distinct.count(), distance)
    sent = None
    for number, (bits, threshold) in enumerate(parts):
        mask = F.lit(_signed(sum(1 << b for b in bits)))
        own = F.col("fp").bitwiseAND(mask)
        rows = distinct.select("fp", F.explode(_masks(_flips(bits, threshold))).alias("flip")) if threshold else distinct.select("fp", F.lit(0).cast("long").alias("flip"))
        rows = rows.select("fp", F.lit(number).alias("part"), own.bitwiseXOR(F.col("flip")).alias("key"), (F.col("flip") == 0).alias("own"))
        sent = rows if sent is None else sent.unionByName(rows)
    held = sent.groupBy("part", "key").agg(F.count_if("own").alias("n"), F.count("*").alias("all")).where("n > 0 AND all > 1").select("part", "key", "n")
    met = cut(sent.join(held, ["part", "key"]))
    few = met.where(F.col("n") <= pairwise)
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    # Of two that both hold the key only one order is needed.
    once = (~F.col("b.own")) | (F.col("a.fp") < F.col("b.fp"))
    direct = few.where("own").alias("a").join(few.alias("b"), (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") != F.col("b.fp")) & once & near).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    crowd = met.where(F.col("n") > pairwise).select("fp").distinct()
    meeting = crowd.select("fp", F.explode(_masks(_flips(range(BITS), distance // 2))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle"))
    # Distinct fingerprints within one bit of a value: 65 at most.
    hubs = meeting.groupBy("middle").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    through = hubs.select(F.array_min("fps").alias("u"), F.explode("fps").alias("v")).where("u <> v")
    return direct.unionByName(through).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, words: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """``id_col, fp, component_id``: the smallest id reachable over links, for every row."""
    prints = cut(fingerprints(df, id_col, text_col, words, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")))
    found = components(links(nodes.select("fp"), distance))
    named = found.join(nodes, found.node == nodes.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    far = found.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    labels = cut(nodes.join(far, "fp", "left").select("fp", "copies", F.coalesce("component_id", "least").alias("component_id")))
    # At most CROWDS fingerprints have so many copies: they are broadcast, and no other fills a task.
    crowded = labels.where(F.col("copies") * CROWDS > prints.count())
    rows = prints.join(F.broadcast(crowded.select("fp", F.col("component_id").alias("known"), F.lit(True).alias("met"))), "fp", "left")
    rest = rows.where("met IS NULL").select(id_col, "fp").join(labels.select("fp", "component_id"), "fp")
    return rows.where("met").select(id_col, "fp", F.col("known").alias("component_id")).unionByName(rest.select(id_col, "fp", "component_id"))


def hex_digits(column):
    """16 lower-case hex digits of a signed 64-bit column."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
