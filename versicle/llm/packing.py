"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are cut into pieces of at most ``capacity`` tokens; a piece of exactly ``capacity``
is a sequence of its own. The rest are dealt at random into shards of bounded size. In each
shard, islands evolve populations of packings, which begin as best fits of random orders:
crossover injects whole well-filled bins of one parent into the other, drops the bins that
would then hold duplicates and the emptiest ones, and best-fits the displaced pieces, longest
first; after each epoch an island's elite migrates to its neighbour through a shuffle. A shard
whose elite comes from a crossover and meets the lower bound ``ceil(tokens / capacity)`` is
optimal and stops. The bins a shard could not fill go into the next round with the poorly
filled bins of other shards, until one shard is left, so nearly all sequences are full at any
corpus size.

Defined cases: a null or empty text is a document of its end id alone; repeated rows are
packed each; no document is dropped or cut except into ``capacity``-token pieces; an empty
table gives no rows. Other columns stay as they are; of the names that results use, a table's
own columns give way.
"""

from __future__ import annotations

import os
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.llm.common import ListTable, bound_batches, cut, split_words, thrifty

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2, 2, 10, 4
#: Shares of a parent's better half that are injected, and of the other's emptiest bins that are dissolved.
INJECTED, DISSOLVED = 2 / 3, 0.1
#: Bins emptier than this go into the next round.
FULL_ENOUGH = 0.995


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Latin letters whose lower case is one letter, between ASCII marks that neither begin a contraction nor a special
#: token: the tokenizer takes the letters, and the marks on each side, as one match each.
_PLAIN = r"^(?P<lead>[!-&(-/:;=-@\[-`{-~]*)(?P<core>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<trail>[!-&(-/:;=-@\[-`{-~]*)$"


class Words:
    """Ids of texts by their words: the tokenizer drops white space, so words are encoded apart, each
    distinct one of a batch once. Letters are looked up in lower case without the marks around them;
    what the table lacks is encoded in one call."""

    def __init__(self, path: str, limit: int = 150_000):
        self._tokenizer = _tokenizer(path)
        self._whole, self._parts = ListTable(self._split, "<u4", limit), ListTable(self._encoded, "<u4", limit)

    def _encoded(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, told apart by where in the joined text they stand."""
        encoding = self._tokenizer.encode("\n".join(words.to_pylist()), add_special_tokens=False)
        ids = np.array(encoding.ids, np.int64).astype("<u4")
        begins = np.fromiter((o[0] for o in encoding.offsets), np.int64, len(ids))
        return ids, np.searchsorted(begins, np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 1))

    def _split(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        found = pc.extract_regex(words, _PLAIN)
        plain = found.is_valid()
        lead, core, trail = (pc.fill_null(pc.struct_field(found, k), "") for k in range(3))
        # A word that isn't plain is its own middle part.
        middle = pc.if_else(plain, pc.utf8_lower(core), words)
        parts = pa.concat_arrays([lead, middle, trail]).dictionary_encode()
        order = parts.indices.to_numpy(zero_copy_only=False).reshape(3, len(words)).T.ravel()
        ids, starts = self._parts.lists(parts.dictionary, order)
        return ids, starts[3::3]

    def __call__(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (and the last's end)."""
        bounds, numbers, words = split_words(texts)
        ids, starts = self._whole.lists(words, numbers)
        return ids, starts[bounds]


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def pieces(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """``id_col, piece int, start long, length long, ids binary`` of each document's pieces, in its order."""
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def made(batches):
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            of, piece, start, parts = [], [], [], []
            ids_of_all, bounds = _words(tokenizer_path)(batch["text"])
            for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                ids = ids_of_all[a:b].tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    of.append(row)
                    piece.append(k)
                    start.append(at // 4)
                    parts.append(ids[at : at + 4 * capacity])
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(of, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array([len(p) // 4 for p in parts], pa.int64()),
                    pa.array(parts, pa.binary()),
                ],
                ["id", "piece", "start", "length", "ids"],
            )

    schema = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids binary"
    return rows.mapInArrow(thrifty(made), schema).withColumnRenamed("id", id_col)


# ---- the packing of one shard ---------------------------------------------------------------


class Fills:
    """Bins by free space; the tightest that takes a length is found on the bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.mask, self.by_free, self.next = capacity, 0, {}, 0

    def add(self, bin_id: int, free: int) -> None:
        if free > 0:
            self.by_free.setdefault(free, []).append(bin_id)
            self.mask |= 1 << free
        self.next = max(self.next, bin_id + 1)

    def place(self, length: int) -> int:
        """The bin that best fits ``length``, which takes it; a new bin if none does."""
        fit = self.mask >> length
        if not fit:
            chosen, free = self.next, self.capacity
        else:
            free = length + (fit & -fit).bit_length() - 1
            those = self.by_free[free]
            chosen = those.pop()
            if not those:
                self.mask ^= 1 << free
        self.add(chosen, free - length)
        return chosen


def best_fit(lengths: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece when pieces are placed in ``order``."""
    fills, bins = Fills(capacity), np.empty(len(lengths), np.int32)
    for item in order.tolist():
        bins[item] = fills.place(int(lengths[item]))
    return bins


def cost(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Bins used, less the mean squared fill: fewer bins first, then a few full bins over many half-full ones."""
    fill = np.bincount(bins, lengths) / capacity
    return float(len(fill) - np.mean(fill**2)) if len(fill) else 0.0


def crossover(lengths: np.ndarray, mother: np.ndarray, father: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of ``father`` injected into ``mother``; displaced pieces go where they fit best.

    Bins of the mother that hold an injected piece, and her emptiest others, are dissolved.
    """
    fill, own = np.bincount(father, lengths), np.bincount(mother, lengths)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.choice(good, size=max(1, int(INJECTED * len(good))), replace=False)] = True
    injected = chosen[father]
    broken = np.zeros(len(own), bool)
    broken[mother[injected]] = True
    whole = np.flatnonzero(~broken)
    broken[whole[np.argsort(own[whole], kind="stable")[: max(1, int(DISSOLVED * len(own)))]]] = True
    settled = ~broken[mother] | injected
    used, where = np.unique(np.where(injected, father + len(own), mother)[settled], return_inverse=True)
    child = np.empty(len(lengths), np.int32)
    child[settled] = where
    fills = Fills(capacity)
    for bin_id, full in enumerate(np.bincount(where, lengths[settled], minlength=len(used)).astype(int).tolist()):
        fills.add(bin_id, capacity - full)
    displaced = np.flatnonzero(~settled)
    for item in displaced[np.argsort(-lengths[displaced], kind="stable")].tolist():
        child[item] = fills.place(int(lengths[item]))
    return child


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    return -(-int(lengths.sum()) // capacity)


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, seed: int, generations: int = GENERATIONS, size: int = POPULATION) -> tuple[list[np.ndarray], int]:
    """The population, best first, and how many generations made it: fewer where a child meets the lower bound.

    An empty population begins as best fits of random orders.
    """
    rng = np.random.default_rng(seed)
    bound = lower_bound(lengths, capacity)
    best = lambda p: cost(lengths, p, capacity)
    population = population or [best_fit(lengths, rng.permutation(len(lengths)), capacity) for _ in range(size)]
    population = sorted(population, key=best)
    for made in range(1, generations + 1):
        a, b = rng.choice(len(population), 2, replace=False) if len(population) > 1 else (0, 0)
        child = crossover(lengths, population[min(a, b)], population[max(a, b)], capacity, rng)
        if child.max() + 1 <= bound:
            return [child, *population][:size], made
        population = sorted([*population, child], key=best)[:size]
    return population, generations


# ---- distribution ----------------------------------------------------------------------------

_STATE = "shard long, island int, done boolean, first_bins int, n_bins int, generations int, cost double, lengths array<int>, population array<array<int>>"


def _evolved(capacity: int, epoch: int):
    def step(frames):
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                population = [np.asarray(p, np.int32) for p in (row.population if row.population is not None else [])]
                made, seed = 0, (row.shard * 31 + row.island) * 31 + epoch
                first = row.first_bins
                if not row.done:
                    if not population:
                        population, _ = evolve(lengths, [], capacity, seed, generations=0)
                        first = int(population[0].max()) + 1
                    population, made = evolve(lengths, population, capacity, seed)
                bins = int(population[0].max()) + 1
                done = bins <= lower_bound(lengths, capacity)
                rows.append((row.shard, row.island, done, first, bins, row.generations + made, cost(lengths, population[0], capacity), row.lengths, population))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _STATE.split(", ")])

    return step


def migrated(state: DataFrame, islands: int = ISLANDS) -> DataFrame:
    """Each island's population with its neighbour's elite; a shard that one island has solved is done, by that elite."""
    guests = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.slice("population", 1, 1).alias("guests"), F.col("done").alias("solved"))
    both = F.when(F.col("solved"), F.concat("guests", "population")).otherwise(F.concat("population", "guests"))
    return state.join(guests, ["shard", "island"]).select("shard", "island", (F.col("done") | F.col("solved")).alias("done"), "first_bins", "n_bins", "generations", "cost", "lengths", both.alias("population"))


def _packed_round(rest: DataFrame, n_shards: int, round_no: int, capacity: int, report: list | None) -> DataFrame:
    """``shard, items, bins`` of the pieces in ``rest``, packed within shards."""
    salt = F.xxhash64("id", "piece", "row", F.lit(round_no))
    shards = cut(
        rest.withColumn("shard", F.pmod(salt, F.lit(n_shards)).cast("long"))
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("length", "row", "id", "piece")), asc=False).alias("items"))
    )
    lengths = F.transform("items", lambda x: x["length"].cast("int"))
    zero = F.lit(0)
    state = shards.select("shard", F.explode(F.sequence(zero, F.lit(ISLANDS - 1))).alias("island"), F.lit(False).alias("done"), zero.alias("first_bins"), zero.alias("n_bins"), zero.alias("generations"), F.lit(0.0).alias("cost"), lengths.alias("lengths"), F.lit(None).cast("array<array<int>>").alias("population"))
    for epoch in range(EPOCHS):
        if epoch:
            state = migrated(state)
        state = cut(state.repartition("shard", "island").mapInPandas(_evolved(capacity, epoch), _STATE))
    if report is not None:
        best = state.groupBy("shard").agg(F.min("first_bins").alias("f"), F.min("n_bins").alias("n"), F.sum("generations").alias("g"))
        report.append(best.agg(F.count("*").alias("shards"), F.sum("f").alias("first_bins"), F.sum("n").alias("n_bins"), F.sum("g").alias("generations")).first())
    best = state.groupBy("shard").agg(F.min_by(F.element_at("population", 1), F.struct("cost", "island")).alias("bins"))
    return shards.join(best, "shard").select("shard", "items", "bins")


def _laid_out(frames):
    """A row for each piece with its bin, its offset there, and how full the bin is."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            bins = np.asarray(row.bins, np.int64)
            lengths = np.fromiter((x["length"] for x in row.items), np.int64, len(bins))
            order = np.argsort(bins, kind="stable")
            ends = np.cumsum(lengths[order])
            fill = np.bincount(bins, lengths).astype(np.int64)
            before = np.concatenate([[0], np.cumsum(fill)])[bins[order]]
            items = [row.items[k] for k in order]
            yield pd.DataFrame(
                {
                    "id": pd.Series([x["id"] for x in items], dtype=object),
                    "piece": [x["piece"] for x in items],
                    "row": [x["row"] for x in items],
                    "length": lengths[order],
                    "shard": row.shard,
                    "bin": bins[order],
                    "offset": ends - lengths[order] - before,
                    "fill": fill[bins[order]],
                }
            )


def pack(lengths: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, report: list | None = None) -> DataFrame:
    """``lengths`` (``id_col, piece, length`` and others) with ``sequence_id long, offset long``.

    ``length`` is from 1 to ``capacity``. What ``lengths`` computes runs once; it is then read back.
    To ``report`` a row is added for each round: its shards, their bins at first and at last, and the generations run.
    """
    bound_batches(lengths.sparkSession)
    lengths = lengths.drop("sequence_id", "offset")
    names = [f"k{i}" for i in range(len(lengths.columns))]  # no other name of the table can clash
    of = lambda c: names[lengths.columns.index(c)]
    made = cut(lengths.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    id_type = made.schema[of(id_col)].dataType.simpleString()
    length = F.col(of("length"))
    whole = made.where(length >= capacity).select(*names, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = made.where(length < capacity).select(F.col(of(id_col)).alias("id"), F.col(of("piece")).alias("piece"), "row", length.alias("length"))
    n_rest, base, placed = rest.count(), 0, []
    schema = f"id {id_type}, piece int, row long, length long, shard long, bin long, offset long, fill long"
    shards_before, round_no = None, 0
    while n_rest:
        n_shards = max(1, round(n_rest / shard_pieces))
        packed = cut(_packed_round(rest, n_shards, round_no, capacity, report).mapInPandas(_laid_out, schema))
        last = n_shards == 1 or (shards_before is not None and n_shards >= shards_before)
        done = packed if last else packed.where(F.col("fill") >= FULL_ENOUGH * capacity)
        # A shard has at most as many bins as pieces; ids of a round start where those of the one before end.
        width = 4 * shard_pieces
        placed.append(done.select("row", (F.lit(base) + F.col("shard") * width + F.col("bin")).alias("sequence_id"), "offset"))
        if last:
            break
        base += n_shards * width
        rest = packed.where(F.col("fill") < FULL_ENOUGH * capacity).select("id", "piece", "row", "length")
        n_rest, shards_before, round_no = rest.count(), n_shards, round_no + 1
    if placed:
        found = reduce(DataFrame.unionByName, placed)
        whole = whole.unionByName(made.where(length < capacity).join(found, "row").select(*names, "sequence_id", "offset"))
    return whole.toDF(*lengths.columns, "sequence_id", "offset")
