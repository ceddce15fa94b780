"""Near-duplicates by Jaccard similarity of word-shingle sets, every pair at or above the threshold.

SimHash comes first: documents whose fingerprints over these shingles are within ``DISTANCE`` bits meet by the
generalised pigeonhole of ``simhash``. At a similarity of 4/5, though, two fingerprints differ in about ten of 64
bits, and no partitioning of 64 bits finds such pairs at a bearable cost; so the rest is found on the sets themselves:
two sets of n and m shingles with a similarity of at least 4/5 differ in at most ``(n + m) / 9`` of them. The range of hashes is
cut into parts, about two shingles each; a shingle by which two sets differ changes one part, so of all parts at most as
many differ, and of the first ``n // 4 + 1`` of each set, under any one order of what parts hold, one at least is equal. What
holds much that is rare comes first, by the counts of a bounded sample, which steer cost only: unlike texts of few words share
single shingles by chance, ever more of them with the square of a table, but seldom whole parts. Sets of fewer than
``FEW`` shingles meet at single ones, the first ``n // 5 + 1``. Pairs that meet are dropped by two bounds that no similar pair can
break (the sets' sizes, and parity bits, three or more a shingle, which differ at most as often as the sets do), and
the rest is verified on the sets.

Each key first links its documents to the most central of them, the one that shares most of its keys, and then
to the most central outside that one's component. Only pairs that these links leave in different components are then
compared, dealt to parts of bounded size, so a crowd of copies costs about its size, not its square.

Shingles are compared by 64-bit hashes. Equal texts are one node. Texts without words are alike;
fewer words than a shingle make one shingle; null ids never name a component unless all are null; rows with one id
and different texts are different documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versicle.llm import simhash
from versicle.llm.common import PieceCache, bound_batches, cut, thrifty
from versicle.llm.components import components

WORDS = 5
#: The least similarity, 4/5, is kept in whole numbers: size, prefix and verification bounds are exact.
SHARE, OF = 4, 5
SEED = 42
#: Differing bits up to which fingerprints link documents at first.
DISTANCE = 2
#: Documents that steer the order, and the shingles of theirs that are put last.
SAMPLE = 4000
FREQUENT = 200_000
#: Sets of fewer shingles are not parted.
FEW = 32
#: The weight of a shingle that the sample holds once at most.
RARE = 1000
#: Parity bits, as 64-bit words, by which a key's documents are compared where they meet.
SKETCH = 8
#: Rows of keys, without texts, that are broadcast at most so that texts need not move to meet them (about 60 bytes a row).
SMALL = 200_000
#: Members compared with one document in one group of rows, and of a shingle's documents in one part.
BLOCK = 512


def _word_hashes():
    import xxhash

    return PieceCache(lambda word: xxhash.xxh64_intdigest(word, SEED), limit=100_000)


def shingles(text: str | None, cache: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; [0] for a text without words."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not tokens:
        return np.zeros(1, np.uint64)
    one = np.array([cache[t] for t in tokens], np.uint64)
    words = min(words, len(one))
    with np.errstate(over="ignore"):
        h = np.zeros(len(one) - words + 1, np.uint64) + np.uint64(words)
        for k in range(words):
            h = h * np.uint64(0x9E3779B97F4A7C15) + one[k : len(one) - words + 1 + k]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    return np.unique(h)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least 4/5."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def parity(held: np.ndarray, words: int | None = None) -> np.ndarray:
    """Parity bits of a set of hashes, as ``words`` 64-bit words; without these at least three bits for each hash and a power of two."""
    bits = 64 * words if words else max(64, 1 << (3 * len(held) - 1).bit_length())
    odd = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _parts(n: int) -> int:
    """Parts of the hash range for sets of ``n``, a power of two; 0: a set is too small, its shingles are taken one by one."""
    return 1 << (5 * n // 14).bit_length() if n >= FEW else 0


def _part_keys(held: np.ndarray, weight: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A key and a weight for what each of ``parts`` parts holds; the key of an empty part is its own.

    Rare shingles add up; of those known to be frequent only the rarest counts, as passages that many texts hold bring them together.
    """
    at = (held & np.uint64(parts - 1)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    there, starts = np.unique(at[order], return_index=True)
    made = np.arange(parts, dtype=np.uint64)
    with np.errstate(over="ignore"):
        made[there] = np.add.reduceat(_mixed(held)[order], starts)
        made = _mixed(made + np.uint64(parts) * np.uint64(0x9E3779B97F4A7C15))
    most = np.zeros(parts, np.int64)
    most[there] = np.maximum.reduceat(np.where(weight < RARE, weight, 0)[order], starts)
    return made, most + RARE * np.bincount(at[weight == RARE], minlength=parts)


def keys(held: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Keys of a set of shingles, one of which at least any similar set has too; ``weight`` is a shingle's rarity, in whole numbers up to ``RARE``.

    Sets of n and m that are similar differ in at most ``(n + m) / 9`` shingles, so of any parts at most as many differ. A pair of two sizes meets
    by the parts of the larger, so a set goes by its own and by those of the largest that can be similar to it.
    """
    n = len(held)
    most = n * OF // SHARE
    found = []
    for parts in {_parts(n), _parts(most)}:
        made, rare = _part_keys(held, weight, parts) if parts else (_mixed(held), weight)
        few = (OF - SHARE) * (n + most) // (OF + SHARE) + 1 if parts else n - -(-n * SHARE // OF) + 1
        found.append(made[np.lexsort((made, -rare))[:few]])
    return np.unique(np.concatenate(found))


def frequent(df: DataFrame, n: int, words: int = WORDS, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``sample`` documents hold, sorted, and how many do; ``df`` has ``text``."""
    some = df.select("text").where(F.pmod(F.xxhash64("text"), F.lit(max(1, n // sample))) == 0)

    def made(batches):
        cache = _word_hashes()
        for batch in batches:
            for text in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, cache, words).view(np.int64))], ["x"])

    held = some.mapInArrow(thrifty(made), "x long").groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    rows = held.orderBy(F.desc("n"), "x").limit(FREQUENT).collect()
    values = np.array([r.x for r in rows], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r.n for r in rows], np.int64)[order]


def _prints(df: DataFrame, often: tuple[np.ndarray, np.ndarray], words: int) -> DataFrame:
    """``id, k, fp, n, parity, sketch, keys`` for ``df(id, k, text)``."""
    known, counts = often
    rare = np.maximum(1, RARE - np.rint(64 * np.log2(np.maximum(counts, 2))).astype(np.int64))

    def made(batches):
        cache = _word_hashes()
        for batch in batches:
            fps, sizes, parities, sketches, met = [], [], [], [], []
            for text in batch["text"].to_pylist():
                held = shingles(text, cache, words)
                weight = np.full(len(held), RARE)
                if len(known):
                    at = np.minimum(np.searchsorted(known, held), len(known) - 1)
                    weight = np.where(known[at] == held, rare[at], RARE)
                fps.append(simhash.fingerprint_of(text, words))
                sizes.append(len(held))
                parities.append(parity(held))
                sketches.append(parity(held, SKETCH))
                met.append(keys(held, weight).view(np.int64))
            lists = [pa.array(v, pa.list_(pa.int64())) for v in (parities, sketches, met)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["k"], pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), *lists], ["id", "k", "fp", "n", "parity", "sketch", "keys"])

    return df.mapInArrow(thrifty(made), f"id {df.schema['id'].dataType.simpleString()}, k binary, fp long, n long, parity array<long>, sketch array<long>, keys array<long>")


def _folded(bits: Column, words: Column) -> Column:
    """Parity bits of the same set at half the length, where they are longer than ``words``."""
    halves = F.zip_with(F.slice(bits, 1, words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > words, halves).otherwise(bits)


def possible(pairs: DataFrame, slim: DataFrame) -> DataFrame:
    """The ``pairs(u, v)`` that sizes and parity bits don't rule out; ``slim`` has ``node, n, parity``."""
    # Each side's bits go to the pairs, not the pairs to all bits.
    of = lambda side: slim.join(_small(pairs), F.col("node") == F.col(side)).select("u", "v", F.col("n").alias(f"n_{side}"), F.col("parity").alias(f"p_{side}"))
    n, m = F.col("n_u"), F.col("n_v")
    words = F.least(F.size("p_u"), F.size("p_v"))  # sizes in proportion: one is at most twice the other
    apart = F.zip_with(_folded(F.col("p_u"), words), _folded(F.col("p_v"), words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    differ = F.aggregate(apart, F.lit(0), lambda s, x: s + x)
    fits = F.when(OF * F.least(n, m) < SHARE * F.greatest(n, m), False).otherwise((OF + SHARE) * differ <= (OF - SHARE) * (n + m))
    return of("u").join(of("v"), ["u", "v"]).where(fits).select("u", "v")


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table of keys, broadcast where it has ``SMALL`` rows at most."""
    return F.broadcast(df) if df.count() <= SMALL else df


def verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, words: int = WORDS) -> DataFrame:
    """The checkpointed ``pairs(u, v)`` whose texts are alike, by ``docs(id, k, text)`` and their ``named(node, nk, least, copies)``."""
    few = pairs.count() <= SMALL
    blocks = F.ceil(F.count("*").over(Window.partitionBy("u")) / BLOCK)
    placed = pairs.withColumn("blocks", blocks).groupBy("u", F.pmod(F.xxhash64("v"), F.col("blocks")).alias("block")).agg(F.collect_list("v").alias("vs"))
    # A document's text goes once to each block where it is the hub (v is null there) or a member, and no other text moves.
    roles = placed.select("u", "block", F.explode(F.concat(F.array(F.lit(None).cast("long")), "vs")).alias("v")).withColumn("who", F.coalesce("v", "u"))
    roles = _small(cut(named.join(F.broadcast(roles) if few else roles, F.col("node") == F.col("who"))))
    found = docs.join(roles, (F.col("k") == F.col("nk")) & F.col("id").eqNullSafe(F.col("least"))).select("copies", "u", "block", "v", "text")
    rows = found.where("copies = 1").unionByName(found.where("copies > 1").dropDuplicates(["u", "block", "v"]))
    rows = rows.repartition("u", "block").sortWithinPartitions("u", "block", F.asc_nulls_first("v"))

    def made(batches):
        cache, hub = _word_hashes(), None
        for batch in batches:
            us, vs = [], []
            for u, v, text in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = shingles(text, cache, words)
                if v is None:
                    hub = own
                elif alike(hub, own):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return rows.select("u", "v", "text").mapInArrow(thrifty(made), "u long, v long")


def _components(links: DataFrame) -> DataFrame:
    """``node, component`` of checkpointed ``links(u, v)``: at most ``SMALL`` are joined on the driver, which takes no shuffles, and more by ``components``."""
    if links.count() > SMALL:
        return components(links)
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for u, v in links.toArrow().to_pandas().itertuples(index=False):
        u, v = top(u), top(v)
        above[max(u, v)] = min(u, v)
    columns = [pa.array(list(above), pa.int64()), pa.array([top(x) for x in list(above)], pa.int64())]
    return F.broadcast(links.sparkSession.createDataFrame(pa.Table.from_arrays(columns, ["node", "component"])))


def _by_component(posts: DataFrame, links: DataFrame) -> DataFrame:
    """``x, node, n, central, c, held`` of the documents of keys whose documents are in several components, and how many these are."""
    found = _components(links).withColumnsRenamed({"node": "far"})
    rows = posts.join(found, F.col("node") == F.col("far"), "left").withColumn("c", F.coalesce("component", "node"))
    over = Window.partitionBy("x")
    rows = rows.withColumns({"lo": F.min("c").over(over), "hi": F.max("c").over(over), "held": F.count("*").over(over)}).where("lo <> hi")
    return rows.select("x", "node", "n", "central", "c", "held")


def _star(rows: DataFrame, second: bool) -> DataFrame:
    """Pairs of each key's most central document (with ``second``: the most central outside its component) with those of other components."""
    over, order = Window.partitionBy("x"), F.struct(F.col("central"), (-F.col("node")).alias("minus"), F.col("c"))
    rows = rows.withColumn("hub", F.max(order).over(over))
    if second:
        rows = rows.withColumn("hub", F.max(F.when(F.col("c") != F.col("hub.c"), order)).over(over))
    hub, node = -F.col("hub.minus"), F.col("node")
    return rows.where(F.col("c") != F.col("hub.c")).select(F.least(hub, node).alias("u"), F.greatest(hub, node).alias("v")).distinct()


def _rest(rows: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of documents of one key in different components that sizes and ``sketches(node, sketch)`` allow; a key's documents are dealt to parts."""
    dealt = rows.join(sketches, "node").withColumn("parts", F.ceil(F.col("held") / BLOCK).cast("int"))
    side = lambda name, part: dealt.select("x", part.alias("part"), F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("n", "c")], *[F.col("sketch")[i].alias(f"s{i}_{name}") for i in range(SKETCH)])
    a = side("u", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    b = side("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    n, m = F.col("n_u"), F.col("n_v")
    differ = sum((F.bit_count(F.col(f"s{i}_u").bitwiseXOR(F.col(f"s{i}_v"))) for i in range(SKETCH)), F.lit(0))
    fits = (F.col("c_u") != F.col("c_v")) & (F.col("u") < F.col("v")) & (OF * F.least(n, m) >= SHARE * F.greatest(n, m)) & ((OF + SHARE) * differ <= (OF - SHARE) * (n + m))
    return a.join(b, ["x", "part"]).where(fits).select("u", "v").distinct()


def grouped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Every row's ``id`` and the digest ``k`` of its text, and ``k, least, copies, component`` of every digest."""
    bound_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(text)).alias("k"), text.alias("text"))
    prints = _prints(docs, frequent(docs, docs.count(), words), words)
    first = [F.first(c).alias(c) for c in ("fp", "n", "parity", "sketch", "keys")]  # equal for equal texts
    nodes = cut(prints.groupBy("k").agg(F.min("id").alias("least"), F.count("*").alias("copies"), *first).withColumn("node", F.monotonically_increasing_id()))
    slim = nodes.select("node", "n", "parity")
    # Nearly every key is one document's own, so a grouped count would shuffle them all for nothing.
    shared = nodes.select("node", "n", F.size("keys").alias("all"), F.explode("keys").alias("x")).withColumn("held", F.count("*").over(Window.partitionBy("x")))
    met = F.count("*").over(Window.partitionBy("node"))
    posts = cut(shared.where("held > 1").withColumn("central", met / F.col("all")).select("x", "node", "n", "central"))
    by_print = cut(nodes.groupBy("fp").agg(F.min("node").alias("u"), F.count("*").alias("same")))
    same = nodes.join(_small(cut(by_print.where("same > 1"))), "fp").where("node <> u").select("u", F.col("node").alias("v"))
    near_prints = _small(cut(simhash.links(by_print.select("fp"), DISTANCE).withColumnsRenamed({"u": "p", "v": "q"})))
    of = lambda side, name: by_print.join(near_prints, F.col("fp") == F.col(side)).select("p", "q", F.col("u").alias(name))
    close = of("p", "a").join(of("q", "b"), ["p", "q"]).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).unionByName(same)
    named = nodes.select("node", F.col("k").alias("nk"), "least", "copies")

    check = lambda pairs: cut(verified(cut(possible(cut(pairs), slim)), docs, named, words))
    near = check(close)
    for second in (False, True):
        near = near.unionByName(check(_star(_by_component(posts, near), second)))
    near = near.unionByName(check(_rest(_by_component(posts, near), nodes.select("node", "sketch"))))
    found = _components(near)
    return docs.select("id", "k"), nodes.select("node", "k", "least", "copies").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``id_col, component_id``: the smallest id reachable over pairs that are alike, for every row."""
    docs, labels = grouped(df, id_col, text_col, words)
    smallest = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = labels.join(smallest, "component")
    return docs.join(labels.select("k", "component_id"), "k").select(F.col("id").alias(id_col), "component_id")


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row of each group, all columns: the one with the smallest id (nulls last), then the smallest digest of its text; of equal rows, any one."""
    _, labels = grouped(df, id_col, text_col, words)
    least = labels.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "k", "copies")).alias("one"))
    kept = _small(cut(least.select("one.least", "one.k", "one.copies")))
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # no name of the table can clash
    own, text = (F.col(f"c{df.columns.index(c)}") for c in (id_col, text_col))
    rows = numbered.join(kept, (F.unhex(F.md5(F.coalesce(text, F.lit("")))) == F.col("k")) & own.eqNullSafe(F.col("least")))
    once = rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates(["k"]))
    return once.select(*numbered.columns).toDF(*df.columns)
