"""The operators against brute force, on small tables with every odd row."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from versicle.llm import bpe, common, components, ftrl, licenses, packing, quality, queries, rules, shingles, simhash, toxicity, urls, vectors, wordpiece
from versicle.llm.common import held_out

RANKS, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
CLASH = "id long, ids string, key string, score string, fp string, label string, offset string, node string, language string, k0 string, __row string"
LONG = "".join(random.Random(3).choices(["word ", "don't", "été ", "  ", "\n", "12.5", "日本", "x" * 700, "-- "], k=3000))
TEXTS = [None, "", " \t\n", "one", "The same text, twice over, here.", "The same text, twice over, here.", LONG, "y" * 40_000, "a\u00a0b \x1cc <|endoftext|> İΣ", "é" * 9 + "!!"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, "en" if n % 2 else None, f"s{n % 3}", len(t or ""), n, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x") for n, t in enumerate(TEXTS)]
    rows.append((*rows[4][:1], "A second row of one id", *rows[4][2:]))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, n % 2, (n + 1) % 2) for n in range(8)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


# ---- 1 and 10 ------------------------------------------------------------------------------------


def _encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk, overlap", [(32_768, 256), (50, 12), (7, 3)])
def test_bpe_equals_the_library_and_round_trips(docs, empty, chunk, overlap):
    enc = _encoding()
    encoded = bpe.encode(docs, RANKS, P.PATTERN, chunk_chars=chunk, overlap_chars=overlap)
    wanted = sorted((i, enc.encode_ordinary(t)) for i, t in rows_of(docs))
    assert sorted((r.doc_id, list(r.ids)) for r in encoded.collect()) == wanted
    if chunk > 100:
        digests = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(encoded, RANKS).collect())
        texts = {tuple(enc.encode_ordinary(t)): t for _, t in rows_of(docs)}
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert digests == sorted((i, len(x), sha(" ".join(map(str, x)).encode()), sha(texts[tuple(x)].encode())) for i, x in wanted)
        assert bpe.digests(bpe.encode(empty, RANKS, P.PATTERN), RANKS).collect() == []


def test_stitching_without_common_boundaries():
    enc, encoder = _encoding(), bpe.Encoder(RANKS, P.PATTERN)
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choices(["a", "  ", "'re", "'", "\n", "1", "é", " b", "!" * 9, "z" * 30], k=rng.randint(0, 60)))
        chunks = [(o, t, *encoder.spans(t)) for o, t in bpe.cut_text(text, rng.randint(1, 12), rng.randint(1, 9))]
        assert np.frombuffer(bpe.stitch(chunks, encoder), "<i4").tolist() == enc.encode_ordinary(text)


def test_stitching_a_long_run_takes_time_in_proportion():
    encoder, spans = bpe.Encoder(RANKS, P.PATTERN), []
    text = "x" + "ab" * 300_000 + " end"
    chunks = [(o, t, *encoder.spans(t)) for o, t in bpe.cut_text(text, 32_768, 256)]
    counted = type("Counted", (), {"spans": lambda _, t: spans.append(len(t)) or encoder.spans(t)})()
    assert bpe.stitch(chunks, counted) == encoder.ids(text)
    assert sum(spans) <= 4 * len(text)


def _greedy(word, first, rest, longest=130):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in (rest if at else first)), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_wordpiece_counts_are_greedy(docs, empty):
    first, rest = wordpiece.pieces_of_ranks(RANKS)
    wanted = []
    for i, text in rows_of(docs):
        found = [_greedy(w.encode(), first, rest) for w in re.findall(r"[^\W_]+|\S", text)]
        wanted.append((i, len(found), sum(n or 1 for n in found), found.count(0)))
    assert sorted(map(tuple, wordpiece.token_counts(docs, RANKS).collect())) == sorted(wanted)
    assert wordpiece.token_counts(empty, RANKS).collect() == []


def test_automaton_on_random_vocabularies():
    rng = random.Random(5)
    for _ in range(150):
        draw = lambda: {bytes(rng.choices(b"ab", k=rng.randint(1, 5))) for _ in range(7)}
        first, rest = draw(), draw()
        automaton = wordpiece.Automaton(first, rest)
        for _ in range(30):
            word = bytes(rng.choices(b"abc", k=rng.randint(1, 14)))
            assert automaton.count(word) == _greedy(word, first, rest)


# ---- 2 --------------------------------------------------------------------------------------------


def test_packing_is_whole_and_gapless(docs, empty):
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = []
    for i, text in rows_of(docs):
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        wanted += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    made = packing.pieces(docs, WORDS).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))
    rows = packing.pack(made).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.crc) for r in rows) == sorted(wanted)
    _check_sequences(rows, 4096)
    assert packing.pack(packing.pieces(empty, WORDS).drop("ids")).collect() == []


def _check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        ends = 0
        for offset, length in sorted(placed):
            assert offset == ends
            ends += length
        assert ends <= capacity
    return len(by)


def test_packing_in_rounds_stays_near_the_bound(spark):
    rng = random.Random(2)
    lengths = [rng.choice([rng.randint(1, 100), rng.randint(1, 40), 100]) for _ in range(900)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").withColumn("piece", F.lit(0))
    used = _check_sequences(packing.pack(df, capacity=100, shard_pieces=60).collect(), 100)
    assert used <= 1.03 * sum(lengths) / 100 + 1


def _triplets(seed, n=40, capacity=1000):
    """Lengths that fill ``n`` bins exactly, three in each."""
    rng = np.random.default_rng(seed)
    a = rng.integers(capacity // 4, capacity // 2, n)
    b = np.array([rng.integers(capacity // 5, capacity - x - capacity // 7) for x in a])
    return np.concatenate([a, b, capacity - a - b])


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(0)
    for _ in range(40):
        lengths = rng.integers(1, 60, rng.integers(2, 80))
        a, b = (packing.best_fit(lengths, rng.permutation(len(lengths)), 100) for _ in range(2))
        child = packing.crossover(lengths, a, b, 100, rng)
        fill = np.bincount(child, lengths)
        assert len(child) == len(lengths) and fill.max() <= 100 and (fill > 0).all()


def test_crossover_makes_the_packing(monkeypatch):
    """From random orders the islands reach the bound, and beat best-fit decreasing where that is not optimal; without crossover they don't."""
    rng = np.random.default_rng(1)
    lengths = np.minimum(4095, rng.lognormal(6.5, 0.8, 3000).astype(int) + 1)
    bound = packing.lower_bound(lengths, 4096)
    bins = lambda population: int(population[0].max()) + 1
    first, none = packing.evolve(lengths, [], 4096, seed=1, generations=0)
    last, made = packing.evolve(lengths, first, 4096, seed=1)
    assert none == 0 and made >= 1 and bins(first) > bound and bins(last) == bound
    hard = [_triplets(k) for k in range(4)]
    decreasing = [int(packing.best_fit(x, np.argsort(-x, kind="stable"), 1000).max()) + 1 for x in hard]
    evolved = [bins(packing.evolve(x, [], 1000, seed=k, generations=60, size=8)[0]) for k, x in enumerate(hard)]
    assert all(e <= d for e, d in zip(evolved, decreasing, strict=True)) and sum(evolved) < sum(decreasing)
    monkeypatch.setattr(packing, "crossover", lambda lengths, mother, father, capacity, rng: mother)
    assert bins(packing.evolve(lengths, first, 4096, seed=1)[0]) == bins(first) > bound


def test_elites_migrate(spark):
    """The neighbour's elite joins a population; one that solves the shard leads it."""
    row = lambda shard, island, done, elite: (shard, island, done, 9, 8, 1, 1.0, [1], [[elite], [0]])
    state = spark.createDataFrame([row(0, 0, False, 5), row(0, 1, False, 6), row(1, 0, True, 7), row(1, 1, False, 8)], packing._STATE)
    found = {(r.shard, r.island): (r.done, r.population) for r in packing.migrated(state, 2).collect()}
    assert found[0, 0] == (False, [[5], [0], [6]]) and found[0, 1] == (False, [[6], [0], [5]])
    assert found[1, 1] == (True, [[7], [8], [0]]) and found[1, 0][1][0] == [7]


def test_packing_reports_its_rounds_and_allows_clashing_names(spark):
    lengths = _triplets(3, 60, 4000).tolist()
    df = spark.createDataFrame([(n, x, "s", "o", "r", "k") for n, x in enumerate(lengths)], "doc_id long, length long, sequence_id string, offset string, row string, k0 string").withColumn("piece", F.lit(0))
    report = []
    rows = packing.pack(df, capacity=4000, report=report).collect()
    assert _check_sequences(rows, 4000) == report[0].n_bins <= report[0].first_bins and report[0].generations >= 1
    assert [r["row"] for r in rows] == ["r"] * len(lengths) and rows[0].__fields__ == ["doc_id", "length", "row", "k0", "piece", "sequence_id", "offset"]


# ---- 3 and 4 -------------------------------------------------------------------------------------


def test_ftrl_is_sparse_and_learns():
    rng = np.random.default_rng(1)
    model = ftrl.Ftrl(500, alpha=1.0, l1=3.0)
    for _ in range(2000):
        at = np.unique(rng.integers(1, 500, 20))
        bad = rng.random() < 0.3
        model.learn(np.union1d(at, [0]) if bad else at, 1.0, float(bad))
    weights = model.weights(slice(0, 500))
    assert weights[0] > 1 and (weights != 0).sum() < 50


def test_classifiers_on_odd_rows(docs, empty, labels, spark):
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        model = module.fit(docs, labels)
        scored = module.score(docs, model, keep=["doc_id", "score", "k0", "text"] if module is toxicity else ["doc_id"])
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r[-1] <= 1 for r in rows)
        assert module.score(empty, model).collect() == []
        for nothing in (labels.limit(0), labels.select("doc_id", F.lit(None).cast("int").alias(label))):
            rows = module.score(docs, module.fit(docs, nothing)).collect()
            assert all(abs(r.score - 0.5) < 1e-3 for r in rows) and len(rows) == docs.count()
            assert all((r.score >= 0.5) == (module is quality) for r in rows)
        module.fit(empty, labels)
        # Only rows outside the held-out fold count.
        only = labels.where(held_out("doc_id"))
        assert abs(module.score(docs, module.fit(docs, only)).first().score - 0.5) < 1e-3


@pytest.mark.parametrize("query, label, least", [(queries.op3_toxicity, "toxic", 0.93), (queries.op4_quality, "quality", 0.97)])
def test_held_out_accuracy(spark, query, label, least):
    sf = "/root/testdata/sf0.1"
    found = query(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert len(found) > 500 and (found.predicted == found[label]).mean() >= least
    # Clean documents are left alone.
    clean = found[found[label] == (1 if label == "quality" else 0)]
    assert (clean.predicted == clean[label]).mean() >= 0.99


def _plain_ftrl(rows, alpha, beta, l1, l2):
    """The published update, a coordinate at a time; ``rows`` of ``{coordinate: value}, label, weight``; the bias has no penalty."""
    z, n = {}, {}

    def weight(i):
        if i == "bias":
            return -z.get(i, 0.0) * alpha / (beta + n.get(i, 0.0) ** 0.5)
        return 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for features, label, times in rows:
        x = {**features, "bias": 1.0}
        w = {i: weight(i) for i in x}
        p = 1 / (1 + np.exp(-max(-35.0, min(35.0, sum(w[i] * v for i, v in x.items())))))
        for i, v in x.items():
            g = times * (p - label) * v
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def _xx(value):
    """Spark's hash of a long, for the order of rows."""
    return xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), 42) - (2**64 if xxhash.xxh64_intdigest(int(value).to_bytes(8, "little", signed=True), 42) >> 63 else 0)


def _small_corpus(spark):
    rng = random.Random(8)
    words = [f"w{n}" for n in range(60)]
    rows, labels = [], []
    for n in range(240):
        bad, poor = rng.random() < 0.3, rng.random() < 0.4
        text = rng.choices(words, k=rng.randint(3, 40)) + ["vile", "foul"] * bad + ["$$", "BUY"] * 3 * poor
        rng.shuffle(text)
        rows.append((n, " ".join(text), "en" if rng.random() < 0.6 else "de", "shop" if poor else "press", len(text)))
        if n % 3:
            labels.append((n, int(not poor), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_equals_brute_force(spark):
    docs, labels = _small_corpus(spark)
    bits = toxicity.BITS

    def features(text):
        words = [zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())]
        m = 2**32 - 1
        pair, skip, after = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D
        raw = [w * pair & m for w in words]
        for gap, first in ((1, skip), (2, after)):
            raw += [((a * first + b * pair) & m) * pair & m for a, b in zip(words, words[gap:], strict=False)]
        return {((h ^ (h >> 15)) * skip & m) >> (32 - bits): 1.0 for h in raw}

    texts = dict(docs.select("doc_id", "text").collect())
    known = [(r.doc_id, r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    order = sorted(known, key=lambda x: _xx(x[0]))
    weights = _plain_ftrl([(features(texts[i]), float(t), 1.0) for i, t in order * toxicity.EPOCHS], toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect():
        logit = sum(weights.get(i, 0.0) for i in features(texts[r.doc_id])) + weights["bias"]
        assert r.score == pytest.approx(1 / (1 + np.exp(-logit)), abs=1e-5)


def _plain_platt(logits, labels):
    """Slope and shift of least smoothed loss, by a general minimiser: coordinate steps of falling size."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (bad + 2))

    def loss(a, b):
        m = a * logits + b
        return np.sum(np.logaddexp(0, m) - target * m) + 0.5e-3 * ((a - 1) ** 2 + b * b)

    at, step = np.array([1.0, 0.0]), 1.0
    while step > 1e-7:
        moves = [at + step * np.array(d) for d in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))]
        best = min(moves, key=lambda x: loss(*x))
        if loss(*best) < loss(*at):
            at = best
        else:
            step /= 2
    return max(0.0, at[0]), at[1]


def test_co_training_equals_brute_force(spark):
    """Every round's fits, calibrations, confident rows, and the final scores, computed plainly."""
    docs, labels = _small_corpus(spark)
    bits, handed, rounds, mask = quality.BITS, 5, 2, (1 << quality.BITS) - 1
    rows = {r.doc_id: r for r in docs.collect()}

    def content(text):
        pieces = text.split()
        words, shapes = ([zlib.crc32(b) & mask for b in part] for part in ([p.lower().encode() for p in pieces], [b"shape " + quality.shape_of(p).encode() for p in pieces]))
        found = {}
        for hashes, scale in ((shapes, 2.0), (words, 1.0)):
            for h in set(hashes):
                found[h] = found.get(h, 0.0) + scale * (hashes.count(h) / len(pieces)) ** 0.5
        raw = [zlib.crc32(p.lower().encode()) for p in pieces]
        repeats = sum(a == b for a, b in zip(raw, raw[1:], strict=False)) / max(1, len(raw) - 1)
        for tell in (f"repeats {int(np.ceil(10 * repeats))}", f"distinct {int(10 * len(set(words)) / len(pieces)) if len(pieces) > 20 else -1}", "empty False"):
            found[zlib.crc32(tell.encode()) & mask] = found.get(zlib.crc32(tell.encode()) & mask, 0.0) + 1.0
        return {k: float(np.float32(v)) for k, v in found.items()}

    def meta(row):
        told = [f"m_lang={row.lang}", f"m_source={row.source}", f"m_n_chars={int(np.log2(max(1, row.n_chars)))}"]
        return {zlib.crc32(t.encode()) & mask: 1.0 for t in told + [f"{told[0]} {x}" for x in told[1:]]}

    features = {"content": {i: content(r.text) for i, r in rows.items()}, "meta": {i: meta(r) for i, r in rows.items()}}
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    truth = {r.doc_id: r.quality for r in labels.collect()}
    known = [i for i in truth if crc(i) not in (0, 1)]
    held = [i for i in truth if crc(i) == 1]
    given = {"content": [], "meta": []}  # rows handed to each view
    offered = {r.doc_id: r.turn for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(rounds)).alias("turn")).collect()}

    def learn():
        # Rows stand in the order of their hashes, which the shuffles of the fit refer to.
        table = sorted([(_xx(i), "", truth[i], i) for i in known + held] + [(_xx(i), "meta", y, i) for i, y in given["content"]] + [(_xx(i), "content", y, i) for i, y in given["meta"]])
        model = {}
        for name, other in (("content", "meta"), ("meta", "content")):
            which = np.array([k for k, (_, giver, _, i) in enumerate(table) if giver == other or (giver == "" and i in known)])
            label = np.array([t[2] for t in table], float)
            share = label[which].mean()
            rng, steps = np.random.default_rng(7), []
            for _ in range(quality.EPOCHS):
                steps += [(features[name][table[k][3]], label[k], 0.5 / (share if label[k] else 1 - share)) for k in rng.permutation(which).tolist()]
            weights = _plain_ftrl(steps, quality.ALPHA, 1.0, quality.L1, quality.L2)
            logit = lambda i, name=name, weights=weights: sum(weights.get(c, 0.0) * v for c, v in features[name][i].items()) + weights["bias"]
            slope, shift = _plain_platt(np.array([logit(i) for i in held]), np.array([truth[i] for i in held], float))
            model[name] = lambda i, logit=logit, slope=slope, shift=shift: slope * logit(i) + shift
        return model

    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    model = learn()
    for turn in range(rounds):
        for name, other in (("content", "meta"), ("meta", "content")):
            pool = [(i, sigmoid(model[name](i))) for i in rows if i not in truth and offered[i] == turn]
            for label in (0, 1):
                sure = sorted(((-max(p, 1 - p), _xx(i), i) for i, p in pool if (p >= 0.5) == bool(label) and max(p, 1 - p) >= quality.CONFIDENT))
                given[other] += [(i, label) for _, _, i in sure[:handed]]
        model = learn()
    assert given["content"] and given["meta"]
    prior = (sum(truth[i] for i in known) + 1) / (len(known) + 2)
    fitted = quality.fit(docs, labels, handed=handed, rounds=rounds)
    for r in quality.score(docs, fitted).collect():
        a, b = model["content"](r.doc_id), model["meta"](r.doc_id)
        assert (r.content_score, r.meta_score) == (pytest.approx(sigmoid(a), abs=2e-4), pytest.approx(sigmoid(b), abs=2e-4))
        assert r.score == pytest.approx(sigmoid(a + b - np.log(prior / (1 - prior))), abs=5e-4)


def test_surest_rows_are_exact_and_bounded(spark):
    rng = random.Random(2)
    rows = [(n, n, rng.choice([0.99, 0.95, rng.random()]), rng.random()) for n in range(3000)]
    found = quality.surest(spark.createDataFrame(rows, "__id long, __hash long, content_score double, meta_score double").repartition(7), handed=20, confident=0.9).collect()
    for view, at in (("content", 2), ("meta", 3)):
        for label in (0, 1):
            pool = sorted((-max(r[at], 1 - r[at]), _xx(r[0]), r[0]) for r in rows if (r[at] >= 0.5) == bool(label) and max(r[at], 1 - r[at]) >= 0.9)
            assert sorted(r["__id"] for r in found if r["__giver"] == view and r["__label"] == label) == sorted(x[2] for x in pool[:20])


def test_training_on_odd_rows(spark):
    """Infinite and odd metadata, repeated ids, and a bound on bytes."""
    inf = float("inf")
    rows = [(n % 40, f"word{n % 7} text {n}", [inf, -inf, float("nan"), None, 3.0][n % 5], ["a", None][n % 2], [n]) for n in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars double, lang string, source array<int>")
    labels = spark.createDataFrame([(n, n % 2, n % 2) for n in range(30)], "doc_id long, quality int, toxic int")
    for most in (1, 1 << 20):
        assert quality.score(docs, quality.fit(docs, labels, train_bytes=most)).count() == 400
        assert toxicity.score(docs, toxicity.fit(docs, labels, train_bytes=most)).count() == 400
    each = common.one_row_each(docs.select("doc_id", "text"), ["doc_id"]).collect()
    assert len(each) == 40 and each == sorted(common.one_row_each(docs.select("doc_id", "text").repartition(3), ["doc_id"]).collect(), key=lambda r: [x.doc_id for x in each].index(r.doc_id))


# ---- 5 and 6 -------------------------------------------------------------------------------------


def _contained(text, templates, k=5, least=0.8):
    words = licenses.words_of(text)
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
    for number, (name, template) in enumerate(templates):
        known = set(licenses.shingles_of(template, k))
        step = licenses.step_of(len(known))
        best = max((len(known & set(grams[w : w + 2 * step])) / len(known) for w in range(0, max(1, len(grams)), step)), default=0)
        if best >= least:
            yield name, number, round(best, 9)


def test_licenses_equal_brute_force(spark, docs, empty):
    mit = licenses.TEMPLATES[2][1]
    edited = mit.replace("modify, merge,", "change, join,")
    texts = [licenses.TEMPLATES[0][1], f"pre {mit} post " * 3, "x " * 99 + edited.upper() + " y" * 50, mit[:200], "MIT License", "Licensed under CC BY-NC 4.0.\n" + licenses.TEMPLATES[3][1]]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, step string").unionByName(docs.select("doc_id", "text", F.lit("q").alias("step")).withColumn("doc_id", F.col("doc_id") + 100))
    found = sorted((r.doc_id, r.license, r.template, round(r.containment, 9)) for r in licenses.scan(df).collect())
    wanted = {(r.doc_id, *hit) for r in df.collect() for hit in _contained(r.text or "", licenses.TEMPLATES)}
    assert found == sorted(wanted) and {x[0] for x in found} == {0, 1, 2, 5}
    assert licenses.scan(empty).collect() == [] and licenses.scan(df, templates=()).collect() == []


def test_bands_retrieve_and_templates_may_be_a_table(spark, monkeypatch):
    """With one band fewer matches are found than with all; a table of templates, in several groups, gives the same as pairs."""
    rng = random.Random(7)
    words = [f"t{n}" for n in range(400)]
    templates = [(f"L{n}", " ".join(rng.choices(words, k=rng.randint(9, 90)))) for n in range(40)]
    texts = []
    for _, text in templates:
        some = text.split()
        some[len(some) // 2] = "edited"
        texts += [" ".join(rng.choices(words, k=30) + some + rng.choices(words, k=30)), " ".join(rng.choices(words, k=7) + text.split())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = sorted((i, *hit) for i, t in enumerate(texts) for hit in _contained(t, templates))
    rows = lambda found: sorted((r.doc_id, r.license, r.template, round(r.containment, 9)) for r in found.collect())
    assert rows(licenses.scan(df, templates=templates)) == wanted and len(wanted) > 50
    assert len(rows(licenses.scan(df, templates=templates, collision=0.01))) < len(wanted)
    table = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(templates)], "template int, license string, text string")
    monkeypatch.setattr(licenses, "GROUP", 15)
    assert rows(licenses.scan(df, templates=table)) == wanted


def test_bands_guarantee_their_probability():
    for n in range(1, 70):
        shared = -(-4 * n // 5)
        similarity = shared / (2 * licenses.step_of(n) + n - shared)
        assert 1 - (1 - similarity) ** licenses.bands_for(n) >= licenses.COLLISION - 1e-12


URLS = [(1, "https://A.b.ORG/x?q"), (2, None), (3, "no scheme/fr/"), (4, "http://m.example.org/es/1"), (5, "x://example.org/en/12"), (6, "http://notexample.org/es/1"), (7, "http://s.com/fr/#t"), (8, "http://s.com/de/1"), (9, "http://s.com"), (10, "a://b://c.com/de/"), (11, ""), (11, "")]


def test_urls(spark, empty):
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in URLS], "page_id long, url string, host string, verdict string")
    rows = {r.page_id: r for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(URLS) and urls.judge(df.limit(0)).count() == 0
    assert (rows[1].host, rows[1].path, rows[1].rule, rows[1].verdict) == ("a.b.org", "/x", "org/", "allow")
    assert (rows[2].host, rows[2].path, rows[2].rule) == ("", "", None) and (rows[3].host, rows[3].path) == ("", "")
    assert [rows[n].rule for n in (4, 5, 6, 7, 8, 9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None]
    assert (rows[10].host, rows[10].path) == ("b:", "//c.com/de/") and {r.verdict for r in rows.values()} == {"allow", "block"}


def _tree(spark, paths):
    pages = urls.templates(spark.createDataFrame(paths, "host string, path string, verdict string"))
    return {(r.host, r.template): r.learnt for r in urls.template_verdicts(pages).collect()}


def test_url_branches_learn_from_labels(spark):
    paths = [("h.com", f"/shop/{n}.html", "block") for n in range(40)] + [("h.com", f"/news/{n}", "allow") for n in range(40)] + [("h.com", "/shop/new.html", None), ("h.com", "/news/new", None), ("o.net", "/a", None)]
    assert _tree(spark, paths) == {("h.com", "shop/*.html"): "block", ("h.com", "news/*"): "allow", ("o.net", "*"): "allow"}


def test_url_siblings_are_compared_with_each_other(spark):
    """A half blocked branch isn't merged with an all blocked one, though both are over their host's share."""
    says = lambda n, blocked: ["block"] * blocked + ["allow"] * (n - blocked)
    paths = [("h.com", f"/{seg}/{k}", v) for seg, n, blocked in (("x", 100, 50), ("y", 100, 100), ("z", 400, 0)) for k, v in enumerate(says(n, blocked))]
    assert _tree(spark, paths) == {("h.com", "x/*"): "allow", ("h.com", "y/*"): "block", ("h.com", "z/*"): "allow"}


def test_merged_url_branches_join_their_subtrees(spark):
    """Two alike branches have too few blocked pages of one kind each; joined, they have enough."""
    paths = [("h.com", f"/{seg}/{kind}/{k}", v) for seg in ("a", "b") for kind, v, n in (("ads", "block", 10), ("text", "allow", 30)) for k in range(n)]
    paths += [("h.com", f"/{seg}/ads/new", None) for seg in ("a", "b")]
    state = _tree(spark, paths)
    assert state["h.com", "a/ads/*"] == state["h.com", "b/ads/*"] == "block" and state["h.com", "a/text/*"] == "allow"
    merged = urls.merged_siblings(
        spark.createDataFrame([("h", [s, "k"], 2, b, 0.5, "", True) for s, b in (("a", 1), ("b", 1), ("c", 2))], "host string, parts array<string>, n long, b long, share double, branch string, open boolean"), 1
    )
    assert merged.count() == 0  # two labelled pages are too few
    odd = [("h.com", f"/p{n}/x", "block") for n in range(60)] * 5 + [("h.com", f"/q/{n}", "allow") for n in range(31)]
    # Sixty even segments have neither a share of the pages nor labelled pages enough: one wildcard. /q has both.
    assert _tree(spark, odd) == {("h.com", "*/x"): "block", ("h.com", "q/*"): "allow"}


# ---- 7 --------------------------------------------------------------------------------------------


def test_rules_base_counts_equal_brute_force(docs, empty):
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(grams) < 1500 else None
        lines = text.split("\n")
        dup = sum(1 for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:k])
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, covered and len(covered) or (0 if covered is not None else None)

    extra = ["a b c d e f\na b c d e f\n\n \n", "w " * 30, "#x <y> | z\n\x0b\n#x", " ".join(f"u{n}" for n in range(60))]
    df = docs.select("doc_id", "text", "lang").unionByName(docs.sparkSession.createDataFrame([(50 + n, t, "en") for n, t in enumerate(extra)], "doc_id long, text string, lang string"))
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.judge(df).collect())
    rows = sorted((r.doc_id, *brute(r.text or "")) for r in df.collect())
    for got, want in zip(found, rows, strict=True):
        assert got[:5] == want[:5] and (want[5] is None or got[5] == want[5])
        assert got[6] == (got[1] < 10 or 100 * got[5] > 20 * got[1])
    assert rules.judge(empty).collect() == []


def test_rules_reject_divergent_texts_only(spark):
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "lorem ipsum dolor amet".split() for b in ("", "ing", "ed", "s")] + rules.COMMON["en"][:12] * 2
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    good = [text(rng.randint(60, 300)) for _ in range(60)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:4]] + [" ".join(w + "###" for w in t.split()) for t in good[4:8]]
    short = ["ONLY A FEW WORDS HERE BUT TEN OF THEM NOW YES"]
    df = spark.createDataFrame([(n, t, "en") for n, t in enumerate(good + bad + short)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in rules.judge(df).collect()}
    assert all(kept[n] for n in range(60)) and not any(kept[n] for n in range(60, 68)) and kept[68]
    # The divergence is a distance: 0 for equal shares, 1 for disjoint ones.
    assert rules.distance(np.array([[2.0, 2, 0], [0, 0, 3]]), np.array([[0.5, 0.5, 0], [0.5, 0.5, 0]])).round(6).tolist() == [0, 1]


def test_rules_verdicts_equal_brute_force(spark):
    """References, both distances, the guards and the verdict, computed plainly."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    odd = [(9000, None, "en"), (9001, "", "xx"), (9002, "ONLY " * 40, None), (9003, "123 456 " * 30, "xx")]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    found = {r.doc_id: r for r in rules.judge(docs).collect()}
    kinds, texts = len(rules.CLASSES), {r.doc_id: (r.text or "", r.lang if r.lang in rules.COMMON else None) for r in docs.collect()}

    def kind(c):
        if ord(c) >= 128:
            return 8 if ord(c) < 0x800 else 9 if ord(c) < 0x10000 else 10
        return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "\t\x0b\x0c " else 4 if c in "\r\n" else 5 if c in ".,;:?" else 6 if c in "\"'()[]-" else 7

    def counts(text, lang):
        chars = [0] * kinds
        for c in text:
            chars[kind(c)] += 1
        common = rules.COMMON.get(lang, [])
        words = [0] * 21
        for piece in text.split() if lang else []:
            word = re.sub(r"^[\"'(\[]+|[.,;:?!\"')\]]+$", "", piece)
            word = word[:1].lower() + word[1:]
            words[common.index(word) if word in common else len(common)] += 1
        return chars, words

    def distance(have, reference):
        if not sum(have) or reference is None:
            return None
        p = [x / sum(have) for x in have]
        part = lambda a, b: sum(x * np.log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x)
        return max(0.0, (part(p, reference) + part(reference, p)) / 2) ** 0.5

    held = {i: counts(t, lang) for i, (t, lang) in texts.items()}
    references = {}
    for lang in {lang for _, lang in texts.values()}:
        long = [i for i, (_, other) in texts.items() if other == lang and not found[i].base_failed and found[i].n_words >= 40]
        for part in (0, 1):
            shares = [[x / sum(held[i][part]) for x in held[i][part]] for i in long if sum(held[i][part])]
            references[lang, part] = [sum(x) / len(shares) for x in zip(*shares, strict=True)] if shares else None
    for i, (_, lang) in texts.items():
        r, bad = found[i], found[i].base_failed
        for part, said, size, least, most, slack in ((0, r.char_distance, r.word_chars, rules.MIN_CHARS, rules.MAX_CHAR_DISTANCE, rules.CHAR_SLACK), (1, r.word_distance, r.n_words, rules.MIN_COMMON, rules.MAX_WORD_DISTANCE, rules.WORD_SLACK)):
            d = distance(held[i][part], references[lang, part]) if size >= least else None
            assert (said is None) == (d is None) and (d is None or said == pytest.approx(d, abs=1e-9))
            bad = bad or (d is not None and d > most + slack / max(1, size) ** 0.5)
        assert r.kept == (not bad)
    assert 0 < sum(r.kept for r in found.values()) < len(found)


# ---- 8 and 9 -------------------------------------------------------------------------------------


def _components(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(500 + n, 501 + n) for n in range(60)] + [(700, n) for n in range(701, 760)] + [(5, 5)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    wanted = _components(800, edges)
    assert found == {n: wanted[n] for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fingerprint_by_hand():
    def brute(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    for text in [*TEXTS[:6], TEXTS[8], "One two", "one TWO three four three", "É É é", LONG[:3000]]:
        assert simhash.fingerprint_of(text) == brute(text)


@pytest.mark.parametrize("pairwise", [32, 2])
def test_links_find_every_pair(spark, pairwise):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(6)]
    chain = [(1 << 63) ^ ((1 << n) - 1) for n in range(0, 40, 2)]
    crowd = [0x0123456789ABCDEF ^ (1 << a) for a in range(64)]
    values = np.array(sorted({0, *base, *near, *chain, *crowd}), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    place = {int(v): k for k, v in enumerate(values.view(np.int64))}
    edges = [(place[r.u], place[r.v]) for r in simhash.links(df, pairwise=pairwise).collect()]
    assert all(int(np.bitwise_count(values[a] ^ values[b])) <= 2 for a, b in edges)
    near = np.argwhere(np.triu(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2, 1)).tolist()
    assert _components(len(values), edges) == _components(len(values), near)


@pytest.mark.parametrize("n", [100, 10**5, 10**7, 10**9, 10**12])
def test_plan_obeys_the_generalised_pigeonhole(n):
    rng = np.random.default_rng(0)
    sample = tuple(rng.integers(-(2**63), 2**63 - 1, 500).tolist())
    plan = simhash._plan(sample, n, 2)
    bits = [b for some, _ in plan for b in some]
    assert len(bits) == len(set(bits))
    for _ in range(300):  # any two flips leave some partition within its threshold
        flipped = set(rng.choice(64, 2, replace=False).tolist())
        assert any(len(flipped & set(some)) <= t for some, t in plan)
    cost, chosen = simhash.allocate([[0, 5, 1e9, 1e9], [0, 9, 1e9, 1e9], [0, 7, 8, 1e9]], 0)
    assert sum(chosen) == 0 and cost == 13


def test_near_duplicates_on_odd_rows(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    prints = sorted((i, simhash.fingerprint_of(t)) for i, t in rows_of(docs))
    n = len(prints)
    linked = [(a, b) for a in range(n) for b in range(a) if bin(prints[a][1] ^ prints[b][1]).count("1") <= 2]
    wanted = [prints[k][0] for k in _components(n, linked)]
    assert sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in rows) == sorted((i, f, c) for (i, f), c in zip(prints, wanted, strict=True))
    assert simhash.near_duplicates(empty).collect() == []
    with pytest.raises(ValueError, match="even"):
        simhash.links(docs.select(F.col("doc_id").alias("fp")), distance=3)


def test_one_document_of_each_group_stays(spark, docs, empty):
    """Null and repeated ids: every group keeps one row, whatever its id; equal texts are one group."""
    odd = [Row(doc_id=None, text="first text without an id, five words"), Row(doc_id=None, text="another text that has no id at all"), Row(doc_id=7001, text="first text without an id, five words"), Row(doc_id=7002, text="one id"), Row(doc_id=7002, text="one id"), Row(doc_id=7002, text="two texts")]
    table = spark.createDataFrame(odd, "doc_id long, text string").select("*", *[F.lit("z").alias(c) for c in ("k", "node", "c0", "least", "fp", "n", "x")])
    kept = shingles.representatives(table)
    assert kept.columns == table.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", odd[1].text), ("7001", odd[0].text), ("7002", "one id"), ("7002", "two texts")])
    kept = shingles.representatives(docs)
    texts = {t.lower().strip() for _, t in rows_of(docs)}
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert shingles.representatives(empty).collect() == [] and shingles.near_duplicates(empty).collect() == []


def _vector_rows(rng):
    rows, base = [], rng.standard_normal((12, 16))
    for k, b in enumerate(base):
        for _ in range(1 + k % 4):
            rows.append((b + rng.standard_normal(16) * 0.05 * (k % 3)).tolist())
    rows += [base[0].tolist()] * 5 + [(base[0] * 1e-30).tolist(), (base[1] * 3).tolist(), [0.0] * 16, None, [], [float("nan")] * 16, [None] * 16, [1.0] * 3, [2.0] * 3, [1e300] * 16]
    return rows


@pytest.mark.parametrize("block", [512, 2])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = _vector_rows(np.random.default_rng(3))
    df = spark.createDataFrame([(7 * k + 3, v, "l", "n") for k, v in enumerate(rows)], "vec_id long, embedding array<double>, n_links string, node string")
    usable = lambda v: v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = [np.array(v) / np.abs(v).max() if usable(v) else None for v in rows]
    unit = [None if v is None else v / np.linalg.norm(v) for v in unit]
    near = lambda a, b: unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    linked = [(a, b) for a in range(len(rows)) for b in range(a) if near(a, b)]
    degree = np.bincount(np.array(linked).ravel(), minlength=len(rows))
    comp = _components(len(rows), linked)
    wanted = [(7 * k + 3, int(degree[k]), 7 * comp[k] + 3, comp[k] == k) for k in range(len(rows))]
    assert sorted(map(tuple, vectors.near_duplicates(df, recall=0.999999).collect())) == wanted
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_vector_recall_by_brute_force(spark):
    """At the production recall on 12,000 vectors: the links found, of all there are at or above the threshold."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6000, 32))
    noise = rng.standard_normal((6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.94, 0.97, (6000, 1))
    every = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * noise])
    df = spark.createDataFrame([(n, v) for n, v in enumerate(every.tolist())], "vec_id long, embedding array<double>")
    found = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    degree = np.concatenate([(unit[k : k + 2000] @ unit.T >= vectors.THRESHOLD).sum(axis=1) - 1 for k in range(0, len(unit), 2000)])
    assert all(found[n].n_links <= degree[n] for n in range(len(unit)))
    assert sum(found[n].n_links for n in range(len(unit))) >= 0.98 * degree.sum() and degree.sum() > 5000


def test_vector_recall_and_repeated_ids(spark):
    k, tables = vectors.sizes(10_000)
    meet = vectors.collision(np.sqrt(0.1)) ** k
    assert 1 - (1 - meet) ** tables >= 0.99
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links) for r in vectors.near_duplicates(df).collect()) == [("1", 1), ("1", 1), ("1", 1), ("None", 1)]
