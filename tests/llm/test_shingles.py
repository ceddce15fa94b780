"""The pipeline's near-duplicate stage against brute-force shingle similarity."""

import numpy as np
import pytest

import corpus_pipeline
from versicle.llm import shingles

SF = "/root/testdata/sf0.001"


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {()}


def brute_force(rows):
    """``id -> smallest id`` over pairs with five-word Jaccard similarity of at least 4/5."""
    sets = {i: _shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    near = [(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in near:
            least = min(group[a], group[b])
            if group[a] != least or group[b] != least:
                group[a] = group[b] = least
                changed = True
    return group


def _crowd():
    """Variants of one text at, above and below the threshold, a chain of edits, and short texts."""
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1000, " ".join(base)), (1001, " ".join(base[:84])), (1002, " ".join(base[:83])), (1003, " ".join(base).upper())]
    for k in range(40):  # each edit changes five shingles
        rows.append((1100 + k, " ".join(base[: 2 + 2 * k] + [f"e{k}"] + base[3 + 2 * k :])))
    chain = list(base)
    for k in range(8):
        chain[10 * k + 9] = f"c{k}"
        rows.append((1200 + k, " ".join(chain)))
    return [*rows, (1300, "a b"), (1301, "A  b"), (1302, "a b c"), (1303, ""), (1304, None), (1305, " \n")]


@pytest.mark.parametrize("given", ["table", "crowd"])
def test_stage_equals_brute_force(spark, given):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if given == "crowd":
        docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in _crowd()], docs.schema)
    group = brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    kept = stage(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in group if group[i] == i)


def test_similar_sets_share_a_key_and_chance_does_not():
    rng = np.random.default_rng(5)
    sets_of = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64))
    for n in [1, 2, 3, 4, 5, 9, 20, 25, 26, 31, 32, 33, 39, 40, 90, 179, 200, 500, 1000]:
        for _ in range(30):
            a = sets_of(n)
            gone = rng.integers(0, n // 5 + 1)
            most = (n - gone) * 5 // 4 - n  # added ones that keep a similarity of 4/5
            b = np.union1d(rng.permutation(a)[gone:], sets_of(rng.integers(0, most + 1)))
            if shingles.alike(a, b):
                weights = [np.where(s % np.uint64(3) == 0, shingles.RARE, 1 + (s % np.uint64(900)).astype(np.int64)) for s in (a, b)]
                assert len(np.intersect1d(shingles.keys(a, weights[0]), shingles.keys(b, weights[1]))), (n, len(b))
    # Unlike texts with a tenth of their shingles from a common stock: nearly every pair shares some, and few pairs share a key.
    stock = sets_of(2000)
    crowd = [np.union1d(sets_of(360), rng.choice(stock, 40, replace=False)) for _ in range(200)]
    found = [shingles.keys(s, np.full(len(s), shingles.RARE)) for s in crowd]
    pairs = [(i, j) for i in range(200) for j in range(i)]
    assert sum(len(np.intersect1d(found[i], found[j])) > 0 for i, j in pairs) < len(pairs) // 50
    assert sum(len(np.intersect1d(crowd[i], crowd[j])) > 0 for i, j in pairs) > len(pairs) // 2


def test_links_are_joined_on_the_driver_as_they_are_apart(spark, monkeypatch):
    rng = np.random.default_rng(6)
    links = spark.createDataFrame([tuple(map(int, rng.choice(60, 2, replace=False))) for _ in range(40)], "u long, v long")
    here = sorted(map(tuple, shingles._components(links).collect()))
    monkeypatch.setattr(shingles, "SMALL", 0)
    assert here == sorted(map(tuple, shingles._components(links).collect()))
