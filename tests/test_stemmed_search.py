"""Stemmed BM25 against brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest

from versicle.functions.stem import stem
from versicle.functions.text import STOPWORDS
from versicle.operators import lexical
from versicle.plans import catalogue

SF = "/root/testdata/sf0.001"


def _terms(text):
    return [stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower()) if w not in STOPWORDS]


def _scores(questions, docs):
    held = {i: Counter(_terms(t)) for i, t in docs}
    lengths = {i: sum(c.values()) for i, c in held.items()}
    average, df = sum(lengths.values()) / len(held), Counter(t for c in held.values() for t in c)
    found = defaultdict(dict)
    for q, text in questions:
        for i, c in held.items():
            score = sum(n * math.log(1 + (len(held) - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * lengths[i] / average)) for t, n in Counter(_terms(text)).items() if c[t])
            if score > 0:
                found[q][i] = score
    return found


def test_other_inflections_are_found(spark):
    docs = spark.createDataFrame([(1, "the policies"), (2, "we feed cats"), (3, "other words"), (4, "feeding policy policies")], "id long, text string")
    asked = spark.createDataFrame([(1, "policy"), (2, "feeding feeds")], "qid long, search_text string")
    found = {(r.qid, r.id): r.score for r in lexical.bm25(asked, docs).collect()}
    wanted = _scores([(1, "policy"), (2, "feeding feeds")], [(r.id, r.text) for r in docs.collect()])
    assert set(found) == {(1, 1), (1, 4), (2, 2), (2, 4)}
    assert all(found[q, i] == pytest.approx(wanted[q][i], abs=2e-6) for q, i in found)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in catalogue.table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in catalogue.table(spark, SF, "benchmark").collect()]
    wanted, found = _scores(items, docs), defaultdict(list)
    for r in catalogue.QUERIES["lexical_topk"](spark, SF).orderBy("qid", "rank").collect():
        found[r.qid].append(r)
    assert set(found) == set(wanted)
    for q, rows in found.items():
        best = sorted(wanted[q].values(), reverse=True)[: lexical.TOP_K]
        assert [r["rank"] for r in rows] == list(range(1, len(best) + 1))
        assert [r.score for r in rows] == pytest.approx(best, abs=2e-6)
        assert all(r.score == pytest.approx(wanted[q][r.id], abs=2e-6) for r in rows)
