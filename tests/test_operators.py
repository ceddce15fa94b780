import json
import re
import urllib.error
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from versicle.functions import text as X
from versicle.functions.stem import stem, stemmed
from versicle.operators import answer, chunking, compare, dense, evalkit, fusion, index, lexical, providers, question, runs
from versicle.plans import retrieve
from versicle.plans.stem_sql import stem_tables
from versicle.sources import files


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("raw, cleaned", [(" What’s new in v2? ", "What's new in 2.0?"), ("V 2.1", "2.1"), ("ver. 3", "3.0"), ("revision 2", "revision 2"), (None, ""), ("version v2.0 changes", "version 2.0 changes"), ("v1 and V 2.5, ver. 3?", "1.0 and 2.5, 3.0?"), ("v2.", "2.0."), ("v1.2.3", "1.2.3")])
def test_clean_question(spark, raw, cleaned):
    assert one(spark, raw, question.clean_question) == cleaned


@pytest.mark.parametrize("text, reason", [("", "empty"), ("y" * 501, "too_long"), ("123?", "no_letters"), ("Hi!", "filler"), ("ok...", "filler"), ("qwrtp sdfg", "keymash"), ("nooooooo way", "keymash"), ("How many days off?", None), ("my gym", None)])
def test_junk_reason(spark, text, reason):
    assert one(spark, text, question.junk_reason) == reason


def test_filters_and_removal(spark):
    known = spark.createDataFrame([("Cats", ["1.0", "2.0"]), ("Dogs", ["1.0"])], "policy string, versions array<string>")
    asked = spark.createDataFrame([(1, "What do the cat rules 2.0 say, in 1.5 hours?"), (2, "cat rules or dog rules 1.0?"), (3, "Cat rules?")], "qid int, question string")
    found = {r.qid: r for r in question.extract_filters(asked, known, {"Cats": ["cat rules"], "Dogs": ["dog rules"]}).collect()}
    assert (found[1].policy, found[1].versions, found[1].search_text) == ("Cats", ["2.0"], "What do the say, in 1.5 hours?")
    # Two policies: neither is a filter, and neither is removed; versions are.
    assert (found[2].policy, found[2].versions, found[2].search_text) == (None, ["1.0"], "cat rules or dog rules?")
    assert found[3].search_text == ""
    # Aliases of policies outside the catalog don't count.
    one = question.extract_filters(spark.createDataFrame([(1, "english or french rules 1.0")], "qid int, question string"), spark.createDataFrame([("en", ["1.0"])], "policy string, versions array<string>"), {"en": ["english"], "fr": ["french rules"]}).first()
    assert (one.policy, one.versions, one.search_text) == ("en", ["1.0"], "or french rules")


@pytest.mark.parametrize("look, comp, route", [(0.4, 0.49, "lookup"), (0.6, 0.62, "compare"), (0.6, 0.61, "lookup"), (0.5, 0.5, "lookup")])
def test_route(spark, look, comp, route):
    row = spark.range(1).select(question.choose_route(F.lit(look), F.lit(comp)).alias("r")).first()
    assert row.r == route


def test_bm25_counts_repeated_terms_and_keeps_ties_in_order(spark):
    docs = spark.createDataFrame([("b", "red fox"), ("a", "red fox"), ("c", "no fox no red"), ("d", ""), ("e", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "fox"), (2, "fox fox"), (3, "the of"), (4, "")], "qid int, search_text string")
    rows = lexical.lexical_topk(asked, docs).collect()
    by = {(r.qid, r.id): r for r in rows}
    assert [r.id for r in sorted(rows, key=lambda r: (r.qid, r.rank)) if r.qid == 1] == ["a", "b", "c"]
    assert by[2, "a"].score == pytest.approx(2 * by[1, "a"].score, abs=2e-6)
    assert {r.qid for r in rows} == {1, 2}


def test_dense_guards(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [2.0, 0.0])], "id int, vector array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "qid int, vector array<float>")
    rows = dense.dense_topk(asked, vectors).orderBy("rank").collect()
    assert [(r.id, r.similarity) for r in rows] == [(1, 1.0), (5, 1.0), (2, 0.0), (3, 0.0), (4, 0.0)]


@settings(max_examples=8, deadline=None)
@given(st.permutations(list("abcde")), st.permutations(list("cdefg")))
def test_fusion_is_a_total_order(spark, near, words):
    listed = lambda ids: spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "qid int, id string, rank int")
    rows = fusion.rrf_fuse(listed(near), listed(words)).orderBy("rank").collect()
    rank = [{i: n for n, i in enumerate(ids, 1)} for ids in (near, words)]
    key = lambda i: (-round(sum(1 / (60 + r[i]) for r in rank if i in r), 9), min(r[i] for r in rank if i in r), rank[0].get(i, 6), i)
    assert [r.id for r in rows] == sorted(set(near) | set(words), key=key)


def section(spark, rows):
    schema = "id string, text string, policy string, version string, heading_path string, section string, source string, ordinal int"
    return spark.createDataFrame([(i, "t " + i, "P", v, h, h, "f", o) for i, v, h, o in rows], schema)


def test_pairing_is_a_partition_and_asymmetric(spark):
    old = section(spark, [("o1", "1.0", "1. Naps", None), ("o2", "1.0", "2. Gone", None), ("o3", "1.0", "3. Old > 3.1 Leaf", 1)])
    new = section(spark, [("n1", "2.0", "4. Naps — Updated", 0), ("n2", "2.0", "4. naps", None), ("n3", "2.0", "5. New > 5.1 Leaf", 1)])
    rows = compare.pair_by_title(old, new, {"old": "new"}).collect()
    assert sorted((r.title, r.previous and r.previous.id, r.current and r.current.id) for r in rows) == [("gone", "o2", None), ("naps", "o1", "n2"), ("new > leaf", "o3", "n3")]
    with pytest.raises(PySparkException, match="two old sections"):
        compare.pair_by_title(old.unionByName(section(spark, [("o4", "1.0", "9. Naps", None)])), new).collect()


def test_titles_and_claims(spark):
    assert one(spark, "4. Nap Time — New in Version 2.0 > 4.1 Mats", X.normalize_title) == "nap time > mats"
    assert one(spark, "4.  > 4.1 Mats", X.section_label) == "Mats"
    assert one(spark, "It costs 1,000.50 for five; 2 for 2", lambda c: X.numbers(c, words=True)) == ["1000.50", "2", "5"]
    assert one(spark, "you don’t", X.has_negation) and not one(spark, "another knot", X.has_negation)
    assert one(spark, "score, ", X.with_period) == "score." and one(spark, "", X.with_period) == ""
    assert one(spark, "naïve x_1 12!", X.estimate_tokens) == 6
    assert one(spark, 'a & "b" <c>', lambda c: X.escape(c, quotes=True)) == "a &amp; &quot;b&quot; &lt;c&gt;"


def test_stems(spark):
    known = {"generously": "generous", "hopping": "hop", "hoping": "hope", "skies": "sky", "allocated": "alloc", "allocation": "alloc", "knives": "knive", "consistency": "consist", "agreed": "agre", "by": "by"}
    assert {w: stem(w) for w in known} == known
    rows = spark.createDataFrame([(["hoping", "by", "hoping"],), (None,), ([],), (["skies"],)], "terms array<string>")
    assert [r.s for r in rows.coalesce(1).select(stemmed(F.col("terms")).alias("s")).collect()] == [["hope", "by", "hope"], None, [], ["sky"]]


def test_stems_agree_with_sql(spark):
    """Two forms of the published algorithm, over the words of the documents and its own examples."""
    words = {w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() for w in re.findall("[a-z0-9]+", (r.text or "").lower())}
    words |= set("caresses ponies ties cries gas kiwis feed agreed plastered motoring hopping hoping controlling sky cry by happy relational conditional valency digitizer operator feudalism decisiveness hopefulness sensitivity apology generate communism arsenal triplicate formative formalize electrical goodness revival airliner adoption probate rate controll roll succeed inning news dying early youth enjoyed fizzed national falling skill".split())
    rows = ", ".join(f"('{w}')" for w in sorted(words))
    found = duckdb.sql(f"WITH {stem_tables(f'SELECT * FROM (VALUES {rows}) t(term)')} SELECT term, stem FROM stems").fetchall()
    assert len(found) == len(words) and all(stem(a) == b for a, b in found)


LONG = "One is here. Two follows e.g. Three stays! " + "word " * 300 + ". Last No. 5 ends? Yes."


def test_sentences_agree_with_python(spark):
    for text in (LONG, "A. B? c. D", "", "etc. Then (vs. This) \"Q\". “X”"):
        assert one(spark, text, X.sentences) == chunking.split_sentences(text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from(["Alpha beta.", "Gamma, delta 12!", "x " * 30 + ".", "Word"]), max_size=30), st.integers(5, 40), st.integers(0, 2))
def test_pieces_fit_and_cover(parts, most, overlap):
    text = " ".join(parts)
    pieces = chunking.split_text(text, most, overlap)
    size = lambda s: len(chunking._TOKEN.findall(s))
    assert all(size(p) <= most for p in pieces)
    assert set(" ".join(pieces).split()) == set(text.split())
    if overlap == 0:
        assert " ".join(pieces).split() == text.split()


def test_split_long_keeps_short_and_null(spark):
    rows = chunking.split_long(spark.createDataFrame([(1, "short"), (2, None), (3, LONG * 3)], "n int, text string")).collect()
    assert [(r.n, r.ordinal) for r in rows if r.n < 3] == [(1, None), (2, None)]
    assert sorted(r.ordinal for r in rows if r.n == 3) == list(range(1, sum(r.n == 3 for r in rows) + 1))


def test_policy_and_version(spark):
    rows = [(["", "Cats Policy — Version 2"], "Acme - Cats Policy v2.0"), (["x"] * 5 + ["Cats Policy - Version 2.0"], "Dogs v1"), (["Cats Policy – Version 2.1"], "Cats v2"), (["x"], "nothing")]
    df = spark.createDataFrame(rows, "lines array<string>, stem string")
    found = df.select(*(c.alias(n) for c, n in zip(chunking.policy_and_version(F.col("lines"), F.col("stem")), ("p", "v", "e"), strict=True))).collect()
    assert [(r.p, r.v) for r in found[:2]] == [("Cats Policy", "2.0"), ("Dogs", "1.0")]
    assert found[0].e is None and "mismatch" in found[2].e and "no policy" in found[3].e


def _docx(path, lines):
    body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in lines)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


HANDBOOK = ["Cats Policy — Version {v}", "1. Scope", "1.1 Indoor. They stay {v}.", "2. Feeding. Twice a day."]


def test_files_to_index_and_answers(spark, tmp_path):
    docs, root = tmp_path / "docs", str(tmp_path / "index")
    docs.mkdir()
    for v in ("1.0", "2.0"):
        _docx(docs / f"Cats Policy v{v}.docx", [line.format(v=v) for line in HANDBOOK])
    (docs / "Dogs Policy v1.0.html").write_text("<title>Dogs Policy — Version 1.0</title><script>x</script><p>1. Walks. Three &amp; more a day.</p>")
    (docs / "note.bin").write_bytes(b"\0")
    store = index.IndexStore(spark, root)
    with pytest.raises(index.IndexMissing):
        store.active()
    ingest = lambda: store.ingest(files.list_files(spark, str(docs)).select("name", "suffix", "sha256", "content"), retrieve.chunk_files, {"cap": 256}, embed=providers.embed)
    report = ingest()
    first = store.active().count()
    assert report.counts == {"skip": 0, "add": 3, "replace": 0, "delete": 0} and (report.embedded, report.reused) == (first, 0)
    assert ingest().counts["skip"] == 3
    before = store.manifest()["parts"]
    (docs / "Dogs Policy v1.0.html").unlink()
    report = ingest()
    assert report.counts["delete"] == 1 and [r.name for r in report.names("delete").collect()] == ["Dogs Policy v1.0.html"]
    # Only the part of the file that went is written anew, and a changed name finds its vectors again.
    assert sum(before[p] != name for p, name in store.manifest()["parts"].items()) == 1
    (docs / "Cats Policy v2.0.docx").rename(docs / "More Cats Policy v2.0.docx")
    report = ingest()
    assert (report.counts["add"], report.counts["delete"], report.embedded, report.reused) == (1, 1, 0, 2)
    rows = store.active()
    assert sorted(r.id for r in index.ids_for_source(rows, "More Cats Policy v2.0.docx").collect()) == sorted(r.id for r in index.all_ids(rows.where("version = '2.0'")).collect())
    index.chunks_to_json(rows.drop("vector"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == rows.count()
    with pytest.raises(FileExistsError):
        store.create()
    assert rows.count() == first - 1 and retrieve.validate(rows).where("error IS NOT NULL").isEmpty()
    assert {r.id for r in rows.collect()} == {f"Cats Policy|{v}|{h}" for v in ("1.0", "2.0") for h in ("1. Scope > 1.1 Indoor", "2. Feeding")}

    vectors = rows.select("id", "vector")
    examples = spark.createDataFrame([("lookup", "how often are cats fed"), ("compare", "what changed between versions")], "kind string, text string")
    examples = examples.select("kind", providers.embed(F.col("text"), task="similarity").alias("vector"))
    raw = spark.createDataFrame([(1, "how often are cats fed?"), (2, "hi"), (3, "what changed between versions")], "qid int, text string")
    hits = retrieve.ask(raw, rows, vectors, {"Cats Policy": ["cats policy"]}, examples).collect()
    kinds = {h.qid: (h.reason, h.kind) for h in hits}
    assert kinds == {1: (None, "lookup"), 2: ("filler", None), 3: (None, "compare")}
    assert {h.id.split("|")[1] for h in hits if h.qid == 1} == {"2.0"}
    assert {h.id.split("|")[1] for h in hits if h.qid == 3} == {"1.0", "2.0"}
    told = {r.qid: r for r in retrieve.ask(raw, rows, vectors, {"Cats Policy": ["cats policy"]}, examples, generator=providers.ExtractiveGenerator).collect()}
    assert told[1].status == "answered" and "[1] Cats Policy 2.0, " in told[1].printed
    assert told[2].reason == "filler" and told[2].printed is None
    assert told[3].kind == "compare" and "Cats Policy 1.0, " in told[3].printed and "Cats Policy 2.0, " in told[3].printed
    store.drop()
    store.drop()
    with pytest.raises(index.IndexMissing):
        store.active()


def test_answers_to_lookups_and_comparisons(spark):
    """Both routes' prompts, the schema's ids, the notes on one-sided sections, and no call without passages."""
    chunk = "id string, policy string, version string, heading_path string, text string"
    rows = spark.createDataFrame([("a", "P", "1.0", "1. Naps", "Naps last 5 minutes."), ("b", "P", "2.0", "1. Naps", "Naps last 9 minutes."), ("c", "P", "1.0", "2. Mats", "Mats are blue.")], chunk)
    side = "struct<id:string,text:string,version:string,heading_path:string,section:string,source:string>"
    as_side = lambda i, v, h, t: (i, t, v, h, h, "f")
    pairs = spark.createDataFrame(
        [(2, "P", "1.0", "2.0", 1, True, ["a", "b", "c"], "naps", "1. Naps", as_side("a", "1.0", "1. Naps", "Naps last 5 minutes."), as_side("b", "2.0", "1. Naps", "Naps last 9 minutes.")), (2, "P", "1.0", "2.0", 2, True, ["a", "b", "c"], "mats", "2. Mats", as_side("c", "1.0", "2. Mats", "Mats are blue."), None)],
        f"qid int, policy string, old string, new string, rank int, reranked boolean, in_fused array<string>, title string, heading_path string, previous {side}, current {side}",
    )
    hits = spark.createDataFrame([(1, "a", 1, True, ["a"])], "qid int, id string, rank int, reranked boolean, in_fused array<string>")
    targets = spark.createDataFrame([(1, "P", "1.0")], "qid int, policy string, version string")
    asked = spark.createDataFrame([(1, "how long?", "lookup"), (2, "what changed?", "compare"), (3, "nothing found", "lookup")], "qid int, question string, kind string")

    class Echo:
        def generate(self, prompt, system=None, schema=None):
            import json

            ids = schema["properties"]["claims"]["items"]["properties"]["chunk_id"]["enum"]
            assert system and schema["properties"]["status"]["enum"][0] == "answered" and all(f'id="{i}"' in prompt for i in ids)
            return json.dumps({"status": "answered", "claims": [{"text": prompt.split("Route: ")[1].split("\n")[0], "chunk_id": i} for i in ids]})

    told = {r.qid: r for r in retrieve.answers(asked, hits, pairs, rows, targets, Echo).collect()}
    assert told[1].printed == "lookup on P 1.0.\n\nSources\n[1] P 1.0, 1. Naps"
    assert told[2].printed.startswith("compare P 1.0 -> 2.0. compare P 1.0 -> 2.0. compare P 1.0 -> 2.0.\nRemoved in version 2.0: Mats.\n\nSources\n[1] P 1.0, 1. Naps")
    assert told[3].printed == answer.NOT_IN_SOURCES and told[3].status == "not_in_sources"
    assert sorted((r.qid, r.chunk_id, r.other) for r in answer.counterparts(pairs).collect()) == [(2, "a", "Naps last 9 minutes."), (2, "b", "Naps last 5 minutes."), (2, "c", None)]
    assert sorted((r.qid, r.id) for r in retrieve.compare_hits(pairs).collect()) == [(2, "a"), (2, "b"), (2, "c")]


def test_evaluation_of_retrieval_and_routes(spark):
    cases = spark.createDataFrame([(1, "lookup", ["a"]), (2, "lookup", ["a"]), (3, "compare", []), (4, "lookup", ["b"]), (5, "lookup", ["a"])], "case_id int, route string, gold_chunks array<string>")
    kinds = spark.createDataFrame([(1, "lookup"), (2, "lookup"), (3, "compare"), (4, "compare"), (5, "lookup")], "qid int, kind string")
    found = spark.createDataFrame([(1, "a", True, ["a", "b"]), (2, "b", True, ["a", "b"]), (4, "b", True, ["b"]), (5, "b", False, ["a", "b"])], "qid int, id string, reranked boolean, in_fused array<string>")
    rows = {r.case_id: r.passes for r in evalkit.score_retrieval(cases, kinds, found).collect()}
    assert rows == {1: True, 2: False, 3: True, 4: False, 5: True}
    scores = spark.createDataFrame([(1, 0.9, 0.1, "lookup"), (2, 0.4, 0.45, "lookup"), (3, 0.6, 0.7, "compare")], "qid int, best_lookup double, best_compare double, route string")
    report = evalkit.route_report(scores, spark.createDataFrame([(1, "lookup"), (2, "lookup"), (3, "lookup")], "qid int, expected string")).first()
    assert (report.problems, report.lowest, report.lowest_qid) == (2, 0.45, 2)


def test_runs_around_queries(spark, tmp_path, capsys, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nKEY = 'a b'\nnothing\nOTHER=\"x=y\"\n")
    monkeypatch.delenv("KEY", raising=False)
    assert runs.read_env(env) == {"KEY": "a b", "OTHER": "x=y"} and runs.setting("KEY", "d", env) == "a b"
    monkeypatch.setenv("KEY", "c")
    assert runs.setting("KEY", path=env) == "c" and runs.setting("NO", "d", env) == "d" and runs.read_env(tmp_path / "none") == {}
    facts = runs.provenance({"embed": "abc"}, {"id": "1"}, folder=tmp_path)
    assert facts["code"] == "unknown" and set(facts["prompts"]) == {"lookup", "compare"} and facts["models"] == {"embed": "abc"}
    runs.write_result(spark.range(3), str(tmp_path / "out"), facts)
    assert spark.read.json(str(tmp_path / "out/cases")).count() == 3 and json.loads(spark.read.text(str(tmp_path / "out/facts")).first().value) == json.loads(json.dumps(facts))
    runs.console(silent=True)
    runs.console(silent=True).info("hidden")
    runs.logger.warning("seen")
    with runs.stage("quiet"):
        pass
    with runs.stage("slow", trace=True):
        pass
    told = capsys.readouterr().err
    assert told.count("seen") == 1 and "hidden" not in told and "slow latency=" in told and "quiet" not in told
    waits = []
    providers.pace(None, 6, waits.append)
    providers.pace(providers.OverlapReranker, 6, waits.append)
    assert waits == [6]
    calls = []

    class Counting(providers.HashingEmbedder):
        def embed(self, texts, task):
            calls.append(task)
            return super().embed(texts, task)

    examples, first = providers.Examples(["how many days"], ["what changed"]), Counting()
    assert examples.vectors(first) == examples.vectors(first) and [k for k, _ in examples.vectors(first)] == ["lookup", "compare"]
    examples.vectors(Counting())
    assert calls == ["similarity", "similarity"]


def test_failed_rebuild_keeps_the_old_index(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "i"))
    rows = spark.createDataFrame([("a",), ("b",)], "id string")
    rows = rows.withColumn("source", F.lit("f"))
    listed = lambda ids: spark.createDataFrame([("f", "h", ids)], "name string, sha256 string, chunk_ids array<string>")
    kept = store.publish(rows, listed(["a", "b"]), {"n": 1})
    for wrong in (["a"], ["a", "b", "c"], []):
        with pytest.raises(index.RebuildFailed):
            store.publish(rows, listed(wrong), {"n": 2})
    assert store.manifest()["active"] == kept and store.active().count() == 2


def test_unreadable_files_have_errors(spark):
    rows = spark.createDataFrame([("a.docx", "docx", b"no zip"), ("b.txt", "txt", b"  "), ("c.pdf", "pdf", b"x"), ("d.txt", "txt", b"l1\nl2")], "name string, suffix string, content binary")
    found = {r.name: r for r in files.read_lines(rows).collect()}
    assert found["d.txt"].lines == ["l1", "l2"] and all(found[n].error for n in ("a.docx", "b.txt", "c.pdf"))


def fakes():
    """Local classes are shipped by value: Python workers can't import this module."""

    class Broken:
        def rank(self, question, documents, top_n):
            from versicle.operators.providers import RerankUnavailable

            raise RerankUnavailable("down")

    class Odd:
        def rank(self, question, documents, top_n):
            return [7, 1, 1, -1, 0]

    return {"none": None, "broken": Broken, "odd": Odd, "overlap": providers.OverlapReranker}


@pytest.mark.parametrize("name, order, used", [("none", [0, 1, 2], False), ("broken", [0, 1, 2], False), ("odd", [1, 0], True), ("overlap", [2, 0, 1], True)])
def test_rerank_falls_back(spark, name, order, used):
    df = spark.createDataFrame([("blue cat", ["a", "b", "cat", "d"])], "q string, d array<string>")
    row = df.select(providers.rerank(F.col("q"), F.col("d"), fakes()[name]).alias("r")).first().r
    assert (row.order, row.reranked) == (order, used)


def test_http_reranker_retries_once():
    calls = []

    def post(body):
        calls.append(body)
        if len(calls) == 1:
            raise urllib.error.HTTPError("u", 503, "busy", None, None)
        return json.dumps({"results": [{"index": 1, "relevance_score": 0.2}, {"index": 0, "relevance_score": 0.9}]}).encode()

    assert providers.HttpReranker("u", "k", "m", post, lambda s: None).rank("q", ["a", "b"], 2) == [0, 1]

    def refuse(body):
        raise urllib.error.HTTPError("u", 401, "no", None, None)

    with pytest.raises(providers.RerankUnavailable):
        providers.HttpReranker("u", "k", "m", refuse).rank("q", ["a"], 1)
    with pytest.raises(providers.ModelMismatch):
        providers.check_pin({"m": "sha256:abc"}, "m", "abd")


def test_render(spark):
    claims = "array<struct<text:string,chunk_id:string>>"
    rows = [
        (1, "lookup", "answered", [("Five days off", "a"), ("Days off: five.", "b"), ("Made up", "zz")], []),
        (2, "compare", "answered", [("Added in version 2.0: Mats.", "a")], ["Added in version 2.0: Naps > Mats", "Removed in version 2.0: Old"]),
        (3, "lookup", "conflicting", [("Yes;", "a"), ("No", "b")], []),
        (4, "lookup", "answered", [("Made up", "zz")], []),
    ]
    answers = spark.createDataFrame(rows, f"qid int, kind string, status string, claims {claims}, notes array<string>")
    sources = spark.createDataFrame([(q, c, "P", "2.0", f"H {c}") for q in (1, 2, 3, 4) for c in "ab"], "qid int, chunk_id string, policy string, version string, heading_path string")
    told = {r.qid: r.printed for r in answer.render(answers, sources).collect()}
    assert told == {
        1: "Five days off.\n\nSources\n[1] P 2.0, H a",
        2: "Added in version 2.0: Mats.\nRemoved in version 2.0: Old.\n\nSources\n[1] P 2.0, H a",
        3: "The sources disagree. Yes. No.\n\nSources\n[1] P 2.0, H a\n[2] P 2.0, H b",
        4: answer.NOT_IN_SOURCES,
    }


def test_answer_checks(spark):
    cases = spark.createDataFrame([(1, "answered", ["a"], [["40", "forty"]], True, True, False)], "case_id int, expect_status string, gold_chunks array<string>, required_facts array<array<string>>, cited_only_gold boolean, no_repeated_claims boolean, needs_rerank boolean")
    claims = spark.createDataFrame([(1, 0, "lookup", "The limit is 41 now.", "a", ["41"]), (1, 1, "lookup", "Limit: 41 now", "b", []), (1, 2, "lookup", "x", "q", [])], "case_id int, pos int, route string, text string, chunk_id string, stale_facts array<string>")
    passages = spark.createDataFrame([(1, "a", "The limit is 40.", "2.0", None), (1, "b", "limit 41 now", "2.0", None)], "case_id int, chunk_id string, passage string, version string, other string")
    answers = spark.createDataFrame([(1, "answered", "The limit is 41 now.\n\nSources\n[1] 40", True)], "case_id int, status string, printed string, reranked boolean")
    row = evalkit.answer_problems(answers, cases, claims, passages).first()
    assert sorted(row.inventions) == ["cites a chunk that was not retrieved: q", "describes a change that the source does not: The limit is 41 now.", "number 41 is not in a", "stale fact 41"]
    assert sorted(row.misses) == ["cited a chunk outside gold: b", "cited a chunk outside gold: q", "missing fact 40", "repeated claim"]


@pytest.mark.parametrize(
    "claim, cited, other, reason",
    [
        ("It increased", "5 days!", "Five? no: 5 days", "both versions give the same numbers"),
        ("It changed", "A b.", "a B", "both versions have the same text"),
        ("It has not changed", "a", "a", None),
        ("It increased", "In version 1.0: 5 days", "In version 2.0: 5 days", "both versions give the same numbers"),
        ("It increased", "In version 1.0: 5 days", "In version 2.0: 6 days", None),
        ("It increased", "In version 1.0: some days", "In version 2.0: other days", None),
        ("It increased", "5 days", None, None),
    ],
)
def test_contradicted_change(spark, claim, cited, other, reason):
    row = spark.createDataFrame([(claim, cited, other, ["1.0", "2.0"])], "a string, b string, c string, v array<string>")
    assert row.select(X.contradicted_change(*map(F.col, "abcv")).alias("r")).first().r == reason


def test_lookup_without_targets_scans_everything(spark):
    rows = section(spark, [("a", "1.0", "h", None), ("b", "2.0", "h", None)])
    assert compare.in_targets(rows, None).count() == 2
    assert compare.in_targets(rows, rows.limit(0)).count() == 0


def test_retrieval_hits_count_gold(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    gold = spark.createDataFrame([(1, 10), (1, 11), (1, 11), (2, 10)], "qid long, id long")
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (3, 10)], "qid long, id long")
    rows = {r.qid: (r.n_gold, r.hit) for r in evalkit.retrieval_hits(questions, gold, found).collect()}
    assert rows == {1: (2, True), 2: (1, False), 3: (0, True)}
    none = spark.createDataFrame([], "qid long, id long")
    assert [(r.n_gold, r.hit) for r in evalkit.retrieval_hits(questions, none, none).collect()] == [(0, True)] * 3
