"""Scoring retrieval and answers against fixed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versicle.functions.text import content_words, contradicted_change, has_change_language, has_negation, numbers, same_claim


def retrieval_hit(gold: Column, found: Column) -> Column:
    """Every gold id was found; no gold is a hit."""
    return F.size(F.array_except(gold, found)) == 0


def retrieval_hits(questions: DataFrame, gold: DataFrame, found: DataFrame) -> DataFrame:
    """``qid, n_gold, hit`` of every question by pairs ``qid, id``; the gold of a question is counted, not gathered, and may be of any size."""
    marked = gold.select("qid", "id").distinct().join(found.select("qid", "id", F.lit(True).alias("met")).distinct(), ["qid", "id"], "left")
    counts = marked.groupBy("qid").agg(F.count("*").alias("n"), F.count("met").alias("n_met"))
    rows = questions.select("qid").join(counts, "qid", "left")
    return rows.select("qid", F.coalesce("n", F.lit(0)).alias("n_gold"), F.coalesce(F.col("n") == F.col("n_met"), F.lit(True)).alias("hit"))


def containing(items: DataFrame, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``qid, id`` of the documents that contain an item as it stands, from ``items(qid, item)``.

    A document that contains an item holds the item's words but its first and last, which may be cut out of longer ones.
    Documents are looked up by the rarest of these alone, and then searched; an item of fewer than
    three words has none, and meets every document.
    """
    spaced = lambda text: F.filter(F.split(text, r"\s+"), lambda w: w != "")
    inner = F.array_distinct(F.slice(F.split("item", r"\s+"), 2, F.greatest(F.lit(0), F.size(F.split("item", r"\s+")) - 2)))
    asked = items.where(F.col("item").isNotNull()).select("qid", "item", F.explode(F.filter(inner, lambda w: w != "")).alias("word"))
    held = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(spaced(F.col(text_col)))).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").agg(F.count("*").alias("n"))
    rare = asked.join(often, "word", "left").groupBy("qid").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))
    met = held.join(rare, "word").select("qid", "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = met.join(texts, "id").join(items, "qid")
    short = texts.join(items.join(rare, "qid", "left_anti").where(F.col("item").isNotNull()), F.contains(F.col("text"), F.col("item")))
    return found.where(F.contains(F.col("text"), F.col("item"))).select("qid", "id").unionByName(short.select("qid", "id"))


def passes_gate(route_ok: Column, n_gold: Column, in_fused: Column, reranked: Column, in_top: Column) -> Column:
    """The route is right and, where there is gold, it is among the fused, and among the first if a reranker ranked them."""
    return route_ok & ((n_gold == 0) | (in_fused & (~reranked | in_top)))


def score_retrieval(cases: DataFrame, kinds: DataFrame, found: DataFrame) -> DataFrame:
    """``case_id, route_ok, n_gold, in_fused, in_top, reranked, passes`` of ``cases(case_id, route, gold_chunks)``.

    ``kinds`` has ``qid, kind``, the route each took; ``found`` has ``qid, id, reranked, in_fused`` of the kept hits, a row each.
    """
    none = F.array().cast("array<string>")
    by_case = found.groupBy("qid").agg(F.collect_set("id").alias("top"), F.first("in_fused").alias("fused"), F.max("reranked").alias("reranked"))
    rows = cases.join(kinds.withColumnRenamed("qid", "case_id"), "case_id", "left").join(by_case.withColumnRenamed("qid", "case_id"), "case_id", "left")
    gold = F.coalesce("gold_chunks", none)
    rows = rows.select("case_id", F.coalesce(F.col("kind") == F.col("route"), F.lit(False)).alias("route_ok"), F.size(gold).alias("n_gold"), retrieval_hit(gold, F.coalesce("fused", none)).alias("in_fused"), retrieval_hit(gold, F.coalesce("top", none)).alias("in_top"), F.coalesce("reranked", F.lit(False)).alias("reranked"))
    return rows.withColumn("passes", passes_gate(*[F.col(c) for c in ("route_ok", "n_gold", "in_fused", "reranked", "in_top")]))


def route_report(scores: DataFrame, cases: DataFrame, floor: float = 0.50) -> DataFrame:
    """One row ``problems, lowest, lowest_qid``: cases routed wrongly or under the floor, and the lowest best similarity with its case.

    ``scores`` are those of ``question.route_scores``; ``cases`` has ``qid, expected``.
    """
    rows = scores.join(cases, "qid").withColumn("best", F.greatest("best_lookup", "best_compare"))
    wrong = (F.col("route") != F.col("expected")) | (F.col("best") < floor)
    return rows.agg(F.count_if(wrong).alias("problems"), F.min("best").alias("lowest"), F.min_by("qid", F.struct("best", "qid")).alias("lowest_qid"))


def totals(rows: DataFrame) -> DataFrame:
    """One row of sums over ``route_ok, misses, inventions, skipped``."""
    clean = ~F.col("skipped") & (F.size("misses") == 0) & (F.size("inventions") == 0)
    return rows.agg(
        F.sum(F.size("misses")).alias("misses"),
        F.sum(F.size("inventions")).alias("inventions"),
        F.count_if(clean).alias("clean"),
        F.count_if("route_ok").alias("route_ok"),
        F.count_if("skipped").alias("skipped"),
    )


def extra_numbers(claim: Column, passage: Column, versions: Column) -> Column:
    """Numbers of a claim that its passage doesn't have; version labels are no numbers."""
    return F.array_sort(F.array_except(F.array_except(numbers(claim), versions), numbers(passage)))


def claim_problems(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``case_id, pos, inventions, misses`` of single claims.

    ``claims`` has ``case_id, pos, route, text, chunk_id, stale_facts``; ``passages`` has ``case_id, chunk_id, passage, version, other`` (the
    counterpart in the other version, null if none).
    """
    versions = passages.groupBy("case_id").agg(F.array_compact(F.collect_set("version")).alias("versions"))
    rows = claims.join(passages, ["case_id", "chunk_id"], "left").join(versions, "case_id", "left")
    none = F.array().cast("array<string>")
    known = F.coalesce("versions", none)
    extra = F.transform(extra_numbers(F.col("text"), F.col("passage"), known), lambda n: F.concat(F.lit("number "), n, F.lit(" is not in "), F.col("chunk_id")))
    stale = F.filter(F.coalesce("stale_facts", none), lambda f: F.contains(F.lower("text"), F.lower(f)) & ~F.contains(F.lower("passage"), F.lower(f)))
    stale = F.transform(stale, lambda f: F.concat(F.lit("stale fact "), f))
    told = (F.col("route") == "lookup") & has_change_language(F.col("text"), F.coalesce("version", F.lit(""))) & ~has_change_language(F.col("passage"))
    change = F.when(told, F.array(F.concat(F.lit("describes a change that the source does not: "), "text"))).otherwise(none)
    unknown = F.array(F.concat(F.lit("cites a chunk that was not retrieved: "), "chunk_id"))
    reason = F.when(F.col("route") == "compare", contradicted_change(F.col("text"), F.col("passage"), F.col("other"), known))
    misses = F.when(reason.isNotNull(), F.array(F.concat(F.lit("claims a change, but "), reason))).otherwise(none)
    return rows.select("case_id", "pos", F.when(F.col("passage").isNull(), unknown).otherwise(F.concat(extra, stale, change)).alias("inventions"), misses.alias("misses"))


def repeated_claims(claims: DataFrame) -> DataFrame:
    """``case_id, pos, repeats``: whether any earlier claim of the case says the same. Pairs are within a case only."""
    facts = claims.select("case_id", "pos", numbers(F.col("text"), words=True).alias("numbers"), has_negation(F.col("text")).alias("negated"), content_words(F.col("text")).alias("content"))
    a, b = facts.alias("a"), facts.alias("b")
    side = lambda name: {c: F.col(f"{name}.{c}") for c in ("numbers", "negated", "content")}
    met = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("b.pos") < F.col("a.pos")) & same_claim(side("a"), side("b")), "left")
    return met.groupBy(F.col("a.case_id").alias("case_id"), F.col("a.pos").alias("pos")).agg(F.max(F.col("b.pos").isNotNull()).alias("repeats"))


def answer_problems(answers: DataFrame, cases: DataFrame, claims: DataFrame, passages: DataFrame) -> DataFrame:
    """``case_id, misses, inventions`` of whole answers.

    ``answers`` has ``case_id, status, printed, reranked``; ``cases`` has ``case_id, expect_status, gold_chunks, required_facts
    (array of arrays: all, any of), cited_only_gold, no_repeated_claims, needs_rerank``.
    """
    single = claim_problems(claims, passages)
    by_case = single.groupBy("case_id").agg(F.flatten(F.collect_list("inventions")).alias("inv"), F.flatten(F.collect_list("misses")).alias("mis"))
    cited = claims.groupBy("case_id").agg(F.collect_set("chunk_id").alias("cited"))
    again = repeated_claims(claims).groupBy("case_id").agg(F.count_if("repeats").alias("n_repeated"))
    rows = answers.join(cases, "case_id").join(by_case, "case_id", "left").join(cited, "case_id", "left").join(again, "case_id", "left")
    none = F.array().cast("array<string>")
    one = lambda condition, text: F.when(condition, F.array(text)).otherwise(none)
    relaxed = F.col("needs_rerank") & ~F.col("reranked")
    wrong = F.col("status") != F.col("expect_status")
    status = F.concat(F.lit("status "), "status", F.lit(", expected "), "expect_status")
    has = F.coalesce("cited", none)
    no_gold = ~relaxed & (F.size("gold_chunks") > 0) & ~F.coalesce(F.arrays_overlap(has, "gold_chunks"), F.lit(False))
    outside = F.when(~relaxed & F.col("cited_only_gold"), F.transform(F.array_sort(F.array_except(has, "gold_chunks")), lambda c: F.concat(F.lit("cited a chunk outside gold: "), c))).otherwise(none)
    shown = F.lower(F.get(F.split("printed", "\n\nSources"), F.lit(0)))
    absent = F.filter("required_facts", lambda options: ~F.exists(options, lambda o: F.contains(shown, F.lower(o))))
    facts = F.when(~relaxed, F.transform(absent, lambda o: F.concat(F.lit("missing fact "), F.get(o, F.lit(0))))).otherwise(none)
    repeats = F.when(F.col("no_repeated_claims"), F.array_repeat(F.lit("repeated claim"), F.coalesce(F.col("n_repeated"), F.lit(0)).cast("int"))).otherwise(none)
    misses = F.concat(F.coalesce("mis", none), one(wrong & (F.col("status") != "answered"), status), one(no_gold, F.lit("no gold chunk cited")), outside, repeats, facts)
    return rows.select("case_id", misses.alias("misses"), F.concat(F.coalesce("inv", none), one(wrong & (F.col("status") == "answered"), status)).alias("inventions"))
