"""Whole questions: files to chunks, and questions to reranked, cited answers, all batched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versicle.functions.text import source_tag
from versicle.functions.versions import compare_versions
from versicle.operators import answer, chunking, compare, dense, fusion, lexical, providers, question
from versicle.operators.runs import load_prompt
from versicle.sources import files as source_files
from versicle.sources.shared import few, settled


def chunk_files(files: DataFrame, pdf: Callable | None = None) -> DataFrame:
    """Chunks with ids and hashes from ``list_files``; a file that can't be read or named stops the run."""
    read = source_files.read_lines(files, pdf)
    policy, version, wrong = chunking.policy_and_version(F.coalesce("lines", F.array().cast("array<string>")), F.regexp_replace("name", r"\.[^.]+$", ""))
    known = read.select("name", "lines", policy.alias("policy"), version.alias("version"), F.coalesce("error", wrong).alias("error"))
    known = known.withColumn("lines", F.when(F.col("error").isNull(), F.col("lines")).otherwise(F.raise_error(F.concat_ws(": ", "name", "error")).cast("array<string>")))
    lines = known.select(F.col("name").alias("doc"), F.posexplode("lines").alias("pos", "line"))
    cut = chunking.split_long(chunking.section_chunks(chunking.heading_blocks(lines)))
    named = cut.join(known.select(F.col("name").alias("doc"), "policy", "version"), "doc").withColumnRenamed("doc", "source")
    whole = F.concat_ws("|", "policy", "version")
    return chunking.identify(named).withColumn("parent_id", F.when(F.col("parent").isNull(), whole).otherwise(F.concat_ws("|", whole, "parent"))).drop("parent", "block")


def validate(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``error``: the first field that is missing or blank, or null."""
    fields = ["id", "text", "policy", "version", "section", "heading_path", "parent_id", "source", "embed_text", "text_sha256", "embed_sha256"]
    blank = lambda c: F.when(F.col(c).isNull() | (F.trim(c) == ""), F.lit(f"missing field: {c}"))
    return chunks.withColumn("error", F.coalesce(*[blank(c) if c in chunks.columns else F.lit(f"missing field: {c}") for c in fields]))


def _target_sets(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``qid, target`` and ``target, policy, version``: what each question searches, and each set of these once.

    Sets come from the catalog (a version of a policy, the latest of all, all that have a version), so there are few, however many questions.
    """
    sets = targets.select("qid", "policy", "version").distinct().groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("policy", "version"))).alias("pairs"))
    sets = settled(sets.withColumn("target", F.to_json("pairs")))
    return sets.select("qid", "target"), sets.select("target", "pairs").distinct().select("target", F.explode("pairs").alias("p")).select("target", "p.policy", "p.version")


def _texts(chunks: DataFrame, ids: DataFrame, text: str) -> DataFrame:
    """``id`` and the text of the named chunks alone: of the others, none is shuffled while the ids are few enough to be broadcast."""
    return chunks.select("id", text).join(few(ids.select("id").distinct()), "id", "left_semi")


def lookup(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, targets: DataFrame, reranker: Callable | None = providers.OverlapReranker, keep: int = 3) -> DataFrame:
    """``qid, id, rank, reranked, in_fused array<string>`` of the kept hits.

    ``questions`` has ``qid, question, search_text, vector``; ``vectors`` has ``id, vector``; ``targets`` has ``qid, policy, version``. Both
    arms search a question's targets alone, with BM25 statistics of exactly these; a set of targets is one corpus for all its questions.
    """
    of_question, sets = _target_sets(targets)
    corpus = chunks.select("policy", "version", "id", "embed_text").join(few(sets), ["policy", "version"]).select("target", "id", "embed_text")
    asked = questions.join(of_question, "qid")
    # Each arm's rows are a few for a question; a plan of both, the fusion and the reranker in one would take longer to make than to run.
    words = settled(lexical.lexical_topk(asked.select("qid", "target", "search_text"), corpus, text_col="embed_text", target_col="target"))
    near = settled(dense.dense_topk(asked.select("qid", "target", "vector"), corpus.select("id", "target").join(vectors, "id"), target_col="target"))
    fused = settled(fusion.rrf_fuse(near, words))
    fused = fused.join(_texts(chunks, fused, "embed_text"), "id")
    ids = fused.groupBy("qid").agg(answer.in_order(F.struct("id", "embed_text"), F.col("rank")).alias("items"))
    texts = F.transform("items", lambda x: x["embed_text"])
    ordered = ids.join(questions.select("qid", "question"), "qid").withColumn("r", providers.rerank(F.col("question"), texts, reranker, keep))
    kept = ordered.select("qid", "r.reranked", "items", F.posexplode("r.order").alias("at", "place"))
    return kept.select("qid", F.get("items", F.col("place"))["id"].alias("id"), (F.col("at") + 1).alias("rank"), "reranked", F.transform("items", lambda x: x["id"]).alias("in_fused"))


def compare_pairs(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, reranker: Callable | None = providers.OverlapReranker, keep: int = 3) -> DataFrame:
    """``qid, policy, old, new, rank, reranked, in_fused, title, heading_path, previous, current``: the kept section pairs.

    ``questions`` has ``qid, question, search_text, vector, policy, versions, known``. Each version is searched on its own,
    with its own statistics; sections are paired by title, once for each pair of versions that is asked about, and
    ranked by their better side.
    """
    two = compare_versions(F.col("versions"), F.col("known"))
    asked = settled(questions).withColumns({"old": F.get(two, F.lit(0)), "new": F.get(two, F.lit(1))}).withColumn("pairing", F.to_json(F.struct("policy", "old", "new")))
    sides = asked.select("qid", "search_text", "vector", "policy", "pairing", F.explode(F.array("old", "new")).alias("version"))
    key = F.to_json(F.struct("policy", "version"))
    sides = sides.withColumns({"target": key, "side": F.struct("qid", "version")})
    asked_of = sides.select("policy", "version").distinct()
    corpus = chunks.join(few(asked_of), ["policy", "version"], "left_semi").withColumn("target", key)
    words = settled(lexical.lexical_topk(sides.select(F.col("side").alias("qid"), "target", "search_text"), corpus, text_col="embed_text", target_col="target"))
    near = settled(dense.dense_topk(sides.select(F.col("side").alias("qid"), "target", "vector"), corpus.select("id", "target").join(vectors, "id"), target_col="target"))
    fused = settled(fusion.rrf_fuse(near, words)).select("qid.qid", "id", "score", F.col("rank").alias("best_rank"))
    hits = fused.join(asked.select("qid", F.col("pairing").alias("policy")), "qid")
    pairings = asked.select("pairing", "policy", "old", "new").distinct()
    # Sections are paired without their texts, which only the pairs that are kept get back.
    bare = chunks.withColumn("text", F.lit(None).cast("string"))
    of = lambda side: pairings.join(bare.withColumnRenamed("version", side), ["policy", side]).withColumn("version", F.col(side)).drop("policy").withColumnRenamed("pairing", "policy")
    pairs = settled(compare.pair_by_title(of("old"), of("new")))
    best = settled(compare.rank_pairs(pairs, hits))
    full = settled(best.join(pairs.select("policy", "title", "ordinal", "heading_path", "previous", "current"), ["policy", "title", "ordinal"]).drop("policy"))
    texts = _texts(chunks, full.select(F.explode(F.array("previous.id", "current.id")).alias("id")), "text")
    for side in ("previous", "current"):
        full = full.join(texts.select(F.col("id").alias("of"), F.col("text").alias("found")), F.col(f"{side}.id") == F.col("of"), "left")
        full = full.withColumn(side, F.when(F.col(side).isNotNull(), F.struct(*[F.col("found").alias("text") if c == "text" else F.col(side)[c].alias(c) for c in compare.SIDE]))).drop("of", "found")
    items = full.groupBy("qid").agg(answer.in_order(F.struct("title", "heading_path", "previous", "current"), F.col("rank")).alias("items"))
    texts = F.transform("items", lambda x: answer.pair_text(x["heading_path"], x["previous"], x["current"]))
    ordered = items.join(asked.select("qid", "question", "policy", "old", "new"), "qid").withColumn("r", providers.rerank(F.col("question"), texts, reranker, keep))
    ids = F.array_compact(F.flatten(F.transform("items", lambda x: F.array(x["previous"]["id"], x["current"]["id"]))))
    kept = ordered.select("qid", "policy", "old", "new", "r.reranked", ids.alias("in_fused"), "items", F.posexplode("r.order").alias("at", "place")).withColumn("p", F.get("items", F.col("place")))
    return kept.select("qid", "policy", "old", "new", (F.col("at") + 1).alias("rank"), "reranked", "in_fused", "p.title", "p.heading_path", "p.previous", "p.current")


def compare_hits(pairs: DataFrame) -> DataFrame:
    """``qid, kind, policy, id, rank, reranked``: both sides of the pairs, where they exist."""
    sides = pairs.select("qid", F.lit("compare").alias("kind"), "policy", F.explode(F.array("previous.id", "current.id")).alias("id"), "rank", "reranked")
    return sides.where("id IS NOT NULL")


def answers(questions: DataFrame, hits: DataFrame, pairs: DataFrame, chunks: DataFrame, targets: DataFrame, generator: Callable = providers.ExtractiveGenerator) -> DataFrame:
    """``qid, kind, status, claims, notes, printed`` of ``questions(qid, question, kind)``, lookups and comparisons alike.

    A question's prompt is its route and the tagged passages; a model may name only the ids it was shown, and
    without passages none is asked. A comparison's one-sided sections are noted where they are cited.
    """
    shown = hits.join(chunks.select("id", "policy", "version", "heading_path", "text"), "id")
    one = shown.withColumn("tag", source_tag(F.col("id"), F.col("policy"), F.col("version"), F.col("heading_path"), F.col("text")))
    looked = one.groupBy("qid").agg(answer.in_order(F.col("tag"), F.col("rank")).alias("tags"), answer.in_order(F.array("id"), F.col("rank")).alias("ids"))
    route = targets.groupBy("qid").agg(answer.describe_lookup(F.array_sort(F.collect_list(F.struct("policy", "version")))).alias("route"))
    looked = looked.join(route, "qid", "left").withColumn("route", F.coalesce("route", F.lit("lookup")))
    tag = answer.pair_tag(F.col("title"), F.col("policy"), F.col("previous"), F.col("current"), F.col("old"), F.col("new"))
    both = pairs.select("qid", "rank", tag.alias("tag"), F.array_compact(F.array("previous.id", "current.id")).alias("ids"), answer.describe_compare(F.col("policy"), F.col("old"), F.col("new")).alias("route"))
    compared = both.groupBy("qid").agg(answer.in_order(F.col("tag"), F.col("rank")).alias("tags"), answer.in_order(F.col("ids"), F.col("rank")).alias("ids"), F.max("route").alias("route"))
    prompts = questions.select("qid", "question", "kind").join(looked.unionByName(compared), "qid", "left")
    prompt = F.when(F.size("tags") > 0, answer.user_message(F.col("question"), F.col("route"), F.col("tags")))
    prompts = prompts.select("qid", "kind", prompt.alias("prompt"), answer.schema_json(F.flatten("ids")).alias("schema"), F.col("kind").alias("system"))
    systems = {kind: load_prompt(kind) for kind in ("lookup", "compare")}
    raw = providers.generate(prompts, factory=generator, schema_col="schema", system_col="system", systems=systems)
    parsed = settled(raw.withColumn("a", answer.parse_answer(F.col("raw"))).select("qid", "kind", "a.status", "a.claims"))
    cited = parsed.select("qid", F.transform("claims", lambda c: c["chunk_id"]).alias("cited"))
    note = answer.missing_side_note(F.col("previous"), F.col("current"), F.col("heading_path"), F.col("new"), F.col("cited"))
    notes = pairs.join(cited, "qid").withColumn("note", note).where("note IS NOT NULL").groupBy("qid").agg(answer.in_order(F.col("note"), F.col("rank")).alias("notes"))
    told = parsed.join(notes, "qid", "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))
    return told.join(answer.render(told, answer.sources(shown, pairs)), "qid")


def ask(raw: DataFrame, chunks: DataFrame, vectors: DataFrame, aliases: dict[str, list[str]], examples: DataFrame, embedder: Callable = providers.HashingEmbedder, reranker: Callable | None = providers.OverlapReranker, keep: int = 3, generator: Callable | None = None) -> DataFrame:
    """``qid, reason, kind, policy, id, rank, reranked`` for ``raw(qid, text)``; with a ``generator``, ``qid, reason, kind, status, printed``.

    Junk has a ``reason`` and nothing else. A comparison of a policy with fewer than two versions, or of
    none that can be inferred from the nearest chunk, falls back to a lookup.
    """
    cleaned = raw.select("qid", question.clean_question(F.col("text")).alias("question")).withColumn("reason", question.junk_reason(F.col("question")))
    known = compare.catalog(chunks)
    known = settled(known)
    cleaned = settled(cleaned)
    real = cleaned.where("reason IS NULL").select("qid", "question")
    filters = question.extract_filters(real, known, aliases)
    asked = real.join(filters, "qid").withColumn("vector", providers.embed(F.when(F.col("search_text") != "", F.col("search_text")).otherwise(F.col("question")), embedder, "query"))
    routed = question.route_scores(real.withColumn("vector", providers.embed(F.col("question"), embedder, "similarity")), examples).select("qid", "route")
    several = known.where(F.size("versions") >= 2)
    held = chunks.select("id", "policy").join(several.select("policy"), "policy", "left_semi").join(vectors, "id")
    nearest = dense.dense_topk(asked.select("qid", "vector"), held.select("id", "vector"), top_k=1).join(chunks.select("id", F.col("policy").alias("inferred")), "id").select("qid", "inferred")
    asked = asked.join(routed, "qid").join(nearest, "qid", "left").join(several.select(F.col("policy").alias("p2"), F.col("versions").alias("known")), F.coalesce("policy", "inferred") == F.col("p2"), "left")
    # Models are asked once for each question: what they said is kept.
    asked = settled(asked.withColumn("kind", F.when((F.col("route") == "compare") & F.col("p2").isNotNull(), "compare").otherwise("lookup")))
    looking = asked.where("kind = 'lookup'")
    targets = compare.lookup_targets(looking.select("qid", "policy", "versions"), few(known))
    found = settled(lookup(looking, chunks, vectors, targets, reranker, keep))
    pairs = settled(compare_pairs(asked.where("kind = 'compare'").withColumn("policy", F.col("p2")), chunks, vectors, reranker, keep))
    if generator is not None:
        said = answers(asked, found, pairs, chunks, targets, generator)
        return cleaned.select("qid", "reason").join(said.select("qid", "kind", "status", "printed"), "qid", "left")
    named = found.join(looking.select("qid", "policy"), "qid").select("qid", F.lit("lookup").alias("kind"), "policy", "id", "rank", "reranked")
    return cleaned.select("qid", "reason").join(named.unionByName(compare_hits(pairs)), "qid", "left")
