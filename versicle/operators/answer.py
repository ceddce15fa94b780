"""Prompts, model answers, and the printed, cited text."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versicle.functions.text import content_words, escape, has_negation, has_phrase, numbers, plain, same_claim, section_label, source_tag, with_period

NOT_IN_SOURCES = "The documents that were searched don't answer this."
DISAGREE = "The sources disagree."
STATUSES = ["answered", "not_in_sources", "conflicting"]
ANSWER_SCHEMA = "status string, claims array<struct<text: string, chunk_id: string>>"


def parse_answer(raw: Column) -> Column:
    """``status, claims`` of a model's JSON; whatever isn't valid is ``not_in_sources`` without claims."""
    read = F.from_json(raw, ANSWER_SCHEMA)
    whole = F.forall(read["claims"], lambda c: c.isNotNull() & c["text"].isNotNull() & c["chunk_id"].isNotNull())
    valid = read["status"].isin(STATUSES) & read["claims"].isNotNull() & whole
    nothing = F.struct(F.lit("not_in_sources").alias("status"), F.array().cast("array<struct<text:string,chunk_id:string>>").alias("claims"))
    return F.when(F.coalesce(valid, F.lit(False)), read).otherwise(nothing)


def schema_json(chunk_ids: Column) -> Column:
    """The JSON schema, as text, that lets a model name only the ids it was shown."""
    text = F.struct(F.lit("string").alias("type"))
    claim = F.struct(
        F.lit("object").alias("type"),
        F.struct(text.alias("text"), F.struct(F.lit("string").alias("type"), chunk_ids.alias("enum")).alias("chunk_id")).alias("properties"),
        F.array(F.lit("text"), F.lit("chunk_id")).alias("required"),
    )
    properties = F.struct(F.struct(F.array(*map(F.lit, STATUSES)).alias("enum")).alias("status"), F.struct(F.lit("array").alias("type"), claim.alias("items")).alias("claims"))
    return F.to_json(F.struct(F.lit("object").alias("type"), properties.alias("properties"), F.array(F.lit("status"), F.lit("claims")).alias("required")))


def describe_lookup(targets: Column) -> Column:
    """``lookup on P 1.0, Q 2.0`` from an array of structs ``policy, version``."""
    named = F.array_join(F.transform(targets, lambda t: F.concat_ws(" ", t["policy"], t["version"])), ", ")
    return F.when(F.size(targets) > 0, F.concat(F.lit("lookup on "), named)).otherwise("lookup")


def describe_compare(policy: Column, old: Column, new: Column) -> Column:
    return F.concat(F.lit("compare "), policy, F.lit(" "), old, F.lit(" -> "), new)


def _side_tag(side: Column, policy: Column, version: Column) -> Column:
    shown = source_tag(side["id"], policy, side["version"], side["heading_path"], side["text"])
    return F.when(side.isNull(), F.concat(F.lit('<missing version="'), escape(version, quotes=True), F.lit('"/>'))).otherwise(shown)


def pair_tag(title: Column, policy: Column, previous: Column, current: Column, old: Column, new: Column) -> Column:
    """Older passage, then newer; a side that is missing stays visible."""
    return F.concat(F.lit('<pair section="'), escape(title, quotes=True), F.lit('">\n'), _side_tag(previous, policy, old), F.lit("\n"), _side_tag(current, policy, new), F.lit("\n</pair>"))


def pair_text(path: Column, previous: Column, current: Column) -> Column:
    """What a reranker reads of a pair."""
    side = lambda label, s: F.when(s.isNull(), label).otherwise(F.concat(F.lit(label + " "), s["version"], F.lit("\n"), s["text"]))
    return F.concat_ws("\n", path, side("current", current), side("previous", previous))


def user_message(question: Column, route: Column, passages: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\n\nRoute: "), route, F.lit("\n\n"), F.array_join(passages, "\n\n"))


def in_order(value: Column, rank: Column) -> Column:
    """An array of values by rank, as an aggregate."""
    return F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), value.alias("value")))), lambda x: x["value"])


def missing_side_note(previous: Column, current: Column, path: Column, new: Column, cited: Column) -> Column:
    """``Removed`` or ``Added in version N: label`` for a one-sided pair whose side is cited; else null."""
    label = section_label(path)
    removed = current.isNull() & F.array_contains(cited, previous["id"])
    added = previous.isNull() & F.array_contains(cited, current["id"])
    note = F.when(removed, F.concat(F.lit("Removed in version "), new, F.lit(": "), label)).when(added, F.concat(F.lit("Added in version "), new, F.lit(": "), label))
    return F.when(label != "", note)


def note_already_said(note: Column, sentences: Column) -> Column:
    """True if a sentence is the note, or has its phrase and its last heading."""
    phrase = plain(F.regexp_extract(note, r"(?i)^\s*((?:removed|added) in version [^:]+):", 1))
    leaf = plain(F.element_at(F.split(F.regexp_extract(note, r"(?i)^\s*(?:removed|added) in version [^:]+:(.*)$", 1), " > "), -1))
    says = lambda s: (plain(s) == plain(note)) | ((phrase != "") & (leaf != "") & has_phrase(plain(s), phrase) & has_phrase(plain(s), leaf))
    return F.exists(sentences, says)


def kept_claims(claims: Column, dedupe: Column) -> Column:
    """Claims (``text, chunk_id``) in order, without those that repeat an earlier kept one."""
    facts = lambda t: {"numbers": numbers(t, words=True), "negated": has_negation(t), "content": content_words(t)}

    def fold(kept: Column, claim: Column) -> Column:
        again = F.exists(kept, lambda k: same_claim(facts(claim["text"]), facts(k["text"])))
        return F.when(dedupe & again, kept).otherwise(F.concat(kept, F.array(claim)))

    return F.aggregate(claims, F.slice(claims, 1, 0), fold)


def render(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """``qid, printed``: sentences that name their sources.

    ``answers`` has ``qid, kind, status, claims, notes``; ``sources`` has ``qid, chunk_id, policy, version, heading_path``. A claim with
    an unknown source is dropped; the source of a repeated claim isn't listed.
    """
    by_id = sources.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("chunk_id", F.concat(F.col("policy"), F.lit(" "), F.col("version"), F.lit(", "), F.col("heading_path")).alias("named")))).alias("known"))
    rows = answers.join(by_id, "qid", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    real = F.transform(F.filter("claims", lambda c: F.map_contains_key("known", c["chunk_id"])), lambda c: F.struct(F.trim(c["text"]).alias("text"), c["chunk_id"].alias("chunk_id")))
    dedupe = ~((F.col("kind") == "compare") | (F.col("status") == "conflicting"))
    rows = rows.withColumn("shown", kept_claims(real, dedupe))
    texts = F.transform("shown", lambda c: c["text"])
    rows = rows.withColumn("told", F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: ~note_already_said(n, texts)))
    lead = F.when(F.col("status") == "conflicting", F.array(F.lit(DISAGREE))).otherwise(F.array().cast("array<string>"))
    paragraph = F.array_join(F.transform(F.concat(lead, texts), with_period), " ")
    block = F.array_join(F.transform("told", with_period), "\n")
    body = F.array_join(F.filter(F.array(paragraph, block), lambda p: p != ""), "\n")
    cited = F.array_distinct(F.transform("shown", lambda c: c["chunk_id"]))
    listing = F.array_join(F.concat(F.array(F.lit("Sources")), F.transform(cited, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.element_at("known", c)))), "\n")
    nothing = (F.col("status") == "not_in_sources") | ((F.size("shown") == 0) & (F.size("told") == 0))
    return rows.select("qid", F.when(nothing, NOT_IN_SOURCES).otherwise(F.concat(body, F.lit("\n\n"), listing)).alias("printed"))


def sources(shown: DataFrame, pairs: DataFrame) -> DataFrame:
    """``qid, chunk_id, policy, version, heading_path, passage`` of every passage that was shown: hits, and both sides of pairs under the pair's policy."""
    sides = pairs.select("qid", "policy", F.explode(F.array_compact(F.array("previous", "current"))).alias("s"))
    both = sides.select("qid", F.col("s.id").alias("chunk_id"), "policy", "s.version", "s.heading_path", F.col("s.text").alias("passage"))
    return shown.select("qid", F.col("id").alias("chunk_id"), "policy", "version", "heading_path", F.col("text").alias("passage")).unionByName(both)


def counterparts(pairs: DataFrame) -> DataFrame:
    """``qid, chunk_id, other``: the text of each passage's counterpart in the other version, null if it has none."""
    old, new = F.col("previous"), F.col("current")
    swapped = F.array(F.struct(old["id"].alias("chunk_id"), new["text"].alias("other")), F.struct(new["id"].alias("chunk_id"), old["text"].alias("other")))
    return pairs.select("qid", F.explode(swapped).alias("s")).select("qid", "s.chunk_id", "s.other").where("chunk_id IS NOT NULL")


def number_citations(claims: DataFrame) -> DataFrame:
    """``qid, chunk_id, number``: sources numbered as first cited by ``claims(qid, pos, chunk_id)``."""
    first = claims.groupBy("qid", "chunk_id").agg(F.min("pos").alias("pos"))
    return first.select("qid", "chunk_id", F.row_number().over(Window.partitionBy("qid").orderBy("pos", "chunk_id")).alias("number"))


