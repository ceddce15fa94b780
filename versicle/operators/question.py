"""Questions: cleaning, rejecting what is none, filters, and the route."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versicle.functions.text import VERSION_PATTERN, every_match
from versicle.operators.dense import cosine

MAX_CHARS, CONSONANT_RUN = 500, 6
ROUTE_MARGIN, ROUTE_FLOOR = 0.02, 0.50
EXAMPLES = 1000
# Words that are no question on their own.
FILLERS = ["hi", "hello", "hey", "ok", "okay", "test", "thanks", "yo", "help"]
# The ways a version is written, and the marks around a question.
_VERSION = r"(?i)\b(?:version|ver\.?|v)\s*([0-9]+)(?:\.([0-9]+))?\b"
_MARKS = "[-!\"#$%&'()*+,./:;<=>?@\\[\\\\\\]^_`{|}~ ]"


def clean_question(raw: Column) -> Column:
    """Straight quotes, single spaces, and ``v2``, ``ver. 2`` or ``Version 2.0`` as ``2.0``."""
    text = F.translate(F.coalesce(raw, F.lit("")), "“”‘’", "\"\"''")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    # In one pass, so that what it makes is never matched again: what stands between the matches, and each match anew.
    major, minor = (F.regexp_extract_all(text, F.lit(_VERSION), F.lit(group)) for group in (1, 2))
    made = F.zip_with(major, minor, lambda a, b: F.concat_ws(".", a, F.when(F.length(b) > 0, b).otherwise("0")))
    parts = F.zip_with(F.split(text, _VERSION, -1), made, lambda before, version: F.concat(before, F.coalesce(version, F.lit(""))))
    return F.array_join(parts, "")


def is_keymash(question: Column) -> Column:
    """Five equal characters in a row, or no word of four letters or more that could be one."""
    words = F.filter(every_match(F.lower(question), "[a-z]+"), lambda w: F.length(w) >= 4)
    strange = lambda w: ~w.rlike("[aeiouy]") | w.rlike(f"[bcdfghjklmnpqrstvwxz]{{{CONSONANT_RUN},}}")
    return question.rlike(r"(.)\1{4,}") | ((F.size(words) > 0) & F.forall(words, strange))


def junk_reason(question: Column) -> Column:
    """The first rule that a cleaned question breaks: empty, too_long, no_letters, filler, keymash; null if none."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(question, f"^{_MARKS}+", ""), f"{_MARKS}+$", ""))
    return (
        F.when(question == "", "empty")
        .when(F.length(question) > MAX_CHARS, "too_long")
        .when(~question.rlike("[A-Za-z]"), "no_letters")
        .when(bare.isin(FILLERS), "filler")
        .when(is_keymash(question), "keymash")
    )


def find_policy(question: Column, aliases: dict[str, list[str]], policies: Column) -> Column:
    """The one policy of the catalog of which an alias stands in the question as whole words; null if none, or more than one."""
    low = F.lower(question)
    stands = lambda some: low.rlike("|".join(rf"\b{re.escape(a)}\b" for a in sorted(some, key=len, reverse=True)))
    named = [F.when(F.array_contains(policies, F.lit(policy)) & stands(some), F.lit(policy)) for policy, some in aliases.items()]
    found = F.array_compact(F.array(*named))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def find_versions(question: Column, known: Column) -> Column:
    """Dotted numbers that are known versions, distinct, as first named."""
    return F.array_distinct(F.filter(every_match(question, VERSION_PATTERN), lambda v: F.array_contains(known, v)))


def remove_named(question: Column, policy: Column, versions: Column, aliases: dict[str, list[str]]) -> Column:
    """The question without the policy's aliases and the versions; leftover spaces and marks are tidied."""
    text = question
    for name, some in aliases.items():
        pattern = "(?i)" + "|".join(rf"\b{re.escape(a)}\b" for a in sorted(some, key=len, reverse=True))
        text = F.when(policy == name, F.regexp_replace(text, pattern, "")).otherwise(text)
    escaped = F.transform(versions, lambda v: F.replace(v, F.lit("."), F.lit("\\.")))
    either = F.concat(F.lit(r"\b(?<![0-9]\.)(?:"), F.array_join(escaped, "|"), F.lit(r")\b(?!\.[0-9])"))
    text = F.when(F.size(versions) > 0, F.regexp_replace(text, either, F.lit(""))).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+([?.!,;:])", "$1"), r"^[\s?.!,;:]+", ""))


def extract_filters(questions: DataFrame, known: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """``qid, policy, versions, search_text`` of ``questions(qid, question)``; ``known`` is a catalog, a row for each policy."""
    every = known.agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("every"), F.map_from_entries(F.collect_list(F.struct("policy", "versions"))).alias("by_policy"))
    rows = questions.crossJoin(every).withColumn("policy", find_policy(F.col("question"), aliases, F.map_keys("by_policy")))  # every: one row
    own = F.when(F.col("policy").isNotNull(), F.element_at("by_policy", F.col("policy"))).otherwise(F.col("every"))
    rows = rows.withColumn("versions", find_versions(F.col("question"), own))
    return rows.select("qid", "policy", "versions", remove_named(F.col("question"), F.col("policy"), F.col("versions"), aliases).alias("search_text"))


def choose_route(lookup: Column, compare: Column, margin: float = ROUTE_MARGIN, floor: float = ROUTE_FLOOR) -> Column:
    """``compare`` only for a clear match that beats lookup by the margin."""
    return F.when(F.greatest(lookup, compare) < floor, "lookup").when(compare >= lookup + margin, "compare").otherwise("lookup")


def route_scores(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """``qid, best_lookup, best_compare, route`` by the nearest of ``examples(kind, vector)``, a short list: more than ``EXAMPLES`` are an error."""
    if examples.limit(EXAMPLES + 1).count() > EXAMPLES:
        raise ValueError(f"more than {EXAMPLES} route examples")
    met = questions.crossJoin(F.broadcast(examples.select("kind", F.col("vector").alias("example"))))
    similarity = cosine(F.col("vector"), F.col("example"))
    best = met.groupBy("qid").agg(*[F.round(F.max(F.when(F.col("kind") == kind, similarity)), 6).alias(f"best_{kind}") for kind in ("lookup", "compare")])
    return best.withColumn("route", choose_route(F.col("best_lookup"), F.col("best_compare")))


