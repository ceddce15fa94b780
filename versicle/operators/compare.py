"""Two versions of a policy side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versicle.functions.text import normalize_title
from versicle.functions.versions import in_order, version_key
from versicle.operators.lexical import ranked

SIDE = ["id", "text", "version", "heading_path", "section", "source"]


def catalog(chunks: DataFrame) -> DataFrame:
    """``policy, versions``: distinct versions in numeric order."""
    return chunks.select("policy", "version").distinct().groupBy("policy").agg(in_order(F.collect_list("version")).alias("versions"))


def lookup_targets(filters: DataFrame, known: DataFrame) -> DataFrame:
    """``qid, policy, version`` that a lookup may search, from ``filters(qid, policy, versions)`` and a catalog.

    A named policy with versions: the first one named, known or not; a policy alone: its latest; a
    version alone: every policy that has it; neither: the latest of each policy. The catalog
    has a row for each policy and is joined to every question, which is the result's own size.
    """
    first = F.get("f.versions", F.lit(0))
    joined = filters.alias("f").join(known.alias("k"), F.col("f.policy").isNull() | (F.col("f.policy") == F.col("k.policy")))
    fits = F.col("f.policy").isNotNull() | first.isNull() | F.array_contains("k.versions", first)
    return joined.where(fits).select("f.qid", F.col("k.policy").alias("policy"), F.coalesce(first, F.element_at("k.versions", -1)).alias("version"))


def in_targets(chunks: DataFrame, targets: DataFrame | None) -> DataFrame:
    """Chunks of the named (policy, version) pairs; no list at all means every chunk."""
    return chunks if targets is None else chunks.join(targets.select("policy", "version").distinct(), ["policy", "version"], "left_semi")


def renamed(title: Column, renames: dict[str, str]) -> Column:
    """An exact new title first, else that of the longest parent (``parent > ...``) that has one."""
    out = title
    for old in sorted(renames, key=lambda t: (len(t), t)):
        out = F.when(title.startswith(old + " > "), F.concat(F.lit(renames[old]), F.substring(title, F.lit(len(old) + 1), F.length(title)))).otherwise(out)
    for old, new in renames.items():
        out = F.when(title == old, F.lit(new)).otherwise(out)
    return out


def pair_by_title(old: DataFrame, new: DataFrame, renames: dict[str, str] | None = None, order: str = "id") -> DataFrame:
    """``policy, title, ordinal, heading_path, previous, current``: a full outer join on title and ordinal.

    Sections of the old version alone were removed, of the new one alone added. Two old sections
    under one title are an error; of two new ones the last by ``order`` wins. Renames are the old side's.
    """
    title = normalize_title(F.col("heading_path"))
    ordinal = F.coalesce("ordinal", F.lit(0))
    side = lambda name: F.struct(*[F.col(c) for c in SIDE]).alias(name)
    before = old.select("policy", renamed(title, renames or {}).alias("title"), ordinal.alias("ordinal"), side("previous"))
    count = before.groupBy("policy", "title", "ordinal").agg(F.count("*").alias("n"), F.first("previous").alias("previous"))
    twice = F.raise_error(F.concat(F.lit("two old sections map to "), "title"))
    before = count.withColumn("previous", F.when(F.col("n") > 1, twice.cast(count.schema["previous"].dataType)).otherwise(F.col("previous"))).drop("n")
    after = new.select("policy", title.alias("title"), ordinal.alias("ordinal"), F.col(order).alias("__order"), side("current"))
    after = after.groupBy("policy", "title", "ordinal").agg(F.max_by("current", "__order").alias("current"))
    joined = before.join(after, ["policy", "title", "ordinal"], "full_outer")
    return joined.select("policy", "title", "ordinal", F.coalesce("current.heading_path", "previous.heading_path").alias("heading_path"), "previous", "current")


def rank_pairs(pairs: DataFrame, hits: DataFrame, top_k: int = 20) -> DataFrame:
    """``qid, policy, title, ordinal, score, best_rank, rank``: each question's pairs of its policy by the better side's score and rank.

    ``pairs`` are those of ``pair_by_title``; ``hits`` have ``qid, policy, id, score, best_rank`` of both versions. Pairs without a hit
    come last, by title, at one rank more than both lists are long. Only pairs with hits, and as many of each
    policy's first by title as can be needed, meet questions.
    """
    sides = pairs.select("policy", "title", "ordinal", F.explode(F.array_distinct(F.array("previous.id", "current.id"))).alias("id")).where("id IS NOT NULL")
    sizes = hits.groupBy("qid", "policy").agg((F.count("*") + 1).cast("int").alias("absent"))
    met = hits.join(sides, ["policy", "id"]).groupBy("qid", "policy", "title", "ordinal").agg(F.max("score").alias("score"), F.min("best_rank").alias("best_rank"))
    most = sizes.agg(F.max("absent")).first()[0] or 0  # one number: no list is longer than the searches' own limits
    first = ranked(pairs.select("policy", "title", "ordinal"), ["policy"], [F.asc("title"), F.asc("ordinal")], top_k + most).drop("rank")
    keys = ["qid", "policy", "title", "ordinal"]
    rest = sizes.join(first, "policy").join(met.select(*keys), keys, "left_anti").select(*keys, F.lit(0.0).alias("score"), F.col("absent").alias("best_rank"))
    return ranked(met.unionByName(rest), ["qid", "policy"], [F.desc("score"), F.asc("best_rank"), F.asc("title"), F.asc("ordinal")], top_k)


def latest(chunks: DataFrame) -> DataFrame:
    """The chunks of each policy's latest version."""
    newest = chunks.groupBy("policy").agg(F.max_by("version", version_key(F.col("version"))).alias("version"))
    return chunks.join(newest, ["policy", "version"], "left_semi")
