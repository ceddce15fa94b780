"""Documents to sections to chunks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from versicle.functions.text import estimate_tokens, word_count
from versicle.functions.versions import normalize_version

TITLE_LINES, MAX_TOKENS, OVERLAP = 5, 256, 1
# How titles, file names and numbered headings are written.
_TITLE = r"^\s*(.+?\bPolicy)\s*[—–-]\s*Version\s+([0-9]+(?:\.[0-9]+)*)\s*$"
_FILE = r"^(?:.+? - )?(.+?)\s+v([0-9]+(?:\.[0-9]+)*)$"
_HEADING = r"^([0-9]+\.[0-9]+(?:\.[0-9]+)*)\s+(.*)$|^([0-9]+)\.\s+(.*)$"


def policy_and_version(lines: Column, stem: Column) -> tuple[Column, Column, Column]:
    """Policy, version and error: the title among the first lines wins over the file's name; their versions must agree."""
    top = F.slice(F.filter(lines, lambda x: F.trim(x) != ""), 1, TITLE_LINES)
    title = F.get(F.filter(top, lambda x: x.rlike(_TITLE)), F.lit(0))
    of = lambda text, pattern, group: F.nullif(F.trim(F.regexp_extract(text, pattern, group)), F.lit(""))
    named, old = of(title, _TITLE, 1), of(stem, _FILE, 1)
    version, file_version = normalize_version(of(title, _TITLE, 2)), normalize_version(of(stem, _FILE, 2))
    error = F.when(version != file_version, F.concat(F.lit("version mismatch: title says "), version, F.lit(", filename says "), file_version))
    error = error.when(F.coalesce(named, old).isNull(), "no policy name and version")
    return F.coalesce(named, old), F.when(named.isNotNull(), version).otherwise(file_version), error


def heading_blocks(lines: DataFrame) -> DataFrame:
    """``doc, block, level, heading, text`` from ``doc, pos, line``: numbered lines open blocks, others go on with them."""
    line = F.trim(F.regexp_replace("line", r"\s+", " "))
    rows = lines.withColumn("line", line).where("line <> ''").withColumn("opens", F.col("line").rlike(_HEADING))
    order = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("block", F.sum(F.col("opens").cast("int")).over(order)).where("block > 0")
    number = F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(.*)$", 1)
    rest = F.regexp_extract("line", r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(.*)$", 2)
    split = F.instr(rest, ". ")
    title = F.when(split > 0, F.substring(rest, F.lit(1), split - 1)).otherwise(rest)
    body = F.when(split > 0, F.substring(rest, split + 2, F.length(rest))).otherwise("")
    heading = F.concat(number, F.when(F.contains(number, F.lit(".")), " ").otherwise(". "), title)
    rows = rows.select("doc", "block", "pos", F.when(F.col("opens"), F.length(F.regexp_replace(number, r"[^.]", "")) + 1).alias("level"), F.when(F.col("opens"), heading).alias("heading"), F.when(F.col("opens"), body).otherwise(F.col("line")).alias("part"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    text = F.trim(F.array_join(F.filter(parts, lambda p: p != ""), " "))
    return rows.groupBy("doc", "block").agg(F.max("level").cast("int").alias("level"), F.max("heading").alias("heading"), text.alias("text"))


def section_chunks(blocks: DataFrame) -> DataFrame:
    """``doc, block, section, heading_path, parent, text``: level-1 sections, and all deeper blocks as their flat children.

    A section with children is a chunk only if it has text of its own; without, always. Blocks before
    the first section are dropped. ``parent`` is null for sections.
    """
    order = Window.partitionBy("doc").orderBy("block")
    rows = blocks.withColumn("section", F.last(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(order))
    rows = rows.withColumn("nth", F.sum((F.col("level") == 1).cast("int")).over(order)).where("section IS NOT NULL")
    rows = rows.withColumn("children", F.count_if(F.col("level") > 1).over(Window.partitionBy("doc", "nth")))
    rows = rows.where((F.col("level") > 1) | (F.col("children") == 0) | (F.trim("text") != ""))
    deeper = F.col("level") > 1
    path = F.when(deeper, F.concat_ws(" > ", "section", "heading")).otherwise(F.col("section"))
    return rows.select("doc", "block", "section", path.alias("heading_path"), F.when(deeper, F.col("section")).alias("parent"), "text")


def embed_text() -> Column:
    """What is embedded and searched of a chunk: its policy and version, its heading, its text."""
    return F.concat_ws("\n", F.concat_ws(" ", "policy", "version"), "heading_path", "text")


def identify(chunks: DataFrame) -> DataFrame:
    """``id, embed_text, text_sha256, embed_sha256, word_count`` for chunks with ``policy, version, heading_path, text, ordinal``."""
    natural = F.concat_ws("|", "policy", "version", "heading_path")
    rows = chunks.withColumns({"id": F.concat(natural, F.coalesce(F.concat(F.lit("#"), F.col("ordinal").cast("string")), F.lit(""))), "embed_text": embed_text()})
    return rows.withColumns({"text_sha256": F.sha2("text", 256), "embed_sha256": F.sha2("embed_text", 256), "word_count": word_count(F.col("text"))})


_TOKEN = re.compile(r"\d|[^\W\d_]+|[^\w\s]")


def split_text(text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most ``most`` tokens, filled sentence by sentence; each begins with the last ``overlap`` of the one before.

    A sentence over the limit is cut between words; a single longer word stays whole.
    """
    size = lambda s: len(_TOKEN.findall(s))
    small: list[tuple[str, int]] = []
    for sentence in (s.strip() for s in split_sentences(text)):
        if size(sentence) <= most:
            small.append((sentence, size(sentence)))
            continue
        run: list[str] = []
        total = 0
        for word in sentence.split():
            n = size(word)
            if run and total + n > most:
                small.append((" ".join(run), total))
                run, total = [], 0
            run.append(word)
            total += n
        small.append((" ".join(run), total))
    pieces: list[list[tuple[str, int]]] = [[]]
    for unit in small:
        if pieces[-1] and sum(n for _, n in pieces[-1]) + unit[1] > most:
            carried = pieces[-1][-overlap:] if overlap else []
            pieces.append(carried if sum(n for _, n in carried) + unit[1] <= most else [])
        pieces[-1] = [*pieces[-1], unit]
    return [" ".join(s for s, _ in piece) for piece in pieces if piece]


def split_sentences(text: str) -> list[str]:
    """Sentences as ``functions.text.sentences`` cuts them, in Python; abbreviations are matched in any case."""
    marks = [m for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z0-9\"“'‘])", text) if not re.search(r"(?i)(?:e\.g\.|i\.e\.|etc\.|vs\.|no\.)$", text[: m.start()][-5:])]
    bounds = [0, *[x for m in marks for x in m.span()], len(text)]
    return [s for s in (text[a:b].strip() for a, b in zip(bounds[::2], bounds[1::2], strict=True)) if s]


def split_long(chunks: DataFrame, text_col: str = "text", most: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """The chunks with ``text_col`` cut into pieces and ``ordinal`` from 1; one that fits keeps its text and a null ordinal."""

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, most, overlap))

    long = estimate_tokens(F.col(text_col)) > most
    rest = [c for c in chunks.columns if c not in (text_col, "ordinal")]
    short = chunks.where(~long | F.col(text_col).isNull()).select(*rest, text_col, F.lit(None).cast("int").alias("ordinal"))
    cut = chunks.where(long).select(*rest, F.posexplode(pieces(F.col(text_col))).alias("__pos", text_col))
    return short.unionByName(cut.select(*rest, text_col, (F.col("__pos") + 1).cast("int").alias("ordinal")))
