"""Document files to lines: DOCX, HTML and plain text here; PDF by a reader that is passed in."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("docx", "html", "htm", "txt", "pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs of a DOCX file, a line each."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in root.iter(f"{_W}p"))


def html_text(content: bytes) -> str:
    """The text of a page without scripts, styles and comments; block elements end lines."""
    text = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ", content.decode("utf-8", "replace"))
    text = re.sub(r"(?i)<(?:br|/p|/h[1-6]|/li|/div|/tr|/title)\b[^>]*>", "\n", text)
    return "\n".join(" ".join(line.split()) for line in html.unescape(re.sub(r"<[^>]*>", "", text)).split("\n"))


def extract(suffix: str, content: bytes, pdf: Callable[[bytes], str] | None = None) -> str:
    if suffix == "docx":
        return docx_text(content).strip()
    if suffix in ("html", "htm"):
        return html_text(content).strip()
    if suffix == "txt":
        return content.decode("utf-8", "replace").strip()
    if suffix == "pdf" and pdf is not None:
        return pdf(content).strip()
    raise ValueError(f"unsupported suffix: {suffix}")


def list_files(spark: SparkSession, directory: str) -> DataFrame:
    """``name, suffix, sha256, content`` of the supported files directly in ``directory``; none is an error."""
    files = spark.read.format("binaryFile").load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    found = files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("name"), suffix.alias("suffix"), F.sha2("content", 256).alias("sha256"), "content").where(F.col("suffix").isin(*SUFFIXES))
    if found.select("name").isEmpty():
        raise FileNotFoundError(f"no supported file in {directory}")
    return found


def read_lines(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """``name, lines, error``: a file that can't be read, or is empty, has an error instead of lines."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, suffix, content in zip(batch["name"], batch["suffix"], batch["content"], strict=True):
                try:
                    text = extract(suffix, bytes(content), pdf)
                    rows.append((name, text.splitlines() if text else None, None if text else "empty extract"))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as error:
                    rows.append((name, None, str(error)))
            yield pd.DataFrame(rows, columns=["name", "lines", "error"])

    return files.select("name", "suffix", "content").mapInPandas(read, "name string, lines array<string>, error string")
