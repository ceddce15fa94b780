"""The index as Parquet folders behind a pointer: diffs, upserts, integrity, and the atomic switch."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of an index, by a hash of the source: what an ingest writes anew is the parts of changed files.
PARTS = 64


def _part(source: str) -> Column:
    return F.pmod(F.xxhash64(source), F.lit(PARTS)).cast("int")


def diff_files(found: DataFrame, recorded: DataFrame) -> DataFrame:
    """``name, action`` (skip, add, replace, delete) from two tables ``name, sha256``."""
    joined = found.select("name", F.col("sha256").alias("new")).join(recorded.select("name", F.col("sha256").alias("old")), "name", "full_outer")
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").isNull(), "add").when(F.col("old") == F.col("new"), "skip").otherwise("replace")
    return joined.select("name", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their keys."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def reuse_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each chunk with the vector of its content hash; null where it has yet to be embedded."""
    return chunks.join(vectors.select("embed_sha256", "vector").dropDuplicates(["embed_sha256"]), "embed_sha256", "left")


def to_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The distinct texts that no vector is known for: equal ones are embedded once."""
    return chunks.join(vectors.select("embed_sha256"), "embed_sha256", "left_anti").groupBy("embed_sha256").agg(F.min("embed_text").alias("embed_text"))


def integrity(stored: DataFrame, files: DataFrame) -> DataFrame:
    """One row ``n_stored, empty_files, repeated_ids, missing_ids, extra_ids, ok``; ``files`` has ``name, chunk_ids``."""
    expected = files.select(F.explode("chunk_ids").alias("id"))
    ids = stored.groupBy("id").agg(F.count("*").alias("s")).join(expected.groupBy("id").agg(F.count("*").alias("e")), "id", "full_outer")
    counts = ids.agg(
        F.coalesce(F.sum("s"), F.lit(0)).alias("n_stored"),
        F.count_if((F.col("s") > 1) | (F.col("e") > 1)).alias("repeated_ids"),
        F.count_if(F.col("s").isNull()).alias("missing_ids"),
        F.count_if(F.col("e").isNull()).alias("extra_ids"),
    )
    empty = files.agg(F.count_if(F.size("chunk_ids") <= 0).alias("empty_files"))
    sound = (F.col("n_stored") > 0) & (F.col("empty_files") + F.col("repeated_ids") + F.col("missing_ids") + F.col("extra_ids") == 0)
    return counts.crossJoin(empty).withColumn("ok", sound)  # one row each


def ids_for_source(rows: DataFrame, source: str) -> DataFrame:
    """``id`` of the chunks of one source."""
    return rows.where(F.col("source") == source).select("id")


def all_ids(rows: DataFrame) -> DataFrame:
    return rows.select("id")


def chunks_to_json(chunks: DataFrame, path: str) -> None:
    """The chunks as JSON records, a line each, wherever Spark writes."""
    chunks.write.mode("overwrite").json(path)


def build_id(params: dict) -> str:
    """Twelve hex digits of the canonical JSON of what an index depends on."""
    return hashlib.sha256(json.dumps(params, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


def empty_manifest() -> dict:
    return {"active": None, "builds": {}, "parts": {}}


def staging_name(build: str, now: datetime | None = None) -> str:
    """A new folder for each build, so that the active one is never written to: the stamp has microseconds."""
    return f"build-{build}-{now or datetime.now(UTC):%Y%m%dT%H%M%S%f}"


class IndexMissing(RuntimeError):
    """There is no active index, or it is empty."""


class RebuildFailed(RuntimeError):
    """The staged build is not sound; the active one is untouched."""


@dataclass
class IngestReport:
    """``actions(name, action)`` of every file, a table as long as the listing, and the counts of its actions and of vectors."""

    actions: DataFrame
    counts: dict[str, int]
    embedded: int = 0
    reused: int = 0

    def names(self, action: str) -> DataFrame:
        return self.actions.where(F.col("action") == action).select("name")


class IndexStore:
    """An index under ``root``: folders of chunks and of files, in ``PARTS`` parts by source, and ``manifest.json``.

    The manifest names the folder of each part, so it has the same size for any index, and an ingest writes the parts
    of changed files only. Content is written first and the manifest last, by a rename, so that a run that dies leaves
    the old index active.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop("/".join([self.root, *parts]))

    def manifest(self) -> dict:
        path = self._path("manifest.json")
        if not self._fs.exists(path):
            return empty_manifest()
        text = "\n".join(r.value for r in self.spark.read.text(path.toString(), wholetext=True).collect())
        return json.loads(text)

    def save(self, manifest: dict) -> None:
        """Written beside the old one, then renamed over it."""
        self._fs.mkdirs(self._path())
        beside = self._path(f"manifest.json.{datetime.now(UTC):%Y%m%dT%H%M%S%f}")
        out = self._fs.create(beside, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=2).encode()))
        out.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(beside, self._path("manifest.json"), options)

    def create(self) -> None:
        """An empty index; one that exists is an error."""
        if self._fs.exists(self._path("manifest.json")):
            raise FileExistsError(self.root)
        self.save(empty_manifest())

    def drop(self) -> None:
        """The whole index goes; none is no error."""
        self._fs.delete(self._path(), True)

    def _read(self, folders: list[str], kind: str) -> DataFrame | None:
        """The given folders' tables of ``chunks`` or ``files``, those that have rows."""
        paths = [p for p in (self._path(f, kind) for f in sorted(folders)) if self._fs.exists(p)]
        return self.spark.read.parquet(*[p.toString() for p in paths]) if paths else None

    def active(self) -> DataFrame:
        """The chunks of the active index."""
        manifest = self.manifest()
        rows = self._read([f"{name}/part={part}" for part, name in manifest["parts"].items()], "chunks") if manifest["active"] else None
        if rows is None:
            raise IndexMissing("no active index; ingest first")
        if rows.isEmpty():
            raise IndexMissing("the active index is empty; ingest again")
        return rows

    def files(self) -> DataFrame:
        """``name, sha256, chunk_ids`` of the active index."""
        found = self._read([f"{name}/part={part}" for part, name in self.manifest()["parts"].items()], "files")
        return self.spark.createDataFrame([], "name string, sha256 string, chunk_ids array<string>") if found is None else found.select("name", "sha256", "chunk_ids")

    def publish(self, chunks: DataFrame, files: DataFrame, params: dict, parts: list[int] | None = None) -> str:
        """Stage a build of ``parts`` (all: a new index), check it, switch to it, and only then drop what no part needs.

        ``chunks`` has ``id`` and ``source``, the name of its file; ``files`` has ``name, sha256, chunk_ids``.
        """
        build, fresh = build_id(params), parts is None
        name, parts = staging_name(build), list(range(PARTS)) if parts is None else parts
        for kind, rows, key in (("chunks", chunks, "source"), ("files", files, "name")):
            staged = f"{self.root}/{name}/{kind}"
            rows.withColumn("part", _part(key)).repartition("part").write.mode("errorifexists").partitionBy("part").parquet(staged)
            for part in parts:  # from kind/part=n to part=n/kind
                if self._fs.exists(self._path(name, kind, f"part={part}")):
                    self._fs.mkdirs(self._path(name, f"part={part}"))
                    self._fs.rename(self._path(name, kind, f"part={part}"), self._path(name, f"part={part}", kind))
            self._fs.delete(self._path(name, kind), True)
        folders = [f"{name}/part={part}" for part in parts]
        stored, listed = self._read(folders, "chunks"), self._read(folders, "files")
        stored = chunks.limit(0) if stored is None else stored
        report = integrity(stored, files.limit(0) if listed is None else listed).first()
        # An index may not be empty; a part may, where its files have gone.
        sound = report.ok or (not fresh and not report.n_stored and not report.missing_ids and not report.empty_files)
        if not sound:
            self._fs.delete(self._path(name), True)
            raise RebuildFailed(f"staged index is not sound: {report.asDict()}")
        manifest = self.manifest()
        manifest["builds"][build] = params
        manifest["parts"] = {**({} if fresh else manifest["parts"]), **{str(part): name for part in parts}}
        manifest["active"] = name
        self.save(manifest)
        self.drop_others()
        return name

    def drop_others(self) -> list[str]:
        """The folders of builds that no part of the active index is in are deleted."""
        held = set(self.manifest()["parts"].values())
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path()) if s.getPath().getName().startswith("build-"))
        gone = [n for n in names if n not in held]
        for name in gone:
            self._fs.delete(self._path(name), True)
        return gone

    def ingest(self, listing: DataFrame, chunk: Callable[[DataFrame], DataFrame], params: dict, embed: Callable[[Column], Column] | None = None, rebuild: bool = False) -> IngestReport:
        """Bring the index to ``listing(name, sha256, ...)``; ``chunk`` turns rows of it into chunks with ``id`` and ``source``.

        Files whose hash is recorded are left alone, unless the build id differs. With ``embed``, new chunks get a
        ``vector``: that of an equal text of the index where it has one, else a new one for each distinct text.
        """
        manifest = self.manifest()
        fresh = rebuild or manifest["active"] is None or build_id(params) not in manifest["builds"]
        recorded = self.files()
        actions = diff_files(listing, recorded.limit(0) if fresh else recorded)
        counted = {r.action: r.n for r in actions.groupBy("action").agg(F.count("*").alias("n")).collect()}  # four at most
        report = IngestReport(actions, {a: counted.get(a, 0) for a in ("skip", "add", "replace", "delete")})
        if not any(report.counts[a] for a in ("add", "replace", "delete")):
            return report
        touched = actions.where("action <> 'skip'").select("name")
        parts = None if fresh else sorted(r.part for r in touched.select(_part("name").alias("part")).distinct().collect())  # PARTS at most
        read = new = chunk(listing.join(actions.where("action IN ('add', 'replace')").select("name"), "name", "left_semi")).persist()
        if embed is not None:
            new, report.embedded, report.reused = self._with_vectors(new, embed, manifest)
        if not fresh:
            held = self.active().where(_part("source").isin(parts))
            new = held.join(touched.withColumnRenamed("name", "source"), "source", "left_anti").unionByName(new, allowMissingColumns=True)
        names = listing.select("name", "sha256") if fresh else listing.select("name", "sha256").where(_part("name").isin(parts))
        files = names.join(new.groupBy(F.col("source").alias("name")).agg(F.collect_list("id").alias("chunk_ids")), "name", "left")
        self.publish(new, files.select("name", "sha256", F.coalesce("chunk_ids", F.array().cast("array<string>")).alias("chunk_ids")), params, parts)
        read.unpersist()
        return report

    def _with_vectors(self, new: DataFrame, embed: Callable[[Column], Column], manifest: dict) -> tuple[DataFrame, int, int]:
        """The chunks with their vectors, and how many were embedded and reused."""
        none = self.spark.createDataFrame([], "embed_sha256 string, vector array<float>")
        known = self.active() if manifest["active"] else none
        known = (known if "vector" in known.columns else none).select("embed_sha256", "vector")
        fresh = to_embed(new, known)
        vectors = known.unionByName(fresh.select("embed_sha256", embed(F.col("embed_text")).alias("vector")))
        need = new.join(known.select("embed_sha256").distinct(), "embed_sha256", "left_anti").count()
        return reuse_vectors(new, vectors), need, new.count() - need
