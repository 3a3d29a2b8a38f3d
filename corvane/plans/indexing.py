"""An incremental build of the index as one plan: inventory, difference, extraction, chunks, vectors, snapshots."""

from __future__ import annotations

import fcntl
import json
import os
import time
import uuid
from contextlib import contextmanager
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import storage
from ..functions.vectors import HashingEmbedder
from ..operators import chunks, files as kept, index
from ..sources import extract, inventory
from ..sources.settings import Settings

MANIFEST = "document_id string, source_path string, relative_path string, extension string, size long, mtime_ns long, revision string, status string, indexed_revision string, index_signature string, error_code string"
BUILDS = "build_id string, started_at timestamp, finished_at timestamp, status string, embedding_version string, config_version string, index_signature string, indexed_count long, failed_count long, chunk_count long"


#: Seconds after which a lock on storage without locks of its own is taken for that of a build that has died.
LOCKED = 6 * 3600


@contextmanager
def single_writer(spark: SparkSession, root: str) -> Iterator[None]:
    """One build at a time on a state folder; a second one fails at once."""
    here = storage.local(spark, root)
    if here is None:
        lock = f"{root}/build.lock"
        held = storage.read(spark, lock)
        if held and float(held) < time.time():
            storage.remove(spark, lock)
        if not storage.claim(spark, lock, str(time.time() + LOCKED)):
            raise RuntimeError("index_build_already_running")
        try:
            yield
        finally:
            storage.remove(spark, lock)
        return
    os.makedirs(here, exist_ok=True)
    with open(f"{here}/build.lock", "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            raise RuntimeError("index_build_already_running") from None
        yield


class Indexer:
    """Keeps tables manifest, documents, points and builds as snapshots under the state root.

    Vectors are written before the manifest that names them, so a failure between leaves documents that the next
    build does again; nothing is half visible.
    """

    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.embedder = HashingEmbedder(settings.embedding_dimension)
        self.manifest, self.documents, self.points, self.builds = (index.Snapshots(spark, f"{settings.state_root}/{t}") for t in ("manifest", "documents", "points", "builds"))

    def signature(self) -> str:
        s = self.settings
        return index.signature({
            "schema": 1, "extensions": sorted(s.extensions), "embedding": self.embedder.version, "chunk_chars": s.chunk_chars, "overlap_chars": s.overlap_chars,
            "min_chunk_chars": s.min_chunk_chars, "max_file_mb": s.max_file_mb, "max_extracted_chars": s.max_extracted_chars, "pdf_max_pages": s.pdf_max_pages, "access_group": s.access_group,
        })

    def _table(self, store: index.Snapshots, schema: str) -> DataFrame:
        df = store.read()
        return self.spark.createDataFrame([], schema) if df is None else df

    def run(self, max_files: int | None = None, prune_missing: bool = False) -> dict:
        """Counts of the build. Missing files are pruned only by a scan of everything."""
        with single_writer(self.spark, self.settings.state_root):
            return self._run(max_files, prune_missing and max_files is None)

    def _run(self, max_files: int | None, prune: bool) -> dict:
        s, spark, began = self.settings, self.spark, time.time()
        signature, build = self.signature(), uuid.uuid4().hex
        log = index.start_build(self._table(self.builds, BUILDS), build, F.current_timestamp(), self.embedder.version, "1")
        self.builds.write(log.withColumn("index_signature", F.when(F.col("build_id") == build, F.lit(signature)).otherwise(F.col("index_signature"))))
        manifest = self._table(self.manifest, MANIFEST)
        points = self.points.read()
        # a document whose vectors are incomplete is done again
        counted = points.where(F.col("index_signature") == signature).groupBy("document_id").agg(F.count("*").alias("_have"), F.max("chunk_total").alias("_want")) if points is not None else None
        files = inventory.scan(spark, s.source_root, s.extensions, max_files, s.max_file_mb << 20, content=True)
        files.select("document_id").count()  # lists the folder once before anything is written
        known = manifest if counted is None else manifest.join(counted, "document_id", "left").withColumn("status", F.when(F.col("_have") == F.col("_want"), F.col("status")).otherwise(F.when(F.col("status") == "indexed", F.lit("extracting")).otherwise(F.col("status")))).drop("_have", "_want")
        seen = files.select("document_id", "size", "mtime_ns", "revision")
        changes = index.difference(seen, known, F.lit(signature))
        todo = files.join(changes.where("change in ('new', 'changed')"), "document_id", "left_semi")
        texts = extract.extracted(todo, extract.Limits(s.max_extracted_chars, s.pdf_max_pages))
        staged = index.Snapshots(spark, f"{s.state_root}/staged")
        staged.write(texts)
        texts = staged.read()
        pieces = chunks.chunk(texts.where("error_code is null"), s.chunk_chars, s.overlap_chars, s.min_chunk_chars)
        total = pieces.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_total"))
        vectors = pieces.join(total, "document_id").select(
            "chunk_id", self.embedder.embed(F.col("text")).alias("embedding"), "document_id", "revision", "ordinal", "char_start", "char_end", "location_kind", "location_start", "location_end", "chunk_total",
            F.lit(s.access_group).alias("access_group"), F.lit(False).alias("goz"), F.lit(True).alias("is_final"), F.lit(build).alias("build_id"), F.lit(self.embedder.version).alias("embedding_version"), F.lit(signature).alias("index_signature"),
        )
        gone = index.missing(files, manifest).select("document_id") if prune else spark.createDataFrame([], "document_id string")
        replaced = texts.where("error_code is null").select("document_id").unionByName(gone)
        vectors = kept.same_dimension(vectors, self.embedder.dimension)
        kept.retried(lambda: self.points.write(vectors if points is None else index.replace_children(points, vectors, "document_id", replaced), 100_000))
        good = texts.where("error_code is null").select("document_id", "revision", "text", "page_count", "truncated", "locations")
        held = self.documents.read()
        self.documents.write(good if held is None else index.replace_children(held, good, "document_id", replaced))
        failed = F.col("error_code").isNotNull()
        rows = texts.select(
            "document_id", "source_path", "relative_path", "extension", "size", "mtime_ns", "revision", F.when(failed, "failed").otherwise("indexed").alias("status"),
            F.when(~failed, F.col("revision")).alias("indexed_revision"), F.when(~failed, F.lit(signature)).alias("index_signature"), "error_code",
        )
        new = index.upsert(manifest, rows, "document_id", "revision")
        if prune:
            new = index.upsert(new, index.missing(files, manifest).select(*new.columns), "document_id", "revision")
        self.manifest.write(new)
        counts = texts.agg(F.count(F.when(~failed, 1)).alias("indexed"), F.count(F.when(failed, 1)).alias("failed")).first()
        report = {"build_id": build, "indexed": counts["indexed"], "failed": counts["failed"], "chunks": self.points.read().where(F.col("build_id") == build).count()}
        report["skipped"] = changes.where("change = 'unchanged'").count() if points is not None else 0
        report["discovered"] = report["indexed"] + report["failed"] + report["skipped"]
        report["status"] = "complete" if not report["failed"] else "complete_with_errors" if report["indexed"] or report["skipped"] else "failed"
        report["files_per_second"] = round(report["discovered"] / max(time.time() - began, 1e-3), 2)
        self.builds.write(index.finish_build(self.builds.read(), build, F.current_timestamp(), report["indexed"], report["failed"], report["chunks"]))
        storage.replace(spark, f"{s.state_root}/report.json", json.dumps(report))
        return report
