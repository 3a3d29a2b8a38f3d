"""State of the index: what a build must do, upserts into snapshots, counts and the build log."""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import storage
from .changes import latest


def upsert(current: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """`current` with the rows of `new` in place of those of the same key; `order` decides among new rows of one key."""
    new = latest(new, key, *order)
    return current.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new)


def replace_children(current: DataFrame, new: DataFrame, key: str, replaced: DataFrame | None = None) -> DataFrame:
    """All rows of the replaced keys (by default those of `new`) out, the rows of `new` in."""
    gone = (new if replaced is None else replaced).select(key).distinct()
    return current.join(gone, key, "left_anti").select(*new.columns).unionByName(new)


def delete(current: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return current.join(keys.select(key).distinct(), key, "left_anti")


def difference(scan: DataFrame, manifest: DataFrame, signature: Column) -> DataFrame:
    """(document_id, change): new, changed, unchanged or missing, one row for each document of either side.

    Both sides hold one row for each document. Unchanged: indexed with equal size, mtime_ns and revision, an
    indexed_revision equal to it and the signature; a null on either side counts as changed.
    """
    s = scan.select("document_id", F.col("size").alias("_s"), F.col("mtime_ns").alias("_m"), F.lower("revision").alias("_r"), F.lit(True).alias("_scan"))
    m = manifest.select("document_id", "status", "size", "mtime_ns", F.lower("revision").alias("revision"), F.lower("indexed_revision").alias("indexed_revision"), "index_signature", F.lit(True).alias("_known"))
    same = (F.col("status") == "indexed") & (F.col("_s") == F.col("size")) & (F.col("_m") == F.col("mtime_ns")) & (F.col("_r") == F.col("revision")) & (F.col("indexed_revision") == F.col("revision")) & (F.lower("index_signature") == F.lower(signature))
    change = F.when(F.col("_scan").isNull(), "missing").when(F.col("_known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return s.join(m, "document_id", "full_outer").select("document_id", change.alias("change"))


def missing(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of files that are gone and not yet deleted, as they are to be written."""
    gone = manifest.where("status <> 'deleted' or status is null").join(scan.select("document_id").distinct(), "document_id", "left_anti")
    return gone.withColumns({"status": F.lit("deleted"), "error_code": F.lit("source_missing")})


def indexed_chunks(chunks: DataFrame, manifest: DataFrame, signature: Column) -> DataFrame:
    """(n): chunks of documents that are indexed in their revision under the signature."""
    ready = manifest.where((F.col("status") == "indexed") & (F.lower("index_signature") == F.lower(signature))).select("document_id", F.lower("indexed_revision").alias("_r"))
    joined = chunks.select("document_id", F.lower("revision").alias("_r")).join(ready, ["document_id", "_r"])
    return joined.agg(F.count("*").alias("n"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count("*").alias("n"))


def latest_build(builds: DataFrame) -> DataFrame:
    """(build_id) of the complete build that finished last; no row if there is none."""
    done = builds.where(F.col("status").isin("complete", "complete_with_errors") & F.col("finished_at").isNotNull())
    return done.agg(F.max(F.struct("finished_at", "build_id")).alias("b")).where("b is not null").select(F.col("b.build_id").alias("build_id"))


def start_build(builds: DataFrame, build_id: str, started_at: Column, embedding_version: str, config_version: str) -> DataFrame:
    """The log with builds still running marked as interrupted and the new one running."""
    stale = F.when(F.col("status") == "running", F.lit("interrupted")).otherwise(F.col("status"))
    old = builds.withColumns({"finished_at": F.when(F.col("status") == "running", started_at).otherwise(F.col("finished_at")), "status": stale})
    values = {"build_id": F.lit(build_id), "started_at": started_at, "status": F.lit("running"), "embedding_version": F.lit(embedding_version), "config_version": F.lit(config_version)}
    row = builds.sparkSession.range(1).select(*[values.get(f.name, F.lit(0 if f.name.endswith("_count") else None)).cast(f.dataType).alias(f.name) for f in builds.schema])
    return old.unionByName(row)


def finish_build(builds: DataFrame, build_id: str, finished_at: Column, indexed: int, failed: int, chunks: int) -> DataFrame:
    status = "complete" if not failed else "complete_with_errors" if indexed else "failed"
    mine = F.col("build_id") == build_id
    new = {"finished_at": finished_at, "status": F.lit(status), "indexed_count": F.lit(indexed).cast("long"), "failed_count": F.lit(failed).cast("long"), "chunk_count": F.lit(chunks).cast("long")}
    return builds.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in new.items()})


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def signature(policy: dict) -> str:
    """SHA-256 of the policy's canonical JSON: changes with anything that changes what is indexed."""
    return sha256(canonical(policy).encode()).hexdigest()


class Snapshots:
    """A table kept as versions in folders, with a pointer to the current one.

    A new version is written whole before the pointer is replaced, so readers see the old or the new one, and a
    failed write leaves nothing behind but an unused folder. `path` is on storage that driver and executors share.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def current(self) -> str | None:
        version = storage.read(self.spark, f"{self.path}/CURRENT")
        return version.strip() if version else None

    def read(self) -> DataFrame | None:
        version = self.current()
        return None if version is None else self.spark.read.parquet(f"{self.path}/{version}")

    def write(self, df: DataFrame, records_per_file: int = 0) -> str:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", records_per_file) if records_per_file else df.write
        writer.parquet(f"{self.path}/{version}")
        storage.replace(self.spark, f"{self.path}/CURRENT", version)
        return version
