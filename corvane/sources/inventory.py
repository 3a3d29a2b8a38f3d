"""Inventory of a source folder, and paths that must stay inside it."""

from __future__ import annotations

from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import stable_document_id

EXTENSIONS = (".txt", ".md", ".csv", ".xml", ".htm", ".html", ".json", ".docx", ".xlsx", ".pptx", ".pdf")
#: Folders whose contents are never listed, whatever their case.
EXCLUDED = ("whdata", "whgdata", "whxdata")


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, max_files: int | None = None, max_bytes: int | None = None, content: bool = False) -> DataFrame:
    """One row for each supported file: document_id, source_path, relative_path, extension, size, mtime_ns, error_code.

    With `content`, also revision (SHA-256) and content; files larger than `max_bytes` have neither, their bytes
    are not read, and error_code is file_too_large. `max_files` keeps the first by small-letter path, after listing.
    Symbolic links aren't followed out of the root, and files that vanish while they're read are skipped.
    """
    base = Path(root).resolve().as_uri().rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(base)
    local = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"\Afile:/+", "/")
    prefix = str(Path(root).resolve()) + "/"
    relative = F.substring(local, F.lit(len(prefix) + 1), F.length(local))
    extension = F.lower(F.regexp_extract(relative, r"(\.[^./]+)\z", 1))
    skipped = F.exists(F.slice(F.split(F.lower(relative), "/"), 1, F.greatest(F.size(F.split(relative, "/")) - 1, F.lit(0))), lambda p: p.isin(*EXCLUDED))
    listed = files.withColumns({"source_path": local, "relative_path": relative, "extension": extension}).where(F.col("extension").isin(*extensions) & ~skipped)
    if max_files is not None:
        keep = listed.select("path", "relative_path").orderBy(F.lower("relative_path"), "relative_path").limit(max_files).select("path")
        listed = listed.join(keep, "path", "left_semi")
    too_large = F.col("length") > max_bytes if max_bytes is not None else F.lit(False)
    rows = listed.select(
        stable_document_id(F.col("relative_path")).alias("document_id"), "source_path", "relative_path", "extension", F.col("length").alias("size"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.when(too_large, "file_too_large").alias("error_code"), *([F.col("content")] if content else []),
    )
    if not content:
        return rows
    large, small = rows.where("error_code is not null").withColumn("content", F.lit(None).cast("binary")), rows.where("error_code is null")
    return small.unionByName(large).withColumn("revision", F.sha2("content", 256))


def inside(root: str, relative: str) -> Path:
    """The file of a relative path under the root as it is now; anything that leads elsewhere is an error."""
    path = PurePosixPath(relative.replace("\\", "/"))
    if not relative or path.is_absolute() or ".." in path.parts:
        raise ValueError("unsafe_source_path")
    base = Path(root).resolve()
    full = (base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError("unsafe_source_path")
    return full


def attachment(root: str, value: str, extensions: tuple[str, ...] = EXTENSIONS) -> Path:
    """A file that a user named, perhaps in quotes: regular, of a supported kind and under the root."""
    name = value.strip().strip("\"'").strip()
    base = Path(root).resolve()
    path = Path(name)
    full = (path if path.is_absolute() else base / path).resolve()
    if not full.is_relative_to(base):
        raise ValueError("attachment_outside_source_root")
    if not full.is_file():
        raise ValueError("attachment_not_found")
    if full.suffix.lower() not in extensions:
        raise ValueError("unsupported_extension")
    return full
