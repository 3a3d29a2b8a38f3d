"""Files over time: drift between folders, hits whose source is still the same, windows for models, copies of state."""

from __future__ import annotations

import hashlib
import json
import shutil
import time
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import Column, DataFrame, functions as F

R = TypeVar("R")

#: Kinds of files whose extraction is worth keeping.
CACHEABLE = (".docx", ".pdf", ".pptx", ".xlsx")
# Answers of a service after which a write is tried again.
TRANSIENT = frozenset({408, 425, 429, 500, 502, 503, 504})


def cacheable(extension: Column) -> Column:
    return F.lower(extension).isin(*CACHEABLE)


def drift(template: DataFrame, target: DataFrame) -> DataFrame:
    """(path, state): same, differs or absent for each file of the template, extra for others of the target. Columns: path, digest."""
    a, b = template.select("path", F.lower("digest").alias("_a"), F.lit(True).alias("_t")), target.select("path", F.lower("digest").alias("_b"), F.lit(True).alias("_u"))
    state = F.when(F.col("_t").isNull(), "extra").when(F.col("_u").isNull(), "absent").when(F.col("_a") == F.col("_b"), "same").otherwise("differs")
    return a.join(b, "path", "full_outer").select("path", state.alias("state"))


def fresh(hits: DataFrame, manifest: DataFrame, scan: DataFrame) -> DataFrame:
    """Hits whose file still has the size, time and, where the scan has hashed it, hash that it was indexed with."""
    hashed = "revision" in scan.columns
    m = manifest.select("document_id", "size", "mtime_ns", F.lower("revision").alias("_r"))
    s = scan.select("document_id", "size", "mtime_ns", *([F.lower("revision").alias("_r")] if hashed else []))
    same = m.join(s, s.columns, "left_semi").select("document_id", "_r")
    return hits.withColumn("_r", F.lower("revision")).join(same, ["document_id", "_r"], "left_semi").drop("_r")


def model_windows(n: Column, longest: int = 512) -> Column:
    """array<struct<first,last>> of overlapping windows over n tokens: two places less than a model's limit, a quarter or 64 shared."""
    size = max(longest, 3) - 2
    step = size - min(64, size // 4)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))
    kept = F.filter(starts, lambda a: (a == 0) | (a + (size - step) < n))
    return F.when(n > 0, F.transform(kept, lambda a: F.struct(a.cast("int").alias("first"), F.least(a + size, n).cast("int").alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def same_dimension(points: DataFrame, dimension: int) -> DataFrame:
    """The points, or an error at the first vector of another length."""
    wrong = F.raise_error(F.lit("embedding_dimension_mismatch"))
    return points.withColumn("embedding", F.when(F.size("embedding") == dimension, F.col("embedding")).otherwise(wrong))


def retried(work: Callable[[], R], attempts: int = 4, pause: float = 0.5) -> R:
    """The result of a driver-side write, tried again after transient answers and time-outs with doubled pauses."""
    for i in range(attempts):
        try:
            return work()
        except Exception as e:
            if i == attempts - 1 or not (isinstance(e, (TimeoutError, ConnectionError)) or getattr(e, "status_code", None) in TRANSIENT):
                raise
            time.sleep(pause * 2**i)
    raise AssertionError


def backup(state_root: str, target: str) -> dict[str, str]:
    """A copy of every table's current version, with SHA-256 of each file; versions don't change, so no lock is needed."""
    sums: dict[str, str] = {}
    for pointer in sorted(Path(state_root).glob("*/CURRENT")):
        version = pointer.read_text(encoding="ascii").strip()
        for name in (pointer, *sorted((pointer.parent / version).rglob("*"))):
            if name.is_file():
                relative = name.relative_to(state_root)
                copy = Path(target) / relative
                copy.parent.mkdir(parents=True, exist_ok=True)
                shutil.copy2(name, copy)
                sums[str(relative)] = hashlib.sha256(copy.read_bytes()).hexdigest()
    Path(target).mkdir(parents=True, exist_ok=True)
    (Path(target) / "checksums.json").write_text(json.dumps(sums, sort_keys=True), encoding="utf-8")
    return sums
