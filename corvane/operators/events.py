"""Stage events: what may be kept of them, and their durations."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F

# The names of details that may be kept.
DETAILS = (
    "accepted_hits accepted_queries adjacent_radius attachment_extension attachment_provided automatic anchor_chunks candidate_count candidates chunks context_count "
    "context_chars contexts conversation_context_chars detected_spans documents_read documents document_limit embedding_candidates embedding_dimension error_type "
    "extracted_cache_bypassed extracted_cache_hits extracted_cache_misses extracted_cache_write_failures extracted_cache_writes extractions extension exact_search "
    "extracted_chars fields fallback_chunks index_hits iteration hnsw_ef marker_count ner_mode output_chars provider qdrant_mode query_normalized query_count question_chars "
    "selected expand_count size_bytes source_hashes span_cache_hits span_cache_misses top_k truncated retrieval_requested retrieval_context_chars retrieval_control_invalid "
    "whole_documents logical_parents"
).split()
STAGE = r"\A[a-z][a-z0-9_.]{0,79}\z"


def allowed(details: Column, names: list[str] = DETAILS) -> Column:
    return F.map_filter(details, lambda k, _: k.isin(*names))


def persisted(events: DataFrame, names: list[str] = DETAILS) -> DataFrame:
    """Events as they may be written: no label, only allowed details, odd stage names replaced."""
    stage = F.when(F.col("stage").rlike(STAGE), F.col("stage")).otherwise(F.lit("invalid_stage"))
    return events.drop("label").withColumns({"stage": stage, "details": allowed(F.col("details"), names)})


@contextmanager
def timed(callback: Callable[[dict], None] | None, stage: str, details: dict | None = None) -> Iterator[dict]:
    """Reports start and end of a stage to `callback`, whose own errors are swallowed."""
    held = dict(details or {})

    def tell(status: str, **more: object) -> None:
        if callback is not None:
            try:
                callback({"stage": stage, "status": status, "timestamp": datetime.now(timezone.utc), "details": dict(held), **more})
            except Exception:  # noqa: BLE001 - a listener must not stop the work
                pass

    began = time.perf_counter()
    tell("started")
    try:
        yield held
    except BaseException as e:
        held["error_type"] = type(e).__name__
        tell("failed", duration_ms=round((time.perf_counter() - began) * 1000))
        raise
    tell("completed", duration_ms=round((time.perf_counter() - began) * 1000))
