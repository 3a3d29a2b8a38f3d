"""Vector search with policy, and what follows it: checks against the manifest, caps, neighbours and sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.vectors import cosine

#: Bytes of query vectors up to which queries are sent to every task; beyond it each block of queries is one scan.
QUERY_BYTES = 16_000_000


@dataclass(frozen=True)
class Policy:
    """Who may see what. A blank group is an error, so that nothing is searched without one."""

    access_group: str
    goz: bool = False
    is_final: bool = True

    def __post_init__(self) -> None:
        if not self.access_group.strip():
            raise ValueError("access_group_required")

    def condition(self, embedding_version: str | None = None, index_signature: str | None = None) -> Column:
        out = (F.col("access_group") == self.access_group) & (F.col("goz") == self.goz) & (F.col("is_final") == self.is_final)
        for name, value in (("embedding_version", embedding_version), ("index_signature", index_signature)):
            if value is not None:
                out = out & (F.col(name) == value)
        return out


def top_k(points: DataFrame, queries: DataFrame, k: int, condition: Column | None = None, least: float | None = None, key: str = "chunk_id", query: str = "request_id") -> DataFrame:
    """The `k` most similar points of each query with score and rank; ties go to the smaller key.

    Exact: every point that meets the condition is compared with the stated queries. The condition stands below the
    comparison, so it reaches the scan. `queries` are few and stated; their size is checked, and more than
    QUERY_BYTES of them are worked off in blocks. Each task keeps `k` rows a query before anything is shuffled.
    """
    queries = queries.select(F.col(query).alias("_q"), F.col("embedding").alias("_e"))
    if condition is not None:
        points = points.where(condition)
    rows, width = queries.agg(F.count("*"), F.max(F.size("_e"))).first()
    blocks = max(1, -(-rows * (width or 0) * 8 // QUERY_BYTES))
    parts = []
    for i in range(blocks):
        some = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("_q"), F.lit(blocks)) == i)
        scored = points.join(F.broadcast(some)).withColumn("score", cosine(F.col("embedding"), F.col("_e")))  # a stated query block
        if least is not None:
            scored = scored.where(F.col("score") >= least)
        ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("_q").orderBy(F.desc("score"), key))).where(F.col("rank") <= k)
        parts.append(ranked.drop("_e", "embedding").withColumnRenamed("_q", query))
    return reduce(DataFrame.unionByName, parts)


def validated(hits: DataFrame, manifest: DataFrame, embedding_version: str | None = None, index_signature: str | None = None) -> DataFrame:
    """Hits of documents that are still indexed in the hit's revision; the rest is dropped without replacement."""
    m = manifest.where("status = 'indexed' and lower(revision) = lower(indexed_revision)").select("document_id", F.lower("revision").alias("_r"), "relative_path")
    good = hits.join(m, (hits["document_id"] == m["document_id"]) & (F.lower(hits["revision"]) == m["_r"])).drop(m["document_id"]).drop("_r")
    for name, value in (("embedding_version", embedding_version), ("index_signature", index_signature)):
        if value is not None:
            good = good.where(F.col(name) == value)
    return good


def sane(hits: DataFrame, length: Column) -> DataFrame:
    return hits.where((F.col("char_start") >= 0) & (F.col("char_start") < F.col("char_end")) & (F.col("char_end") <= length))


def cap_documents(hits: DataFrame, most: int, request: str = "request_id") -> DataFrame:
    """Hits of the first `most` distinct documents of each request, by rank."""
    first = F.min("rank").over(W.partitionBy(request, "document_id"))
    place = F.dense_rank().over(W.partitionBy(request).orderBy("_first", "document_id"))
    return hits.withColumn("_first", first).withColumn("_place", place).where(F.col("_place") <= most).drop("_first", "_place")


def neighbours(hits: DataFrame, chunks: DataFrame, radius: int, request: str = "request_id") -> DataFrame:
    """Chunks at most `radius` places from a hit in its document and revision, without the hits themselves.

    Each chunk comes once, with the score of its best-ranked hit. None for a radius of 0 or less.
    """
    h = hits.select(request, "rank", "score", "document_id", "revision", F.explode(F.sequence(F.col("ordinal") - max(radius, 0), F.col("ordinal") + max(radius, 0))).alias("_o"), F.col("ordinal").alias("_own"))
    # the radius is small, so each hit meets its neighbours by an equality of places
    c = chunks.withColumnRenamed("ordinal", "_o")
    near = h.where(F.col("_o") != F.col("_own")).join(c, ["document_id", "revision", "_o"]).drop("_own").withColumnRenamed("_o", "ordinal")
    near = near.join(hits.select(request, "chunk_id"), [request, "chunk_id"], "left_anti")
    return first_of(near, [request, "chunk_id"], "rank")


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key by `order`."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    picked = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def merged(hits: list[DataFrame], most: int | None = None, request: str = "request_id") -> DataFrame:
    """Hits of several searches in order, each chunk once, the first `most`; `place` is the new order."""
    every = reduce(DataFrame.unionByName, [h.withColumn("_s", F.lit(i)) for i, h in enumerate(hits)])
    once = first_of(every, [request, "chunk_id"], "_s", "rank")
    placed = once.withColumn("place", F.row_number().over(W.partitionBy(request).orderBy("_s", "rank", "chunk_id"))).drop("_s")
    return placed if most is None else placed.where(F.col("place") <= most)


def similar_rewrites(pairs: DataFrame, least: float) -> DataFrame:
    """Rewritten queries close enough to their originals (columns original and rewritten hold vectors)."""
    return pairs.withColumn("similarity", cosine(F.col("original"), F.col("rewritten"))).where(F.col("similarity") >= least)


def cited(hits: DataFrame, citations: DataFrame, request: str = "request_id") -> DataFrame:
    """Hits that citations such as R002 name, unless they are whole documents already."""
    wanted = citations.select(request, F.regexp_extract("citation_ref", r"\AR(\d{3})\z", 1).try_cast("int").alias("place")).distinct()
    return hits.join(wanted, [request, "place"]).where("context_scope <> 'whole_document' or context_scope is null")


def sources(hits: DataFrame, request: str = "request_id") -> DataFrame:
    """One row for each document of a request: its citations in order, its locations and its best score."""
    ref = F.format_string("R%03d", "place")
    where = F.when(F.col("location_kind") != "", F.struct(F.col("place"), ref.alias("citation_ref"), F.col("location_kind").alias("kind"), F.col("location_start").alias("start"), F.col("location_end").alias("end")))
    grouped = hits.groupBy(request, "document_id", "relative_path").agg(
        F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", ref.alias("r")))).alias("_refs"), F.max("score").alias("best_score"), F.array_sort(F.collect_list(where)).alias("_where")
    )
    return grouped.select(
        request, "document_id", F.col("relative_path").alias("path"), F.row_number().over(W.partitionBy(request).orderBy("first")).alias("ordinal"),
        F.transform("_refs", lambda x: x["r"]).alias("citation_refs"), "best_score", F.transform("_where", lambda x: x.dropFields("place")).alias("locations"),
    )


def build_ids(hits: DataFrame, request: str = "request_id") -> DataFrame:
    return hits.groupBy(request).agg(F.array_join(F.array_sort(F.collect_set("build_id")), ",").alias("build_ids"))


def provider_context(hits: DataFrame, request: str = "request_id") -> DataFrame:
    """What leaves the boundary: no file names and no paths."""
    kind = F.lower(F.regexp_replace("source_type", r"\A\.", ""))
    return hits.select(
        request, "document_id", "chunk_id", F.format_string("R%03d", "place").alias("citation_ref"), "score", F.when(kind.rlike(r"\A[a-z0-9]{1,12}\z"), kind).otherwise(F.lit("unknown")).alias("file_type"), "context_scope", "text"
    )
