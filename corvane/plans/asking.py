"""Questions over the index: search, contexts, masking, provider, restoring. Many requests run in one plan."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
import re
import time
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import rules, text as T
from ..operators import chunks, context, control, files, search, spans
from ..operators.index import canonical
from ..sources import extract, inventory
from ..sources.settings import Settings
from .indexing import Indexer

Provider = Callable[[dict], str]


def stub_provider(payload: dict) -> str:
    """Repeats the question and the beginning of each context."""
    lines = [payload["question"], *(f"{c['citation_ref']}: {c['text'][:500]}" for c in payload["contexts"])]
    return "\n\n".join(lines)


class Retriever:
    """Search over the current snapshots, for any number of requests at once."""

    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings, self.indexer = spark, settings, Indexer(spark, settings)

    def search(self, requests: DataFrame, top_k: int | None = None) -> DataFrame:
        """Hits of requests (request_id, question) with text, checked against manifest and documents.

        Blank questions have no hits. Documents beyond the cap and hits outside a text are dropped, not replaced.
        """
        s, ix = self.settings, self.indexer
        asked = requests.select("request_id", T.normalize_query(F.col("question")).alias("q")).where("q <> ''").select("request_id", ix.embedder.embed(F.col("q")).alias("embedding"))
        condition = search.Policy(s.access_group).condition(ix.embedder.version, ix.signature())
        hits = search.top_k(ix.points.read(), asked, top_k or s.top_k, condition, s.score_threshold)
        return self._with_text(self._fresh(search.validated(hits, ix.manifest.read())))

    def _fresh(self, hits: DataFrame) -> DataFrame:
        """Hits whose files are as they were when they were indexed, by a listing of the source folder; none is read."""
        s = self.settings
        return files.fresh(hits, self.indexer.manifest.read(), inventory.scan(self.spark, s.source_root, s.extensions))

    def _with_text(self, hits: DataFrame) -> DataFrame:
        d = self.indexer.documents.read().select("document_id", F.col("revision").alias("_r"), F.col("text").alias("_t"))
        joined = hits.join(d, (hits["document_id"] == d["document_id"]) & (hits["revision"] == d["_r"])).drop(d["document_id"]).drop("_r")
        capped = search.cap_documents(joined, self.settings.max_source_documents)
        good = search.sane(capped, F.length("_t"))
        source = F.regexp_extract("relative_path", r"\.(\w+)\z", 1)
        return good.withColumns({"text": T.slice_text(F.col("_t"), F.col("char_start"), F.col("char_end")), "source_type": source, "context_scope": F.lit("retrieved_chunk")}).drop("_t")

    def around(self, hits: DataFrame, radius: int | None = None) -> DataFrame:
        """Neighbouring chunks of hits in the current index, with the hit's score."""
        near = search.neighbours(hits.select("request_id", "rank", "score", "document_id", "revision", "ordinal", "chunk_id"), self.indexer.points.read().where(F.col("index_signature") == self.indexer.signature()).drop("embedding"), self.settings.adjacent_radius if radius is None else radius)
        return self._with_text(self._fresh(search.validated(near, self.indexer.manifest.read())))

    def attachment(self, question: str, name: str, request_id: str, top_k: int | None = None) -> DataFrame:
        """Hits inside one file that the user named, which needn't be in the index."""
        s, ix = self.settings, self.indexer
        path = inventory.attachment(s.source_root, name, s.extensions)
        text, _, truncated, where, error = extract.extract(path.read_bytes(), path.suffix.lower(), extract.Limits(s.max_extracted_chars, s.pdf_max_pages))
        if error:
            raise ValueError(error)
        row = [("attachment", "attachment", text, where)]
        d = self.spark.createDataFrame(row, f"document_id string, revision string, text string, locations {extract.LOCATIONS}")
        points = chunks.chunk(d, s.chunk_chars, s.overlap_chars, s.min_chunk_chars).withColumn("embedding", ix.embedder.embed(F.col("text")))
        asked = self.spark.createDataFrame([(request_id, question)], "request_id string, q string").select("request_id", ix.embedder.embed(F.col("q")).alias("embedding"))
        return search.top_k(points, asked, top_k or s.top_k).withColumns({"relative_path": F.lit(path.name), "build_id": F.lit("direct-attachment"), "source_type": F.lit(path.suffix[1:].lower()), "context_scope": F.lit("retrieved_chunk")})


def masked_requests(questions: DataFrame, contexts: DataFrame, detectors: list[Callable] | None = None, markers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fields, markers): every field of every request with its sensitive values as markers.

    `questions`: request_id, text (field 0); `contexts`: request_id, place, text. A value found in one field is marked
    in all fields of its request. Markers are numbered by first occurrence, question first; given `markers` go on.
    The frames are lazy; each request's values stay within its rows.
    """
    detectors = detectors or [rules.detect]
    fields = questions.select("request_id", F.lit(0).alias("field"), "text").unionByName(contexts.select("request_id", F.col("place").alias("field"), "text"))
    found = fields.withColumn("spans", F.concat(*[d(F.col("text")) for d in detectors]))
    exploded = found.select("request_id", "field", "text", F.explode("spans").alias("s"))
    known = exploded.where("s.label <> 'RAW_MARKER'").select("request_id", T.slice_text(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"), F.col("s.label").alias("label"), F.col("s.priority").alias("priority"))
    more = spans.propagate_known(fields, known)
    every = exploded.select("request_id", "field", F.col("s").alias("s")).unionByName(
        more.select("request_id", "field", F.struct("start", "end", "label", F.lit(1.0).alias("score"), F.lit("known").alias("source"), "priority", F.lit(2_000_000_000).alias("seq")).cast(rules.SPAN).alias("s"))
    )
    merged = every.groupBy("request_id", "field").agg(spans.merge(F.collect_list("s")).alias("spans"))
    values = fields.join(merged, ["request_id", "field"]).select("request_id", "field", "text", F.explode("spans").alias("s")).select("request_id", "field", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.label").alias("label"), T.slice_text(F.col("text"), F.col("s.start"), F.col("s.end")).alias("value"))
    minted = spans.mint(values, markers)
    from ..functions import names

    keyed = values.select("request_id", "field", "start", "end", T.safe_label(F.col("label")).alias("label"), names.identity(F.col("label"), F.col("value")).alias("identity"))
    placed = keyed.join(minted.select("request_id", "label", "identity", "marker"), ["request_id", "label", "identity"]).groupBy("request_id", "field").agg(F.array_sort(F.collect_list(F.struct("start", "end", "marker"))).alias("m"))
    none = F.array().cast("array<struct<start:int,end:int,marker:string>>")
    states = minted.groupBy("request_id").agg(F.collect_list(F.struct("marker", "aliases")).alias("state"))
    masked = fields.join(placed, ["request_id", "field"], "left").withColumn("masked", spans.masked(F.col("text"), F.coalesce("m", none))).join(states, "request_id", "left")
    clean = masked.select("request_id", "field", F.coalesce(spans.propagated(F.col("masked"), F.col("state")), F.col("masked")).alias("masked"))
    return clean, minted


class Vault:
    """Artifacts of a request in a folder: what was sent, the markers with check sums, the answer and its state."""

    def __init__(self, root: str) -> None:
        self.root = Path(root)

    def _write(self, request: str, name: str, value: object) -> str:
        folder = self.root / request
        folder.mkdir(parents=True, exist_ok=True)
        data = (value if isinstance(value, str) else canonical(value)).encode()
        staged = folder / f".{name}.{uuid.uuid4().hex}"
        staged.write_bytes(data)
        os.replace(staged, folder / name)
        return hashlib.sha256(data).hexdigest()

    def create(self, request: str, payload: dict, markers: list[dict], sources: list[dict], versions: dict) -> None:
        sums = {"payload.json": self._write(request, "payload.json", payload), "markers.json": self._write(request, "markers.json", markers), "sources.json": self._write(request, "sources.json", sources)}
        self._write(request, "manifest.json", {"request_id": request, "status": "prepared", "versions": versions, "sha256": sums})

    def manifest(self, request: str) -> dict:
        return json.loads((self.root / request / "manifest.json").read_text(encoding="utf-8"))

    def update(self, request: str, payload: dict, markers: list[dict], sources: list[dict]) -> None:
        """Only a prepared request takes new contexts."""
        m = self.manifest(request)
        if m["status"] != "prepared":
            raise ValueError("request_not_prepared")
        self.create(request, payload, markers, sources, m["versions"])

    def markers(self, request: str) -> dict[str, str]:
        """Marker to value; a changed file is an error."""
        sums = self.manifest(request)["sha256"]
        for name, expected in sums.items():
            if hashlib.sha256((self.root / request / name).read_bytes()).hexdigest() != expected:
                raise ValueError("vault_integrity_failed")
        return {m["marker"]: m["display_value"] for m in json.loads((self.root / request / "markers.json").read_text(encoding="utf-8"))}

    def stage(self, request: str, answer: str) -> None:
        """Keeps an answer after checking that all its markers are the request's own."""
        restore(answer, self.markers(request))
        m = self.manifest(request)
        m["answer_sha256"], m["status"] = self._write(request, "answer.txt", answer), "response_received"
        self._write(request, "manifest.json", m)

    def restored(self, request: str) -> str:
        m = self.manifest(request)
        data = (self.root / request / "answer.txt").read_bytes()
        if hashlib.sha256(data).hexdigest() != m.get("answer_sha256"):
            raise ValueError("staged_response_integrity_failed")
        text = restore(data.decode(), self.markers(request))
        m["status"] = "restored"
        self._write(request, "manifest.json", m)
        return text


def restore(text: str, known: dict[str, str]) -> str:
    for m in re.findall(spans.MARKER_LIKE, text):
        if m not in known:
            raise ValueError("unknown_marker")
    return re.sub(spans.MARKER, lambda m: known[m[0]], text)


class Pipeline:
    """A question answered: search, contexts, masking, provider rounds, restoring."""

    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.settings = spark, settings
        self.retriever, self.vault = Retriever(spark, settings), Vault(f"{settings.state_root}/requests")

    def run(self, question: str, provider: Provider | None = stub_provider, top_k: int | None = None, attachment: str | None = None, retrieval_context: str = "", conversation_context: str = "") -> dict:
        """answer (None where no provider is given), request_id, sources and iterations.

        A provider may ask for more by the control command, at most max_iterations rounds in all; a malformed command
        ends the rounds. Markers keep their numbers over rounds.
        """
        if not question.strip():
            raise ValueError("empty_question")
        s, spark, request = self.settings, self.spark, uuid.uuid4().hex
        searched = f"{retrieval_context}\n{question}".strip()
        hits = [self.retriever.search(spark.createDataFrame([(request, searched)], "request_id string, question string"), top_k)]
        if attachment:
            hits.insert(0, self.retriever.attachment(question, attachment, request, top_k))
        common = ["request_id", "chunk_id", "document_id", "revision", "ordinal", "char_start", "char_end", "location_kind", "location_start", "location_end", "score", "rank", "relative_path", "build_id", "source_type", "context_scope", "text"]
        merged = search.merged([h.select(*common) for h in hits], s.max_contexts).persist()
        asked = f"{conversation_context}\n\n{question}".strip()
        markers = self._prepare(request, asked, merged, None)
        answer, iteration = None, 1
        while provider is not None:
            payload = json.loads((self.vault.root / request / "payload.json").read_text(encoding="utf-8"))
            answer = provider(payload)
            command = spark.createDataFrame([(answer,)], "t string").select(control.parse(F.col("t"), s.max_queries).alias("c")).first()["c"]
            if command is None:
                break
            if command["error"] or iteration >= s.max_iterations:
                answer = "The material found is not sufficient for an answer."
                break
            merged, grown = self._more(request, question, command, merged, common)
            iteration = iteration + 1 if grown else s.max_iterations
            markers = self._prepare(request, asked, merged, markers)
        result = {"request_id": request, "iterations": iteration, "answer": None, "sources": json.loads((self.vault.root / request / "sources.json").read_text(encoding="utf-8"))}
        if answer is not None:
            self.vault.stage(request, answer)
            result["answer"] = self.vault.restored(request)
        merged.unpersist()
        return result

    def _prepare(self, request: str, question: str, merged: DataFrame, markers: DataFrame | None) -> DataFrame:
        s = self.settings
        documents = self.retriever.indexer.documents.read()
        budget = context.Budget(s.total_context_max_chars, s.whole_document_max_chars, s.logical_parent_max_chars, s.max_whole_documents)
        parents = context.parents(merged.select("request_id", "place", "document_id", "revision", "chunk_id", "char_start", "char_end", "text", "source_type"), documents, budget)
        asked = self.spark.createDataFrame([(request, question)], "request_id string, text string")
        fields, minted = masked_requests(asked, parents, markers=markers)
        minted, fields = minted.persist(), fields.persist()
        state = [r.asDict() for r in minted.orderBy("label", "n").collect()]
        rows = {r["field"]: r["masked"] for r in fields.collect()}
        outside = self.spark.createDataFrame([(t,) for t in rows.values()], "t string")
        aliases = F.array(*[F.lit(a) for m in state for a in m["aliases"]]).cast("array<string>")
        if state and outside.where(spans.leaks(F.col("t"), aliases)).limit(1).count():
            raise ValueError("outbound_validation_failed")
        shown = search.provider_context(merged.drop("text", "context_scope").join(parents.select("place", "text", "context_scope"), "place")).orderBy("citation_ref").collect()
        contexts = [{"citation_ref": c["citation_ref"], "document_id": c["document_id"], "chunk_id": c["chunk_id"], "score": c["score"], "file_type": c["file_type"], "context_scope": c["context_scope"], "text": rows[int(c["citation_ref"][1:])]} for c in shown]
        sources = [r.asDict(True) for r in search.sources(merged).orderBy("ordinal").collect()]
        versions = {"index_signature": self.retriever.indexer.signature(), "builds": (search.build_ids(merged).first() or {"build_ids": ""})["build_ids"]}
        payload = {"request_id": request, "question": rows[0], "contexts": contexts}
        if (self.vault.root / request / "manifest.json").exists():
            self.vault.update(request, payload, state, sources)
        else:
            self.vault.create(request, payload, state, sources, versions)
        return minted

    def _more(self, request: str, question: str, command: object, merged: DataFrame, common: list[str]) -> tuple[DataFrame, bool]:
        """The hits with what the command adds, and whether that is anything. Rewrites far from the question are ignored."""
        s, spark, known = self.settings, self.spark, self.vault.markers(request)
        vectors = self.retriever.indexer.embedder.vectors([question, *(restore(q, known) for q in command["queries"])])
        near = [restore(q, known) for q, v in zip(command["queries"], vectors[1:]) if float(vectors[0] @ v) >= s.rewrite_min_similarity]
        parts = [merged.drop("place").select(*common)]
        for q in near:
            parts.append(self.retriever.search(spark.createDataFrame([(request, q)], "request_id string, question string")).select(*common))
        if command["expand_citations"]:
            named = spark.createDataFrame([(request, c) for c in command["expand_citations"]], "request_id string, citation_ref string")
            parts.append(self.retriever.around(search.cited(merged, named)).select(*common))
        before = merged.count()
        new = search.merged(parts, s.max_contexts).persist()
        return new, new.count() > before


def verified_subject(token: str, secret: str, issuer: str, now: float | None = None) -> str:
    """The subject of a signed HS256 token; anything wrong with it is one error."""
    now = time.time() if now is None else now

    def decoded(part: str) -> bytes:
        return base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))

    try:
        head, body, sign = token.split(".")
        header, claims = json.loads(decoded(head)), json.loads(decoded(body))
        expected = hmac.new(secret.encode(), f"{head}.{body}".encode(), hashlib.sha256).digest()
        good = (
            header.get("alg") == "HS256" and hmac.compare_digest(expected, decoded(sign)) and claims.get("iss") == issuer and claims["iat"] <= now + 60 and claims["exp"] >= now - 30
            and claims["exp"] > claims["iat"] and re.fullmatch(r"[A-Za-z0-9_.@:-]{1,128}", claims["sub"])
        )
    except Exception:  # noqa: BLE001 - no detail of a bad token may be told apart
        good = False
    if not good:
        raise PermissionError("invalid_identity")
    return claims["sub"]


def authorized(header: str | None, key: str | None) -> int:
    """HTTP status of a bearer header: 200, 401, or 503 where no key is set."""
    if not key:
        return 503
    return 200 if header and hmac.compare_digest(header.encode(), f"Bearer {key}".encode()) else 401
