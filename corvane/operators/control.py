"""The one command that a provider may send back: search again, or show more around a citation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TAG = "retrieval_request"
ENVELOPE = rf"(?s)\A<{TAG}>(\{{.*\}})</{TAG}>\z"
CITATION = r"\AR\d{3}\z"


def _list(payload: Column, name: str) -> Column:
    """The list under a name as JSON texts, [] where the name is missing, null where it is no list."""
    raw = F.get_json_object(payload, f"$.{name}")
    found = F.array_contains(F.json_object_keys(payload), name)
    return F.when(~found, F.array().cast("array<string>")).when(raw.startswith("["), F.from_json(raw, "array<string>"))


def _typed(payload: Column, name: str) -> Column:
    """Whether all elements are strings."""
    parts = F.from_json(F.get_json_object(payload, f"$.{name}"), "array<variant>")
    return F.coalesce(F.forall(parts, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(True))


def parse(text: Column, most_queries: int = 3, most_chars: int = 300, most_citations: int = 5) -> Column:
    """struct<queries,expand_citations,error>; null where the text holds no command.

    Queries have their white space made single; repetitions are dropped, order kept. `error` names the first rule
    that the command breaks; both lists are empty then.
    """
    stripped = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    payload = F.regexp_extract(stripped, ENVELOPE, 1)
    queries, citations = _list(payload, "queries"), _list(payload, "expand_citations")
    clean = F.transform(queries, lambda q: F.regexp_replace(F.regexp_replace(q, r"(?U)\s+", " "), r"\A | \z", ""))
    bad_query = F.exists(queries, lambda q: F.coalesce(q.rlike(r"[\x00-\x1f]"), F.lit(True))) | F.exists(clean, lambda q: (q == "") | (F.length(q) > most_chars))
    error = (
        F.when(payload == "", F.when(text.contains(f"<{TAG}>") | text.contains(f"</{TAG}>"), "invalid_retrieval_control_envelope"))
        .when(F.json_object_keys(payload).isNull(), "invalid_retrieval_control_json")
        .when(F.size(F.array_except(F.json_object_keys(payload), F.array(F.lit("queries"), F.lit("expand_citations")))) > 0, "invalid_retrieval_control_fields")
        .when(queries.isNull() | citations.isNull(), "invalid_retrieval_control_lists")
        .when((F.size(queries) > most_queries) | (F.size(citations) > most_citations), "retrieval_control_limit_exceeded")
        .when(bad_query | ~_typed(payload, "queries"), "invalid_retrieval_query")
        .when(F.exists(citations, lambda c: F.coalesce(~c.rlike(CITATION), F.lit(True))) | ~_typed(payload, "expand_citations"), "invalid_retrieval_citation")
        .when((F.size(queries) == 0) & (F.size(citations) == 0), "empty_retrieval_control")
    )
    none = F.array().cast("array<string>")
    good = error.isNull()
    result = F.struct(
        F.when(good, F.array_distinct(clean)).otherwise(none).alias("queries"), F.when(good, F.array_distinct(citations)).otherwise(none).alias("expand_citations"), error.alias("error")
    )
    return F.when(text.isNotNull() & ((payload != "") | error.isNotNull()), result)
