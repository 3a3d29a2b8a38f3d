"""Entity spans: conflicts, reversible markers, masking, leak checks and restoring."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import names, text as T
from ..functions.rules import SPAN

MARKER = r"\[\[[A-Z][A-Z0-9_]*_\d{4,}\]\]"
MARKER_LIKE = r"\[\[[^\[\]\r\n]{1,80}\]\]"


def merge(spans: Column) -> Column:
    """Spans without overlaps, by start: those of higher priority, score and length win, then earlier ones, then `seq`."""
    order = F.transform(
        spans,
        lambda s: F.struct((-s["priority"]).alias("p"), (-s["score"]).alias("q"), (s["start"] - s["end"]).alias("l"), s["start"].alias("a"), s["end"].alias("b"), s["seq"].alias("i"), s.alias("s")),
    )
    kept = F.aggregate(
        F.transform(F.array_sort(order), lambda x: x["s"]),
        F.array().cast(f"array<{SPAN}>"),
        lambda acc, s: F.when(F.exists(acc, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])), acc).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(a["end"] - b["end"]))


def admitted(spans: Column, text: Column, labels: list[str] | None = None, least_score: float = 0.0, least_chars: int = 1) -> Column:
    """Spans of allowed labels and scores with enough letters or digits."""
    def good(s: Column) -> Column:
        ok = (s["score"] >= least_score) & (s["end"] > s["start"]) & (F.length(F.regexp_replace(T.slice_text(text, s["start"], s["end"]), r"[^\p{L}\p{N}]", "")) >= least_chars)
        return ok & s["label"].isin(labels) if labels else ok

    return F.filter(spans, good)


def best_per_window(spans: DataFrame, *keys: str) -> DataFrame:
    """Of spans that overlapping model windows found twice, the one of the best score."""
    rest = [c for c in spans.columns if c not in (*keys, "start", "end", "label", "score")]
    best = F.max(F.struct("score", *rest)).alias("_b")
    return spans.groupBy(*keys, "start", "end", "label").agg(best).select(*keys, "start", "end", "label", "_b.*")


def mint(values: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(request_id, label, identity, n, marker, display_value, aliases) of values (request_id, field, start, label, value).

    Numbers follow the first occurrence over fields and starts, for each request and label. Values of one identity
    share a marker; its display value is that of the first. `existing` markers keep their numbers and new ones go on
    after them. Null values and labels are left out.
    """
    v = values.where("value is not null and label is not null").select(
        "request_id", T.safe_label(F.col("label")).alias("label"), names.identity(F.col("label"), F.col("value")).alias("identity"),
        names.display(F.col("label"), F.col("value")).alias("display_value"), "value", F.struct("field", "start").alias("first"),
    )
    grouped = v.groupBy("request_id", "label", "identity").agg(
        F.min("first").alias("first"), F.min(F.struct("first", "display_value"))["display_value"].alias("display_value"), F.array_sort(F.array_union(F.collect_set("value"), F.collect_set("display_value"))).alias("aliases")
    )
    known = None
    if existing is not None:
        known = existing.select("request_id", "label", "identity", "n", "marker", F.col("display_value").alias("_d"), F.col("aliases").alias("_a"))
        most = existing.groupBy("request_id", "label").agg(F.max("n").alias("_most"))
        both = grouped.join(known, ["request_id", "label", "identity"], "full_outer")
        old = both.where("marker is not null").select("request_id", "label", "identity", "n", "marker", F.col("_d").alias("display_value"), F.array_sort(F.array_union(F.coalesce("_a", F.array()), F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"))
        grouped = both.where("marker is null").select("request_id", "label", "identity", "first", "display_value", "aliases").join(most, ["request_id", "label"], "left")
    else:
        grouped = grouped.withColumn("_most", F.lit(0))
    number = F.coalesce("_most", F.lit(0)) + F.row_number().over(W.partitionBy("request_id", "label").orderBy("first"))
    new = grouped.withColumn("n", number.cast("int")).withColumn("marker", F.format_string("[[%s_%04d]]", "label", "n")).select("request_id", "label", "identity", "n", "marker", "display_value", "aliases")
    return new if known is None else old.unionByName(new)


def masked(text: Column, spans: Column) -> Column:
    """`text` with each of spans (struct<start,end,marker>, by start, without overlaps) replaced by its marker."""
    return F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            (s["start"] >= acc["at"]) & (s["end"] <= F.length(text)),
            F.struct(s["end"].alias("at"), F.concat(acc["out"], T.slice_text(text, acc["at"], s["start"]), s["marker"]).alias("out")),
        ).otherwise(acc),
        lambda acc: F.concat(acc["out"], T.slice_text(text, acc["at"], F.length(text))),
    )


def unknown_markers(text: Column, known: Column) -> Column:
    """What looks like a marker but isn't one of the map's."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(MARKER_LIKE), F.lit(0)), lambda m: ~F.map_contains_key(known, m)))


def restored(text: Column, known: Column, strict: bool = True) -> Column:
    """`text` with markers replaced by their values. Strict: a marker the map lacks is an error."""
    found, parts = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0)), F.split(text, MARKER, -1)
    whole = F.array_join(F.zip_with(parts, found, lambda p, m: F.concat(p, F.coalesce(F.try_element_at(known, m), m, F.lit("")))), "")
    return F.when(F.size(unknown_markers(text, known)) > 0, F.raise_error(F.lit("unknown_marker"))).otherwise(whole) if strict else whole


def _whole_word(value: Column) -> Column:
    v = F.trim(value)
    quoted = F.concat(F.lit(r"\Q"), F.replace(v, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.when(F.substring(v, 1, 1).rlike(r"\p{L}"), F.lit(r"(?<!\w)")).otherwise(F.lit(""))
    after = F.when(F.substring(v, -1, 1).rlike(r"\p{L}"), F.lit(r"(?!\w)")).otherwise(F.lit(""))
    return F.concat(before, quoted, after)


def known_value_pattern(value: Column) -> Column:
    """A pattern of a value as a whole word, whatever its case; null for values of fewer than three characters."""
    return F.when(F.length(F.trim(value)) >= 3, F.concat(F.lit("(?iuU)"), _whole_word(value)))


def leaks(text: Column, aliases: Column) -> Column:
    """Whether any alias of three characters or more stands in the text outside its markers.

    Aliases that don't occur at all are sorted out by plain search, so a pattern runs for few texts, once.
    """
    bare = F.regexp_replace(text, MARKER, "")
    # the array of one makes the small form be computed once, not for each alias
    held = F.flatten(F.transform(F.array(F.lower(bare)), lambda b: F.filter(aliases, lambda a: (F.length(F.trim(a)) >= 3) & F.contains(b, F.lower(F.trim(a))))))
    pattern = F.concat(F.lit("(?iuU)(?:"), F.array_join(F.transform(held, _whole_word), "|"), F.lit(")"))
    return F.when(F.size(held) > 0, F.rlike(bare, pattern)).otherwise(F.lit(False))


def checked(text: Column, aliases: Column) -> Column:
    """The text, or an error if it leaks."""
    return F.when(leaks(text, aliases), F.raise_error(F.lit("outbound_validation_failed"))).otherwise(text)


def _pattern(value: str) -> re.Pattern[str] | None:
    v = (value or "").strip()
    if len(v) < 3:
        return None
    return re.compile((r"(?<!\w)" if v[0].isalpha() else "") + re.escape(v) + (r"(?!\w)" if v[-1].isalpha() else ""), re.I)


def propagate_known(fields: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of every known value in every field of its request: (request_id, field, start, end, label, priority).

    `fields` has (request_id, field, text), `known` (request_id, value, label, priority). The values of a request go
    to its fields in one grouped row, so no field meets another request's values.
    """
    grouped = known.where("length(trim(value)) >= 3").groupBy("request_id").agg(F.collect_set(F.struct("value", "label", "priority")).alias("known"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for request, field, text, values in zip(batch["request_id"], batch["field"], batch["text"], batch["known"]):
                for v in values:
                    for m in _pattern(v["value"]).finditer(text or ""):
                        rows.append((request, field, m.start(), m.end(), v["label"], v["priority"]))
            yield pd.DataFrame(rows, columns=["request_id", "field", "start", "end", "label", "priority"])

    types = dict(fields.dtypes)
    schema = f"request_id {types['request_id']}, field {types['field']}, start int, end int, label string, priority int"
    return fields.select("request_id", "field", "text").join(grouped, "request_id").mapInPandas(scan, schema).distinct()


def propagate_markers(text: str, markers: dict[str, list[str]]) -> str:
    """Aliases that stand in the text outside markers become their markers: leftmost first, longer ones before shorter."""
    taken = [m.span() for m in re.finditer(MARKER, text)]
    found = []
    for marker, aliases in markers.items():
        for alias in aliases:
            if pattern := _pattern(alias):
                found += [(m.start(), -m.end(), marker) for m in pattern.finditer(text) if all(m.end() <= a or m.start() >= b for a, b in taken)]
    out, at = [], 0
    for start, end, marker in sorted(found):
        if start >= at and start >= 0:
            out += [text[at:start], marker]
            at = -end
    return "".join([*out, text[at:]])


def propagated(text: Column, markers: Column) -> Column:
    """`propagate_markers` on columns: text, and array<struct<marker,aliases>>."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else propagate_markers(t, {m["marker"]: list(m["aliases"]) for m in s}) for t, s in zip(texts, states)])

    return run(text, markers)
