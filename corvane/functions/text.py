"""Text functions as Column expressions: normal forms, match offsets, windows and formats.

All offsets count code points, from 0, ends exclusive. A null input gives a null result unless stated otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space of str.isspace without the line feed, and the punctuation dropped at a query's end.
BLANKS = r"\t\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
QUERY_END = r".,!?;:…。！？"
STEP_LABELS = {"page": "стр.", "approx_page": "примерно стр.", "slide": "слайд", "sheet": "лист"}
_ANY = rf"[{BLANKS}\n]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"\A{_ANY}+|{_ANY}+\z", "")


def normalize_text(c: Column) -> Column:
    """No NUL, line feeds only, no blanks at line ends, one blank line at most in a row, stripped."""
    c = F.regexp_replace(c, r"\x00", "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, rf"[{BLANKS}]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(c)


def normalize_query(c: Column) -> Column:
    """White space runs as one blank, stripped, without punctuation at the end."""
    c = strip(F.regexp_replace(c, rf"{_ANY}+", " "))
    return F.regexp_replace(F.regexp_replace(c, rf"[{QUERY_END}]+\z", ""), rf"{_ANY}+\z", "")


def prefixed(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), c)


def matches(c: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start:int,end:int,text:string>> of all matches of a pattern that never matches nothing.

    With `group`, the offsets are of that group inside its match (its first occurrence there).
    """
    # arrays are zipped, not looked up by place: a look-up inside a lambda would match the text again for each element
    whole, parts = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    sizes = F.zip_with(whole, parts, lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    folded = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
            F.struct(
                (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("text")))).alias("out"),
            )
        ),
        lambda acc: acc["out"],
    )
    folded = F.when(F.size(whole) > 0, folded).when(F.size(whole) == 0, none)  # most texts need one scan only
    if not group:
        return folded
    inner = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    return F.zip_with(
        folded,
        inner,
        lambda m, g: F.struct(
            (m["start"] + F.instr(m["text"], g) - 1).cast("int").alias("start"), (m["start"] + F.instr(m["text"], g) - 1 + F.length(g)).cast("int").alias("end"), g.alias("text")
        ),
    )


def slice_text(c: Column, start: Column, end: Column) -> Column:
    return F.substring(c, start + 1, F.greatest(F.lit(0), end - start))


def window(low: Column, high: Column, focus_start: Column, focus_end: Column, budget: Column) -> Column:
    """struct<start,end> of at most `budget` characters of low..high around the focus, moved where a bound is near."""
    start = F.least(F.greatest(focus_start, low), high)
    spare = budget - (F.least(F.greatest(focus_end, start), high) - start)
    begin = F.when(spare <= 0, start).otherwise(F.least(F.greatest(start - F.floor(spare / 2).cast("int"), low), high - budget))
    return F.when(high - low <= budget, F.struct(low.alias("start"), high.alias("end"))).otherwise(F.struct(begin.alias("start"), F.least(high, begin + budget).alias("end")))


def table_excerpt(text: Column, low: Column, high: Column, focus_start: Column, focus_end: Column, budget: Column, separator: str, header: int = 3000) -> Column:
    """struct<text,start,end>: the table's head, a separator and the window around the match, within `budget`."""
    head = F.least(F.lit(header), F.greatest(F.lit(1), (budget / 3).cast("int")))
    head_end = F.least(high, low + head)
    near = window(low, high, focus_start, focus_end, F.greatest(F.lit(1), budget - head - F.lit(len(separator))))
    joined = F.concat(slice_text(text, low, head_end), F.lit(separator), slice_text(text, near["start"], near["end"]))
    result = lambda t, a, b: F.struct(t.alias("text"), a.alias("start"), b.alias("end"))
    return (
        F.when(high - low <= budget, result(slice_text(text, low, high), low, high))
        .when(focus_start <= head_end, result(slice_text(text, low, F.least(high, low + budget)), low, F.least(high, low + budget)))
        .otherwise(result(F.substring(joined, F.lit(1), budget), low, near["end"]))
    )


def location_label(kind: Column, start: Column, end: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in STEP_LABELS.items() for x in kv])
    span = F.when(end.isNull() | (end == "") | (end == start), start).otherwise(F.concat(start, F.lit("–"), end))
    return F.trim(F.concat(F.coalesce(F.try_element_at(labels, kind), kind), F.lit(" "), span))


def indented(c: Column) -> Column:
    """Each line behind four blanks, so that a renderer shows it as it is."""
    return F.concat(F.lit("    "), F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n").substr(F.lit(1), F.greatest(F.lit(0), F.length(F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\z", "")))), "\n", "\n    "))


def task_suffix(c: Column) -> Column:
    """The last dotted part in small letters, or null if it isn't a plain name."""
    task = F.lower(strip(F.element_at(F.split(c, r"\."), -1)))
    return F.when(task.rlike(r"\A[a-z0-9_]{1,80}\z"), task)


def message_text(parts: Column) -> Column:
    """The non-empty texts of parts of type text or input_text, a line each."""
    good = F.filter(parts, lambda p: p["type"].isin("text", "input_text") & (F.coalesce(p["text"], F.lit("")) != ""))
    return F.array_join(F.transform(good, lambda p: p["text"]), "\n")


def history_content(role: Column, content: Column, failed: str, progress_end: str, sources: str, answer: str = "Ответ:") -> Column:
    """A turn without what the interface added: failed turns are empty, progress before and sources after are cut."""
    text = strip(content)
    after = F.when(F.contains(text, F.lit(progress_end)), strip(F.substring(text, F.instr(text, progress_end) + len(progress_end), F.length(text)))).otherwise(text)
    after = F.when(F.contains(text, F.lit(progress_end)) & F.startswith(after, F.lit(answer)), strip(F.substring(after, F.lit(len(answer) + 1), F.length(after)))).otherwise(after)
    body = strip(F.split_part(after, F.lit(sources), F.lit(1)))
    return F.when(role != "assistant", text).when(F.contains(text, F.lit(failed)), F.lit("")).otherwise(body)


def normalize_label(c: Column) -> Column:
    name = F.regexp_replace(F.upper(F.trim(c)), r"\A[BI]-", "")
    return (
        F.when(name.isin("PERSON", "PERS"), F.lit("PER")).when(name.isin("ORGANIZATION", "ORGANISATION"), F.lit("ORG")).when(name == "LOCATION", F.lit("LOC")).otherwise(name)
    )


def safe_label(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(F.upper(c), r"[^A-Z0-9_]+", "_"), r"\A_+|_+\z", "")
    return F.when(name == "", F.lit("ENTITY")).otherwise(name)


def stable_document_id(path: Column) -> Column:
    """32 hex digits from the path, the same for either slash and any case (by `lower`, so ß isn't ss)."""
    return F.substring(F.sha2(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), 256), 1, 32)


def bounded_join(parts: Column, separator: str, most: int) -> Column:
    """struct<text,truncated>: the parts joined, cut at `most` characters."""
    whole = F.array_join(parts, separator)
    return F.struct(F.substring(whole, 1, most).alias("text"), (F.length(whole) > most).alias("truncated"))
