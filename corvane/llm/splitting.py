"""Pieces of texts within a size limit, cut at natural boundaries, with overlap (problem 3).

Each text gets an array of boundary strengths: the place just after a separator has the strength of that separator.
A sparse table answers which place in a window is strongest, ties going to the rightmost one, in two look-ups. Pieces
are then cut one after the other, the next one stepping back by the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.cuts import pieces

def kind_of(locations: list | None, start: int, end: int) -> str:
    """The kind that all locations overlapping start..end share, or ''."""
    kinds = {x["location_kind"] for x in (locations if locations is not None else ()) if x is not None and x["char_start"] is not None and x["char_end"] is not None and x["char_start"] < end and x["char_end"] > start}
    return next(iter(kinds)) or "" if len(kinds) == 1 else ""


def split(df: DataFrame, record: str = "doc_id", longer_than: int = 0, limit: int = 1000, overlap: int = 120, least: int = 80) -> DataFrame:
    """(record, char_start, char_end, location_kind) of each piece of each text of more than `longer_than` characters.

    Needs the columns text and locations. Null and blank texts have no pieces; null locations count as none; equal
    pieces of repeated rows count once. Offsets count code points of the text as stored.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, a, b, kind_of(where, a, b)) for i, text, where in zip(batch["id"], batch["text"], batch["locations"]) for a, b in pieces(text, limit, overlap, least, past_blanks=True)]
            yield pd.DataFrame(rows, columns=["id", "char_start", "char_end", "location_kind"])

    source = df.where(F.length("text") > longer_than).select(F.col(record).alias("id"), "text", "locations")
    kind = dict(df.dtypes)[record]
    out = source.mapInPandas(cut, f"id {kind}, char_start int, char_end int, location_kind string")
    return out.withColumnRenamed("id", record)
