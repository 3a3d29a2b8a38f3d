"""Evaluation texts leaking into training text (problem 8).

Winnowing: of every `window` consecutive k-word hashes the smallest is kept as a fingerprint, so two texts that share
k + window - 1 consecutive words share a fingerprint. Documents' fingerprints are joined with the items', and each hit
is extended word by word; a span of at least k + window - 1 words is a leak, and each such span is found.

Words are those of problem 2, in texts without markup (problem 6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .markup import clean
from .words import Words, runs_of, words_of

#: Characters of all items up to which their index is sent to every executor; beyond it fingerprints meet in a join.
BROADCAST_CHARS = 16_000_000


def winnowed(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, text, place): the fingerprints, the text of each and the index of its first word in `words`."""
    n = len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = words.text[:n] == words.text[k - 1 :]
    runs = runs_of(words, k)
    place = np.flatnonzero(whole)
    chosen = np.zeros(len(place), bool)
    m = len(place) - window + 1
    if m > 0:
        least = runs.hashes[:m].copy()
        for j in range(1, window):
            np.minimum(least, runs.hashes[j : j + m], out=least)
        inside = runs.text[:m] == runs.text[window - 1 :]
        for j in range(window):
            chosen[j : j + m] |= inside & (runs.hashes[j : j + m] == least)
    # a text with fewer runs than a window keeps its smallest
    edge = np.flatnonzero(np.diff(runs.text, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(place)]):
        if b - a < window:
            chosen[a + int(np.argmin(runs.hashes[a:b]))] = True
    return runs.hashes[chosen], runs.text[chosen], place[chosen]


class ItemIndex:
    """Fingerprints and words of the items."""

    def __init__(self, ids: list[int], texts: list[str], k: int, window: int) -> None:
        self.ids, self.k, self.window = np.array(ids, np.int64), k, window
        self.words = words_of(texts)
        hashes, text, place = winnowed(self.words, k, window)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.place = hashes[order], place[order]
        self.bounds = np.searchsorted(self.words.text, np.arange(len(texts) + 1))

    def leaks(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, item id) of spans of at least k + window - 1 words."""
        words = words_of(texts)
        hashes, _, place = winnowed(words, self.k, self.window)
        if not len(hashes) or not len(self.hashes):
            return []
        low = np.searchsorted(self.hashes, hashes)
        high = np.searchsorted(self.hashes, hashes, "right")
        ends = np.searchsorted(words.text, np.arange(len(texts) + 1))
        out, need = set(), self.k + self.window - 1
        for h in np.flatnonzero(high > low):
            p = int(place[h])
            t = int(words.text[p])
            for j in range(low[h], high[h]):
                q = int(self.place[j])
                i = int(self.words.text[q])
                key = (t, int(self.ids[i]))
                if key in out:
                    continue
                a, b = p, q
                while a > ends[t] and b > self.bounds[i] and words.hashes[a - 1] == self.words.hashes[b - 1]:
                    a, b = a - 1, b - 1
                c, d = p, q
                while c < ends[t + 1] and d < self.bounds[i + 1] and words.hashes[c] == self.words.hashes[d]:
                    c, d = c + 1, d + 1
                if c - a >= need:
                    out.add(key)
        return sorted(out)


def found(documents: DataFrame, items: DataFrame, record: str = "doc_id", item: str = "item_id", k: int = 5, window: int = 6, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(record, item) of documents with at least k + window - 1 consecutive words of an item.

    Null and blank texts, and items of fewer words, are in no pair; equal rows count once.
    """
    spark = documents.sparkSession
    docs = documents.where("text is not null").select(F.col(record).cast("long").alias("id"), "text").where("id is not null")
    held = items.where("text is not null").select(F.col(item).cast("long").alias("item"), F.col("text").alias("passage")).where("item is not null").distinct()
    size = held.agg(F.sum(F.length("passage"))).first()[0] or 0
    if size <= broadcast_chars:
        rows = held.collect()
        shared = spark.sparkContext.broadcast(ItemIndex([r.item for r in rows], [clean(r.passage) for r in rows], k, window))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["id"].tolist()
                yield pd.DataFrame([(ids[t], i) for t, i in shared.value.leaks([clean(t) for t in batch["text"]])], columns=["id", "item"]).astype("int64")

        pairs = docs.mapInPandas(scan, "id long, item long")
    else:

        def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                names, texts = batch.columns
                hashes, text, _ = winnowed(words_of([clean(t) for t in batch[texts]]), k, window)
                yield pd.DataFrame({"name": batch[names].to_numpy()[text], "print": hashes.astype(np.int64)}).drop_duplicates()

        @F.pandas_udf("boolean")
        def shares(texts: pd.Series, passages: pd.Series) -> pd.Series:
            return pd.Series([bool(ItemIndex([0], [clean(p)], k, window).leaks([clean(t)])) for t, p in zip(texts, passages)], dtype=bool)

        ours = docs.mapInPandas(prints, "name long, print long").withColumnRenamed("name", "id")
        theirs = held.mapInPandas(prints, "name long, print long").withColumnRenamed("name", "item")
        met = ours.join(theirs, "print").select("id", "item").distinct()
        pairs = met.join(docs, "id").join(held, "item").where(shares("text", "passage")).select("id", "item")
    return pairs.distinct().withColumnsRenamed({"id": record, "item": item})
