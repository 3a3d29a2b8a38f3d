"""Keyword-stuffed and link-list pages (problem 9).

Lines are reduced to shapes: the bucket of their word count, their share of capitals, their separators and how many
there are, links and tags, whether they end as a sentence, how many function words and figures they have, and whether
they repeat the page's words. The shape alone decides what a line is. Lines of one shape are grouped; shapes that no
sentence, table or list of contents has are counted by their length. A page is flagged when most of its text belongs
to such shapes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .markup import ENTITY, STOP_WORDS, TAG, plain_signs

LINK = re.compile(r"<a\s[^>]*>|</a>|\]\((?:https?://)?[^)\s]*\)|https?://\S+|\bwww\.\S+", re.I)
WORD = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d")
HASHTAG = re.compile(r"(?<![\w&])#[\w-]+")
CAMEL = re.compile(r"[A-ZА-ЯЁÀ-ÖØ-Þ]?[a-zа-яёß-öø-ÿ]+|\d+[A-Z]*|[A-ZА-ЯЁÀ-ÖØ-Þ]+(?![a-zа-яёß-öø-ÿ])")
REFERENCE = re.compile(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.)])\s")
NUMBER = re.compile(r"\(?\d[\d.,]*[):;,.]?")
LEADER = re.compile(r"\.{3,}\s*\d+\s*$|(?:\. ){3,}\d+\s*$")
END = re.compile(r"[.!?…]['\"»”)\]]*\s+|[.!?…]['\"»”)\]]*$")
SEPARATORS = ("|", "/", "»", "•", "·", ">", ",", ";", "\t")


class Limits(NamedTuple):
    window: int = 60  #: words that repetition is judged on; shorter lines are taken together
    distinct: float = 0.65  #: share of distinct words below which a window without stop words repeats few words
    sentences: float = 0.5  #: the same for a window with stop words
    stop: float = 0.1  #: share of stop words that makes the difference
    linked: float = 0.3  #: share of a line's characters in links from which it is a line of links
    page: float = 0.58  #: share of the text in non-sentence shapes from which a page is flagged
    least: int = 8  #: words, links and tags a page must have at least
    whole: float = 0.5  #: share of distinct words below which a page's lists, taken together, repeat their words
    letters: float = 0.65  #: share of letters from which a line is a list of words, not of figures
    figures: float = 0.5  #: share of a line's tokens with digits from which it is data
    numbers: float = 0.2  #: the same for tokens that are whole numbers, as quantities and pages are
    items: int = 8  #: separators from which a line of short items without sentences is a list of tags, whether they repeat or not


class Shape(NamedTuple):
    words: int  #: bit length of the word count
    capitals: int  #: tenths of words that begin with a capital
    separator: str  #: the separator that occurs most, if it does at least twice
    items: int  #: 0 to 3: less than two separators, some, many with long items, many with short items
    links: int  #: bit length of the number of links
    linked: bool  #: most of what can be read of the line is links
    tags: int  #: bit length of the number of hashtags
    tagged: bool  #: most of the line is hashtags
    sentence: bool
    stops: int  #: tenths of function words
    figures: int  #: 0 to 2: few tokens with digits, some, most
    ordered: bool  #: it has a number of its own, a leader to a page number, or columns
    repeated: bool  #: it repeats words of the page

    @property
    def label(self) -> str:
        """'links', 'tags', 'keywords', 'data' or 'text'."""
        if self.linked and not (self.ordered and self.sentence):
            return "links"
        if self.tagged:
            return "tags"
        if self.ordered or self.figures == 2 or self.figures == 1 and self.sentence:
            return "data"
        if self.repeated or self.items == 3 and not self.stops and not self.sentence:
            return "keywords"
        return "text"


def _lines(text: str, limits: Limits) -> Iterator[str]:
    """Lines; lines of many sentences are cut into groups of sentences, short neighbours of one make are joined."""
    for line in text.split("\n"):
        if not line.strip():
            continue
        if len(line) < 200:
            yield line
            continue
        at, n = 0, 0
        for m in END.finditer(line):
            n = m.end()
            if n - at >= 150:
                yield line[at:n]
                at = n
        while len(line) - at > 600:  # a line without sentences
            cut = line.find(" ", at + 300)
            cut = len(line) if cut < 0 else cut + 1
            yield line[at:cut]
            at = cut
        if line[at:].strip():
            yield line[at:]


def _repeats(words: list[str], limits: Limits) -> bool:
    content = [w for w in words if w not in STOP_WORDS]
    most = limits.sentences if len(words) - len(content) >= limits.stop * len(words) else limits.distinct
    return len(content) >= limits.window // 3 and len(set(content)) < most * len(content)


class _Line(NamedTuple):
    line: str
    links: list[str]
    bare: str  #: without links, tags and entities
    tags: list[str]
    words: list[str]  #: small letters
    found: list[str]  #: as written


def _read(text: str, limits: Limits) -> list[_Line]:
    parts = []
    for line in _lines(text, limits):
        links = LINK.findall(line) if "http" in line or "](" in line or "<a" in line or "www." in line else []
        bare = LINK.sub(" ", line) if links else line
        if "<" in bare:
            bare = TAG.sub(" ", bare)
        if "&" in bare:
            bare = ENTITY.sub(" ", bare)
        tags = HASHTAG.findall(bare) if "#" in bare else []
        found = WORD.findall(bare)
        words = [w for t in tags for w in CAMEL.findall(t[1:])] if len(tags) > 1 and sum(map(len, tags)) > len(bare) / 2 else found
        parts.append(_Line(line, links, bare, tags, [w.lower() for w in words if len(w) > 1], found))
    return parts


def _repeated(parts: list[_Line], limits: Limits) -> list[bool]:
    """Which lines repeat few words, judged on windows of neighbouring lines and on all lists of the page together."""
    few = [False] * len(parts)
    start, gathered = 0, []
    for i, p in enumerate(parts):
        gathered += p.words
        if len(gathered) >= limits.window or i == len(parts) - 1:
            if i == len(parts) - 1 and len(gathered) < limits.window and start:
                few[start : i + 1] = [few[start - 1] and (not gathered or len(set(gathered)) < 0.9 * len(gathered) or len(gathered) < 8)] * (i + 1 - start)
            else:
                few[start : i + 1] = [_repeats(gathered, limits)] * (i + 1 - start)
            start, gathered = i + 1, []
    # a list longer than a window repeats only on the page: lines of words without sentences, of one make by separator
    lists: dict[str, list[int]] = {}
    content: dict[str, list[str]] = {}
    for i, p in enumerate(parts):
        own = [w for w in p.words if w not in STOP_WORDS]
        if own and len(p.words) - len(own) < limits.stop * len(p.words) and sum(map(len, p.found)) >= limits.letters * len(p.bare.strip()) and not END.search(p.bare):
            separator = _separator(p.line)
            lists.setdefault(separator, []).append(i)
            content.setdefault(separator, []).extend(own)
    for separator, at in lists.items():
        if len(content[separator]) >= limits.window and len(set(content[separator])) < limits.whole * len(content[separator]):
            for i in at:
                few[i] = True
    return few


def _separator(line: str) -> str:
    n, most = max((line.count(s), s) for s in SEPARATORS)
    return most if n > 1 else ""


def shapes_of(text: str, limits: Limits = Limits()) -> list[tuple[Shape, int]]:
    """(shape, characters) of each line."""
    parts = _read(plain_signs(text), limits)
    return _shapes(parts, _repeated(parts, limits), limits)


def _shapes(parts: list[_Line], few: list[bool], limits: Limits) -> list[tuple[Shape, int]]:
    out = []
    for (line, links, bare, tags, words, found), repeated in zip(parts, few):
        linked = (len(line) - len(bare) if links else 0) / len(line)
        numbered = bool(REFERENCE.match(line))
        tokens = bare.split()
        figured = [t for t in tokens if DIGIT.search(t)] if DIGIT.search(bare) else []
        numbers, digits = sum(bool(NUMBER.fullmatch(t)) for t in figured), len(figured)
        columns = line.count("\t") >= 2 or line.count(";") - line.count("; ") >= 3
        separator = _separator(line)
        n = line.count(separator) if separator else 0
        items = 0 if n < 2 else 1 if n < limits.items else 3 if len(found) <= 4 * n and sum(map(len, found)) >= limits.letters * len(bare.strip()) else 2
        stops = sum(w in STOP_WORDS for w in words)
        shape = Shape(
            len(found).bit_length(), 10 * sum(w[0].isupper() for w in found) // max(1, len(found)), separator, items,
            len(links).bit_length(), bool(links) and linked >= limits.linked and not (numbered and "](" not in line), len(tags).bit_length(), len(tags) >= 2 and sum(map(len, tags)) > len(line) / 2,
            bool(END.search(line)), 10 * stops // max(1, len(words)),
            2 if digits and len(DIGIT.findall(bare)) > sum(map(len, found)) or digits >= limits.figures * max(1, len(tokens)) or numbers and numbers >= limits.numbers * len(tokens) else 1 if digits else 0,
            bool(LEADER.search(line)) or columns or numbered and bool(links), repeated,
        )
        out.append((shape, len(line)))
    return out


def score(text: str | None, limits: Limits = Limits()) -> float:
    """The share of the text in non-sentence shapes; 0 for null, blank and very short texts."""
    if not text or text.isspace():
        return 0.0
    parts = _read(plain_signs(text), limits)
    few = _repeated(parts, limits)
    # without these no shape of the page can be of another kind than data or text
    if not any(few) and not any(p.links or len(p.tags) > 1 or max(map(p.line.count, SEPARATORS)) >= limits.items for p in parts):
        return 0.0
    lines = _shapes(parts, few, limits)
    weight: Counter[Shape] = Counter()
    for shape, n in lines:
        weight[shape] += n
    if sum(s.links + s.tags + s.words for s, _ in lines) < limits.least:
        return 0.0
    return sum(n for s, n in weight.items() if s.label in ("links", "tags", "keywords")) / max(1, sum(weight.values()))


def found(df: DataFrame, record: str, column: str, limits: Limits = Limits()) -> DataFrame:
    """(record) of texts most of which are repeated keywords, links or tags. Null and blank texts are no case."""

    @F.pandas_udf("double")
    def share(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([score(t, limits) for t in batch], dtype=float)

    return df.where(F.col(column).isNotNull()).select(F.col(record), share(F.col(column)).alias("share")).where(F.col("share") > limits.page).select(record).distinct()
