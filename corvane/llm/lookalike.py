"""One consistent spelling for text that looks the same (problem 1).

Look-alike classes are built by union-find over code points and strings: full-width forms, kinds of blank
and hyphen, letters of other scripts with the same shape, ligatures, letters of other fonts, composed and decomposed
accents, and invisible characters (the class of the empty string). The representative of a class is its most frequent
member in the corpus, strings included, counted over all texts. Texts are rewritten greedily, leftmost and longest
first, by one automaton over all members that aren't representatives.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed

# Letters of the Cyrillic and Greek scripts and the Latin letters of the same shape.
SAME_SHAPE = """
АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ԚQ ԜW
аa еe ѕs іi јj оo рp сc уy хx ԛq ԝw һh ԁd
ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX
οo νv ϲc ϳj ρp
ҮY ӏl ԛq ԝw ԌG օo հh ցg ՕO ՍU ՏS ɡg ɑa
ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ
ꓮA ꓐB ꓚC ꓓD ꓰE ꓝF ꓖG ꓧH ꓲI ꓙJ ꓗK ꓡL ꓟM ꓠN ꓳO ꓑP ꓣR ꓢS ꓔT ꓴU ꓦV ꓪW ꓫX ꓬY ꓜZ
""".split()

#: Code points of all planes that have letters, marks or invisible characters.
_LIMIT = 0xE0200


@lru_cache(1)
def _mark_set() -> frozenset[str]:
    """Characters that stand after the first in a canonical decomposition, and narrow letters that compose as those do."""
    marks = {c for cp in range(1, 0x1F000) for c in unicodedata.normalize("NFD", chr(cp))[1:]}
    return frozenset(marks | set("ﾞﾟ") | set(map(chr, range(0xFFA1, 0xFFDD))))


def _class_of(chars: Iterable[str]) -> str:
    """A pattern's class of these characters; of the planes above the first it takes all, as the pattern is slow on many of them."""
    low = sorted(c for c in chars if c < "\U00010000")
    return "[" + re.escape("".join(low)) + "\U00010000-\U0010ffff]"


#: Texts that may hold accents apart from their letters.
MARKS = re.compile(_class_of(_mark_set()))


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.parent.setdefault(root, root) != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = sorted((self.find(a), self.find(b)), key=lambda s: (len(s), s))
        self.parent[b] = a


def _invisible(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind == "Cf" or kind == "Cc" and c not in "\t\n\r\x0b\x0c\x85" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠ឴឵ㅤﾠ"


def _sources() -> Iterator[tuple[str, str]]:
    """Pairs of strings that a reader cannot tell apart, by rule except for the letters above."""
    for a, b in SAME_SHAPE:
        yield a, b
    for cp in range(_LIMIT):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cn", "Cs", "Co"):
            continue
        if kind == "Zs" and c != " ":
            yield c, " "
        elif kind == "Pd" and "HYPHEN" in unicodedata.name(c, "") and c != "-":
            yield c, "-"
        elif _invisible(c):
            yield c, ""
        elif whole := unicodedata.decomposition(c):
            if whole.startswith(("<wide>", "<narrow>", "<font>")) or whole.startswith("<compat>") and re.search("LIGATURE|ROMAN NUMERAL", unicodedata.name(c, "")):
                yield c, unicodedata.normalize("NFC", unicodedata.normalize("NFKD", c))
            elif whole[0] != "<":
                yield c, unicodedata.normalize("NFD", c)


@lru_cache(1)
def classes() -> dict[str, frozenset[str]]:
    """Every member with its class. Strings equal after replacing their characters fall into one class too."""
    sets = UnionFind()
    pairs = list(_sources())
    for a, b in pairs:
        sets.union(a, b)
    strings = {s for p in pairs for s in p if len(s) > 1}
    for s in strings:
        sets.union(s, "".join(sets.find(c) for c in s))
    out: dict[str, set[str]] = {}
    for s in list(sets.parent):
        out.setdefault(sets.find(s), set()).add(s)
    return {s: frozen for members in out.values() if len(members) > 1 for frozen in [frozenset(members)] for s in members}


def _spelled(s: str) -> bool:
    """Several letters that one sign stands for; they are always the representative."""
    return len(s) > 1 and _mark_set().isdisjoint(s)


class Lookalikes:
    """Classes with chosen representatives, and the automaton that rewrites texts."""

    def __init__(self, frequency: dict[str, int] | None = None) -> None:
        frequency = frequency or {}
        self.plain = None if not frequency else lookalikes()  # shortest representatives, composed
        self.representative: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for members in set(classes().values()):
            spelled = [s for s in members if _spelled(s)]
            best = "" if "" in members else min(spelled) if spelled else min(members, key=lambda s: (-frequency.get(s, 0), len(s), s))
            for s in members:
                self.representative[s] = best
        final = {s: "".join(self.representative.get(c, c) for c in r) if len(r) > 1 else r for s, r in self.representative.items()}
        self.representative = final
        for s, r in final.items():
            if s and s != r:
                self.automaton.add_word(s, (len(s), r))
        self.automaton.make_automaton()
        # of a longer member what stands after its first character
        odd = {c for s, r in final.items() if s and s != r for c in (s if len(s) == 1 else s[1:])}
        self.strange = re.compile(_class_of(odd | _mark_set()))

        #: Texts whose form differs in length from what single characters become.
        self.uneven = re.compile(_class_of(_mark_set() | {s for s, r in final.items() if len(s) == 1 and len(r) > 1}))

    def rewrite(self, text: str) -> str:
        """`text` in the consistent form. Idempotent."""
        if not self.strange.search(text):
            return text
        if self.plain and MARKS.search(text):  # accents meet their letters first, so that longer members are seen whole
            text = self.plain.rewrite(text)
        out, at = [], 0
        for end, (n, new) in self.automaton.iter_long(text):
            out.append(text[at : end + 1 - n])
            out.append(new)
            at = end + 1
        out.append(text[at:])
        text = "".join(out)
        if not self.plain and MARKS.search(text):  # an accent that an invisible character kept from its letter
            whole = unicodedata.normalize("NFC", text)
            if whole != text:
                return self.rewrite(whole)
        return text


@lru_cache(4)
def lookalikes(frequency: tuple[tuple[str, int], ...] = ()) -> Lookalikes:
    return Lookalikes(dict(frequency))


def codes_of(texts: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def _strings() -> tuple[ahocorasick.Automaton, np.ndarray]:
    """The members of several code points as an automaton, and which code points are members."""
    automaton, single = ahocorasick.Automaton(), np.zeros(0x110000, bool)
    for s in classes():
        if len(s) > 1 and not _spelled(s):
            automaton.add_word(s, s)
        elif len(s) == 1:
            single[ord(s)] = True
    automaton.make_automaton()
    return automaton, single


def count_members(df: DataFrame, column: str) -> DataFrame:
    """(member string, n long): how often each member of a class occurs, over all texts; the longest member at a place counts."""

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, single = _strings()
        total, strings = np.zeros(0x110000, np.int64), Counter()
        for batch in batches:
            texts = batch["text"].dropna()
            codes = codes_of(texts)
            if len(codes):
                n = np.bincount(codes)
                total[: len(n)] += n
            for text in texts:
                if not text.isascii() and MARKS.search(text):
                    strings.update(s for _, s in automaton.iter_long(text))
        for s, n in strings.items():
            for c in s:
                total[ord(c)] -= n
        codes = np.flatnonzero(total * single)
        yield pd.DataFrame({"member": pd.Series([*map(chr, codes), *strings], dtype=object), "n": pd.Series([*total[codes].tolist(), *strings.values()], dtype="int64")})

    return df.select(F.col(column).alias("text")).mapInPandas(tally, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))


def representatives(*texts: DataFrame) -> tuple[tuple[str, int], ...]:
    """Counts of class members over all rows of one-column frames. To the driver: at most one row a class member."""
    counted = None
    for df in texts:
        part = count_members(df, df.columns[0])
        counted = part if counted is None else counted.unionByName(part)
    rows = counted.groupBy("member").agg(F.sum("n").alias("n")).collect()
    return tuple(sorted((r.member, r.n) for r in rows))


def normalize(df: DataFrame, column: str, frequency: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """`df` with `column` rewritten. Null stays null; blanks and line ends stay; other columns are untouched."""
    schema = df.schema

    @F.pandas_udf("string")
    def rewritten(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = lookalikes(frequency).rewrite
        for batch in texts:
            yield batch.map(rewrite, na_action="ignore")

    return df.withColumn(column, rewritten(F.col(column))).select(*[f"`{f.name}`" for f in schema])


def keyed(df: DataFrame, record: str, column: str, frequency: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """(id, raw, shown): 128-bit digests of the stored and of the rewritten text; null and blank texts dropped."""

    @F.pandas_udf("binary")
    def shown(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = lookalikes(frequency).rewrite
        for batch in texts:
            forms = [rewrite(t) for t in batch]
            yield pd.Series([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() if t and not t.isspace() else None for t in forms])

    return (
        df.where(F.col(column).isNotNull())
        .select(F.col(record).cast("long").alias("id"), F.unhex(F.md5(F.col(column).cast("binary"))).alias("raw"), shown(F.col(column)).alias("shown"))
        .where("shown is not null and id is not null")
    )


#: Rows of one shown text that one task pairs with others at most, and how many texts are taken for hot at most.
SALT_ROWS, HOT_TEXTS = 4096, 1000


def same_looking_pairs(keyed_rows: DataFrame) -> DataFrame:
    """(table_name, id_a, id_b) of records that are shown alike but stored differently.

    Input: (table_name, id, raw, shown). Copies of one stored form are counted first, so a form that a third of all
    rows share costs one row there. Texts that hold more than a thousandth of all rows are known before the first
    join and salted in it. The work is in proportion to the pairs returned.
    """
    text = ["table_name", "shown"]
    rows = checkpointed(keyed_rows.distinct())  # digests only; the texts are rewritten once
    forms = rows.groupBy(*text, "raw").agg(F.count("*").alias("n"))
    several = checkpointed(forms.groupBy(*text).agg(F.count("*").alias("forms"), F.sum("n").alias("all")).where("forms > 1"))
    least = max(SALT_ROWS, rows.count() // HOT_TEXTS)
    hot = F.broadcast(several.where(F.col("all") > least).select(*text, F.ceil(F.col("all") / F.lit(SALT_ROWS)).cast("int").alias("salts")))  # HOT_TEXTS rows at most
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    salted = several.join(hot, text, "left").select(*text, "salts", F.explode(salts).alias("salt"))
    members = rows.join(hot, text, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")).join(salted.select(*text, "salt"), [*text, "salt"], "left_semi")
    parts = members.groupBy(*text, "raw", "salt").agg(F.count("*").alias("n")).drop("n")  # what stands for the rows of one form and salt
    a, b = parts.select(*text, F.col("raw").alias("ra"), F.col("salt").alias("sa")), parts.select(*text, F.col("raw").alias("rb"), F.col("salt").alias("sb"))
    met = a.join(b, text).where("ra < rb")
    left = members.select(*text, F.col("raw").alias("ra"), F.col("salt").alias("sa"), F.col("id").alias("s"))
    right = members.select(*text, F.col("raw").alias("rb"), F.col("salt").alias("sb"), F.col("id").alias("l"))
    pairs = met.join(left, [*text, "ra", "sa"]).join(right, [*text, "rb", "sb"]).where("s <> l")
    return pairs.select("table_name", F.least("s", "l").alias("id_a"), F.greatest("s", "l").alias("id_b")).distinct()


def same_looking_classes(keyed_rows: DataFrame) -> DataFrame:
    """(table_name, id, class_id, size, links): each record, the smallest id shown alike, how many are, and how many of them are stored differently.

    Rows are in proportion to the records, also where a third of them is shown alike.
    """
    text = ["table_name", "shown"]
    rows = checkpointed(keyed_rows.distinct())
    forms = rows.groupBy(*text, "raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    shown = forms.groupBy(*text).agg(F.sum("n").alias("size"), F.min("first").alias("class_id"))
    known = forms.join(shown, text).select(*text, "raw", "class_id", "size", (F.col("size") - F.col("n")).alias("links"))
    least = max(SALT_ROWS, rows.count() // HOT_TEXTS)
    large = known.where(F.col("size") - F.col("links") > least)  # forms of more rows than that are few
    small = known.where(F.col("size") - F.col("links") <= least)
    columns = ["table_name", "id", "class_id", "size", "links"]
    hot = rows.join(F.broadcast(large), [*text, "raw"]).select(*columns)
    return hot.unionByName(rows.join(F.broadcast(large.select(*text, "raw")), [*text, "raw"], "left_anti").join(small, [*text, "raw"]).select(*columns))
