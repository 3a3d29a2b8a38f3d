"""Rules that detect identifiers, and their check sums, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F

from .text import matches

SPAN = "struct<start:int,end:int,label:string,score:double,source:string,priority:int,seq:int>"


def _weighted(value: Column, weights: tuple[int, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(value, i + 1, 1).cast("int") * w for i, w in enumerate(weights)])


def valid_inn(c: Column) -> Column:
    """Check digits of a taxpayer number of 10 or 12 digits."""
    digits = F.regexp_replace(c, r"\D", "")
    digit = lambda i: F.substring(digits, i, 1).cast("int")
    # fixed values: the weights of the check digits
    ten = _weighted(digits, (2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == digit(10)
    eleventh = _weighted(digits, (7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == digit(11)
    twelfth = _weighted(digits, (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) % 11 % 10 == digit(12)
    return F.coalesce(F.when(F.length(digits) == 10, ten).when(F.length(digits) == 12, eleventh & twelfth), F.lit(False))


def valid_snils(c: Column) -> Column:
    """Check number of an insurance number of 11 digits."""
    digits = F.regexp_replace(c, r"\D", "")
    rest = _weighted(digits, (9, 8, 7, 6, 5, 4, 3, 2, 1)) % 101
    return F.coalesce(F.when(F.length(digits) == 11, F.when(rest == 100, F.lit(0)).otherwise(rest) == F.substring(digits, 10, 2).cast("int")), F.lit(False))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    pattern: str
    group: int = 0
    valid: object = None
    anchor: str = ""  #: a quick pattern that every text with a match also matches


# Labels, priorities and shapes of the rules.
RULES = (
    Rule("RAW_MARKER", 2000, r"\[\[[^\[\]\r\n]{1,80}\]\]", anchor=r"\[\["),
    Rule("EMAIL", 1200, r"(?U)(?<![\w.+-])[\w.+-]+@(?:[\w-]+\.)+[\w-]{2,}(?![\w-])", anchor="@"),
    Rule("SNILS", 1190, r"(?U)(?<!\d)\d{3}[- ]?\d{3}[- ]?\d{3}[ ]?\d{2}(?!\d)", 0, valid_snils),
    Rule("INN", 1180, r"(?U)(?<!\d)(?:\d{12}|\d{10})(?!\d)", 0, valid_inn),
    Rule("BANK_ACCOUNT", 1170, r"(?iuU)(?:р(?:асч[её]тный)?\s*/?\s*с(?:ч[её]т)?|сч[её]т|account)\s*(?:№|N|:)?\s*(\d{20})(?!\d)", 1, anchor=r"\p{Nd}{20}"),
    Rule("BANK_ACCOUNT", 1135, r"(?U)(?<!\d)\d{20}(?!\d)", anchor=r"\p{Nd}{20}"),
    Rule("BANK_ACCOUNT", 1160, r"(?U)(?<!\d)(\d{4}(?:[ -]\d{4}){4})(?!\d)", 1, anchor=r"\p{Nd}{4}[ -]\p{Nd}{4}[ -]\p{Nd}{4}[ -]"),
    Rule("PHONE", 1150, r"(?U)(?<!\d)(?:\+7|8)[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}(?!\d)"),
    Rule("PASSPORT", 1140, r"(?U)(?<!\d)(?:\d{2}\s+\d{2}\s+\d{6}|\d{4}\s+\d{6})(?!\d)"),
    Rule("MONEY", 1100, r"(?iuU)(?<!\w)(?:\d{1,15}|\d{1,3}(?:[ \xa0]\d{3})+)(?:[.,]\d{1,2})?\s*(?:₽|руб(?:л(?:ь|я|ей))?\.?)(?!\w)", anchor="₽|(?iu)руб"),
)


def detect(c: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<span> of all rules' matches, in the order of rules and places; `seq` keeps that order."""
    found = []
    for number, rule in enumerate(rules):
        spans = matches(c, rule.pattern, rule.group)
        if rule.anchor:
            spans = F.when(c.rlike(rule.anchor), spans).otherwise(F.array().cast("array<struct<start:int,end:int,text:string>>"))
        if rule.valid is not None:
            spans = F.filter(spans, lambda m: rule.valid(m["text"]))
        found.append(
            F.transform(
                spans,
                lambda m, i: F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), F.lit(rule.label).alias("label"), F.lit(1.0).alias("score"),
                    F.lit("regex").alias("source"), F.lit(rule.priority).alias("priority"), (F.lit(number * 1_000_000) + i).cast("int").alias("seq"),
                ),
            )
        )
    return F.when(c.isNotNull(), F.concat(*found)).otherwise(F.array().cast(f"array<{SPAN}>"))
