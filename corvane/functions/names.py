"""Forms of Russian surnames brought to one, so that a person has one identity in all cases."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Endings of surnames and of their cases.
ENDINGS = (
    (r"(ов|ев|ёв)(?:ыми|ых|ы|ому|ого|ым|ую|ой|у|е|ом|а)", "$1$2"),
    (r"(ов)ами", "$1$2"),
    (r"(ин|ын)(?:ыми|ому|ого|ым|ую|ой|у|е|ом|а)", "$1$2"),
    (r"(ск|цк)(?:ими|ому|ого|им|ую|ой|ом|ая|ие)", "$1$2ий"),
)
HINTS = "ов ев ёв ин ын ский цкий ской цкой ова ева ёва ина ына енко чук ук юк ян дзе ых их".split()
WORD = r"(?U)[^\W\d_]+(?:[-'’][^\W\d_]+)?"


def _endings(stem: str) -> list[tuple[str, str]]:
    return [(rf"\A({stem}){pattern}\z", new) for pattern, new in ENDINGS]


def normalize_surname(c: Column) -> Column:
    """The nominative of a surname in the case of the input. At least two letters stay before the ending."""
    value = F.trim(c)
    low = F.lower(value)
    for pattern, new in _endings(r"(?s).{2,}"):
        low = F.when(low.rlike(pattern), F.regexp_replace(low, pattern, new)).otherwise(low)
    upper = (value == F.upper(value)) & (value != F.lower(value))
    capital = F.substring(value, 1, 1) != F.lower(F.substring(value, 1, 1))
    return F.when(upper, F.upper(low)).when(capital, F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, F.lit(2), F.length(low)))).otherwise(low)


def looks_like_surname(c: Column) -> Column:
    low = F.lower(c)
    pattern = "(?:" + "|".join([*HINTS, *(p for p, _ in ENDINGS)]) + r")\z"
    return (F.length(low) >= 4) & low.rlike(pattern)


def canonical_person(c: Column) -> Column:
    """The normal form of the first word that looks like a surname, else of the first of more than one letter."""
    words = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    surname = F.coalesce(F.get(F.filter(words, looks_like_surname), F.lit(0)), F.get(F.filter(words, lambda w: F.length(w) > 1), F.lit(0)), F.get(words, F.lit(0)))
    return F.when(F.size(words) == 0, F.trim(c)).otherwise(normalize_surname(surname))


def _person(label: Column) -> Column:
    return F.upper(label).isin("PER", "PERSON", "PERS")


def identity(label: Column, value: Column) -> Column:
    """What two values of a label share when they mean the same: persons by surname, others exactly."""
    return F.when(_person(label), F.lower(canonical_person(value))).otherwise(value)


def display(label: Column, value: Column) -> Column:
    """The value that is written back: a bare surname in its normal form, all else as it stood."""
    words = F.regexp_extract_all(value, F.lit(WORD), F.lit(0))
    return F.when(_person(label) & (F.size(words) == 1), normalize_surname(F.get(words, F.lit(0)))).otherwise(value)
