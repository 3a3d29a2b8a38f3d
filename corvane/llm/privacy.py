"""Personal information in free text (problem 5): spans with types, and readable text with typed placeholders.

Texts pass transducers that keep for each character they emit the place it came from: invisible characters and inline
markup vanish, full-width forms, blanks and hyphens take their plain form, letters of another script inside a word
take the word's script, and runs of spelled digits become digits. Identifiers are found in what comes out, and their
spans are mapped back to the text as stored. Each detector runs only on texts that hold one of its literal anchors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lookalike import SAME_SHAPE, lookalikes

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


# --- Transducers ---

#: Lengths between which the longest lines of a wrapped text lie.
WRAPPED = (55, 100)

ODD = re.compile(r"[\x00-\x08\x0e-\x1f\xa0\xad\u2000-\u200f\u2010\u2011\u202a-\u202f\u205f-\u2064\u3000\ufeff\uff01-\uff5e]")
MIXED = re.compile(r"[A-Za-z][\u0370-\u04ff]|[\u0370-\u04ff][A-Za-z]")
WORD = re.compile(r"[^\W\d_]+")
INLINE = re.compile(
    r"(?=[<*~`'\[\]\\}!_&])(?:</?(?!(?:at|chez|arobase|dot|punkt|point)\s*>)[A-Za-z][^<>\n]{0,120}>|\*\*|~~|`|'''?|\[\[(?![A-Z]+_\d)(?:[^\[\]|\n]{0,60}\|)?|(?<=[^\d\]])\]\]|(?<=\d)\]\](?<!_\d\d\d\d\]\])|\\(?:emph|textbf|texttt|textit)\{|(?<=[\w.)])\}"
    r"|!?\[(?=[^\]\[\n]{1,120}\]\([^)\s]*\))|\]\([^)\s]*\)|(?<![\w@.+])_(?=\w)|(?<=[\w.])_(?![\w@.+])|&quot;|&nbsp;|&mdash;|&#8211;|(?<=\S)~(?=\s))"
)
# The names of the digits in the four languages.
DIGITS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "ноль один два три четыре пять шесть семь восемь девять",
        "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf",
    )
    for i, w in enumerate(words.split())
}
SPELLED = re.compile(r"(?<!\w)(?:plus\s+|плюс\s+)?(?:(?:%s)[\s-]+){5,}(?:%s)(?!\w)" % ("|".join(DIGITS), "|".join(DIGITS)), re.I)
#: Letters that re.I takes for others than their small letters are.
_ODD_CASE = re.compile("[%s]" % "".join(c for c in map(chr, range(128, 0x10000)) if len(c.lower()) != 1 or re.fullmatch("[a-zа-яёßäöüàâçéèêëîïôùû]", c, re.I) and not re.fullmatch("[a-zа-яёßäöüàâçéèêëîïôùû]", c.lower())))


def _odd_case(text: str) -> bool:
    return not text.isascii() and _ODD_CASE.search(text) is not None


_TO_LATIN = {a: b for a, b in SAME_SHAPE}
_TO_CYRILLIC = {b: a for a, b in SAME_SHAPE if "Ѐ" <= a <= "ӿ" and a not in "ԚԜԁһ"}
_ONLY_CYRILLIC = re.compile("[%s]" % "".join(c for c in map(chr, range(0x410, 0x452)) if c not in _TO_LATIN))


class Text:
    """A text under transducers: what they emit and where each character came from (None: unchanged places)."""

    def __init__(self, text: str) -> None:
        self.out = text
        self.place: np.ndarray | None = None  #: where the part begins that a character stands for
        self.stop: np.ndarray | None = None  #: where it ends

    def _edit(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces [start, end) by new text. Each new character stands for the part it replaces."""
        if not edits:
            return
        place = self.place if self.place is not None else np.arange(len(self.out))
        stop = self.stop if self.stop is not None else np.arange(1, len(self.out) + 1)
        text, places, stops, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.out[at:a], new]
            places += [place[at:a], np.full(len(new), place[a])]
            stops += [stop[at:a], np.full(len(new), stop[b - 1])]
            at = b
        text.append(self.out[at:])
        self.out, self.place, self.stop = "".join(text), np.concatenate([*places, place[at:]]), np.concatenate([*stops, stop[at:]])

    def characters(self) -> None:
        if self.out.isascii() or not ODD.search(self.out):
            return
        known = lookalikes().representative
        self._edit([(m.start(), m.end(), known.get(c, c)) for m in ODD.finditer(self.out) if (c := m[0]) not in "\t\n\r\x0b\x0c"])

    def scripts(self) -> None:
        if self.out.isascii() or not MIXED.search(self.out):
            return
        edits = []
        for m in WORD.finditer(self.out):
            w = m[0]
            if w.isascii() or not MIXED.search(w):
                continue
            to = _TO_CYRILLIC if _ONLY_CYRILLIC.search(w) else _TO_LATIN
            edits += [(m.start() + i, m.start() + i + 1, to[c]) for i, c in enumerate(w) if c in to]
        self._edit(edits)

    def markup(self) -> None:
        t = self.out
        if "</" in t or "<br" in t or "**" in t or "~" in t or "`" in t or "''" in t or "](" in t or "[[" in t or "\\" in t or " _" in t or "&" in t:
            self._edit([(m.start(), m.end(), " " if m[0][0] == "&" and m[0] != "&quot;" or m[0].lower().startswith("<br") else "") for m in INLINE.finditer(t)])

    def spelled(self) -> None:
        """All words of a number but the first and the last stand by themselves, so a text of fewer such words than four has none."""
        if sum(map(DIGITS.__contains__, self.out.lower().replace("-", " ").split())) < 4 and not _odd_case(self.out):
            return
        edits = []
        for m in SPELLED.finditer(self.out):
            for w in re.finditer(r"[^\W\d_]+|[\s-]+", m[0]):
                v = w[0].lower()
                edits.append((m.start() + w.start(), m.start() + w.end(), DIGITS.get(v, "+" if v in ("plus", "плюс") else "")))
        self._edit(edits)

    def lines(self) -> None:
        """In a text wrapped at a fixed width, the ends of lines inside paragraphs become blanks."""
        rows = self.out.split("\n")
        if len(rows) > 3 and max(map(len, rows)) <= WRAPPED[1] and sum(len(r) >= WRAPPED[0] for r in rows) >= 3:
            self.out = re.sub(r"(?<=[^\s])\n(?=[^\s•*#|>=])", " ", self.out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        if self.place is None or self.stop is None:
            return start, end
        return int(self.place[start]), int(self.stop[end - 1])


# --- Detectors ---

EMAIL = re.compile(r"(?<![\w.+%-])[^\W_][\w.+%-]{0,80}@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
# Words for the signs of an address, in brackets and (the second of each) also bare.
_AT_WORDS, _AT_BARE = "at|собака|chez|arobase|ät", "at|собака|arobase"
_DOT_WORDS, _DOT_BARE = "dot|точка|punkt|point", "dot|точка"
_AT = rf"(?:\s*[\[({{<]\s*(?:{_AT_WORDS})\s*[\])}}>]\s*|\s+(?:{_AT_BARE})\s+|\s*@\s*)"
_DOT = rf"(?:\s*[\[({{<]\s*(?:{_DOT_WORDS})\s*[\])}}>]\s*|\s+(?:{_DOT_BARE})\s+|\.)"
WRITTEN_EMAIL = re.compile(rf"(?<![\w.+@-])[^\W_][\w.+-]{{0,80}}{_AT}[^\W_][\w-]*(?:{_DOT}[^\W_][\w-]*)+", re.I)
#: What only a written-out address has; a bare 'at' before a domain is none.
_BARE = tuple(sorted({*_AT_BARE.split("|"), *_DOT_BARE.split("|")} - {"at"}))
_BRACKETED = rf"[\[({{<]\s*(?:{_AT_WORDS}|{_DOT_WORDS})\s*[\])}}>]"
BRACKETED_SIGN = re.compile(_BRACKETED, re.I)
WRITTEN_SIGN = re.compile(rf"{_BRACKETED}|\s(?:{'|'.join(_BARE)})\s", re.I)

NUMBERS = re.compile(r"[+(]?\d[\d ().\-]{7,}\d")
PHONES = re.compile(
    r"(?<![\w+.-])(?:\+\d{11,13}|\+\d{1,3} \(\d{1,4}\) \d{2,4}(?:[- ]\d{2,4}){1,3}|\+\d{1,3}(?:[ .-]\d{1,6}){2,6}|00\d{1,3}(?:[ .-]\d{1,6}){2,6}|8 ?\(\d{3}\) ?\d{3}-\d{2}-\d{2}"
    r"|8[ -]\d{3}[ -]\d{3}[ -]\d{2}[ -]\d{2}|0\d{4} \d{6}|0\d(?:[. ]\d{2}){4}|\(\d{3}\) \d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?![\w-]|\.\d)"
)
IDS = re.compile(r"(?<![\w+.,-])(?:\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{3} \d{3} \d{3} \d{2}|\d{2} \d{2} \d{6}|\d{4} \d{6}|\d{10,12})(?![\w-]|[.,]\d)")

#: Numbers known by their shape and check digits or by the word before them.
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])")
SOCIAL = re.compile(r"(?<![\w.+-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-]|\.\d)")
PASSPORT = re.compile(r"(?i:passport|passeport|reisepass|personalausweis|identity card|id card|carte d'identité|паспорт\w*)(?i:\s*(?:no\.?|number|nr\.?|nummer|numéro|n°|№|номер|is|:|#)){0,3}\s*([A-Z]{1,3}[ -]?\d{6,9}|\d{2}[A-Z]{2}\d{5}|[CFGHJKLMNPRTVWXYZ][0-9CFGHJKLMNPRTVWXYZ]{8})(?![\w-])")
PASSPORT_SIGNS = ("passp", "passe", "reisepass", "ausweis", "identity card", "id card", "identité", "паспорт")


def valid_iban(value: str) -> bool:
    """Check digits by ISO 13616: the moved-round number modulo 97 is 1."""
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


_TYPES = r"(?i:Street|St\.|Road|Rd\.|Lane|Avenue|Ave\b\.?|Row|Square|Sq\.|Drive|Court|Close|Way|Terrace)"
_NAMED = r"[A-ZÀ-Þ][\w'’-]*"
_PLACE = rf"{_NAMED}(?: {_NAMED})?"
ADDRESSES = [
    ((" row", " square", " street", "st.", " road", " lane", " ave", " rd.", " sq.", " drive", " court", " close", " way", " terrace"),
     re.compile(rf"(?<![\w-])(?:\d{{1,4}}[A-Za-z]? (?:{_NAMED} ){{1,3}}{_TYPES}(?:, (?i:Flat|Apt\.?|Apartment) \d+\w?)?(?:, {_NAMED}(?: \d{{5}})?(?![\w]))?|(?:{_NAMED} ){{1,3}}{_TYPES} \d{{1,4}}[A-Za-z]?(?:, (?i:Flat|Apt\.?) \d+)?, \d{{5}} {_NAMED})")),
    ((" rue ", " avenue ", " boulevard ", " place ", " chemin "), re.compile(rf"(?<![\w-])\d{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin) (?:de la |de l'|des |du |de |d')?{_PLACE}(?:, (?:appt|app\.|apt) \d+)?(?:, \d{{5}} {_NAMED})?", re.I)),
    (("ул.", "улица", "проспект", "пр-т", "пер.", "переулок"), re.compile(r"(?<!\w)(?:\d{6}, )?(?:г\. [А-ЯЁ][\w-]+, )?(?:ул\.|улица|проспект|пр-т|пер\.|переулок) [А-ЯЁ][\w-]*(?: [А-ЯЁ][\w-]*)?(?:,? (?:д\.|дом) ?\d+\w?(?:, (?:кв\.|квартира) ?\d+)?| \d+\w?(?:-\d+)?)", re.I)),
    (("via ", "viale ", "piazza ", "corso ", "calle ", "avenida ", "rua "), re.compile(rf"(?<![\w-])(?:Via|Viale|Piazza|Corso|Calle|Avenida|Rua) (?:(?:dei|della|delle|del|di|de|da|do|la) )*{_NAMED}(?: {_NAMED}){{0,2}},? \d{{1,4}}[A-Za-z]?(?:, \d{{5}} {_NAMED})?")),
    (("straße", "strasse", "str.", "weg ", "gasse", "platz ", "allee"), re.compile(rf"(?<!\w)[A-ZÀ-Þ][\w-]*(?:straße|strasse|str\.|weg|gasse|platz|allee) \d{{1,4}}[A-Za-z]?(?:, (?:Wohnung|Whg\.) \d+)?(?:, \d{{5}} {_NAMED})?", re.I)),
]

_UP = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_W = rf"[{_UP}](?:[^\W\d_]|[̀-ͯ]|['’](?=[^\W\d_]))+(?:-[{_UP}](?:[^\W\d_]|[̀-ͯ])+)?"
_I = rf"[{_UP}]\.(?:-[{_UP}]\.)?"
NAME = rf"(?:{_I} ?{_I} ?{_W}|{_I} ?{_W}|{_W},? {_I}(?: ?{_I})?(?! ?[^\W\d_])|{_W}, {_W}(?: {_I})?|{_W}(?: {_I}){{1,2}} {_W}|{_W}(?: {_W}){{0,2}})"
TITLES = r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|г-н|г-жа|д-р|проф)\.? )*"
#: Words that stand before a name, and words that stand after one. Names are taken only beside them.
BEFORE = [
    "signed:", "signed by", "please forward this to", "the person is called", "identity number of", "our colleague", "contact", "contact :", "contact:", "contact person:", "tenant", "attn:",
    "signé par", "signé :", "la personne s'appelle", "notre collègue", "locataire", "gezeichnet", "ansprechpartner ist", "ansprechpartnerin ist", "unser kollege", "unsere kollegin", "mieter", "mieterin",
    "контактное лицо:", "подпись:", "фамилия", "наш коллега", "жилец", "звонил", "звонила",
]
AFTER = ["took the minutes", "reported the fault", "and asks for a call back", "lives at"]
_NOT_NAMES = frozenset("the a an our this that under with and or for of if in on at all any each no please signed contact tenant tel fax mail phone telefon flat invoice".split())
_BEFORE = {c: re.compile(rf"(?<!\w)(?i:{re.escape(c)})\s+(?i:{TITLES})({NAME})") for c in BEFORE}
_AFTER = {c: re.compile(rf"(?<![\w.'’-])(?i:{TITLES})({NAME})\s+(?i:{re.escape(c)})") for c in AFTER}
#: Evidence that needs no phrase. Titles, salutations and author lines, endings of patronymics.
_TITLE = r"(?:(?:Mrs?|Ms|Dr|Prof)\b\.?|(?:Miss|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|господин[уа]?|госпож[аеу])\b|(?:г-н|г-ж|д-р)[ауе]?\b|проф\.|Проф\.|Господин[уа]?\b|Госпож[аеу]\b)"
_BY = r"(?:Dear|[Ww]ritten by|[Aa]uthors?:|[Aa]uteure? ?:|[Aa]utor(?:in)?:|[Вв]едущий:|[Аа]втор:|Уважаем(?:ый|ая)|Sehr geehrter?|Ch(?:er|ère)|Lieber?)"
GENERAL = [
    (("mr", "ms", "miss", "dr", "prof", "herr", "frau", "mme", "mlle", "monsieur", "madame", "господин", "госпож", "г-н", "г-ж", "д-р", "проф"),
     re.compile(rf"(?<![\w-])(?:{_TITLE} )+({NAME})")),
    (("dear", "written by", "author", "auteur", "autor", "ведущий", "автор", "важаем", "geehrte", "cher ", "chère", "liebe"), re.compile(rf"(?<![\w-]){_BY} (?:{_TITLE} )*({NAME})")),
    ((".",), re.compile(rf"(?<![\w.-])({_I} ?{_I} ?{_W}|{_W} [{_UP}]\. ?[{_UP}]\.)(?![\w-])")),
    (("вич", "вна", "вны", "вне", "вну", "ичем"), re.compile(rf"(?<![\w-])((?:{_W} )?{_W} [А-ЯЁ][а-яё]+(?:вич(?:а|у|ем|е)?|вн(?:а|ы|е|у|ой))(?: {_W})?)(?![\w-])")),
]
# Given names that are frequent in the four languages. With a surname after one of them no other evidence is needed.
GIVEN = (
    "Adam Alan Albert Alex Alexander Alfred Alice Amanda Amy Andrea Andreas Andrew Angela Anja Anna Anne Anton Antoine Arthur Barbara Benjamin Bernard Bernd Brian Camille Carl Carla Catherine Charles Charlotte "
    "Christian Christine Christoph Claire Claudia Daniel David Diana Dieter Dmitri Dorothea Edward Elena Elisabeth Elizabeth Emily Emma Eric Erik Eva Florian François Frank Franz Friedrich Gabriele George Georg "
    "Hannah Hans Heinrich Helen Helga Henri Henry Igor Ingrid Irina Isabelle Ivan Jacques Jakob James Jan Jane Jean Jennifer Jessica Johann John Jonas Joseph Julia Julie Jürgen Karin Karl Katharina Kevin Klaus Laura "
    "Linda Louis Louise Lucas Lukas Maria Marie Mark Markus Martin Mary Matthew Matthias Michael Michel Monika Natalia Nicole Nikolai Olga Oliver Oscar Patricia Patrick Paul Paula Peter Petra Philip Philippe Pierre "
    "Rachel Ralf Rebecca Richard Robert Sabine Samuel Sandra Sarah Sergei Sophie Stefan Stephanie Stephen Susan Susanne Svetlana Thomas Tatiana Ursula Uwe Victor Werner William Wolfgang"
).split()
GIVEN_CYRILLIC = "Александр Алексей Анастасия Андрей Анна Антон Виктор Виктория Владимир Галина Дарья Дмитрий Евгений Екатерина Елена Иван Игорь Ирина Ксения Людмила Максим Мария Михаил Наталья Николай Ольга Павел Пётр Сергей Светлана Татьяна Юлия Юрий".split()
_FIRM = r"(?! ?(?:&|und Söhne|and Sons|et Fils|GmbH|AG\b|KG\b|Ltd|LLC|Inc|Corp|plc|SA\b|SARL|S\.A\.|Street|St\.|Road|Avenue|Lane|Square|Hotel|Hospital|Bank|School))"
_NO_SURNAME = r"(?!(?:Street|St|Road|Avenue|Lane|Square|Way|Court|Drive|Hotel|Hospital|School|Bank|Luther King)\b)"
_KEEL = r"(?<!\bMS )(?<!\bSS )(?<!\bMV )(?<!\bship )(?<!\bvessel )(?<!\bSchiff )(?<!\bHotel )(?<!\bnavire )(?<!судно )(?<!теплоход )(?<!\bSt\. )(?<!\bSankt )"
_GIVEN = frozenset(GIVEN + GIVEN_CYRILLIC)
_GIVEN_WORD = re.compile(r"[%s][^\W\d_]+(?=[ -])" % "".join(sorted({w[0] for w in _GIVEN})))
GIVEN_NAME = re.compile(rf"(?<![\w.'’-]){_KEEL}((?:{'|'.join(GIVEN + GIVEN_CYRILLIC)})(?:-[{_UP}][^\W\d_]+)?(?: {_I}){{0,2}} {_NO_SURNAME}{_W}(?:-{_W})?)(?![\w-]){_FIRM}")
#: Words at the end of a letter and of minutes, before a name of at least two words.
CLOSING = re.compile(rf"(?i:kind regards|best regards|regards|yours sincerely|yours faithfully|sincerely|freundlichen grüßen|freundliche grüße|cordialement|bien à vous|с уважением|(?:taken|prepared|written|checked|approved|reported|submitted) by|protokoll:|geprüft von|erstellt von|rédigé par|составил[аи]?|подготовил[аи]?)[,:]?\s+({_W}(?: {_I}){{0,2}} {_W}(?:-{_W})?)(?![\w-]){_FIRM}")
#: What its matches begin with.
CLOSING_CUES = (
    "kind regards", "best regards", "regards", "yours sincerely", "yours faithfully", "sincerely", "freundlichen grüßen", "freundliche grüße", "cordialement", "bien à vous", "с уважением",
    "taken by", "prepared by", "written by", "checked by", "approved by", "reported by", "submitted by", "protokoll:", "geprüft von", "erstellt von", "rédigé par", "составил", "подготовил",
)
CLOSINGS = ("regards", "sincerely", "faithfully", " grü", "cordialement", "bien à vous", "уважением", " by ", "protokoll:", " von ", "rédigé par", "составил", "подготовил")
_NO_PERSONS = frozenset("sir sirs madam madame all team customer customers colleague colleagues friend friends reader readers damen herren herr frau kollegen kunden client clients collègues коллеги друзья господа клиенты".split())
_LEAD = re.compile(r"^(?:(?:Tenant|Our|The|Contact|Colleague|Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme)\.? )+", re.I)


def _names(text: str, low: str) -> Iterator[tuple[int, int]]:
    for table, cues in ((_BEFORE, BEFORE), (_AFTER, AFTER)):
        for cue in cues:
            if cue not in low:
                continue
            for m in table[cue].finditer(text):
                a, b = m.span(1)
                value = text[a:b]
                if lead := _LEAD.match(value):
                    a += lead.end()
                    value = text[a:b]
                first = value.split(" ")[0].strip(",").lower()
                if value and first not in _NOT_NAMES:
                    yield a, b


def _matches(pattern: re.Pattern[str], text: str, starts: Iterable[int]) -> Iterator[re.Match[str]]:
    """What `finditer` gives, for all places in ascending order where a match may begin."""
    end = 0
    for a in starts:
        if a >= end and (m := pattern.match(text, a)):
            end = m.end()
            yield m


def _general(text: str, low: str) -> Iterator[tuple[int, int]]:
    """Names by titles, salutations, initials, patronymics, given names and closings."""
    for m in _matches(GIVEN_NAME, text, (w.start() for w in _GIVEN_WORD.finditer(text) if w[0] in _GIVEN)):
        a, b = m.span(1)
        yield a, b - 2 if text[b - 2 : b] in ("'s", "’s") else b
    if any(c in low for c in CLOSINGS):
        whole = len(low) != len(text) or _odd_case(text)
        for m in CLOSING.finditer(text) if whole else _matches(CLOSING, text, sorted({a for a, _ in _places(low, CLOSING_CUES)})):
            if not {w.lower() for w in m[1].split()} & (_NOT_NAMES | _NO_PERSONS):
                yield m.span(1)
    for anchors, pattern in GENERAL:
        if any(a in low for a in anchors):
            for m in pattern.finditer(text):
                words = m[1].lower().replace(",", " ").split()
                if words[0] not in _NOT_NAMES and words[0] not in _NO_PERSONS:
                    yield m.span(1)


def _places(low: str, anchors: tuple[str, ...]) -> list[tuple[int, int]]:
    at = []
    for a in anchors:
        i = low.find(a)
        while i >= 0:
            at.append((i, i + len(a)))
            i = low.find(a, i + 1)
    return at


def _near(low: str, anchors: tuple[str, ...], before: int, after: int) -> list[tuple[int, int]]:
    """Windows around the anchors, joined where they overlap. Patterns run inside them, so their work is bounded."""
    return _windows(_places(low, anchors), before, after)


def _windows(at: list[tuple[int, int]], before: int, after: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((max(0, a - before), b + after) for a, b in at):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def detect(text: str | None) -> list[Span]:
    """Spans in code points of the text as stored, by start. Null and blank texts have none. Spans don't overlap."""
    if not text or text.isspace():
        return []
    t = Text(text)
    t.characters()
    t.scripts()
    t.markup()
    t.spelled()
    t.lines()
    s = t.out
    low = s.lower()
    found: list[tuple[int, int, int, str]] = []  # the third puts surer kinds first
    for a, b in _near(low, ("@",), 100, 160):
        found += [(m.start(), m.end(), 0, "EMAIL") for m in EMAIL.finditer(s, a, b)]
    signs = [m.span() for m in BRACKETED_SIGN.finditer(s)] + _places(low, _BARE)
    for a, b in _windows(signs, 120, 160):
        found += [(m.start(), m.end(), 1, "EMAIL") for m in WRITTEN_EMAIL.finditer(s, a, b) if WRITTEN_SIGN.search(m[0])]
    for anchors, pattern in ADDRESSES:
        for a, b in _near(low, anchors, 70, 70):
            found += [(m.start(), m.end(), 2, "ADDRESS") for m in pattern.finditer(s, a, b)]
    found += [(m.start(), m.end(), 2, "ID_NUMBER") for m in IBAN.finditer(s) if valid_iban(m[0])]
    found += [(m.start(), m.end(), 3, "ID_NUMBER") for m in SOCIAL.finditer(s)]
    if any(w in low for w in PASSPORT_SIGNS):
        found += [(*m.span(1), 3, "ID_NUMBER") for m in PASSPORT.finditer(s)]
    for m in NUMBERS.finditer(s):
        a, b = max(0, m.start() - 1), m.end() + 2
        piece = s[a:b]
        for kind, order, pattern in (("PHONE", 3, PHONES), ("ID_NUMBER", 3, IDS)):
            found += [(a + x.start(), a + x.end(), order, kind) for x in pattern.finditer(piece)]
    found += [(a, b, 5, "NAME") for a, b in _names(s, low)]
    found += [(a, b, 6, "NAME") for a, b in _general(s, low)]
    out: list[Span] = []
    taken: list[tuple[int, int]] = []
    for a, b, _, kind in sorted(found, key=lambda f: (f[2], f[0] - f[1], f[0])):
        if all(b <= c or a >= d for c, d in taken):
            taken.append((a, b))
            out.append(Span(*t.back(a, b), kind))
    return sorted(out)


def redact(text: str | None) -> str | None:
    """The text with each piece of personal data replaced by its type in brackets; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in detect(text):
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def found(df: DataFrame, record: str, column: str, name: str) -> DataFrame:
    """(table_name, record_key, pii_type, char_start, char_end) of each piece; equal rows of one key count once."""

    @F.pandas_udf("array<struct<char_start:int,char_end:int,pii_type:string>>")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: [{"char_start": a, "char_end": b, "pii_type": k} for a, b, k in detect(t)])

    rows = df.where(F.col(column).isNotNull() & F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record_key"), F.explode(spans(F.col(column))).alias("s"))
    return rows.select(F.lit(name).alias("table_name"), "record_key", "s.pii_type", "s.char_start", "s.char_end").distinct()


def redacted(df: DataFrame, column: str) -> DataFrame:
    """`df` with placeholders in `column`; other columns untouched."""

    @F.pandas_udf("string")
    def text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(redact, na_action="ignore")

    return df.withColumn(column, text(F.col(column)))
