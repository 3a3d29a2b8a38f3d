"""Markup residue in texts (problem 6): which languages a text holds, and the clean text with its structure kept.

A text is cut into blocks at blank lines. In the first pass signs that only one language has, stop-word density,
length and link density decide blocks: a block is of one or more languages, prose, or undecided. In the second
pass undecided blocks with signs that several languages share ('# ', '* ', a tag on a line of its own) inherit the
language of the nearest decided neighbour; without one such a sign stays plain text, or stands for its own
language where it has one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .lookalike import lookalikes

KINDS = ("html", "markdown", "wiki", "latex")

# Names of HTML elements and of LaTeX commands, and frequent function words of the four languages.
ELEMENTS = (
    "a abbr article aside b blockquote body br button caption center code col dd del details div dl dt em figure font footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html i iframe img input ins label li link main meta nav ol option p pre q s samp script section select small span strike strong style "
    "sub summary sup svg table tbody td textarea tfoot th thead title tr tt u ul video"
).split()
COMMANDS = (
    "begin end item textbf emph texttt textit textsc underline section subsection subsubsection paragraph chapter documentclass usepackage title author "
    "maketitle label ref cite footnote caption includegraphics centering frac sqrt sum prod int leq geq neq alpha beta gamma delta lambda sigma cdot times "
    "left right infty partial mathrm mathbf hline newline linebreak tableofcontents url href"
).split()
STOP_WORDS = frozenset(
    "the a of and to in is was by for on with at as it that are be from or not this were has had which their after before between each "
    "и в на с по из за не что для до от как к у о при или его был была это все "
    "der die das und in zu den mit von für auf ist im nicht ein eine des dem wurde werden bei nach über "
    "le la les de des du et en un une est à pour que dans sur par au pas avec ce sont".split()
)

TAG = re.compile(r"</?(?:%s)(?:\s[^<>]*)?/?>" % "|".join(ELEMENTS), re.I)
ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}\d{0,2}|#\d{2,6}|#[xX][0-9a-fA-F]{2,5});")
COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>", re.S)
ANY_TAG = re.compile(r"<(?:[A-Za-z][\w:-]*(?:\s+[\w:-]+=(?:\"[^\"<>\n]*\"|'[^'<>\n]*'))+\s*/?|/[A-Za-z][\w:-]*\s*)>")
NAME = re.compile(r"</?([A-Za-z][\w:-]*)")
# HTML elements that the languages have as signs of their own.
OWN_TAGS = {"markdown": frozenset(["br"]), "wiki": frozenset("br ref references nowiki small sub sup s u gallery blockquote math code pre".split())}
MARKER = re.compile(r"\[\[[A-Z]+_\d{4}\]\]")
PROJECT = re.compile(r"\[(?:PAGE_BREAK|NOTES|SLIDE \d+)\]|\[SHEET\][^\n]*")

STRONG = {
    "markdown": re.compile(
        r"^#{2,6} \S|^ {0,3}(?:```|~~~)|\*\*(?=\S)[^*\n]+?(?<=\S)\*\*|(?<!\w)__(?=\S)[^_\n]+?__(?!\w)|!?\[[^\]\n]*\]\([^)\s]+\)|^[^\n]*\w[^\n]*\n(?:={3,}|-{3,})$|^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|$"
        r"|^> \S|(?<!`)`[^`\n]+`(?!`)|~~(?=\S)[^~\n]+~~|^\s*[-*+] \[[ xX]\] |(?<![\w_])_(?=[^\W_])[^_\n]{1,80}(?<=[^\W_])_(?![\w_])|(?<![\w*])\*(?=[^\W\d_])[^*\n]{1,80}(?<=[^\W\d_])\*(?![\w*])",
        re.M,
    ),
    "wiki": re.compile(r"\[\[(?![A-Z]+_\d+\]\])[^\[\]\n]+\]\]|\{\{[^{}\n]+\}\}|^(={2,6})[^=\n]*\w[^=\n]*\1\s*$|'''?(?=[^\s'])[^\n]+?'''?(?!\w)|^\{\||^\|\}|__(?:TOC|NOTOC)__", re.M),
    "latex": re.compile(r"\\(?:%s)(?![A-Za-z])\*?|\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|\{\\[A-Za-z]{2,} [^{}\n]*\}|(?<![\w$])\$(?=\S)[^$\n]{0,200}[\^_][^$\n]{0,200}(?<=\S)\$(?![\w$])|\$\$[^$\n]+\$\$|\$[^$\n]*\\[A-Za-z][^$\n]*\$" % "|".join(COMMANDS)),
}
#: One of these substrings is in every match of the language's patterns; they only save time.
GATES = {
    "html": ("<", "&"),
    "markdown": ("# ", "~~", "*", "_", "](", "===", "---", "> ", "`", "- [", "+ ["),
    "wiki": ("[[", "{{", "==", "''", "{|", "|}", "__"),
    "latex": ("\\", "$"),
}
WEAK = {"markdown": re.compile(r"^(?:# |[-*+] )\S", re.M), "wiki": re.compile(r"^[*#:;]+ ?\S", re.M)}
LINK = re.compile(r"https?://\S+|<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\s]*\)", re.S)
DOLLARS = re.compile(r"\$\$[^$]+\$\$|\$[^$\n]+\$")
WORD = re.compile(r"[^\W\d_]+")
#: A block of at least this many letters can be decided as prose; its share of stop words must reach the second figure.
PROSE_LETTERS, PROSE_STOP_WORDS, LINK_DENSITY = 70, 0.15, 0.3
PROGRAM = re.compile(r"^\s*(?:def |return\b|for .*:$|if .*[:{]$|SELECT\b|FROM\b|WHERE\b|import |class |\w+\(.*\);?$|\w+: \S)", re.M)


class Block(NamedTuple):
    text: str
    kinds: frozenset[str]  #: languages decided by strong signs
    label: str  #: 'markup', 'prose', 'links' or 'undecided'


def plain_signs(text: str) -> str:
    """Full-width signs and invisible characters are put right before signs are looked for."""
    return text if text.isascii() else lookalikes().rewrite(text) if UNUSUAL.search(text) else text


UNUSUAL = re.compile("[\xad​-‏⁠﻿＀-～̀-ͯ]")


def _first_pass(text: str) -> Block:
    kinds = {kind for kind, pattern in STRONG.items() if any(g in text for g in GATES[kind]) and pattern.search(text)}
    if "<" in text and (COMMENT.search(text) or TAG.search(text) or ANY_TAG.search(text)) or "&" in text and ENTITY.search(text):
        kinds.add("html")
    if kinds:
        return Block(text, frozenset(kinds), "markup")
    linked = sum(map(len, LINK.findall(text))) if "http" in text else 0
    if linked > LINK_DENSITY * max(1, len(text)):
        return Block(text, frozenset(), "links")
    words = WORD.findall(text.lower())
    if sum(map(len, words)) >= PROSE_LETTERS and sum(w in STOP_WORDS for w in words) >= PROSE_STOP_WORDS * len(words):
        return Block(text, frozenset(), "prose")
    return Block(text, frozenset(), "undecided")


def _own(block: Block) -> frozenset[str]:
    """What an undecided block's shared signs could mean."""
    if PROGRAM.search(block.text):
        return frozenset()
    return frozenset(kind for kind, pattern in WEAK.items() if pattern.search(block.text))


#: Shared signs that are a language's own where no block decides: a heading and a list, each a paragraph of its own.
TITLE, LIST = re.compile(r"^# \S[^\n]*$"), re.compile(r"^(?:[-*+] \S[^\n]*(?:\n|$)){2,}")


def blocks_of(text: str) -> list[Block]:
    """Blocks with their labels after both passes."""
    blocks = [_first_pass(b) for b in re.split(r"\n[ \t]*\n", text)]
    decided = [i for i, b in enumerate(blocks) if b.kinds]
    out = []
    for i, b in enumerate(blocks):
        if b.label in ("undecided", "links") and (may := _own(b)):
            near = sorted(decided, key=lambda j: (abs(i - j), j))
            taken = next((blocks[j].kinds & may for j in near if blocks[j].kinds & may), frozenset())
            if taken:
                b = Block(b.text, taken, "markup")
        out.append(b)
    if not decided and any(TITLE.match(b.text) for b in out) and any(LIST.match(b.text.strip("\n")) for b in out):
        out = [Block(b.text, frozenset({"markdown"}), "markup") if TITLE.match(b.text) or LIST.match(b.text) else b for b in out]
    return out


def _foreign_html(text: str, others: set[str]) -> bool:
    """Whether a text of another language has HTML that isn't that language's own."""
    own = frozenset().union(*(OWN_TAGS[k] for k in others))
    return bool(COMMENT.search(text)) or any(NAME.match(m[0])[1].lower() not in own for p in (TAG, ANY_TAG) for m in p.finditer(text))


def kinds_of(text: str | None) -> list[str]:
    """The markup languages of a text, in the order of KINDS. Null, empty and blank texts have none."""
    if not text:
        return []
    text = plain_signs(text)
    found: set[str] = set()
    for b in blocks_of(text):
        found |= b.kinds
    if "html" in found and (others := found & OWN_TAGS.keys()) and not _foreign_html(text, others):
        found.discard("html")
    if {"markdown", "latex"} <= found and not STRONG["latex"].search(DOLLARS.sub(" ", text)):  # Markdown has formulas between dollars
        found.discard("latex")
    return [k for k in KINDS if k in found]


# --- Clean text ---

CODE = re.compile(
    r"^ {0,3}(?:```|~~~)[^\n]*\n(?P<md>.*?)^ {0,3}(?:```|~~~)[ \t]*$|<pre[^>]*>(?:\s*<code[^>]*>)?(?P<html>.*?)(?:</code>\s*)?(?:</pre>|\Z)|\\begin\{(?:verbatim|lstlisting)\}\n?(?P<tex>.*?)\\end\{(?:verbatim|lstlisting)\}",
    re.S | re.M | re.I,
)
FORMULA = re.compile(r"\$\$(.+?)\$\$|\\begin\{(?:equation|align|displaymath)\*?\}(.+?)\\end\{(?:equation|align|displaymath)\*?\}|\$([^$\n]*\\[^$\n]*)\$", re.S)
RULES: dict[str, list[tuple[re.Pattern[str], str]]] = {
    "html": [
        (COMMENT, ""),
        (re.compile(r"<(script|style|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I), ""),
        (re.compile(r"[ \t]*<li\b[^>]*>\s*", re.I), "\n• "),
        (re.compile(r"<h[1-6]\b[^>]*>|</h[1-6]>|</?(?:p|div|table|ul|ol|dl|body|blockquote|section|article|title|head|header|footer|nav)\b[^<>]*>", re.I), "\n\n"),
        (re.compile(r"<br\s*/?>[ \t]*\n?|</?tr\b[^<>]*>|</?(?:dt|dd|option|hr)\b[^<>]*>", re.I), "\n"),
        (re.compile(r"</t[dh]>\s*<t[dh]\b[^<>]*>", re.I), "\t"),
        (TAG, ""),
    ],
    "markdown": [
        (re.compile(r"^(?:={3,}|-{3,})[ \t]*$\n?", re.M), ""),
        (re.compile(r"^#{1,6} +(.*?)(?: +#+)?[ \t]*$", re.M), r"\1"),
        (re.compile(r"^(?:> ?)+", re.M), ""),
        (re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|[ \t]*$\n?", re.M), ""),
        (re.compile(r"^\| ?(.*?) ?\|[ \t]*$", re.M), r"\1"),
        (re.compile(r"^(\s*)[-*+] (?:\[[ xX]\] )?", re.M), r"\1• "),
        (re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*(?: \"[^\"]*\")?\)"), r"\1"),
        (re.compile(r"(\*\*\*|\*\*|~~|__)(?=\S)([^\n]+?)(?<=\S)\1"), r"\2"),
        (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), r"\1"),
        (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]{1,80}?)(?<=\S)\*(?![\w*])"), r"\1"),
        (re.compile(r"(?<![\w_])_(?=[^\W_])([^_\n]{1,80}?)(?<=[^\W_])_(?![\w_])"), r"\1"),
    ],
    "wiki": [
        (re.compile(r"\[\[(?:Category|File|Image|Datei|Fichier|Файл|Категория):[^\[\]]*\]\]", re.I), ""),
        (re.compile(r"\{\{(?:Infobox|Navbox|Taxobox)[^{}]*\}\}\n?", re.I), ""),
        (re.compile(r"\{\{[^{}|\n]*\|([^{}|\n]*)[^{}\n]*\}\}"), r"\1"),
        (re.compile(r"\{\{[^{}\n]*\}\}"), ""),
        (re.compile(r"\[\[(?![A-Z]+_\d+\]\])(?:[^\[\]\n|]*\|)?([^\[\]\n|]+)\]\]"), r"\1"),
        (re.compile(r"\[https?://\S+ ([^\]\n]+)\]"), r"\1"),
        (re.compile(r"'{2,5}(?=[^\s'])([^\n]+?)'{2,5}"), r"\1"),
        (re.compile(r"^(={2,6})[ \t]*([^=\n]*\w[^=\n]*?)[ \t]*\1[ \t]*$", re.M), r"\2"),
        (re.compile(r"^(?:\{\|.*|\|\}|\|-.*)$\n?", re.M), ""),
        (re.compile(r"^[!|] ?", re.M), ""),
        (re.compile(r" ?(?:!!|\|\|) ?"), "\t"),
        (re.compile(r"^[*#:;]+ ?(?=\S)", re.M), "• "),
    ],
    "latex": [
        (re.compile(r"(?<![\\\d])%.*$\n?", re.M), ""),  # after a digit it is a per cent sign
        (re.compile(r"\\(?:usepackage|documentclass|includegraphics)\*?(?:\[[^\]]*\])?\{[^{}]*\}\n?"), ""),
        (re.compile(r"\\(?:footnote|cite|label|ref)\*?(?:\[[^\]]*\])?\{[^{}]*\}"), ""),
        (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?\n?"), ""),
        (re.compile(r"^[ \t]*\\item(?:\[[^\]]*\])?[ \t]*", re.M), "• "),
        (re.compile(r"\\(?:maketitle|centering|tableofcontents|hline|newline|linebreak)\b"), ""),
        (re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}"), r"\1"),
        (re.compile(r"(?<=\S)~(?=\s)"), ""),
        (re.compile(r"~"), " "),
        (re.compile(r"\\([%&_#${}])"), r"\1"),
        (re.compile(r"\\\\(?:\[[^\]]*\])?"), "\n"),
    ],
}


def clean(text: str | None, kinds: list[str] | None = None) -> str | None:
    """The text as a reader sees it: no markup; headings and list items on lines of their own, code and formulas as they are.

    Null stays null. A text without markup comes back as it is. Project markers stay.
    """
    kinds = kinds_of(text) if kinds is None else kinds
    if not kinds:
        return text
    text = plain_signs(text)
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    def code(m: re.Match[str]) -> str:
        own = next(g for g in m.groups() if g is not None) if any(g is not None for g in m.groups()) else ""
        return "\n\n" + keep(html.unescape(own) if m.lastgroup == "html" else own) + "\n\n"

    if "```" in text or "~~~" in text or "\\begin{" in text or "<pre" in text.lower():
        text = CODE.sub(code, text)
    if "latex" in kinds or "markdown" in kinds:
        text = FORMULA.sub(lambda m: keep(next(g for g in m.groups() if g is not None).strip()), text)
    for kind in ("html", "wiki", "latex", "markdown"):
        if kind in kinds or kind == "html" and "markdown" in kinds:
            for pattern, new in RULES[kind]:
                text = pattern.sub(new, text)
    if "html" in kinds:
        text = html.unescape(text)
    for n in range(len(kept) - 1, -1, -1):
        text = text.replace(f"\x00{n}\x00", kept[n])
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+\n", "\n\n", text).strip("\n")


def found(df: DataFrame, record: str, column: str) -> DataFrame:
    """(record, markup): one row for each language in a text. Equal rows of one id count once."""

    @F.pandas_udf("array<string>")
    def languages(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(kinds_of)

    return df.where(F.col(column).isNotNull()).select(F.col(record), F.explode(languages(F.col(column))).alias("markup")).distinct()


def cleaned(df: DataFrame, column: str) -> DataFrame:
    """`df` with `column` as clean text; other columns untouched."""

    @F.pandas_udf("string")
    def text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(clean, na_action="ignore")

    return df.withColumn(column, text(F.col(column)))
