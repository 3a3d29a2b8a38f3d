"""Token ids of a public byte-level BPE vocabulary (problem 7).

The merges are compiled into a finite-state transducer that is determinised lazily: a state is the longest suffix of
the input that some token begins with, together with the last token of the encoding of each prefix that ends inside
that suffix. Reading one byte leads to one next state, which is computed once and kept. The last token of a prefix is
the longest suffix token that is compatible with the token before it, where two tokens are compatible if no merge
would join across them. A token is emitted as soon as all encodings still possible pass its end, after a lookahead
bounded by the longest token. The pattern that cuts a text into words limits a word's states further.

Decoding goes through an incremental UTF-8 decoder, so ids may arrive in any portions.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

#: Distinct words whose ids a worker keeps; beyond that it begins anew. Results don't depend on it.
KEPT_WORDS = 400_000
#: States kept; beyond that the transducer is determinised anew.
KEPT_STATES = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Transducer:
    """Encoder of byte strings by ranked merges."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.longest = max(self.size.values())
        # the order of merges: by rank, single bytes first whatever their ids
        self.order = {i: (0, n) if (n := self.size[i]) == 1 else (1, i) for i in self.token}
        self.starts = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.reset()

    def reset(self) -> None:
        #: of each state: suffix, last tokens at its inner prefixes and its end
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-1,))]
        self.number = {self.states[0]: 0}
        self.step: list[dict[int, int]] = [{}]
        self.fits: dict[tuple[int, int], bool] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for single bytes."""
        if token not in self.parts:
            text = self.token[token]
            self.parts[token] = None if len(text) == 1 else self._merged(text, self.ranks[text])
        return self.parts[token]

    def _merged(self, text: bytes, below: int) -> tuple[int, int]:
        """The last two parts left when only merges ranked before `below` are applied."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) != 2:
            raise ValueError("a token is not made by merging two others")
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        if left < 0:
            return True
        # what merges could have joined across the border at any time: the right edge of `left`, the left edge of `right`
        a, a_until, b, b_until = left, 1 << 30, right, 1 << 30
        while True:
            joined = self.ranks.get(self.token[a] + self.token[b])
            # both edges exist until the first of them is merged into something larger
            if joined is not None and (joined < min(a_until, b_until) or joined == min(a_until, b_until) and self._earlier(a, a_until, b_until)):
                return False
            sa, sb = self.split(a), self.split(b)
            if sa is None and sb is None:
                return True
            # undo the later of the two merges
            if sb is None or sa is not None and self.ranks[self.token[a]] >= self.ranks[self.token[b]]:
                a, a_until = sa[1], self.ranks[self.token[a]]
            else:
                b, b_until = sb[0], self.ranks[self.token[b]]

    @staticmethod
    def _earlier(a: int, a_until: int, b_until: int) -> bool:
        """Of equal merges the one further left comes first; the one across is right of that inside the left token."""
        return b_until < a_until

    def next(self, state: int, byte: int) -> int:
        to = self.step[state].get(byte)
        if to is None:
            suffix, last = self.states[state]
            text = suffix + bytes((byte,))
            while text not in self.starts:
                text = text[1:]
            # last[-1 - k] is the last token of the prefix that ends k bytes back
            found, ranks, fits = -1, self.ranks, self.fits
            for n in range(len(text), 0, -1):
                token = ranks.get(text[-n:])
                if token is None:
                    continue
                pair = (last[-n], token)
                good = fits.get(pair)
                if good is None:
                    good = fits[pair] = self.compatible(*pair)
                if good:
                    found = token
                    break
            if found < 0:
                raise ValueError("the vocabulary lacks single bytes")
            key = (text, (last + (found,))[-len(text) - 1 :])
            to = self.number.get(key)
            if to is None:
                to = self.number[key] = len(self.states)
                self.states.append(key)
                self.step.append({})
            self.step[state][byte] = to
        return to

    def encode(self, text: bytes) -> list[int]:
        if len(self.states) > KEPT_STATES:
            self.reset()
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        state, lasts, step, states = 0, [], self.step, self.states
        for byte in text:
            to = step[state].get(byte)
            state = self.next(state, byte) if to is None else to
            lasts.append(states[state][1][-1])
        out, at = [], len(text)
        while at:
            out.append(lasts[at - 1])
            at -= self.size[lasts[at - 1]]
        out.reverse()
        return out

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Tokens of one word whose bytes arrive one by one, each as soon as nothing to come can change it."""
        state, lasts, done = 0, [], 0  # lasts: of the prefixes from `done` on
        for byte in data:
            state = self.next(state, byte)
            lasts.append(self.states[state][1][-1])
            depth = len(self.states[state][0])
            ends: set[int] | None = None
            for back in range(depth + 1):  # the next token begins at one of the prefixes that end in the suffix
                at, chain = len(lasts) - back, []
                if at < 0:
                    break
                while at > 0:
                    chain.append(at)
                    at -= self.size[lasts[at - 1]]
                ends = set(chain) if ends is None else ends & set(chain)
            for end in sorted(ends or ()):
                yield lasts[end - 1]
            if ends:
                cut = max(ends)
                lasts = lasts[cut:]
        out, at = [], len(lasts)
        while at > 0:
            out.append(lasts[at - 1])
            at -= self.size[lasts[at - 1]]
        yield from reversed(out)


class Tokenizer:
    """A text's ids: words by the vocabulary's pattern, each through the transducer."""

    def __init__(self, path: str, pattern: str | None = None) -> None:
        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(ranks)
        self.words = regex.compile(pattern).findall
        self.kept: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; an empty list for empty and null texts."""
        if not text:
            return []
        out: list[int] = []
        kept = self.kept
        for word in self.words(text):
            ids = kept.get(word)
            if ids is None:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                ids = kept[word] = self.transducer.encode(word.encode("utf-8", "replace"))
            out += ids
        return out

    def decode(self, portions: Iterable[list[int]]) -> Iterator[str]:
        """The text of ids that arrive in portions; characters come out as soon as they are complete."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in portions:
            yield machine.decode(b"".join(self.transducer.token[i] for i in ids))
        yield machine.decode(b"", True)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encoded(df: DataFrame, record: str, column: str, path: str | None = None) -> DataFrame:
    """(record, ids) of every row. `path` names a vocabulary file that all executors can read."""
    path = path or vocabulary_path()

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = tokenizer(path).encode
        for batch in texts:
            yield batch.map(encode)

    return df.select(F.col(record), ids(F.col(column)).alias("ids"))
