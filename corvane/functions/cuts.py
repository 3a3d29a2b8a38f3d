"""Where texts are cut: boundary strengths and an index that answers which place in a window is strongest."""

from __future__ import annotations

import numpy as np

#: Separators from the strongest to the weakest.
SEPARATORS = ("\n\n", ". ", "\n", "; ", ", ", " ")
#: Code points of Unicode white space.
BLANKS = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def strengths(codes: np.ndarray) -> np.ndarray:
    """uint8 for each place 0..n: the strength of the best separator that ends there, 0 for none."""
    out = np.zeros(len(codes) + 1, np.uint8)
    n = len(SEPARATORS)
    for i, s in reversed(list(enumerate(SEPARATORS))):
        hit = codes == ord(s[-1])
        if len(s) == 2:
            hit = hit[1:] & (codes[:-1] == ord(s[0]))
        out[len(s) :][hit] = n - i
    return out


class Strongest:
    """Range-maximum index over strengths for windows of up to `widest` places. Ties go to the rightmost place."""

    def __init__(self, values: np.ndarray, widest: int) -> None:
        # the place breaks ties, so the rows hold places of maxima
        n = len(values)
        self.values = values
        self.rows = [np.arange(n, dtype=np.int32)]
        width = 1
        while width * 2 <= min(widest, n):
            a, b = self.rows[-1][: n - 2 * width + 1], self.rows[-1][width : n - width + 1]
            self.rows.append(np.where(values[b] >= values[a], b, a))
            width *= 2

    def __call__(self, first: int, last: int) -> int:
        """The strongest place of first..last."""
        k = (last - first + 1).bit_length() - 1
        a, b = int(self.rows[k][first]), int(self.rows[k][last + 1 - (1 << k)])
        return b if self.values[b] >= self.values[a] else a


def pieces(text: str, limit: int = 1000, overlap: int = 120, least: int = 80, share: float = 0.65, past_blanks: bool = False) -> list[tuple[int, int]]:
    """(start, end) of each piece in code points. A text without anything but blanks has none.

    A piece that has all that is left is the last. With `past_blanks` it is so only if it reaches the end of the text
    after the blanks at its end are dropped; where blanks end a text none does, and pieces follow from every further
    non-blank place within the overlap of the last one.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(codes, BLANKS) if not text.isascii() else (codes == 32) | ((codes >= 9) & (codes <= 13)) | ((codes >= 28) & (codes <= 31))
    solid = np.flatnonzero(~blank)
    if not len(solid):
        return []
    n, low = len(codes), max(least, int(share * limit))
    value = strengths(codes)
    index = Strongest(value, limit - low) if n > limit else None
    # the separator lies wholly in the window's part from `low` on: a longer one must end later
    out, at = [], 0
    while at < n:
        i = int(np.searchsorted(solid, at))
        if i == len(solid):
            break
        start = int(solid[i])
        if n - start <= limit:
            end = n
        else:
            end = _cut(value, index, start + low, start + limit)
        last = int(solid[np.searchsorted(solid, end) - 1]) + 1
        out.append((start, last))
        if last >= n or end >= n and not past_blanks:
            break
        at = max(last - overlap, start + 1)
    return out


def _cut(value: np.ndarray, index: Strongest, low: int, high: int) -> int:
    """The place to cut at: after a separator that lies in low..high, or high."""
    place = index(low + 1, high)
    strength = int(value[place])
    if not strength:
        return high
    if place == low + 1 and len(SEPARATORS[len(SEPARATORS) - strength]) == 2:
        # it begins before the window; what else ends there is at most its last character
        rest = index(low + 2, high) if low + 2 <= high else place
        tail = SEPARATORS[len(SEPARATORS) - strength][-1]
        single = len(SEPARATORS) - SEPARATORS.index(tail)
        if rest != place and value[rest] >= single:
            return rest
        return place
    return place
