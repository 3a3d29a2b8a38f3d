"""Near-duplicate texts and paths (problem 2): all pairs of sets with a Jaccard similarity of at least a threshold.

A record is the set of its runs of k words. Sets are cut into regions by their elements' hashes: where two sets reach
the threshold, they reach it in at least one region, so it is enough to look for pairs region by region. The Hamming
distance of two indicator vectors is the size of the sets' symmetric difference, which is at most
(1 - t) / (1 + t) * (|A| + |B|) for similar sets. A region's fingerprint has 64 parities of its elements by residue, so
distances of fingerprints are never more than the sets' own.

Tables of distances alone would have to be compared for all pairs, so the pairs that reach the tables come from an
exact prefix index: two similar sets share one of their rarest elements. Rarity is counted over all records in a table
of fixed size. A rare element is a key by itself; a frequent one, whose list would grow with the data, is one only
together with the next one or two elements that both sets hold. Small sets are indexed by combinations throughout. Of each list of the
index up to REFERENCES members are the reference fingerprints; the distances of all members to them are computed once,
and by the triangle inequality a pair whose coordinates differ by more than the bound anywhere is discarded. Survivors
are verified, on the fingerprints and then on the sets themselves. No filter loses a pair. Copies (equal sets) are one
class throughout.

Tasks pack the entries of many records for one part of the index into one row, so an entry costs at most 26 bytes of
shuffle however many parts there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointed
from .words import _mix, distinct_runs

#: Counters of the rarity table, by the upper bits of an element's hash; in blocks that are added up apart.
RARITY_BITS, RARITY_BLOCKS = 22, 64
#: Records up to whose number an element is a key alone, and together with one further element; beyond, with two. In tables
#: of more than MANY elements, both are larger by the square root of how much more, as keys of several elements cost entries.
ALONE, PAIRED, MANY = 48, 1024, 1 << 25
#: Elements that are worked on at once.
ELEMENTS = 1 << 17
#: Entries of the prefix index that one part holds, on average, and that a task packs at once.
PART_ENTRIES, PACKED_ENTRIES = 1_500_000, 1_000_000
#: Entries for each element of the plain prefixes, for the keys of several elements; an estimate that only the number of parts follows from.
KEYS_EACH = 2
#: Groups of regions that parts are made of.
REGION_GROUPS = 8
#: Members of a list that are references, spread over its sizes.
REFERENCES = 16
#: Entries of one list that are compared at once; longer lists are cut into blocks, and pairs of blocks are spread over tasks.
LIST_BLOCK = 32_768
#: None: all pairs of all classes. A number is a limit that a caller may set: of a class of more members, only the first stands in pairs.
COPIES: int | None = None
#: Members of a class in one block, on average; one row pairs two blocks.
BLOCK = 1024
#: Rows up to which document ids are broadcast (8 MB).
BROADCAST_IDS = 1_000_000


def _signature(tokens: np.ndarray) -> int:
    """A 64-bit digest of a set given in ascending order."""
    with np.errstate(over="ignore"):
        x = np.bitwise_xor.reduce(tokens * np.uint64(0x9E3779B97F4A7C15)) ^ (np.add.reduce(tokens) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(len(tokens))
    return int(x.astype(np.int64))


def _fingerprint(tokens: np.ndarray) -> int:
    """64 parities of the elements by residue."""
    n = np.bincount((tokens & np.uint64(63)).astype(np.int64), minlength=64)
    return int(np.packbits((n & 1).astype(np.uint8)).view(np.uint64)[0])


def _whole(tokens: np.ndarray) -> bytes:
    """Parities of all elements of a set, in 1.5 to 3 bits an element. The number of bits is a power of two, at least 64."""
    bits = max(64, 1 << math.ceil(math.log2(1.5 * len(tokens))))
    n = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _apart(a: bytes, b: bytes) -> int:
    """The distance of two fingerprints, the longer one brought to the other's bits."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


# --- Rarity ---


def _code(count: np.ndarray | int) -> np.ndarray:
    """Counts in one byte, eight steps each time they double."""
    return np.minimum(8 * np.log2(1.0 + np.asarray(count)), 255).astype(np.uint8)


def _tallied(slots: np.ndarray, width: int) -> bytes:
    """Counts of slots below `width` as bytes: the distance from the last one, and a number up to 255."""
    at, n = np.unique(slots, return_counts=True)
    times = (n + 254) // 255
    last = np.zeros(int(times.sum()), bool)
    last[np.cumsum(times) - 1] = True
    number = np.full(len(last), 255)
    number[last] = n - 255 * (times - 1)
    steps = np.arange(0, width, 255)  # slots that stand for no element, so that no distance is longer
    at, number = np.concatenate([np.repeat(at, times).astype(np.int64), steps]), np.concatenate([number, np.zeros(len(steps), np.int64)])
    order = np.argsort(at, kind="stable")
    return np.stack([np.diff(at[order], prepend=0), number[order]]).astype(np.uint8).tobytes()


def _counted(data: bytes, width: int) -> np.ndarray:
    gaps, number = np.frombuffer(data, np.uint8).reshape(2, -1)
    return np.bincount(np.cumsum(gaps, dtype=np.int64), number, width).astype(np.int64)


def _rarity(codes: np.ndarray, elements: int) -> np.ndarray:
    """Codes of what counters hold beyond the usual, which is other elements' part, at the size of a table of MANY elements."""
    held = np.exp2(np.arange(256) / 8) - 1
    return _code(np.maximum(held - held[int(np.median(codes))] * 1.1, 0) / math.sqrt(max(1, elements / MANY)))[codes]


# --- The prefix index ---


#: Sizes up to which sets are cut into 1, 16, 64, 256, … regions.
EDGES = [40, *(640 * 4**e for e in range(16))]


def _regions(n: int) -> int:
    """Regions of pairs whose larger set has n elements; of up to 40 elements each."""
    return 1 if n <= EDGES[0] else 16 * 4 ** next(i for i, m in enumerate(EDGES[1:]) if n <= m)


def _level(n: int, threshold: float) -> int:
    """Elements in one key of the index for pairs whose larger set has n elements."""
    return min(3 if n <= 10 else 2 if n <= 16 else 1, math.ceil(threshold * n - 1e-9))


@lru_cache(100_000)
def _forms(n: int, threshold: float) -> list[tuple[int, int]]:
    """(level, regions) of all pairs that a set of n elements may be the smaller one of."""
    largest = math.floor(n / threshold + 1e-9)
    sizes = [*range(n, min(largest, 17) + 1), n, largest, *(m for m in EDGES if n <= m <= largest)]
    return sorted({(_level(m, threshold), _regions(m)) for m in sizes})


def _prefix(n: int, threshold: float, shared: int) -> int:
    """Of a set's n elements in the common order, how many must be looked at to see `shared` that a similar set has too."""
    return min(n, n - math.ceil(threshold * n - 1e-9) + shared)


@lru_cache(256)
def _choices(n: int, level: int) -> np.ndarray:
    return np.array(list(combinations(range(n), level)))


def _keys(tokens: np.ndarray, threshold: float, level: int) -> np.ndarray:
    """Keys of small sets of one size, a row each, whose elements are given from the rarest to the most frequent."""
    if level > tokens.shape[1]:
        return tokens[:, :0]
    chosen = tokens[:, _choices(_prefix(tokens.shape[1], threshold, level), level)]
    keys = np.full(chosen.shape[:2], level, np.uint64)
    with np.errstate(over="ignore"):
        for c in np.moveaxis(np.sort(chosen, axis=2), 2, 0):  # in an order that doesn't depend on the set
            keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + c)
    return keys


def _further(at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(of, next): for each place all further ones before its end."""
    n = np.maximum(end - at - 1, 0)
    of = np.repeat(np.arange(len(at)), n)
    return of, at[of] + 1 + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)


def _small(tokens: np.ndarray, count: np.ndarray, start: np.ndarray, n: int, threshold: float, level: int) -> tuple[np.ndarray, ...]:
    at = start[:, None] + np.arange(n)
    order = np.argsort(count[at], axis=1, kind="stable")  # ascending hashes break ties of rarity alike in all records
    keys = _keys(np.take_along_axis(tokens[at], order, 1), threshold, level)
    each = keys.shape[1]
    print_ = np.bitwise_xor.reduce(np.uint64(1) << (tokens[at] & np.uint64(63)), axis=1)
    return np.zeros(keys.size, np.uint64), keys.ravel(), np.full(keys.size, n, np.uint16), np.repeat(print_, each), np.repeat(np.arange(len(start)), each)


def _regional(tokens: np.ndarray, count: np.ndarray, start: np.ndarray, n: np.ndarray, threshold: float, regions: int) -> tuple[np.ndarray, ...]:
    """Entries of sets that are cut into regions.

    Of a region, the elements are ordered by rarity. If two records share o elements of it, the rarest shared one stands
    among the first n - o + 1 of both, the l-th among the first n - o + l. How many elements a key has follows from the
    first one's count alone, so both records make it alike; where a record's region may share fewer, it makes the shorter keys too.
    """
    owner = np.repeat(np.arange(len(start)), n)
    at = np.arange(len(owner)) + np.repeat(start - np.cumsum(n) + n, n)
    token = tokens[at]
    region = (token >> np.uint64(20)) % np.uint64(regions)
    bits = np.uint64(len(at).bit_length())
    order = owner.astype(np.uint64) * np.uint64(regions) + region << np.uint64(8) | count[at].astype(np.uint64)
    order = np.sort(order << bits | np.arange(len(at), dtype=np.uint64))  # as places ascend with hashes, these break ties of rarity
    group, order = order >> bits + np.uint64(8), (order & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)
    ordered, frequent = token[order], count[at][order]
    first = np.flatnonzero(np.diff(group, prepend=~group[:1]))
    size = np.diff(first, append=len(ordered))
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (ordered & np.uint64(63)), first) if len(first) else ordered
    of = np.repeat(np.arange(len(first)), size)
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)  # elements that a similar region shares
    begin, least, size_of = first[of], least[of], size[of]
    place = np.arange(len(ordered))
    wanted = 1 + (frequent > _code(ALONE)).astype(np.int64) + (frequent > _code(PAIRED))
    found = []
    with np.errstate(over="ignore"):
        hashed = _mix(ordered + np.uint64(regions))
        for level in (1, 2, 3):
            end = begin + np.minimum(size_of, size_of - least + level)
            i = np.flatnonzero((wanted >= level) & (np.minimum(wanted, least) <= level) & (place < end - level + 1))
            keys, last = hashed[i], i
            for _ in range(level - 1):
                back, last = _further(last, end[i])
                i, keys = i[back], _mix(keys[back] * np.uint64(0x9E3779B97F4A7C15) + ordered[last])
            found.append((of[i], keys))
        of, keys = (np.concatenate([f[j] for f in found]) for j in (0, 1))
        order = np.argsort(of, kind="stable")  # a region's entries stand together
        of, keys = of[order], keys[order]
        here = group[first] % np.uint64(regions)
        where = np.zeros(len(of), np.uint64) if regions == 1 else _mix(here + np.uint64(regions))[of]
    return where, keys, np.minimum(size[of], 0xFFFF).astype(np.uint16), parity[of], (group[first] // np.uint64(regions)).astype(np.int64)[of]


def entries_of_all(tokens: np.ndarray, count: np.ndarray, start: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(region, keys, sizes, prints, owners) of sets, of which each has `size` ascending elements from `start` on: of each key
    its region's number, size and fingerprint, and its set's number. `count` says in a byte how frequent an element is."""
    sizes, kind = np.unique(size, return_inverse=True)
    regional: dict[int, list[int]] = {}
    for j, n in enumerate(sizes.tolist()):
        for level, regions in _forms(n, threshold):
            if level == 1:
                regional.setdefault(regions, []).append(j)
            else:
                sets = np.flatnonzero(kind == j)
                *entries, owner = _small(tokens, count, start[sets], n, threshold, level)
                yield *entries, sets[owner]
    for regions, kinds in regional.items():
        sets = np.flatnonzero(np.isin(kind, kinds))
        *entries, owner = _regional(tokens, count, start[sets], size[sets], threshold, regions)
        yield *entries, sets[owner]


def entries_of(tokens: np.ndarray, count: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """The entries of one set."""
    return entries_of_all(tokens, count, np.zeros(1, np.int64), np.array([len(tokens)]), threshold)


class _Entries:
    """Entries of the index: of each the key's upper bits, its record's class, and size and fingerprint of its region."""

    COLUMNS = ("tokens", "names", "sizes", "prints", "counts")

    def __init__(self, token: np.ndarray, name: np.ndarray, n: np.ndarray, print_: np.ndarray) -> None:
        self.token, self.name, self.n, self.print = token, name, n, print_

    def take(self, at: np.ndarray | slice) -> _Entries:
        return _Entries(self.token[at], self.name[at], self.n[at], self.print[at])

    def packed(self) -> tuple[bytes, ...]:
        """Bytes of the columns; neighbouring entries of one region of a record hold what they share once."""
        first = np.flatnonzero((np.diff(self.name, prepend=~self.name[:1]) != 0) | (np.diff(self.print, prepend=~self.print[:1]) != 0) | (np.diff(self.n, prepend=~self.n[:1]) != 0))
        counts = np.diff(first, append=len(self.name)).astype(np.uint32)
        return self.token.tobytes(), self.name[first].tobytes(), self.n[first].tobytes(), self.print[first].tobytes(), counts.tobytes()

    @staticmethod
    def unpacked(rows: pd.DataFrame) -> _Entries:
        token, name, n, print_, counts = (np.frombuffer(b"".join(rows[c]), t) for c, t in zip(_Entries.COLUMNS, (np.uint32, np.int64, np.uint16, np.uint64, np.uint32)))
        return _Entries(token, np.repeat(name, counts), np.repeat(n, counts), np.repeat(print_, counts))


def _tables(e: _Entries) -> np.ndarray:
    """The distance tables: a row for each entry, ordered by key, with its distances to the references of its list."""
    start = np.flatnonzero(np.diff(e.token, prepend=~e.token[:1]) != 0)
    length = np.diff(start, append=len(e.token))
    out = np.empty((len(e.token), REFERENCES), np.int8)
    for r in range(REFERENCES):
        out[:, r] = np.bitwise_count(e.print ^ e.print[np.repeat(start + (r * length) // REFERENCES if r else start, length)])
    return out


def _met(e: _Entries, threshold: float, across: np.ndarray | None = None, tally: Counter | None = None) -> pd.DataFrame:
    """(x, y) of pairs whose entries, ordered by key and size, meet and which no distance discards; `across`: only of different marks."""
    far = _tables(e) if len(e.token) else None
    found: list[np.ndarray] = []
    step, alive = 1, np.arange(len(e.token) - 1)
    while len(alive):  # each entry with the one `step` further on, until its key or the permitted size ends
        alive = alive[alive + step < len(e.token)]
        b = alive + step
        alive = alive[(e.token[alive] == e.token[b]) & (e.n[alive] >= threshold * e.n[b] - 1e-9)]
        for a in np.array_split(alive, len(alive) // 1_000_000 + 1):
            a = a[e.name[a] != e.name[a + step]] if across is None else a[(across[a] != across[a + step]) & (e.name[a] != e.name[a + step])]
            b = a + step
            most = np.floor((1 - threshold) / (1 + threshold) * (e.n[a].astype(np.int64) + e.n[b]) + 1e-9)
            good = np.abs(far[a] - far[b]).max(1, initial=0) <= most
            if tally is not None:
                tally.update(met=len(a), discarded=int((~good).sum()))
            a, b, most = a[good], b[good], most[good]
            good = np.bitwise_count(e.print[a] ^ e.print[b]) <= most
            x, y = e.name[a[good]], e.name[b[good]]
            if len(x):
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
        if sum(map(len, found)) > 1 << 21:
            found = [np.unique(np.concatenate(found), axis=0)]
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"x": pairs[:, 0], "y": pairs[:, 1]})


_PACKED = "tokens binary, names binary, sizes binary, prints binary, counts binary"


def candidate_pairs(source: DataFrame, k: int, threshold: float, codes: np.ndarray, elements: int) -> DataFrame:
    """(x, y) of classes that no distance table discards, each once. `source`: (id, text); `codes`: of the counters, which add up to `elements`."""
    shared = source.sparkSession.sparkContext.broadcast(_rarity(codes, elements))
    shares = max(1, math.ceil(elements * (1 - threshold) * KEYS_EACH / PART_ENTRIES / REGION_GROUPS))  # parts of each group of regions

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flushed() -> pd.DataFrame:
            region, keys, sizes, prints, names = (np.concatenate([h[i] for h in held]) for i in range(5))
            part = ((region % np.uint64(REGION_GROUPS)) * np.uint64(shares) + keys % np.uint64(shares)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            whole = _Entries((keys >> np.uint64(32)).astype(np.uint32), names, sizes, prints).take(order)
            part = part[order]
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            return pd.DataFrame([(int(part[c]), *whole.take(slice(c, d)).packed()) for c, d in zip(cuts, [*cuts[1:], len(part)])], columns=["part", *_Entries.COLUMNS])

        for batch in batches:
            hashes, bounds = distinct_runs(batch["text"].tolist(), k)
            count = shared.value[(hashes >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]
            kept = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if a == b or (own := _signature(hashes[a:b])) in seen:
                    continue
                if len(seen) < 1_000_000:  # copies in this task; those in others fall together in the index
                    seen.add(own)
                kept.append((own, a, b - a))
            if not kept:
                continue
            own, start, n = np.array(kept, np.int64).T
            cuts = np.flatnonzero(np.diff(np.cumsum(n) // ELEMENTS, prepend=-1))
            for c, d in zip(cuts, [*cuts[1:], len(n)]):
                for *entry, owner in entries_of_all(hashes, count, start[c:d], n[c:d], threshold):
                    held.append((*entry, own[c:d][owner]))
                    size += len(owner)
                if size >= PACKED_ENTRIES:
                    yield flushed()
                    held.clear()
                    size = 0
        if held:
            yield flushed()

    NEAR, FAR = ["x", "y"], ["part", "token", "j", "h", "side", *_Entries.COLUMNS]

    def lists(group: pd.DataFrame) -> pd.DataFrame:
        e = _Entries.unpacked(group)
        key = e.token.astype(np.uint64) << np.uint64(32) | e.n.astype(np.uint64) << np.uint64(16) | e.name.astype(np.uint64) & np.uint64(0xFFFF)
        e = e.take(np.argsort(key))
        same = np.zeros(len(e.token), bool)  # copies in several tasks
        same[1:] = (e.token[1:] == e.token[:-1]) & (e.name[1:] == e.name[:-1]) & (e.n[1:] == e.n[:-1]) & (e.print[1:] == e.print[:-1])
        e = e.take(~same)
        start = np.flatnonzero(np.diff(e.token, prepend=~e.token[:1]) != 0)
        length = np.diff(start, append=len(e.token))
        out, short = [], np.ones(len(e.token), bool)
        for i in np.flatnonzero(length > LIST_BLOCK):  # to other tasks, in pairs of blocks whose sizes may be similar
            short[start[i] : start[i] + length[i]] = False
            cuts = [*range(start[i], start[i] + length[i], LIST_BLOCK), start[i] + length[i]]
            blocks = [e.take(slice(c, d)) for c, d in zip(cuts, cuts[1:])]
            for j, left in enumerate(blocks):
                for h in range(j, len(blocks)):
                    if left.n[-1] >= threshold * blocks[h].n[0] - 1e-9:
                        for side in {j, h}:
                            out.append((int(e.token[start[i]]), j, h, side, *blocks[side].packed()))
        near = _met(e.take(short) if out else e, threshold).astype(object).assign(**dict.fromkeys(FAR))
        far = pd.DataFrame(out, columns=FAR[1:], dtype=object).assign(part=group["part"].iloc[0], **dict.fromkeys(NEAR))
        return (pd.concat([near, far]) if out else near)[[*NEAR, *FAR]]

    def crossed(group: pd.DataFrame) -> pd.DataFrame:
        sides = [_Entries.unpacked(rows) for _, rows in group.groupby("side")]
        mark = np.repeat(np.arange(len(sides)), [len(s.token) for s in sides])
        e = _Entries(*[np.concatenate([getattr(s, c) for s in sides]) for c in ("token", "name", "n", "print")])
        order = np.argsort(e.n, kind="stable")
        return _met(e.take(order), threshold, mark[order] if len(sides) > 1 else None)

    indexed = source.mapInPandas(index, f"part int, {_PACKED}")
    found = indexed.groupBy("part").applyInPandas(lists, f"x long, y long, part int, token long, j int, h int, side int, {_PACKED}")
    near = found.where("x is not null").select("x", "y")
    if codes.max(initial=0) >= _code(LIST_BLOCK):  # no element's list is longer than its counter
        found = checkpointed(found)
        near = found.where("x is not null").select("x", "y")
        near = near.unionByName(found.where("x is null").drop("x", "y").groupBy("part", "token", "j", "h").applyInPandas(crossed, "x long, y long"))
    return near.distinct()


def linked_classes(records: DataFrame, record: str, column: str, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class) of all records with a run, and links (x, y) of classes that are similar, each given once."""
    source = records.select(F.col(record).cast("long").alias("id"), F.col(column).alias("text")).where("id is not null and text is not null")

    def survey(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = [np.zeros(0, np.uint32)]
        for batch in batches:
            hashes, bounds = distinct_runs(batch["text"].tolist(), k)
            slots.append((hashes >> np.uint64(64 - RARITY_BITS)).astype(np.uint32))
            rows = [(i, _signature(s), len(s), _whole(s)) for i, a, b in zip(batch["id"].tolist(), bounds[:-1], bounds[1:]) if (s := hashes[a:b]).size]
            yield pd.DataFrame(rows, columns=["id", "class", "n", "data"]).assign(block=-1)
            if sum(map(len, slots)) > 1 << 23:
                yield tallied(slots)
                slots = [np.zeros(0, np.uint32)]
        yield tallied(slots)

    width = (1 << RARITY_BITS) // RARITY_BLOCKS

    def tallied(slots: list[np.ndarray]) -> pd.DataFrame:
        """A row for each block of counters that has any."""
        at = np.sort(np.concatenate(slots))
        cuts = np.searchsorted(at, np.arange(RARITY_BLOCKS + 1) * width)
        rows = [(0, 0, 0, _tallied(at[c:d] - j * width, width), j) for j, (c, d) in enumerate(zip(cuts, cuts[1:])) if c < d]
        return pd.DataFrame(rows, columns=["id", "class", "n", "data", "block"])

    surveyed = checkpointed(source.mapInPandas(survey, "id long, class long, n int, data binary, block int"))

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(width, np.int64)
        for d in parts["data"]:
            total += _counted(d, width)
        return pd.DataFrame({"block": [parts["block"].iloc[0]], "data": [_code(total).tobytes()], "elements": [int(total.sum())]})

    # up to RARITY_BLOCKS rows, a byte for each counter
    codes, elements = np.zeros((RARITY_BLOCKS, width), np.uint8), 0
    for r in surveyed.where("block >= 0").groupBy("block").applyInPandas(added, "block int, data binary, elements long").collect():
        codes[r.block] = np.frombuffer(r.data, np.uint8)
        elements += r.elements
    members = surveyed.where("block < 0").select("id", "class").distinct()

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        most = np.floor((1 - threshold) / (1 + threshold) * n.to_numpy() + 1e-9)
        return pd.Series([_apart(x, y) <= m for x, y, m in zip(a, b, most)], dtype=bool)

    prints = surveyed.where("block < 0").groupBy("class").agg(F.first("n").alias("n"), F.first("data").alias("p"))  # equal in all of a class
    px, py = (prints.select(F.col("class").alias(c), F.col("n").alias(f"n{c}"), F.col("p").alias(f"p{c}")) for c in "xy")
    met = candidate_pairs(source, k, threshold, codes.ravel(), elements).join(px, "x").join(py, "y")
    pairs = checkpointed(met.where(near("px", "py", F.col("nx") + F.col("ny"))).select("x", "y"))
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("class")).distinct()
    few = pairs.count() * 2 <= BROADCAST_IDS
    firsts = members.join(F.broadcast(wanted) if few else wanted, "class", "left_semi").groupBy("class").agg(F.min("id").alias("id"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes, bounds = distinct_runs(batch["text"].tolist(), k)
            yield pd.DataFrame({"class": batch["class"], "tokens": [hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]})

    read = source.join(F.broadcast(firsts) if few else firsts, "id").select("class", "text").mapInPandas(sets, "class long, tokens binary")
    held = read.dropDuplicates(["class"])

    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(a, b):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both >= threshold * (len(s) + len(t) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    ta = held.select(F.col("class").alias("x"), F.col("tokens").alias("ta"))
    tb = held.select(F.col("class").alias("y"), F.col("tokens").alias("tb"))
    return members, pairs.join(ta, "x").join(tb, "y").where(similar("ta", "tb")).select("x", "y").distinct()


def similar_pairs(records: DataFrame, record: str, column: str, k: int, threshold: float) -> DataFrame:
    """(id_a, id_b) of records whose sets of k-word runs have a Jaccard similarity of at least `threshold`.

    Null and blank texts and texts of fewer than k words have no run and are in no pair. Equal rows of one id count
    once. Copies (equal sets, whose texts may differ) are paired with each other and with everything their class is
    similar to, however many they are.
    """
    return _expanded(*linked_classes(records, record, column, k, threshold))


def similar_classes(records: DataFrame, record: str, column: str, k: int, threshold: float) -> DataFrame:
    """(id, class_id, size, links): each record with its class of equal sets, named by its smallest id, and the number of other records it is similar to.

    Rows are in proportion to the records, also where a class holds a third of them. Records without a run have no row.
    """
    members, linked = linked_classes(records, record, column, k, threshold)
    sizes = members.groupBy("class").agg(F.count("*").alias("size"), F.min("id").alias("class_id"))
    both = linked.unionByName(linked.select(F.col("y").alias("x"), F.col("x").alias("y")))
    links = both.join(sizes.select(F.col("class").alias("y"), "size"), "y").groupBy(F.col("x").alias("class")).agg(F.sum("size").alias("others"))
    known = sizes.join(links, "class", "left").select("class", "class_id", "size", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(known, "class").select("id", "class_id", "size", "links")


def _expanded(members: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs of records from linked classes and from the classes themselves.

    A class is cut into blocks of about BLOCK ids and pairs of blocks are spread over all tasks, so what a task holds
    at once doesn't grow with a class. The work is in proportion to the pairs returned.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    firsts = None
    if COPIES is not None:
        firsts = members.join(sizes.where(F.col("size") > COPIES), "class").where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"))
        sizes = sizes.withColumn("size", F.when(F.col("size") > COPIES, 1).otherwise(F.col("size")))
    several = members.join(sizes.where("size > 1"), "class").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / F.lit(BLOCK))))
    blocks = several.groupBy("class", "block").agg(F.collect_list("id").alias("ids"))
    blocks = blocks.unionByName(sizes.where("size = 1").select("class", F.lit(0).cast("long").alias("block"), F.array("first").alias("ids")))
    links = linked.select("x", "y").unionByName(sizes.where("size > 1").select(F.col("class").alias("x"), F.col("class").alias("y")))
    met = (
        links.join(blocks.select(F.col("class").alias("x"), F.col("block").alias("bx"), F.col("ids").alias("as")), "x")
        .join(blocks.select(F.col("class").alias("y"), F.col("block").alias("by"), F.col("ids").alias("bs")), "y")
        .where("x <> y or bx <= by")
        .repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "x", "bx", "y", "by")  # a stated number, as few bytes may stand for many pairs
    )
    own = (F.col("x") == F.col("y")) & (F.col("bx") == F.col("by"))  # a block with itself
    pairs = met.select(own.alias("own"), F.explode("as").alias("a"), "bs").select("own", "a", F.explode("bs").alias("b")).where("if(own, a < b, a <> b)")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if firsts is not None:
        pairs = pairs.unionByName(firsts)
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
