"""Removal of repeated passages: every byte covered by a 100-byte string that also starts earlier in the corpus.

Hashes only decide which bytes meet; what is removed is decided on bytes, by the common-prefix interval tree of an enhanced suffix
array (suffix array and longest common prefixes). The tree is scanned with a stack; intervals of length 100 or more whose suffixes have
different left extensions are the maximal repeats, each with all its occurrences. All occurrences but the first are covered.

Each window of 100 bytes has an anchor: the 32-byte string in it of least hash (the last of equals), so equal windows have equal anchors
at equal places. Consecutive windows of one anchor that reach 34 bytes left of it, and those that do not, form parts of at most 35
windows. A part's key is the hash of the 66 bytes of anchor and side that all its windows hold: equal windows lie in parts of equal keys.

1. Each task hashes the parts of about 2 MB of text at a time. The bytes of parts that are equal there, or equal to parts that the task has
   met before, go through a suffix array at once; parts that it shows to be covered need no shuffle, so a passage of a third of all
   documents sends about a row a task. Keys that a bounded sample of documents shows to be very common are dealt by window instead: their
   rows have the hash of their own 100 bytes as key.
2. Parts meet by key, in a stream. Of parts that seem equal the first is the source; each other one claims to repeat it. Different
   parts of a key ask to be compared with one another, or window by window if there are more of them than PART_LIMIT.
3. Claims and sources that follow each other are joined into runs, and their bytes are dealt by the place of the source; parts by their
   key. Suffix arrays of about a MB, always with the source, find what is covered.
4. Covered intervals are merged per document and cut out.

Order: smaller id first, null ids last; rows with the same id are ordered by a hash of their text. Defined results: null is the empty
text; texts under 100 bytes lose nothing; of rows that repeat a row in id and text all but one lose what the first has. Extra columns of
any names are left alone. An empty table gives an empty result. A hash that two different strings share can cause no removal, but for
one case: whether a row repeats another of the same id (or also without one) is told by the 64-bit hash of its whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copresence.llm.common import packed_row, table, unpacked_row, written

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # anchors to choose from in a window
SIDE = (LENGTH - GRAM) // 2
#: A task compares up to this many different parts of a key with one another; more are dealt by window.
PART_LIMIT = 4096
#: Documents in the sample that looks for very common keys, and the number of parts of a key there from which it is dealt by window.
SAMPLE_ROWS, COMMON = 10_000, 32
#: Bytes of text that a task hashes at a time; longer documents are hashed in overlapping pieces. Bytes of a suffix array.
CHUNK, SLICE, PLACE_BITS = 2 << 20, 1 << 20, np.uint64(22)
#: Runs are cut where a part's key says so, or after this many parts; and sources by this many windows.
CUT_MASK, MOST_PARTS, CELL = np.uint64(31), 64, 1024
OPEN, COVER, CLAIM, SOURCE, PART, SPLIT = range(6)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = 0xD6E8FEB86659FD93


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of all substrings: prefix sums of byte * base**-i modulo 2**64, shifted back by base**start."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        inverse = pow(_BASE, -1, 1 << 64)
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(inverse, k, 1 << 64))])

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.down[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.up[start])


_HASHER = Hasher()


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n, low, step = len(v) - width + 1, v, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    return np.minimum(low[:n], low[width - step : width - step + n])


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals that overlap or touch, by document; doc holds small integers."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    reach = np.maximum.accumulate(doc * (1 << 33) + end)
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] * (1 << 33) + start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1) if len(doc) else np.zeros(0, np.int64)
    return doc[new], start[new], reach[last] - doc[new] * (1 << 33)


def _batch(columns, types, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


class SuffixArray:
    """Enhanced suffix array of several strings: suffixes end with their string; of equal ones the earlier string's comes first.

    order: suffixes sorted; lcp[i]: common prefix of suffixes order[i - 1] and order[i]."""

    def __init__(self, strings: list[bytes]):
        size = np.array([len(s) for s in strings], np.int64)
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.string = np.repeat(np.arange(len(strings)), size)
        self.start = np.cumsum(size) - size
        self.end = np.repeat(np.cumsum(size), size)
        self.order = self._sorted()
        self.lcp = self._common_prefixes()

    def _sorted(self) -> np.ndarray:
        """Prefix doubling from 5 bytes on. A rank is the place of the first of equal suffixes; only ties are sorted again."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64)
        place = np.arange(n)
        left = self.end - place
        key = np.zeros(n, np.uint64)
        for j in range(5):
            key <<= np.uint64(8)
            key[: n - j] |= np.where(left[: n - j] > j, self.data[j:], 0).astype(np.uint64)
        key = (key << np.uint64(3)) | np.minimum(left, 5).astype(np.uint64)  # a shorter suffix comes before its extensions
        rank, tied = self._ranked(key, 43, place, np.zeros(n, np.int64))
        step, bits = 5, n.bit_length()
        while len(tied):
            tied = tied[left[tied] >= step]
            if not len(tied):
                break
            after = tied + step
            second = np.where(after < self.end[tied], rank[np.minimum(after, n - 1)] + 1, 0)
            fresh, still = self._ranked(((rank[tied] << bits) | second).astype(np.uint64), 2 * bits, tied, rank[tied])
            rank[tied], tied = fresh, still
            step *= 2
        return self._order(rank.astype(np.uint64), bits)[1]

    @staticmethod
    def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of so many bits in order, and their places, the first of equals first. Where both fit a word they are sorted as one."""
        shift = max(1, len(key).bit_length())
        if bits + shift > 64:
            order = np.argsort(key, kind="stable")
            return key[order], order
        both = np.sort((key << np.uint64(shift)) | np.arange(len(key), dtype=np.uint64))
        return both >> np.uint64(shift), (both & np.uint64((1 << shift) - 1)).astype(np.int64)

    @classmethod
    def _ranked(cls, key: np.ndarray, bits: int, member: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of members whose keys decide within groups of equal base rank, which keep their places; and the members still tied."""
        k, order = cls._order(key, bits)
        b = base[order]
        at = np.arange(len(k))
        new = np.append(True, k[1:] != k[:-1])
        first = np.maximum.accumulate(np.where(new, at, 0))
        group = np.maximum.accumulate(np.where(np.append(True, b[1:] != b[:-1]), at, 0))
        out = np.empty(len(k), np.int64)
        out[order] = b + first - group
        again = ~new
        again[:-1] |= ~new[1:]
        return out, np.sort(member[order[again]])

    def _common_prefixes(self) -> np.ndarray:
        """A suffix that its neighbour in order precedes with the same byte has one byte less in common than the suffix before it in the
        text; only the others are compared, eight bytes at a time."""
        n = len(self.data)
        out = np.zeros(n, np.int64)
        if n < 2:
            return out
        neighbour = np.full(n, -1)
        neighbour[self.order[1:]] = self.order[:-1]
        at = np.arange(n)
        begins = self.start[self.string] == at
        follows = (neighbour >= 0) & ~begins & ~begins[neighbour]
        follows[follows] = self.data[at[follows] - 1] == self.data[neighbour[follows] - 1]
        alone = np.flatnonzero(~follows & (neighbour >= 0))
        words = np.zeros(n + 8, np.uint64)
        for j in range(8):
            words[: n - j] |= self.data[j:].astype(np.uint64) << np.uint64(8 * j)
        p, q, open_ = alone.copy(), neighbour[alone], np.arange(len(alone))
        room = np.minimum(self.end[p] - p, self.end[q] - q)
        common = np.zeros(len(alone), np.int64)
        while len(open_):
            differ = words[p[open_] + common[open_]] ^ words[q[open_] + common[open_]]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)).astype(np.int64) // 8)
            common[open_] = np.minimum(common[open_] + same, room[open_])
            open_ = open_[(same == 8) & (common[open_] < room[open_])]
        in_text = np.zeros(n, np.int64)
        in_text[alone] = common
        last = np.maximum.accumulate(np.where(~follows, at, 0))
        in_text = np.where(follows, in_text[last] - (at - last), in_text)
        return in_text[self.order]

    def left(self) -> np.ndarray:
        """The byte before each suffix, in order; at the start of a string a value of its own."""
        first = self.order == self.start[self.string[self.order]]
        return np.where(first, -1 - self.string[self.order], self.data[np.maximum(self.order - 1, 0)].astype(np.int64))

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last): runs order[first..last] of suffixes that share a prefix of `length` >= least, no byte longer and not
        all preceded by the same byte: the maximal repeats with all their occurrences, from a stack scan of the interval tree."""
        left, lcp = self.left(), self.lcp
        changes = np.append(0, np.cumsum(left[1:] != left[:-1]))  # equal at two places if nothing changes between them
        high = np.flatnonzero(lcp >= least)
        if not len(high):
            return
        cut = np.flatnonzero(np.diff(high) > 1)
        begins, ends = high[np.append(0, cut + 1)], high[np.append(cut, len(high) - 1)]
        diverse = changes[ends] != changes[begins - 1]  # a subtree whose suffixes all follow the same byte holds no maximal repeat
        for begin, end in zip(begins[diverse].tolist(), ends[diverse].tolist(), strict=True):
            stack = []  # (length, first)
            for i, length in enumerate(lcp[begin : end + 1].tolist(), begin):
                first = i - 1
                while stack and stack[-1][0] > length:
                    longer, first = stack.pop()
                    if changes[i - 1] != changes[first]:
                        yield longer, first, i - 1
                if not stack or stack[-1][0] < length:
                    stack.append((length, first))
            while stack:
                longer, first = stack.pop()
                if changes[end] != changes[first]:
                    yield longer, first, end


def repeats(did: np.ndarray, th: np.ndarray, start: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """Strings and their places -> (index of a string, start, length): all occurrences of maximal repeats but the first, in document
    coordinates."""
    array = SuffixArray(bodies)
    string = array.string[array.order]
    byte = start[string] + array.order - array.start[string]
    _, doc = np.unique(np.stack([did, th]), axis=1, return_inverse=True)
    place = doc.ravel()[string] * (1 << 33) + byte
    at, lengths = [], []
    for length, first, last in array.maximal_repeats(LENGTH):
        inside = place[first : last + 1]
        later = first + np.flatnonzero(inside > inside.min())
        at.append(later)
        lengths.append(np.full(len(later), length))
    if not at:
        return (np.zeros(0, np.int64),) * 3
    at = np.concatenate(at)
    return string[at], byte[at], np.concatenate(lengths)


PART_COLUMNS = ["key", "block", "did", "th", "meta"]
PART_SCHEMA = "key long, block long, did long, th long, meta long"
PART_TYPES = [pa.int64()] * 5
_BYTES = LENGTH + SIDE + 2  # the longest part


def packed(start: np.ndarray, span: np.ndarray, kind) -> np.ndarray:
    """start, span (last window's offset; of covers the number of bytes) and kind in one number that sorts by start."""
    return (np.asarray(start, np.int64) << 32) | (np.asarray(span, np.int64) << 8) | kind


def unpacked(meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return meta >> 32, (meta >> 8) & 0xFFFFFF, meta & 0xFF


class Known:
    """Bytes and places of parts that a task has met more than once, of bounded number: what repeats them later needs no shuffle."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.parts = limit, {}

    def learn(self, key: int, place: tuple[int, int, int], body: bytes) -> None:
        if key in self.parts:
            if place < self.parts[key][0]:
                self.parts[key] = (place, body)
        elif len(self.parts) < self.limit:
            self.parts[key] = (place, body)

    def before(self, keys: list[int]) -> list[tuple[tuple[int, int, int], bytes]]:
        found = {k: self.parts[k] for k in keys if k in self.parts}
        return sorted(found.values())

    def __len__(self) -> int:
        return len(self.parts)


def _joined(parts: list[tuple[tuple[int, int, int], bytes]]) -> list[tuple[tuple[int, int, int], bytes]]:
    """Parts in order of place, those that follow each other without a gap joined into one string."""
    out: list[list] = []
    for (did, th, start), body in parts:
        if out:
            (d, t, s), pieces, windows = out[-1]
            if (d, t, s + windows) == (did, th, start) and windows < MOST_PARTS * SIDE:
                pieces.append(body[LENGTH - 1 :])
                out[-1][2] += len(body) - LENGTH + 1
                continue
        out.append([(did, th, start), [body], len(body) - LENGTH + 1])
    return [(place, b"".join(pieces)) for place, pieces, _ in out]


def _parts_of(data: np.ndarray, size: np.ndarray, common: np.ndarray):
    """Bytes of several pieces (sizes >= LENGTH) -> piece, first window (in data), span, key and hash of each part, in order."""
    at = np.cumsum(size) - size
    sums = _HASHER.sums(data)
    every = np.arange(len(data) - GRAM + 1)
    gram = _mixed((sums[GRAM:] - sums[:-GRAM]) * _HASHER.up[: len(every)])
    mask = np.uint64((1 << int(PLACE_BITS)) - 1)
    low = _sliding_min((gram & ~mask) | (mask - every.astype(np.uint64)), SPAN)
    del gram, every
    windows = size - LENGTH + 1
    piece = np.repeat(np.arange(len(size)), windows)
    window = np.arange(len(piece)) + np.repeat(at - (np.cumsum(windows) - windows), windows)
    anchor = (mask - (low[window] & mask)).astype(np.int64)
    del low
    right = anchor - window < SIDE
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (right[1:] != right[:-1]) | (piece[1:] != piece[:-1])))
    first, last = window[new], window[np.append(new[1:], len(window)) - 1]
    anchor, right, piece = anchor[new], right[new], piece[new]
    del window
    key = _HASHER.of(sums, np.where(right, anchor, anchor - SIDE), np.where(right, anchor + GRAM + SIDE, anchor + GRAM))
    key = np.where(right, key, _mixed(key + _M1))
    if len(common):
        often = np.isin(key, common)
        if often.any():
            count = np.where(often, last - first + 1, 1)
            source = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
            often = often[source]
            first, piece = first[source] + np.where(often, step, 0), piece[source]
            last = np.where(often, first, last[source])
            key = np.where(often, _HASHER.of(sums, first, first + LENGTH), key[source])
    return piece, first, last - first, key, _HASHER.of(sums, first, last + LENGTH)


def _chunk_parts(pieces: list[tuple[int, int, int, bytes]], known: Known, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """pieces (did, th, first byte in the document, bytes) in order -> parts that are not covered here, and covered intervals."""
    pieces = [p for p in pieces if len(p[3]) >= LENGTH]
    if not pieces:
        return
    data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    size = np.array([len(p[3]) for p in pieces])
    at = np.cumsum(size) - size
    piece, first, span, key, block = _parts_of(data, size, common)
    did, th, base = (np.array([p[i] for p in pieces], np.int64) for i in range(3))
    start = first - at[piece] + base[piece]
    both = _mixed(key) + block * _M2
    order = np.argsort(both, kind="stable")
    same = np.append(False, both[order[1:]] == both[order[:-1]])
    again = same.copy()
    again[:-1] |= same[1:]
    twice = np.zeros(len(both), bool)
    twice[order[again]] = True
    earlier = known.before(both[np.isin(both, np.fromiter(known.parts, np.uint64, len(known)))].tolist()) if len(known) else []
    if earlier:
        met = np.isin(both, np.array([k for k in known.parts], np.uint64))
        twice |= met
    done = np.zeros(len(both), bool)
    if twice.any():
        i = np.flatnonzero(twice)
        follows = np.append(False, (np.diff(i) == 1) & (first[i[1:]] == first[i[:-1]] + span[i[:-1]] + 1) & (piece[i[1:]] == piece[i[:-1]]))
        follows &= (key[i] & CUT_MASK) != 0
        run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(i))))
        follows &= (np.arange(len(i)) - run) % MOST_PARTS != 0
        head = np.flatnonzero(~follows)
        tail = np.append(head[1:], len(i)) - 1
        lo, hi = first[i[head]], first[i[tail]] + span[i[tail]] + LENGTH
        whole = data.tobytes()
        bodies = [whole[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        where, shift = piece[i[head]], start[i[head]]
        old = _joined(earlier)
        s_did = np.concatenate([did[where], np.array([p[0] for p, _ in old], np.int64)])
        s_th = np.concatenate([th[where], np.array([p[1] for p, _ in old], np.int64)])
        s_start = np.concatenate([shift, np.array([p[2] for p, _ in old], np.int64)])
        found, byte, length = repeats(s_did, s_th, s_start, [*bodies, *(b for _, b in old)])
        mine = found < len(bodies)
        found, byte, length = where[found[mine]], byte[mine], length[mine]
        if len(found):
            p, s, e = _merged(found, byte, byte + length - LENGTH + 1)  # windows
            slot = np.searchsorted(p * (1 << 33) + s, piece[i] * (1 << 33) + start[i], "right") - 1
            inside = (slot >= 0) & (p[slot] == piece[i]) & (start[i] + span[i] + 1 <= e[slot])
            done[i[inside]] = True
            p, s, e = _merged(found, byte, byte + length)
            spread = _mixed(did[p].view(np.uint64) + s.astype(np.uint64)).view(np.int64)
            yield _batch((spread, np.zeros(len(p), np.int64), did[p], th[p], packed(s, e - s, COVER)), PART_TYPES, PART_COLUMNS)
        for j in i[~done[i]].tolist():
            q = piece[j]
            known.learn(int(both[j]), (int(did[q]), int(th[q]), int(start[j])), whole[first[j] : first[j] + span[j] + LENGTH])
    o = np.flatnonzero(~done)
    p = piece[o]
    yield _batch((key[o].view(np.int64), block[o].view(np.int64), did[p], th[p], packed(start[o], span[o], OPEN)), PART_TYPES, PART_COLUMNS)


def _parts(common: np.ndarray):
    """(did, th, text) -> rows of PART_SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()

        def flush(rows):
            yield from _chunk_parts(sorted(rows, key=lambda p: p[:3]), known, common)

        rows, held = [], 0
        for b in batches:
            for did, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                body = text.as_buffer()
                body = b"" if body is None else body.to_pybytes()
                for base in range(0, max(1, len(body) - LENGTH + 1), CHUNK - LENGTH):
                    part = body[base : base + CHUNK - 1]
                    if held + len(part) > CHUNK:
                        yield from flush(rows)
                        rows, held = [], 0
                    rows.append((did, th, base, part))
                    held += len(part)
        yield from flush(rows)

    return run


ASK_COLUMNS = ["kind", "key", "did", "th", "start", "span", "delta", "of_did", "of_th"]
ASK_SCHEMA = "kind byte, key long, did long, th long, start int, span int, delta int, of_did long, of_th long"
ASK_TYPES = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]


def _asks(x: dict[str, np.ndarray], split: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block, did, th, meta) -> covered intervals, claims, sources and parts to compare. split: the key of rows that
    other calls see more of, so that all its parts are dealt by window."""
    start, span, kind = unpacked(x["meta"])
    done = kind == COVER
    none = lambda n: np.zeros(n, np.int64)
    if done.any():
        n = int(done.sum())
        yield _batch((np.full(n, COVER), none(n), x["did"][done], x["th"][done], start[done], span[done], none(n), none(n), none(n)), ASK_TYPES, ASK_COLUMNS)
    key, block, did, th = (x[c][~done] for c in PART_COLUMNS[:4])
    start, span = start[~done], span[~done]
    n = len(key)
    if not n:
        return
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key | np.append(True, block[1:] != block[:-1])
    source = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    claim = np.flatnonzero(~new & ~((did == did[source]) & (th == th[source]) & (start == start[source])))
    of = source[claim]
    group = np.cumsum(new_key) - 1
    different = np.bincount(group[new], minlength=group[-1] + 1)[group]
    compared = np.flatnonzero(new & (different > 1))
    used = np.unique(of)
    rows = np.concatenate([claim, used, compared])
    wide = (different[compared] > PART_LIMIT) | ((key[compared] == split) if split is not None else False)
    kinds = np.concatenate([np.full(len(claim), CLAIM), np.full(len(used), SOURCE), np.where(wide, SPLIT, PART)])
    rest = none(len(used) + len(compared))
    delta = np.concatenate([start[claim] - start[of], rest])
    yield _batch(
        (kinds, key[rows], did[rows], th[rows], start[rows], span[rows], delta, np.concatenate([did[of], rest]), np.concatenate([th[of], rest])), ASK_TYPES, ASK_COLUMNS
    )


def _asked(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Streams _asks over runs of whole keys; a key with very many rows comes in several, each led by the last source of the one before."""
    rest, split = None, None
    for b in batches:
        now = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(PART_COLUMNS)}
        if rest is not None:
            now = {c: np.concatenate([rest[c], now[c]]) for c in PART_COLUMNS}
        key = now["key"]
        if not len(key):
            continue
        at = int(np.searchsorted(key, key[-1]))
        if at:
            yield from _asks({c: v[:at] for c, v in now.items()}, split)
        rest = {c: v[at:] for c, v in now.items()}
        if len(rest["key"]) > most:
            split = int(rest["key"][0])
            yield from _asks(rest, split)
            opened = np.flatnonzero((rest["meta"] & 0xFF) == OPEN)
            block = rest["block"][opened]
            head = opened[np.searchsorted(block, block[-1])] if len(opened) else 0
            rest = {c: v[head : head + 1] for c, v in rest.items()} if len(opened) else None
    if rest is not None:
        yield from _asks(rest, split)


STRING_COLUMNS = ["key", "did", "th", "start", "sliced", "body"]
STRING_SCHEMA = "key long, did long, th long, start int, sliced boolean, body binary"
STRING_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]


def _cell_key(did: np.ndarray, th: np.ndarray, start: np.ndarray) -> np.ndarray:
    return _mixed(_mixed(_mixed(did.view(np.uint64)) + th.view(np.uint64)) + (start // CELL).astype(np.uint64) * _M1)


def _strings_of(did: int, th: int, body: bytes, asked: pa.StructArray) -> Iterator[tuple[int, int, bool, bytes]]:
    """(key, start, sliced, bytes) of what is asked of a document: runs of claims and sources, parts, windows."""
    kind, key, start, span, delta, of_did, of_th = (asked.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("kind", "key", "start", "span", "delta", "of_did", "of_th"))
    mine = kind == SOURCE
    of_did, of_th, delta = np.where(mine, did, of_did), np.where(mine, th, of_th), np.where(mine, 0, delta)
    runs = np.flatnonzero(mine | (kind == CLAIM))
    if len(runs):
        runs = runs[np.lexsort((start[runs], delta[runs], of_th[runs], of_did[runs], kind[runs]))]
        cell = _cell_key(of_did[runs], of_th[runs], start[runs] - delta[runs])
        s, e = start[runs], start[runs] + span[runs] + 1
        alike = np.append(False, (cell[1:] == cell[:-1]) & (delta[runs[1:]] == delta[runs[:-1]]) & (kind[runs[1:]] == kind[runs[:-1]]))
        first = np.flatnonzero(~(alike & np.append(False, s[1:] == e[:-1])))
        last = np.append(first[1:], len(runs)) - 1
        for k, a, b in zip(cell[first].view(np.int64).tolist(), s[first].tolist(), e[last].tolist(), strict=True):
            yield k, a, True, body[a : b + LENGTH - 1]
    for i in np.flatnonzero(kind == PART).tolist():
        yield int(key[i]), int(start[i]), False, body[start[i] : start[i] + span[i] + LENGTH]
    for i in np.flatnonzero(kind == SPLIT).tolist():
        a, n = int(start[i]), int(span[i]) + 1
        piece = body[a : a + n + LENGTH - 1]
        at = np.arange(n)
        hashes = _HASHER.of(_HASHER.sums(np.frombuffer(piece, np.uint8)), at, at + LENGTH).view(np.int64)
        for j, h in enumerate(hashes.tolist()):
            yield h, a + j, True, piece[j : j + LENGTH]


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, text, asked: array<struct>) -> the bytes asked for."""
    for b in batches:
        out, held = [[] for _ in STRING_COLUMNS], 0
        for i in range(b.num_rows):
            if not b.column(3)[i].is_valid:
                continue
            did, th, body = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(2)[i].as_buffer().to_pybytes()
            for key, start, sliced, piece in _strings_of(did, th, body, b.column(3)[i].values):
                for c, v in zip(out, (key, did, th, start, sliced, piece), strict=True):
                    c.append(v)
                held += len(piece)
                if held > 4 * SLICE:
                    yield _batch(out, STRING_TYPES, STRING_COLUMNS)
                    out, held = [[] for _ in STRING_COLUMNS], 0
        yield _batch(out, STRING_TYPES, STRING_COLUMNS)


COVER_COLUMNS = ["did", "th", "start", "span"]
COVER_SCHEMA = "did long, th long, start int, span int"
COVER_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]


def _covers(strings: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    did, th, start = (np.array([s[i] for s in strings], np.int64) for i in range(3))
    string, byte, length = repeats(did, th, start, [s[3] for s in strings])
    _, one, doc = np.unique(np.stack([did, th]), axis=1, return_index=True, return_inverse=True)
    d, s, e = _merged(doc.ravel()[string], byte, byte + length)
    return _batch((did[one[d]], th[one[d]], s, e - s), COVER_TYPES, COVER_COLUMNS)


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by (key, did, th, start) -> covered intervals, from suffix arrays of about SLICE bytes. A key's strings lie in one array,
    but for claims and windows of very many documents: these come in several arrays, each with the strings of the first document."""
    held, size, key, head = [], 0, None, []
    for b in batches:
        for k, did, th, start, sliced, body in zip(*(b.column(i).to_pylist() for i in range(5)), b.column(5), strict=True):
            row = (did, th, start, body.as_buffer().to_pybytes())
            if k != key:
                if size > SLICE:
                    yield _covers(held)
                    held, size = [], 0
                key, head = k, []
            elif sliced and size > SLICE and head[0][:2] != row[:2]:
                yield _covers(held)
                held, size = list(head), sum(len(h[3]) for h in head)
            if sliced and (not head or head[0][:2] == row[:2]):
                head.append(row)
            held.append(row)
            size += len(row[3])
    if held:
        yield _covers(held)


def spans(covers: list[int] | None, size: int, whole: bool) -> list[tuple[int, int]]:
    """Maximal covered runs of a document, from intervals packed as start << 32 | length."""
    if whole:
        return [(0, size)] if size >= LENGTH else []
    if not covers:
        return []
    both = np.array(covers, np.int64)
    start, length = both >> 32, both & 0xFFFFFFFF
    _, s, e = _merged(np.zeros(len(both), np.int64), start, start + length)
    return list(zip(s.tolist(), e.tolist(), strict=True))


def common_keys(texts: DataFrame) -> np.ndarray:
    """Keys of very many parts in a sample of about SAMPLE_ROWS of texts(did, th, body): how rows are dealt depends on it, what is found does
    not. A row of the sample has a bounded share of them, so there are few."""
    every = max(1, texts.count() // SAMPLE_ROWS)
    sample = texts.filter(F.pmod(F.xxhash64("did", "th"), F.lit(every)) == 0)
    parts = sample.mapInArrow(_parts(np.zeros(0, np.uint64)), PART_SCHEMA).filter((F.col("meta") % 256) == OPEN)
    often = parts.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > COMMON).select("key")
    return np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, body, covers, again): a struct of the other columns, the text, its covered intervals packed as start << 32 | length (null if
    there are none), and whether the row repeats one in id and text, so that it is covered whole."""
    named = docs.select(
        packed_row(docs, text).alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1)).alias("did"), F.col(text).cast("string").alias("body")
    )
    unique = named.groupBy("did").agg(F.count("*").alias("n")).filter(f"n > 1 OR did = {(1 << 63) - 1}").isEmpty()
    if unique:
        keyed = texts = named.withColumns({"th": F.lit(0).cast("long"), "again": F.lit(False)})
    else:
        placed = written(named.withColumns({"th": F.xxhash64(F.coalesce("body", F.lit(""))), "at": F.monotonically_increasing_id()}))
        firsts = placed.groupBy("did", "th").agg(F.min("at").alias("first")).withColumnsRenamed({"did": "of", "th": "of_th"})
        joined = placed.join(firsts, (F.col("did") == F.col("of")) & (F.col("th") == F.col("of_th")))
        keyed = written(joined.select("row", "did", "body", "th", (F.col("at") != F.col("first")).alias("again")))
        texts = keyed.filter("NOT again")
    bodies = texts.select("did", "th", F.coalesce("body", F.lit("")).alias("body"))
    met = bodies.mapInArrow(_parts(common_keys(bodies)), PART_SCHEMA).repartition("key").sortWithinPartitions(*PART_COLUMNS)
    asks = written(met.mapInArrow(_asked, ASK_SCHEMA))
    asked = F.collect_list(F.struct("kind", "key", "start", "span", "delta", "of_did", "of_th"))
    wanted = asks.filter(f"kind <> {COVER}").groupBy("did", "th").agg(asked.alias("asked")).withColumnsRenamed({"did": "of", "th": "of_th"})
    mine = (F.col("did") == F.col("of")) & (F.col("th") == F.col("of_th"))
    # every column goes along, so that this exchange of texts and the last one are the same and Spark runs it once
    strings = keyed.join(wanted, mine, "left").select("did", "th", "body", "asked", "row", "again").filter("NOT again").mapInArrow(_strings, STRING_SCHEMA)
    dealt = strings.repartition("key").sortWithinPartitions("key", "did", "th", "start")
    covers = (
        asks.filter(f"kind = {COVER}").select(*COVER_COLUMNS).unionAll(dealt.mapInArrow(_covered, COVER_SCHEMA))
        .groupBy("did", "th").agg(F.collect_list(F.expr("shiftleft(CAST(start AS BIGINT), 32) | span")).alias("covers"))
        .withColumnsRenamed({"did": "of", "th": "of_th"})
    )
    return keyed.join(covers, mine, "left").select("row", "body", "covers", "again")


def digests(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns from what repeated_spans() gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, count, digest = [], [], [], []
            for text, covers, again in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                body = text.as_buffer()
                body = b"" if body is None else body.to_pybytes()
                gone, at, kept = spans(covers, len(body), again), 0, hashlib.sha256()
                for s, e in gone:
                    kept.update(body[at:s])
                    at = e
                kept.update(body[at:])
                n.append(len(body))
                removed.append(sum(e - s for s, e in gone))
                count.append(len(gone))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in (n, removed, count)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    given = found.select(F.col("row").getField(doc_id).alias("doc_id"), "body", "covers", "again")
    return given.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What the removal of repeated passages leaves of every document."""
    return digests(repeated_spans(table(spark, sf_dir, "documents", "doc_id", "text")))


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with repeated passages cut out of the text; a character that loses a byte goes whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for value, covers, again in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                body = value.as_buffer()
                if body is None:
                    out.append(None)
                    continue
                body, at, left = body.to_pybytes(), 0, []
                for s, e in spans(covers, len(body), again):
                    left.append(body[at:s].decode("utf-8", "ignore"))
                    at = e
                out.append("".join([*left, body[at:].decode("utf-8", "ignore")]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["row", "body"])

    found = repeated_spans(docs, doc_id, text)
    schema = T.StructType([found.schema["row"], T.StructField("body", T.StringType())])
    back = found.mapInArrow(run, schema)
    return back.select(*unpacked_row(F.col("row"), docs.columns, **{text: F.col("body")}))
