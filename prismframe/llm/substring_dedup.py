"""Operator 2: near-duplicate passages by compact windows.

Tokens are hashed 5-word shingles.  Under each of ``hashes`` hash functions the Cartesian tree of a text's
token hashes has a node for each token; the node's *compact window* (l, c, r) stands for all
subsequences [i, j] with l <= i <= c <= j <= r, whose min-hash is that of c.  Only windows that hold a
passage of ``least`` words matter; they are the tree's top and are found as the runs of equal arg-minima
of sliding windows, some 2 / ``least`` of the tokens.  Two passages that share a signature lie in
windows with equal min-hash values, so windows are grouped by value (over all hash functions, any of
which suffices: at a similarity of 0.8 three miss a pair with probability 0.008).

Windows whose value occurs in one document are dropped.  The others are verified around c: a passage of ``least`` words that
holds c lies within ``least`` words of it, so that much context is compared.  Pairs of passages count whose shingles (with repeats, in
any order) have a similarity of at least ``similarity`` and of which one has ``least`` words (the other may have inserted ones, some 11
more at 50 words and 0.8); the union of those of all nodes covers the clean parts of longer passages.  A longer passage that reaches the
similarity only as a whole is covered only as far as such pairs reach.  Equal contexts are compared once, and where all contexts of a
value are equal only their places are shuffled.  The contexts of a large group lead in turn, those with most partners first.  A pair
is left uncompared only if it shares too few tokens, or if both are covered as far as the tokens that other documents of the group
share allow and links already join them: no link between passages is lost, as a passage's class is all that links reach.  Groups of
more than ``GROUP_ROWS`` windows are parted, and every part meets every part, so that a task never holds more.

Documents of fewer than ``least`` words have no passages.  Null texts and ids: a null text is empty, rows
with a null id are left out (a result row could not name them).  Repeated ids are one document.  Words are lower-cased (A-Z).  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismframe.llm.common import bit_map, broadcast_if_small, hashed_texts, materialize, mix, rows_of, shingles, table
from prismframe.llm.components import connected_components

SHINGLE = 5
_LOW = np.uint64(63)
#: Contexts of a group that all meet, and that all do which share enough tokens; members of a group that meet in one task (larger
#: groups are parted, and part meets part).
FEW = 12
SOME = 80
GROUP_ROWS = 20_000


def compact_windows(tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int, seed: int):
    """Nodes of several texts' token arrays, laid end to end, whose window holds ``width`` tokens.

    Text k's tokens are [begins[k], ends[k]).  Returns (text, l, c, r, value), absolute places.  Of equal tokens
    the first in the window is the pivot, wherever the text stands.  Where a repeated word or phrase gives a run of nodes with
    one token, only so many stay that each passage of ``width`` tokens with such a pivot holds one of them."""
    keys = mix(tokens, seed)

    def first_least(at: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.where(keys[other] < keys[at], other, at)

    # first minimum of every run of ``width`` keys by doubling
    low, span = np.arange(len(keys)), 1
    while span * 2 <= width:
        low = first_least(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = first_least(low[: len(low) - (width - span)], low[width - span :])
    counts = np.maximum(ends - begins - width + 1, 0)
    text = np.repeat(np.arange(len(begins)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begins, counts)
    pivot = low[starts]
    new = np.ones(len(pivot), bool)
    new[1:] = (pivot[1:] != pivot[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(pivot)) - 1 if len(pivot) else first
    text, left, c, right = text[first], starts[first], pivot[first], starts[last] + width - 1
    # a run of nodes with one token (a repeated word or phrase): some, and the last, of which each passage holds one
    same = np.zeros(len(c) + 1, bool)
    same[1:-1] = (text[1:] == text[:-1]) & (keys[c[1:]] == keys[c[:-1]]) & (c[1:] - c[:-1] < width)
    head = c[np.maximum.accumulate(np.where(same[:-1], 0, np.arange(len(c))))] if len(c) else c
    step = (c - head) // max(1, width // 2)
    keep = ~same[:-1] | ~same[1:]
    keep[1:] |= step[1:] != step[:-1]
    return text[keep], left[keep], c[keep], right[keep], (keys[c[keep]] & ~_LOW) | np.uint64(seed % 64)


def _nodes(rows: list[tuple], width: int, hashes: int):
    hashed, starts = hashed_texts([t.lower() if t else None for _, t in rows])
    begins, ends = starts[:-1], np.maximum(starts[1:] - SHINGLE + 1, starts[:-1])
    tokens = shingles(hashed, SHINGLE)
    if len(tokens) < width:
        return tokens, begins, ends, []
    return tokens, begins, ends, [compact_windows(tokens, begins, ends, width, f) for f in range(1, hashes + 1)]


def _likes(tokens: np.ndarray, begins: np.ndarray, ends: np.ndarray, width: int):
    """A function of (text, c): tokens before and after c in its context, and a hash that tells contexts apart."""
    base = np.uint64(0xD6E8FEB86659FD93)
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(tokens), base)), dtype=np.uint64)
    back = np.cumprod(np.append(np.uint64(1), np.full(len(tokens), np.uint64(pow(int(base), -1, 1 << 64)))), dtype=np.uint64)
    sums = np.append(np.uint64(0), np.cumsum(mix(tokens, 7) * powers[:-1], dtype=np.uint64))

    def of(text: np.ndarray, c: np.ndarray):
        before, after = np.minimum(c - begins[text], width - 1), np.minimum(ends[text] - 1 - c, width - 1)
        inside = (sums[c + after + 1] - sums[c - before]) * back[c - before]
        return before, after, mix(inside + mix((before * width + after).astype(np.uint64), 6))

    return of


def _values(width: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            ids = np.array([r[0] for r in rows], np.int64)
            tokens, begins, ends, nodes = _nodes(rows, width, hashes)
            like_of = _likes(tokens, begins, ends, width)
            for text, _, c, _, value in nodes:
                like = like_of(text, c)[2]
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ids[text]), pa.array(like.view(np.int64))], ["value", "doc_id", "like"])

    return run


def _contexts(width: int, hashes: int, passes: np.ndarray, several: np.ndarray):
    """Windows with values that pass the filter: value, hash of the context, doc_id, place of c, tokens after c and, if the value may
    have ``several`` contexts, 32 bits of each token near c."""
    around = np.arange(-(width - 1), width)

    def marked(bits: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = (mix(value, 99) % np.uint64(8 * len(bits))).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in rows_of(batches):
            ids = np.array([r[0] for r in rows], np.int64)
            tokens, begins, ends, nodes = _nodes(rows, width, hashes)
            short, like_of = (tokens >> np.uint64(32)).astype(np.uint32), _likes(tokens, begins, ends, width)
            for text, _, c, _, value in nodes:
                on = marked(passes, value)
                text, c, value = text[on], c[on], value[on]
                _, after, like = like_of(text, c)
                columns = [value.view(np.int64), like.view(np.int64), ids[text], (c - begins[text]).astype(np.int32), after.astype(np.int32)]
                need = marked(several, value)
                for some in (need, ~need):
                    if not some.any():
                        continue
                    near = np.ascontiguousarray(short[np.clip(c[some][:, None] + around, 0, len(short) - 1)]) if some is need else None
                    blobs = pa.nulls(int(some.sum()), pa.binary()) if near is None else pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * len(around)), len(near), [None, pa.py_buffer(near)]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(v[some]) for v in columns), blobs], ["value", "like", "doc_id", "c", "after", "near"])

    return run


class _Cover:
    """What the passages of one context cover that are like passages of another.

    Two passages of a and b tokens, both around c (as all of ``width`` tokens in a context are), that share o tokens, repeats counted,
    have a similarity of o / (a + b - o).  One has ``width`` tokens, the other up to width / similarity."""

    def __init__(self, width: int, similarity: float):
        self.width, self.similarity, self.size = width, similarity, 2 * width - 1
        self.longest = min(int(width / similarity + 1e-9), self.size)
        self.least = self.need(2 * width)
        # (tokens to share, the longest passage that they suffice for)
        self.steps = list({self.need(n + width): n for n in range(width, self.longest + 1)}.items())

    def need(self, n: int) -> int:
        return int(np.ceil(n * self.similarity / (1 + self.similarity) - 1e-9))

    def possible(self, shared: np.ndarray, before: np.ndarray, after: np.ndarray):
        """The most (first, last place) that passages can cover if only the tokens marked in ``shared`` have partners."""
        width = self.width
        lo, hi = np.full(len(shared), width), np.full(len(shared), -width)
        rows = np.flatnonzero(shared.sum(axis=1) >= self.least)
        for k in (rows[i : i + 1024] for i in range(0, len(rows), 1024)):
            total = np.zeros((len(k), self.size + 1), np.int16)
            np.cumsum(shared[k], axis=1, out=total[:, 1:])
            for n in range(width, self.longest + 1):
                first = np.arange(self.size + 1 - n) - width + 1
                on = (total[:, n:] - total[:, :-n] >= self.need(n + width)) & (first >= -before[k, None]) & (first + n - 1 <= after[k, None])
                if on.any():
                    some = on.any(axis=1)
                    lo[k] = np.where(some, np.minimum(lo[k], first[on.argmax(axis=1)]), lo[k])
                    hi[k] = np.where(some, np.maximum(hi[k], first[on.shape[1] - 1 - on[:, ::-1].argmax(axis=1)] + n - 1), hi[k])
        return lo, hi

    def pairs(self, x, bx, ax, y, by, ay):
        """Row by row: first and last place covered in x, and in y (first > last if nothing is)."""
        out = np.empty((4, len(x)), np.int64)
        for k in (slice(i, i + 512) for i in range(0, len(x), 512)):
            row, p, q, odd = self._matches(x[k], bx[k], ax[k], y[k], by[k], ay[k])
            out[:, k], odd = self.in_order(row, p, q, odd, bx[k], ax[k], by[k], ay[k])
            at = k.start + np.flatnonzero(odd)
            if len(at):
                out[:, at] = self.in_any_order(x[at], bx[at], ax[at], y[at], by[at], ay[at])
        return tuple(out)

    def _matches(self, x, bx, ax, y, by, ay):
        """(row, place in x, place in y) of equal tokens, places from 0 and by place in y; ``odd`` rows hold some token of both several times."""
        at = np.arange(self.size)
        keys = np.empty((len(x), 2 * self.size), np.uint64)
        for side, (v, b, a) in enumerate(((x, bx, ax), (y, by, ay))):
            ok = (at >= self.width - 1 - b[:, None]) & (at <= self.width - 1 + a[:, None])
            keys[:, side * self.size : (side + 1) * self.size] = np.where(ok, v, np.uint64(1 << 32)) << np.uint64(8) | (side << 7 | at).astype(np.uint64)
        keys.sort(axis=1)
        token = keys >> np.uint64(8)
        same = (token[:, 1:] == token[:, :-1]) & (token[:, 1:] < np.uint64(1 << 32))
        both = same & ((keys[:, 1:] ^ keys[:, :-1]) & np.uint64(128) != 0)
        odd = (both[:, 1:] & same[:, :-1]).any(axis=1) | (both[:, :-1] & same[:, 1:]).any(axis=1)
        row, at = np.nonzero(both)
        points = np.sort(row << 14 | (keys[row, at + 1] & np.uint64(127)).astype(np.int64) << 7 | (keys[row, at] & np.uint64(127)).astype(np.int64))
        return points >> 14, points & 127, points >> 7 & 127, odd

    def in_order(self, row: np.ndarray, p: np.ndarray, q: np.ndarray, odd: np.ndarray, bx, ax, by, ay):
        """What ``pairs`` returns, from the matches (row, place in x, place in y) by row and place in y, and the rows left out: ``odd``
        ones and those whose tokens stand in another order in x.

        The tokens that two passages share are then some that follow one another: as many as needed, near enough in x and in y."""
        width, longs = self.width, np.array([[self.width], [-self.width], [self.width], [-self.width]])
        out = np.tile(longs, len(odd))
        odd = odd.copy()
        odd[row[1:][(row[1:] == row[:-1]) & (p[1:] < p[:-1])]] = True
        fits = (bx + ax + 1 >= width) & (by + ay + 1 >= width) & ~odd & (np.bincount(row, minlength=len(odd)) >= self.least)
        on = fits[row]
        row, p, q = row[on], p[on] - width + 1, q[on] - width + 1
        for c, n in self.steps:
            k = np.flatnonzero(row[: max(0, len(row) - c + 1)] == row[c - 1 :])
            if not len(k):
                break
            last = k + c - 1
            far, far2 = p[last] - p[k], q[last] - q[k]
            for mine, others in ((width, n), (n, width)):
                some = np.flatnonzero((far < mine) & (far2 < others))
                if not len(some):
                    continue
                first, of = k[some], row[k[some]]
                new = np.append(True, of[1:] != of[:-1])
                head, tail, of = first[new], first[np.append(new[1:], True)], of[new]
                end = head + c - 1
                out[0, of] = np.minimum(out[0, of], np.maximum(-bx[of], p[end] - mine + 1))
                out[1, of] = np.maximum(out[1, of], np.minimum(ax[of], p[tail] + mine - 1))
                out[2, of] = np.minimum(out[2, of], np.maximum(-by[of], q[end] - others + 1))
                out[3, of] = np.maximum(out[3, of], np.minimum(ay[of], q[tail] + others - 1))
        return out, odd

    def in_any_order(self, x, bx, ax, y, by, ay):
        """What ``pairs`` returns.

        Tokens equal at equal places are shared for certain, so is the pivot as often as both hold it, and no more than the tokens that
        occur in the other context at all; where these bounds differ, the passages are compared one by one."""
        out = np.tile(np.array([[self.width], [-self.width], [self.width], [-self.width]]), len(x))
        found = [self._shared(k, x, bx, ax, y, by, ay) for k in (slice(i, i + 128) for i in range(0, len(x), 128))]
        if not found:
            return tuple(out)
        straight, mine, others = (np.concatenate(v) for v in zip(*found, strict=True))
        fits = (bx + ax + 1 >= self.width) & (by + ay + 1 >= self.width)
        at = np.flatnonzero((np.minimum(mine.sum(axis=1), others.sum(axis=1)) >= self.least) & fits)
        straight, mine, others = straight[at], mine[at], others[at]
        within = self._within(straight)
        out[:2, at], out[2:, at] = self._straight(within, bx[at], ax[at]), self._straight(within, by[at], ay[at])
        found = self._pivots(x[at], bx[at], ax[at], y[at], by[at], ay[at])
        out[:, at] = np.where([[True], [False]] * 2, np.minimum(out[:, at], found), np.maximum(out[:, at], found))
        bound = out.copy()
        for v, rows, before, after in ((mine, slice(0, 2), bx, ax), (others, slice(2, 4), by, ay)):
            (some,) = np.nonzero((v != straight).any(axis=1))
            bound[rows, at[some]] = self.possible(v[some], before[at[some]], after[at[some]])
        at = at[(bound[:, at] != out[:, at]).any(axis=0) & (bound[0, at] <= bound[1, at]) & (bound[2, at] <= bound[3, at])]
        for k in (at[i : i + 64] for i in range(0, len(at), 64)):
            same = self._equal(k, x, bx, ax, y, by, ay)
            repeats = (same.sum(axis=1, dtype=np.int8).max(axis=1) > 1) | (same.sum(axis=2, dtype=np.int8).max(axis=1) > 1)
            for some, several in ((np.flatnonzero(~repeats), False), (np.flatnonzero(repeats), True)):
                if len(some):
                    here, order = k[some], np.array([2, 3, 0, 1])
                    found = self._one_way(same[some], x[here], bx[here], ax[here], y[here], by[here], ay[here], several, out[:, here], bound[:, here])
                    if (found != bound[:, here]).any():
                        back = same[some].transpose(0, 2, 1), y[here], by[here], ay[here], x[here], bx[here], ax[here]
                        found = self._one_way(*back, several, found[order], bound[order][:, here])[order]
                    out[:, here] = found
        return tuple(out)

    def _equal(self, k, x, bx, ax, y, by, ay) -> np.ndarray:
        place = np.arange(self.size) - self.width + 1
        okx, oky = ((place >= -b[k, None]) & (place <= a[k, None]) for b, a in ((bx, ax), (by, ay)))
        return (x[k][:, :, None] == y[k][:, None, :]) & okx[:, :, None] & oky[:, None, :]

    def _shared(self, *pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens equal at equal places, those of x that y holds and those of y that x holds."""
        same = self._equal(*pairs)
        return np.ascontiguousarray(same.diagonal(axis1=1, axis2=2)), same.any(axis=2), np.logical_or.reduce(same, axis=1)

    def _within(self, on: np.ndarray) -> np.ndarray:
        """How many tokens are marked in each passage of ``width``."""
        total = np.zeros((len(on), self.size + 1), np.int8)
        np.cumsum(on, axis=1, out=total[:, 1:])
        return total[:, self.width :] - total[:, : -self.width]

    def _straight(self, shared: np.ndarray, before, after) -> np.ndarray:
        """What is covered in one of two contexts by tokens shared at equal places: ``shared`` in each passage of ``width`` tokens."""
        width, size, best = self.width, self.size, shared
        lo, hi = np.full(len(shared), width), np.full(len(shared), -width)
        for n in range(width, self.longest + 1):
            if n > width:
                best = np.maximum(best[:, :-1], shared[:, n - width :])
            first = np.arange(size + 1 - n) - width + 1
            good = (best >= self.need(n + width)) & (first >= -before[:, None]) & (first + n - 1 <= after[:, None])
            some = good.any(axis=1)
            lo = np.where(some, np.minimum(lo, first[good.argmax(axis=1)]), lo)
            hi = np.where(some, np.maximum(hi, first[-1] - good[:, ::-1].argmax(axis=1) + n - 1), hi)
        return np.stack([lo, hi])

    def _pivots(self, x, bx, ax, y, by, ay) -> np.ndarray:
        """What is covered by x's pivot alone, which passages share as often as both hold it."""
        width, place = self.width, np.arange(self.size) - self.width + 1
        sums = np.zeros((2, len(x), self.size + 1), np.int8)
        for k, (v, b, a) in enumerate(((x, bx, ax), (y, by, ay))):
            np.cumsum((v == x[:, width - 1 : width]) & (place >= -b[:, None]) & (place <= a[:, None]), axis=1, out=sums[k, :, 1:])
        out = np.tile(np.array([[width], [-width], [width], [-width]]), len(x))
        for n in range(width, self.longest + 1):
            for longs in ((width, n), (n, width)) if n > width else ((n, n),):
                good = []
                for m, total, b, a in zip(longs, sums, (bx, by), (ax, ay), strict=True):
                    first = place[: self.size + 1 - m]
                    good.append((total[:, m:] - total[:, :-m] >= self.need(n + width)) & (first >= -b[:, None]) & (first + m - 1 <= a[:, None]))
                at = np.flatnonzero(good[0].any(axis=1) & good[1].any(axis=1))
                for k, (m, on) in enumerate(zip(longs, good, strict=True)):
                    on = on[at]
                    out[2 * k, at] = np.minimum(out[2 * k, at], on.argmax(axis=1) - width + 1)
                    out[2 * k + 1, at] = np.maximum(out[2 * k + 1, at], self.size - width - on[:, ::-1].argmax(axis=1))
        return out

    def _one_way(self, same: np.ndarray, x, before, after, y, before2, after2, several: bool, out: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Passages of ``width`` tokens of x with y's of up to ``longest``, where ``same`` marks the equal tokens.  Tokens that occur
        ``several`` times are counted as often as both passages hold them.  ``out`` is what is known to be covered, ``bound`` the most
        that can be."""
        width, size = self.width, self.size
        first = np.arange(width) - width + 1
        fits = (first >= -before[:, None]) & (first + width - 1 <= after[:, None])
        if several:
            held, held2, same = self._several(same, x, y)
            held = held[:, :, width:] - held[:, :, :-width]
        rows = np.zeros((len(same), size + 1, size), np.int8)
        np.cumsum(same, axis=1, out=rows[:, 1:])
        total = np.zeros((len(same), width, size + 1), np.int8)
        np.cumsum(rows[:, width:] - rows[:, :-width], axis=2, out=total[:, :, 1:])
        for n in range(self.longest, width - 1, -1):
            if (out == bound).all():
                break
            shared = total[:, :, n:] - total[:, :, :-n]
            for mine, others in zip(held.swapaxes(0, 1), (held2[:, :, n:] - held2[:, :, :-n]).swapaxes(0, 1), strict=True) if several else ():
                shared = shared + np.minimum(mine[:, :, None], others[:, None, :])
            first2 = np.arange(size + 1 - n) - width + 1
            fits2 = (first2 >= -before2[:, None]) & (first2 + n - 1 <= after2[:, None])
            good = (shared >= self.need(n + width)) & fits[:, :, None] & fits2[:, None, :]
            if good.any():
                found = [f(np.where(on, start + m, none), axis=1) for start, long, on in ((first, width, good.any(axis=2)), (first2, n, good.any(axis=1))) for f, m, none in ((np.min, 0, width), (np.max, long - 1, -width))]
                out = np.where([[True], [False]] * 2, np.minimum(out, found), np.maximum(out, found))
        return out

    def _several(self, same: np.ndarray, x: np.ndarray, y: np.ndarray):
        """How often tokens that x or y repeats occur up to each place of x and of y (pair, token, place), and ``same`` without them."""
        on, on2 = same.any(axis=2), same.any(axis=1)
        first = ((x[:, :, None] == x[:, None, :]) & on[:, None, :]).argmax(axis=2)
        repeated = (same.sum(axis=2, dtype=np.int8) > 1) | (same & (same.sum(axis=1, dtype=np.int8) > 1)[:, None, :]).any(axis=2)
        pair, at = np.nonzero(repeated & (first == np.arange(self.size)))
        slot = np.arange(len(pair)) - np.searchsorted(pair, pair)
        out = []
        for v, there in ((x, on), (y, on2)):
            sums = np.zeros((len(same), int(slot.max(initial=-1)) + 1, self.size + 1), np.int8)
            sums[pair, slot, 1:] = np.cumsum((v[pair] == x[pair, at][:, None]) & there[pair], axis=1)
            out.append(sums)
        return *out, same & ~repeated[:, :, None]


def _verified(width: int, similarity: float):
    """Sorted windows (value, part, like, ...) -> spans (in tokens) like passages of other documents, and the ``hub`` that stands for all
    contexts of the group that links join.

    Members of a group with equal contexts (``like``) are compared once.  In small groups all contexts meet; in larger
    ones they lead in turn, those with most partners first.  Parts below zero are of values with one context."""
    cover, place = _Cover(width, similarity), np.arange(-(width - 1), width)

    def partners(names: np.ndarray, lo: np.ndarray, hi: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """The tokens that another document's context in the group has too."""
        rows = np.nonzero(ok)[0]
        least, most = np.full(names.max() + 1, np.iinfo(np.int64).max), np.full(names.max() + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, names, lo[rows])
        np.maximum.at(most, names, hi[rows])
        out = np.zeros(ok.shape, bool)
        out[ok] = (least != most)[names]
        return out

    def verify(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        value, part, like, doc, c, after = (batch[k].to_numpy() for k in range(6))
        new = np.append(True, (value[1:] != value[:-1]) | (part[1:] != part[:-1]))
        fresh = new.copy()
        fresh[1:] |= like[1:] != like[:-1]
        rep, edges = np.cumsum(fresh) - 1, np.flatnonzero(fresh)  # each row's context
        low, high = np.minimum.reduceat(doc, edges), np.maximum.reduceat(doc, edges)
        group = (np.cumsum(new) - 1)[edges]
        none = bytes(4 * len(place))
        near = np.frombuffer(b"".join(b or none for b in batch["near"].take(pa.array(edges)).to_pylist()), np.uint32).reshape(len(edges), -1)
        before, after = np.minimum(c[edges], width - 1).astype(np.int64), np.minimum(after[edges], width - 1).astype(np.int64)
        # a context that two documents have is covered whole, if it holds a passage
        whole = ((low != high) | (part[edges] < 0)) & (before + after + 1 >= width)
        done_lo, done_hi = np.where(whole, -before, width), np.where(whole, after, -width)
        joined = np.arange(len(edges))  # the first context that links reach

        def meet(x: np.ndarray, y: np.ndarray, compare=cover.pairs) -> np.ndarray:
            return take(x, y, *compare(near[x], before[x], after[x], near[y], before[y], after[y]))

        def take(x, y, lo, hi, lo2, hi2) -> np.ndarray:
            for at, first, last in ((x, lo, hi), (y, lo2, hi2)):
                good = first <= last
                np.minimum.at(done_lo, at[good], first[good])
                np.maximum.at(done_hi, at[good], last[good])
            return lo <= hi

        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(group))
        sizes = ends - starts
        small, x, y = np.repeat((sizes > 1) & (sizes <= FEW), sizes), [], []
        for d in range(1, min(FEW, len(group))):
            at = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]) & ((low[:-d] != high[d:]) | (high[:-d] != low[d:])))
            x, y = [*x, at], [*y, at + d]
        for a, b in zip(starts[(sizes > FEW) & (sizes <= SOME)].tolist(), ends[(sizes > FEW) & (sizes <= SOME)].tolist(), strict=True):
            rows = np.arange(a, b)
            row, at = np.nonzero((place >= -before[rows, None]) & (place <= after[rows, None]))
            known, names = np.unique(near[a + row, at], return_inverse=True)
            often = np.bincount(names) > 1
            # distinct tokens in common, of which a context may hold some several times
            marks = np.zeros((b - a, int(often.sum())), np.float32)
            counts = np.bincount(row * len(known) + names, minlength=(b - a) * len(known)).reshape(b - a, -1)
            marks[:] = np.sqrt(counts[:, often])
            differ = (low[rows, None] != high[rows]) | (high[rows, None] != low[rows])
            one, other = np.nonzero(np.triu((marks @ marks.T > cover.least - 0.01) & differ, 1))
            x, y = [*x, a + one], [*y, a + other]
        if x:
            x, y = np.concatenate(x), np.concatenate(y)
            linked = np.concatenate([np.empty(0, bool), *(meet(x[k], y[k]) for k in (slice(i, i + 4096) for i in range(0, len(x), 4096)))])
            x, y = x[linked], y[linked]
            was = None
            while was is None or (joined != was).any():
                was = joined.copy()
                for one, other in ((x, y), (y, x)):
                    np.minimum.at(joined, one, joined[other])
        for a, b in zip(starts[sizes > SOME].tolist(), ends[sizes > SOME].tolist(), strict=True):
            rows = np.arange(a, b)
            ok = (place >= -before[rows, None]) & (place <= after[rows, None])
            known, names = np.unique(near[rows][ok], return_inverse=True)
            shared = partners(names, low[rows], high[rows], ok)
            most_lo, most_hi = np.full(len(low), width), np.full(len(low), -width)
            most_lo[rows], most_hi[rows] = cover.possible(shared, before[rows], after[rows])
            tokens = np.full(ok.shape, len(known), np.int32)
            tokens[ok] = names
            tokens[~shared] = len(known)
            order = np.argsort(-shared.sum(axis=1), kind="stable")
            order = order[most_lo[a + order] <= most_hi[a + order]]
            tokens, order = tokens[order], a + order
            # tokens that a context holds several times
            several, inner = np.zeros(tokens.shape, bool), np.sort(tokens, axis=1)
            for k in np.flatnonzero(((inner[:, 1:] == inner[:, :-1]) & (inner[:, 1:] < len(known))).any(axis=1)).tolist():
                again = inner[k, 1:][inner[k, 1:] == inner[k, :-1]]
                several[k] = np.isin(tokens[k], again[again < len(known)])
            slot = np.full(len(known) + 1, -1, np.int16)  # where the lead holds a token
            settled = lambda at: (done_lo[at] <= most_lo[at]) & (done_hi[at] >= most_hi[at])
            for k, lead in enumerate(order.tolist()):
                later = np.arange(k + 1, len(order))
                other = order[later]
                if settled(lead):
                    open_ = ~settled(other) | (joined[other] != joined[lead])
                    later, other = later[open_], other[open_]
                on = (low[other] != high[lead]) | (high[other] != low[lead])
                later, other = later[on], other[on]
                if not len(other):
                    continue
                slot[tokens[k]] = np.arange(len(place))
                slot[-1] = -1
                common = (slot[tokens[later]] >= 0).sum(axis=1)
                best = np.argsort(-common, kind="stable")[: int((common >= cover.least).sum())]
                later, other = later[best], other[best]
                for at in range(0, len(other), 256):
                    some, row = other[at : at + 256], later[at : at + 256]
                    open_ = (joined[some] != joined[lead]) | ~settled(some) | ~settled(lead)
                    some, row = some[open_], row[open_]
                    if not len(some):
                        continue
                    there = slot[tokens[row]]
                    pair, q = np.nonzero(there >= 0)
                    p = there[pair, q].astype(np.int64)
                    odd = np.zeros(len(some), bool)
                    odd[pair[several[k, p] | several[row[pair], q]]] = True
                    mine = np.full(len(some), before[lead]), np.full(len(some), after[lead])
                    found, odd = cover.in_order(pair, p, q, odd, *mine, before[some], after[some])
                    linked = some[take(np.full(len(some), lead), some, *found)]
                    if odd.any():
                        # of those that links join already, the ones whose common tokens, wherever they stand, could cover more of either
                        row, one = row[odd], some[odd]
                        apart = joined[one] != joined[lead]
                        at_own = np.unique(tokens[k], return_inverse=True)[1]
                        marks = np.zeros((len(one), len(place)), bool)
                        pair, q = np.nonzero(there[odd] >= 0)
                        marks[pair, at_own[there[odd][pair, q]]] = True
                        lo, hi = cover.possible(marks[:, at_own], np.full(len(one), before[lead]), np.full(len(one), after[lead]))
                        lo2, hi2 = cover.possible(there[odd] >= 0, before[one], after[one])
                        gain = (lo < done_lo[lead]) | (hi > done_hi[lead]) | (lo2 < done_lo[one]) | (hi2 > done_hi[one])
                        one = one[(apart | gain) & (lo <= hi) & (lo2 <= hi2)]
                        if len(one):
                            linked = np.append(linked, one[meet(np.full(len(one), lead), one, cover.in_any_order)])
                    group_of = np.unique(joined[np.append(linked, lead)])
                    if len(group_of) > 1:
                        joined[a:b][np.isin(joined[a:b], group_of)] = group_of[0]
                slot[tokens[k]] = -1
        good = done_lo[rep] <= done_hi[rep]
        if good.any():
            at, f = rep[good], value[good] & 63
            first = edges[joined[at]]
            hub = mix(mix(value[first].view(np.uint64), 1) + mix(np.maximum(part[first], -1).astype(np.int64).view(np.uint64), 2) + mix(like[first].view(np.uint64), 3))
            columns = [doc[good], c[good] + done_lo[at], c[good] + done_hi[at], hub.view(np.int64), f]
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns], ["doc_id", "first", "last", "hub", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 4096:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            value, part = rows["value"].to_numpy(), rows["part"].to_numpy()
            inside = np.flatnonzero((value != value[-1]) | (part != part[-1]))
            cut = int(inside[-1]) + 1 if len(inside) else 0  # the last group may go on
            if cut:
                yield from verify(rows.slice(0, cut))
            held = [rows.slice(cut)]
        if held:
            yield from verify(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _value_filter(values: DataFrame) -> np.ndarray:
    """Bit map of hashed values, some 8 bits for each and never more than 16 MB."""
    return bit_map(values, 99)


def repeated_passages(documents: DataFrame, least: int = 50, hashes: int = 3, similarity: float = 0.8) -> DataFrame:
    """(doc_id, start_word, end_word, class_doc_id, n_hashes): the passages that (nearly) repeat in another
    document.  ``end_word`` is exclusive; ``class_doc_id`` is the smallest id of the documents whose passages links reach from
    this one; ``n_hashes`` counts the hash functions that found it."""
    width = least - SHINGLE + 1
    docs = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    windows = docs.mapInArrow(_values(width, hashes), "value long, doc_id long, like long")
    shared = windows.groupBy("value").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.min("like").alias("l"), F.max("like").alias("m"))
    shared = materialize(shared.where("lo < hi").select("value", "n", F.expr("l = m").alias("alone")), "shared")
    passes, several = _value_filter(shared.select("value")), _value_filter(shared.where("not alone").select("value"))
    contexts = docs.mapInArrow(_contexts(width, hashes, passes, several), "value long, like long, doc_id long, c int, after int, near binary")
    large = shared.where(F.col("n") > GROUP_ROWS).select("value", "alone", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("g"))
    contexts = contexts.join(F.broadcast(large) if large.count() <= 100_000 else large, "value", "left")
    # part meets part: each row of a large group goes to as many pairs of parts as there are parts, but equal contexts need not meet
    mine = F.pmod("like", F.coalesce("g", F.lit(1))).cast("int")
    others = F.when(F.col("alone"), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))
    contexts = contexts.withColumns({"mine": mine, "o": F.explode(others)})
    part = F.when(F.col("o") < 0, -1 - F.pmod(F.xxhash64("doc_id"), F.col("g"))).otherwise(F.least("mine", "o").cast("long") * (1 << 31) + F.greatest("mine", "o")).alias("part")
    contexts = contexts.select("value", part, "like", "doc_id", "c", "after", "near")
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(n, "value", "part").sortWithinPartitions("value", "part", "like")
    spans = dealt.mapInArrow(_verified(width, similarity), "doc_id long, first long, last long, hub long, hash long")
    by_doc = Window.partitionBy("doc_id").orderBy("first", "last", "hub", "hash")
    until = F.max("last").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    parted = spans.distinct().withColumn("new", F.coalesce((F.col("first") > until).cast("int"), F.lit(1)))
    parted = materialize(parted.withColumn("k", F.sum("new").over(by_doc)).drop("new").withColumn("id", F.xxhash64("doc_id", "k")), "spans")
    found = parted.groupBy("doc_id", "k", "id").agg(F.min("first").alias("start_word"), (F.max("last") + SHINGLE).alias("end_word"), F.countDistinct("hash").alias("n_hashes"))
    # passages that meet in a hub are of one class
    held = parted.select("id", "hub").distinct()
    links = held.join(held.groupBy("hub").agg(F.min("id").alias("first")), "hub").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    comps = connected_components(materialize(links, "passage_links"))
    classes = materialize(parted.select("id", "doc_id").distinct().join(comps, "id").groupBy("component").agg(F.min("doc_id").alias("class_doc_id")), "classes")
    placed = found.join(comps, "id").join(broadcast_if_small(classes), "component")
    return placed.select("doc_id", "start_word", "end_word", "class_doc_id", "n_hashes")


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
