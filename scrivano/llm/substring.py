"""Operators 1 and 10: removal of repeated passages, by words and by bytes."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from .anchors import PrefixHash, U, byte_symbols, elect, mix, widest
from .repeats import HOT, Layout, Plan, Units, equal_bytes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = U(0x8CB92BA72F3D8DD7)


# -- words -------------------------------------------------------------------
def word_edges(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word stops, word offsets by document) of concatenated texts; space: the bytes between words."""
    solid = ~space[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def one_spaced(data: np.ndarray, offsets: np.ndarray) -> Layout:
    """The words of the texts, one blank after each: equal word sequences are equal bytes."""
    starts, stops, word_offsets = word_edges(data, offsets)
    size = stops - starts
    end = np.cumsum(size + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 32, dtype=np.uint8)
    solid = np.ones(len(out), dtype=bool)
    solid[end - 1] = False
    out[solid] = data[~_SPACE[data]]
    return Layout(out, end - 1 - size, end - 1, word_offsets)


class Symbols:
    """What recompression has named: symbol k has the words start[k]..stop[k] - 1 and holds
    wherever the words of its *region* low[k]..high[k] - 1 do."""

    def __init__(self, name, start, stop, low, high):
        self.name, self.start, self.stop, self.low, self.high = name, start, stop, low, high


def recompress(letters: np.ndarray, offsets: np.ndarray, rounds: int = 3) -> Symbols:
    """All symbols of ``rounds`` of recompression over words; the words themselves come first.

    A round names maximal runs (letter, length), then the pairs "left letter, right
    letter" of a split of the alphabet by a bit of each name.  A name is a hash of the
    names it joins, so it is the same in every document of the corpus without a
    dictionary that each round would have to shuffle.  What a symbol depends on is
    followed exactly: a run on its neighbours, a lone letter on the neighbour that it
    could have joined, a pair on nothing else.  So equal passages have equal symbols
    wherever the region is inside of them.
    """
    n = len(letters)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    name, start, stop = letters, np.arange(n), np.arange(1, n + 1)
    low, high = start.copy(), stop.copy()
    told = [(name, start, stop, low, high)]
    # A neighbour beyond the text's edge is in no window.
    beyond = 1 << 40

    def before(k):
        back = np.maximum(k - 1, 0)
        return np.where((k > 0) & (doc[start[back]] == doc[start[k]]), low[back], low[k] - beyond)

    def after(k):
        on = np.minimum(k + 1, len(start) - 1)
        return np.where((on > k) & (doc[start[on]] == doc[start[k]]), high[on], high[k] + beyond)

    for r in range(rounds if n else 0):
        same = np.zeros(n if not r else len(name), dtype=bool)
        same[1:] = (name[1:] == name[:-1]) & (doc[start[1:]] == doc[start[:-1]])
        head = np.flatnonzero(~same)
        length = np.diff(np.append(head, len(name)))
        tail = head + length - 1
        run = length > 1
        low, high = before(head), after(tail)
        start, stop = start[head], stop[tail]
        name = np.where(run, mix(mix(name[head] + U(2 * r + 1)) ^ length.astype(U)), name[head])

        bit = (name * _ODD >> U(40 + r)) & U(1) == 1
        left = np.zeros(len(name), dtype=bool)
        left[:-1] = ~bit[:-1] & bit[1:] & (doc[start[1:]] == doc[start[:-1]])
        right = np.zeros(len(name), dtype=bool)
        right[1:] = left[:-1]
        one, two = np.flatnonzero(left), np.flatnonzero(right)
        lone = ~left & ~right
        wait, miss = np.flatnonzero(lone & ~bit), np.flatnonzero(lone & bit)
        new_low, new_high, new_stop, new_name = low.copy(), high.copy(), stop.copy(), name.copy()
        new_high[one], new_stop[one] = high[two], stop[two]
        new_high[wait], new_low[miss] = after(wait), before(miss)
        new_name[one] = mix(mix(name[one] + U(2 * r + 2)) * U(3) + name[two])
        fresh = (left | run)[~right]
        name, start, stop, low, high = (x[~right] for x in (new_name, start, new_stop, new_low, new_high))
        told.append(tuple(x[fresh] for x in (name, start, stop, low, high)))
    return Symbols(*(np.concatenate(x) for x in zip(*told, strict=True)))


class Words(Units):
    def __init__(self, width: int, rounds: int):
        self.width, self.rounds = width, rounds

    def layout(self, data, offsets):
        return one_spaced(data, offsets)

    def symbols(self, layout):
        return mix(PrefixHash(byte_symbols(layout.data)).slices(layout.starts, layout.stops) ^ (layout.stops - layout.starts).astype(U))

    def anchors(self, layout):
        """The widest symbol whose region is inside a window, the greatest name of these, is its anchor."""
        found = recompress(self.symbols(layout), layout.offsets, self.rounds)
        rank = np.minimum(found.stop - found.start, 63).astype(U) << U(26) | found.name >> U(38)
        chosen, first, last = widest(rank, found.low, found.high, layout.offsets, self.width)
        name = mix(found.name[chosen] ^ (found.stop - found.start)[chosen].astype(U))
        return name, found.start[chosen], first, last

    def resolve(self, key, layout, lead, m):
        """Equal names of whole windows around a shared symbol, then equal words."""
        row = np.repeat(np.arange(len(m)), m)
        begin = np.cumsum(m) - m
        first = layout.offsets[:-1][row] + np.arange(len(row)) - begin[row]
        a, b = layout.starts[first], layout.stops[first + self.width - 1]
        name = PrefixHash(byte_symbols(layout.data)).slices(a, b)
        order = np.lexsort((name, key[row]))
        x, y = order[:-1], order[1:]
        like = np.flatnonzero((key[row[x]] == key[row[y]]) & (name[x] == name[y]))
        x, y = x[like], y[like]
        size = (b - a)[x]
        same = size == (b - a)[y]
        same[same] = equal_bytes(layout.data, a[x[same]], a[y[same]], size[same])
        hit = np.zeros(len(row), dtype=bool)
        if same.all():
            hit[x] = hit[y] = True
            return hit
        # Two different windows share a name: those names are told by their bytes.
        odd = set(zip(key[row[x[~same]]].tolist(), name[x[~same]].tolist(), strict=True))
        seen: dict[tuple, int] = {}
        for at in range(len(row)):
            if (group := (int(key[row[at]]), int(name[at]))) in odd:
                whole = (*group, layout.data[a[at] : b[at]].tobytes())
                if whole in seen:
                    hit[[at, seen[whole]]] = True
                seen.setdefault(whole, at)
        good = same & np.array([(int(key[row[k]]), int(name[k])) not in odd for k in x])
        hit[x[good]] = hit[y[good]] = True
        return hit

    def finish(self, layout, covered):
        size = layout.stops - layout.starts + 1
        kept = layout.data[np.repeat(~covered, size)].tobytes()
        edges = _cumulated(np.where(covered, 0, size))[layout.offsets].tolist()
        # Without the last word's blank.
        shas = [hashlib.sha256(kept[a : max(b - 1, a)]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]
        return [np.diff(layout.offsets), np.diff(_cumulated(covered)[layout.offsets]), shas]


def _cumulated(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(x)]).astype(np.int64)


def substring_dedup(docs: DataFrame, window: int = 35, rounds: int = 3, hot: int = HOT) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts elsewhere.

    docs: doc_id, text and any other columns (ignored).  Words are the maximal
    runs of characters other than blanks and tab..carriage return; windows stay
    within a document.  Returns doc_id, n_words, n_removed, kept_sha256.

    Recompression names runs and pairs of words in rounds (``recompress``).  The
    widest symbol inside each window is its anchor, so equal windows share it; the
    symbols that occur more than once, counted over the corpus, are written, and the
    windows around shared symbols are verified byte by byte.  See ``repeats``.

    Null or blank text: no words, zero removed, the digest of the empty string.
    Null doc_id: kept as null.  Rows that repeat an id are documents of their
    own, so two equal rows of at least ``window`` words repeat each other.
    Empty table: no rows.
    """
    return Plan(Words(window, rounds), hot).apply(docs, "doc_id long, n_words long, n_removed long, kept_sha256 string")


# -- bytes -------------------------------------------------------------------
class Suffixes:
    """Suffixes of texts, compared by prefix hashes: a binary search finds the common extension."""

    def __init__(self, data: np.ndarray, salt: int = 0):
        self.data = data
        self.hash = PrefixHash(mix(byte_symbols(data) ^ U(salt)) if salt else byte_symbols(data))

    def common(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at a and b, up to room, by hashes."""
        low, high = np.zeros(len(a), dtype=np.int64), room.copy()
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high + 1) >> 1
            like = self.hash.slices(a, a + mid) == self.hash.slices(b, b + mid)
            low = np.where(open_ & like, mid, low)
            high = np.where(open_ & ~like, mid - 1, high)

    def less(self, a, b, end_a, end_b):
        """Whether suffix a sorts before b; ties are false."""
        room = np.minimum(end_a - a, end_b - b)
        c = self.common(a, b, room)
        inside = c < room
        out = end_a - a < end_b - b
        out[inside] = self.data[a[inside] + c[inside]] < self.data[b[inside] + c[inside]]
        return out

    def sorted(self, group, start, end, order) -> bool:
        """Whether the order is right on the bytes themselves: each suffix against the next."""
        x, y = order[:-1], order[1:]
        near = group[x] == group[y]
        x, y = x[near], y[near]
        room = np.minimum(end[x] - start[x], end[y] - start[y])
        c = self.common(start[x], start[y], room)
        whole = c == room
        if (whole & (end[x] - start[x] > end[y] - start[y])).any():
            return False
        at = np.flatnonzero(~whole)
        if (self.data[start[x[at]] + c[at]] >= self.data[start[y[at]] + c[at]]).any():
            return False
        return bool(equal_bytes(self.data, start[x], start[y], c).all())

    def sort(self, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Merge sort of suffixes inside each group of equal ``group`` (sorted): a permutation.

        All merges of a level run at once: an item's new place is its place in its own run
        plus its rank in the neighbouring run, found by binary search.
        """
        n = len(start)
        order = np.arange(n)
        if n < 2:
            return order
        edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.append(edge, n))
        base, total = np.repeat(edge, size), np.repeat(size, size)
        run = 1
        while run < size.max():
            live = np.flatnonzero(total > run)
            local = live - base[live]
            block = local // run
            left = block % 2 == 0
            other = base[live] + np.where(left, block + 1, block - 1) * run
            stop = np.minimum(other + run, base[live] + total[live])
            low, high = np.minimum(other, stop), stop.copy()
            floor = low.copy()
            me = order[live]
            while True:
                busy = np.flatnonzero(low < high)
                if not len(busy):
                    break
                mid = (low[busy] + high[busy]) >> 1
                you, mine = order[mid], me[busy]
                # Left items go before equal right ones.
                from_left = left[busy]
                x, y = np.where(from_left, you, mine), np.where(from_left, mine, you)
                before = self.less(start[x], start[y], end[x], end[y])
                up = np.where(from_left, before, ~before)
                low[busy] = np.where(up, mid + 1, low[busy])
                high[busy] = np.where(up, high[busy], mid)
            place = base[live] + (block // 2) * 2 * run + local % run + (low - floor)
            merged = order.copy()
            merged[place] = me
            order = merged
            run *= 2
        return order


def sorted_suffixes(data, group, start, end, attempts: int = 4):
    """``Suffixes.sort`` with the result checked on the bytes; a hash collision calls for other hashes."""
    for salt in range(attempts):
        suffixes = Suffixes(data, salt)
        order = suffixes.sort(group, start, end)
        if suffixes.sorted(group, start, end, order):
            return order
    raise RuntimeError(f"hashes collided in {attempts} families")


class Bytes(Units):
    def __init__(self, width: int, gram: int):
        if not 0 < gram < width:
            raise ValueError("a gram is shorter than a window")
        self.width, self.gram = width, gram

    def layout(self, data, offsets):
        at = np.arange(len(data))
        return Layout(data, at, at + 1, offsets)

    def symbols(self, layout):
        return byte_symbols(layout.data)

    def anchors(self, layout):
        grams = PrefixHash(self.symbols(layout)).windows(self.gram)
        anchor, first, last = elect(grams, layout.offsets, self.width, self.gram)
        return grams[anchor], anchor, first, last

    def resolve(self, key, layout, lead, m):
        """From the sorted suffixes at the anchors; one position further left the order follows
        from the byte in front (a stable sort), and two neighbours in it that agree on a whole
        window are a repeat."""
        data, width = layout.data, self.width
        at = layout.offsets[:-1] + lead
        group = _cumulated(key[1:] != key[:-1]) if len(key) else np.zeros(0, dtype=np.int64)
        order = sorted_suffixes(data, group, at, layout.offsets[1:])
        hit = np.zeros(int(m.sum()), dtype=bool)
        begin = np.cumsum(m) - m
        names = PrefixHash(byte_symbols(data)).windows(width)
        for back in range(int(lead.max(initial=-1)) + 1):
            if back:
                order = order[lead[order] >= back]
                front = data[at[order] - back].astype(np.int64)
                order = order[np.argsort(group[order] * 256 + front, kind="stable")]
            able = order[lead[order] - back < m[order]]
            if len(able) < 2:
                continue
            a, b = able[:-1], able[1:]
            x, y = at[a] - back, at[b] - back
            like = np.flatnonzero((group[a] == group[b]) & (names[x] == names[y]))
            like = like[equal_bytes(data, x[like], y[like], np.full(len(like), width))]
            for side in (a[like], b[like]):
                hit[begin[side] + lead[side] - back] = True
        return hit

    def finish(self, layout, covered):
        kept = layout.data[~covered].tobytes()
        edges = _cumulated(~covered)[layout.offsets].tolist()
        begins = covered.copy()
        begins[1:] &= ~covered[:-1]
        inner = layout.offsets[layout.offsets < len(covered)]
        begins[inner] = covered[inner]
        shas = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(edges, edges[1:], strict=False)]
        return [np.diff(layout.offsets), *(np.diff(_cumulated(x)[layout.offsets]) for x in (covered, begins)), shas]


def suffix_array_dedup(docs: DataFrame, length: int = 200, gram: int = 48, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts elsewhere.

    docs: doc_id, text and any other columns (ignored); texts count as UTF-8
    bytes and matches stay within a document.  Returns doc_id, n_bytes,
    n_removed, n_spans, kept_sha256.

    Sampled suffixes (one anchor for each window) are merge-sorted with comparisons by
    prefix hashes, logarithmic in their common extension (``Suffixes``); the finished
    order and every repeat are verified on the bytes.  See ``repeats``.

    Null or empty text: zero bytes, the digest of the empty string.  Null
    doc_id: kept as null.  Rows that repeat an id are documents of their own.
    Empty table: no rows.
    """
    return Plan(Bytes(length, gram), hot).apply(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
