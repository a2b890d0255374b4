"""Removal of repeated 100-byte strings through a sparse suffix array, sorted deep and shallow.

Suffixes are sampled by content: in every window of 100 bytes the least-hashed 32-byte string marks an anchor, so equal
windows hold the same anchors at the same places. Anchors meet by the hash of their 32 bytes; those of equal contexts (all
bytes of all windows around them) are settled by their first one. The suffixes at the rest are sorted: multikey quicksort
on 8-byte characters down to a shallow depth, blind tries for the groups that still share a long prefix. The same is done
for what stands before the anchors, backwards. Two windows with an anchor at offset o are equal if the two sorted orders
show common prefixes of 100 - o bytes after and o bytes before the anchor. Every window but the first of its class is
removed. For anchors with very many contexts the windows are told apart in strips instead: the 98 bytes that three windows
in a row share go by their hashes, the two bytes at either side as they are, so that a task need not hold all contexts.
Contexts count as equal by two independent hashes, of 64 and 17 bits, and strips by two of 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sluice.tables import keep, partitions, table

LENGTH = 100  # bytes of a string that counts
GRAM = 32  # bytes of an anchor
REACH = LENGTH - GRAM  # bytes before an anchor that its windows can hold
SHALLOW = 4  # 8-byte characters sorted before blind tries take over
MANY = 128  # contexts of one anchor string that are sorted as suffixes; beyond, strips
SIDE = 2  # bytes at either side of a strip
STRIP = LENGTH - SIDE  # bytes that SIDE + 1 windows in a row share
HELD = 20_000  # rows that are sorted at a time
CHUNK = 1 << 20  # bytes hashed at a time

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_NONE = np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = _BASES[which]
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down), np.random.default_rng(7 + which).integers(1, 1 << 63, 256).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _slide(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best over each run of `width` values, by doubling."""
    size = 1
    while 2 * size <= width:
        a, size = best(a[:-size], a[size:]), 2 * size
    return best(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


class Hashed:
    """Texts laid end to end, with the hash of any of their strings at hand; `which` of two independent ones."""

    def __init__(self, texts: list[bytes], which: int = 0):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.stops = np.cumsum([len(t) for t in texts])
        self.starts = self.stops - [len(t) for t in texts]
        n = len(self.data)
        room = max(2 * CHUNK, 1 << (n + 1).bit_length())
        up, self.down, of_byte = _powers(room, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(of_byte[self.data] * up[:n], out=self.sums[1:])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64))

    def grams(self) -> np.ndarray:
        return _mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: len(self.data) - GRAM + 1])

    def anchors(self) -> tuple[np.ndarray, ...]:
        """text index, place in the text, key and context hash of every anchor, and its reach before and after, last with
        17 bits of a second hash."""
        n = len(self.data)
        if n < LENGTH:
            return (_NONE,) * 5
        h = self.grams()
        whole = np.zeros(n - GRAM + 1, bool)
        window = np.zeros(n - LENGTH + 1, bool)
        for a, b in zip(self.starts.tolist(), self.stops.tolist(), strict=True):
            whole[a : max(a, b - GRAM + 1)] = True
            window[a : max(a, b - LENGTH + 1)] = True
        h[~whole] = np.uint64(2**64 - 1)
        least = _slide(h, REACH + 1, np.minimum)
        least[~window] = 0
        pad = np.zeros(REACH, np.uint64)
        most = _slide(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)
        at = np.flatnonzero((h == most) & whole)
        text = np.searchsorted(self.stops, at, "right")
        before = np.minimum(at - self.starts[text], REACH)
        after = np.minimum(self.stops[text] - at, LENGTH)
        context = self.hash(at - before, at + after) ^ _mixed((before * 256 + after).astype(np.uint64))
        again = Hashed([self.data.tobytes()], 1).hash(at - before, at + after) >> np.uint64(47)
        reach = (again.astype(np.int64) << 14) | (before << 7) | after  # 31 bits
        return text, at - self.starts[text], h[at].view(np.int64), context.view(np.int64), reach


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a document, as they overlap or touch, made one."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    reach = stop.copy()
    new = np.ones(len(doc), bool)
    for i in range(1, len(doc)):
        if doc[i] == doc[i - 1] and start[i] <= reach[i - 1]:
            new[i], reach[i] = False, max(reach[i], reach[i - 1])
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _chunks(docs: list, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or i == len(texts) - 1:
            yield np.array(docs[at : i + 1], np.int64), texts[at : i + 1]
            at, size = i + 1, 0


_ANCHOR = "kind int, key long, context long, doc long, place int, stop int"
_NAMES = ["kind", "key", "context", "doc", "place", "stop"]
FOUND, GONE, SORT, HOT = 0, 1, 2, 3  # an anchor (stop: its reach); an interval to remove; an anchor to sort; one of very many


def _reach(stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Before and after."""
    return stop >> 7 & 0x7F, stop & 0x7F


def _table(kind: int, key, context, doc, place, stop) -> pa.RecordBatch:
    n = len(doc)
    cols = [pa.array(np.full(n, kind, np.int32)), *(pa.array(np.asarray(x, np.int64)) for x in (key, context, doc)), *(pa.array(np.asarray(x).astype(np.int32)) for x in (place, stop))]
    return pa.RecordBatch.from_arrays(cols, _NAMES)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of whole texts. Of those with equal contexts in a batch only the first goes on; the others' windows go."""
    for b in batches:
        parts = []
        for doc, texts in _chunks(b.column("doc").to_pylist(), [t.encode() for t in b.column("text").to_pylist()]):
            text, place, key, context, reach = Hashed(texts).anchors()
            parts.append((key, context, reach, doc[text], place))
        if not parts:
            continue
        key, context, reach, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, doc, reach, context, key))
        once = np.ones(len(key), bool)  # a row that is given twice has its anchors once
        once[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (place[order][1:] != place[order][:-1])
        key, context, reach, doc, place = (x[order[once]] for x in (key, context, reach, doc, place))
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (context[1:] != context[:-1]) | (reach[1:] != reach[:-1])
        yield _table(FOUND, key[first], context[first], doc[first], place[first], reach[first])
        rest = ~first
        before, after = _reach(reach)
        gone = _merged(doc[rest], (place - before)[rest], (place - np.maximum(0, LENGTH - after) + LENGTH)[rest])
        yield _table(GONE, gone[0], np.zeros(len(gone[0])), *gone)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors in (key, context, stop, doc, place) order. Of equal contexts all but the first go; an anchor string with one
    context only is done; the first anchors of the others go on, up to MANY as SORT, else all as HOT."""
    now, last, held, hot = None, None, [], False
    for b in batches:
        kind, key, context, doc, place, stop = (b.column(c).to_numpy(zero_copy_only=False) for c in _NAMES)
        if (kind == GONE).any():
            g = kind == GONE
            yield _table(GONE, key[g], context[g], doc[g], place[g], stop[g])
            key, context, doc, place, stop = (x[~g] for x in (key, context, doc, place, stop))
        if not len(key):
            continue
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (context[1:] == context[:-1]) & (stop[1:] == stop[:-1])
        again = same.copy()  # but for an anchor that is given twice
        again[1:] &= (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
        if last is not None and (key[0], context[0], stop[0]) == last[:3]:
            same[0], again[0] = True, (doc[0], place[0]) != last[3:]
        last = (key[-1], context[-1], stop[-1], doc[-1], place[-1])
        if again.any():
            before, after = _reach(stop[again])
            yield _table(GONE, key[again], context[again], doc[again], place[again] - before, place[again] - np.maximum(0, LENGTH - after) + LENGTH)
        key, doc, place = (x[~same] for x in (key, doc, place))
        if not len(key):
            continue
        alone = np.ones(len(key), bool)  # whole groups of one within the batch need no look
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[:-1] != key[1:]
        alone[[0, -1]] = False
        out: dict[int, list] = {SORT: [], HOT: []}

        def close(out=out) -> None:
            if not hot and len(held) > 1:
                out[SORT].extend(held)
            held.clear()

        for row in zip(key[~alone].tolist(), doc[~alone].tolist(), place[~alone].tolist(), strict=True):
            if row[0] != now:
                close()
                now, hot = row[0], False
            if hot:
                out[HOT].append(row)
                continue
            held.append(row)
            if len(held) > MANY:
                hot = True
                out[HOT].extend(held)
                held.clear()
        for what, rows in out.items():
            if rows:
                k, d, p = zip(*rows, strict=True)
                yield _table(what, k, np.zeros(len(k)), d, p, np.zeros(len(k)))
    if not hot and len(held) > 1:
        k, d, p = zip(*held, strict=True)
        yield _table(SORT, k, np.zeros(len(k)), d, p, np.zeros(len(k)))


_SPOTS = "kind int, key long, twin long, rest long, doc long, place int, before binary, after binary"
_SPOT_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())


def _spot_rows(kind: int, n: int, **cols) -> pa.RecordBatch:
    """SORT: an anchor and what stands before (backwards) and after it. HOT: a strip's hashes, place and sides (rest). GONE:
    an interval, its end in rest."""
    names = [c.split()[0] for c in _SPOTS.split(", ")]
    cols["kind"] = np.full(n, kind, np.int32)
    blank = {"twin": np.zeros(n, np.int64), "rest": np.zeros(n, np.int64), "before": [None] * n, "after": [None] * n}
    return pa.RecordBatch.from_arrays([pa.array(cols.get(c, blank.get(c)), k) for c, k in zip(names, _SPOT_KINDS, strict=True)], names)


def _strips(texts: list[bytes], hot: list[list[int]]) -> tuple[np.ndarray, ...]:
    """text index, place, two hashes and sides of the strips around these anchors. A window goes with the anchor that is its
    least-hashed string, the first of equal ones, and with the strip that is by a multiple of SIDE + 1 before that: both are
    told from its own bytes, so equal windows go with equal strips. Windows whose least-hashed string is another kind of
    anchor are settled by that one."""
    laid = Hashed(texts)
    n = len(laid.data)
    h = laid.grams()
    least = _slide(h, REACH + 1, np.minimum)
    anchor = np.repeat(np.arange(len(texts)), [len(x) for x in hot])
    at = laid.starts[anchor] + np.array([p for x in hot for p in x], np.int64)
    texts_of, places = [], []
    for i in range(0, len(at), HELD):
        t, p = anchor[i : i + HELD], at[i : i + HELD]
        start = p[:, None] - np.arange(REACH + 1)
        own = (start >= laid.starts[t][:, None]) & (start + LENGTH <= laid.stops[t][:, None])
        own &= least[np.clip(start, 0, n - LENGTH)] == h[p][:, None]
        same = (h[np.maximum(start, 0)] == h[p][:, None]) & (start >= laid.starts[t][:, None])
        own[:, 1:] &= ~np.logical_or.accumulate(same[:, 1:], axis=1)
        which, step = np.nonzero(np.logical_or.reduceat(own, np.arange(0, REACH + 1, SIDE + 1), axis=1))
        texts_of.append(t[which])
        places.append(p[which] - (SIDE + 1) * step - laid.starts[t[which]])
    text, place = np.concatenate(texts_of), np.concatenate(places)
    size = laid.stops - laid.starts
    start = laid.starts[text] + place
    stop = start + STRIP
    key = laid.hash(start, stop).view(np.int64)
    twin = Hashed([laid.data.tobytes()], 1).hash(start, stop).view(np.int64)
    before, after = np.minimum(place, SIDE), np.minimum(size[text] - place - STRIP, SIDE)
    rest = before | after << 2
    for i in range(SIDE):
        rest |= np.where(i < before, laid.data[np.maximum(start - 1 - i, 0)], 0).astype(np.int64) << 8 * (1 + i)
        rest |= np.where(i < after, laid.data[np.minimum(stop + i, len(laid.data) - 1)], 0).astype(np.int64) << 8 * (1 + SIDE + i)
    return text, place, key, twin, rest


def _again(key: np.ndarray, twin: np.ndarray, rest: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each strip's windows, by bytes before it: which are there, and which have an equal one that starts earlier."""
    there, again = np.zeros((len(key), SIDE + 1), bool), np.zeros((len(key), SIDE + 1), bool)
    for o in range(SIDE + 1):
        rows = np.flatnonzero(((rest & 3) >= o) & ((rest >> 2 & 3) >= SIDE - o))
        there[rows, o] = True
        side = (rest[rows] >> 8 & (1 << 8 * o) - 1) | (rest[rows] >> 8 * (1 + SIDE) & (1 << 8 * (SIDE - o)) - 1) << 8 * SIDE
        rows = rows[(by := np.lexsort((place[rows], doc[rows], side, twin[rows], key[rows])))]
        side = side[by]
        new = np.ones(len(rows), bool)
        new[1:] = (key[rows[1:]] != key[rows[:-1]]) | (twin[rows[1:]] != twin[rows[:-1]]) | (side[1:] != side[:-1])
        first = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        again[rows, o] = (doc[rows] != doc[first]) | (place[rows] != place[first])
    return there, again


def _found_again(again: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, o = np.nonzero(again)
    return _merged(doc[row], place[row] - o, place[row] - o + LENGTH)


def _fold(cols: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of key, twin, rest, doc and place the rows with a window that none of them has earlier, and the others' intervals."""
    there, again = _again(*cols)
    stay = (there & ~again).any(axis=1)
    return tuple(x[stay] for x in cols), _found_again(again & ~stay[:, None], *cols[3:])


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What stands around each anchor to sort; for anchors of very many contexts instead the strips around them, of which
    those that others in the batch make needless are left out and their windows go."""

    def sort(rows: list[tuple]) -> pa.RecordBatch:
        key, doc, place, before, after = zip(*rows, strict=True)
        return _spot_rows(SORT, len(rows), key=key, doc=doc, place=place, before=before, after=after)

    def hot(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        (key, twin, rest, doc, place), gone = _fold(tuple(np.concatenate(x) for x in zip(*parts, strict=True)))
        yield _spot_rows(HOT, len(key), key=key, twin=twin, rest=rest, doc=doc, place=place)
        yield _spot_rows(GONE, len(gone[0]), key=gone[0], rest=gone[2], doc=gone[0], place=gone[1])

    for b in batches:
        rows: list[tuple] = []
        docs, texts, places, size, parts = [], [], [], 0, []
        for i, (doc, text, wants) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc", "text", "wants")), strict=True)):
            t = text.encode()
            rows += [(w["key"], doc, p := w["place"], t[max(0, p - REACH) : p][::-1], t[p + GRAM : p + LENGTH]) for w in wants if w["kind"] == SORT]
            if len(rows) > HELD:
                yield sort(rows)
                rows = []
            if many := [w["place"] for w in wants if w["kind"] == HOT]:
                docs.append(doc)
                texts.append(t)
                places.append(many)
                size += len(t)
            if texts and (size > CHUNK or i == b.num_rows - 1):
                text_of, place, key, twin, rest = _strips(texts, places)
                parts.append((key, twin, rest, np.array(docs, np.int64)[text_of], place))
                docs, texts, places, size = [], [], [], 0
                if sum(len(x[0]) for x in parts) > 10 * HELD:
                    yield from hot(parts)
                    parts = []
        if rows:
            yield sort(rows)
        if parts:
            yield from hot(parts)


def blind_trie(strings: list[bytes], depth: int) -> list[int]:
    """The order of strings that agree in their first `depth` bytes. Inner nodes hold only the place where their strings
    part; a string goes down by its bytes there, is compared with the leaf it meets, and branches where they differ."""
    root: list | int = 0
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while not isinstance(node, int):
            at = node[0]
            child = node[1].get(s[at] if at < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other, low = strings[node], depth
        high = min(len(s), len(other))
        if s[low:high] == other[low:high]:
            low = high
        while low < high and s[low] == other[low]:
            low += 1
        mine = s[low] if low < len(s) else -1
        parent, edge, node = None, None, root
        while not isinstance(node, int) and node[0] < low:
            parent, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        if not isinstance(node, int) and node[0] == low:
            twin = node[1].get(mine)
            node[1][mine] = i if twin is None else _same(twin, i)
            continue
        theirs = other[low] if low < len(other) else -1
        fork = [low, {theirs: node, mine: i}] if theirs != mine else _same(node, i)
        if parent is None:
            root = fork
        else:
            parent[1][edge] = fork
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            todo += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def _same(node, i: int) -> list:
    """Equal strings hang from a node past their end, under marks of their own below any byte."""
    if not isinstance(node, int) and node[0] == 1 << 30:
        node[1][-1 - len(node[1])] = i
        return node
    return [1 << 30, {-1: node, -2: i}]


def deep_shallow(group: np.ndarray, strings: list[bytes], depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorts strings within their groups; the strings of a group agree in `depth` bytes. Returns the order, and each
    place's common prefix with the place before it (-1 where a group begins)."""
    n = len(strings)
    flat = np.frombuffer(b"".join(s.ljust(width + 8, b"\0") for s in strings), np.uint8).reshape(n, width + 8)
    size = np.array([len(s) for s in strings])
    order, segment = np.argsort(group, kind="stable"), None
    segment = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    for k in range(SHALLOW):  # each pass parts the segments by their next character; single ones stay as they are
        at = depth + 8 * k
        if at >= width:
            break
        live = np.flatnonzero(np.isin(segment, np.flatnonzero(np.bincount(segment) > 1)))
        word = np.ascontiguousarray(flat[order[live], at : at + 8]).view(">u8").ravel()
        moved = np.lexsort((word, segment[live]))
        order[live] = order[live][moved]
        word, part = word[moved], segment[live]
        step = np.zeros(n, np.int64)
        step[live[1:]] = (part[1:] == part[:-1]) & (word[1:] != word[:-1])
        segment = segment + np.cumsum(step)
        segment = np.cumsum(np.concatenate([[0], segment[1:] != segment[:-1]]))
    bounds = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1], [True]]))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            rows = order[a:b].tolist()
            order[a:b] = [rows[i] for i in blind_trie([strings[r] for r in rows], min(depth + 8 * SHALLOW, width, int(size[rows].min())))]
    common = np.full(n, -1)
    for at in range(1, n, 8192):
        a, b = order[at - 1 : min(n, at + 8192) - 1], order[at : at + 8192]
        differ = flat[a, :width] != flat[b, :width]
        lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[at : at + len(b)] = np.where(group[a] == group[b], np.minimum(lcp, np.minimum(size[a], size[b])), -1)
    return order, common


def _classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeated(key: np.ndarray, doc: np.ndarray, place: np.ndarray, before: list[bytes], after: list[bytes]) -> tuple[np.ndarray, ...]:
    """Intervals of the windows around these anchors that have an equal window starting earlier among them."""
    rank = np.lexsort((key, place, doc))
    once = np.ones(len(rank), bool)
    once[1:] = (key[rank][1:] != key[rank][:-1]) | (place[rank][1:] != place[rank][:-1]) | (doc[rank][1:] != doc[rank][:-1])
    rank = rank[once]
    key, doc, place = key[rank], doc[rank], place[rank]
    before, after = [before[i] for i in rank], [after[i] for i in rank]
    right = deep_shallow(key, after, 0, REACH)
    left = deep_shallow(key, before, 0, REACH)
    n_before, n_after = np.array([len(x) for x in before]), np.array([len(x) for x in after])
    gone = np.zeros((len(key), REACH + 3), bool)
    for o in range(REACH + 1):
        rows = np.flatnonzero((n_before >= o) & (n_after >= REACH - o))
        code = _classes(*right, REACH - o)[rows] * (len(key) + 1) + _classes(*left, o)[rows]
        by = np.argsort(code, kind="stable")
        again = np.zeros(len(rows), bool)
        again[by[1:]] = code[by[1:]] == code[by[:-1]]
        gone[rows[again], o + 1] = True
    edge = np.diff(gone.astype(np.int8), axis=1)
    r, low = np.nonzero(edge == 1)  # offsets low .. high - 1
    _, high = np.nonzero(edge == -1)
    return doc[r], place[r] - (high - 1), place[r] - low + LENGTH


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of the windows that start earlier, too, from spots in (kind, key, doc, place) order."""

    def gone(doc, start, stop) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32))], ["doc", "start", "stop"])

    def arrays(rows: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
        t = pa.Table.from_batches(rows)
        return [t.column(c).to_numpy() for c in names]

    def anchors(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        return gone(*repeated(*arrays(rows, "key", "doc", "place"), t.column("before").to_pylist(), t.column("after").to_pylist()))

    def strips(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = arrays(rows, "key", "twin", "rest", "doc", "place")
        return gone(*_found_again(_again(*cols)[1], *cols[3:]))

    held: dict[int, list[pa.RecordBatch]] = {SORT: [], HOT: []}
    solve = {SORT: anchors, HOT: strips}
    for b in batches:
        bounds = np.searchsorted(b.column("kind").to_numpy(), [GONE, SORT, HOT, HOT + 1]).tolist()
        for kind, at, end in zip((GONE, SORT, HOT), bounds[:-1], bounds[1:], strict=True):
            if at == end:
                continue
            rows = b.slice(at, end - at)
            if kind == GONE:
                yield gone(*arrays([rows], "doc", "place", "rest"))
                continue
            key = rows.column("key").to_numpy()  # groups are held together: of SORT they have MANY rows at most
            cut, now = int(np.searchsorted(key, key[-1], "left")), held[kind]
            if sum(x.num_rows for x in now) + cut > HELD and (cut or now[-1].column("key")[-1].as_py() != key[0]):
                yield solve[kind]([*now, rows.slice(0, cut)] if cut else now)
                now[:], rows = [], rows.slice(cut)
            now.append(rows)
            if kind == HOT and sum(x.num_rows for x in now) > 2 * HELD:  # one string's: what it leaves is some 200,000 rows at most
                names = ["key", "twin", "rest", "doc", "place"]
                cols, again = _fold(tuple(arrays(now, *names)))
                yield gone(*again)
                now[:] = [_spot_rows(HOT, len(cols[0]), **dict(zip(names, cols, strict=True)))]
    for kind, rows in held.items():
        if rows:
            yield solve[kind](rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            t, rest, at, spans = text.encode(), hashlib.sha256(), 0, []
            for g in sorted((g["start"], g["stop"]) for g in gone or []):
                if spans and g[0] <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(g[1], spans[-1][1]))
                else:
                    spans.append(g)
            for a, z in spans:
                rest.update(t[at:a])
                at = z
            rest.update(t[at:])
            rows.append((len(t), sum(z - a for a, z in spans), len(spans), rest.hexdigest(), [{"start": a, "stop": z} for a, z in spans]))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        arrays = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, stop>>.

    Every byte of a 100-byte string that also starts earlier (smaller id, or earlier in the same text) is removed, judged
    on the input. A null text is empty. Null ids come first; rows that share an id but not the text count as documents of
    their own, in the order of their hashes; rows repeated whole are one document and get one result each. An empty table
    gives an empty table. A task needs some 60 bytes of memory for each byte of the longest text."""
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    clash = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b"))
    if clash.where("a <> b or doc_id is null").isEmpty():
        rows = rows.withColumn("doc", F.col("doc_id"))
    else:  # ids of our own, in the same order
        names = rows.select("doc_id", F.xxhash64("text").alias("h")).distinct().orderBy("doc_id", "h")
        names = keep(names.withColumn("doc", F.monotonically_increasing_id()), "ids")
        same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h"))
        rows = rows.join(names.withColumnRenamed("doc_id", "i"), same).select("doc_id", "text", "doc")
    found = rows.where(F.octet_length("text") >= LENGTH).select("doc", "text").mapInArrow(_find, _ANCHOR)
    found = found.repartition(n, "key").sortWithinPartitions("key", "context", "stop", "doc", "place")
    settled = keep(found.mapInArrow(_settle, _ANCHOR), "settled", free=True)

    wants = settled.where(F.col("kind").isin(SORT, HOT)).groupBy("doc").agg(F.collect_list(F.struct("kind", "key", "place")).alias("wants"))
    spots = rows.select("doc", "text").join(wants, "doc").select("doc", "text", "wants").mapInArrow(_spots, _SPOTS)
    spots = spots.repartition(n, "key").sortWithinPartitions("kind", "key", "doc", "place")
    ordered = keep(spots.mapInArrow(_sorted, "doc long, start int, stop int"), "ordered", free=True)
    gone = settled.where(F.col("kind") == GONE).select("doc", F.col("place").alias("start"), "stop").unionByName(ordered)
    gone = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "stop")).alias("gone"))
    return rows.join(gone, "doc", "left").select("doc_id", "text", "gone").mapInArrow(
        _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: int, stop: int>>"
    )


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
