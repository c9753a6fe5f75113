"""Suffix sorting by induction in files: queues of suffix tuples on disk, common prefixes carried along, recursion.

Suffixes are of type L (greater than the next one) or S (smaller); an S suffix behind an L one is a star. Stars are
sorted first, by the same routine on their substrings and then by recursion on their names (which ends in memory). From them all L suffixes
are induced in ascending order and from these all S suffixes in descending order: whenever the queue gives out a suffix,
the one before it in the text enters behind all that have entered with its symbol. The tuples are
(key, position, common prefix with the one before it in its bucket); the common prefix of two induced suffixes is one
more than the least common prefix of what was given out between those that induced them.

All of it runs in batches: as many suffixes are taken at once as induce nothing that belongs between them. Texts, stars,
queues and results are files as soon as they exceed buffers of a stated size; beside these, memory holds a batch and one
bucket of several symbols.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

BUCKET_ROWS = 1 << 12  # rows for which a bucket of several symbols is planned
QUEUE_ROWS = 1 << 21  # rows of a queue in memory (24 bytes each) before its buckets go to files
BLOCK = 1 << 18  # rows read or written at a time
BASE_ROWS = 1 << 21  # star names that are sorted in memory; more are a text of their own, induced like the first
HELD_BYTES = 128 << 20  # a table up to this size stays in memory; a larger one is a mapped file
_CELLS = 1 << 20  # cells of the histogram that plans the buckets
_NONE = np.zeros((0, 3), np.int64)


class BucketQueue:
    """A priority queue of rows (key, position, common prefix): least key first, then first in, first out.

    Keys never fall below the one given out last. A bucket is a range of keys; rows wait in memory lists and, beyond
    ``memory`` rows, in one file per bucket. A bucket of one key is read in blocks, others are sorted when their turn comes.
    """

    def __init__(self, folder: str, edges: np.ndarray, memory: int = QUEUE_ROWS):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.edges, self.memory = folder, edges, memory
        self.held: dict[int, list[np.ndarray]] = {}
        self.held_rows = 0
        self.filed: set[int] = set()
        self.pending: list[np.ndarray] = []
        self.pending_rows = 0
        self.bucket, self.single, self.until = -1, False, -1
        self.front, self.at = _NONE, 0
        self.blocks: Iterator[np.ndarray] = iter(())
        self.tail: list[np.ndarray] = []

    def push(self, rows: np.ndarray) -> None:
        """Add rows in the order in which those of equal key are to come out."""
        now = rows[:, 0] < self.until
        if now.any():
            own, rows = rows[now], rows[~now]
            if self.single:
                self.tail.append(own)
            else:
                own = own[np.argsort(own[:, 0], kind="stable")]
                rest = self.front[self.at:]
                places = np.searchsorted(rest[:, 0], own[:, 0], "right") + np.arange(len(own))
                front, old = np.empty((len(rest) + len(own), 3), np.int64), np.ones(len(rest) + len(own), bool)
                old[places] = False
                front[places], front[old] = own, rest
                self.front, self.at = front, 0
        if len(rows):
            self.pending.append(rows)
            self.pending_rows += len(rows)
            if self.pending_rows > self.memory // 4:
                self._deal()

    def peek(self, rows: int) -> np.ndarray:
        """The first rows; fewer only where the current bucket ends."""
        while len(self.front) - self.at < rows and (self.single or self.at == len(self.front)):
            more = self._more()
            if more is None:
                break
            self.front, self.at = (np.concatenate([self.front[self.at:], more]) if self.at < len(self.front) else more), 0
        return self.front[self.at:self.at + rows]

    def drop(self, rows: int) -> None:
        self.at += rows

    def _more(self) -> np.ndarray | None:
        if self.single:
            block = next(self.blocks, None)
            if block is None and self.tail:
                block, self.tail = np.concatenate(self.tail), []
            if block is not None or self.at < len(self.front):
                return block
        self._deal()
        waiting = self.filed | self.held.keys()
        if not waiting:
            self.single, self.until = False, -1
            return None
        self.bucket = b = min(waiting)
        self.until = int(self.edges[b + 1])
        self.single = self.until - int(self.edges[b]) == 1
        lists = self.held.pop(b, [])
        self.held_rows -= sum(map(len, lists))
        if self.single:
            self.blocks = self._read(b, lists)
            return next(self.blocks)
        rows = np.concatenate([*self._read(b, lists)])
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def _read(self, b: int, lists: list[np.ndarray]) -> Iterator[np.ndarray]:
        if b in self.filed:
            self.filed.discard(b)
            path = f"{self.folder}/{b}"
            with open(path, "rb") as source:
                while data := source.read(BLOCK * 24):
                    yield np.frombuffer(data, np.int64).reshape(-1, 3)
            os.remove(path)
        yield from lists

    def _deal(self) -> None:
        if self.pending:
            rows, self.pending, self.pending_rows = np.concatenate(self.pending), [], 0
            bucket = np.searchsorted(self.edges, rows[:, 0], "right") - 1
            order = _grouped(bucket, len(self.edges))
            rows, bucket = rows[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, part in zip(bucket[np.r_[0, cuts]].tolist(), np.split(rows, cuts), strict=True):
                self.held.setdefault(b, []).append(part.copy())
            self.held_rows += len(rows)
        if self.held_rows > self.memory:
            for b, lists in self.held.items():
                with open(f"{self.folder}/{b}", "ab") as out:
                    for part in lists:
                        out.write(np.ascontiguousarray(part).data)
                self.filed.add(b)
            self.held, self.held_rows = {}, 0


def room(path: str, dtype, rows: int) -> np.ndarray:
    """Space for an array, zeros at first."""
    if rows * np.dtype(dtype).itemsize <= HELD_BYTES:
        return np.zeros(rows, dtype)
    return np.memmap(path, dtype, "w+", shape=(rows,))


def _store(path: str, blocks: Iterator[np.ndarray], dtype, width: int = 0) -> np.ndarray:
    held, size, filed = [], 0, False
    for block in blocks:
        held.append(np.ascontiguousarray(block, dtype))
        size += held[-1].nbytes
        if size > HELD_BYTES:
            with open(path, "ab" if filed else "wb") as out:
                for part in held:
                    out.write(part.data)
            held, size, filed = [], 0, True
    if filed:
        with open(path, "ab") as out:
            for part in held:
                out.write(part.data)
        rows = np.memmap(path, dtype, "r")
        return rows.reshape(-1, width) if width else rows
    return np.concatenate([np.zeros((0, width) if width else 0, dtype), *held])


def _edges(text: np.ndarray, symbols: int, flipped: bool) -> np.ndarray:
    """Borders of the buckets, from a histogram of the symbols; a frequent symbol has buckets of its own."""
    shift = max(0, (symbols - 1).bit_length() - (_CELLS - 1).bit_length())
    counts = np.zeros(((symbols - 1) >> shift) + 1, np.int64)
    for i in range(0, len(text), BLOCK):
        counts += np.bincount(_symbols(text[i:i + BLOCK], symbols, flipped) >> shift, minlength=len(counts))
    first = np.flatnonzero(np.diff(np.r_[-1, np.cumsum(counts) // BUCKET_ROWS])) << (shift + 1)
    hot = np.flatnonzero(counts > BUCKET_ROWS) << 1 if shift == 0 else np.zeros(0, np.int64)
    return np.unique(np.r_[0, first, hot, hot + 1, hot + 2, 2 * (len(counts) << shift) + 2])


def _symbols(values: np.ndarray, symbols: int, flipped: bool) -> np.ndarray:
    values = values.astype(np.int64)
    return symbols - 1 - values if flipped else values


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of the suffixes at a[i] and b[i], up to limit[i]."""
    most = len(text) - np.maximum(a, b)
    if limit is not None:
        most = np.minimum(most, limit)
    out, live, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live) > 16:
        on = most[live] > done
        live = live[on]
        live = live[text[a[live] + done] == text[b[live] + done]]
        done += 1
        out[live] = done
    for i in live.tolist():  # few are left: in growing slices
        at, step = done, 64
        while at < most[i]:
            size = min(step, int(most[i]) - at)
            unlike = np.flatnonzero(text[a[i] + at:a[i] + at + size] != text[b[i] + at:b[i] + at + size])
            at += int(unlike[0]) if len(unlike) else size
            if len(unlike):
                break
            step *= 2
        out[i] = at
    return out


def _equal_before(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many symbols directly before at[i] equal the one at at[i]."""
    out, live, done = np.zeros(len(at), np.int64), np.arange(len(at)), 0
    while len(live) > 16:
        live = live[at[live] > done]
        live = live[text[at[live] - done - 1] == text[at[live]]]
        done += 1
        out[live] = done
    for i in live.tolist():
        end, step = int(at[i]) - done, 64
        while end > 0:
            start = max(0, end - step)
            unlike = np.flatnonzero(text[start:end] != text[at[i]])
            if len(unlike):
                end = start + int(unlike[-1]) + 1
                break
            end, step = start, 2 * step
        out[i] = at[i] - end
    return out


def _forward(text: np.ndarray, at: int) -> int:
    """How many symbols from ``at`` on are equal."""
    end, step = at + 1, 8
    while end < len(text):
        unlike = np.flatnonzero(text[end:end + step] != text[at])
        if len(unlike):
            return end + int(unlike[0]) - at
        end, step = end + step, 2 * step
    return len(text) - at


def _whole_run(text: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The rows of one key, equal in the length of their runs, followed by all that they induce under the same symbol."""
    at, shared = rows[:, 1], rows[:, 2]
    run = _forward(text, int(at[0]))
    longer = _equal_before(text, at)
    total = int(longer.sum())
    item = np.repeat(np.arange(len(at)), longer)
    step = np.arange(1, total + 1) - np.repeat(np.cumsum(longer) - longer, longer)
    order = np.argsort(step, kind="stable")
    item, step = item[order], step[order]
    out = np.empty((total, 3), np.int64)
    out[:, 0], out[:, 1] = rows[0, 0], at[item] - step
    if total:
        head = np.concatenate([[True], step[1:] != step[:-1]])
        out[head, 2] = run + step[head] - 1
        inner = np.flatnonzero(~head)
        out[inner, 2] = step[inner] + _Minima(shared).least(item[inner - 1] + 1, item[inner] + 1)
    return np.concatenate([rows, out])


def _grouped(values: np.ndarray, most: int) -> np.ndarray:
    """A stable order of values from 0 to ``most``; small ones are sorted by their digits."""
    return np.argsort(values.astype(np.uint16) if most < 1 << 16 else values, kind="stable")


class _Minima:
    """Least value of any range of an array."""

    def __init__(self, values: np.ndarray):
        self.levels = np.empty((len(values).bit_length(), len(values)), np.int64)
        self.levels[0] = values
        for k in range(1, len(self.levels)):
            span, until = 1 << (k - 1), len(values) - (1 << k) + 1
            np.minimum(self.levels[k - 1, :until], self.levels[k - 1, span:span + until], out=self.levels[k, :until])

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first:last], all ranges nonempty."""
        level = np.frexp((last - first).astype(np.float64))[1] - 1
        return np.minimum(self.levels[level, first], self.levels[level, last - (1 << level)])


def _induce(text: np.ndarray, seeds: Iterator[np.ndarray], symbols: int, flipped: bool, folder: str,
            prefixes: bool) -> Iterator[np.ndarray]:
    """Give all induced suffixes in order, as rows (symbol, position, common prefix with the one before, 0 after another symbol).

    ``seeds`` are rows like these in the order of the scan; ``flipped`` scans downwards. Without ``prefixes`` (when star
    substrings are sorted) the common prefixes are not kept and mean nothing.
    """
    queue = BucketQueue(folder, _edges(text, symbols, flipped))
    for rows in seeds:
        rows = rows.copy()
        rows[:, 0] = 2 * (symbols - 1 - rows[:, 0] if flipped else rows[:, 0]) + 1
        queue.push(rows)
    size, last_key, last_at = 1 << 10, -1, 0
    known, floor = _NONE[:, 0], _NONE[:, 0]  # targets under the current symbol, least prefix since they were induced
    while len(rows := queue.peek(size)):
        same = int(np.searchsorted(rows[:, 0], last_key, "right")) if rows[0, 0] == last_key and last_key % 2 == 0 else size
        run = same < size and _forward(text, last_at) + 1 == _forward(text, int(rows[0, 1])) == _forward(text, int(rows[same - 1, 1]))
        if run:  # the symbol induces itself: its remaining rounds at once
            queue.drop(same)
            rows = _whole_run(text, rows[:same])
        key, at = rows[:, 0], rows[:, 1]
        symbol = key >> 1
        target = _symbols(text[np.maximum(at - 1, 0)], symbols, flipped)
        goes = (at > 0) & ((target > symbol) if run else (target + (1 - (key & 1)) > symbol))
        took = len(rows)
        if not run:
            bar = np.minimum.accumulate(np.where(goes, target, symbols))
            late = np.flatnonzero(key[1:] > 2 * bar[:-1])
            took = int(late[0]) + 1 if len(late) else took
            queue.drop(took)
        follows = took == len(rows) or symbol[took] == symbol[took - 1]
        key, at, symbol, goes, target = key[:took], at[:took], symbol[:took], goes[:took], target[:took]
        prefix = rows[:took, 2].copy()

        # Where a key ends: another symbol shares nothing, seeds behind induced ones of their symbol share a run.
        new = np.flatnonzero(key[1:] != key[:-1]) + 1
        if key[0] != last_key:
            new = np.concatenate([[0], new])
        if len(new):
            prefix[new] = 0
            before = np.where(new > 0, key[new - 1], last_key)
            seam = (key[new] & 1 == 1) & (before == key[new] - 1)
            if prefixes and seam.any():
                there = new[seam]
                prefix[there] = common(text, np.where(there > 0, at[there - 1], last_at), at[there])
        induced = (key & 1) == 0
        if induced.any():
            out = np.stack([_symbols(symbol, symbols, flipped), at, prefix], 1)
            yield out if induced.all() else out[induced]

        if symbol[0] != last_key >> 1:
            known = floor = _NONE[:, 0]
        where = np.flatnonzero(goes)
        if not prefixes:
            if len(where):
                queue.push(np.stack([2 * target[where], at[where] - 1, prefix[where]], 1))
            follows = False
        elif len(where):
            minima = _Minima(prefix)
            order = _grouped(target[where], symbols)
            by, to = where[order], target[where][order]
            fresh = np.ones(len(to), bool)
            np.not_equal(to[1:], to[:-1], out=fresh[1:])
            share = np.zeros(len(by), np.int64)
            again = np.flatnonzero(~fresh)
            if len(again):
                share[again] = minima.least(by[again - 1] + 1, by[again] + 1)
            if len(known):
                heads = np.flatnonzero(fresh)
                place = np.minimum(np.searchsorted(known, to[heads]), len(known) - 1)
                met = known[place] == to[heads]
                heads, place = heads[met], place[met]
                share[heads] = np.minimum(floor[place], minima.least(np.zeros(len(heads), np.int64), by[heads] + 1))
            pushed = np.empty((len(by), 3), np.int64)
            pushed[:, 0], pushed[:, 1] = 2 * target[where], at[where] - 1
            pushed[order, 2] = share + 1
            queue.push(pushed)
            follows = follows or bool((to == symbol[-1]).any())
        if follows:
            begin = int(np.searchsorted(symbol, symbol[-1]))  # from here on all are of the symbol that may go on
            known, floor = (known, np.minimum(floor, prefix.min())) if not begin else (_NONE[:, 0], _NONE[:, 0])
            if len(mine := where[where >= begin]):
                to, place = np.unique(target[mine][::-1], return_index=True)
                by = mine[::-1][place]
                since = np.full(len(to), np.iinfo(np.int64).max)
                inner = by + 1 < took
                since[inner] = minima.least(by[inner] + 1, np.full(int(inner.sum()), took))
                old = ~np.isin(known, to) if len(known) else slice(0)
                known, floor = np.concatenate([known[old], to]), np.concatenate([floor[old], since])
                order = np.argsort(known)
                known, floor = known[order], floor[order]
        last_key, last_at = int(key[-1]), int(at[-1])
        size = min(2 * size, 1 << 16) if took >= len(rows) else max(64, 2 * took)


def _descending(rows: np.ndarray) -> Iterator[np.ndarray]:
    """A table of rows from its end, common prefixes moved to the row that now comes second."""
    for end in range(len(rows), 0, -BLOCK):
        start = max(0, end - BLOCK)
        block = rows[start:end][::-1].copy()
        block[:, 2] = np.r_[rows[end, 2] if end < len(rows) else 0, block[:-1, 2]]
        yield block


def _blocks(rows: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(0, len(rows), BLOCK):
        yield rows[i:i + BLOCK]


def _both(text: np.ndarray, stars: Iterator[np.ndarray], symbols: int, folder: str,
          prefixes: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All L suffixes ascending and all S suffixes descending, as files of rows (symbol, position, common prefix)."""
    ascending = _store(f"{folder}/L", _induce(text, stars, symbols, False, f"{folder}/queue", prefixes), np.int64, 3)

    def falling() -> Iterator[np.ndarray]:
        yield from _induce(text, _descending(ascending), symbols, True, f"{folder}/queue", prefixes)
        yield np.array([[0, len(text) - 1, 0]])  # the end of the text, which nothing induces

    return ascending, _store(f"{folder}/S", falling(), np.int64, 3)


def _stars(text: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of the stars, last one first."""
    smaller, end = True, len(text)  # type of the suffix at ``end``; the last symbol is of type S
    yield np.array([len(text) - 1])
    end -= 1
    while end > 0:
        start = max(0, end - BLOCK)
        values = text[start:end + 1].astype(np.int64)
        sign = np.sign(np.diff(values))
        places = np.where(sign != 0, np.arange(len(sign)), len(sign))
        nearest = np.minimum.accumulate(places[::-1])[::-1]
        s = np.where(nearest < len(sign), np.r_[sign, 1 if smaller else -1][nearest] > 0, smaller)
        s = np.r_[s, smaller]
        inner = np.flatnonzero(s[1:-1] & ~s[:-2]) + 1 + start  # stars whose left neighbour lies in this block
        edge = [end] if end < len(text) - 1 and s[-1] and not s[-2] else []
        yield np.r_[inner, np.array(edge, np.int64)][::-1]
        smaller, end = bool(s[0]), start


def _doubled(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The end of the recursion: suffix array and common prefixes of a text in memory, by ranks of doubled lengths."""
    n = len(text)
    ranks, rank = [], np.asarray(text)
    while rank.max() < n - 1:
        ranks.append(rank.astype(np.int32))
        ahead = np.zeros(n, np.int64)
        span = 1 << (len(ranks) - 1)
        ahead[:max(0, n - span)] = rank[span:] + 1
        _, rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b, shared = order[:-1], order[1:], np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # the last symbol is unlike all others, so equal ranks lie before it
        x, y = a + shared[1:], b + shared[1:]
        inside = np.maximum(x, y) < n
        same = inside & (ranks[k][np.minimum(x, n - 1)] == ranks[k][np.minimum(y, n - 1)])
        shared[1:] += same << k
    return order, shared


def sort_suffixes(text: np.ndarray, symbols: int, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows (symbol, position, common prefix) of the L suffixes, ascending, and of the S suffixes, descending.

    The last symbol must be 0 and occur nowhere else; values lie below ``symbols``. The common prefix is the one with
    the row before it, 0 where that begins with another symbol. A symbol's L suffixes come before its S suffixes.
    """
    os.makedirs(folder, exist_ok=True)
    if len(text) == 1:
        return np.zeros((0, 3), np.int64), np.array([[0, 0, 0]])
    star = _store(f"{folder}/stars", _stars(text), np.int64)[::-1]

    def in_text_order() -> Iterator[np.ndarray]:
        for at in _blocks(star):
            yield np.stack([text[at].astype(np.int64), at, np.zeros(len(at), np.int64)], 1)

    def named(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Star numbers in ascending order of their substrings, each with the name of its substring."""
        name, last = -1, None
        for block in _descending(rows):
            at = block[:, 1]
            at = at[(at > 0) & (text[np.maximum(at, 1) - 1] > text[at])]
            if not len(at):
                continue
            number = np.searchsorted(star, at)
            length = star[np.minimum(number + 1, len(star) - 1)] - at + 1
            if last is None:
                before, before_length = np.r_[at[0], at[:-1]], np.r_[0, length[:-1]]
            else:
                before, before_length = np.r_[last[0], at[:-1]], np.r_[last[1], length[:-1]]
            like = np.flatnonzero(before_length == length)
            same = np.zeros(len(at), bool)
            same[like] = common(text, before[like], at[like], length[like]) == length[like]
            names = name + np.cumsum(~same)
            name, last = int(names[-1]), (int(at[-1]), int(length[-1]))
            yield np.stack([number, names], 1)

    _, falling = _both(text, in_text_order(), symbols, folder, prefixes=False)
    pairs = _store(f"{folder}/names", named(falling), np.int64, 2)
    names = int(pairs[-1, 1]) + 1
    if names == len(star):
        order, shared = pairs[:, 0], None
    else:
        reduced = room(f"{folder}/reduced", np.int64, len(star))
        for block in _blocks(pairs):
            reduced[block[:, 0]] = block[:, 1]
        if len(reduced) <= BASE_ROWS:
            order, shared = _doubled(reduced)
        else:
            order, shared = merged(reduced, *sort_suffixes(reduced, names, f"{folder}/next"), f"{folder}/next")

    def sorted_stars() -> Iterator[np.ndarray]:
        for i in range(0, len(star), BLOCK):
            number = np.asarray(order[i:i + BLOCK])
            before = np.r_[order[i - 1] if i else number[0], number[:-1]]
            a, b = star[before], star[number]
            done = np.zeros(len(a), np.int64)
            if shared is not None:
                done = star[np.minimum(before + shared[i:i + BLOCK], len(star) - 1)] - a
            prefix = done + common(text, a + done, b + done)
            if not i:
                prefix[0] = 0
            yield np.stack([text[b].astype(np.int64), b, prefix], 1)

    return _both(text, sorted_stars(), symbols, folder)


def seams(text: np.ndarray, ascending: np.ndarray, descending: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Last L suffix, first S suffix and their common prefix, of each symbol that has both."""
    tail, head = [], []
    for i in range(0, len(ascending), BLOCK):
        rows = ascending[i:i + BLOCK + 1]
        ends = rows[:, 0] != np.r_[rows[1:, 0], -1]
        tail.append(rows[:BLOCK][ends[:BLOCK]][:, :2])
    for i in range(0, len(descending), BLOCK):
        rows = descending[i:i + BLOCK + 1]
        ends = rows[:, 0] != np.r_[rows[1:, 0], -1]
        head.append(rows[:BLOCK][ends[:BLOCK]][:, :2])
    tail, head = np.concatenate([np.zeros((0, 2), np.int64), *tail]), np.concatenate(head)[::-1]
    _, x, y = np.intersect1d(tail[:, 0], head[:, 0], assume_unique=True, return_indices=True)
    a, b = tail[x, 1], head[y, 1]
    return a, b, common(text, a, b)


def merged(text: np.ndarray, ascending: np.ndarray, descending: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array and the common prefixes of neighbours."""
    n = len(text)
    order, prefix = room(f"{folder}/order", np.int64, n), room(f"{folder}/prefix", np.int64, n)
    s_rows = len(descending)
    falling = -descending[:, 0]  # ascending by symbol from the end, hence sorted as it stands
    for i in range(0, len(ascending), BLOCK):
        rows = ascending[i:i + BLOCK]
        to = np.arange(i, i + len(rows)) + s_rows - np.searchsorted(falling, -rows[:, 0], "right")
        order[to], prefix[to] = rows[:, 1], rows[:, 2]
    l_symbols, done = ascending[:, 0], 0
    for rows in _descending(descending):
        to = np.arange(done, done + len(rows)) + np.searchsorted(l_symbols, rows[:, 0], "right")
        order[to], prefix[to] = rows[:, 1], rows[:, 2]
        done += len(rows)
    a, b, share = seams(text, ascending, descending)
    if len(b):
        at = np.searchsorted(l_symbols, text[a].astype(np.int64), "right") + s_rows - np.searchsorted(
            falling, -text[a].astype(np.int64), "right")
        prefix[at] = share
    return order, prefix
