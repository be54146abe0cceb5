"""External suffix sorting by recursive induction, with common prefixes.

The input is a string of fragments, each closed by a separator (symbol 0) that matches nothing. Suffixes of type S* are
sorted first: an induction from unsorted seeds orders their substrings up to the next S* suffix and names them; where
names repeat, the string of names is sorted by the same method, which is at most half as long, and so on until all names
differ or a level's names fit into the memory limit, where doubling sorts them. A level hands its order and common prefixes, counted in names, up to the level above: the names in common tell
how many symbols are, and only the first names that differ are compared by their symbols. From the sorted S* suffixes all
others are induced: a queue entry is a suffix with its preceding symbols and the length of the prefix that it has in
common with the entry before it. A scan in sorted order moves each entry to the queue of its preceding symbol, with one
more common symbol than the least common prefix met since that symbol's last entry. So every queue receives its entries
in order: priority queues by (symbol, rank) that are plain sequences.

Bytes have a queue each. Names are the places of their groups in the order of S* suffixes, and ranges of names have a
queue each, ranges of about the same number of suffixes; a name that alone has more has its own. A range is read as a
whole, and its entries move on in one step up to the first that waits for an entry not there yet.

Nothing else of the input's size needs memory: the text may be a mapped file; types, runs, the S* suffixes, their names,
order and common prefixes are arrays that lie on disk once they exceed the memory limit together, and are worked on block
by block; queues spill to disk blocks beyond the same limit.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np

from .common import BYTE, FAR, PLACE, mix

#: Entries that a scan handles at once.
BLOCK = 1 << 16
#: Position, common prefix, and the eight symbols before the position, the nearest lowest.
ENTRY = np.dtype([("at", np.int64), ("common", np.int16), ("before", np.uint64)])
#: The same for a string of names, two of which stand in ``before``, with the suffix's own first name.
NAMED = np.dtype([*((name, ENTRY[name]) for name in ENTRY.names), ("symbol", np.int64)])
#: Suffixes to a range of names, unless there are too many ranges; their number; entries looked at for one step.
WIDTH, RANGES, LOOK = 4096, 256, 4096
NEVER = np.iinfo(np.int64).max
#: Bytes that doubling in memory takes for a name, at most.
DOUBLING = 40


def spill_dir() -> str | None:
    """Where a task may leave what it can't hold: where Spark itself spills on this executor. Gone with the task."""
    local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return local if local and os.path.isdir(local) else None


class Arrays:
    """Arrays of zeros, in memory while they fit ``limit`` bytes together, mapped from disk beyond."""

    def __init__(self, folder: str, limit: int) -> None:
        self.folder, self.limit, self.used, self.files = Path(folder), limit, 0, 0

    def make(self, n: int, kind: type) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if self.used + size <= self.limit or not n:
            self.used += size
            return np.zeros(n, kind)
        self.files += 1
        return np.memmap(self.folder / f"{self.files}.array", kind, "w+", shape=(n,))


class Pool:
    """Memory shared by queues; beyond ``limit`` bytes the largest queue moves to disk."""

    def __init__(self, folder: str, limit: int, kind: np.dtype = ENTRY) -> None:
        self.folder, self.limit, self.kind, self.used, self.queues = Path(folder), limit, kind, 0, []
        self.files = 0

    def queue(self) -> Queue:
        q = Queue(self)
        self.queues.append(q)
        return q

    def grow(self, n: int) -> None:
        self.used += n
        while self.used > self.limit:
            largest = max(self.queues, key=lambda q: q.bytes)
            if not largest.bytes:
                break
            largest.spill()


class Queue:
    """A sequence of entries, appended and taken in blocks, partly on disk."""

    __slots__ = ("pool", "held", "bytes", "path")

    def __init__(self, pool: Pool) -> None:
        self.pool, self.held, self.bytes, self.path = pool, [], 0, None

    def push(self, block: np.ndarray) -> None:
        if len(block):
            self.held.append(block)
            self.bytes += block.nbytes
            self.pool.grow(block.nbytes)

    def spill(self) -> None:
        if self.path is None:
            self.pool.files += 1
            self.path = f"{self.pool.folder}/{self.pool.files}.queue"
        with open(self.path, "ab") as f:
            for block in self.held:
                block.tofile(f)
        self.pool.used -= self.bytes
        self.held, self.bytes = [], 0

    def drain(self) -> Iterator[np.ndarray]:
        """Blocks in order, also those pushed meanwhile; the queue is empty afterwards."""
        done = 0
        while True:
            if self.path is not None and os.path.getsize(self.path) > done:
                block = np.fromfile(self.path, self.pool.kind, BLOCK, offset=done)
                done += block.nbytes
            elif self.held:
                block = np.concatenate(self.held)
                self.pool.used -= self.bytes
                self.held, self.bytes = [], 0
            else:
                break
            for a in range(0, len(block), BLOCK):
                yield block[a : a + BLOCK]
        if self.path is not None:
            os.unlink(self.path)
            self.path = None

    def clear(self) -> None:
        self.pool.used -= self.bytes
        self.held, self.bytes = [], 0
        if self.path is not None:
            os.unlink(self.path)
            self.path = None

    def reverse(self) -> Iterator[np.ndarray]:
        """Blocks from the last entry to the first, of those there at the start; the queue is left as it is. It may spill
        meanwhile."""
        held, n = list(self.held), os.path.getsize(self.path) // self.pool.kind.itemsize if self.path is not None else 0
        for block in reversed(held):
            yield block[::-1]
        for end in range(n, 0, -BLOCK):
            a = max(0, end - BLOCK)
            yield np.fromfile(self.path, self.pool.kind, end - a, offset=a * self.pool.kind.itemsize)[::-1]


class Queues(dict):
    """Queues by number, each made when it is first asked for."""

    def __init__(self, pool: Pool) -> None:
        self.pool = pool

    def __missing__(self, number: int) -> Queue:
        self[number] = self.pool.queue()
        return self[number]

    def pop(self, number: int) -> Iterator[np.ndarray]:
        """What a queue holds; it is given up then."""
        yield from self[number].drain()
        self.pool.queues.remove(dict.pop(self, number))


class Scan:
    """The part of an induction that carries common prefixes from a scan to the queues of preceding symbols."""

    def __init__(self, queues: list[Queue]) -> None:
        self.queues, self.since = queues, np.full(256, -1, np.int16)  # -1: the queue is still empty

    def move(self, block: np.ndarray, symbol: np.ndarray, chosen: np.ndarray) -> None:
        """Entries at the places ``chosen`` go on to the queues of their preceding ``symbol``."""
        common, n = block["common"], len(block)
        if not len(chosen):
            self.since = np.minimum(self.since, common.min())
            return
        order = chosen[np.argsort(symbol[chosen], kind="stable")]
        to = symbol[order]
        first = np.concatenate(([True], to[1:] != to[:-1]))
        start = np.where(first, 0, np.concatenate(([0], order[:-1])) + 1)
        least = _range_min(common, start, order)
        least[first] = np.minimum(least[first], self.since[to[first]])
        entries = np.empty(len(order), ENTRY)
        entries["at"], entries["common"], entries["before"] = block["at"][order] - 1, least + 1, block["before"][order] >> np.uint64(8)
        tail = np.minimum.accumulate(common[::-1])[::-1]
        self.since = np.minimum(self.since, common.min())
        last = np.concatenate((np.flatnonzero(first)[1:], [len(order)])) - 1
        self.since[to[last]] = np.where(order[last] + 1 < n, tail[np.minimum(order[last] + 1, n - 1)], np.iinfo(np.int16).max)
        for a, b in zip(np.flatnonzero(first), last + 1, strict=True):
            self.queues[to[a]].push(entries[a:b].copy())  # a view would keep the whole block


def _range_min(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minima of x over start..end, both included."""
    size = end - start + 1
    out = np.empty(len(start), x.dtype)
    level = np.frexp(size.astype(np.float64))[1] - 1
    table, k = x, 0
    top = int(level.max())
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[start[at]], table[end[at] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


class InducedSort:
    """Sorts the suffixes of ``text`` (uint8, ends with 0; no two zeros side by side). Prefix lengths stop at ``cap``."""

    #: Bits of a symbol that an entry carries; symbols.
    bits, names = 8, 256

    def __init__(self, text: np.ndarray, cap: int, memory: int = 64 << 20, block: int = BLOCK) -> None:
        self.text, self.cap, self.memory, self.block = text, cap, memory, block

    @staticmethod
    def _code(x: np.ndarray) -> np.ndarray:
        return BYTE[x]

    def _blocks(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.block):
            yield a, min(a + self.block, n)

    def _types(self) -> None:
        """small: S or L, run: equal symbols from here, up to the cap; stars: the S* suffixes."""
        n = len(self.text)
        self.small, self.run = self.arrays.make(n, np.bool_), self.arrays.make(n, np.int16)
        for a, b in reversed(list(self._blocks(n))):
            x = np.asarray(self.text[a:b])
            after = np.append(x[1:], self.text[b] if b < n else 0)
            turn = x != after
            turn[-1] |= b == n
            at = np.arange(b - a)
            end = np.minimum.accumulate(np.where(turn, at, b - a)[::-1])[::-1]
            inside = end < b - a
            last = np.where(inside, end, 0)
            run = np.where(inside, end - at + 1, b - a - at + (int(self.run[b]) if b < n else 0))
            small = np.where(inside, x[last] < after[last], bool(self.small[b]) if b < n else True)
            self.small[a:b], self.run[a:b] = small | (x == 0), np.minimum(run, self.cap)
        self.stars, k = self.arrays.make(sum(len(self._stars_in(a, b)) for a, b in self._blocks(n)), np.int64), 0
        for a, b in self._blocks(n):
            some = self._stars_in(a, b)
            self.stars[k : k + len(some)] = some
            k += len(some)

    def _stars_in(self, a: int, b: int) -> np.ndarray:
        small = np.asarray(self.small[max(0, a - 1) : b])
        return np.flatnonzero(small[1:] & ~small[:-1]) + max(0, a - 1) + 1

    def _before(self, at: np.ndarray) -> np.ndarray:
        """As many symbols before each position as fit 64 bits; none before a fragment's start."""
        out = np.zeros(len(at), np.uint64)
        open_ = np.ones(len(at), bool)
        for k in range(1, 64 // self.bits + 1):
            p = at - k
            s = np.where(p >= 0, self.text[np.maximum(p, 0)], 0)
            open_ &= s > 0
            out |= np.where(open_, s, 0).astype(np.uint64) << np.uint64(self.bits * (k - 1))
        return out

    def _refill(self, block: np.ndarray) -> np.ndarray:
        """Read the text again for entries that have used up the symbols they carried."""
        out = np.flatnonzero(block["before"] == 0)
        out = out[block["at"][out] > 0]
        out = out[self.text[block["at"][out] - 1] > 0]
        if len(out):
            block = block.copy()
            block["before"][out] = self._before(block["at"][out])
        return block

    def induce(self, seeds: np.ndarray, common: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, common prefix with the position before) of all suffixes in order, but the separators' own, from
        the S* suffixes in order."""
        pool = Pool(tempfile.mkdtemp(dir=self.folder), self.memory)
        large, small = [pool.queue() for _ in range(256)], [pool.queue() for _ in range(256)]
        kept = [pool.queue() for _ in range(256)]
        scan, last = Scan(large), None
        for c in range(256):
            last = None
            for block in large[c].drain():
                block = self._refill(block)
                kept[c].push(block)
                last = block[-1]["at"]
                symbol = (block["before"] & np.uint64(255)).astype(np.int64)
                scan.move(self._capped(block), symbol, np.flatnonzero((symbol >= c) & (symbol > 0)))
            for a in range(self.bounds[c], self.bounds[c + 1], self.block):
                b = min(a + self.block, self.bounds[c + 1])
                at = np.asarray(seeds[a:b])
                block = np.empty(len(at), ENTRY)
                block["at"], block["common"], block["before"] = at, 0 if common is None else common[a:b], self._before(at)
                if a == self.bounds[c]:
                    block["common"][0] = 0 if last is None or c == 0 else min(self.run[last], self.run[at[0]])
                symbol = (block["before"] & np.uint64(255)).astype(np.int64)
                scan.move(block, symbol, np.flatnonzero(symbol > c))
        scan = Scan(small)
        for c in range(255, 0, -1):
            done = pool.queue()
            lowest = None
            for block in small[c].drain():
                block = self._refill(block)
                done.push(block)
                lowest = block[-1]["at"]
                symbol = (block["before"] & np.uint64(255)).astype(np.int64)
                scan.move(self._capped(block), symbol, np.flatnonzero((symbol <= c) & (symbol > 0)))
            # the L suffixes from the last: each one's common prefix with the one scanned before it
            nearest = 0 if lowest is None else None
            for block in kept[c].reverse():
                block = block.copy()
                if nearest is None:
                    nearest = min(self.run[block[0]["at"]], self.run[lowest])
                own = block["common"].copy()
                block["common"][1:] = own[:-1]
                block["common"][0] = nearest
                nearest = own[-1]
                symbol = (block["before"] & np.uint64(255)).astype(np.int64)
                scan.move(self._capped(block), symbol, np.flatnonzero((symbol < c) & (symbol > 0)))
            small[c] = done
        for c in range(1, 256):
            last = None
            for block in kept[c].drain():
                last = block[-1]["at"]
                yield block["at"], np.minimum(block["common"], self.cap)
            # S suffixes lie from the last to the first, each with its common prefix with the next one in order
            nearest = 0 if last is None else None
            for block in small[c].reverse():
                if nearest is None:
                    nearest = min(self.run[last], self.run[block[0]["at"]])
                own = block["common"]
                yield block["at"], np.minimum(np.concatenate(([nearest], own[:-1])), self.cap)
                nearest = own[-1]
            small[c].clear()

    def _capped(self, block: np.ndarray) -> np.ndarray:
        if (block["common"] > self.cap).any():
            block = block.copy()
            block["common"] = np.minimum(block["common"], self.cap)
        return block

    def _digests(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash and the size of each S* substring: up to the next S* suffix, its first symbol included; 1 for a separator."""
        stars = self.stars
        digest, size = self.arrays.make(len(stars), np.uint64), self.arrays.make(len(stars), np.int64)
        for a, b in self._blocks(len(stars)):
            own = np.asarray(stars[a : min(b + 1, len(stars))])
            if b == len(stars):
                own = np.append(own, own[-1])
            own, end = own[:-1], own[1:]
            size[a:b] = np.where(self.text[own] == 0, 0, end - own) + 1
            for c, d in self._stretches(own, end):
                inside = np.arange(own[c], end[d - 1] + (end[d - 1] == own[d - 1]))
                step = inside - own[c + np.searchsorted(own[c:d], inside, "right") - 1]
                code = self._code(self.text[inside]) * (PLACE[step & 255] + FAR * (step >> 8).astype(np.uint64))
                digest[a + c : a + d] = mix(np.add.reduceat(code, own[c:d] - own[c]) + self._code(self.text[end[c:d]]) * FAR + size[a + c : a + d].astype(np.uint64))
        return digest, size

    def _stretches(self, own: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
        """S* substrings a block of symbols at a time."""
        c = 0
        while c < len(own):
            d = max(c + 1, int(np.searchsorted(end, own[c] + 4 * self.block, "right")))
            yield c, d
            c = d

    def _named(self) -> tuple[np.ndarray, np.ndarray]:
        """The S* suffixes (as places in text order) ordered by the names of their substrings, separators first; and the
        place of the first one with the same name, by place in text order."""
        stars, m = self.stars, len(self.stars)
        self.bounds, next_ = self.arrays.make(self.names + 1, np.int64), self.arrays.make(self.names + 1, np.int64)
        for a, b in self._blocks(m):
            symbol, count = np.unique(self.text[stars[a:b]], return_counts=True)
            self.bounds[symbol + 1] += count
        total = 0
        for a, b in self._blocks(self.names + 1):
            self.bounds[a:b] = next_[a:b] = total + np.cumsum(self.bounds[a:b])
            total = int(self.bounds[b - 1])
        seeds, order, rank = (self.arrays.make(m, np.int64) for _ in range(3))
        for a, b in self._blocks(m):
            own = np.asarray(stars[a:b])
            symbol = self.text[own]
            turn = np.argsort(symbol, kind="stable")
            own, ends = own[turn], turn[symbol[turn] == 0] + a
            order[next_[0] : next_[0] + len(ends)] = ends  # separators are all different, and stand in text order
            rank[ends] = next_[0] + np.arange(len(ends))
            symbol, begin, count = np.unique(symbol[turn], return_index=True, return_counts=True)
            seeds[np.repeat(next_[symbol] - begin, count) + np.arange(len(own))] = own
            next_[symbol] += count
        digest, size = self._digests()
        place, before, first = int(self.bounds[1]), None, int(self.bounds[1])
        for at, _ in self.induce(seeds, None):
            at = at[self.small[at] & (at > 0)]
            at = at[~self.small[at - 1]]
            if not len(at):
                continue
            k = np.searchsorted(stars, at)
            told = digest[k], size[k], self.text[at]
            new = np.ones(len(k), bool)
            new[1:] = np.any([t[1:] != t[:-1] for t in told], axis=0)
            new[0] = before is None or before != tuple(int(t[0]) for t in told)
            before = tuple(int(t[-1]) for t in told)
            places = place + np.arange(len(k))
            order[places[0] : places[-1] + 1] = k
            firsts = np.maximum.accumulate(np.where(new, places, first))
            rank[k] = firsts
            place, first = place + len(k), int(firsts[-1])
        return order, rank

    def _repeated(self, order: np.ndarray, rank: np.ndarray) -> tuple[bool, np.ndarray]:
        """Whether names repeat; those that more suffixes have than a range does."""
        m, repeat, heavy, last = len(order), False, [], None
        self.width = max(min(self.block, WIDTH), m // RANGES)
        for a, b in self._blocks(m):
            first = np.flatnonzero(rank[order[a:b]] == np.arange(a, b)) + a
            repeat |= len(first) < b - a
            begin = first if last is None else np.append(last, first)
            heavy += begin[:-1][np.diff(begin) > self.width].tolist()
            last = begin[-1:]
        if last is not None and m - last[0] > self.width:
            heavy.append(int(last[0]))
        return repeat, np.array([h for h in heavy if h >= self.bounds[1]], np.int64)

    def _string(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The names in text order, and which S* suffix each stands for. A separator that would stand first or after
        another one is left out."""
        m, k, ended = len(rank), 0, True
        string, at = self.arrays.make(m, np.int64), self.arrays.make(m, np.int64)
        for a, b in self._blocks(m):
            end = self.text[self.stars[a:b]] == 0
            keep = np.flatnonzero(~(end & np.concatenate(([ended], end[:-1]))))
            string[k : k + len(keep)], at[k : k + len(keep)] = np.where(end, 0, rank[a:b])[keep], keep + a
            k, ended = k + len(keep), bool(end[-1])
        return string[:k], at[:k]

    def _sorted_stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the S* suffixes in order, and the common prefix of each and the one before."""
        order, rank = self._named()
        same = self.arrays.make(len(order), np.int16)  # names in common
        repeat, heavy = self._repeated(order, rank)
        if repeat and len(order) * DOUBLING <= self.memory:
            self._double(order, rank)
        elif repeat:
            string, at = self._string(rank)
            place = int(self.bounds[1])
            # a name but a separator's is of two symbols at least, besides the one that begins the next
            for own, common in NameSort(self, string, heavy).suffixes():
                order[place : place + len(own)], same[place : place + len(own)] = at[own], common
                place += len(own)
        return self._told(order, same)

    def _double(self, order: np.ndarray, rank: np.ndarray) -> None:
        """Sorts S* suffixes of the same name by the names that follow, twice as many at each turn."""
        m, h = len(order), 1
        rank = np.append(rank, m).astype(np.int32)
        close = np.where(self.text[self.stars] == 0, np.arange(m, dtype=np.int32), np.int32(m))
        close = np.minimum.accumulate(close[::-1])[::-1]  # of each one the place of its fragment's separator
        first = np.append(rank[order] == np.arange(m), True)
        ties = np.flatnonzero(~(first[:-1] & first[1:])).astype(np.int32)
        while len(ties) and 2 * h < self.cap:  # h names are of 2 h symbols at least
            at = order[ties].astype(np.int32)
            follow = np.minimum(at + np.int32(h), close[at])
            key = np.where(follow == close[at], 0, rank[follow] + np.int64(1)) | rank[at].astype(np.int64) << 32
            turn = np.argsort(key, kind="stable")
            key, at = key[turn], at[turn]
            order[ties] = at
            new = np.append(True, key[1:] != key[:-1])
            rank[at] = np.maximum.accumulate(np.where(new, ties, 0))
            ties = ties[~(new & np.append(new[1:], True))]
            h *= 2

    def _told(self, order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the S* suffixes, and their common prefixes up to the cap: what their common names cover, and as
        much of the first names that differ as is equal."""
        stars, m = self.stars, len(order)
        out, common = self.arrays.make(m, np.int64), self.arrays.make(m, np.int16)
        for first, end in self._blocks(m):
            begin = max(0, first - 1)
            star = np.asarray(order[begin:end])
            own = stars[star]
            out[first:end] = own[first - begin :]
            left = star[1:]
            done = np.minimum(stars[left + same[begin + 1 : end]] - stars[left], self.cap)
            common[begin + 1 : end] = done
            at = np.flatnonzero(done < self.cap)
            a, b, k = own[:-1][at] + done[at], own[1:][at] + done[at], done[at]
            while len(at):
                x = self.text[a]
                more = (x == self.text[b]) & (x > 0)
                a, b, k, at = a[more] + 1, b[more] + 1, k[more] + 1, at[more]
                common[begin + 1 + at] = k
                short = k < self.cap
                a, b, k, at = a[short], b[short], k[short], at[short]
        return out, common

    def suffixes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self._types()
        yield from self.induce(*self._sorted_stars())

    def sorted(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes but the separators' own, in order: blocks of positions, with the common prefix of each and the
        one before it, up to the cap."""
        with tempfile.TemporaryDirectory(prefix="induced-", dir=spill_dir()) as self.folder:
            self.arrays = Arrays(self.folder, self.memory)
            yield from self.suffixes()


class Sweep:
    """A scan over names, upwards (``sign`` 1: it moves L suffixes) or downwards (-1: S suffixes), that moves entries to the
    queues of their preceding names. A name's first entries are those moved there, its second ones come from elsewhere."""

    def __init__(self, sort: NameSort, queues: Queues, sign: int) -> None:
        self.sort, self.queues, self.sign = sort, queues, sign
        self.last = sort.last  # when each name last received an entry
        for a, b in sort._blocks(len(self.last)):
            self.last[a:b] = 0
        self.seen = 0
        self.low = np.zeros(sort.cap + 1, np.int64)  # when a common prefix of at most 0, 1, ... was last met
        self.before = -1, 0, False  # the entry scanned last
        self.out, self.waiting = [], 0

    def targets(self, block: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The name that each entry moves to; 0: none."""
        to, own = (block["before"] & np.uint64(0xFFFFFFFF)).astype(np.int64), block["symbol"]
        return np.where((to > 0) & (self.sign * to >= self.sign * own + second), to, 0)

    def keys(self, symbol: np.ndarray, second: np.ndarray | int) -> np.ndarray:
        return 2 * self.sign * symbol + second

    def step(self, block: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Scans a block; the entries that it moves."""
        sort, n, own = self.sort, len(block), block["symbol"]
        _meet(block, second, self.before, sort.run)
        common = block["common"] = np.minimum(block["common"], sort.cap)
        self.before = int(own[-1]), int(block["at"][-1]), bool(second[-1])
        to = self.targets(block, second)
        order = np.flatnonzero(to)
        when = self.seen + 1 + np.arange(n)
        entries = np.empty(len(order), NAMED)
        if len(order):
            order = order[np.argsort(to[order], kind="stable")]
            to = to[order]
            first = np.append(True, to[1:] != to[:-1])
            least = _range_min(common, np.where(first, 0, np.append(0, order[:-1]) + 1), order)
            ago = self.last[to[first]]
            # before this block: the least value met after that time
            least[first] = np.where(ago > 0, np.minimum(least[first], np.searchsorted(self.low, ago, "right")), -1)
            self.last[to[np.append(first[1:], True)]] = when[order[np.append(first[1:], True)]]
            entries["at"], entries["common"], entries["before"] = block["at"][order] - 1, least + 1, block["before"][order] >> np.uint64(32)
            entries["symbol"] = to
            entries = entries[np.argsort(order)]  # as scanned
        newest = np.zeros(len(self.low), np.int64)
        newest[common] = when  # of equal values the last one counts
        self.low = np.maximum(self.low, np.maximum.accumulate(newest))
        self.seen += n
        return entries

    def send(self, entries: np.ndarray) -> None:
        self.out.append(entries)
        self.waiting += len(entries)
        if self.waiting > self.sort.block:
            self.flush()

    def flush(self) -> None:
        if self.waiting:
            entries = np.concatenate(self.out)
            queue = self.sort.queue_of(entries["symbol"])
            order = np.argsort(queue, kind="stable")
            entries, queue = entries[order], queue[order]
            cut = np.flatnonzero(np.append(True, queue[1:] != queue[:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(queue)), strict=True):
                self.queues[int(queue[a])].push(entries[a:b].copy())
        self.out, self.waiting = [], 0

    def range(self, q: int, firsts: np.ndarray, seconds: np.ndarray, kept: Queue) -> None:
        """Scans the entries of queue ``q`` and what moves there meanwhile; firsts are kept."""
        block, second = np.concatenate((firsts, seconds)), np.repeat([False, True], [len(firsts), len(seconds)])
        turn = np.argsort(self.keys(block["symbol"], second), kind="stable")
        columns = self._columns(q, block[turn], second[turn])
        at = 0
        while at < len(columns[0]):
            block, second, key, to = (c[at : at + LOOK] for c in columns)
            # an entry may go on if none before it moves one to a place ahead of it
            wait = key > np.minimum.accumulate(to)
            n = int(wait.argmax()) if wait.any() else len(wait)
            entries = self.step(block[:n], second[:n])
            kept.push(block[:n][~second[:n]])
            inside = self.sort.queue_of(entries["symbol"]) == q
            self.send(entries[~inside])
            at += n
            if inside.any():
                new = entries[inside]
                new = self._columns(q, new[np.argsort(self.keys(new["symbol"], 0), kind="stable")], np.zeros(len(new), bool))
                where = np.searchsorted(columns[2][at:], new[2], "right") + np.arange(len(new[2]))
                old = np.ones(len(columns[2]) - at + len(where), bool)
                old[where] = False
                columns, at = tuple(_merged(c[at:], n, old) for c, n in zip(columns, new, strict=True)), 0

    def _columns(self, q: int, block: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entries, which are second ones, their places in the scan, and the places in this queue that they move one to."""
        block = self.sort._refill(block)
        to = self.targets(block, second)
        return block, second, self.keys(block["symbol"], second), np.where((to > 0) & (self.sort.queue_of(to) == q), self.keys(to, 0), NEVER)

    def blocks(self, blocks: Iterator[np.ndarray], second: bool, kept: Queue | None = None) -> None:
        """Scans the entries of one name."""
        for block in blocks:
            block = self.sort._refill(block).copy()
            self.send(self.step(block, np.full(len(block), second)))
            self.flush()  # a name may come before itself
            if kept is not None:
                kept.push(block)


def _merged(old: np.ndarray, new: np.ndarray, is_old: np.ndarray) -> np.ndarray:
    out = np.empty(len(is_old), old.dtype)
    out[is_old], out[~is_old] = old, new
    return out


def _meet(block: np.ndarray, second: np.ndarray, before: tuple[int, int, bool], run: np.ndarray) -> None:
    """Where a name's second entries begin, they share the run of their name with the entry before."""
    symbol = np.append(before[0], block["symbol"][:-1])
    same = symbol == block["symbol"]
    edge = np.flatnonzero(second & ~(same & np.append(before[2], second[:-1])))
    if len(edge):
        ahead = np.append(before[1], block["at"][:-1])[edge]
        block["common"][edge] = np.where(same[edge], np.minimum(run[ahead], run[block["at"][edge]]), 0)


def _shifted(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Entries in reverse, each with the common prefix that the one before it now was scanned with."""
    nearest = 0
    for block in blocks:
        block = block.copy()
        own = block["common"].copy()
        block["common"] = np.append(nearest, own[:-1])
        nearest = own[-1]
        yield block


def _whole(blocks: Iterator[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, NAMED), *blocks])


class NameSort(InducedSort):
    """The level below ``above``: sorts the suffixes of its string of names."""

    bits = 32

    def __init__(self, above: InducedSort, text: np.ndarray, heavy: np.ndarray) -> None:
        super().__init__(text, above.cap // 2 + 1, above.memory, above.block)
        self.names = len(above.stars)
        if self.names >> 32:
            raise ValueError("a shard's S* suffixes must be fewer than 2^32")
        self.heavy, self.span, self.arrays, self.folder = heavy, above.width, above.arrays, above.folder
        self.last = self.arrays.make(self.names, np.int64)

    @staticmethod
    def _code(x: np.ndarray) -> np.ndarray:
        return mix(x.astype(np.uint64) + FAR) | np.uint64(1)

    def queue_of(self, symbol: np.ndarray) -> np.ndarray:
        queue = 2 * (symbol // self.span)
        if len(self.heavy):
            queue += self.heavy[np.minimum(np.searchsorted(self.heavy, symbol), len(self.heavy) - 1)] == symbol
        return queue

    def _seeds(self, seeds: np.ndarray, common: np.ndarray | None, a: int, b: int) -> np.ndarray:
        at = np.asarray(seeds[a:b])
        block = np.empty(len(at), NAMED)
        block["at"], block["common"], block["before"], block["symbol"] = at, 0 if common is None else common[a:b], self._before(at), self.text[at]
        return block

    def induce(self, seeds: np.ndarray, common: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pool = Pool(tempfile.mkdtemp(dir=self.folder), self.memory, NAMED)
        n, bounds = (self.names - 1) // self.span + 1, self.bounds
        large, small, kept, done = (Queues(pool) for _ in range(4))
        heavy = dict(zip((self.heavy // self.span).tolist(), self.heavy.tolist(), strict=True))

        def parts(a: int, b: int) -> Iterator[np.ndarray]:
            return (self._seeds(seeds, common, c, min(c + self.block, b)) for c in range(a, b, self.block))

        sweep = Sweep(self, large, 1)
        sweep.blocks(parts(0, int(bounds[1])), True)
        for p in range(n):
            sweep.flush()
            a, b = int(bounds[max(1, p * self.span)]), int(bounds[heavy.get(p, min(self.names, (p + 1) * self.span))])
            sweep.range(2 * p, _whole(large.pop(2 * p)), self._seeds(seeds, common, a, b), kept[2 * p])
            if p in heavy:
                sweep.flush()
                sweep.blocks(large.pop(2 * p + 1), False, kept[2 * p + 1])
                sweep.blocks(parts(int(bounds[heavy[p]]), int(bounds[heavy[p] + 1])), True)
        sweep = Sweep(self, small, -1)
        for p in range(n - 1, -1, -1):
            sweep.flush()
            if p in heavy:
                sweep.blocks(small.pop(2 * p + 1), False, done[2 * p + 1])
                sweep.blocks(_shifted(kept[2 * p + 1].reverse()), True)
            sweep.range(2 * p, _whole(small.pop(2 * p)), _whole(_shifted(kept[2 * p].reverse())), done[2 * p])
        before = -1, 0, False
        for p in range(n):
            firsts, seconds = _whole(kept.pop(2 * p)), _whole(_shifted(done[2 * p].reverse()))
            done[2 * p].clear()
            block, second = np.concatenate((firsts, seconds)), np.repeat([False, True], [len(firsts), len(seconds)])
            turn = np.argsort(2 * block["symbol"] + second, kind="stable")
            light = block[turn], second[turn]
            streams = [light]
            if p in heavy:
                q = 2 * p + 1
                streams = chain(streams, ((b.copy(), np.zeros(len(b), bool)) for b in kept.pop(q)), ((b, np.ones(len(b), bool)) for b in _shifted(done[q].reverse())))
            for block, second in streams:
                if len(block):
                    _meet(block, second, before, self.run)
                    before = int(block["symbol"][-1]), int(block["at"][-1]), bool(second[-1])
                    yield block["at"], np.minimum(block["common"], self.cap)
            done[2 * p + 1].clear()
