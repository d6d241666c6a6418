"""External induced sorting of suffixes with their common prefixes, for operator 13; runs inside a Spark task.

A suffix is of type S if it is less than the one behind it, else of type L. The leftmost S suffixes of each ascent
(seeds) order all others: going up, each suffix met puts the one before it, if of type L, behind all of the same
first character; going down, the same gives those of type S. The seeds themselves are ordered by renaming the
stretches between them and sorting the shorter text of names, by the same induction if it is longer than
``memory``, else by doubling.

What waits to be met is a queue of tuples (first character, place, common prefix with its neighbour): least character
first, or greatest first on the way down, and equal ones in order of entry. It keeps ``memory`` tuples and writes
the rest to sorted runs on disk. A common prefix is one more than the least one met since the last entry for the
same character. Beside the queue a task holds one or two bytes per suffix, the text, mapped from a file
if it is longer than ``memory``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyarrow import fs as pfs

#: Tuples a queue keeps before it writes a run.
MEMORY = 4_000_000


class Scratch:
    """Files of one task in a folder the session shares; they are deleted once the task is done with them."""

    def __init__(self, folder: str):
        self.files, root = pfs.FileSystem.from_uri(folder)
        self.root, self.made = f"{root}/{uuid.uuid4().hex}", 0

    def write(self, *arrays: np.ndarray) -> str:
        if not self.made:
            self.files.create_dir(self.root, recursive=True)
        self.made += 1
        path = f"{self.root}/{self.made}"
        with self.files.open_output_stream(path) as out:
            for x in arrays:
                out.write(np.ascontiguousarray(x).view("u1"))
        return path

    def read(self, path: str, spans: list[tuple[int, int]]) -> list[bytes]:
        """Bytes [start, start + length) of a file, for each span."""
        with self.files.open_input_file(path) as file:
            return [file.read_at(length, start) for start, length in spans]

    def mapped(self, values: np.ndarray) -> np.ndarray:
        """The values in a mapped file, where the folder is mounted; else as they are."""
        return np.memmap(self.write(values), dtype=values.dtype, mode="r") if isinstance(self.files, pfs.LocalFileSystem) else values

    def drop(self, path: str) -> None:
        self.files.delete_file(path)

    def close(self) -> None:
        if self.made:
            self.files.delete_dir(self.root)


class Queue:
    """Tuples (character, place, common prefix): characters in monotone order, equal ones as they came."""

    def __init__(self, scratch: Scratch, memory: int, down: bool = False):
        self.scratch, self.memory, self.sign = scratch, memory, -1 if down else 1
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0
        self.runs: list[dict] = []

    def push(self, chars: np.ndarray, places: np.ndarray, shared: np.ndarray) -> None:
        """``chars`` must be sorted; equal ones keep their order."""
        cuts = np.flatnonzero(np.diff(chars)) + 1
        starts = [0, *cuts.tolist()]
        for a, b in zip(starts, [*starts[1:], len(chars)]):
            self.waiting.setdefault(int(chars[a]), []).append((places[a:b], shared[a:b]))
        self.size += len(chars)
        if self.size > self.memory:
            self._spill()

    def _spill(self) -> None:
        chars = sorted(self.waiting, key=lambda c: self.sign * c)
        places = [np.concatenate([p for p, _ in self.waiting[c]]) for c in chars]
        shared = [np.concatenate([s for _, s in self.waiting[c]]) for c in chars]
        ends = np.cumsum([len(p) for p in places])
        path = self.scratch.write(np.concatenate(places).astype("<i8"), np.concatenate(shared).astype("u1"))
        self.runs.append({"path": path, "chars": chars, "ends": ends, "next": 0})
        self.waiting, self.size = {}, 0

    def drain(self, char: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of all tuples of ``char``, also of those that enter meanwhile."""
        while True:
            for run in self.runs:
                if run["next"] < len(run["chars"]) and run["chars"][run["next"]] == char:
                    i, total = run["next"], int(run["ends"][-1])
                    run["next"] += 1
                    first, end = int(run["ends"][i - 1]) if i else 0, int(run["ends"][i])
                    for a in range(first, end, self.memory):
                        n = min(self.memory, end - a)
                        p, s = self.scratch.read(run["path"], [(8 * a, 8 * n), (8 * total + a, n)])
                        yield np.frombuffer(p, dtype="<i8"), np.frombuffer(s, dtype="u1")
                    break
            else:
                blocks = self.waiting.pop(char, None)
                if blocks is None:
                    break
                places, shared = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*blocks))
                self.size -= len(places)
                yield places, shared
        for run in [r for r in self.runs if r["next"] == len(r["chars"])]:
            self.scratch.drop(run["path"])
            self.runs.remove(run)


class Blocks:
    """Blocks of (place, common prefix) by character, in order of entry; read once, last first."""

    def __init__(self, scratch: Scratch, memory: int):
        self.scratch, self.memory, self.size = scratch, memory, 0
        self.blocks: dict[int, list] = {}

    def add(self, char: int, places: np.ndarray, shared: np.ndarray) -> None:
        block = (places, shared)
        if self.size + len(places) > self.memory:
            block = (self.scratch.write(places.astype("<i8"), shared.astype("u1")), len(places))
        else:
            self.size += len(places)
        self.blocks.setdefault(char, []).append(block)

    def backwards(self, char: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in reversed(self.blocks.pop(char, [])):
            if isinstance(block[0], str):
                path, n = block
                p, s = self.scratch.read(path, [(0, 8 * n), (8 * n, n)])
                self.scratch.drop(path)
                yield np.frombuffer(p, dtype="<i8"), np.frombuffer(s, dtype="u1")
            else:
                self.size -= len(block[0])
                yield block


def seeds(text: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Places of the leftmost S suffixes; the last character must be less than all others."""
    n, found, after = len(text), [np.array([len(text) - 1])], True
    for end in range(n - 1, 0, -block):
        start = max(0, end - block)
        part = text[start : end + 1]
        rises, level = part[1:] > part[:-1], part[1:] == part[:-1]
        # Equal neighbours take the type of the next place where the text moves.
        if level.any():
            at = np.where(level, len(level), np.arange(len(level)))
            at = np.minimum.accumulate(at[::-1])[::-1]
            rises = np.append(rises, after)[at]
        types = np.append(rises, after)
        found.append(start + 1 + np.flatnonzero(types[1:] & ~types[:-1]))
        after = bool(types[0])
    places = np.concatenate(found[::-1])
    return np.append(places[places < n - 1], n - 1)


def _packed(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes of characters from each place on as a number of the same order; beyond the end as 0."""
    width = 8 // text.dtype.itemsize
    if width == 1:
        return np.where(places < len(text), text[np.minimum(places, len(text) - 1)], 0).astype(np.uint64)
    out = np.zeros(len(places), dtype=np.uint64)
    whole = max(0, len(text) - width + 1)
    if whole:  # a number that begins at every character, read from the text where it lies
        wide = np.ndarray((whole,), dtype="<u8", buffer=text.data, strides=text.strides)
        inside = np.flatnonzero(places < whole)
        out[inside] = _turned(wide[places[inside]], text.dtype.itemsize)
    for i in np.flatnonzero(places >= whole).tolist():
        for j, c in enumerate(text[places[i] : places[i] + width].tolist()):
            out[i] |= np.uint64(c << (8 * text.dtype.itemsize * (width - 1 - j)))
    return out


def _turned(values: np.ndarray, size: int) -> np.ndarray:
    """Little-endian numbers of characters of ``size`` bytes, first character last, turned round."""
    if size == 1:
        return values.byteswap()
    rows = values.view(f"<u{size}").reshape(-1, 8 // size)
    return np.ascontiguousarray(rows[:, ::-1]).view("<u8").ravel()


def _refined(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (number of lesser ones) of ``active`` after a look at ``key``; returns those that are still tied."""
    old = rank[active]
    if not old.any():
        order = np.argsort(key)
    elif len(rank) < 1 << 31 and key.dtype != np.uint64:
        order = np.argsort((old << 32) + key + 1)
    else:
        order = np.lexsort((key, old))
    active, key, old = active[order], key[order], old[order]
    starts = np.r_[True, old[1:] != old[:-1]]
    new = starts | np.r_[True, key[1:] != key[:-1]]
    index = np.arange(len(active))
    first = np.maximum.accumulate(np.where(starts, index, 0))
    rank[active] = old + np.maximum.accumulate(np.where(new, index, 0)) - first
    alone = new & np.r_[new[1:], True]
    return active[~alone]


def _names(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rank of the stretch from each seed to the next, both included; one that goes on beyond another's end is less."""
    length = np.append(np.diff(places), 0) + 1
    size = text.dtype.itemsize
    width = 8 // size
    rank, active, at = np.zeros(len(places), dtype=np.int64), np.arange(len(places)), 0
    while len(active):
        key = _packed(text, places[active] + at)
        beyond = np.clip(at + width - length[active], 0, width)
        key |= np.where(beyond == width, ~np.uint64(0), (np.uint64(1) << (beyond % width * 8 * size).astype(np.uint64)) - np.uint64(1))
        active = _refined(rank, active, key)
        at += width
        # One that ends just here may still be tied with one that goes on.
        active = active[length[active] >= at]
    return rank


def _by_doubling(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a text of ranks, told apart by their first ``depth`` names at least."""
    rank, k = names.copy(), 1
    active = np.flatnonzero(np.bincount(rank)[rank] > 1)
    while len(active) and k < depth:
        behind = active + k
        key = np.where(behind < len(rank), rank[np.minimum(behind, len(rank) - 1)], -1)
        active = _refined(rank, active, key)
        k *= 2
    return np.argsort(rank, kind="stable")


def seed_order(text: np.ndarray, places: np.ndarray, depth: int, scratch: Scratch, memory: int) -> np.ndarray:
    """The seeds' places in order of their suffixes, which may tie beyond ``depth`` characters."""
    names = _names(text, places)
    if len(np.unique(names)) == len(names):
        return places[np.argsort(names)]
    if len(names) <= memory:
        return places[_by_doubling(names, depth)]
    blocks = [p for p, _ in induced(names, 0, depth, scratch, memory)]
    return places[np.concatenate([[len(names) - 1], np.concatenate(blocks)[::-1]])]


def _shared(text: np.ndarray, order: np.ndarray, cap: int, block: int = 1 << 18) -> np.ndarray:
    """Common prefix of each suffix of ``order`` with the one before it, up to ``cap``; the first has none."""
    out = np.zeros(len(order), dtype=np.uint8)
    size = text.dtype.itemsize
    width = 8 // size
    for start in range(1, len(order), block):
        b = order[start : start + block]
        a, n = order[start - 1 : start - 1 + len(b)], np.zeros(len(b), dtype=np.int64)
        live, at = np.arange(len(b)), 0
        while len(live) and at < cap:
            differ = _packed(text, a[live] + at) ^ _packed(text, b[live] + at)
            bits = np.frexp((differ >> np.uint64(11)).astype(np.float64))[1]  # upper 53 bits are exact in a float
            low = differ < np.uint64(1 << 11)
            bits = np.where(low, np.frexp(differ.astype(np.float64))[1], bits + 11)
            n[live] += (64 - bits) // (8 * size)
            live = live[differ == 0]
            at += width
        out[start : start + block] = np.minimum(n, cap)
    return out


class _Minima:
    """Least common prefix met since the last entry of each character."""

    def __init__(self, size: int, cap: int):
        self.cap, self.least, self.seen = cap, np.full(size, 255, dtype=np.uint8), np.zeros(size, dtype=bool)

    def entries(self, near: np.ndarray, at: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Common prefixes of entries at ``at`` (indices of ``near``, sorted by ``chars`` and then place)."""
        new = np.r_[True, chars[1:] != chars[:-1]]
        out = np.empty(len(at), dtype=np.uint8)
        first = at[new]
        c = chars[new]
        fore = np.minimum.accumulate(near)
        out[new] = np.where(self.seen[c], np.minimum(self.least[c], fore[first]), 0)
        out[new] = np.where(self.seen[c], np.minimum(out[new], self.cap - 1) + 1, 0)
        rest = np.flatnonzero(~new)
        if len(rest):
            lo, hi = at[rest - 1] + 1, at[rest]
            level = np.frexp(hi - lo + 1)[1] - 1
            table, got = near, np.empty(len(rest), dtype=np.uint8)
            for k in range(int(level.max()) + 1):
                use = level == k
                got[use] = np.minimum(table[lo[use]], table[hi[use] - (1 << k) + 1])
                if len(table) > 1 << k:
                    table = np.minimum(table[: -(1 << k)], table[1 << k :])
            out[rest] = np.minimum(got, self.cap - 1) + 1
        self.least = np.minimum(self.least, fore[-1])
        last = at[np.r_[new[1:], True]]
        back = np.append(np.minimum.accumulate(near[::-1])[::-1], np.uint8(255))
        self.least[c] = back[last + 1]
        self.seen[c] = True
        return out

    def passed(self, near: np.ndarray) -> None:
        self.least = np.minimum(self.least, near.min())


def _run(text: np.ndarray, place: int, cap: int) -> int:
    """How often the character at ``place`` repeats, up to ``cap``."""
    part = text[place : place + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induced(text: np.ndarray, cap: int, depth: int, scratch: Scratch, memory: int = MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (places, common prefixes) of all suffixes but the last, the greatest first.

    A common prefix is that with the suffix met before, up to ``cap`` (at most 255); with ``cap`` 0 none is kept.
    The order is right in the first ``depth`` characters. The last character must be less than all others.
    """
    places = seeds(text)
    order = seed_order(text, places, depth, scratch, memory)
    near = _shared(text, order, cap) if cap else np.zeros(len(order), dtype=np.uint8)
    firsts = text[order]
    chars = np.unique(text)
    size = int(chars[-1]) + 1 if cap else 0

    def met(block, shared, char, keep, queue, minima):
        before = block - 1
        ch = text[before]  # of place 0 that is the last one, the least
        at = np.flatnonzero(keep(ch, char) & (block > 0))
        if not len(at):
            if cap:
                minima.passed(shared)
            return
        ch = ch[at]
        by = np.argsort(ch, kind="stable")
        at, ch = at[by], ch[by]
        queue.push(ch, before[at], minima.entries(shared, at, ch) if cap else np.zeros(len(at), dtype=np.uint8))

    up, large, minima = Queue(scratch, memory), Blocks(scratch, memory), _Minima(size, cap)
    greatest: dict[int, int] = {}
    for char, a, b in zip(chars.tolist(), np.searchsorted(firsts, chars).tolist(), np.searchsorted(firsts, chars, side="right").tolist()):
        for block, shared in up.drain(char):
            large.add(char, block, shared)
            greatest[char] = int(block[-1])
            met(block, shared, char, np.greater_equal, up, minima)
        for start in range(a, b, memory):
            block, shared = order[start : min(b, start + memory)], near[start : min(b, start + memory)].copy()
            if cap and start == a:
                shared[0] = min(_run(text, greatest[char], cap), _run(text, int(block[0]), cap)) if char in greatest else 0
            met(block, shared, char, np.greater, up, minima)
    down, minima = Queue(scratch, memory, down=True), _Minima(size, cap)
    for char in chars[::-1].tolist():
        least = None
        for block, shared in down.drain(char):
            least = int(block[-1])
            yield block, shared
            met(block, shared, char, np.less_equal, down, minima)
        behind = 0  # of the suffix met before with the first of the block
        if cap and least is not None and char in greatest:
            behind = min(_run(text, greatest[char], cap), _run(text, least, cap))
        for block, shared in large.backwards(char):
            block, turned = block[::-1], shared[::-1]
            shared = np.concatenate([np.array([behind], dtype=np.uint8), turned[:-1]])
            behind = int(turned[-1])
            yield block, shared
            met(block, shared, char, np.less, down, minima)
