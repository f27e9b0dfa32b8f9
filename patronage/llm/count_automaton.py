"""Weighted acyclic automata of word n-grams and their counts.

An n-gram of one to three words is a path from the root; the weight of the path's last
arc is its count, 0 where the path is only the beginning of others.  States with equal
arcs are one state.  Words are bytes without blanks, and sort by their bytes.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import zstandard

ORDER = 3
END = 0  # the state without arcs
Phrase = tuple[bytes, ...]


@dataclass
class Grams:
    """Sorted n-grams: places in the sorted ``words``, from 1, 0 after the last; and weights."""

    words: list[bytes]
    at: np.ndarray
    weight: np.ndarray

    def __len__(self) -> int:
        return len(self.at)

    def phrase(self, i: int) -> Phrase:
        return tuple(self.words[w - 1] for w in self.at[i].tolist() if w)

    def part(self, start: int, end: int) -> Grams:
        """Some of the n-grams, with the words they use."""
        at = self.at[start:end]
        used = np.unique(at)
        used = used[used > 0]
        place = np.zeros(len(self.words) + 1, np.int32)
        place[used] = np.arange(1, len(used) + 1)
        return Grams([self.words[i - 1] for i in used.tolist()], place[at], self.weight[start:end])

    def first_from(self, bound: Phrase) -> int:
        """The number of n-grams before ``bound``."""
        row = [0] * ORDER
        for depth, word in enumerate(bound):
            i = bisect_left(self.words, word)
            row[depth] = i + 1
            if i == len(self.words) or self.words[i] != word:
                break
        return bisect_left(range(len(self)), row, key=lambda i: self.at[i].tolist())


def keys_of(at: np.ndarray, n_words: int) -> np.ndarray:
    """A number for each n-gram, in the order of the n-grams."""
    at = at.astype(np.int64)
    bits = (n_words + 1).bit_length()
    if 3 * bits <= 63:
        return at[:, 0] << 2 * bits | at[:, 1] << bits | at[:, 2]
    pair = np.unique(at[:, 0] << 32 | at[:, 1], return_inverse=True)[1]
    return pair << 32 | at[:, 2]


def collected(words: list[bytes], at: np.ndarray, weight: np.ndarray) -> Grams:
    """Sorted n-grams; the weights of equal ones are added."""
    keys = keys_of(at, len(words))
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.diff(keys[order], prepend=-1))
    added = np.add.reduceat(weight[order], new) if len(new) else weight[:0]
    return Grams(words, at[order[new]], added)


def count_grams(words: list[bytes], sequence: np.ndarray, size: int) -> Iterator[Grams]:
    """Count the n-grams of a sequence of places in ``words``, from 1; 0 parts pieces.

    Gives them sorted, ``size`` at a time, each time with the words that occur.
    """
    padded = np.append(sequence.astype(np.int64), [0] * ORDER)
    one, two, three = (padded[i : len(padded) - ORDER + i] for i in range(ORDER))
    bits = (len(words) + 1).bit_length()
    pairs = (one > 0) & (two > 0)
    triples = pairs & (three > 0)
    if 3 * bits > 63:
        rows = [(one > 0, (1, 0, 0)), (pairs, (1, 1, 0)), (triples, (1, 1, 1))]
        at = np.concatenate([np.column_stack([one * x, two * y, three * z])[kept] for kept, (x, y, z) in rows])
        whole = collected(words, at, np.ones(len(at), np.int64))
        for start in range(0, len(whole), size):
            yield whole.part(start, start + size)
        return
    keys = one << 2 * bits
    parts = [keys[one > 0]]
    keys |= two << bits
    parts.append(keys[pairs])
    keys |= three
    parts.append(keys[triples])
    keys = np.concatenate(parts)
    del parts, pairs, triples, padded, one, two, three
    keys.sort()
    new = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    mask = (1 << bits) - 1
    for start in range(0, len(keys), size):
        own = keys[start : start + size]
        at = np.column_stack([own >> 2 * bits, own >> bits & mask, own & mask])
        yield Grams(words, at, counts[start : start + size]).part(0, size)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the slices that begin at ``start``."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class _Register(dict):
    """Numbers of states by their arcs, and the arcs in order of the numbers.

    Unless ``shared``, each state is new, as in a tree.
    """

    def __init__(self, shared: bool):
        self.shared, self.tally = shared, 1
        self[b""] = END
        self.sizes: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def __missing__(self, arcs: bytes | tuple) -> int:
        self[arcs] = number = len(self)
        return number

    def add(
        self, symbol: np.ndarray, weight: np.ndarray, target: np.ndarray, ends: np.ndarray, root: bool = False
    ) -> np.ndarray:
        """The numbers of states whose arcs end at ``ends``, one after the other."""
        size = np.diff(ends, prepend=0)
        first = ends - size
        if not self.shared:
            own = (size > 0) | root
            numbers = np.where(own, self.tally + np.cumsum(own) - 1, END)
            self.tally += int(own.sum())
            self.sizes.append(size[own])
            self.arcs.append((symbol, weight, target))
            return numbers
        arcs = np.empty(len(symbol), [("s", "<i4"), ("t", "<i4"), ("w", "<i8")])
        arcs["s"], arcs["t"], arcs["w"] = symbol, target, weight
        data = arcs.tobytes()
        before = len(self)
        cuts = zip((16 * first).tolist(), (16 * ends).tolist(), strict=True)
        if root:
            self[None] = before
            numbers = np.array([before])
        else:
            numbers = np.fromiter(map(self.__getitem__, (data[i:j] for i, j in cuts)), np.int64, len(ends))
        # new numbers rise, so the first state that got one is where the numbers pass all before
        most = np.maximum.accumulate(np.append(before - 1, numbers))
        new = np.flatnonzero(most[1:] > most[:-1])
        own = _spread(first[new], size[new])
        self.sizes.append(size[new])
        self.arcs.append((symbol[own], weight[own], target[own]))
        return numbers

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts = np.append(0, np.cumsum(np.concatenate(self.sizes)))
        return starts, *(np.concatenate(x) for x in zip(*self.arcs, strict=True))


@dataclass
class CountAutomaton:
    """State ``s`` has the arcs from ``starts[s]`` up to ``starts[s + 1]``, sorted by symbol."""

    words: list[bytes]
    starts: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @property
    def root(self) -> int:
        return len(self.starts) - 2

    @staticmethod
    def build(grams: Grams, shared: bool = True) -> CountAutomaton:
        """Read sorted n-grams in order.  A state that the next n-gram no longer passes
        through is looked up by its arcs, or added: first those after two words, then
        those after one, then the root.  Without ``shared`` it is a tree, made sooner."""
        at, weight = grams.at, grams.weight.astype("<i8")
        length = (at > 0).sum(axis=1)
        change = np.ones((len(at), 2), bool)
        change[1:, 0] = at[1:, 0] != at[:-1, 0]
        change[1:, 1] = change[1:, 0] | (at[1:, 1] != at[:-1, 1])
        leaf = np.flatnonzero(length == 3)
        pair = np.flatnonzero(change[:, 1] & (length > 1))
        head = np.flatnonzero(change[:, 0])
        states = _Register(shared)
        # a path that only begins others has no weight of its own
        ends = np.searchsorted(leaf, np.append(pair[1:], len(at)))[: len(pair)]
        after_two = states.add(at[leaf, 2], weight[leaf], np.zeros(len(leaf), "<i4"), ends)
        own = np.where(length[pair] == 2, weight[pair], 0)
        ends = np.searchsorted(pair, np.append(head[1:], len(at)))[: len(head)]
        after_one = states.add(at[pair, 1], own, after_two, ends)
        own = np.where(length[head] == 1, weight[head], 0)
        states.add(at[head, 0], own, after_one, np.array([len(head)]), root=True)
        return CountAutomaton(grams.words, *states.arrays())

    def grams(self) -> Grams:
        """All n-grams with a weight."""
        states, prefix = np.array([self.root]), np.zeros((1, ORDER), np.int32)
        found, weights = [], []
        for depth in range(ORDER):
            size = self.starts[states + 1] - self.starts[states]
            arcs = _spread(self.starts[states], size)
            prefix = np.repeat(prefix, size, axis=0)
            prefix[:, depth] = self.symbol[arcs]
            found.append(prefix)
            weights.append(self.weight[arcs])
            states = self.target[arcs]
        at, weight = np.concatenate(found), np.concatenate(weights)
        kept = np.flatnonzero(weight > 0)
        kept = kept[np.argsort(keys_of(at[kept], len(self.words)), kind="stable")]
        return Grams(self.words, at[kept], weight[kept])

    def compose(self, counts: CountAutomaton) -> Iterator[tuple[Phrase, int, int]]:
        """The phrases that both hold, with both weights, by walking both at once."""
        index = {w: i for i, w in enumerate(counts.words, 1)}
        same = np.array([0, *[index.get(w, 0) for w in self.words]], np.int64)
        of_arc = np.repeat(np.arange(len(counts.starts) - 1), np.diff(counts.starts))
        arc_keys = of_arc << 32 | counts.symbol
        mine, other = np.array([self.root]), np.array([counts.root])
        prefix = np.zeros((1, ORDER), np.int64)
        for depth in range(ORDER):
            size = self.starts[mine + 1] - self.starts[mine]
            arcs = _spread(self.starts[mine], size)
            wanted = np.repeat(other, size).astype(np.int64) << 32 | same[self.symbol[arcs]]
            place = np.minimum(np.searchsorted(arc_keys, wanted), max(len(arc_keys) - 1, 0))
            hit = np.flatnonzero(arc_keys[place] == wanted) if len(arc_keys) else place[:0]
            prefix = np.repeat(prefix, size, axis=0)[hit]
            arcs, place = arcs[hit], place[hit]
            prefix[:, depth] = self.symbol[arcs]
            weights = self.weight[arcs], counts.weight[place]
            for i in np.flatnonzero((weights[0] > 0) & (weights[1] > 0)).tolist():
                phrase = tuple(self.words[w - 1] for w in prefix[i].tolist() if w)
                yield phrase, int(weights[0][i]), int(weights[1][i])
            mine, other = self.target[arcs], counts.target[place]

    def to_bytes(self) -> bytes:
        words = b" ".join(self.words)
        size = np.diff(self.starts)
        parts = [size.astype("<u4"), self.symbol.astype("<u4"), self.target.astype("<u4")]
        wide = "<u4" if not len(self.weight) or self.weight.max() < 1 << 32 else "<u8"
        parts.append(self.weight.astype(wide))
        head = struct.pack("<QQQB", len(words), len(size), len(self.symbol), parts[-1].itemsize)
        return zstandard.compress(b"".join([head, words, *[p.tobytes() for p in parts]]), 3)

    @staticmethod
    def from_bytes(data: bytes) -> CountAutomaton:
        data = zstandard.decompress(data)
        n_bytes, n_states, n_arcs, wide = struct.unpack_from("<QQQB", data)
        start = struct.calcsize("<QQQB")
        words = data[start : start + n_bytes].split(b" ") if n_bytes else []
        start += n_bytes
        arrays = []
        for kind, n in (("<u4", n_states), ("<u4", n_arcs), ("<u4", n_arcs), (f"<u{wide}", n_arcs)):
            arrays.append(np.frombuffer(data, kind, n, start).astype(np.int64))
            start += arrays[-1].itemsize * n if kind == "<u8" else int(kind[2]) * n
        size, symbol, target, weight = arrays
        return CountAutomaton(words, np.append(0, np.cumsum(size)), symbol, weight, target)


def union(parts: Sequence[Grams]) -> Grams:
    """The n-grams of all parts; weights of equal ones are added."""
    if len(parts) == 1:
        return parts[0]
    words = sorted(set().union(*[p.words for p in parts]))
    index = {w: i for i, w in enumerate(words, 1)}
    places = [np.array([0, *[index[w] for w in p.words]], np.int32) for p in parts]
    at = np.concatenate([place[p.at] for place, p in zip(places, parts, strict=True)])
    return collected(words, at, np.concatenate([p.weight for p in parts]))
