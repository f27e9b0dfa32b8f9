"""Byte-level BPE as finite-state transducers.

A tokenizer file compiles into two deterministic transducers.

* The **splitter** reads code points.  Eleven states know what the current piece is
  made of; a transition emits up to two marks, "a piece starts here" and "a piece
  started one place back" (runs of blanks and contractions are decided one place
  late).  Text is cut into chunks of equal length and all chunks are read at once: each
  chunk becomes a map from the state it is entered in to the state it is left in, a
  parallel prefix scan composes the maps, and a second pass emits the marks.
* The **piece transducer** has one transition per distinct piece, annotated with the
  token ids it emits, so with their count.  Transitions are compiled when a piece is
  first seen: the merges run over all new pieces of a batch at once, by rank.

Both hold a few batches of text at most.  A long text is cut where a blank follows a
non-blank, which starts a piece in every state.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

CHUNK = 512
BATCH_CHARS = 1 << 21
CACHE_ENTRIES = 1_500_000
LONG_PIECE = 400

# Symbols the splitter tells apart.
END, SPACE, BLANK, NUMBER, OTHER, QUOTE, LETTER, LETTER_STMD, LETTER_E, LETTER_RV, LETTER_L = range(11)
# States: what the piece being read is.
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, SPACE_1, BLANK_1, SPACE_N, BLANK_N, QUOTED, QUOTED_RV,
 QUOTED_L) = range(11)
HERE, BACK = 1, 2
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
# Code points that the split pattern's \s takes.
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
          0x202F, 0x205F, 0x3000)


@lru_cache(maxsize=1)
def symbol_table() -> np.ndarray:
    """The splitter's symbol for every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter(
        (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
    )
    table[list(BLANKS)] = BLANK
    table[ord(" ")], table[ord("'")] = SPACE, QUOTE
    for letters, symbol in (("stmd", LETTER_STMD), ("e", LETTER_E), ("rv", LETTER_RV), ("l", LETTER_L)):
        for letter in letters:
            table[ord(letter)] = symbol
    return table


def _step(state: int, symbol: int) -> tuple[int, int]:
    """Next state and marks of the splitter."""
    run = {NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}.get(symbol, IN_LETTERS)
    in_blanks = state in (SPACE_1, BLANK_1, SPACE_N, BLANK_N)
    half_quoted = state in (QUOTED_RV, QUOTED_L)
    if symbol == END:
        return START, HERE | (BACK if half_quoted else 0)
    if symbol in (SPACE, BLANK):
        if in_blanks:
            return (SPACE_N if symbol == SPACE else BLANK_N), 0
        return (SPACE_1 if symbol == SPACE else BLANK_1), HERE | (BACK if half_quoted else 0)
    if (state, symbol) in ((QUOTED_RV, LETTER_E), (QUOTED_L, LETTER_L), (QUOTED, LETTER_STMD)):
        return START, 0
    if state == QUOTED and symbol in (LETTER_RV, LETTER_L):
        return (QUOTED_RV if symbol == LETTER_RV else QUOTED_L), 0
    if half_quoted:  # the quote was a piece of its own, the letter after it began one
        state, late = IN_LETTERS, BACK
    elif state == QUOTED:
        state, late = IN_OTHERS, 0
    elif state in (SPACE_N, BLANK_N):
        late = BACK
    else:
        late = 0
    joins = state == run or state in (SPACE_1, SPACE_N)  # one space goes with what follows
    if symbol == QUOTE and not joins:
        return QUOTED, HERE | late
    return run, late if joins else HERE | late


@lru_cache(maxsize=1)
def splitter() -> np.ndarray:
    """Transitions by state and four symbols: next state, then two marks a symbol."""
    one = np.zeros((11, 11), np.int64)
    for state in range(11):
        for symbol in range(11):
            after, marks = _step(state, symbol)
            one[state, symbol] = after << 2 | marks
    state = np.arange(11)[:, None, None, None, None]
    marks = np.zeros_like(state)
    for axis in range(4):
        symbol = np.arange(11).reshape([11 if a == axis + 1 else 1 for a in range(5)])
        move = one[state, symbol]
        state, marks = move >> 2, marks << 2 | move & 3
    return (state << 8 | marks).astype(np.uint16).ravel()


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each place of a sequence of symbols."""
    size, moves, fours = len(symbols), splitter(), CHUNK // 4
    chunks = -(-size // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:size] = symbols
    quads = padded.reshape(-1, 4).astype(np.int32) @ np.array([1331, 121, 11, 1], np.int32)
    columns = np.ascontiguousarray(quads.reshape(chunks, fours).T)
    # each chunk as a map of states; most maps are constant after a few symbols
    maps = np.repeat(np.arange(11, dtype=np.int32)[None, :], chunks, axis=0)
    at = 0
    while at < fours and not (maps == maps[:, :1]).all():
        maps = (moves[maps * 14641 + columns[at][:, None]] >> 8).astype(np.int32)
        at += 1
    if at < fours:
        left = maps[:, 0].copy()
        for column in columns[at:]:
            left = (moves[left * 14641 + column] >> 8).astype(np.int32)
        maps = np.repeat(left[:, None], 11, axis=1)
    step = 1
    while step < chunks:  # prefix scan: each map after the one `step` before it
        maps = np.concatenate([maps[:step], np.take_along_axis(maps[step:], maps[:-step], 1)])
        step *= 2
    state = np.concatenate([[START], maps[:-1, START]]).astype(np.int32)
    marks = np.empty((fours, chunks), np.uint8)
    for at, column in enumerate(columns):
        move = moves[state * 14641 + column]
        marks[at], state = move & 255, (move >> 8).astype(np.int32)
    bits = np.unpackbits(np.ascontiguousarray(marks.T).ravel()).reshape(-1, 2)
    starts = bits[:, 1].astype(bool)  # HERE is the lower bit of each pair
    starts[:-1] |= bits[1:, 0].astype(bool)
    return starts[:size]


class PieceTransducer:
    """Token ids of pieces; transitions are compiled when first needed."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab = data["model"]["vocab"]
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        letter = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_ids = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.slots = self._hash(keys)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self._forget()

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(44)).astype(np.int64), (mixed >> np.uint64(20)).astype(
            np.int64
        ) & 0xFFFFF

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        """Each pair in one of its two places of a table; few, so one by one."""
        self.pair_keys = np.append(keys, -1)
        table = np.full(1 << 20, len(keys), np.int32)
        first, second = (p.tolist() for p in self._places(keys))
        for i in range(len(keys)):
            at, held = first[i], i
            for _ in range(500):
                table[at], held = held, int(table[at])
                if held == len(keys):
                    break
                at = second[held] if at == first[held] else first[held]
            else:
                raise ValueError("the pair table is too small")
        return table

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where there is none."""
        key = left << 32 | right
        first, second = self._places(key)
        a, b = self.slots[first], self.slots[second]
        none = len(self.pair_keys) - 1
        return np.where(self.pair_keys[a] == key, a, np.where(self.pair_keys[b] == key, b, none))

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """One long piece, by a heap of pairs."""
        tokens = self.byte_ids[np.frombuffer(piece, np.uint8)]
        after = list(range(1, len(tokens) + 1))
        before = list(range(-1, len(tokens) - 1))
        ranks = self._rank(tokens[:-1], tokens[1:])
        tokens, size, none = tokens.tolist(), len(tokens), len(self.pair_keys) - 1
        heap = [(int(r), i, tokens[i], tokens[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        rank_of = self._rank_map()
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else size
            if j >= size or tokens[j] != b:
                continue
            tokens[i], tokens[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < size:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < size and (r := rank_of.get((tokens[x] << 32) | tokens[y])) is not None:
                    heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
        return np.array([t for t in tokens if t >= 0], np.int64)

    @lru_cache(maxsize=1)  # noqa: B019 - one transducer lives as long as its worker
    def _rank_map(self) -> dict[int, int]:
        return {k: i for i, k in enumerate(self.pair_keys[:-1].tolist())}

    def _emitted(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each piece, and the tokens in the order of the pieces."""
        long = {i: self._merge_long(p) for i, p in enumerate(pieces) if len(p) > LONG_PIECE}
        if long:
            short = [i for i in range(len(pieces)) if i not in long]
            counts, tokens = self._emitted([pieces[i] for i in short])
            parts = dict(zip(short, np.split(tokens, np.cumsum(counts)[:-1]), strict=True)) if short else {}
            parts |= long
            every = [parts[i] for i in range(len(pieces))]
            return np.array([len(p) for p in every]), np.concatenate(every)
        if not pieces:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        tokens = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_tokens, done_owner, none = [], [], len(self.pair_keys) - 1
        rank = np.full(len(tokens), none)  # of each token with the next one of its piece
        same = np.flatnonzero(owner[:-1] == owner[1:])
        rank[same] = self._rank(tokens[same], tokens[same + 1])
        while len(tokens):
            heads = np.flatnonzero(np.concatenate([[True], owner[:-1] != owner[1:]]))
            sizes = np.diff(np.append(heads, len(tokens)))
            least = np.repeat(np.minimum.reduceat(rank, heads), sizes)
            open_ = least < none
            if not open_.all():
                done_tokens.append(tokens[~open_])
                done_owner.append(owner[~open_])
                tokens, owner, rank, least = tokens[open_], owner[open_], rank[open_], least[open_]
            hit = np.flatnonzero(rank == least)
            if not len(hit):
                break
            # of overlapping pairs take the first, third, ...
            first = np.concatenate([[True], np.diff(hit) > 1])
            run_start = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            tokens[hit] = self.merged[rank[hit]]
            keep = np.ones(len(tokens), bool)
            keep[hit + 1] = False
            rank[hit] = rank[hit + 1]  # whether the piece goes on is as for the token gone
            tokens, owner, rank = tokens[keep], owner[keep], rank[keep]
            new = hit - np.arange(len(hit))  # where the merged tokens are now
            for at in (new, new[new > 0] - 1):
                at = at[at + 1 < len(tokens)]
                at = at[owner[at] == owner[at + 1]]
                rank[at] = self._rank(tokens[at], tokens[at + 1])
        tokens, owner = np.concatenate(done_tokens), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(pieces)), tokens[order]

    def transitions(
        self, keys: np.ndarray, checks: np.ndarray, sample: Callable[[np.ndarray], list[bytes]]
    ) -> np.ndarray:
        """Slots of the transitions for ascending distinct piece keys.

        ``sample`` gives the pieces themselves for places in ``keys``; it is asked for
        those without a transition only.  A key that is held with another check belongs to
        another piece: such pieces are compiled one by one, and told apart by their bytes.
        """
        if len(self.known) > CACHE_ENTRIES:
            self._forget()
        at = np.searchsorted(self.known, keys)
        held = np.minimum(at, max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[held] != keys) if len(self.known) else np.arange(len(keys))
        if len(new):
            counts, tokens = self._emitted(sample(new))
            slots = len(self.counts) + np.arange(len(new))
            self.offsets = np.append(self.offsets, len(self.tokens) + np.cumsum(counts) - counts)
            self.counts = np.append(self.counts, counts)
            self.tokens = np.append(self.tokens, tokens.astype(np.uint32))
            self.known = np.insert(self.known, at[new], keys[new])
            self.slot = np.insert(self.slot, at[new], slots)
            self.checks = np.append(self.checks, checks[new])
            at = np.searchsorted(self.known, keys)
        slots = self.slot[at]
        odd = np.flatnonzero(self.checks[slots] != checks)
        if len(odd):
            slots[odd] = [self.clashing(piece) for piece in sample(odd)]
        return slots

    def clashing(self, piece: bytes) -> int:
        """The slot of a piece whose key is another piece's."""
        if piece not in self.clashes:
            counts, tokens = self._emitted([piece])
            self.clashes[piece] = len(self.counts)
            self.offsets = np.append(self.offsets, len(self.tokens))
            self.counts = np.append(self.counts, counts)
            self.tokens = np.append(self.tokens, tokens.astype(np.uint32))
            self.checks = np.append(self.checks, np.uint64(0))
        return self.clashes[piece]

    def _forget(self) -> None:
        self.known, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.clashes: dict[bytes, int] = {}
        self.slot, self.counts, self.offsets = (np.zeros(0, np.int64) for _ in range(3))
        self.tokens = np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    return PieceTransducer(path)


def _segments(text: str, special: dict[str, int]) -> Iterator[str | int]:
    """A text as ordinary stretches of bounded length and ids of special tokens."""
    for content, number in special.items():
        if content in text:
            for i, part in enumerate(text.split(content)):
                if i:
                    yield number
                yield from _segments(part, {k: v for k, v in special.items() if k != content})
            return
    start = 0
    while len(text) - start > BATCH_CHARS:
        cut = text.find(" ", start + BATCH_CHARS)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


@lru_cache(maxsize=1)
def _byte_symbols() -> bytes:
    return symbol_table()[:256].tobytes()


def _piece_keys(data: bytes, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of pieces, up to seven bytes as they are, longer ones mixed; and a check
    of 64 other bits for the longer ones."""
    padded = np.frombuffer(data + bytes(16), np.uint8)
    words = np.lib.stride_tricks.as_strided(
        padded[:8].view("<u8"), shape=(len(data) + 8,), strides=(1,), writeable=False
    )
    left = np.minimum(size, 8)
    key = words[at] & MASKS[left]
    short = size < 8
    key[short] |= size[short].astype(np.uint64) << np.uint64(56)
    rest, check = np.flatnonzero(~short), np.zeros(len(at), np.uint64)
    if len(rest):
        other = _mix(~key[rest])
        mixed, where, left = key[rest] ^ size[rest].astype(np.uint64), at[rest] + 8, size[rest] - 8
        mixed = _mix(mixed)
        while True:
            more = np.flatnonzero(left > 0)
            if not len(more):
                break
            part = words[where[more]] & MASKS[np.minimum(left[more], 8)]
            mixed[more] = _mix(mixed[more] * np.uint64(0xD6E8FEB86659FD93) ^ part)
            other[more] = _mix(other[more] * np.uint64(0xA0761D6478BD642F) + part)
            where, left = where + 8, left - 8
        key[rest], check[rest] = mixed | np.uint64(0xFF << 56), other
    return key, check


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _read(segments: list[str], fst: PieceTransducer) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all pieces, and how many pieces each segment has."""
    joined = "\n".join(segments) + "\n"
    data = joined.encode("utf-8")
    ends = np.cumsum(np.array([len(s) + 1 for s in segments])) - 1
    try:
        narrow = joined.encode("latin-1")
        symbols = np.frombuffer(bytearray(narrow.translate(_byte_symbols())), np.uint8)
        extra = np.frombuffer(narrow, np.uint8) > 0x7F
    except UnicodeEncodeError:
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols = symbol_table()[points]
        extra = (points > 0x7F).astype(np.uint8) + (points > 0x7FF) + (points > 0xFFFF)
    symbols[ends] = END
    starts = np.flatnonzero(piece_starts(symbols))
    markers = np.searchsorted(starts, ends)
    at = starts
    if len(data) > len(symbols):  # places in bytes
        more = np.cumsum(extra, dtype=np.int64)
        at = starts + more[starts] - extra[starts]
    size = np.diff(np.append(at, len(data)))
    keep = np.ones(len(at), bool)
    keep[markers] = False
    at, size = at[keep], size[keep]
    keys, checks = _piece_keys(data, at, size)
    keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)

    def sample(places: np.ndarray) -> list[bytes]:
        begin = at[first[places]]
        end = begin + size[first[places]]
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]

    slots = fst.transitions(keys, checks[first], sample)[inverse]
    for i in np.flatnonzero(checks[first][inverse] != checks).tolist():
        slots[i] = fst.clashing(data[at[i] : at[i] + size[i]])
    return slots, np.diff(np.concatenate([[-1], markers])) - 1


def _batches(
    texts: Sequence[str | None], fst: PieceTransducer
) -> Iterator[tuple[list[int], list[str], list[tuple[int, int]]]]:
    """Rows and segments in batches of bounded length, with special tokens between.

    A special token is told by the row and the number of segments of the batch before it.
    """
    rows: list[int] = []
    waiting: list[str] = []
    special: list[tuple[int, int]] = []
    chars = 0
    for row, text in enumerate(texts):
        for segment in _segments(text or "", fst.special):
            if isinstance(segment, int):
                special.append((len(waiting), segment))
                segment = ""
            rows.append(row)
            waiting.append(segment)
            chars += len(segment) + 1
            if chars > BATCH_CHARS:
                yield rows, waiting, special
                rows, waiting, special, chars = [], [], [], 0
    if waiting:
        yield rows, waiting, special


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def count_tokens(texts: Sequence[str | None], path: str) -> np.ndarray:
    """Number of tokens of each text; NULL counts as empty."""
    fst, out = transducer(path), np.zeros(len(texts), np.int64)
    for rows, segments, special in _batches(texts, fst):
        slots, pieces = _read(segments, fst)
        counts = _sums(fst.counts[slots], pieces)
        counts[[at for at, _ in special]] = 1
        np.add.at(out, rows, counts)
    return out


def encode_texts(texts: Sequence[str | None], path: str) -> list[np.ndarray]:
    """Token ids of each text as unsigned 32-bit numbers; NULL counts as empty."""
    fst = transducer(path)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, segments, special in _batches(texts, fst):
        slots, pieces = _read(segments, fst)
        counts, offsets = fst.counts[slots], fst.offsets[slots]
        ends = np.cumsum(counts)
        inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        ids = fst.tokens[np.repeat(offsets, counts) + inside]
        parts = np.split(ids, np.cumsum(_sums(counts, pieces))[:-1])
        for at, number in special:
            parts[at] = np.array([number], np.uint32)
        for row, part in zip(rows, parts, strict=True):
            found[row].append(part)
    return [p[0] if len(p) == 1 else np.concatenate(p) for p in found]
