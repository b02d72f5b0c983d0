"""Vectorised splitting of texts into pre-tokens, and which of the pieces are equal.

The split patterns of byte-level BPE ("GPT" style) and of lower-cased word BPE ("word" style) only depend
on runs of four character classes, so the pieces of a whole batch of texts are found with a handful of
array operations instead of one regular-expression match per piece. Character classes are taken once per
process from the tokenizer library itself, so they always agree with it.

Memory is linear in a chunk (``CHUNK`` characters, or the longest single text).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator, Sequence

import numpy as np

CHUNK = 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@functools.lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point, as the tokenizer library's regular expressions see it."""
    from tokenizers import Regex, pre_tokenizers

    # the planes from 4 to 13 have no characters
    points = "".join(map(chr, (*range(0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xE0200))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"[\p{L}]+", LETTER), (r"[\p{N}]+", NUMBER), (r"[\s]+", SPACE)):
        split = pre_tokenizers.Split(Regex(pattern), behavior="removed", invert=True)
        found = "".join(piece for piece, _ in split.pre_tokenize_str(points))
        out[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return out


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    x = (np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, CHUNK + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
        _powers[:] = out
    return _powers[0], _powers[1]


def codepoints(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and where each text begins and the last ends."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def _run_starts(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cls, n = char_classes()[cp], len(cp)
    first = np.zeros(n + 1, bool)
    first[off] = True
    new = first.copy()
    new[0] = new[n] = True
    new[1:n] |= cls[1:] != cls[:-1]
    return cls, first, new


def _contractions(cp: np.ndarray, first: np.ndarray, new: np.ndarray) -> None:
    """'s 't 'm 'd 're 've 'll at the start of a piece are pieces of their own."""
    n = len(cp)
    q = np.flatnonzero(cp == 39)
    q = q[new[q]]
    q = q[q + 1 < n]
    q = q[~first[q + 1]]
    if not len(q):
        return
    one = cp[q + 1]
    two = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], cp[np.minimum(q + 2, n - 1)], 0)
    size = np.zeros(len(q), np.int64)
    size[np.isin(one, [115, 116, 109, 100])] = 1
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    q, size = q[size > 0], size[size > 0]
    new[q + 1] = False
    new[q + 1 + size] = True


def gpt_pieces(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the byte-level pattern (public_tokenizers.PATTERN)."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, first, new = _run_starts(cp, off)
    n = len(cp)
    after = np.flatnonzero(new[1:n] & (cls[:-1] == SPACE) & ~first[1:n]) + 1
    new[after - 1] = True
    new[after[cp[after - 1] == 32]] = False
    _contractions(cp, first, new)
    starts = np.flatnonzero(new[:n])
    return starts, np.append(starts[1:], n)


def word_pieces(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the matches of the word pattern: letter runs, single numbers, other runs; no spaces."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cls, first, new = _run_starts(cp, off)
    n = len(cp)
    new[:n] |= cls == NUMBER
    _contractions(cp, first, new)
    starts = np.flatnonzero(new[:n])
    ends = np.append(starts[1:], n)
    solid = cls[starts] != SPACE
    return starts[solid], ends[solid]


def blank_words(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words divided by the ASCII blanks 0x20 and 0x09-0x0D only."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(cp)
    solid = ~((cp == 32) | ((cp >= 9) & (cp <= 13)))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.zeros(n, bool)
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    follows = np.zeros(n, bool)
    follows[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~follows | edge[1:])) + 1
    return starts, ends


def fingerprints(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial fingerprints of cp[start:end]; equal pieces have equal ones wherever they stand, but so may others."""
    up, down = powers(len(cp) + 1)
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(_values()[cp] * up[: len(cp)], out=total[1:])
    out = (total[ends] - total[starts]) * down[starts]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def distinct(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each piece, and the place of the first piece of each number; equal pieces and no others share one.

    Fingerprints only propose groups: every piece is compared with the first of its group, code point by code point,
    and those that differ (fingerprints can collide) are told apart by their text.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(fingerprints(cp, starts, ends), return_index=True, return_inverse=True)
    lead, size = first[number], ends - starts
    odd = size != size[lead]
    place = np.flatnonzero((lead != np.arange(len(lead))) & ~odd)
    size = size[place]
    stop = np.cumsum(size)
    if len(stop) and stop[-1]:
        own = np.arange(stop[-1]) + np.repeat(starts[place] - (stop - size), size)
        wrong = np.flatnonzero(cp[own] != cp[own + np.repeat(starts[lead[place]] - starts[place], size)])
        odd[place[np.searchsorted(stop, wrong, "right")]] = True
    if odd.any():
        names, more = {}, []
        at = np.flatnonzero(odd)
        for k, text in zip(at.tolist(), piece_texts(cp, starts[at], ends[at]), strict=True):
            if (known := names.get(text)) is None:
                known = names[text] = len(first) + len(more)
                more.append(k)
            number[k] = known
        first = np.concatenate([first, np.array(more, np.int64)])
    return number, first


def piece_texts(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """The pieces as strings, decoded together."""
    size = ends - starts
    stop = np.cumsum(size)
    if not len(stop):
        return []
    where = np.arange(stop[-1]) + np.repeat(starts - (stop - size), size)
    text = cp[where].tobytes().decode("utf-32-le", "surrogatepass")
    return [text[a:b] for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]


def chunks(texts: Sequence[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit characters together; a longer text stands alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


class Pool:
    """Byte strings by number, joined without a step for each."""

    def __init__(self, strings: Sequence[bytes]):
        self.size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.at = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0, np.uint8)
        size = self.size[numbers]
        ends = np.cumsum(size)
        where = np.repeat(self.at[numbers] - (ends - size), size)
        where += np.arange(len(where))
        return self.data[where]


class PieceCache:
    """Piece -> token ids. When it is to hold more than ``most`` pieces, those that were not met again are dropped first.

    ``resolve`` turns a list of piece strings into lists of ids.
    """

    def __init__(self, resolve: Callable[[list[str]], list[Sequence[int]]], most: int = 600_000):
        self.resolve, self.most = resolve, most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.at, self.size, self.met = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 12, bool)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _shrink(self, room: int) -> None:
        """Drop pieces that were not met again; all of them where too many were."""
        kept = np.flatnonzero(self.met[: len(self.numbers)])
        if len(kept) + room > max(self.most, room) * 3 // 4:
            self.clear()
            return
        names, old = list(self.numbers), (self.at[kept], self.size[kept])
        flat = self.ids(*old)
        self.clear()
        self._store([names[i] for i in kept.tolist()], old[1], flat)

    def _add(self, pieces: list[str]) -> None:
        lists = self.resolve(pieces)
        size = np.fromiter(map(len, lists), np.int32, len(lists))
        self._store(pieces, size, np.fromiter((x for ids in lists for x in ids), np.uint32, int(size.sum())))

    def _store(self, pieces: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        n = len(self.numbers)
        while n + len(pieces) > len(self.at):
            self.at, self.size, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.met))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.at[n : n + len(pieces)] = self.used + np.cumsum(size, dtype=np.int64) - size
        self.size[n : n + len(pieces)] = size
        self.used += len(flat)
        self.numbers.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def look_up(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids lie in the pool, and how many they are."""
        number, first = distinct(cp, starts, ends)
        pieces = piece_texts(cp, starts[first], ends[first])
        if len(self.numbers) + len(pieces) > self.most:
            self._shrink(len(pieces))
        before = len(self.numbers)
        if new := [x for x in pieces if x not in self.numbers]:
            self._add(new)
        mine = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        self.met[mine[mine < before]] = True
        mine = mine[number]
        return self.at[mine], self.size[mine]

    def ids(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """All ids of the pieces, in order."""
        ends = np.cumsum(size, dtype=np.int64)
        if not len(ends):
            return np.zeros(0, np.uint32)
        where = np.arange(ends[-1], dtype=np.int64)
        where += np.repeat(at - (ends - size), size)
        return self.pool[where]
