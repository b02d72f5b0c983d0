"""Runs (maximal periodic stretches) of words by Crochemore's partition refinement (operator 12).

Positions of a text are classes of equal factors of one length, which grows by one word a level. Level m + 1 follows from
level m by splitting: positions whose successors fell into different children of one class part. Of the children of each
class the largest is left out (smaller half), so all levels together touch O(n log n) positions. Classes are stretches of one
array of positions and doubly linked lists in order of position; two neighbours of a class at a distance equal to the
level's length are a square with a primitive root, and squares of one period at consecutive positions are a run. The
texts of a block are refined together with array operations; each text ends with a mark of its own, so factors never cross
texts. Gaps that change are put down under their size and looked at when the level reaches it.

A run is reported if it has at least ``min_words`` words and ``min_periods`` periods, so levels beyond a text's number of words
divided by ``min_periods`` are not needed.

Defined results: a null text has no words; repeated rows and equal or null ids each give a row; further columns of the
input are ignored; words are the stretches without the ASCII blanks 0x20 and 0x09-0x0D. Memory is linear in a block
(``BLOCK`` words or the longest text); there is no shuffle, and a lost task is run again by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import ship

BLOCK = 400_000


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Classes:
    """Positions by class; ``first`` are the classes of length 1, as numbers from 0."""

    def __init__(self, first: np.ndarray):
        n = len(first)
        self.of = first.astype(np.int64)
        self.perm = np.argsort(self.of, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.perm] = np.arange(n)
        size = np.bincount(self.of)
        self.count = len(size)
        room = self.count + n + 1  # a split makes classes that are not empty, so 2n names are more than are alive at once
        self.size = np.zeros(room, np.int64)
        self.size[: self.count] = size
        self.begin = np.zeros(room, np.int64)
        self.begin[: self.count] = np.cumsum(size) - size
        self.next, self.prev = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        a, b = self.perm[:-1], self.perm[1:]
        same = self.of[a] == self.of[b]
        self.next[a[same]], self.prev[b[same]] = b[same], a[same]

    def _names(self, k: int) -> np.ndarray:
        if self.count + k > len(self.size):
            more = max(k, len(self.size))
            self.size, self.begin = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.size, self.begin))
        self.count += k
        return np.arange(self.count - k, self.count)

    def split(self, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Part the predecessors of small from their classes; the next level's small positions, and positions with a new ``next``."""
        none = np.zeros(0, np.int64)
        at = small[small > 0] - 1
        at = at[self.size[self.of[at]] > 1]
        if not len(at):
            return none, none
        parent, after = self.of[at], self.of[at + 1]
        order = np.lexsort((at, after, parent))
        at, parent, after = at[order], parent[order], after[order]
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (parent[1:] != parent[:-1]) | (after[1:] != after[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        split = size < self.size[parent[start]]
        if not split.all():  # classes that go on as they are
            keep = np.repeat(split, size)
            at, parent = at[keep], parent[keep]
            size = size[split]
            if not len(at):
                return none, none
            start = np.cumsum(size) - size
        # the linked lists: those that go are taken out in stretches that follow each other in their list
        asc = np.lexsort((at, parent))
        u = at[asc]
        joined = np.zeros(len(u), bool)
        joined[1:] = self.prev[u[1:]] == u[:-1]
        head = np.flatnonzero(~joined)
        tail = np.append(head[1:], len(u)) - 1
        before, behind = self.prev[u[head]], self.next[u[tail]]
        self.next[before[before >= 0]] = behind[before >= 0]
        self.prev[behind[behind >= 0]] = before[behind >= 0]
        changed = before[before >= 0]
        self.prev[at[1:]], self.next[at[:-1]] = at[:-1], at[1:]
        self.prev[at[start]], self.next[at[start + size - 1]] = -1, -1
        # the stretches of the array: those that go move to the end of their class's stretch, group by group
        lead = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        classes, gone = parent[lead], np.diff(np.append(lead, len(parent)))
        target = _spread(self.begin[classes] + self.size[classes] - gone, gone)
        came = self.place[at]
        holders = self.perm[target]
        mark = self._mark(len(self.of))
        mark[at] = True
        stay = holders[~mark[holders]]
        mark[at] = False
        bound = np.repeat(self.begin[classes] + self.size[classes] - gone, gone)
        free = came[came < bound]
        # both are in order of class, and as many in each class
        self.perm[free], self.place[stay] = stay, free
        self.perm[target], self.place[at] = at, target
        names = self._names(len(size))
        self.of[at] = np.repeat(names, size)
        self.size[names], self.begin[names] = size, target[start]
        self.size[classes] -= gone
        # smaller half: of all children of a class but the largest, the positions are the next level's
        owner = np.repeat(np.arange(len(classes)), np.diff(np.append(np.searchsorted(start, lead), len(start))))
        most = np.maximum.reduceat(size, np.searchsorted(start, lead))
        rest = self.size[classes]
        largest = np.zeros(len(size), bool)
        big = np.flatnonzero((size == most[owner]) & (most[owner] > rest[owner]))
        largest[big[np.unique(owner[big], return_index=True)[1]]] = True
        small_rest = (rest > 0) & (most > rest)
        out = [at[np.repeat(~largest, size)], self.perm[_spread(self.begin[classes[small_rest]], rest[small_rest])]]
        last = np.zeros(len(at), bool)
        last[start + size - 1] = True
        return np.concatenate(out), np.concatenate([changed, at[~last]])

    def _mark(self, n: int) -> np.ndarray:
        if not hasattr(self, "_marks"):
            self._marks = np.zeros(n, bool)
        return self._marks


def find_runs(words: np.ndarray, sizes: np.ndarray, min_words: int = 6, min_periods: int = 4) -> tuple[np.ndarray, ...]:
    """text, start, length, period of every run, in order of text, start and period.

    words: numbers of the words of all texts, one after the other, equal in one text exactly for equal words; sizes: words of each text.
    """
    sizes = np.asarray(sizes, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    end = np.cumsum(sizes + 1) - 1
    n = len(text)
    out: list[tuple[np.ndarray, ...]] = []
    if n > len(sizes):
        longest = sizes // min_periods
        solid = np.ones(n, bool)
        solid[end] = False
        first = np.empty(n, np.int64)
        pairs = text[solid] * (int(words.max()) + 1) + words
        first[solid] = np.unique(pairs, return_inverse=True)[1]
        first[end] = n + np.arange(len(end))  # no text's mark is equal to another's
        first = np.unique(first, return_inverse=True)[1]
        state, most = _Classes(first), longest[text]
        due: dict[int, list[np.ndarray]] = {}

        def put_down(changed: np.ndarray, level: int) -> None:
            """Under its gap, each changed position whose next is at least level words and no more than the longest period away."""
            changed = changed[state.next[changed] >= 0]
            gap = state.next[changed] - changed
            kept = (gap >= level) & (gap <= most[changed])
            changed, gap = changed[kept], gap[kept]
            if len(gap):
                order = np.argsort(gap, kind="stable")
                changed, gap = changed[order], gap[order]
                cuts = np.flatnonzero(gap[1:] != gap[:-1]) + 1
                for g, part in zip(gap[np.append(0, cuts)].tolist(), np.split(changed, cuts), strict=True):
                    due.setdefault(g, []).append(part)

        small, level, last = np.arange(n), 1, int(longest.max())
        put_down(small, 1)
        while level <= last:
            if found := due.pop(level, None):
                at = np.unique(np.concatenate(found)) if len(found) > 1 else np.sort(found[0])
                at = at[state.next[at] - at == level]
                if len(at):
                    head = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (text[at[1:]] != text[at[:-1]])))
                    length = np.diff(np.append(head, len(at))) - 1 + 2 * level
                    good = length >= max(min_words, min_periods * level)
                    head = at[head[good]]
                    if len(head):
                        out.append((text[head], head - (end[text[head]] - sizes[text[head]]), length[good], np.full(len(head), level)))
            if not len(small) and not due:
                break
            level += 1
            small, changed = state.split(small[most[small] >= level - 1] if len(small) else small)
            put_down(changed, level)
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    found = tuple(np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((found[3], found[1], found[0]))
    return tuple(x[order] for x in found)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of each text (from 0 in every text), and how many words each has."""
    flat: list[int] = []
    for words in texts:
        known: dict[bytes, int] = {}
        flat += [known.setdefault(w, len(known)) for w in words]
    return np.array(flat, np.int64), np.fromiter(map(len, texts), np.int64, len(texts))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 6, min_periods: int = 4) -> DataFrame:
    """id_col, runs (array of start, length, period in words, by start and period), collapsed (the words that no run holds after its first period, one space between)."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = src.schema[0].dataType.simpleString()
    spans = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def solve(ids: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
        words, sizes = numbered(texts)
        text, start, length, period = find_runs(words, sizes, min_words, min_periods)
        bounds = np.searchsorted(text, np.arange(len(sizes) + 1))
        begin = np.cumsum(sizes) - sizes
        gone = np.zeros(len(words) + 1, np.int32)
        np.add.at(gone, begin[text] + start + period, 1)
        np.add.at(gone, begin[text] + start + length, -1)
        gone = np.cumsum(gone) > 0
        joined = []
        for i, own in enumerate(texts):
            if bounds[i + 1] > bounds[i]:
                own = [own[k] for k in np.flatnonzero(~gone[begin[i] : begin[i] + sizes[i]]).tolist()]
            joined.append(b" ".join(own).decode("utf-8", "replace"))
        rows = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(period, pa.int64())], fields=list(spans))
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows), pa.array(joined, pa.string())], [id_col, "runs", "collapsed"])

    def run(batches):
        ids, held, size = [], [], 0
        for batch in batches:
            at = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                held.append(words)
                size += len(words) + 1
                if size >= BLOCK:
                    ids.append(batch.column(0)[at : i + 1])
                    yield solve(ids, held)
                    ids, held, size, at = [], [], 0, i + 1
            if at < batch.num_rows:
                ids.append(batch.column(0)[at:])
        if held:
            yield solve(ids, held)

    return src.mapInArrow(run, f"`{id_col}` {id_type}, runs array<struct<start:long,length:long,period:long>>, collapsed string")
