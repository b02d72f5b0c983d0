"""Packing documents into sequences by order-preserving dynamic programming (operator 3).

Documents keep their order within an input split. Window cuts lie at document ends, sentence ends, or, inside
very long sentences, at fixed steps. The plan minimises padding plus penalties for cuts inside documents and
sentences: with best[j] the least cost of everything before cut j, a padded window (i, j] costs
best[i] + capacity - (j - i) + penalty(j), so the best i of all cuts within one capacity is the least
best[i] + i, kept by a monotone queue; windows whose length is a power of two need no padding and are tried
besides. A split is planned in blocks of ``HORIZON`` tokens; the last window of a block is left open and
planned again with the next block, so memory is bounded (by a block, or the longest text) and no padding
arises between blocks. The last tokens of a split are cut at powers of two.

It is a pure map (no shuffle): sequence ids are made from the split's number and a counter.

Defined results: a null text counts as empty, and an empty text still has its end id, so each row has at least
one piece; repeated rows and equal or null doc_id are packed as they come; further columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import pieces as P
from vigilake.session import ship

HORIZON = 1 << 19
SENTENCE, INSIDE, STEP = 8.0, 64.0, 512  # at a capacity of SCALE: penalties in tokens of padding; tokens between cuts in long sentences
SCALE = 4096


class WordCoder:
    """Ids of texts by a tokenizer file with lower-casing word BPE; each distinct word is encoded by the library once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.sign = os.path.commonprefix(self.special)  # a text without it has no special string
        self.cache = P.PieceCache(lambda words: [x.ids for x in self.library.encode_batch_fast(words, add_special_tokens=False)])
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?") and token.endswith("</w>")

    @staticmethod
    def normal(text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # no final sigma: characters are lower-cased one by one

    def encode_batch(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        for a, b in P.chunks(texts):
            own = [self.normal(x) for x in texts[a:b]]
            odd = {i for i in range(b - a) if self.sign in texts[a + i] and any(x in texts[a + i] for x in self.special)}
            cp, off = P.codepoints(["" if i in odd else x for i, x in enumerate(own)])
            starts, ends = P.word_pieces(cp, off)
            at, size = self.cache.look_up(cp, starts, ends)
            ids = self.cache.ids(at, size)
            cuts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.searchsorted(starts, off)]
            for i in range(b - a):
                yield np.array(self.library.encode(texts[a + i], add_special_tokens=False).ids, np.uint32) if i in odd else ids[cuts[i] : cuts[i + 1]]


_coders: dict[str, WordCoder] = {}


def word_coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def plan(cuts: list[int], penalty: list[float], capacity: int, closed: bool) -> list[int]:
    """The chosen cuts (the first is 0, the last the end of the last window).

    cuts: increasing, from 0, at most capacity apart. closed: the last cut is an end that must be met;
    otherwise the plan stops at the cheapest cut of the last capacity.
    """
    n, scale = len(cuts), capacity / SCALE
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # (best[i] + cut, i), increasing
    sizes = [1 << k for k in range(capacity.bit_length()) if 1 << k < capacity]
    where = {x: i for i, x in enumerate(cuts)}
    for j in range(1, n):
        at = cuts[j]
        while cuts[queue[0][1]] < at - capacity:
            queue.popleft()
        key, i = queue[0]
        cost = key + capacity - at
        for size in sizes:
            k = where.get(at - size, -1)
            if k >= 0 and best[k] + SHORT[size] * scale < cost:
                cost, i = best[k] + SHORT[size] * scale, k
        best[j], back[j] = cost + penalty[j], i
        key = best[j] + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if not closed:
        first = bisect.bisect_left(cuts, cuts[-1] - capacity)
        j = min(range(first, n), key=lambda x: best[x] - 1e-9 * cuts[x])
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return [cuts[x] for x in reversed(out)]


#: A short sequence has no padding but costs a sequence of its own: the shorter it is, the more.
SHORT = {1 << k: max(0.0, 6.0 * (13 - k)) for k in range(31)}


def candidates(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray, capacity: int, final: bool) -> tuple[list[int], list[float]]:
    """Cuts and their penalties in a run of documents. doc_ends: positions after each document's last id."""
    marks = np.flatnonzero(sentence[ids]) + 1
    marks = marks[marks <= len(ids)]
    step = max(1, STEP * capacity // SCALE)
    at = np.unique(np.concatenate([[0], doc_ends, marks, [len(ids)]]))
    gaps = np.flatnonzero(np.diff(at) > step)
    at = np.unique(np.concatenate([at, *(np.arange(at[g] + step, at[g + 1], step) for g in gaps)]))
    if final:  # the tail may be cut anywhere at powers of two from its end
        tail, extra, end = len(ids) - int(at[max(0, np.searchsorted(at, len(ids) - capacity))]), [], len(ids)
        for k in range(capacity.bit_length()):
            if tail >> k & 1:
                end -= 1 << k
                extra.append(end)
        at = np.unique(np.concatenate([at, [x for x in extra if x > 0]])).astype(np.int64)
    cost = np.full(len(at), INSIDE * capacity / SCALE)
    cost[np.isin(at, marks)] = SENTENCE * capacity / SCALE
    cost[np.isin(at, doc_ends)] = 0.0
    cost[0] = 0.0
    return at.tolist(), cost.tolist()


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (array<int>)."""
    return _packed(docs, path, capacity, end_id, id_col, text_col, True)


def pack_digests(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As pack(), without the ids."""
    return _packed(docs, path, capacity, end_id, id_col, text_col, False)


def _packed(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))

    def run(batches):
        own = word_coder(path)
        held: list[np.ndarray] = []  # ids of the open documents, the first perhaps without its packed beginning
        names: list = []
        skip, size, serial, part = 0, 0, 0, 0

        def flush(final: bool):
            nonlocal held, names, skip, size, serial
            ids = np.concatenate([held[0][skip:], *held[1:]])
            lengths = np.array([len(x) for x in held])
            lengths[0] -= skip
            doc_ends = np.cumsum(lengths)
            at, cost = candidates(ids, doc_ends, own.ends, capacity, final)
            cuts = plan(at, cost, capacity, final)
            out = {k: [] for k in ("id", "start", "length", "crc", "tokens", "seq", "offset", "ids")}
            d = 0
            for a, b in zip(cuts, cuts[1:], strict=False):
                x = a
                while x < b:
                    while doc_ends[d] <= x:
                        d += 1
                    y = min(b, int(doc_ends[d]))
                    begin = int(doc_ends[d]) - int(lengths[d])
                    piece = ids[x:y].astype("<u4")
                    out["id"].append(names[d])
                    out["start"].append(x - begin + (skip if d == 0 else 0))
                    out["length"].append(y - x)
                    out["crc"].append(zlib.crc32(piece.tobytes()))
                    out["tokens"].append(len(held[d]))
                    out["seq"].append(part << 33 | serial)
                    out["offset"].append(x - a)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
                    x = y
                serial += 1
            done = cuts[-1]
            d = int(np.searchsorted(doc_ends, done, "right"))
            kept = done - (int(doc_ends[d - 1]) if d else 0)
            skip = kept + (skip if d == 0 else 0)
            held, names = held[d:], names[d:]
            size = len(ids) - done
            columns = [pa.array(out["id"], id_arrow), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "tokens", "seq", "offset"))]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, fields)

        fields = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        id_arrow = None
        for batch in batches:
            id_arrow = batch.column(0).type
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
            for name, ids in zip(batch.column(0).to_pylist(), own.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                held.append(np.append(ids, np.uint32(end_id)))
                names.append(name)
                size += len(ids) + 1
                if size >= max(HORIZON, 8 * capacity):
                    yield flush(False)
        if held:
            yield flush(True)

    kind = src.schema[0].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids)
