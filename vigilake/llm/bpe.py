"""Byte-level BPE encoding and decoding (operator 1).

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves; the
others are merged by a heap of neighbouring pairs over a linked list of bytes. Pieces that a process has
met already come from a bounded cache in front of both. Encoding is a pure map over documents (no
shuffle), so it scales with the number of input splits and a lost task is simply run again.

Defined results: a null text counts as empty; an empty text has no ids; repeated rows and rows with equal
or null doc_id each give a row; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from vigilake.llm import pieces as P
from vigilake.session import ship


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys, n slots, one displacement for each small bucket.

    A key's bucket and a seed come from one 128-bit hash; its slot is a mix of that seed and the bucket's
    displacement, mod n. Buckets are placed from the largest to the smallest. Foreign keys are told
    apart by comparing with the key stored in the slot.
    """

    def __init__(self, keys: Sequence[bytes], values: Sequence[int], load: int = 2):
        self.n, self.buckets = len(keys), max(1, len(keys) // load)
        by: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            bucket, seed = self._parts(key)
            by[bucket].append((seed, i))
        self.shift, self.slots = [0] * self.buckets, [-1] * self.n
        free = 0
        for bucket in sorted(range(self.buckets), key=lambda x: -len(by[x])):
            members = by[bucket]
            if not members:
                break
            if len(members) == 1:  # any free slot will do: solve for it directly
                while self.slots[free] >= 0:
                    free += 1
                self.slots[free], self.shift[bucket] = members[0][1], -free - 1
                continue
            d = 0
            while True:
                at = [self._slot(seed, d) for seed, _ in members]
                if len({*at}) == len(at) and all(self.slots[x] < 0 for x in at):
                    break
                d += 1
            self.shift[bucket] = d
            for x, (_, i) in zip(at, members, strict=True):
                self.slots[x] = i
        self.keys = [keys[i] for i in self.slots]
        self.values = [values[i] for i in self.slots]

    def _parts(self, key: bytes) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h >> 64) % self.buckets, h & 0xFFFFFFFFFFFFFFFF

    def _slot(self, seed: int, d: int) -> int:
        x = (seed + d * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF
        return (x >> 24) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        bucket, seed = self._parts(key)
        d = self.shift[bucket]
        slot = -d - 1 if d < 0 else self._slot(seed, d)
        return self.values[slot] if self.keys[slot] == key else -1


_END = 1 << 24  # stands for "no token"; no pair has it


def merge_linked(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge neighbours, lowest rank and then leftmost first. pairs: left << 32 | right -> merged id, which is its rank.

    Nodes are linked by position; one more node at the end stands before the first as well as after the last.
    """
    n, look, push, pop = len(ids), pairs.get, heapq.heappush, heapq.heappop
    heap = [r << 32 | i for i in range(n - 1) if (r := look(ids[i] << 32 | ids[i + 1])) is not None]
    if not heap:
        return ids
    heapq.heapify(heap)
    ids.append(_END)
    after, before = [*range(1, n + 2)], [*range(-1, n + 1)]
    while heap:
        top = pop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        j = after[i]
        if look(ids[i] << 32 | ids[j]) != r:
            continue  # one of the two has been merged meanwhile
        ids[i], ids[j] = r, _END
        k = after[i] = after[j]
        p, before[k] = before[i], i
        if (x := look(r << 32 | ids[k])) is not None:
            push(heap, x << 32 | i)
        if (x := look(ids[p] << 32 | r)) is not None:
            push(heap, x << 32 | p)
    return [x for x in ids if x != _END]


class ByteBPE:
    """Encoder and decoder for a file of ranks (base64 token, space, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.single = [self.ranks.get(bytes([i]), -1) for i in range(256)]
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        get = self.ranks.get
        self.pairs = {a << 32 | b: r for t, r in self.ranks.items() for i in range(1, len(t)) if (a := get(t[:i], -1)) >= 0 and (b := get(t[i:], -1)) >= 0}
        top = max(self.tokens) + 1
        self.bytes_of = [self.tokens.get(i, b"") for i in range(top)]
        self.spelled = P.Pool([b"%d " % i for i in range(top)])
        self.raw = P.Pool(self.bytes_of)
        self.cache = P.PieceCache(self._resolve)

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.whole.get(piece)) >= 0:
            return [whole]
        return merge_linked([self.single[x] for x in piece], self.pairs)

    def _resolve(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_piece(x.encode("utf-8", "replace")) for x in texts]

    def encode_batch(self, texts: Sequence[str]) -> Iterator[np.ndarray]:
        """Ids of each text, in order."""
        for a, b in P.chunks(texts):
            cp, off = P.codepoints(texts[a:b])
            starts, ends = P.gpt_pieces(cp, off)
            at, size = self.cache.look_up(cp, starts, ends)
            ids = self.cache.ids(at, size)
            cuts = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.searchsorted(starts, off)]
            for i in range(b - a):
                yield ids[cuts[i] : cuts[i + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.raw.join(ids).tobytes()

    def spell(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        return self.spelled.join(ids)[:-1].tobytes()


_coders: dict[str, ByteBPE] = {}


def coder(path: str) -> ByteBPE:
    """The process's coder for a rank file; built once in each worker, so nothing is broadcast."""
    if path not in _coders:
        _coders[path] = ByteBPE(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>: the ids of each whole text. path: the rank file, at the same place on all machines."""

    def run(batches):
        own = coder(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = [x.astype(np.int32) for x in own.encode_batch(texts)]
            off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, pa.array(flat))], [id_col, "ids"])

    ship(docs.sparkSession)
    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, ids array<int>")


def digest_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest each text in one pass, so that ids don't leave the worker.

    Columns: id_col, n_tokens, ids_sha256 (of decimal ids joined by a space), decoded_sha256.
    """

    def run(batches):
        own = coder(path)
        for batch in batches:
            counts, encoded, decoded = [], [], []
            for ids in own.encode_batch([x or "" for x in batch.column(1).to_pylist()]):
                counts.append(len(ids))
                encoded.append(hashlib.sha256(own.spell(ids)).hexdigest())
                decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    ship(docs.sparkSession)
    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
