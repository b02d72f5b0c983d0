"""Token counts without ids (operator 7).

Documents are cut into blocks. A block's distinct pre-tokens, each with the documents of the block that hold
it and how often, are packed into one row for each hash bucket; a bucket's rows meet in one task (each task has
one bucket), where every distinct pre-token is counted once (its pieces under BPE) and joined to the frequencies by
its bytes; the products are summed for each document of the block. Texts and ids are never shuffled. A pre-token
that many documents of a block hold is dealt to a bucket by pre-token and block together, so no word, however common,
gathers in one task; it is then counted once in each bucket at most.

Rows are sorted inside their input split before blocks are cut, so that a task that is run again makes the same
blocks in whatever order its input comes.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and equal or null doc_id each
give a row; further columns of the input are ignored. Special strings inside texts are single tokens, which is
the tokenizer library's default. Memory is linear in a block (``BLOCK`` characters or the longest text).
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import pieces as P
from vigilake.llm.bpe import PerfectHash, merge_linked
from vigilake.session import ship

BLOCK = 4 << 20
COMMON = 48  # documents of a block, from which a pre-token is dealt by block as well
KNOWN = 1_000_000  # pre-tokens whose counts a task remembers before it starts anew


class PieceCounter:
    """How many tokens a pre-token has, by the vocabulary and merges of a tokenizer file (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        rest = [b for b in range(256) if b not in set(keep)]
        byte_of = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda token: bytes(byte_of[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        plain = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.single = [plain[bytes([b])] for b in range(256)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        ids = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        if any(x[2] >= y[2] for x, y in zip(ids, ids[1:], strict=False)):
            raise ValueError("ids must grow with the rank of their merge")
        self.pairs = {a << 32 | b: c for a, b, c in ids}
        # whole pre-tokens that merge into one token; a token that its own merges don't reach isn't one
        whole = [t for t, i in plain.items() if merge_linked([self.single[x] for x in t], self.pairs) == [i]]
        self.whole = PerfectHash(whole, [1] * len(whole))
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def count(self, piece: bytes) -> int:
        return 1 if self.whole.get(piece) > 0 else len(merge_linked([self.single[x] for x in piece], self.pairs))


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def _pack(*arrays: np.ndarray) -> bytes:
    """Sizes, then the arrays' bytes, deflated."""
    return zlib.compress(b"".join([np.array([x.nbytes for x in arrays], np.int64).tobytes(), *(x.tobytes() for x in arrays)]), 1)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    data = zlib.decompress(blob)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(data, np.int64, len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _frequencies(texts: list[str], owner: np.ndarray, buckets: int, block: int) -> list[tuple[int, bytes]]:
    """(bucket, packed pre-tokens with their documents and frequencies) of one block. owner: document of each text."""
    number_of: dict[str, int] = {}
    cells, times = [], []
    for a, b in P.chunks(texts):
        cp, off = P.codepoints(texts[a:b])
        starts, ends = P.gpt_pieces(cp, off)
        number, first = P.distinct(cp, starts, ends)
        mine = np.fromiter((number_of.setdefault(x, len(number_of)) for x in P.piece_texts(cp, starts[first], ends[first])), np.int64, len(first))
        doc = owner[a:b][np.searchsorted(off, starts, "right") - 1]
        cell, n = np.unique(mine[number] << 32 | doc, return_counts=True)
        cells.append(cell)
        times.append(n)
    if not number_of:
        return []
    cell, n = np.concatenate(cells), np.concatenate(times)
    order = np.argsort(cell, kind="stable")
    piece, doc, freq = (cell[order] >> 32), (cell[order] & 0xFFFFFFFF).astype(np.int32), n[order].astype(np.int32)
    words = [x.encode("utf-8", "replace") for x in number_of]
    held = np.bincount(piece, minlength=len(words))
    first = np.cumsum(held) - held
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = np.where(held >= COMMON, (keys ^ np.uint64((block * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93), keys)
    to = ((mixed >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    out = []
    order = np.argsort(to, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
        own = [words[k] for k in part.tolist()]
        size = np.fromiter(map(len, own), np.int32, len(own))
        where = np.repeat(first[part] - (np.cumsum(held[part]) - held[part]), held[part]) + np.arange(int(held[part].sum()))
        out.append((int(to[part[0]]), _pack(size, np.frombuffer(b"".join(own), np.uint8), held[part].astype(np.int32), doc[where], freq[where])))
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row.

    path: a byte-level BPE tokenizer file, at the same place on all machines. buckets: by default the
    session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    src = src.sortWithinPartitions(F.xxhash64("id", "text"), "id")
    id_type = src.schema[0].dataType.simpleString()

    def cut(batches):
        """Rows (block, bucket, data); bucket -1 has the block's own documents: ids as Arrow data, bytes, special tokens."""
        own, held, size, seq = counter(path), [], 0, 0

        def emit(part):
            ids = pa.concat_arrays([x for x, _ in held])
            texts, special = [], np.zeros(len(ids), np.int64)
            for i, text in enumerate(x for _, rows in held for x in rows):
                if own.split and any(s in text for s in own.special):
                    found = own.split.split(text)
                    special[i] = len(found) // 2
                    text = None if special[i] else text
                    texts.append((i, found[::2]) if text is None else (i, [text]))
                else:
                    texts.append((i, [text]))
            flat = [(i, x) for i, xs in texts for x in xs]
            block = part << 32 | seq
            whole = [x for _, rows in held for x in rows]
            n_bytes = np.fromiter((len(x.encode("utf-8", "replace")) for x in whole), np.int64, len(whole))
            sink = pa.BufferOutputStream()
            batch = pa.RecordBatch.from_arrays([ids, pa.array(n_bytes), pa.array(special)], ["id", "n_bytes", "special"])
            with pa.ipc.new_stream(sink, batch.schema) as w:
                w.write_batch(batch)
            rows = [(block, -1, zlib.compress(sink.getvalue().to_pybytes(), 1))]
            # parts of a text cut at special strings count for the same document
            owner = np.fromiter((i for i, _ in flat), np.int64, len(flat))
            rows += [(block, bucket, data) for bucket, data in _frequencies([x for _, x in flat], owner, parts, block)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["block", "bucket", "data"])

        part = 0
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            if len(texts):
                part = batch.column(2)[0].as_py()
            at = 0
            for i, text in enumerate(texts):
                size += len(text) + 8
                if size >= BLOCK:
                    held.append((batch.column(0)[at : i + 1], texts[at : i + 1]))
                    yield emit(part)
                    held, size, seq, at = [], 0, seq + 1, i + 1
            if at < len(texts):
                held.append((batch.column(0)[at:], texts[at:]))
        if held:
            yield emit(part)

    def join(batches):
        """Rows (block, bucket, data): a block's documents as they are, or its sums from one bucket."""
        own, known = counter(path), {}
        for batch in batches:
            blocks, out = [], []
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket >= 0:
                    size, words, held, doc, k = _unpack(data, np.int32, np.uint8, np.int32, np.int32, np.int32)
                    ends, raw = np.cumsum(size), words.tobytes()
                    pieces = [raw[b - s : b] for b, s in zip(ends.tolist(), size.tolist(), strict=True)]
                    if len(known) > KNOWN:
                        known.clear()
                    for x in pieces:
                        if x not in known:
                            known[x] = own.count(x)
                    n = np.fromiter(map(known.__getitem__, pieces), np.float64, len(pieces))
                    total = np.bincount(doc, np.repeat(n, held) * k)
                    some = np.flatnonzero(total)
                    data = _pack(some.astype(np.int32), total[some].astype(np.int64))
                blocks.append(block)
                out.append((bucket, data))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["block", "bucket", "data"])

    def add(batches):
        now, own, total, late = None, None, None, []

        def finish():
            n = own.column(1).to_numpy() * 0 if total is None else total
            n = n + own.column(2).to_numpy()
            return pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(n, pa.int64()), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

        for batch in batches:
            for block, bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now and now is not None:
                    yield finish()
                if bucket < 0:
                    own = pa.ipc.open_stream(zlib.decompress(data)).read_next_batch()
                    now, total = block, np.zeros(own.num_rows, np.int64)
                else:
                    doc, n = _unpack(data, np.int32, np.int64)
                    total[doc] += n
        if now is not None:
            yield finish()

    schema = "block long, bucket int, data binary"
    cuts = src.mapInArrow(cut, schema)
    # a bucket is a task of its own; a block's own documents (bucket -1) aren't a bucket, they are dealt by block
    dealt = cuts.repartitionById(parts, F.when(F.col("bucket") < 0, F.pmod(F.hash("block"), F.lit(parts))).otherwise(F.col("bucket")))
    sums = dealt.mapInArrow(join, schema)
    return sums.repartition(parts, "block").sortWithinPartitions("block", "bucket").mapInArrow(add, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
