"""Removal of byte strings that occur more than once, by sorting suffixes in sampled ranges (operator 13).

A suffix counts by its first ``length`` bytes (a string). Sorting all suffixes of all bytes would move many times the input,
so suffixes are sorted by successive keys and only those that stay tied go on:

* Texts are cut where the content says so (a position whose 8 bytes have the least hash of some ``REACH`` successive
  positions), so that equal strings have equal cuts but for ``REACH`` positions at their two ends. A cut stands for the strings
  whose first cut at least ``REACH`` bytes after their start it is.
* First sort, one suffix for each cut: its leading token (the bytes from the cut up to the last cut that all strings it stands
  for share), then the bytes of all strings it stands for together. Where the leading token occurs once, so do all
  strings of the cut; where both keys occur twice, all of them are repeated.
* Second sort, one suffix for each string that is still open: 128 bits of the hash of its bytes.

In both, splitters from a bounded sample part the keys into ranges, one range a task; a task sorts its range by the first
word and, within ties only, by the second (multikey), and compares neighbours. Keys with equal first words may lie in two
ranges; so a suffix whose first word is that of a splitter is taken as tied with it. Each block of texts sends a key once
however often it has it, so no key, however common, has more rows in a task than there are blocks, and keys with a common
leading token are spread over ranges by their second word.

Blocks of texts are written to the shared folder first, so all sorts see the same blocks, and a lost task is run again alone.
Strings are told apart by the 128-bit hashes of their bytes (in the first sort 64 bits for the leading token and 64 for
the whole).

Defined results: a null text is empty; texts shorter than ``length`` bytes have no strings; repeated rows are documents of their
own, so their strings are repeated; equal or null ids each give a row; further columns are ignored. Memory is linear in
a block (``BLOCK`` bytes or the longest text) and in a range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import settled, ship

BLOCK = 4 << 20
REACH, GRAM = 80, 8
CHUNK = 1 << 19
#: Blocks whose keys are sampled for splitters, and keys of each.
SAMPLE_BLOCKS, SAMPLE_KEYS = 512, 256


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _extreme(x: np.ndarray, width: int, which: np.ufunc) -> np.ndarray:
    """The extreme of each width successive values."""
    span = 1
    while 2 * span <= width:
        x = which(x[:-span], x[span:])
        span *= 2
    return which(x[: span - width], x[width - span :]) if span < width else x


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places whose GRAM bytes have the least hash of some REACH successive places (all of them where several are equal)."""
    if len(raw) < GRAM + REACH:
        return np.zeros(0, np.int64)
    grams = np.ndarray((len(raw) - GRAM + 1,), "<u8", raw, strides=(1,))
    h = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
    least = _extreme(h, REACH, np.minimum)
    edge = np.zeros(REACH - 1, np.uint32)
    greatest = _extreme(np.concatenate([edge, least, edge]), REACH, np.maximum)
    return np.flatnonzero(greatest == h)


def stands_for(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Cuts that stand for strings: first and last start of these strings, and the leading token's ends, for each.

    raw: the bytes of texts one after the other; ends: where each text ends. Every start of a string of length bytes within
    one text belongs to one cut.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    begins = np.append(0, ends[:-1])
    open_texts = ends - begins >= length
    if not open_texts.any():
        return none
    at = cuts(raw)
    core = length - GRAM - 3 * REACH
    stop = at[np.searchsorted(at, at + core, "right") - 1]
    low = np.append(-1, at[:-1]) - REACH + 1
    high = at - REACH
    low[0] = 0
    # a cut's starts may lie in several texts; each text's share is a row
    first, last = begins[open_texts], ends[open_texts] - length
    a, b = np.searchsorted(high, first), np.searchsorted(high, last)  # the cuts of a text's first and last start
    n = b - a + 1
    cut = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return np.maximum(low[cut], np.repeat(first, n)), np.minimum(high[cut], np.repeat(last, n)), at[cut], stop[cut]


def _pieces(texts: list[bytes]):
    """Texts in groups of about CHUNK bytes: first text, bytes, ends."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size >= CHUNK or i == len(texts) - 1:
            yield first, b"".join(held), np.cumsum(np.fromiter(map(len, held), np.int64, len(held)))
            held, size, first = [], 0, i + 1


def _texts(data: bytes) -> tuple[pa.Array, list[bytes]]:
    batch = _unpack(data)
    return batch.column(0), batch.column(1).to_pylist()


def cut_keys(texts: list[bytes], length: int) -> np.ndarray:
    """(leading token, whole) of every row that ``stands_for`` gives for the texts, in order."""
    out = [np.zeros((0, 2), np.uint64)]
    digest = xxhash.xxh3_64_intdigest
    for _, raw, ends in _pieces(texts):
        low, high, at, stop = (x.tolist() for x in stands_for(np.frombuffer(raw, np.uint8), ends, length))
        if low:
            keys = np.empty((len(low), 2), np.uint64)
            keys[:, 0] = np.fromiter((digest(raw[a:b]) for a, b in zip(at, stop, strict=True)), np.uint64, len(low))
            keys[:, 1] = np.fromiter((digest(raw[a : b + length]) for a, b in zip(low, high, strict=True)), np.uint64, len(low))
            out.append(keys)
    return np.concatenate(out)


def string_keys(texts: list[bytes], state: np.ndarray, length: int) -> np.ndarray:
    """128-bit keys of the strings of the cuts that take part in the second sort (see ``states_of``)."""
    out, seen = [np.zeros((0, 2), np.uint64)], 0
    digest = xxhash.xxh3_128_digest
    for _, raw, ends in _pieces(texts):
        low, high, _, _ = stands_for(np.frombuffer(raw, np.uint8), ends, length)
        mine = state[seen : seen + len(low)] & 1 > 0
        seen += len(low)
        found = b"".join(digest(raw[i : i + length]) for a, b in zip(low[mine].tolist(), high[mine].tolist(), strict=True) for i in range(a, b + 1))
        out.append(np.frombuffer(found, np.uint64).reshape(-1, 2))
    return np.concatenate(out)


def multikey_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of two words: by the first, and within its ties only by the second."""
    order = np.argsort(keys[:, 0], kind="stable")
    first = keys[order, 0]
    tied = np.zeros(len(first) + 1, bool)
    tied[1:-1] = first[1:] == first[:-1]
    rows = np.flatnonzero(tied[:-1] | tied[1:])
    if len(rows):
        group = np.cumsum(~tied[rows])
        order[rows] = order[rows][np.lexsort((keys[order[rows], 1], group))]
    return order


def states_of(keys: np.ndarray, many: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What comparing neighbours of the sorted rows tells: 2 if a row stands more than once, plus 1 if it takes part in the second sort.

    many: rows that stand for several; known: rows whose first word others may have too. A row takes part if its first word has
    other second words beside its own; of equal rows only the first does.
    """
    order = multikey_order(keys)
    a, b = keys[order, 0], keys[order, 1]
    new = np.ones(len(order), bool)
    new[1:] = a[1:] != a[:-1]
    fresh = new.copy()
    fresh[1:] |= b[1:] != b[:-1]
    group, pair = np.cumsum(new) - 1, np.cumsum(fresh) - 1
    repeated = (np.bincount(pair)[pair] > 1) | np.maximum.reduceat(many[order], np.flatnonzero(fresh))[pair] if len(order) else np.zeros(0, bool)
    varied = (np.bincount(group[fresh])[group] > 1) | known[order]
    out = np.zeros(len(order), np.uint8)
    out[order] = repeated * 2 + (varied & fresh)
    return out


def ranges(keys: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """The range of each key: how many splitters are not greater."""
    s, k = splitters[:, 0], keys[:, 0]
    a, b = np.searchsorted(s, k, "left"), np.searchsorted(s, k, "right")
    for word in np.unique(s[1:][s[1:] == s[:-1]]).tolist():  # a common first word has several splitters
        rows = np.flatnonzero(k == np.uint64(word))
        lo, hi = np.searchsorted(s, np.uint64(word), "left"), np.searchsorted(s, np.uint64(word), "right")
        a[rows] = lo + np.searchsorted(splitters[lo:hi, 1], keys[rows, 1], "right")
        b[rows] = a[rows]
    single = np.flatnonzero(b > a)
    a[single] += splitters[a[single], 1] <= keys[single, 1]
    return a


def _sort_round(spark, blocks: DataFrame, keys_of, splitters: np.ndarray, parts: int) -> DataFrame:
    """block, states: those of the block's distinct keys, in order (see ``states_of``)."""

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = keys_of(row)
                if not len(keys):
                    continue
                order = multikey_order(keys)
                fresh = np.ones(len(order), bool)
                fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
                number = np.cumsum(fresh) - 1
                single, many = keys[order[fresh]], np.bincount(number) > 1
                to = ranges(single, splitters)
                known = np.isin(single[:, 0], splitters[:, 0])
                cut = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                parts_of = list(zip(cut.tolist(), [*cut[1:].tolist(), len(to)], strict=True))
                flags = many.astype(np.uint8) * 2 + known
                own = [row["block"]] * len(cut), to[cut], [single[a:b].tobytes() for a, b in parts_of], [flags[a:b].tobytes() for a, b in parts_of]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(own, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["block", "range", "keys", "known"])

    def meet(batches):
        rows = [(b, r, np.frombuffer(k, np.uint64).reshape(-1, 2), np.frombuffer(n, np.uint8)) for batch in batches for b, r, k, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not rows:
            return
        rows.sort(key=lambda x: x[:2])  # whatever order they came in
        keys, known = np.concatenate([x[2] for x in rows]), np.concatenate([x[3] for x in rows])
        state, at = states_of(keys, known >= 2, known % 2 == 1), 0
        for b, r, k, _ in rows:
            part = state[at : at + len(k)]
            at += len(k)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([r], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "range", "states"])

    sent = blocks.mapInArrow(send, "block long, range int, keys binary, known binary")
    met = sent.repartitionById(parts, F.col("range")).mapInArrow(meet, "block long, range int, states binary")
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "states"))), lambda x: F.hex(x["states"])), ""))
    return settled(met.groupBy("block").agg(joined.alias("states")))


def _states(keys: np.ndarray, sent: bytes | None) -> np.ndarray:
    """What was found for each key, from the states of a block's distinct keys in order."""
    if not len(keys):
        return np.zeros(0, np.uint8)
    order = multikey_order(keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.frombuffer(sent, np.uint8)[np.cumsum(fresh) - 1]
    return out


def covered(texts: list[bytes], state: np.ndarray, open_state: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, starts and ends of the stretches that repeated strings cover. state: of the cuts; open_state: of the strings in the second sort."""
    out, seen, at = [], 0, 0
    for _, raw, ends in _pieces(texts):
        low, high, _, _ = stands_for(np.frombuffer(raw, np.uint8), ends, length)
        mine = state[seen : seen + len(low)]
        seen += len(low)
        change = np.zeros(len(raw) + 1, np.int32)
        np.add.at(change, low[mine >= 2], 1)
        np.add.at(change, high[mine >= 2] + length, -1)
        a, n = low[mine & 1 > 0], (high - low + 1)[mine & 1 > 0]
        total = int(n.sum())
        start = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)
        start = start[open_state[at : at + total] >= 2]
        at += total
        np.add.at(change, start, 1)
        np.add.at(change, start + length, -1)
        inside = np.cumsum(change[:-1]) > 0
        begin = 0
        for end in ends.tolist():
            own = np.zeros(end - begin + 2, np.int8)
            own[1:-1] = inside[begin:end]
            out.append(np.flatnonzero(np.diff(own)).reshape(-1, 2))
            begin = end
    return out


def repeated_strings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, spans (array of start, end in bytes: the maximal stretches covered by repeated strings), kept (the other bytes, together).

    length: at least 3 * REACH + GRAM + 1.
    """
    if length <= 3 * REACH + GRAM:
        raise ValueError(f"length must be over {3 * REACH + GRAM}")
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).alias("id"), F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8").alias("text"), F.spark_partition_id().alias("part"))
    id_type = src.schema[0].dataType.simpleString()

    def gather(batches):
        """Blocks of whole texts."""
        held, size, seq, part = [], 0, 0, 0

        def emit():
            batch = pa.RecordBatch.from_arrays([pa.concat_arrays(list(x)) for x in zip(*held, strict=True)], ["id", "text"])
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq], pa.int64()), pa.array([_pack(batch)], pa.binary())], ["block", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            part, at = batch.column(2)[0].as_py(), 0
            for i, n in enumerate(pa.compute.binary_length(batch.column(1)).to_pylist()):
                size += n + 8
                if size >= BLOCK:
                    held.append((batch.column(0)[at : i + 1], batch.column(1)[at : i + 1]))
                    yield emit()
                    held, size, seq, at = [], 0, seq + 1, i + 1
            if at < batch.num_rows:
                held.append((batch.column(0)[at:], batch.column(1)[at:]))
        if held:
            yield emit()

    blocks = settled(src.mapInArrow(gather, "block long, data binary"))

    def sample(batches):
        for batch in batches:
            for data in batch.column(1).to_pylist():
                keys = cut_keys(_texts(data)[1], length)
                keys = keys[multikey_order(keys)]
                if len(keys):
                    some = keys[np.unique(np.linspace(0, len(keys) - 1, SAMPLE_KEYS).astype(np.int64))]
                    yield pa.RecordBatch.from_arrays([pa.array([some.tobytes()], pa.binary())], ["keys"])

    picked = blocks.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLE_BLOCKS)
    some = [np.frombuffer(r[0], np.uint64).reshape(-1, 2) for r in blocks.join(F.broadcast(picked), "block", "left_semi").mapInArrow(sample, "keys binary").collect()]
    some = np.concatenate([np.zeros((0, 2), np.uint64), *some])
    some = some[multikey_order(some)]
    splitters = some[np.linspace(0, len(some) - 1, parts + 1).astype(np.int64)[1:-1]] if len(some) else some
    even = np.zeros((parts - 1, 2), np.uint64)  # hashes of strings are uniform as they are
    even[:, 0] = [(1 << 64) * i // parts for i in range(1, parts)]

    first = _sort_round(spark, blocks, lambda row: cut_keys(_texts(row["data"])[1], length), splitters, parts)
    both = blocks.join(first.withColumnRenamed("states", "first"), "block", "left")

    def open_strings(row):
        texts = _texts(row["data"])[1]
        return string_keys(texts, _states(cut_keys(texts, length), row["first"]), length)

    second = _sort_round(spark, both, open_strings, even, parts)
    out = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def remove(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _texts(row["data"])
                state = _states(cut_keys(texts, length), row["first"])
                found = covered(texts, state, _states(string_keys(texts, state, length), row["second"]), length)
                kept = [b"".join(t[a:b] for a, b in zip([0, *s[:, 1].tolist()], [*s[:, 0].tolist(), len(t)], strict=True)) for t, s in zip(texts, found, strict=True)]
                flat = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
                where = np.append(0, np.cumsum([len(s) for s in found]))
                spans = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], fields=list(out)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), spans, pa.array(kept, pa.binary())], [id_col, "n_bytes", "spans", "kept"])

    return both.join(second.withColumnRenamed("states", "second"), "block", "left").mapInArrow(remove, f"`{id_col}` {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
