"""Ranked lexical search by TPUT over term-partitioned postings (operator 11).

One scan makes the postings of the items' terms (packed for each term and block of documents) and the counts of the whole table;
they are settled in the shared folder. Weights and impacts (a term's share of a document's score) follow without a second scan: lists
are dealt by term, long ones in shares, and settled as segments of up to ``SEGMENT`` documents in order of impact.

TPUT then has three phases for all items at once:

1. The ``k`` greatest impacts of each list give partial sums; an item's k-th greatest is a lower bound of its k-th score.
2. Each list gives what is at least the bound divided by the item's number of lists. A document that none of them gives is below
   the bound. What the lists give is dealt by document and added there; a document's unseen lists add at most their greatest
   impact, and less than the divided bound. The k-th greatest sum is a new bound, in each task first and then of all, and documents
   whose sum with what is unseen stays below it are out.
3. The documents left are looked up in all lists, which gives exact scores; the k best are the result.

Heads, bounds and results are aggregates with partial sums or limits for each task; no list, item or document is gathered. Items are
taken in blocks of about ``SHIPPED`` different terms together, which go to the tasks; each block of items is a pass of its own.

Defined results: a null or blank text has no terms and is not counted; rows of documents are documents of their own, also where
doc_id repeats or is null (ties by doc_id, null last, then by no fixed order of rows); rows with one item_id (null too) are
one item with the terms of all of them; items without terms or without a document have no rows; further columns are ignored. Memory
is linear in a block of documents (``BLOCK`` characters or the longest text), in a segment, and in what a task adds up.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm import pieces as P
from vigilake.session import broadcast_if_small, settled, ship

#: Different terms of items, counted for each item, that a pass takes.
SHIPPED = 200_000
BLOCK, SEGMENT = 4 << 20, 1 << 15
#: Sums (documents times items) that a task holds at once.
CELLS = 1 << 21
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms(text) -> F.Column:
    """The terms of a text, in order, with repeats (A-Z lower-cased, nothing else)."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(_TERM), F.lit(0))


def _spans(cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms in lower-cased code points of texts that begin at off."""
    n = len(cp)
    solid = (cp >= 128) | ((cp >= 48) & (cp <= 57)) | ((cp >= 97) & (cp <= 122))
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    return np.flatnonzero(solid & (~before | edge[:n])), np.flatnonzero(solid & (~after | edge[1:])) + 1


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join([np.int64(len(arrays[0])).tobytes(), *(x.tobytes() for x in arrays)]), 1)


def _unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zlib.decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _batch(columns: list, types: str, names: str) -> pa.RecordBatch:
    kinds = {"l": pa.int64(), "i": pa.int32(), "b": pa.binary(), "?": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[t]) for x, t in zip(columns, types, strict=True)], names.split())


def _ids(ids: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids], ["id"])
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return zlib.compress(sink.getvalue().to_pybytes(), 1)


def _ids_in(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(zlib.decompress(data)).read_next_batch().column(0)


def _scan(names: list[str]):
    """Map of rows (id, text, part) to packed postings (term, block, size, total, data: document, its terms, occurrences).

    A row with term -1 has the block's documents with terms (size), all their terms (total), and the ids of all its documents.
    """
    number_of = {x: i for i, x in enumerate(names)}
    cp, off = P.codepoints(names)
    prints = np.unique(P.fingerprints(cp, off[:-1], off[1:]))

    def postings(texts: list[str]):
        found, n_docs, n_terms = [], 0, 0
        for a, b in P.chunks(texts):
            cp, off = P.codepoints(texts[a:b])
            if not len(cp):
                continue
            cp = np.where((cp >= 65) & (cp <= 90), cp + 32, cp).astype(np.uint32)
            starts, ends = _spans(cp, off)
            doc = np.searchsorted(off, starts, "right") - 1
            size = np.bincount(doc, minlength=b - a)
            n_docs, n_terms = n_docs + int((size > 0).sum()), n_terms + len(starts)
            known = P.fingerprints(cp, starts, ends)
            at = np.minimum(np.searchsorted(prints, known), len(prints) - 1)
            hit = np.flatnonzero(prints[at] == known)
            if not len(hit):
                continue
            number, first = P.distinct(cp, starts[hit], ends[hit])
            # equal fingerprints only propose terms, their texts decide
            own = np.fromiter((number_of.get(x, -1) for x in P.piece_texts(cp, starts[hit][first], ends[hit][first])), np.int64, len(first))[number]
            cell, tf = np.unique(own[own >= 0] << 32 | doc[hit][own >= 0], return_counts=True)
            at = cell & 0xFFFFFFFF
            found.append((cell >> 32, a + at, size[at], tf))
        if not found:
            return n_docs, n_terms, []
        term, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(term, kind="stable")
        cut = np.flatnonzero(np.diff(term[order])) + 1
        return n_docs, n_terms, [(int(term[x[0]]), [c[x].astype(np.int32) for c in rest]) for x in np.split(order, cut)]

    def run(batches):
        ids, texts, size, seq, part = [], [], 0, 0, 0

        def emit():
            block = part << 32 | seq
            n_docs, n_terms, found = postings(texts)
            rows = [(-1, block, n_docs, n_terms, _ids(pa.concat_arrays(ids))), *((t, block, len(x[0]), 0, _pack(*x)) for t, x in found)]
            return _batch(list(zip(*rows, strict=True)), "illlb", "term block size total data")

        for batch in batches:
            own, at = [x or "" for x in batch.column(1).to_pylist()], 0
            if own:
                part = batch.column(2)[0].as_py()
            for i, text in enumerate(own):
                size += len(text) + 16
                if size >= BLOCK:
                    ids.append(batch.column(0)[at : i + 1])
                    texts += own[at : i + 1]
                    yield emit()
                    ids, texts, size, seq, at = [], [], 0, seq + 1, i + 1
            if at < len(own):
                ids.append(batch.column(0)[at:])
                texts += own[at:]
        if texts:
            yield emit()

    return run


def impact_lists(found: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """Settled segments (term, top, data: block, document, impact), in order of impact; terms of weight 0 have none."""
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))).cast("long")
    weights = found.groupBy("term").agg(F.sum("size").alias("df")).select("term", weight.alias("w"), F.ceil(F.col("df") / SEGMENT).alias("shares")).where("w > 0")
    dealt = found.join(broadcast_if_small(weights), "term").select("term", F.pmod(F.xxhash64("block"), F.col("shares")).cast("int").alias("share"), "block", "w", "data")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def merge(batches):
        now, held, size = None, [], 0

        def emit():
            term, _, w = now
            block = np.concatenate([np.full(len(x[0]), b) for b, x in held])
            doc, n, tf = (np.concatenate([x[k] for _, x in held]).astype(np.int64) for k in range(3))
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            impact = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            order = np.lexsort((doc, block, -impact))
            return _batch([[term], [int(impact[order[0]])], [_pack(block[order], impact[order], doc[order].astype(np.int32))]], "ilb", "term top data")

        for batch in batches:
            for term, share, block, w, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((term, share, w) != now or size >= SEGMENT):
                    yield emit()
                    held, size = [], 0
                now = (term, share, w)
                held.append((block, _unpack(data, np.int32, np.int32, np.int32)))
                size += len(held[-1][1][0])
        if held:
            yield emit()

    return settled(dealt.repartition(parts, "term", "share").sortWithinPartitions("term", "share", "block").mapInArrow(merge, "term int, top long, data binary"))


def _bucket(block: np.ndarray, doc: np.ndarray, parts: int) -> np.ndarray:
    h = block.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + doc.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _split(to: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    return [(int(to[x[0]]), x) for x in np.split(order, np.flatnonzero(np.diff(to[order])) + 1)] if len(order) else []


class _Asked:
    """The items of a pass by number: for each term, its items and how often they ask for it."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray, n_terms: int):
        order = np.argsort(term, kind="stable")
        self.item, self.term, self.times = item[order], term[order], times[order]
        self.at = np.searchsorted(self.term, np.arange(n_terms + 1))
        self.items = int(item.max()) + 1 if len(item) else 0

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For postings of terms: the posting and the row of each item that asks for it."""
        n = self.at[term + 1] - self.at[term]
        posting = np.repeat(np.arange(len(term)), n)
        return posting, np.repeat(self.at[term] - (np.cumsum(n) - n), n) + np.arange(len(posting))


def _sums(cell: np.ndarray, value: np.ndarray, cells: int) -> np.ndarray:
    if len(value) and float(value.max()) * len(value) < 2**53:  # exact in doubles
        return np.bincount(cell, value, cells).astype(np.int64)
    out = np.zeros(cells, np.int64)
    np.add.at(out, cell, value)
    return out


def _added(asked: _Asked, least: np.ndarray, unseen: np.ndarray, bound: np.ndarray, k: int, docs: np.ndarray, term: np.ndarray, impact: np.ndarray):
    """Phase 2 in a task: item, document and upper end of the sum, of documents (numbers in order, one for each posting) that can still be among the best; and the k greatest sums of each item."""
    room, bound = np.bincount(asked.item, unseen, asked.items).astype(np.int64), bound.copy()
    best, out = np.zeros((0, asked.items), np.int64), []
    first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1])) if len(docs) else np.zeros(0, np.int64)
    per = max(k, CELLS // max(1, asked.items))
    for lo in range(0, len(first), per):
        a, b = first[lo], first[lo + per] if lo + per < len(first) else len(docs)
        local = np.cumsum(np.append(False, docs[a + 1 : b] != docs[a : b - 1]))
        posting, row = asked.spread(term[a:b])
        given = impact[a:b][posting] >= least[row]
        posting, row = posting[given], row[given]
        cell, n = local[posting] * asked.items + asked.item[row], (int(local[-1]) + 1) * asked.items
        total = _sums(cell, impact[a:b][posting] * asked.times[row], n).reshape(-1, asked.items)
        upper = total + room - _sums(cell, unseen[row], n).reshape(-1, asked.items)
        best = np.concatenate([best, total])
        if len(best) > k:
            best = np.partition(best, len(best) - k, axis=0)[-k:]
        if len(best) == k:
            bound = np.maximum(bound, best.min(axis=0))
        doc, item = np.nonzero((upper >= bound) & (total > 0))
        out.append((item, docs[a:b][np.searchsorted(local, doc)], upper[doc, item]))
    item, doc, upper = (np.concatenate(x) for x in zip(*out, strict=True))
    left = upper >= bound[item]
    return item[left], doc[left], upper[left], best


def _pass(docs: DataFrame, asked: DataFrame, k: int, id_col: str, item_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = asked.collect()
    values = sorted({r["item"]["item_id"] for r in rows}, key=lambda x: (x is None, str(x)))
    names = sorted({r["term"] for r in rows})
    item_number, term_number = {x: i for i, x in enumerate(values)}, {x: i for i, x in enumerate(names)}
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.spark_partition_id().alias("part"))
    id_type, item_type = src.schema["id"].dataType.simpleString(), asked.schema["item"].dataType["item_id"].dataType.simpleString()
    out = f"`{item_col}` {item_type}, rank int, `{id_col}` {id_type}, score long"
    if not rows:
        return spark.createDataFrame([], out)
    scanned = settled(src.mapInArrow(_scan(names), "term int, block long, size long, total long, data binary"))
    n_docs, n_terms = scanned.where("term < 0").agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    if not n_terms:
        return spark.createDataFrame([], out)
    lists = impact_lists(scanned.where("term >= 0"), n_docs, n_terms)

    # phase 1
    def first(batches):
        for batch in batches:
            for term, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block, impact, doc = (x[:k] for x in _unpack(data, np.int64, np.int64, np.int32))
                yield _batch([np.full(len(block), term), block, doc, impact], "ilil", "term block doc impact")

    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "block", "doc"))
    heads = settled(lists.mapInArrow(first, "term int, block long, doc int, impact long").withColumn("place", place).where(F.col("place") <= k))
    top = np.zeros(len(names), np.int64)
    for r in heads.where("place = 1").select("term", "impact").collect():
        top[r["term"]] = r["impact"]
    plan = _Asked(*(np.array(x, np.int64) for x in zip(*((item_number[r["item"]["item_id"]], term_number[r["term"]], r["times"]) for r in rows if top[term_number[r["term"]]]), strict=True)), len(names)) if top.any() else None
    if plan is None:
        return spark.createDataFrame([], out)
    asks = spark.createDataFrame(list(zip(plan.item.tolist(), plan.term.tolist(), plan.times.tolist(), strict=True)), "item int, term int, times long")
    sums = heads.join(broadcast_if_small(asks, SHIPPED), "term").groupBy("item", "block", "doc").agg(F.sum(F.col("times") * F.col("impact")).alias("total"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("total")))
    bound = np.zeros(plan.items, np.int64)
    for r in sums.select("item", "total", nth.alias("nth")).where(F.col("nth") <= k).where(F.col("nth") == k).collect():
        bound[r["item"]] = r["total"]
    n_lists = np.bincount(plan.item, minlength=plan.items)[plan.item]
    least = -(-bound[plan.item] // (n_lists * plan.times))
    # what a list adds that gave nothing: less than the divided bound, and its greatest impact at most
    unseen = np.where(bound[plan.item] > 0, np.minimum(plan.times * top[plan.term], (bound[plan.item] - 1) // n_lists), 0)
    need = np.full(len(names), np.iinfo(np.int64).max)
    np.minimum.at(need, plan.term, least)

    def deal(all_of: bool):
        """Segments' postings (at least what is needed, or all) by the bucket of their document."""

        def run(batches):
            for batch in batches:
                for term, _, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    block, impact, doc = _unpack(data, np.int64, np.int64, np.int32)
                    n = len(impact) if all_of else int(np.searchsorted(-impact, -need[term], "right"))
                    found = [(to, 2, term, _pack(block[x], impact[x], doc[x])) for to, x in _split(_bucket(block[:n], doc[:n], parts))]
                    if found:
                        yield _batch(list(zip(*found, strict=True)), "iiib", "bucket kind term data")

        return run

    dealt = "bucket int, kind int, term int, data binary"

    # phase 2
    def add(batches):
        held = [(b, t, *_unpack(x, np.int64, np.int64, np.int32)) for batch in batches for b, _, t, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if not held:
            return
        bucket = held[0][0]
        term = np.repeat([x[1] for x in held], [len(x[2]) for x in held])
        block, impact, doc = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
        order = np.lexsort((doc, block))
        block, doc, term, impact = block[order], doc[order], term[order], impact[order]
        number = np.cumsum(np.append(True, (block[1:] != block[:-1]) | (doc[1:] != doc[:-1]))) - 1
        where = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        item, at, upper, best = _added(plan, least, unseen, bound, k, number, term, impact)
        yield _batch([[bucket], [-1], [0], [_pack(upper, block[where[at]], doc[where[at]], item.astype(np.int32))]], "iilb", "bucket item total data")
        place, some = np.nonzero(best)
        yield _batch([np.full(len(some), bucket), some, best[place, some], [None] * len(some)], "iilb", "bucket item total data")

    given = lists.mapInArrow(deal(False), dealt).repartitionById(parts, F.col("bucket"))
    added = settled(given.mapInArrow(add, "bucket int, item int, total long, data binary"))
    nth = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("total")))
    last = bound.copy()
    for r in added.where("item >= 0").select("item", "total", nth.alias("nth")).where(F.col("nth") <= k).where(F.col("nth") == k).collect():
        last[r["item"]] = max(last[r["item"]], r["total"])

    # phase 3
    def candidates(batches):
        for batch in batches:
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                upper, block, doc, item = _unpack(data, np.int64, np.int64, np.int32, np.int32)
                x = upper >= last[item]
                if x.any():
                    yield _batch([[bucket], [0], [-1], [_pack(block[x], doc[x], item[x])], [None]], "iiibb", "bucket kind term data more")

    def ids_of(batches):
        for batch in batches:
            for block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = _ids_in(data)
                doc, own = np.arange(len(ids), dtype=np.int32), np.full(len(ids), block, np.int64)
                found = [(b, 1, -1, _pack(own[x], doc[x]), _ids(ids.take(pa.array(x)))) for b, x in _split(_bucket(own, doc, parts))]
                yield _batch(list(zip(*found, strict=True)), "iiibb", "bucket kind term data more")

    def look_up(batches):
        held, known = [], []
        exact = None
        for batch in batches:
            for _, kind, term, data, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    held.append(_unpack(data, np.int64, np.int32, np.int32))
                elif not held:
                    return  # no candidates here
                elif kind == 1:
                    known.append((*_unpack(data, np.int64, np.int32), _ids_in(more)))
                else:
                    exact = exact or _Exact(plan, held)
                    exact.add(term, *_unpack(data, np.int64, np.int64, np.int32))
        if exact:
            yield exact.best(known, k)

    looked = "bucket int, kind int, term int, data binary, more binary"
    every = added.where("item < 0").select("bucket", "data").mapInArrow(candidates, looked).union(scanned.where("term < 0").select("block", "data").mapInArrow(ids_of, looked)).union(lists.mapInArrow(deal(True), dealt).withColumn("more", F.lit(None).cast("binary")))
    scored = every.repartitionById(parts, F.col("bucket")).sortWithinPartitions("kind").mapInArrow(look_up, f"item int, score long, id {id_type}, block long, doc int")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "block", "doc")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = spark.createDataFrame(list(enumerate(values)), f"item int, value {item_type}")
    return best.join(broadcast_if_small(named, SHIPPED), "item").select(F.col("value").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


class _Exact:
    """Exact scores of a task's candidates (block, document, item), from all postings of their documents."""

    def __init__(self, asked: _Asked, held: list[list[np.ndarray]]):
        self.asked = asked
        block, doc, item = (np.concatenate(x) for x in zip(*held, strict=True))
        self.blocks = np.unique(block)
        key, _ = self._keys(block, doc)
        self.keys, number = np.unique(key, return_inverse=True)
        self.cells = np.sort(number * asked.items + item)
        self.total = np.zeros(len(self.cells), np.int64)

    def _keys(self, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One number for each document, and which are of a candidate's block."""
        at = np.minimum(np.searchsorted(self.blocks, block), len(self.blocks) - 1)
        return at << 32 | doc.astype(np.int64), self.blocks[at] == block

    def _places(self, block: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates' documents among these: where they are here, and their numbers."""
        key, near = self._keys(block, doc)
        number = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        met = np.flatnonzero(near & (self.keys[number] == key))
        return met, number[met]

    def add(self, term: int, block: np.ndarray, impact: np.ndarray, doc: np.ndarray) -> None:
        met, number = self._places(block, doc)
        posting, row = self.asked.spread(np.full(len(met), term))
        cell = number[posting] * self.asked.items + self.asked.item[row]
        at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
        good = self.cells[at] == cell
        # a document is once in a list and an item once asks for it, so cells do not repeat here
        self.total[at[good]] += impact[met][posting][good] * self.asked.times[row][good]

    def best(self, known: list[tuple], k: int) -> pa.RecordBatch:
        """The k best of each item. known: (block, document, ids) of all documents of the task."""
        block, doc = (np.concatenate([x[i] for x in known]) for i in (0, 1))
        met, number = self._places(block, doc)
        where = np.empty(len(self.keys), np.int64)
        where[number] = met
        at = where[self.cells // self.asked.items]
        ids = pa.concat_arrays([x[2] for x in known]).take(pa.array(at))
        columns = [pa.array(self.cells % self.asked.items, pa.int32()), pa.array(self.total), ids, pa.array(block[at]), pa.array(doc[at], pa.int32())]
        found = pa.RecordBatch.from_arrays(columns, ["item", "score", "id", "block", "doc"])
        found = found.filter(pc.greater(found.column(1), 0))
        found = found.take(pc.sort_indices(found, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")]))
        of = found.column(0).to_numpy()
        return found.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < k))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_col, rank, id_col, score: the k best documents of each item with a score above 0 (fewer if there are fewer)."""
    asked = settled(items.select(F.struct(F.col(item_col).alias("item_id")).alias("item"), F.explode(terms(F.col(text_col))).alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")))
    blocks = max(1, -(-asked.count() // SHIPPED))
    of = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for i in range(blocks):
        found = _pass(docs, asked.where(of == i), k, id_col, item_col, text_col)
        out = found if out is None else out.union(found)
    return out
