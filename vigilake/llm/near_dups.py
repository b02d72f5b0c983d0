"""Near-duplicate documents by ProbMinHash sketches, banding and exact verification (operator 10).

1. Equal texts are one class (grouped by a 128-bit hash, partial aggregation first), so copies never meet.
2. A sketch of each class: weighted five-word shingles (weight: occurrences) are Poisson processes whose rate is
   the weight; an arrival falls into a random one of ``SIZE`` registers, and each register keeps its earliest
   arrival's shingle. An element stops as soon as its next arrival is later than every register's, so most
   shingles need one or two arrivals. Two sketches agree in a register with the probability Jaccard similarity.
3. Bands of ``ROWS`` registers are bucket keys. Classes in a bucket are compared with the bucket's least class and
   buckets of up to ``SMALL`` with one another. Pairs that pass a sketch filter are verified on the exact
   shingle multisets, and components of the verified links are taken.
4. Larger buckets that hold classes of several components are still open. Those that share classes are taken
   together as one group (or one by one, where that is less work), so that classes that meet in forty bands are
   compared once. Members are first compared with a few of the group, chosen by hash. Then the members outside the
   group's largest component, its stragglers, are compared in full with all of it, in blocks: by their sketches, then
   by their shingles, inside the task, so that only links come out. No partner is capped and no group emits its pairs.

Words are told apart by their text; a shingle is known by 64 bits mixed from 64-bit hashes (xxh3) of its words.

Defined results: texts are compared as words divided by ASCII blanks; a text with one to four words is one shingle;
null texts and texts without a word are linked with nothing, equal ones included; of equal texts every row gets
the same class; rows with equal doc_id are one document, which is similar to whatever any of its texts is similar to, and
each of them gives a row; a null doc_id has class null and kept null; further columns are ignored. Similarity is the
probability Jaccard index of the shingle counts, which is the plain Jaccard index where no shingle repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm import pieces as P
from vigilake.llm.components import compact, connected_components
from vigilake.session import settled, shared_dir, ship

WORDS, SIMILARITY = 5, 0.8
ROWS, BANDS = 6, 40
SIZE = ROWS * BANDS
SMALL = 12
#: Members that a straggler's group is first compared with; members of a block, and characters that count as one more.
PIVOTS, BLOCK, HEAVY = 4, 512, 32_768
SALTS = 16  # shares into which the members of a group are dealt when facts about the group are joined to them
SLACK = 0.12  # a sketch estimate below SIMILARITY - SLACK is over four and a half standard deviations away


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: Sequence[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, occurrences), sorted by text and hash."""
    docs, prints = [], []
    for a, b in P.chunks(texts):
        cp, off = P.codepoints(texts[a:b])
        starts, ends = P.blank_words(cp, off)
        if not len(starts):
            continue
        number, lead = P.distinct(cp, starts, ends)
        words_of = P.piece_texts(cp, starts[lead], ends[lead])
        h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in words_of), np.uint64, len(words_of))[number]
        first = np.searchsorted(starts, off)
        n = np.diff(first)
        doc = np.repeat(np.arange(a, b), n)
        place = np.arange(len(h)) - np.repeat(first[:-1], n)
        left = np.repeat(n, n) - place  # words from here to the text's end
        total = h.copy()
        for k in range(1, words):
            nxt = np.zeros_like(h)
            nxt[:-k] = h[k:] if k < len(h) else 0
            nxt[left <= k] = 0
            total = _mix(total * np.uint64(0x9E3779B97F4A7C15) + nxt)
        whole = (left >= words) | ((place == 0) & (np.repeat(n, n) < words))
        docs.append(doc[whole])
        prints.append(total[whole])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, h = np.concatenate(docs), np.concatenate(prints)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[edge], h[edge], np.diff(np.append(edge, len(h)))


def sketches(doc: np.ndarray, prints: np.ndarray, weight: np.ndarray, n: int, size: int = SIZE) -> np.ndarray:
    """n x size registers (fingerprint of the winner, 32 bits); texts without shingles have zeros."""
    best = np.full(n * size, np.inf)
    won, registers, latest = np.zeros(n * size, np.uint64), best.reshape(n, size), np.full(n, np.inf)
    state, base, rate, time = prints.copy(), doc.astype(np.int64) * size, weight.astype(np.float64), np.zeros(len(doc))
    element = _mix(prints ^ np.uint64(0xA5A5A5A55A5A5A5A))
    owner = doc
    while len(state):
        state = _mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / rate
        at = base + (_mix(state ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(size)).astype(np.int64)
        better = np.flatnonzero(time < best[at])
        where, when = at[better], time[better]
        np.minimum.at(best, where, when)
        hit = when == best[where]
        won[where[hit]] = element[better[hit]]
        open_docs = owner[np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))]
        latest[open_docs] = registers[open_docs].max(axis=1)
        go = np.flatnonzero(time < latest[owner])
        state, base, rate, time, element, owner = state[go], base[go], rate[go], time[go], element[go], owner[go]
    return won.reshape(n, size).astype(np.uint32)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard index of two weighted sets of sorted fingerprints, without a step for each pair of elements.

    Each common element x contributes 1 / sum_y max(a_y / a_x, b_y / b_x); with r = a / b this is a sum over the
    elements below and above x's own ratio.
    """
    both, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    if (wa == 1).all() and (wb == 1).all():
        return len(both) / (len(a) + len(b) - len(both))
    ratio = x / y
    order = np.argsort(ratio)
    x, y, ratio = x[order], y[order], ratio[order]
    # sum of max(a_y / a_x, b_y / b_x): elements of higher ratio count by a, of lower by b
    cx, cy = np.concatenate([[0], np.cumsum(x)]), np.concatenate([[0], np.cumsum(y)])
    cut = np.arange(len(x))
    high = (wa.sum() - x.sum()) + (cx[-1] - cx[cut])
    low = (wb.sum() - y.sum()) + cy[cut]
    return float((1.0 / (high / x + low / y)).sum())


def _sketch_rows(batches):
    """Rows (text, ...) to (..., bands, sketch), without texts that have no word."""
    for batch in batches:
        texts, names = batch.column(0).to_pylist(), batch.schema.names[1:]
        for a, b in P.chunks(texts, 1 << 20):
            doc, prints, weight = shingles(texts[a:b])
            keep = np.unique(doc)
            if not len(keep):
                continue
            found = sketches(np.searchsorted(keep, doc), prints, weight, len(keep))
            keys = np.zeros((len(keep), BANDS), np.uint64)
            for r in range(ROWS):
                keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + found[:, r::ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
            bands = pa.ListArray.from_arrays(np.arange(0, len(keep) * BANDS + 1, BANDS, dtype=np.int32), pa.array(keys.reshape(-1).view(np.int64)))
            sketch = pa.array([x.tobytes() for x in found.astype(np.uint8)], pa.binary())  # a byte of each register
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a).take(pa.array(keep)) for c in batch.columns[1:]), bands, sketch], [*names, "bands", "sketch"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity from the registers' bytes, without the chance agreements of 1 in 256."""
    return (np.count_nonzero(a == b, axis=-1) / a.shape[-1] - 1 / 256) / (1 - 1 / 256)


def _close(batches):
    """Pairs (a, b, sketch of a, sketch of b) that may be similar enough."""
    for batch in batches:
        if batch.num_rows:
            left, right = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, SIZE) for c in (batch.column(2), batch.column(3)))
            yield batch.select([0, 1]).filter(pa.array(_agreement(left, right) >= SIMILARITY - SLACK))


def _verified(batches):
    """Pairs (a, b, text of a, text of b) whose exact similarity is high enough; rows come sorted by b."""
    last, own = None, None
    for batch in batches:
        a, b, ta, tb = (c.to_pylist() for c in batch.columns)
        good = np.zeros(len(a), bool)
        for lo in range(0, len(a), 64):
            part = ta[lo : lo + 64]
            doc, prints, weight = shingles(part)
            edge = np.searchsorted(doc, np.arange(len(part) + 1))
            for i in range(len(part)):
                if last != b[lo + i]:
                    last = b[lo + i]
                    _, p, w = shingles([tb[lo + i]])
                    own = (p, w)
                x, y = edge[i], edge[i + 1]
                good[lo + i] = similarity(prints[x:y], weight[x:y], *own) >= SIMILARITY
        yield batch.select([0, 1]).filter(pa.array(good))


def _unit_links(batches):
    """Links inside units. Rows (unit, i, j, side, id, component, straggler, sketch, text), sorted by unit, i, j, side.

    Side 0 has stragglers, side 1 members; each of side 0 is compared with those of side 1 in other components (two
    stragglers from the greater one's side only) by one search of its shingles in theirs. One link to each other
    component comes out.
    """
    now, rows = None, []

    def links(found):
        split = next((k for k, r in enumerate(found) if r[0] == 1), len(found))
        ids, component, straggler = (np.array([r[k] for r in found], np.int64) for k in (1, 2, 3))
        sketch = np.frombuffer(b"".join(r[4] for r in found), np.uint8).reshape(-1, SIZE)
        doc, prints, weight = shingles([r[5] for r in found])
        edge = np.searchsorted(doc, np.arange(len(found) + 1))
        theirs, from_edge = slice(split, len(found)), edge[split:-1]
        size = np.diff(edge)[theirs]
        out = []
        if split == len(found):
            return out
        counted = np.add.reduceat(weight, edge[:-1]) > np.diff(edge)  # shingles that repeat
        base = edge[split]
        for x in range(split):
            near = _agreement(sketch[theirs], sketch[x]) >= SIMILARITY - SLACK
            near &= (component[theirs] != component[x]) & ((straggler[theirs] == 0) | (ids[theirs] < ids[x]))
            if not near.any():
                continue
            own, own_weight = prints[edge[x] : edge[x + 1]], weight[edge[x] : edge[x + 1]]
            to = np.minimum(np.searchsorted(own, prints[base:]), len(own) - 1)
            shared = np.add.reduceat((own[to] == prints[base:]).astype(np.int64), from_edge - base)
            score = np.where(near, shared / (size + len(own) - shared), 0.0)
            for y in np.flatnonzero(near & (counted[theirs] | counted[x])).tolist():
                lo, hi = edge[split + y], edge[split + y + 1]
                score[y] = similarity(own, own_weight, prints[lo:hi], weight[lo:hi])
            good = np.flatnonzero(score >= SIMILARITY) + split
            for y in good[np.unique(component[good], return_index=True)[1]].tolist():
                out.append((max(int(ids[x]), int(ids[y])), min(int(ids[x]), int(ids[y]))))
        return out

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], ["a", "b"])

    for batch in batches:
        for unit, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (unit, i, j) != now and rows:
                yield batch_of(links(rows))
                rows = []
            now = (unit, i, j)
            rows.append(rest)
    if rows:
        yield batch_of(links(rows))


def _with_facts(members: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """members joined to facts, of which each key has one row, in SALTS shares by id, so that no task gets a large group whole."""
    facts = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return members.withColumn("salt", F.pmod(F.hash("id"), F.lit(SALTS))).join(facts, [key, "salt"]).drop("salt")


def _units(rows: DataFrame) -> DataFrame:
    """unit, id, component, rows, columns, straggler: whom to compare with whom, in so many blocks. rows: unit, id, component, heavy."""
    by_component = rows.groupBy("unit", "component").agg(F.sum("heavy").alias("w"), F.count("*").alias("n"))
    sizes = by_component.groupBy("unit").agg(F.max_by(F.struct("component", "w"), F.struct("n", "component")).alias("most"), F.sum("w").alias("all"), F.count("*").alias("k")).where("k > 1")
    blocks = lambda w: F.ceil(w / BLOCK).cast("int")
    sizes = sizes.select("unit", F.col("most.component").alias("most"), blocks(F.col("all") - F.col("most.w")).alias("rows"), blocks(F.col("all")).alias("columns"))
    return _with_facts(rows, sizes, "unit").select("unit", "id", "component", "rows", "columns", (F.col("component") != F.col("most")).alias("straggler"))


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a > b) whose texts are similar."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").sortWithinPartitions("b")
    return both.mapInArrow(_verified, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, class_id (the least id of its near-duplicate group), kept (id = class_id)."""
    spark = docs.sparkSession
    ship(spark)
    shared_dir(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    solid = F.coalesce(F.col("id").isNotNull() & (F.length(F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))) > 0), F.lit(False))
    texts = rows.where(solid)
    texts = texts.select("id", "text", F.unhex(F.md5("text")).alias("copy"))
    # a node for each different text, named by a number of its own
    first = texts.groupBy("copy").agg(F.min("id").alias("id")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    named = texts.select("id", "copy").join(first.select("copy", "node"), "copy").select("id", "node").checkpoint()
    # an id's texts are one document, so all nodes of an id are linked
    apart = named.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b < top").select("id", "b")
    same = compact(named.join(apart, "id").where("node > b").select(F.col("node").alias("a"), "b").distinct())
    # sketches are made before copies are dropped, so that no text is shuffled for it
    sketch = texts.select("text", "id", "copy").mapInArrow(_sketch_rows, "id long, copy binary, bands array<long>, sketch binary")
    sketch = sketch.join(first, ["id", "copy"]).dropDuplicates(["id", "copy"]).select(F.col("node").alias("id"), "bands", "sketch").checkpoint()

    keys = sketch.select("id", F.explode("bands").alias("key"))
    bucket = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("b")).where("n > 1")
    held = keys.join(bucket, "key").checkpoint()
    stars = held.where("id > b").select(F.col("id").alias("a"), "b")
    small = held.where((F.col("n") > 2) & (F.col("n") <= SMALL)).select("key", "id")
    inner = small.groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.explode(F.expr("flatten(transform(slice(ids, 2, size(ids)), (x, i) -> transform(slice(ids, 2, i), y -> struct(x as a, y as b))))")).alias("p")).select("p.a", "p.b")
    pairs = stars.union(inner).distinct()
    own = sketch.select("id", "sketch")
    # only classes that share a bucket are compared: their texts are put aside once, in place of all texts each time
    met = first.join(held.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    texts_in = settled(texts.join(met, ["id", "copy"]).dropDuplicates(["id", "copy"]).select(F.col("node").alias("id"), "text"))

    def links_of(pairs: DataFrame) -> DataFrame:
        both = pairs.join(own.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(own.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
        return _verify(both.select("a", "b", "sa", "sb").mapInArrow(_close, "a long, b long"), texts_in).checkpoint()

    def solved(links: DataFrame) -> DataFrame:
        """id, component."""
        return connected_components(links, native=False).select(F.col("node").alias("id"), "component")

    links = links_of(pairs).union(same)
    groups = solved(links)
    of_class = sketch.select("id", "bands").join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.explode("bands").alias("key"))
    in_large = of_class.join(bucket.where(F.col("n") > SMALL).select("key"), "key")
    open_keys = in_large.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("b"), F.count("*").alias("n")).where("lo < hi").select("key", "b", "n")
    left = compact(in_large.join(open_keys, "key").select("key", "id", "component", "b"))
    if left.limit(1).count():
        # open buckets that share classes are one group
        grouped = compact(connected_components(left.select("id", "b"), native=False).select(F.col("node").alias("id"), F.col("component").alias("grp")))
        members = compact(left.select("id", "component").distinct().join(grouped, "id"))
        heads = members.groupBy("grp").agg(*(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "component")).alias(f"p{k}") for k in range(PIVOTS)))
        few = _with_facts(members, heads, "grp").select("id", "component", F.explode(F.array(*(f"p{k}" for k in range(PIVOTS)))).alias("x")).where("component != x.component")
        links = links.union(links_of(few.select(F.greatest("id", "x.id").alias("a"), F.least("id", "x.id").alias("b")).distinct()))
        groups = solved(links)
        heavy = texts_in.select("id", (1 + F.length("text") / HEAVY).alias("heavy"))
        members = members.select("id", "grp").join(heavy, "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
        # a group is a unit, or each of its buckets where these have fewer pairs together
        keys_of = left.groupBy("key", "b").agg(F.count("*").alias("n")).join(grouped.select(F.col("id").alias("b"), "grp"), "b")
        work = keys_of.groupBy("grp").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("apart"))
        work = work.join(members.groupBy("grp").agg(F.count("*").cast("double").alias("n")), "grp").select("grp", (F.col("n") * F.col("n") <= F.col("apart")).alias("together"))
        named_members = compact(_with_facts(members, work, "grp"))
        whole = named_members.where("together").select(F.struct("grp", F.lit(None).cast("long").alias("key")).alias("unit"), "id", "component", "heavy")
        single = left.select("key", "id").join(named_members.where("not together"), "id").select(F.struct("grp", "key").alias("unit"), "id", "component", "heavy")
        units = compact(_units(whole.union(single)))
        spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        at = lambda n: F.pmod(F.hash("id"), F.col(n))
        dealt = units.where("straggler").select("unit", at("rows").alias("i"), spread("columns").alias("j"), F.lit(0).alias("side"), "id", "component", "straggler")
        dealt = dealt.union(units.select("unit", spread("rows").alias("i"), at("columns").alias("j"), F.lit(1).alias("side"), "id", "component", "straggler"))
        ready = dealt.join(own, "id").join(texts_in, "id").select("unit", "i", "j", "side", "id", "component", F.col("straggler").cast("int").alias("straggler"), "sketch", "text")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ready = ready.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j", "side")
        found = ready.mapInArrow(_unit_links, "a long, b long").distinct().checkpoint()
        groups = solved(links.union(found))
    groups = groups.withColumnRenamed("id", "node")
    classes = first.join(groups.select("node", "component"), "node", "left").select("id", "node", F.coalesce("component", "node").alias("component"))
    least = classes.groupBy("component").agg(F.min("id").alias("class_id"))
    linked = named.join(classes.join(least, "component").select("node", "class_id"), "node").select("id", "class_id")
    out = linked.union(rows.where(~solid).select("id", F.col("id").alias("class_id")))
    return out.select(F.col("id").alias(id_col), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))
