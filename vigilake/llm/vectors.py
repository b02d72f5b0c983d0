"""Embedding near-duplicates by random-hyperplane sign hashing in several tables (operator 4).

Equal vectors are one class with a count. Each class gets, in each of T tables, a code of K signs of random
projections; classes with a code in common in a table are compared exactly (double precision), in blocks: a
bucket with more than ``BLOCK`` classes is cut into blocks and each pair of blocks is a unit of work of its own, so a
hot bucket is spread over tasks and nothing is capped. A pair is counted in the first table where its codes
agree, so no pairs are shuffled to remove repetitions: each unit gives, for each class, the number of rows it
links to and one edge to a smaller linked class in place of all its links. Components of these edges are the components of
all links, because every link's two ends are joined inside some unit.

Vectors are compared with those of their own length only: the length is part of a bucket's key, and each length has
projections of its own.

K grows with the logarithm of the number of classes (of all lengths), so that a bucket of unrelated vectors stays small, and T
with it, so that a pair at the least similarity is missed with a probability of at most ``MISS`` (less above it).

Vectors are scaled by powers of two before products are taken, so neither great nor small components are lost.

Defined results: a vector that is null, empty, zero or with null or non-finite
components has no links and is its own component; rows with equal vec_id and vector are one vector; different vectors with one vec_id
are vectors of their own in one component, each with its own links (the others of that vec_id count where they are near); a null
vec_id has no component; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import connected_components
from vigilake.session import shared_dir, ship

MISS, BLOCK, FILL = 0.002, 1024, 200
SEED = 20_240_229
#: Lengths whose projections a task holds at once; they are made again from the seed.
HELD = 8


def plan(classes: int, cosine: float) -> tuple[int, int]:
    """Signs in a code and tables: about FILL unrelated classes in a bucket, misses at the least similarity below MISS."""
    bits = min(28, max(4, math.ceil(math.log2(max(2, classes) / FILL))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _scaled(matrix: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1."""
    return np.ldexp(matrix, -np.frexp(np.abs(matrix).max(axis=1, keepdims=True))[1])


def _units(matrix: np.ndarray) -> np.ndarray:
    matrix = _scaled(matrix)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The batch in parts of vectors (column 1) of one length; without rows, none."""
    size = np.diff(batch.column(1).offsets.to_numpy())
    return [batch.filter(pa.array(size == n)) for n in np.unique(size)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each row of vectors: id_col, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    shared_dir(spark)
    exact = np.float32 if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    valid = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    solid = rows.where(F.coalesce(valid, F.lit(False)))
    classes = solid.distinct().groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()).checkpoint()
    bits, tables = plan(classes.count(), cosine)
    short = np.int16 if bits < 15 else np.int32  # rows are repeated for each table, so they are kept small

    def codes(batches):
        powers, planes = (1 << np.arange(bits, dtype=np.int64)), {}
        for batch in (part for whole in batches for part in _by_length(whole)):
            dims = len(batch.column(1)[0])
            matrix = np.array(batch.column(1).flatten(), dtype=np.float64).reshape(-1, dims)
            if dims not in planes:
                if len(planes) == HELD:
                    planes.clear()
                planes[dims] = np.random.default_rng(SEED).standard_normal((dims, bits * tables))
            signs = (_scaled(matrix) @ planes[dims] > 0).reshape(-1, tables, bits)
            code = (signs * powers).sum(axis=2)
            blob = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.full(len(matrix), dims, np.int32)), blob(matrix.astype(exact)), blob(code.astype(short)), pa.ListArray.from_arrays(np.arange(0, code.size + 1, tables, dtype=np.int32), pa.array(code.reshape(-1).astype(np.int32)))], ["c", "n", "dims", "vector", "codes", "list"])

    coded = classes.select("c", "v", "n").mapInArrow(codes, "c long, n long, dims int, vector binary, codes binary, list array<int>").checkpoint()
    keys = coded.select("c", "dims", F.posexplode("list").alias("t", "code"))
    buckets = keys.groupBy("dims", "t", "code").count().where("count > 1")
    full = keys.join(buckets, ["dims", "t", "code"]).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("block", F.pmod(F.hash("c"), F.col("blocks")))
    dealt = full.select("c", "dims", "t", "code", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("c", "dims", "t", "code", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"))

    def compare(batches):
        """Rows (c, links, to): links found in one unit, and the least linked class of each."""
        now, held = None, []

        def unit(dims, table):
            side = np.array([x[0] for x in held])
            c, n = (np.array([x[k] for x in held], np.int64) for k in (1, 2))
            m = _units(np.frombuffer(b"".join(x[3] for x in held), exact).reshape(-1, dims).astype(np.float64))
            code = np.frombuffer(b"".join(x[4] for x in held), short).reshape(-1, tables)
            left = np.flatnonzero(side == 0)
            right = np.flatnonzero(side == 1) if (side == 1).any() else left
            a, b = np.nonzero(m[left] @ m[right].T >= cosine - 1e-9)
            a, b = left[a], right[b]
            go = c[a] != c[b]
            if right is left:
                go &= a < b
            a, b = a[go], b[go]
            # the first table where the codes agree counts the pair; products are taken once more without blocks
            first = (code[a] == code[b]).argmax(axis=1) == table if len(a) else np.zeros(0, bool)
            a, b = a[first], b[first]
            good = np.einsum("ij,ij->i", m[a], m[b]) >= cosine
            a, b = a[good], b[good]
            links = np.zeros(len(held), np.int64)
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            to = c.copy()
            ends = np.minimum(c[a], c[b])
            np.minimum.at(to, a, ends)
            np.minimum.at(to, b, ends)
            # ends with different least neighbours join those too, so that every link's ends get into one component
            lo_a, lo_b = to[a], to[b]
            apart = lo_a != lo_b
            some = np.flatnonzero(links)
            pair = np.unique(np.stack([lo_a[apart], lo_b[apart]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([c[some], pair[:, 0]])), pa.array(np.concatenate([links[some], np.zeros(len(pair), np.int64)])), pa.array(np.concatenate([to[some], pair[:, 1]]))], ["c", "links", "to"])

        for batch in batches:
            for dims, t, code, i, j, *rest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (dims, t, code, i, j) != now and now is not None:
                    yield unit(*now[:2])
                    held = []
                now = (dims, t, code, i, j)
                held.append(rest)
        if held:
            yield unit(*now[:2])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt.join(coded.select("c", "n", "vector", "codes"), "c").select("dims", "t", "code", "i", "j", "side", "c", "n", "vector", "codes")
    found = ready.repartition(parts, "dims", "t", "code", "i", "j").sortWithinPartitions("dims", "t", "code", "i", "j", "side").mapInArrow(compare, "c long, links long, to long").checkpoint()
    # an id's different vectors belong together
    print_of = F.xxhash64("v")
    several = solid.groupBy("id").agg(F.min(print_of).alias("a"), F.max(print_of).alias("b")).where("a != b").select("id")
    held = solid.join(several, "id", "left_semi").join(classes.select("v", "c"), "v").select("id", "c")
    joined = held.join(held.groupBy("id").agg(F.min("c").alias("to")), "id").select("c", "to")
    groups = connected_components(found.select("c", "to").union(joined).where("c != to"), native=False)
    least = groups.join(classes.select(F.col("c").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    component = groups.join(least, "component").select(F.col("node").alias("c"), "component_id")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "c", "left").join(component, "c", "left")
    of_class = of_class.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    # rows without a vector to compare find none
    known = rows.select("id", F.when(F.coalesce(valid, F.lit(False)), F.col("v")).alias("v"))
    found_rows = known.where("v is not null").join(of_class, "v").select("id", "n_links", "component_id")
    out = found_rows.union(known.where("v is null").select("id", F.lit(0).cast("long"), "id"))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
