"""Connected components, with DataFrame operations only or with a contraction inside each task before them.

Native rounds alternate large-star and small-star steps. Each step needs a node's least neighbour, which is an aggregate
with partial sums on the map side, and a join on the node, whose hot keys adaptive execution can split; no group of
neighbours is gathered. A contraction replaces the edges of one task, whose number is bounded (``TASK``), by a star around
the least node of each of their components; a graph that fits in one task is done with it. The edges of each round are
written by checkpoint() to the shared folder, so lineage stays short and lost executors cost no more than a round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.session import shared_dir, ship

ROUNDS = 60
#: Edges that a task contracts; rows that are worth a partition of their own.
TASK, ROWS = 1 << 20, 1 << 18


def compact(rows: DataFrame, per: int = ROWS) -> DataFrame:
    """rows by checkpoint(), in no more partitions than their number asks for (a table of few rows is read by few tasks)."""
    held = rows.checkpoint()
    return held.coalesce(max(1, -(-held.count() // per)))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges u, v but the least of its component, and that least node."""
    ids, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, to = place[: len(u)], place[len(u) :], np.arange(len(ids))
    while True:
        x, y = to[a], to[b]
        open_edges = np.flatnonzero(x != y)
        if not len(open_edges):
            break
        a, b, x, y = a[open_edges], b[open_edges], x[open_edges], y[open_edges]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while (to[to] != to).any():
            to = to[to]
    other = np.flatnonzero(to != np.arange(len(ids)))
    return ids[other], ids[to[other]]


def _contract(batches):
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, rounds: int = ROUNDS, native: bool = True) -> DataFrame:
    """node, component for each node of an edge between two different nodes; component: the least node reachable.

    edges: two columns of one ordered type (long if not native), in any direction, repeated or not; rows with a null are no edges.
    """
    shared_dir(edges.sparkSession)
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    if native:
        now = now.distinct().checkpoint()
    else:
        ship(edges.sparkSession)
        now = compact(now, TASK)
    before, alone = None, False
    for _ in range(rounds):
        if not native:
            alone = now.rdd.getNumPartitions() == 1
            now = compact(now.mapInArrow(_contract, "u long, v long"), TASK)
            if alone:
                break
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        now = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = now if native else compact(now, TASK)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    found = now if alone else now.groupBy("u").agg(F.min("v").alias("v"))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component")).union(found.select("v", "v").distinct())
