"""Connected components of a graph given by its edges, without bringing a component together."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import stored

#: Edges joined at once inside a task, and edges that one task may join by itself (16 bytes each).
_EDGES, ONE_TASK = 1 << 20, 2_000_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars with the components of the edges (a, b): each vertex with the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)].astype(np.int64), at[len(a) :].astype(np.int64)
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = low != high
        if not live.any():
            break
        x, y, low, high = x[live], y[live], low[live], high[live]
        np.minimum.at(root, high, low)
        while True:  # pointers jump until they rest
            up = root[root]
            if (up == root).all():
                break
            root = up
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _stars(batches):
    """Edges of a task as stars, in portions of bounded size."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        n += batch.num_rows
        if n >= _EDGES:
            a, b = forest(*np.concatenate(held, axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held, n = [], 0
    if n:
        a, b = forest(*np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _whole(batches):
    """(v, root) for all vertices of all edges."""
    held = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if held:
        a, b = np.concatenate(held, axis=1)
        v, root = forest(a, b)
        roots = np.setdiff1d(np.concatenate([a, b]), v)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([v, roots])), pa.array(np.concatenate([root, roots]))], ["v", "root"])


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(v, root) for each vertex of `edges` (columns a, b of type long, stored: they are read twice); root is the smallest vertex of the component.

    Up to ONE_TASK edges, which is checked, are joined by one task. Beyond, each round turns edges into stars inside tasks and then applies the large-star and small-star steps; both only need the minimum of a
    vertex's neighbours, which is aggregated before the shuffle. That ends when nothing changes. No edges give no rows; loops and
    repeated edges do no harm; edges with a null end are ignored.
    """
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if now.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return stored(now.coalesce(1).mapInArrow(_whole, "v long, root long"))
    loops = now.where("a = b").select("a")
    now = now.where("a <> b").mapInArrow(_stars, "a long, b long")
    now = stored(now.distinct())
    seen = None
    for _ in range(most):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("m"))
        large = both.join(low, F.col("a") == F.col("u")).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()  # edges (larger, smaller)
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(low, F.col("a") == F.col("u"))
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("u", "m"))
        now = stored(small.mapInArrow(_stars, "a long, b long").distinct())
    else:
        raise RuntimeError("the components didn't settle")
    ends = now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), (F.col("b") + 0).alias("root")))
    ends = ends.union(loops.select(F.col("a").alias("v"), (F.col("a") + 0).alias("root")))
    return ends.groupBy("v").agg(F.min("root").alias("root"))
