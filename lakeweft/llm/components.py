"""Connected components of an edge table, without collecting links anywhere.

``contract`` shrinks the edges that one task holds to stars; ``components`` alternates
the large-star and small-star steps of Kiveris et al. (2014) on what is left.  Each step
is an aggregate with map-side combining and an equality join, so a node with very many
links is split by adaptive execution like any skewed join key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweft.llm.common import drop_written, written


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) equivalent to the given edges."""
    if not len(a):
        return a, b
    nodes, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ids[: len(a)], ids[len(a) :]
    label = np.arange(len(nodes))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def _least(pairs: DataFrame) -> DataFrame:
    """(w, m): the smallest neighbour of each node.

    Written before it is joined, so that both sides of the join are plain shuffles and
    adaptive execution can split a hub's rows over many tasks.
    """
    return written(pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)`` but the roots; root is the smallest node.

    Self-links and repeated links are harmless; an empty table gives an empty table.
    """
    high = lambda x, y: F.greatest(x, y).alias("u")
    low = lambda x, y: F.least(x, y).alias("v")
    stars = written(edges.where("u <> v").select(high("u", "v"), low("u", "v")).distinct(), "edges")
    mark = _mark(stars)
    while mark[0]:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both)
        large = written(both.join(least, both["u"] == least["w"]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "edges")
        first = _least(large)
        small = large.join(first, large["u"] == first["w"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        for done in (stars, least, large, first):
            drop_written(done)
        stars, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
