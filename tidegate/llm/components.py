"""Connected components of links, by alternating star operations on tables of links."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(x: np.ndarray, y: np.ndarray, number: int) -> list[tuple[int, int]]:
    """Links ``(x, y)`` between ``number`` nodes that connect what all of them connect."""
    parent = list(range(number))
    kept = []
    for a, b in zip(x.tolist(), y.tolist()):
        i, j = a, b
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        while parent[j] != j:
            parent[j] = parent[parent[j]]
            j = parent[j]
        if i != j:
            parent[max(i, j)] = min(i, j)
            kept.append((a, b))
    return kept


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of the links ``(a, b)``: the smallest node it reaches.

    Every round hangs the larger neighbours of each node on its smallest one, then its smaller
    ones. The rounds grow with the logarithm of the longest path. Each ends with a checkpoint in
    the shared folder. A node with very many links is a skewed join key, which adaptive execution
    splits; its minimum is reduced before the shuffle. Links with a null end are left out.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("a IS NOT NULL AND b IS NOT NULL AND u != v")
        .distinct()
        .checkpoint()
    )
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = _small_star(_large_star(edges)).checkpoint()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    rest = edges.join(least, "u").filter("v != m")
    return least.select("u", F.col("m").alias("v")).union(rest.select("v", "m")).distinct()
