"""Union-find over edges that are spread over a cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition: each vertex is tied to the smallest it reaches there."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (y := up.setdefault(root, root)) != root:
            root = y
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    rows = [(x, find(x)) for x in list(up)]
    rows = [(x, r) for x, r in rows if x != r]
    yield pd.DataFrame({"u": pd.Series([x for x, _ in rows], dtype="int64"), "v": pd.Series([r for _, r in rows], dtype="int64")})


def sum_of(edges: DataFrame) -> tuple:
    """The number of edges and a sum of their hashes: equal for equal edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of edges (u, v long): the smallest id it reaches.

    Each partition is first thinned to a union-find forest, which bounds what is shuffled by the
    number of vertices. Rounds of large-star and small-star then tie each vertex to smaller ones
    until nothing changes; every round is a combinable min and a join, so a hub of many edges is
    pre-aggregated and its join can be split.
    """
    tied = written(edges.where("u <> v").mapInPandas(forest, "u long, v long"), "forest")
    while True:
        both = tied.unionByName(tied.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.where("u <> v").distinct(), "stars")
        if sum_of(new) == sum_of(tied):
            break
        tied = new
    roots = new.select("v").distinct()
    return new.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select(F.col("v").alias("id"), F.col("v").alias("component")))
