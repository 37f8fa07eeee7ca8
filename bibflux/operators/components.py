"""Connected components of an edge table: the transitive closure that duplicate groups need.

Each task first reduces its own part of the edges to stars by union-find, which never gives more edges than it takes; alternating large-star
and small-star steps then rewire every node to the smallest node it can see. Both repeat until only stars are left, or so few edges that one task
reduces them all; the number of rounds grows with the logarithm of the longest chain, not with its length. Minima are found by aggregation (combined before the shuffle) and joined
back, so a node with very many edges is never gathered in one task. Every round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.session import written

#: So few edges are reduced by one task, which holds their nodes in memory (some 200 bytes each).
FEW_EDGES = 1_000_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of one task as edges from each node to the smallest node that these edges connect it to."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist()):
            a, b = root(u), root(v)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    rows = [(x, r) for x in parent if (r := root(x)) != x]
    for k in range(0, len(rows), 100_000):
        yield pd.DataFrame(rows[k : k + 100_000], columns=["u", "v"])


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller node, which has none itself."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(edges.select("v", F.lit(0), F.lit(1)))
    wrong = roles.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).filter("c > 1 or (c > 0 and p > 0)")
    return wrong.isEmpty()


def connected_components(edges: DataFrame, src: str, dst: str, few: int = FEW_EDGES) -> DataFrame:
    """Rows ``(id, component)`` for every node of an edge; ``component`` is the smallest id that is connected to it.

    Edges have no direction, may repeat and may join a node to itself; edges with a null end are ignored. Other columns are
    ignored; no edge gives no row. So ``few`` edges are left to one task.
    """
    pairs = written(edges.select(F.col(f"`{src}`").alias("u"), F.col(f"`{dst}`").alias("v")).filter("u is not null and v is not null"))
    schema = pairs.schema
    current = written(pairs.filter("u <> v").mapInPandas(_stars, schema))
    while (n := current.count()) > few and not _only_stars(current):
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("_m"))
        small = large.join(low, "u")
        small = small.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v")).union(low.select("u", F.col("_m").alias("v")))
        linked = small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        current = written(linked.mapInPandas(_stars, schema))
    if n <= few:
        current = written(current.coalesce(1).mapInPandas(_stars, schema))
    found = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = current.select("v", "v").union(pairs.filter("u = v").select("u", "v")).distinct()
    return found.union(roots.toDF("id", "component").join(found.select("id"), "id", "left_anti"))
