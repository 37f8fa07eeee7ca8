"""Hierarchical clustering of bounded document sets: linkages, cophenetic quality, flat clusters.

Merging is sequential, so each set is one group of ``applyInPandas``; many sets are clustered side by side. A set's distance matrix
is square, so sets are limited to ``max_docs`` documents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METHODS = ("complete", "average", "ward")


def linkage(distances: np.ndarray, method: str) -> list[tuple[int, int, float, int]]:
    """Merges ``(a, b, height, size)`` of a square matrix; new clusters are numbered from n on.

    Of equal distances the pair of the smallest numbers merges first. Ward merges squared distances; its heights are their roots.
    """
    n = len(distances)
    d = np.full((2 * n - 1, 2 * n - 1), np.inf)
    d[:n, :n] = distances**2 if method == "ward" else distances
    np.fill_diagonal(d, np.inf)
    size = np.zeros(2 * n - 1)
    size[:n] = 1
    alive = list(range(n))
    out = []
    for new in range(n, 2 * n - 1):
        sub = d[np.ix_(alive, alive)]
        upper = np.where(np.triu(np.ones_like(sub, bool), 1), sub, np.inf)
        i, j = divmod(int(np.argmin(upper)), len(alive))
        a, b = alive[i], alive[j]
        rest = [k for k in alive if k not in (a, b)]
        if method == "complete":
            row = np.maximum(d[a, rest], d[b, rest])
        elif method == "average":
            row = (size[a] * d[a, rest] + size[b] * d[b, rest]) / (size[a] + size[b])
        elif method == "ward":
            row = ((size[a] + size[rest]) * d[a, rest] + (size[b] + size[rest]) * d[b, rest] - size[rest] * d[a, b]) / (size[a] + size[b] + size[rest])
            row = np.maximum(row, 0)
        else:
            raise ValueError(f"unknown method {method}")
        height = float(np.sqrt(max(d[a, b], 0)) if method == "ward" else d[a, b])
        size[new] = size[a] + size[b]
        d[new, rest] = d[rest, new] = row
        out.append((a, b, height, int(size[new])))
        alive = [*rest, new]
    return out


def monotone(heights: list[float]) -> list[float]:
    """Heights that rise by at least 1e-10 where they would fall."""
    out: list[float] = []
    for h in heights:
        out.append(h if not out or h >= out[-1] else out[-1] + 1e-10)
    return out


def cophenetic(merges: list[tuple[int, int, float, int]], n: int) -> np.ndarray:
    """The height at which each two documents first share a cluster."""
    members = {i: [i] for i in range(n)}
    out = np.zeros((n, n))
    for k, (a, b, height, _) in enumerate(merges):
        out[np.ix_(members[a], members[b])] = height
        out[np.ix_(members[b], members[a])] = height
        members[n + k] = members.pop(a) + members.pop(b)
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson's; 0 where one does not vary."""
    x, y = x - x.mean(), y - y.mean()
    scale = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / scale) if scale > 0 else 0.0


def _cluster(max_docs: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["id_a"]) | set(pdf["id_b"]))
        n = len(ids)
        if n > max_docs:
            raise ValueError(f"{n} documents in one set; at most {max_docs} can be clustered together")
        at = {x: i for i, x in enumerate(ids)}
        matrix = np.zeros((n, n))
        i, j = pdf["id_a"].map(at).to_numpy(), pdf["id_b"].map(at).to_numpy()
        matrix[i, j] = matrix[j, i] = pdf["distance"].to_numpy()
        upper = np.triu_indices(n, 1)
        rows = []
        for order, method in enumerate(METHODS):
            merges = linkage(matrix, method)
            heights = monotone([m[2] for m in merges])
            merges = [(a, b, h, s) for (a, b, _, s), h in zip(merges, heights)]
            quality = 1.0 if n == 2 else correlation(matrix[upper], cophenetic(merges, n)[upper])
            rows += [(pdf["set_id"].iloc[0], method, order, step, a, b, h, s, quality) for step, (a, b, h, s) in enumerate(merges)]
        return pd.DataFrame(rows, columns=["set_id", "method", "method_order", "step", "a", "b", "dist", "size", "cophenetic"])

    return run


def hierarchical(distances: DataFrame, max_docs: int = 2000) -> DataFrame:
    """Rows ``(set_id, method, method_order, step, a, b, dist, size, cophenetic)`` of all three linkages of each set.

    ``distances(set_id, id_a, id_b, distance)`` holds every pair of a set once. Documents are numbered in the order of their ids; heights are
    made monotone; ``cophenetic`` is the correlation of merge heights with distances. Sets of one document have no pair and no row.
    """
    schema = "set_id long, method string, method_order int, step int, a int, b int, dist double, size int, cophenetic double"
    return distances.select(F.col("set_id").cast("long"), "id_a", "id_b", "distance").groupBy("set_id").applyInPandas(_cluster(max_docs), schema)


def scores(merges: DataFrame) -> DataFrame:
    """Rows ``(set_id, method, method_order, cophenetic)``."""
    return merges.groupBy("set_id", "method", "method_order").agg(F.max("cophenetic").alias("cophenetic"))


def best_method(merges: DataFrame) -> DataFrame:
    """Rows ``(set_id, method, cophenetic, quality)``: the best linkage of each set, of equals the first."""
    best = scores(merges).groupBy("set_id").agg(F.max_by("method", F.struct("cophenetic", -F.col("method_order"))).alias("method"), F.max("cophenetic").alias("cophenetic"))
    return best.withColumn("quality", quality_label(F.col("cophenetic")))


def quality_label(c: Column) -> Column:
    return F.when(c >= 0.9, "excellent").when(c >= 0.75, "good").when(c >= 0.6, "acceptable").otherwise("weak")


def last_merges(merges: DataFrame, p: int) -> DataFrame:
    """The last ``p`` merges of each linkage, as a truncated dendrogram shows them."""
    ends = merges.groupBy("set_id", "method").agg(F.max("step").alias("_last"))
    return merges.join(ends, ["set_id", "method"]).filter(F.col("step") > F.col("_last") - p).drop("_last")


def flat_clusters(merges: DataFrame, share: float = 0.7) -> DataFrame:
    """Rows ``(set_id, method, doc, cluster)``: documents joined below ``share`` of the greatest height; ``cluster`` is its smallest number."""

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("step")
        n = len(pdf) + 1
        limit = share * pdf["dist"].max()
        members = {i: [i] for i in range(n)}
        label = list(range(n))
        for k, (a, b, h) in enumerate(zip(pdf["a"], pdf["b"], pdf["dist"])):
            members[n + k] = sorted(members.pop(a) + members.pop(b))
            if h <= limit:
                for m in members[n + k]:
                    label[m] = members[n + k][0]
        return pd.DataFrame({"set_id": pdf["set_id"].iloc[0], "method": pdf["method"].iloc[0], "doc": range(n), "cluster": label})

    return merges.groupBy("set_id", "method").applyInPandas(cut, "set_id long, method string, doc int, cluster int")
