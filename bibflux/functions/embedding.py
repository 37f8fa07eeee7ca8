"""Vectors: pluggable encoders, means, and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def encoder(load: Callable[[], Callable[[list[str]], np.ndarray]]):
    """A pandas UDF ``string -> array<float>`` around any sentence encoder; ``load`` runs once per worker and batch stream."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(list(np.asarray(model(texts.fillna("").tolist()), np.float32)))

    return encode


def mean_by(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Rows ``(group, pos, mean)``: the mean of each place of the vectors of a group; positions from 1."""
    rows = df.select(group, F.posexplode(vector).alias("_p", "_x"))
    return rows.groupBy(group, (F.col("_p") + 1).cast("int").alias("pos")).agg(F.avg(F.col("_x").cast("double")).alias("mean"))


def text_vectors(words: DataFrame, key: str, word: str, vectors: DataFrame, vector: str) -> DataFrame:
    """Rows ``(key, vector)``: the mean of the vectors of a text's words, each as often as it stands there; words without a vector do not count, texts of none have no row.

    ``words(key, word)`` has a row per word of a text, ``vectors(word, vector)`` one per known word.
    """
    known = words.select(key, F.col(word).alias("_w")).join(vectors.select(F.col(word).alias("_w"), F.col(vector).alias("_v")), "_w")
    means = known.select(key, F.posexplode("_v").alias("_p", "_x")).groupBy(key, "_p").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda s: s["_m"]).alias(vector))


def nearest(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int = 5, block: int = 4096) -> DataFrame:
    """Rows ``(query_id, neighbour_id, cosine)``: the ``k`` vectors of highest cosine for each query, itself left out; ties by smaller id.

    Exact. Queries are sent in blocks of at most ``block``; each task keeps its best ``k`` per query, so only those are shuffled. Null and
    zero vectors have no neighbours and are none.
    """
    clean = lambda d: d.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("v").isNotNull())
    wanted = clean(queries)
    n = wanted.count()
    out = None
    blocks = max(1, -(-n // block))
    for b in range(blocks):
        part = wanted.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        found = clean(vectors).mapInPandas(_best(part, k), "query_id long, neighbour_id long, cosine double")
        best = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cosine")).alias("d"), F.col("neighbour_id").alias("i")))), 1, k).alias("_l"))
        rows = best.select("query_id", F.explode("_l").alias("_s")).select("query_id", F.col("_s.i").alias("neighbour_id"), (-F.col("_s.d")).alias("cosine"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _best(part: pd.DataFrame, k: int):
    def unit(m: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not len(part):
            return
        ids, q = part["id"].to_numpy(), unit(np.stack(part["v"].to_numpy()).astype(np.float64))
        for batch in batches:
            if not len(batch):
                continue
            own, v = batch["id"].to_numpy(), unit(np.stack(batch["v"].to_numpy()).astype(np.float64))
            order = np.argsort(own, kind="stable")
            own, v = own[order], v[order]
            s = q @ v.T
            s[(ids[:, None] == own[None, :]) | np.isnan(s)] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(ids)), top.shape[1])
            cols = top.ravel()
            keep = np.isfinite(s[rows, cols])
            yield pd.DataFrame({"query_id": ids[rows[keep]], "neighbour_id": own[cols[keep]], "cosine": s[rows[keep], cols[keep]]})

    return run
