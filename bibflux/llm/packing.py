"""Documents packed into containers of one fixed capacity, measured in tokens of a public tokenizer.

Documents are dealt to partitions at random and each partition runs best-fit decreasing. Dual feasible functions
give a lower bound of the containers its documents need: a partition that meets it is certified optimal. Partitions with a gap
keep their containers that are full; the documents of their others go into a common pool, are dealt anew and packed again, until all
partitions are certified or an exchange saves no container. Sizes only move as numbers; the texts are read once, to count their tokens.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.session import written

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of byte-level BPE vocabularies of this family.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest run that goes to the tokenizer at once; its time grows faster than the length of a run without a break.
_RUN = 20_000
_loaded: dict = {}


def _encoder(path: str):
    """The tokenizer of a vocabulary file, loaded once per worker."""
    if path not in _loaded:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
            _loaded[path] = lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = True
            _loaded[path] = lambda texts: [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _loaded[path]


def _stretches(text: str) -> list[str]:
    """Cuts before blanks, at least every ``_RUN`` characters, so that no stretch is too long for the tokenizer."""
    out, start = [], 0
    while len(text) - start > _RUN:
        end = text.rfind(" ", start + 1, start + _RUN)
        end = end if end > start else start + _RUN
        out.append(text[start:end])
        start = end
    return [*out, text[start:]]


def token_count(path: str = DEFAULT_TOKENIZER):
    """A pandas UDF ``string -> long``: tokens of a text; 0 for null and empty."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(path)
        for texts in batches:
            parts, owner = [], []
            for k, t in enumerate(texts):
                for p in _stretches(t) if t else ():
                    parts.append(p)
                    owner.append(k)
            n = np.bincount(owner, encode(parts), len(texts)) if parts else np.zeros(len(texts))
            yield pd.Series(n.astype("int64"))

    return count


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Containers that ``sizes`` (each 1 to capacity, ``counts`` times) need at least: the best of two families of dual feasible functions.

    The first sets sizes above capacity - a to the capacity and drops those below a, for every a up to half of it; the second
    rounds x to floor((k + 1) x / capacity) / k unless (k + 1) x is a multiple of the capacity.
    """
    if not len(sizes):
        return 0
    n = np.bincount(sizes, counts, minlength=capacity + 1).astype(np.int64)
    total = np.cumsum(n * np.arange(capacity + 1))
    count = np.cumsum(n)
    best = -(-int(total[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    above = count[-1] - count[capacity - a]
    middle = total[capacity - a] - total[a - 1]
    best = max(best, int((above + -(-middle // capacity)).max())) if len(a) else best
    values = np.flatnonzero(n)
    for k in range(2, 41):
        x = (k + 1) * values
        scaled = np.where(x % capacity == 0, values * k, (x // capacity) * capacity)  # times k * capacity
        best = max(best, -(-int((scaled * n[values]).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each size: largest first, each into the fullest container that has room."""
    order = np.argsort(-sizes, kind="stable")
    out = np.zeros(len(sizes), np.int64)
    rooms: list[int] = []  # distinct rooms in order
    by_room: dict[int, list[int]] = {}
    n = 0
    for k in order:
        size = int(sizes[k])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bin_, room = n, capacity
            n += 1
        else:
            room = rooms[at]
            bin_ = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        out[k] = bin_
        if left := room - size:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(bin_)
    return out


def _pack_partition(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_tokens", "_doc", "_piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["_tokens"].to_numpy(np.int64)
        bins = best_fit_decreasing(sizes, capacity)
        fill = np.bincount(bins, sizes)
        bound = lower_bound(sizes, capacity)
        return pdf.assign(_bin=bins, _bins=len(fill), _bound=bound, _done=(len(fill) == bound) | (fill[bins] == capacity))

    return pack


def pack_documents(df: DataFrame, key: str, text: str, capacity: int = 2048, tokenizer: str = DEFAULT_TOKENIZER, per_partition: int = 20_000) -> DataFrame:
    """Rows ``(key, piece, token_start, n_tokens, container_id, certified)``: every token of every document in one container.

    A document of at most ``capacity`` tokens is one piece; a longer one is cut into pieces of ``capacity`` and a rest. ``key`` is unique.
    ``certified`` tells whether the container is full or one of a partition that needs no fewer. Null and empty texts have no tokens and get no row; other columns are ignored; an
    empty table gives none. The same input gives the same containers in every run.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = df.select(F.col(f"`{key}`").alias("_doc"), token_count(tokenizer)(F.col(f"`{text}`")).alias("_n")).filter("_n > 0")
    last_piece = F.floor((F.col("_n") - 1) / capacity).cast("int")
    pieces = sized.select("_doc", "_n", F.explode(F.sequence(F.lit(0), last_piece)).alias("_piece"))
    start = F.col("_piece").cast("long") * capacity
    pieces = written(pieces.select("_doc", "_piece", start.alias("_start"), F.least(F.lit(capacity).cast("long"), F.col("_n") - start).alias("_tokens")))
    whole = F.col("_tokens") == capacity
    columns = ("_doc", "_piece", "_start", "_tokens")
    out = pieces.filter(whole).select(*columns, F.concat_ws("-", F.lit("w"), F.col("_doc").cast("string"), F.col("_piece").cast("string")).alias("_container"), F.lit(True).alias("_sure"))
    pool = pieces.filter(~whole)
    key_type = df.schema[key].dataType.simpleString()
    schema = f"_doc {key_type}, _piece int, _start long, _tokens long, _part long, _bin long, _bins long, _bound long, _done boolean"
    best = None  # containers of the pool in the last round
    r = 0
    while n := pool.count():
        parts = -(-n // per_partition)
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64("_doc", "_piece", F.lit(r)), F.lit(parts)))
        packed = written(dealt.groupBy("_part").applyInPandas(_pack_partition(capacity), schema))
        now = packed.select("_part", "_bin").distinct().count()
        last = parts == 1 or (best is not None and now >= best)
        container = F.concat_ws("-", F.lit(f"r{r}"), F.col("_part").cast("string"), F.col("_bin").cast("string"))
        out = out.unionByName((packed if last else packed.filter("_done")).select(*columns, container.alias("_container"), F.col("_done").alias("_sure")))
        if last:
            break
        pool = packed.filter("not _done").select(*columns)
        best = packed.filter("not _done").select("_part", "_bin").distinct().count()
        r += 1
    return out.select(F.col("_doc").alias(key), F.col("_piece").alias("piece"), F.col("_start").alias("token_start"), F.col("_tokens").alias("n_tokens"), F.col("_container").alias("container_id"), F.col("_sure").alias("certified"))


def certificate(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row ``(n_pieces, n_containers, bound, gap, fill)`` of a packing: its containers, how many any packing of all its pieces needs at least, and how full they are.

    Only the number of pieces of each size reaches the driver, at most ``capacity`` numbers.
    """
    sizes = packed.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = packed.select("container_id").distinct().count()
    bound = lower_bound(sizes["n_tokens"].to_numpy(np.int64), capacity, sizes["n"].to_numpy(np.int64))
    tokens = int((sizes["n_tokens"] * sizes["n"]).sum()) if len(sizes) else 0
    row = (int(sizes["n"].sum()) if len(sizes) else 0, n, int(bound), n - int(bound), tokens / (n * capacity) if n else 1.0)
    return packed.sparkSession.createDataFrame([row], "n_pieces long, n_containers long, bound long, gap long, fill double")
