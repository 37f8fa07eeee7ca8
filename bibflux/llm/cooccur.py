"""Items that appear together: pair counts and how far they exceed chance.

Equal baskets are counted once with a weight before anything is paired, so a basket that a third of all
records repeat costs as much as one. Baskets of up to ``chunk`` items make their pairs inside their row.
Larger ones are cut into chunks of that many items, a row each; every two chunks of a basket are one unit of work, and the units, numbers
at first, get their two chunks by equality joins that spread them over all tasks. So no task ever holds all pairs of a huge basket, and no row more than two chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.let import let
from bibflux.session import written


def _pairs_within(items: Column) -> Column:
    """All (a, b) of a sorted array with a before b."""
    after = lambda all_, i: F.slice(all_, i + 2, F.size(all_))
    pairs = lambda all_: F.transform(all_, lambda a, i: F.transform(after(all_, i), lambda b: F.struct(a.alias("item_a"), b.alias("item_b"))))
    return F.flatten(let(items, pairs))


def _pairs_between(left: Column, right: Column) -> Column:
    pair = lambda a, b: F.struct(F.least(a, b).alias("item_a"), F.greatest(a, b).alias("item_b"))
    return F.flatten(let(right, lambda all_: F.transform(left, lambda a: F.transform(all_, lambda b: pair(a, b)))))


def pair_associations(baskets: DataFrame, items: str = "items", n_records: DataFrame | None = None, min_pairs: int = 1, chunk: int = 64) -> DataFrame:
    """Rows ``(item_a, item_b, n_ab, n_a, n_b, n, lift, pmi)`` with item_a < item_b.

    ``baskets`` has one row per record with the array column ``items``; repeated items of a record count once,
    null items not at all, null and empty arrays give no pair. ``n`` counts the records with at least one item, or is the
    single value of ``n_records``. ``lift`` is n_ab * n / (n_a * n_b), ``pmi`` its binary logarithm. Pairs in fewer than
    ``min_pairs`` records are left out. Other columns are ignored; no basket gives no row.
    """
    col = F.col(f"`{items}`")
    own = baskets.select(F.sort_array(F.array_distinct(F.filter(col, lambda x: x.isNotNull()))).alias("_items")).filter(F.size("_items") > 0)
    own = written(own.groupBy("_items").agg(F.count(F.lit(1)).alias("_w")))  # read four times below
    counts = own.select(F.explode("_items").alias("item"), "_w").groupBy("item").agg(F.sum("_w").alias("n_item"))
    if n_records is None:
        n_records = own.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("n"))
    small = own.filter(F.size("_items") <= chunk).select("_w", F.explode_outer(_pairs_within(F.col("_items"))).alias("_p"))
    big = own.filter(F.size("_items") > chunk).withColumn("_m", F.ceil(F.size("_items") / chunk).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("_m") - 1), lambda i: F.slice("_items", i * chunk + 1, F.lit(chunk)))
    chunks = big.select(F.struct(F.xxhash64("_items"), F.hash("_items"), F.size("_items")).alias("_b"), "_w", "_m", F.posexplode(cut).alias("_i", "_c"))
    other = chunks.select("_b", F.col("_i").alias("_j"), F.col("_c").alias("_d"))
    units = chunks.select("_b", "_i", F.explode(F.sequence(F.col("_i"), F.col("_m") - 1)).alias("_j"))
    units = units.join(other, ["_b", "_j"]).join(chunks.select("_b", "_i", "_w", "_c"), ["_b", "_i"])
    large = units.select("_w", F.explode_outer(F.when(F.col("_i") == F.col("_j"), _pairs_within(F.col("_c"))).otherwise(_pairs_between(F.col("_c"), F.col("_d")))).alias("_p"))
    pairs = small.unionByName(large).filter(F.col("_p").isNotNull()).groupBy("_p.item_a", "_p.item_b").agg(F.sum("_w").alias("n_ab")).filter(F.col("n_ab") >= min_pairs)
    a = counts.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = counts.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    n = int(n_records.first()[0])
    out = pairs.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(n).cast("long"))
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return out.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift.alias("lift"), F.log2(lift).alias("pmi"))
