"""Duplicate records by fuzzy title: pairs, groups, representatives, what was discarded, and enrichment.

The title join loses nothing: titles are collapsed to distinct ones and cut into tiles by length; tiles whose lengths can meet are compared
in one task each, all titles whose letters sum up to nearly the same along an axis, by a word of letter counts, in which each edit changes two bits
at most. Titles made alike share most of their words, so no index of parts is selective there; the letters of the whole title are. What they let pass
is tested exactly. The comparisons grow with the square of the distinct titles, at about one nanosecond for each pair of fitting lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.similarity import levenshtein_similarity
from bibflux.functions.text import normalize_title
from bibflux.operators.components import connected_components
from bibflux.schema import CANONICAL
from bibflux.session import written

DEFAULT_THRESHOLD = 0.92
#: The order of sources by which a representative is chosen.
PRIORITY = {"ScienceDirect": 3, "EBSCO": 2, "ACM": 1, "OpenAlex": 0}


def _edits(length, threshold: float):
    """Edits that a longer title of this length may have, an edge of rounding more; what decides is the similarity itself."""
    return np.floor(length * (1 - threshold) + 1e-6).astype(np.int64)


def _longest(length, threshold: float):
    """Length of the longest partner of a title as the shorter one."""
    return np.floor(length / threshold + 1e-6).astype(np.int64)


#: Bits for the counts of blanks and of the letters a to z, 64 in all. Other characters count with these.
_WIDTHS = (3, 3, 2, 3, 3, 3, 2, 2, 2, 3, 1, 2, 2, 3, 3, 3, 2, 1, 3, 3, 3, 3, 2, 2, 2, 2, 1)
#: Columns for pairs of neighbouring characters.
_PAIRS = 101
#: Titles of one tile, and of the other, that are compared at once.
_ROWS, _CHUNK = 64, 1024


#: The column of each character.
_KINDS = np.arange(0x110000, dtype=np.int32) % 27
_KINDS[[32, *range(97, 123)]] = range(27)


def _rings() -> np.ndarray:
    """For each letter and count the bits of a signature in which they show."""
    rings, at = np.zeros((27, 256), dtype=np.uint64), 0
    for letter, width in enumerate(_WIDTHS):
        for j in range(width):
            rings[letter] |= ((np.arange(256) + j) // width % 2).astype(np.uint64) << np.uint64(at)
            at += 1
    return rings


_RINGS = _rings()


def _counts(titles: list[str], n: np.ndarray) -> np.ndarray:
    """For each title, none of them empty, how often it has each letter, in 27 columns, then the pairs of neighbours, in columns by their hash."""
    cp = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    pair = (cp[:-1] * np.int32(31) + cp[1:] * np.int32(1009)) % np.int32(_PAIRS)
    pair[np.cumsum(n)[:-1] - 1] = _PAIRS  # of two titles
    counts = np.empty((len(n), 27 + _PAIRS), dtype=np.uint8)
    counts[:, :27] = np.minimum(np.bincount(row * np.int32(27) + _KINDS[cp], minlength=27 * len(n)).reshape(-1, 27), 255)
    counts[:, 27:] = np.minimum(np.bincount(row[:-1] * np.int32(_PAIRS + 1) + pair, minlength=(_PAIRS + 1) * len(n)).reshape(-1, _PAIRS + 1)[:, :_PAIRS], 255)
    return counts


def _signatures(counts: np.ndarray) -> np.ndarray:
    """A word of 64 bits for each title in which one more of a letter changes one bit (its bits are a ring that fills and empties)."""
    words = _RINGS[0][counts[:, 0]]
    for letter in range(1, 27):
        words |= _RINGS[letter][counts[:, letter]]
    return words


def _axis(counts: np.ndarray) -> np.ndarray:
    """1 or -1 for each letter, so that the sums over a title's letters lie far apart."""
    some = counts[:: -(-len(counts) // 4096), :27].astype(np.float64)
    some -= some.mean(axis=0)
    return np.where(np.linalg.eigh(some.T @ some)[1][:, -1] < 0, -1, 1).astype(np.int16)


class _Tile:
    """Titles of one tile, with their ids, in the order of their lengths and sums along ``axis`` (default: the tile's own)."""

    def __init__(self, titles: pa.Array, ids: pa.Array, axis: np.ndarray | None = None):
        n = np.asarray(pc.utf8_length(titles), dtype=np.int64)
        counts = np.concatenate([_counts(titles[k : k + 8192].to_pylist(), n[k : k + 8192]) for k in range(0, len(n), 8192)])
        self.axis = _axis(counts) if axis is None else axis
        sums = counts[:, :27] @ self.axis
        order = np.lexsort((sums, n))
        self.n, self.sums, self.counts, self.titles, self.ids = n[order], sums[order].astype(np.int64), counts[order], titles.take(pa.array(order)), ids.take(pa.array(order))
        self.words = _signatures(self.counts)


def _allowed(a: _Tile, b: _Tile, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The candidates whose letters and pairs of neighbours differ in no more places than the edits explain."""
    k, d = _edits(b.n[j], threshold), b.n[j] - a.n[i]
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 4096):
        s = slice(at, at + 4096)
        x, y = a.counts[i[s]], b.counts[j[s]]
        apart = np.maximum(x, y) - np.minimum(x, y)
        keep[s] = (apart[:, :27].sum(axis=1, dtype=np.int64) <= 2 * k[s] - d[s]) & (apart[:, 27:].sum(axis=1, dtype=np.int64) <= 4 * k[s] - d[s])
    return i[keep], j[keep]


def _near(a: _Tile, b: _Tile, threshold: float, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``a`` and ``b`` of titles whose counts allow that they are alike, the one of ``b`` not shorter (``strict``: longer); of a tile with itself, each pair once.

    An edit changes the count of one letter by one, or of two if it is a replacement, and removes two pairs of neighbours and adds two, one less if it
    changes the length; so k edits that make up a difference of d letters change letters, and their sum along an axis, by 2 k - d and pairs by 4 k - d at most.
    """
    left, right, held = [], [], 0
    x, c, ok = np.empty(_ROWS * _CHUNK, np.uint64), np.empty(_ROWS * _CHUNK, np.uint8), np.empty(_ROWS * _CHUNK, bool)
    eights, eight = ok.view(np.uint64), np.arange(8)  # answers are looked through by eights, since few are yes
    lengths, starts = np.unique(b.n, return_index=True)
    spans = list(zip(lengths.tolist(), starts.tolist(), [*starts[1:].tolist(), len(b.n)]))
    for n in np.unique(a.n).tolist():
        first, last = np.searchsorted(a.n, [n, n + 1]).tolist()
        near = [(from_, to, int(2 * _edits(m, threshold) - (m - n))) for m, from_, to in spans if n + strict <= m <= _longest(n, threshold)]
        for top in range(first, last, _ROWS):
            end = min(top + _ROWS, last)
            rows = a.words[top:end, None]
            for from_, to, most in near:
                low, high = (from_ + np.searchsorted(b.sums[from_:to], [a.sums[top] - most, a.sums[end - 1] + most + 1])).tolist()
                if a is b:
                    low = max(low, top + 1)
                for at in range(low, high, _CHUNK):
                    wide = min(_CHUNK, high - at)
                    size = (end - top) * wide
                    shape = (end - top, wide)
                    np.bitwise_xor(rows, b.words[at : at + wide], out=x[:size].reshape(shape))
                    np.bitwise_count(x[:size], out=c[:size])
                    np.less_equal(c[:size], min(most, 64), out=ok[:size])
                    ok[size : -(-size // 8) * 8] = False
                    some = np.flatnonzero(eights[: -(-size // 8)] != 0)
                    if some.size:
                        found = (some[:, None] * 8 + eight).ravel()
                        i, j = np.divmod(found[ok[found]], wide)
                        i, j = i + top, j + at
                        if a is b and at < end:
                            i, j = i[i < j], j[i < j]
                        left.append(i)
                        right.append(j)
                        held += len(i)
            if held >= 50_000:
                yield _allowed(a, b, np.concatenate(left), np.concatenate(right), threshold)
                left, right, held = [], [], 0
    if held:
        yield _allowed(a, b, np.concatenate(left), np.concatenate(right), threshold)


def _met(threshold: float):
    """For ``mapInArrow`` over rows ``(place, title, id)`` in the order of their places: the candidates of each pair of tiles."""

    def pairs(sides: dict[int, tuple[list[pa.Array], list[pa.Array]]]) -> Iterator[pa.RecordBatch]:
        tiles = {}
        for side, parts in sides.items():
            tiles[side] = _Tile(*map(pa.concat_arrays, parts), *(x.axis for x in tiles.values()))
        turns = [(tiles[0], tiles[0], False)] if sides.keys() == {0} else [(tiles[0], tiles[1], False), (tiles[1], tiles[0], True)] if len(sides) == 2 else []
        for a, b, strict in turns:
            for i, j in _near(a, b, threshold, strict):
                for k in range(0, len(i), 100_000):
                    x, y = pa.array(i[k : k + 100_000]), pa.array(j[k : k + 100_000])
                    yield pa.RecordBatch.from_arrays([a.titles.take(x), a.ids.take(x), b.titles.take(y), b.ids.take(y)], ["title_a", "id_a", "title_b", "id_b"])

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.asarray(batch.column(0))
            ends = [*(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends], ends):
                pair, side = divmod(int(places[start]), 2)
                if pair != now:
                    yield from pairs(sides)
                    now, sides = pair, {}
                titles, ids = sides.setdefault(side, ([], []))
                titles.append(batch.column(1).slice(start, end - start))
                ids.append(batch.column(2).slice(start, end - start))
        yield from pairs(sides)

    return of_task


def _close(t: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``(title_a, id_a, title_b, id_b, similarity)`` of different titles of ``t(title, id)``, a written table of distinct titles, none empty; ``title_a`` is not the longer one."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    # bands of lengths, so that the longer title of a pair is in the band of the shorter one or in the next
    lengths = sorted((r[0], r[1]) for r in t.groupBy(F.length("title")).count().collect())
    total, starts, bands, sizes = sum(k for _, k in lengths), [1], {}, {}
    for n, k in lengths:  # a band ends with the longest partner of its shortest title
        while (following := int(_longest(starts[-1], threshold)) + 1) <= n:
            starts.append(following)
        bands[n] = band = len(starts)
        sizes[band] = sizes.get(band, 0) + k
    tile = max(1 << 14, min(1 << 17, total // 10), total // 100)
    tiles = {b: -(-k // tile) for b, k in sizes.items()}
    groups = sum(k * (k + 1) // 2 + k * tiles.get(b + 1, 0) for b, k in tiles.items())
    # places where the titles of each tile of a band are compared: the pair of tiles, those of a band numbered on into the next one, and a bit for the side
    place = lambda band, x, y, side: (((band << 20) + x << 20) + y) * 2 + side
    places = {}
    for b, own in tiles.items():
        before, after = tiles.get(b - 1, 0), tiles.get(b + 1, 0)
        places[b] = [
            [place(b, min(r, k), max(r, k), r > k) for k in range(own)] + [place(b, r, own + k, 0) for k in range(after)] + [place(b - 1, k, before + r, 1) for k in range(before)]
            for r in range(own)
        ]
    spark = t.sparkSession
    rows = pa.table({"n": pa.array(list(bands), pa.int32()), "places": pa.array([places[b] for b in bands.values()], pa.list_(pa.list_(pa.int64())))})
    met = t.join(F.broadcast(spark.createDataFrame(rows)), F.length("title") == F.col("n"))  # as many rows as lengths
    met = met.select(F.explode(F.get("places", F.pmod(F.xxhash64("title"), F.size("places")).cast("int"))).alias("place"), "title", "id")
    tasks = max(1, min(groups, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    kind = t.schema["id"].dataType.simpleString()
    met = met.repartition(tasks, F.shiftright("place", 1)).sortWithinPartitions("place").mapInArrow(_met(threshold), f"title_a string, id_a {kind}, title_b string, id_b {kind}")
    most = F.floor(F.length("title_b") * (1 - threshold) + 1e-6).cast("int")
    edits = F.call_function("levenshtein", F.col("title_a"), F.col("title_b"), most).bitwiseAND((1 << 30) - 1)  # -1, for more than these, becomes very many: one test, so that edits are counted once
    return met.withColumn("similarity", 1.0 - edits / F.length("title_b")).filter(F.col("similarity") >= threshold)


def similar_titles(titles: DataFrame, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Pairs ``(title_a, title_b, similarity)`` of different ``titles(title)`` with 1 - edits / longer length >= threshold.

    ``title_a`` is the shorter one (of equal length, the smaller). Repeated, null and empty titles are ignored.
    """
    met = _close(written(titles.select("title").filter("title <> ''").distinct().withColumn("id", F.lit(0))), threshold)
    swap = (F.length("title_a") == F.length("title_b")) & (F.col("title_a") > F.col("title_b"))
    return met.select(F.when(swap, F.col("title_b")).otherwise(F.col("title_a")).alias("title_a"), F.when(swap, F.col("title_a")).otherwise(F.col("title_b")).alias("title_b"), "similarity")


def titles_are_duplicate(a: Column, b: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Whether two titles are alike after normalisation; false if either is then empty or null."""
    x, y = normalize_title(a), normalize_title(b)
    return (x != "") & (y != "") & (levenshtein_similarity(x, y) >= threshold)


def duplicate_groups(df: DataFrame, key: str = "record_id", threshold: float = DEFAULT_THRESHOLD, strict_empty: bool = False) -> DataFrame:
    """Rows ``(key, group_id)`` for every record with a duplicate; ``group_id`` is the group's smallest key.

    Similarity carries over: a title like one of a group's joins the group. Records whose normalised title is empty are no duplicates of each
    other unless ``strict_empty``. Equal titles are one node however many records have them.
    """
    rows = df.select(F.col(key).alias("_id"), normalize_title(F.col("title")).alias("title"))
    if not strict_empty:
        rows = rows.filter("title <> ''")
    rows = written(rows)
    classes = written(rows.groupBy("title").agg(F.min("_id").alias("rep"), F.count(F.lit(1)).alias("_n")))
    edges = _close(classes.filter("title <> ''").select("title", F.col("rep").alias("id")), threshold)
    component = connected_components(edges, "id_a", "id_b").withColumnRenamed("id", "rep")
    grouped = classes.join(component, "rep", "left").filter("_n > 1 or component is not null").select("title", F.coalesce("component", "rep").alias("group_id"))
    return rows.join(grouped, "title").select(F.col("_id").alias(key), "group_id")


def record_score(columns: list[str]) -> Column:
    """Priority of the source times 1000, plus the fields that are not empty, plus the length of the abstract."""
    priority = F.coalesce(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))[F.col("source_db")], F.lit(0))
    filled = sum((F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int") for c in columns[1:]), F.coalesce(F.trim(F.col(columns[0])) != "", F.lit(False)).cast("int"))
    # normalised only where no letter or digit shows at once that something is left
    named = F.when(F.col("title").rlike("[A-Za-z0-9]"), 1).otherwise((normalize_title(F.col("title")) != "").cast("int"))
    return priority * 1000 + filled + named + F.length(F.coalesce("abstract", F.lit("")))


def representatives(df: DataFrame, groups: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows ``(group_id, kept_id)``: the record of the highest score of each group, of equals the smallest key."""
    scored = df.select(key, record_score(list(CANONICAL)).alias("_score")).join(groups, key)
    return scored.groupBy("group_id").agg(F.max_by(F.col(key), F.struct("_score", -F.col(key))).alias("kept_id"))


def unify(df: DataFrame, key: str = "record_id", threshold: float = DEFAULT_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The kept records (canonical columns and ``key``) and the discarded ones with ``kept_record_id, kept_title, kept_db``.

    A kept record without abstract gets the longest one of the OpenAlex records that were discarded for it.
    """
    groups = written(duplicate_groups(df, key, threshold))
    kept = written(representatives(df, groups, key))
    fate = groups.join(kept, "group_id").select(key, "kept_id")
    lost = fate.filter(F.col(key) != F.col("kept_id"))
    cols = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in CANONICAL]
    records = df.select(key, *cols)
    discarded = records.join(lost, key)
    holder = records.select(F.col(key).alias("kept_id"), F.col("title").alias("kept_title"), F.col("source_db").alias("kept_db"))
    duplicates = discarded.join(holder, "kept_id").select(key, *CANONICAL, F.col("kept_id").alias("kept_record_id"), "kept_title", "kept_db")
    spare = discarded.filter((F.col("source_db") == "OpenAlex") & (F.trim("abstract") != "")).select("kept_id", F.trim("abstract").alias("_a"), key)
    spare = spare.groupBy("kept_id").agg(F.max_by("_a", F.struct(F.length("_a"), -F.col(key))).alias("_spare"))
    unified = records.join(lost.select(key), key, "left_anti").join(spare.withColumnRenamed("kept_id", key), key, "left")
    abstract = F.when((F.trim("abstract") == "") & F.col("_spare").isNotNull(), F.col("_spare")).otherwise(F.col("abstract"))
    return unified.withColumn("abstract", abstract).select(key, *CANONICAL), duplicates
