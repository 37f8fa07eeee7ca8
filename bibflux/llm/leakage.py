"""Evaluation texts that stand in a corpus: the q-gram lemma, bands of diagonals and banded alignment.

Texts are reduced to words. Two passages of m characters within e edits share at least m - q + 1 - e * q of their q-grams, all on diagonals (place in
the document minus place in the item) that differ by at most e. Of any e * q + 1 q-grams of such a passage they therefore share one. The corpus is streamed
through twice. The first time the q-grams that items have are counted, and of every passage of ``min_words`` words of an item the e * q + 1 rarest are chosen, so
that phrases which items and corpus have in common lead nowhere. The second time these are looked up in a bitmap of fixed size, and the stretches around
them meet their items in a join by q-gram. Where the two meet, all shared q-grams are counted in overlapping bands of diagonals, bands below the bound are
dropped, and a banded alignment decides. Items are never collected: what their number changes is the join, not the scan.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibflux.session import written

_IGNORED = re.compile("[­​‌‍⁠﻿]")
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|th|tr|table|h[1-6]|html|body|head|title|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_BROKEN = re.compile(r"-[ \t ]*(?:\r\n|\r|\n)[ \t ]*")
#: Letters in lower case and digits as they are, all other bytes blanks.
_PLAIN = bytes(c if chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + b" " * 128
#: Bits of the bitmap of the items' q-grams: a megabyte, whatever the number of items.
BITMAP_BITS = 1 << 23


def plain_text(text: str | None) -> bytes:
    """The runs of a-z and 0-9 of a text without case, accents, tags, entities, invisible signs and hyphenation, with one blank between two."""
    if not text:
        return b""
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _IGNORED.sub("", text)
    if "-" in text and ("\n" in text or "\r" in text):
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return b" ".join(text.encode("ascii", "replace").translate(_PLAIN).split())


def plain_words(text: str | None) -> list[str]:
    return plain_text(text).decode().split()


def codes(data: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram at each place; alignment decides later, so a collision costs time only."""
    n = max(0, len(data) - q + 1)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out *= np.uint64(0x100000001B3)
        out += data[k : k + n]
    return (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _known(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which q-grams a bitmap may hold: both bits of a q-gram that it holds are set."""
    shift = np.uint64(64 - (BITMAP_BITS.bit_length() - 1))
    at = np.flatnonzero(bits[(grams >> shift).astype(np.int64)])
    return at[bits[((grams[at] << np.uint64(64 - int(shift))) >> shift).astype(np.int64)]]


def _ends(plain: bytes) -> np.ndarray:
    """Where each word ends, with its blank."""
    data = np.frombuffer(plain, np.uint8)
    return np.append(np.flatnonzero(data == 32) + 1, len(data) + 1)


def _bounds(plain: bytes, min_words: int, q: int, edits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Of every passage of ``min_words`` words of an item the first q-gram and the one after the last, and how many q-grams the shortest keeps within the edits, one at least."""
    ends = _ends(plain)
    starts = np.append(0, ends[:-min_words])
    after = np.maximum(ends[min_words - 1 :] - 1 - q + 1, starts + 1)
    return starts, after, max(1, int((after - starts).min()) - edits * q)


def _item_grams(min_words: int, q: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                plain = plain_text(text)
                if plain.count(b" ") + 1 >= min_words and len(plain) >= q:
                    grams = codes(np.frombuffer(plain, np.uint8), q)
                    yield pd.DataFrame({"_item": item, "_gram": grams.astype(np.int64), "_place": np.arange(len(grams), dtype=np.int32)})

    return run


def _rarest(min_words: int, q: int, edits: int):
    """Of each item's q-grams those that are among the ``edits * q + 1`` rarest of a passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, text, grams, uses in zip(*(batch[c] for c in ("_item", "_item_text", "_grams", "_uses"))):
                starts, after, _ = _bounds(plain_text(text), min_words, q, edits)
                grams, uses = np.asarray(grams), np.asarray(uses)
                chosen = np.zeros(len(grams), bool)
                for a, b in zip(starts, after):
                    chosen[a + np.argsort(uses[a:b], kind="stable")[: edits * q + 1]] = True
                yield pd.DataFrame({"_item": item, "_gram": np.unique(grams[chosen]), "_span": int((after - starts).max()) + q})

    return run


#: Characters of documents that a worker turns into q-grams at a time.
_SLICE = 1 << 20


def _slices(batches: Iterator[pd.DataFrame], q: int) -> Iterator[tuple[list, list[bytes], np.ndarray, np.ndarray]]:
    """(keys, plain texts, where each begins, q-grams of all) of some documents at a time."""

    def done():
        base = np.cumsum([0, *(len(t) + q for t in texts)])
        return keys, texts, base, codes(np.frombuffer((b"\n" * q).join([*texts, b""]), np.uint8), q)

    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
            keys.append(key)
            texts.append(plain_text(text))
            size += len(texts[-1])
            if size >= _SLICE:
                yield done()
                keys, texts, size = [], [], 0
    if keys:
        yield done()


def _uses(packed: bytes, q: int):
    """How often each q-gram that the bitmap has occurs in the documents of a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        grams, uses = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def added(found: np.ndarray):
            both, at = np.unique(np.concatenate([grams, found]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([uses, np.ones(len(found), np.int64)]), len(both)).astype(np.int64)

        for _, _, _, all_grams in _slices(batches, q):
            grams, uses = added(all_grams[_known(all_grams, known)])
            if len(grams) > _SLICE:
                yield pd.DataFrame({"_gram": grams.astype(np.int64), "_n": uses})
                grams, uses = grams[:0], uses[:0]
        yield pd.DataFrame({"_gram": grams.astype(np.int64), "_n": uses})

    return run


def _stretches(packed: bytes, q: int, margin: int):
    """The stretches of documents around the q-grams that the bitmap has, with ``margin`` characters at either end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for keys, texts, base, grams in _slices(batches, q):
            at = _known(grams, known)
            if not len(at):
                continue
            doc, rows = np.searchsorted(base, at, side="right") - 1, []
            for part in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > margin) | (np.diff(doc) > 0)) + 1):
                d = int(doc[part[0]])
                places, text = at[part] - base[d], texts[d]
                low, high = max(0, int(places[0]) - margin), min(len(text), int(places[-1]) + q + margin)
                low = text.rfind(b" ", 0, low + 1) + 1
                high = len(text) if (end := text.find(b" ", high)) < 0 else end
                rows.append((keys[d], low, text[low:high].decode(), np.unique(grams[at[part]]).astype(np.int64)))
            yield pd.DataFrame(rows, columns=["_key", "_first", "_text", "_grams"])

    return run


def _numbers(text: str) -> np.ndarray:
    return np.array([hash(w) for w in text.split()], np.int64)


class _Item:
    """An item's words, its q-grams in order, and the bound for its bands."""

    def __init__(self, text: str, min_words: int, q: int, edits: int):
        plain = plain_text(text)
        self.words = _numbers(plain.decode())
        self.starts = np.append(0, _ends(plain)[:-1])
        grams = codes(np.frombuffer(plain, np.uint8), q)
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]
        self.least = _bounds(plain, min_words, q, edits)[2]

    def diagonals(self, starts: np.ndarray, grams: np.ndarray, edits: int) -> tuple[int, int] | None:
        """The outermost diagonals, in words, of the bands of a text's q-grams that meet the bound; None if no band does. ``starts``: of the text's words."""
        low, high = (np.searchsorted(self.grams, grams, side=side) for side in ("left", "right"))
        n = high - low
        at = np.repeat(np.arange(len(grams)), n)
        place = self.order[np.repeat(low, n) + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)]
        diagonal, width = at - place, 2 * (edits + 1)
        keep = np.zeros(len(at), bool)
        # two sets of bands, shifted by half a band: diagonals that differ by at most e share a band in one of them
        for shift in (0, width // 2):
            _, band = np.unique((diagonal + shift) // width, return_inverse=True)
            keep |= (np.bincount(band) >= self.least)[band]  # an item that repeats itself counts too high, which drops nothing
        if not keep.any():
            return None
        words = np.searchsorted(starts, at[keep], side="right") - np.searchsorted(self.starts, place[keep], side="right")
        return int(words.min()), int(words.max())


def banded_passages(item: np.ndarray, doc: np.ndarray, low: int, high: int, edits: int) -> list[int]:
    """For 0 to ``edits`` edits the longest passage of ``item``, in words, that stands in ``doc`` with so many word edits at most.

    Both are arrays of numbers that stand for words. The alignment stays on the diagonals (place in doc minus place in item) from ``low`` to ``high``. A passage begins and ends with equal words.
    """
    n, width = len(item), high - low + 1
    i, d = np.arange(n)[None, :], np.arange(width)[:, None]
    j = i + d + low
    equal = (j >= 0) & (j < len(doc))
    equal &= doc[np.clip(j, 0, len(doc) - 1)] == item[None, :]
    # words of the run of equal ones that ends here
    run = i + 1 - np.maximum.accumulate(np.where(equal, 0, i + 1), axis=1)
    best, state = [int(run.max(initial=0))], run
    # a run and the place before it are one segment; what an edit leaves anywhere in it can go on to its end
    segment = np.cumsum(~equal, axis=1) * (4 * n)
    for _ in range(edits):
        # an edit: a word replaced, one that the document lacks, one that it has besides
        p = np.pad(state, ((1, 1), (1, 0)))
        replaced, lacking, besides = p[1:-1, :-1], p[2:, :-1], p[:-2, 1:]
        edited = np.maximum(np.where(replaced > 0, replaced + 1, 0), np.maximum(np.where(lacking > 0, lacking + 1, 0), besides))
        carried = np.maximum.accumulate(segment + np.where(edited > 0, edited - i, -2 * n), axis=1) - segment
        ended = np.where(equal, np.maximum(run, np.pad(carried, ((0, 0), (1, 0)), constant_values=-2 * n)[:, :-1] + i), 0)
        state = np.maximum(state, np.maximum(edited, ended))
        best.append(max(best[-1], int(ended.max(initial=0))))
    return best


def _aligned(min_words: int, q: int, edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items: dict = {}
        last, starts, grams, words = None, None, None, None
        for batch in batches:
            rows = []
            for key, item, text, item_text in zip(*(batch[c] for c in ("_key", "_item", "_text", "_item_text"))):
                if item not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[item] = _Item(item_text, min_words, q, edits)
                if text != last:
                    data = np.frombuffer(text.encode(), np.uint8)
                    last, starts, grams, words = text, np.append(0, np.flatnonzero(data == 32) + 1), codes(data, q), _numbers(text)
                own = items[item]
                if (ends := own.diagonals(starts, grams, edits)) is None:
                    continue
                best = banded_passages(own.words, words, ends[0] - edits, ends[1] + edits, edits)
                if best[-1] >= min_words:
                    rows.append((key, item, best[-1], best[0], best[-1] / len(own.words)))
            if rows:
                yield pd.DataFrame(rows, columns=["_key", "_item", "n_words", "n_equal", "coverage"])

    return run


def _bitmap(grams: DataFrame) -> bytes:
    """Two bits for each q-gram; at most as many numbers as it has bits reach the driver."""
    bits = np.zeros(BITMAP_BITS, bool)
    n = BITMAP_BITS.bit_length() - 1
    both = F.array(F.shiftrightunsigned("_gram", 64 - n).cast("int"), F.shiftrightunsigned(F.shiftleft("_gram", n), 64 - n).cast("int"))
    bits[grams.select(F.explode(both).alias("b")).distinct().toPandas()["b"].to_numpy(np.int64)] = True
    return np.packbits(bits).tobytes()


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = 12, q: int = 12, edits: int = 1) -> DataFrame:
    """Rows ``(key, item_key, n_words, n_equal, coverage)`` for each document that holds ``min_words`` words of an item in a row, but for ``edits`` edits.

    ``n_words`` is the longest such passage, with at most so many words changed, ``coverage`` its share of the item's words, ``n_equal`` the longest one without any edit. Null and empty
    texts give no row, nor do items of fewer words; repeated documents and items each give their own rows. Other columns are ignored. Empty tables give no row.
    """
    key_type, item_type = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    own = items.select(F.col(f"`{item_key}`").alias("_item"), F.col(f"`{item_text}`").alias("_item_text")).filter(F.col("_item_text").isNotNull())
    source = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).filter(F.col("_text").isNotNull())
    grams = written(own.mapInPandas(_item_grams(min_words, q), f"_item {item_type}, _gram long, _place int"))
    uses = source.mapInPandas(_uses(_bitmap(grams), q), "_gram long, _n long").unionByName(grams.select("_gram", F.lit(1).cast("long").alias("_n")))
    uses = written(uses.groupBy("_gram").agg(F.sum("_n").alias("_n")).join(grams.select("_gram").distinct(), "_gram", "left_semi"))
    listed = F.array_sort(F.collect_list(F.struct("_place", "_gram", "_n")))
    by_item = grams.join(uses, "_gram").groupBy("_item").agg(listed.alias("_l")).select("_item", F.col("_l._gram").alias("_grams"), F.col("_l._n").alias("_uses"))
    rare = written(by_item.join(own.groupBy("_item").agg(F.first("_item_text").alias("_item_text")), "_item").mapInPandas(_rarest(min_words, q, edits), f"_item {item_type}, _gram long, _span int"))
    # every passage of min_words words holds a chosen q-gram, so one that is found ends no further from such a one than they are long
    span = int(rare.agg(F.coalesce(F.max("_span"), F.lit(0))).first()[0]) + edits
    found = source.mapInPandas(_stretches(_bitmap(rare), q, span), f"_key {key_type}, _first int, _text string, _grams array<long>")
    found = written(found)
    met = found.select("_key", "_first", F.explode("_grams").alias("_gram")).join(rare.select("_gram", "_item"), "_gram").select("_key", "_first", "_item").distinct()
    pairs = met.join(found.select("_key", "_first", "_text"), ["_key", "_first"]).join(own, "_item")
    # few bytes but much work: as many tasks as the session has for a shuffle (by a hash of its own, else the join's partitions would do, which are merged by their bytes)
    pairs = pairs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("_key", "_first")).sortWithinPartitions("_key", "_first")
    aligned = pairs.mapInPandas(_aligned(min_words, q, edits), f"_key {key_type}, _item {item_type}, n_words int, n_equal int, coverage double")
    best = aligned.groupBy("_key", "_item").agg(*(F.max(c).alias(c) for c in ("n_words", "n_equal", "coverage")))
    return best.withColumnsRenamed({"_key": key, "_item": item_key})
