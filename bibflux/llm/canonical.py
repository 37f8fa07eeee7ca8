"""Free-entered values mapped to the entries of a canonical list.

An automaton over all names, aliases and known other entities finds the mentions embedded in a value; the longest one wins, of equally long
ones the last, since a place ends with its largest unit. A value, or its last part, that is just a code names the entry with that code: a code is a
whole field of its own, so it is read before mentions. What holds no mention goes to token-set similarity: the entries whose name, or any word of
it, lies within two edits of the value or any word of it are scored, and the best one counts unless it ties with another entry.

The list is held by every task; it must have at most ``max_names`` names, which is checked before it is sent.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTS = re.compile(r"[,;:()\[\]{}/|]+|\s+[-–—]+\s+")
_WORDS = re.compile(r"[a-z0-9]+")
#: Values a worker remembers.
_REMEMBERED = 200_000


def plain(value: str) -> str:
    """Lower-case ASCII words of a value; dots and apostrophes join what they divide (``U.S.A.`` is ``usa``)."""
    text = unicodedata.normalize("NFKD", value.replace("ß", "ss").replace("ł", "l").replace("ø", "o").replace("ı", "i"))
    text = "".join(c for c in text if not unicodedata.combining(c)).lower().replace("&", " and ")
    text = re.sub(r"(?<=\b[a-z])\.\s?(?=[a-z]\b)|['’`´]", "", text)
    return " ".join(_WORDS.findall(text))


def osa_distance(a: str, b: str, limit: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or ``limit + 1`` if more; takes time in proportion to length times limit."""
    n, m = len(a), len(b)
    far = limit + 1
    if abs(n - m) > limit:
        return far
    before: list[int] = []
    last = [j if j <= limit else far for j in range(m + 1)]
    for i in range(1, n + 1):
        low, high = max(1, i - limit), min(m, i + limit)
        row = [far] * (m + 1) if m <= 64 else _Row(far)
        row[0] = i if i <= limit else far
        x, best = a[i - 1], row[0]
        for j in range(low, high + 1):
            y = b[j - 1]
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y), far)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row[j] = cost
            best = min(best, cost)
        if best > limit:
            return far
        before, last = last, row
    return last[m]


class _Row(dict):
    """A row of the table of which only the band is held."""

    def __init__(self, far: int):
        super().__init__()
        self.far = far

    def __missing__(self, key: int) -> int:
        return self.far


def _allowed(length: int) -> int:
    return 0 if length < 4 else 1 if length < 8 else 2


def _paired(x: list[str], y: list[str]) -> list[tuple[str, str, float]]:
    """(word of x, word of y, closeness) for each word of y that finds one of x within the edits its length allows, each used once."""
    out, rest = [], list(x)
    for t in y:
        limit = _allowed(len(t))
        near = [(d, k) for k, s in enumerate(rest) if (d := osa_distance(s, t, limit)) <= limit]
        if near:
            d, k = min(near)
            out.append((rest.pop(k), t, 1 - d / len(t)))
    return out


def token_set_similarity(a: str, b: str) -> float:
    """Closeness of the words of a value ``a`` and a name ``b``, from 0 to 1: the best of three readings.

    Letters in words that pair up as a share of all letters; the two written without blanks, which forgives blanks in the wrong place; and, where
    every word of a name of six letters or more is found, nine tenths of the closeness of those words, whatever else the value says.
    """
    x, y = a.split(), b.split()
    joined, other = "".join(x), "".join(y)
    limit = _allowed(len(other))
    d = osa_distance(joined, other, limit)
    best = 1 - d / max(len(other), 1) if d <= limit else 0.0
    pairs = _paired(x, y)
    total = len(joined) + len(other)
    score = sum((len(s) + len(t)) * c for s, t, c in pairs) / total if total else 0.0
    if len(pairs) == len(y) and len(other) >= 6:
        score = max(score, 0.9 * sum(len(t) * c for _, t, c in pairs) / len(other))
    return max(best, score)


#: Letters of a word of which deletions are taken. Two words within n edits have beginnings of this length that share a string after n deletions each.
_HEAD = 10


def _deletions(word: str, n: int) -> set[str]:
    head = word[:_HEAD]
    return {"".join(c for k, c in enumerate(head) if k not in gone) for r in range(n + 1) for gone in combinations(range(len(head)), r)}


class Canonical:
    """``names``: entry id and its names, best first; ``codes``: code and entry id; ``others``: names of entities that are not on the list."""

    def __init__(self, names: list[tuple[int, str]], codes: list[tuple[str, int]], others: list[str], none: int = -1, least: float = 0.7):
        import ahocorasick

        self.none, self.least = none, least
        self.codes = {c.lower(): i for c, i in codes}
        self.names: dict[str, int] = {}
        #: Decides between equally close names: an entry's first name before its aliases, those before other entities.
        self.rank: dict[str, float] = {}
        first: set[int] = set()
        for entry, name in [*names, *((none, o) for o in others)]:
            if (p := plain(name)) and p not in self.names:
                self.names[p] = entry
                self.rank[p] = 0.02 if entry == none else 0.01 if entry in first else 0.0
                first.add(entry)
        self.automaton = ahocorasick.Automaton()
        for p, entry in self.names.items():
            self.automaton.add_word(f" {p} ", (len(p) + 2, entry))
        self.automaton.make_automaton()
        #: Names by the deletions of their beginnings, written without blanks, and of those of their words.
        self.near: dict[str, set[str]] = {}
        self.near_word: dict[str, set[str]] = {}
        for p in self.names:
            words = p.split()
            for index, keys in ((self.near, ["".join(words)]), (self.near_word, words)):
                for w in keys:
                    if len(w) >= 4:
                        for d in _deletions(w, _allowed(len(w))):
                            index.setdefault(d, set()).add(p)
        self.seen: dict[str, int] = {}

    def __call__(self, value: str | None) -> int:
        if value is None:
            return self.none
        if value not in self.seen:
            if len(self.seen) >= _REMEMBERED:
                self.seen.clear()
            self.seen[value] = self._resolve(value)
        return self.seen[value]

    def _resolve(self, value: str) -> int:
        parts = [p for p in map(plain, _PARTS.split(value)) if p]
        if not parts:
            return self.none
        last = parts[-1].replace(" ", "")
        if last in self.codes:
            return self.codes[last]
        if (entry := self._mentioned(" ".join(parts))) is not None:
            return entry
        for part in reversed(parts):
            if (entry := self._similar(part)) is not None:
                return entry
        return self.none

    def _mentioned(self, text: str) -> int | None:
        """The entry of the longest mention, of equally long ones the last: no longer one overlaps it."""
        found = max(((size, end, entry) for end, (size, entry) in self.automaton.iter(f" {text} ")), default=None)
        return None if found is None else found[2]

    def _similar(self, part: str) -> int | None:
        words = part.split()
        reach = lambda w: 0 if len(w) < 3 else min(2, max(1, _allowed(len(w))))
        near: set[str] = set()
        for index, keys in ((self.near, ["".join(words)]), (self.near_word, words)):
            for w in keys:
                for d in _deletions(w, reach(w)):
                    near |= index.get(d, set())
        scores: dict[int, float] = {}
        for p in near:
            s = token_set_similarity(part, p)
            if s >= self.least:
                entry = self.names[p]
                scores[entry] = max(scores.get(entry, 0.0), s - self.rank[p])
        if not scores:
            return None
        best = max(scores.values())
        top = [e for e, s in scores.items() if s > best - 1e-9]
        return top[0] if len(top) == 1 else None


#: What a worker has built, by the list it is for.
_built: dict[str, Canonical] = {}


def _finder(names: list[tuple[int, str]], codes: list[tuple[str, int]], others: list[str], none: int, max_names: int):
    """A function that gives the list's ``Canonical``, built once per worker; raises for a list that is too large to send to every task."""
    if len(names) + len(codes) + len(others) > max_names:
        raise ValueError(f"more than {max_names} names: too large to send to every task")
    mark = hashlib.sha256(repr((names, codes, others, none)).encode()).hexdigest()

    def find() -> Canonical:
        if mark not in _built:
            _built[mark] = Canonical(names, codes, others, none)
        return _built[mark]

    return find


def canonical_udf(names: list[tuple[int, str]], codes: list[tuple[str, int]], others: list[str], none: int = -1, max_names: int = 200_000):
    """A pandas UDF ``string -> int``; null and empty values give ``none``."""
    find = _finder(names, codes, others, none, max_names)

    @F.pandas_udf("int")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = find()
        for values in batches:
            yield values.map(own).astype("int32")

    return resolve


def named_places_udf(names: list[tuple[int, str]], codes: list[tuple[str, int]], others: list[str], separator: str = ";", none: int = -1, max_names: int = 200_000):
    """A pandas UDF ``string -> int``: how many places of a separated list name an entry; 0 for null and empty."""
    find = _finder(names, codes, others, none, max_names)

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = find()
        for values in batches:
            yield values.map(lambda v: sum(own(p) != none for p in v.split(separator)) if v else 0).astype("int32")

    return count


def map_places(df: DataFrame, key: str, field: str, blank: Column, resolve, name: str, separator: str = ";") -> DataFrame:
    """Rows ``(key, pos, name)`` for each place of a separated list; an empty place is a place and names nothing.

    Rows for which ``blank`` holds give nothing; repeated rows each give their own; other columns are ignored.
    """
    places = df.filter(~blank).select(F.col(f"`{key}`"), F.posexplode(F.split(F.col(f"`{field}`"), separator)).alias("_pos", "_place"))
    return places.select(F.col(f"`{key}`"), (F.col("_pos") + 1).cast("int").alias("pos"), resolve("_place").alias(name))
