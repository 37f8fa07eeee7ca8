"""Letters without accents, inside the JVM.

Spark has no Unicode normalisation function. ``translate`` with a table that is derived from the
Unicode decompositions gives the same for Latin letters, without a Python worker.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from bibflux.functions.let import let


def _decompositions() -> tuple[str, str, list[tuple[str, str]]]:
    single_from, single_to, longer = [], [], []
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF10, 0xFF5B)):
        ch = chr(code)
        plain = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if not plain or plain == ch:
            continue
        if len(plain) == 1:
            single_from.append(ch)
            single_to.append(plain)
        elif plain.isalpha():
            longer.append((ch, plain))
    return "".join(single_from), "".join(single_to), longer


_FROM, _TO, _LONGER = _decompositions()


def fold_accents(c: Column) -> Column:
    """Latin letters without accents (compatibility forms too); combining marks vanish, all else stays. ASCII texts are only looked at."""

    def fold(x: Column) -> Column:
        out = F.translate(F.regexp_replace(x, r"\p{Mn}+", ""), _FROM, _TO)
        for ch, plain in _LONGER:
            if ch in "ﬀﬁﬂﬃﬄ":
                out = F.replace(out, F.lit(ch), F.lit(plain))
        return F.when(F.octet_length(x) == F.length(x), x).otherwise(out)

    return let(c, fold)


def fold_ascii(c: Column) -> Column:
    """``fold_accents`` in lower case without what is then not ASCII."""
    return F.regexp_replace(F.lower(fold_accents(c)), r"[^\x00-\x7F]+", "")
