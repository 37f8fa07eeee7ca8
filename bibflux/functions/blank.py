"""What counts as no value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of every script, for Java regular expressions.
SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
SPACES = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
BLANK_WORDS = ("", "nan", "none")


def strip(c: Column) -> Column:
    """Without white space at either end; only the ends of a text are looked at."""
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty, only white space, or the word nan or none in any case; never null itself. Ends at the first sign that tells."""
    return F.coalesce(c.rlike(rf"(?i)\A{SPACE}*+(?:nan|none)?+{SPACE}*+\z"), F.lit(True))


def clean(c: Column) -> Column:
    """The value without outer white space, or the empty string where it is blank."""
    return F.when(is_blank(c), F.lit("")).otherwise(strip(c))
