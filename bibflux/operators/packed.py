"""Several values packed in one field: one row for each value, with its place.

The field is split at its quote characters. Odd pieces stand inside quotes and are literals;
even pieces are split at delimiters. Array functions then put the values together again
and number them. Everything is a column expression: no shuffle, no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibflux.functions.blank import SPACE, is_blank, strip
from bibflux.functions.let import let

#: Stand for a separator outside quotes while the pieces are being put together.
_HARD, _COMMA = "\x01", "\x02"
#: Separators that are never part of a value outside quotes.
HARD = rf"[;；|、\n\r\t\x{{2028}}\x{{2029}}]|{SPACE}+[·•/]{SPACE}+"
#: Words that separate the last two names of a list.
NAME_JOINERS = rf",?{SPACE}+(?:and|&|y){SPACE}+"
#: Words that belong to the surname that follows them.
PARTICLES = ("von", "van", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "der", "den", "ter", "ten", "zu", "bin", "al", "el")
#: A surname has eight particles at most; a repetition without bound would take a stack as deep as the text is long.
_SURNAME = rf"{SPACE}*(?:(?i:{'|'.join(PARTICLES)}){SPACE}+){{0,8}}[^\s\x01\x02\"]+{SPACE}*"


def packed_values(field: Column, names: bool = False) -> Column:
    """The values of a packed field, in order, as ``array<string>``.

    ``names``: the field lists persons. A comma then separates two of them unless the part before
    it is a lone surname (particles aside), which it joins with the given name that follows;
    ``and``, ``&`` and ``y`` separate too. Otherwise a comma separates values only if nothing else does.

    Values lose outer white space and quotes, doubled quotes inside quotes become one; empty places vanish.
    A field in brackets that begins with a quote is a written-out list. A last quote without a partner is
    an ordinary character. Blank and null fields give an empty array.
    """
    text = F.regexp_replace(field, rf'(?s)^{SPACE}*\[{SPACE}*(".*"){SPACE}*\]{SPACE}*$', "$1")
    hard = f"{NAME_JOINERS}|{HARD}" if names else HARD

    def assembled(pieces: Column) -> Column:
        # the index from which on a piece is outside quotes, wherever it stands: a quote without partner is no quote
        unpaired = F.size(pieces) - (F.size(pieces) % 2 == 0).cast("int")

        def piece(p: Column, i: Column) -> Column:
            outside = F.translate(F.regexp_replace(p, hard, _HARD), ",，", _COMMA * 2)
            return F.when((i % 2 == 1) & (i < unpaired), p).otherwise(outside)

        return F.array_join(F.transform(pieces, piece), '"')

    joined = let(F.split(text, '"'), assembled)
    if names:
        joined = F.regexp_replace(joined, rf"(^|[\x01\x02])({_SURNAME})\x02({SPACE}*[^\s\x01\x02])", "$1$2,$3")
    else:
        joined = let(joined, lambda j: F.when(F.contains(j, F.lit(_HARD)), F.translate(j, _COMMA, ",")).otherwise(j))

    def value(v: Column) -> Column:
        # in quotes: every quote between the outer two is doubled (told without a pattern, which long values would overtax)
        inner = lambda x: F.substring(x, F.lit(2), F.length(x) - 2)
        quoted = lambda x: F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1) & ~F.contains(F.replace(inner(x), F.lit('""'), F.lit("")), F.lit('"'))
        return let(strip(v), lambda x: F.when(quoted(x), strip(F.replace(inner(x), F.lit('""'), F.lit('"')))).otherwise(x))

    values = F.filter(F.transform(F.split(joined, r"[\x01\x02]"), value), lambda v: v != "")
    return F.when(is_blank(field), F.array().cast("array<string>")).otherwise(values)


def explode_packed(df: DataFrame, key: str, fields: dict[str, bool]) -> DataFrame:
    """Rows ``(key, field, pos, value)`` for every value packed in ``fields`` of ``df``.

    ``fields`` maps each field to whether it lists persons. Rows of the input may repeat and each gives
    its own values; blank fields give no row; positions start at 1. Other columns of ``df`` are ignored,
    whatever their names. An empty table gives an empty result.
    """
    packed = F.array(*(F.struct(F.lit(f).alias("field"), packed_values(F.col(f"`{f}`"), names).alias("vals")) for f, names in fields.items()))
    return (
        df.select(F.col(f"`{key}`").alias("_key"), F.explode(packed).alias("_p"))
        .select("_key", F.col("_p.field").alias("field"), F.posexplode("_p.vals").alias("_pos", "value"))
        .select(F.col("_key").alias(key), "field", (F.col("_pos") + 1).cast("int").alias("pos"), "value")
    )
