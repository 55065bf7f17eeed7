"""Several values packed in one text field: one row per value, with its position.

Quotation marks that enclose a whole value are the split points. Of the pieces, the odd ones are literals and are kept
whole; the even ones are bare text and are split on the delimiters. Array functions put the values back in order and
number them, so everything stays in the JVM and no row leaves its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = ",;/|&\t\n\r"
WORDS = ("and",)
#: After a comma these belong to the name before it.
SUFFIXES = ("PhD", "Ph.D.", "MD", "M.D.", "Jr", "Jr.", "Sr", "Sr.", "II", "III", "IV", "Esq", "Esq.")
#: Opening and closing marks that may enclose a value.
MARKS = (('"', '"'), ("'", "'"), ("“", "”"), ("«", "»"), ("‘", "’"), ("‹", "›"), ("„", "“"))
CUT = "\x01"
#: How the cut mark, and this mark itself, are written while a text is split.
HELD = (("\x02", "\x02b"), (CUT, "\x02a"))
BLANK = r"[\s\x{a0}]"


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[&" else {"\t": r"\t", "\n": r"\n", "\r": r"\r"}.get(c, c) for c in chars) + "]"


def packed_values(
    text: Column,
    delimiters: str = DELIMITERS,
    words: Sequence[str] = WORDS,
    marks: Sequence[tuple[str, str]] = MARKS,
    suffixes: Sequence[str] = SUFFIXES,
) -> Column:
    """The values of one packed text as an array in order; null text gives an empty array.

    A value is enclosed if its mark opens after a delimiter or the start and closes before a delimiter or the end.
    Enclosing marks go, a mark doubled inside them becomes one; marks within a bare value stay. Blanks around values
    and empty values go. A mark that never closes is part of a bare value. A comma before one of ``suffixes`` alone
    doesn't separate.
    """
    d = _class(delimiters)
    word = "(?i:" + "|".join(words) + ")" if words else "(?!)"
    parts = []
    for o, c in marks:
        body = f"[^{c}]*+" if o != c else f"[^{c}]*+(?:{c}{c}[^{c}]*+)*+"
        parts.append(f"{o}{body}{c}")
    enclosed = f"(^|{d}|(?<!\\S){word}(?=\\s))({BLANK}*+)({'|'.join(parts)})(?={BLANK}*(?:$|{d})|\\s+{word}(?!\\S))"
    held = text
    for mark, code in HELD:
        held = F.replace(held, F.lit(mark), F.lit(code))
    marked = F.regexp_replace(held, enclosed, f"$1$2{CUT}$3{CUT}")
    pieces = F.split(marked, CUT, -1)
    trim = lambda c: F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")

    def literal(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        out = inner
        for o, c in marks:
            if o == c:
                out = F.when(F.substring(piece, 1, 1) == o, F.replace(inner, F.lit(c + c), F.lit(c))).otherwise(out)
        return F.array(out)

    bare = f"{d}|(?<!\\S){word}(?!\\S)"
    if suffixes:
        alone = "|".join(x.replace(".", "\\.") for x in suffixes)
        bare = f"(?!,{BLANK}*+(?:{alone}){BLANK}*+(?:{d}|$))(?:{bare})"
    split = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, literal(piece)).otherwise(F.split(piece, bare, -1)))

    def free(value: Column) -> Column:
        for mark, code in reversed(HELD):
            value = F.replace(value, F.lit(code), F.lit(mark))
        return value

    values = F.filter(F.transform(F.flatten(split), lambda v: free(trim(v))), lambda v: v != "")
    return F.coalesce(values, F.array().cast("array<string>"))


def unpack(
    df: DataFrame,
    ident: str = "book_id",
    column: str = "authors",
    value: str = "author",
    position: str = "pos",
    only_packed: bool = True,
    **rules,
) -> DataFrame:
    """One distinct row per value: ``ident``, ``position`` (from 1), ``value``.

    ``only_packed`` keeps the rows whose text holds more than one value.

    Defined cases: null, empty and blank texts give no rows, nor does a null ``ident``. Repeated rows give their
    values once; two different texts under one ``ident`` give the values of both. A value that occurs twice in a text
    keeps both positions. Texts may be of any length. Other columns are never read.
    """
    base = df.select(F.col(ident).alias("__i"), F.col(column).cast("string").alias("__t")).where("__i is not null and __t is not null")
    values = base.distinct().select("__i", packed_values(F.col("__t"), **rules).alias("__v"))
    values = values.where(F.size("__v") > (1 if only_packed else 0))
    out = values.select("__i", F.posexplode("__v").alias("__p", "__x"))
    return out.select(F.col("__i").alias(ident), (F.col("__p") + 1).cast("bigint").alias(position), F.col("__x").alias(value)).distinct()
