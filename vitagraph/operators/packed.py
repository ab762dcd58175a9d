"""Several values packed in one field: one row per value, its place kept.

Method: a cell is split on the quote characters that open and close a whole value; odd
pieces are literals, even pieces are divided on the delimiters, and array folds put the
values together again with their ordinals. Which quotes enclose a whole value is read
from the delimiters around them. The whole operator is made of built-in expressions, so
it stays inside the JVM and needs no shuffle; no sign of a cell is used as a mark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitagraph.functions.text import let

#: Characters that divide a cell wherever they stand outside quotes.
HARD = r";|\t\r\n•·"
_BLANKS = r"[ \u00a0]*+"
_AND = r"[ ](?:&|and)[ ]"
_LIST_MARK = r"\A\s*(?:[-*‣◦▪●]\s+)"


def _quoted(names: bool) -> str:
    """A quoted whole value (group 2) after its delimiter (group 1). The inner loop is
    unrolled, so that long cells need no recursion."""
    end = rf"{_BLANKS}(?:\z|[\]}},{HARD}])" + (f"|{_AND}" if names else "")

    def value(q: str) -> str:
        plain, inner = rf"[^{q}\\]*+", rf"(?:\\.|{q}{q}|{q}(?!{end}))"
        return rf"{q}{plain}(?:{inner}{plain})*+{q}"

    return rf"(?s)(\A|[\[{{,{HARD}]|{_AND}){_BLANKS}({value(chr(34))}|{value(chr(39))})(?={end})"


def packed_values(cell: Column, comma: str = "alone", names: bool = False) -> Column:
    """``array<string>`` of the non-empty values of a packed cell, in order.

    comma: ``always`` - a comma divides like any delimiter; ``alone`` - it divides
        within square brackets, and elsewhere only in a cell without another
        delimiter.
    names: the cell holds person names; a comma before initials with full stops
        or before ``Jr.`` belongs to the name, and ``&`` or ``and`` divides.

    Null gives null; an empty, blank or bracket-only cell gives an empty array.
    Repeated values are kept. Quotes inside a value that do not enclose it are
    part of it; escaped quotes (backslash or doubled) are restored.
    """
    square = cell.rlike(r"(?s)\A\s*\[.*\]\s*\z")
    bare = F.regexp_replace(cell, r"(?s)\A\s*(?:\[(.*)\]|\{(.*)\})\s*\z", "$1$2")
    quoted = F.lit(_quoted(names))
    kept = rf"(?!\s*(?:(?:\p{{Lu}}\p{{M}}*\.[ -]?)+|Jr\.)\s*(?:\z|[,{HARD}]|&))" if names else ""
    anything = rf",{kept}|[{HARD}]" + (r"|\s+(?:&|and)\s+" if names else "")

    def delimiter(c: Column) -> Column:
        """What divides the even pieces; delimiters inside quotes do not count."""
        if comma == "always":
            return F.lit(anything)
        outside = F.when(c.rlike("[\"']"), F.regexp_replace(c, quoted, F.lit("$1"))).otherwise(c)
        return F.when(square | ~outside.rlike(f"[{HARD}]"), F.lit(anything)).otherwise(F.lit(f"[{HARD}]"))

    def pieces(c: Column) -> Column:
        """Even pieces as they stand, odd ones with their quotes."""
        odd = F.regexp_extract_all(c, quoted, F.lit(2))
        both = let(odd, lambda o: F.flatten(F.transform(F.split(c, quoted, -1), lambda p, i: F.when(i < F.size(o), F.array(p, F.get(o, i))).otherwise(F.array(p)))))
        return F.when(c.rlike("[\"']"), both).otherwise(F.array(c))

    def literal(piece: Column) -> Column:
        plain = F.regexp_replace(F.substr(piece, F.lit(2), F.length(piece) - 2), r"\\([\"'\\])", "$1")
        return F.when(F.startswith(piece, F.lit('"')), F.replace(plain, F.lit('""'), F.lit('"'))).otherwise(F.replace(plain, F.lit("''"), F.lit("'")))

    def divide(piece: Column, i: Column, at: Column) -> Column:
        parts = F.transform(F.split(piece, at, -1), lambda v: F.regexp_replace(v, _LIST_MARK, ""))
        return F.when(i % 2 == 1, F.array(literal(piece))).otherwise(parts)

    values = let(bare, lambda c: let(delimiter(c), lambda at: F.flatten(F.transform(pieces(c), lambda p, i: divide(p, i, at)))))
    values = F.transform(values, lambda v: F.regexp_replace(v, r"\A[\s\u00a0]+|[\s\u00a0]+\z", ""))
    return F.when(cell.isNotNull(), F.filter(values, lambda v: v != ""))


def split_packed(df: DataFrame, keys: Sequence[str], fields: dict[str, dict]) -> DataFrame:
    """One row per value of each packed field: ``keys``, ``field_name``, ``pos``
    (from 1), ``item``.

    fields: column name -> arguments of :func:`packed_values`. All fields are
    taken in one scan. Other columns of ``df``, whatever their names, are pruned.
    Rows whose cells hold no value give no row.
    """
    cells = F.array(
        *[F.struct(F.lit(f).alias("field_name"), packed_values(F.col(f), **how).alias("vals")) for f, how in fields.items()]
    )
    return (
        df.select(*keys, F.explode(cells).alias("cell_"))
        .select(*keys, F.col("cell_.field_name").alias("field_name"), F.posexplode("cell_.vals").alias("pos_", "item"))
        .select(*keys, "field_name", (F.col("pos_") + 1).alias("pos"), "item")
    )


#: How each packed field of the test tables is read.
FIELDS = {
    "authors": {"comma": "always", "names": True},
    "mesh_terms": {"comma": "alone"},
    "keywords": {"comma": "alone"},
    "attributes": {"comma": "always"},
}
