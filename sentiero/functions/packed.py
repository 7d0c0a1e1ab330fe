"""Fields that pack several values into one string: splitting by delimiters, with quoted spans kept whole."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that only say there is nothing (compared in lower case).
NOTHING = ("", "-", "--", "n.d.", "n.d", "nd", "n/d", "n/a", "na", "null", "none", "nan", "nessuno", "nessuna", "nessun valore", "vuoto", "assente")
#: A quoted span stands at the start of an item and ends before a delimiter; a quote inside is doubled or has a backslash.
QUOTED = r"""(?:(?<=^|[,;|\s\[{(])"(?:[^"\\]|\\.|"")*"(?=$|[,;|\s\]})])|(?<=^|[,;|\s\[{(])'(?:[^'\\]|\\.|''|(?<=\p{L})'(?=\p{L}))*'(?=$|[,;|\s\]})]))"""
#: Delimiters: comma, semicolon, bar, tab, line break; slash, plus, dash and the word "e" only between blanks.
DELIMITER = r"\s*[,;|\t\r\n]\s*|\s+[/+–—-](?=\s)|(?<=\s)[/+–—-]\s+|\s+e\s+"
_OPEN, _CLOSE = "", ""


def split_packed(field: Column) -> Column:
    """Array of structs (posizione, valore) of the values in ``field``, in the order written.

    Quoted spans give way to indexed placeholders; a private character already in the text is marked first, so that no
    text can look like a placeholder. What is left is split at the delimiters, at plain blanks only where all pieces are
    numbers or placeholders, and the spans are put back by array lookup. Blanks, enclosing quotes and escapes are taken
    off; empty items are not counted. A null, blank or nothing-saying field gives an empty array.
    """
    marked = F.replace(F.trim(F.regexp_replace(field, r"^[\s ]+|[\s ]+$", "")), F.lit(_OPEN), F.lit(_OPEN + "u"))
    bare = F.regexp_replace(marked, r"^\[(.*)\]$|^\{(.*)\}$", "$1$2")
    bare = F.regexp_replace(bare, r"^[\s,;|]+|[\s,;|]+$", "")
    spans = F.regexp_extract_all(bare, F.lit(f"({QUOTED})"), F.lit(1))
    between = F.split(bare, QUOTED, -1)
    numbered = F.transform(between, lambda part, i: F.when(i == 0, part).otherwise(F.concat(F.lit(_OPEN), (i - 1).cast("string"), F.lit(_CLOSE), part)))
    flat = F.array_join(numbered, "")
    pieces = F.split(flat, DELIMITER, -1)
    blanks = F.split(flat, r"\s+", -1)
    only_ids = flat.rlike(rf"^(?:\d+|{_OPEN}\d+{_CLOSE})(?:\s+(?:\d+|{_OPEN}\d+{_CLOSE}))+$")
    pieces = F.when(only_ids, blanks).otherwise(pieces)

    def restore(piece: Column) -> Column:
        at = F.regexp_extract(piece, rf"^{_OPEN}(\d+){_CLOSE}$", 1)
        span = F.get(spans, F.when(at != "", at.cast("int")))
        inner = F.substring(span, F.lit(2), F.length(span) - 2)
        inner = F.when(span.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))
        inner = F.regexp_replace(inner, r"\\(.)", "$1")
        return F.trim(F.replace(F.when(at != "", inner).otherwise(piece), F.lit(_OPEN + "u"), F.lit(_OPEN)))

    values = F.transform(pieces, lambda p: restore(F.trim(F.regexp_replace(p, r"^[\s ]+|[\s ]+$", ""))))
    values = F.filter(values, lambda v: v != "")
    nothing = (F.size(values) == 0) | ((F.size(values) == 1) & F.lower(F.get(values, F.lit(0))).isin(*NOTHING))
    numbered_values = F.transform(values, lambda v, i: F.struct((i + 1).cast("int").alias("posizione"), v.alias("valore")))
    empty = F.array().cast("array<struct<posizione:int,valore:string>>")
    return F.when(field.isNull() | nothing, empty).otherwise(numbered_values)
