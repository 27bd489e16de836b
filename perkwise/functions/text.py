"""White space in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The letters that Unicode calls white space.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space at its ends, in one pass whatever lies between."""
    return F.btrim(text, F.lit(WHITE_SPACE))
