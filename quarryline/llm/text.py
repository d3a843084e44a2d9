"""Character classes and foldings that the operators of this folder share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Full-width forms of ASCII and the ideographic space, and what they fold to.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "


def narrow(c: Column) -> Column:
    """Full-width ASCII as ASCII."""
    return F.translate(c, WIDE, NARROW)


def letters_only(c: Column) -> Column:
    """The letters of any script, in lower case and without width."""
    return F.lower(F.regexp_replace(narrow(c), r"[^\p{L}]+", ""))
