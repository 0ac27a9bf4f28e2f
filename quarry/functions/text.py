"""Line and trim functions on section texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the characters with the Unicode property White_Space ------
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# -----------------------------------------------------------------------------


def trim_white_space(text: Column) -> Column:
    """Without Unicode white space at both ends (plain trim only drops U+0020)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def section_lines(text: Column) -> Column:
    """The lines of a trimmed text.  A blank text has one empty line, a carriage
    return stays, and inner lines are not trimmed; null for null."""
    return F.split(trim_white_space(text), "\n")


def manifest_text(paths: Column) -> Column:
    """Paths joined by line feeds, with none at the end."""
    return F.array_join(paths, "\n")
