"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ranges of CJK and full-width characters (ends excluded) that garbled text lacks.
GARBLE = r"[\x{9FFF}-\x{FEFF}\x{FFEF}-\x{10FFFF}]"
CJK = r"[\x{4E00}-\x{9FFF}]"
#: White space and punctuation that carry no information.
SPARSE = "[ \t\n\r，。、；：\"！？…—　]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"))


def preview(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)
