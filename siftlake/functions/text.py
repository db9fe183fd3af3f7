"""Text normal forms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any script, as one pattern that is the same in Java and RE2.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def collapse(text: Column) -> Column:
    """White space collapsed and trimmed; a null text is an empty one."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
