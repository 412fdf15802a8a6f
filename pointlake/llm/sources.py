"""Names of sources: case and surrounding blanks don't tell sources apart."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def source_key(source: Column) -> Column:
    """The source a spelling stands for; NULL and blank names are NULL."""
    s = F.lower(F.regexp_replace(source, r"^[\s\x{A0}\x{200B}\x{3000}]+|[\s\x{A0}\x{200B}\x{3000}]+$", ""))
    return F.when(s != "", s)
