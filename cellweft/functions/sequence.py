"""Column functions over DNA strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(seq: Column) -> Column:
    """Reverse complement; other letters stay."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")
