"""Names for columns that operators add for a while: none that the caller's tables have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_prefix(*tables: DataFrame) -> str:
    """A prefix that no column of these tables begins with, in any case of letters."""
    taken, prefix = [c.lower() for t in tables for c in t.columns], "_v_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix
