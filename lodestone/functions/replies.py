"""Values out of model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_of(raw: str, n: str | int | None = None) -> Column:
    """A whole number out of ``3``, ``#3``, ``[3]``, ``(3)`` or ``3.``: brackets, marks and dots at either end don't count.

    Null for anything else, true and false too, and, where ``n`` is given, for ids outside 0 to n - 1.
    """
    bare = F.regexp_replace(F.trim(F.col(raw)), r"^[\[\]#().]+|[\[\]#().]+$", "")
    found = F.regexp_extract(bare, r"^\s*([+-]?\d+)\s*$", 1).try_cast("long")
    if n is None:
        return found
    return F.when((found >= 0) & (found < (F.col(n) if isinstance(n, str) else F.lit(n))), found)
