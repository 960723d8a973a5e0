from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def qcol(name: str) -> Column:
    """Column by exact name (dots, spaces and back-quotes allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")
