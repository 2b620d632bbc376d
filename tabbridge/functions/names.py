"""Column name lookup shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ColumnsNotFound(ValueError):
    """Raised while a plan is built, before any job runs."""

    def __init__(self, missing: Sequence[str], available: Sequence[str]):
        self.missing = list(missing)
        super().__init__(f"columns not found: {self.missing}; available: {list(available)}")


def bare(name: str) -> str:
    """Field name without blanks and without surrounding quote marks."""
    name = name.strip()
    if len(name) > 1 and name[0] == name[-1] and name[0] in "`\"":
        name = name[1:-1]
    return name


def col(name: str) -> Column:
    """Reference to a top-level column, whatever characters its name holds."""
    return F.col("`" + bare(name).replace("`", "``") + "`")


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The bare names, or ``ColumnsNotFound`` naming every missing one once."""
    wanted = [bare(n) for n in names]
    missing = [n for n in dict.fromkeys(wanted) if n not in df.columns]
    if missing:
        raise ColumnsNotFound(missing, df.columns)
    return wanted
