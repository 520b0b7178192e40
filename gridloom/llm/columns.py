"""Names of columns that can't clash with those that an operator makes for itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_place(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns called c0, c1, ... and the new name of each."""
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*named.values()), named


def named_again(found: DataFrame, named: dict[str, str], columns: list[str], new: list[str] | None = None) -> DataFrame:
    """``columns`` under the names that they had before by_place(), then the columns ``new``."""
    return found.select(*[F.col(named[c]).alias(c) for c in columns], *(new or []))
