"""Decision lists over pairs: which conclusion the first case that holds gives, with its reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def decide(cases: Sequence[tuple[Column, str, str]], otherwise: tuple[str, str]) -> tuple[Column, Column]:
    """Conclusion and reason of the first case (test, conclusion, reason) that holds; a null test does not."""
    end, why = F.lit(otherwise[0]), F.lit(otherwise[1])
    for test, conclusion, reason in reversed(cases):
        holds = F.coalesce(test, F.lit(False))
        end = F.when(holds, F.lit(conclusion)).otherwise(end)
        why = F.when(holds, F.lit(reason)).otherwise(why)
    return end, why


def support(*signs: Column) -> Column:
    """How many of the signs hold."""
    total = F.lit(0)
    for s in signs:
        total = total + F.coalesce(s, F.lit(False)).cast("int")
    return total
