"""Ordered rule ladders: the first rule that holds decides, and says which stage decided."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A condition with what it decides. A condition that is null does not hold."""

    when: Column
    verdict: str
    stage: str


def ladder(df: DataFrame, rules: Sequence[Rule], otherwise: tuple[str, str], verdict: str = "verdict", stage: str = "stage") -> DataFrame:
    """``df`` with the verdict and stage of the first rule that holds; ``otherwise`` gives both where
    none does. All conditions stay inside one projection."""
    says, where = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for rule in rules:
        holds = F.coalesce(rule.when, F.lit(False))
        says, where = says.when(holds, rule.verdict), where.when(holds, rule.stage)
    return df.withColumns({verdict: says.otherwise(otherwise[0]), stage: where.otherwise(otherwise[1])})


def first_evidence(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first value that is not null, and the name of what it came from."""
    name = F.when(F.lit(False), "")
    for source, value in sources:
        name = name.when(value.isNotNull(), source)
    return F.coalesce(*[v for _, v in sources]), name


def quarantine(df: DataFrame, checks: Sequence[tuple[str, Column]], reason: str = "reason") -> DataFrame:
    """``df`` with the name of the first check that fails (a null check fails); null for good rows.
    Bad rows are marked and kept, never dropped."""
    why = F.when(F.lit(False), "")
    for name, good in checks:
        why = why.when(~F.coalesce(good, F.lit(False)), name)
    return df.withColumn(reason, why)
