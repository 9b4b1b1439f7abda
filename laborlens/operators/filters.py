"""Row filters (F1-F12).  All are Column predicates, so Catalyst pushes the
parts that touch raw scan columns down to the parquet reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions.scalars import to_number


def age_between(df: DataFrame, col: str = "idade", lo: float = P.AGE_MIN_DEFAULT,
                hi: float = P.AGE_MAX_DEFAULT, coerce: bool = False) -> DataFrame:
    """keep lo <= age <= hi (nulls and non-numbers removed)."""
    x = to_number(col) if coerce else F.col(col)
    return df.filter(x.between(lo, hi))


def employed_or_income(df: DataFrame, ocupado: str = "ocupado",
                       income: str = "rendimento_trabalho_principal") -> DataFrame:
    """ocupado == 1 OR income > 0."""
    return df.filter(F.coalesce(F.col(ocupado) == 1, F.lit(False))
                     | F.coalesce(F.col(income) > 0, F.lit(False)))


def employed(df: DataFrame, ocupado: str = "ocupado") -> DataFrame:
    """ocupado == 1."""
    return df.filter(F.col(ocupado) == 1)


def year_between(df: DataFrame, lo: int, hi: int, col: str = "ano") -> DataFrame:
    """lo <= year <= hi, null year removed."""
    return df.filter(F.col(col).between(lo, hi))


def required(df: DataFrame, *cols: str) -> DataFrame:
    """required non-null columns."""
    return df.dropna(subset=list(cols))


def min_schooling(df: DataFrame, col: str = "anos_estudo", lo: int = 1) -> DataFrame:
    """schooling >= lo years."""
    return df.filter(F.col(col) >= lo)


def keep_latest(agg: DataFrame, col: str = "ano") -> DataFrame:
    """F8 on an *aggregated* table: keep the rows of the latest year.  The
    window spans the small per-year table (years x categories), so the raw rows
    are scanned once, aggregated for every year, and the latest year is picked
    afterwards."""
    from pyspark.sql import Window
    mx = F.max(col).over(Window.partitionBy(F.lit(0)))
    return agg.withColumn("_mx", mx).filter(F.col(col) == F.col("_mx")).drop("_mx")


def segment(df: DataFrame, it: bool, col: str = "eh_ti") -> DataFrame:
    """IT or non-IT part (prefer conditional aggregation over two scans)."""
    return df.filter(F.col(col) == F.lit(it))


def all_of(preds: list[Column]) -> Column:
    """opt-in predicate builder (AND of the given predicates)."""
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def quality_predicates(salary: str | None = "salario_num", salary_range=(0, 100_000),
                       family: str | None = "cbo_familia", apprentice: str | None = None,
                       move: str | None = None, age: str | None = "idade",
                       age_range=(18, 100)) -> list[Column]:
    """the declared quality rules, as a list of predicates to AND."""
    out = []
    if salary:
        out.append(F.col(salary).between(*salary_range))
    if family:
        out.append(F.col(family).isNotNull())
    if apprentice:
        out.append(F.coalesce(F.col(apprentice) != "1", F.lit(True)))
    if move:
        out.append(F.col(move).isin(list(P.MOVE_HIRE + P.MOVE_EXIT)))
    if age:
        out.append(F.col(age).between(*age_range))
    return out


def file_type(df: DataFrame, types=("MOV",), name_col: str = "arquivo") -> DataFrame:
    """keep movement files of the given types (MOV / FOR / EXC) by file name."""
    kind = F.upper(F.regexp_extract(F.col(name_col), r"(?i)CAGED(MOV|FOR|EXC)", 1))
    return df.filter(kind.isin(list(types)))
