"""Projection / schema operators.

Column-name work happens on the driver over ``df.columns`` (metadata only);
the data side is a single ``toDF`` / ``select`` projection.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens.functions import scalars as X


def ascii_name(name: str) -> str:
    return unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode("ascii")


def normalize_name(name: str, strict: bool = True) -> str:
    """Trim, lower, accents -> ASCII, whitespace -> '_'; strict also drops
    everything outside [a-z0-9_] ('vinculo_ativo_31/12' -> 'vinculo_ativo_3112')."""
    s = ascii_name(str(name).strip().lower())
    s = re.sub(r"\s+", "_", s)
    if strict:
        s = re.sub(r"[^a-z0-9_]", "", s)
    return s


def normalize_headers(df: DataFrame, strict: bool = True) -> DataFrame:
    return df.toDF(*[normalize_name(c, strict) for c in df.columns])


def rename_present(df: DataFrame, mapping: dict, normalize_keys: bool = True) -> DataFrame:
    """Rename by map, only columns present (keys normalised like headers)."""
    cols = set(df.columns)
    out = {}
    for k, v in mapping.items():
        for cand in ([k, normalize_name(k)] if normalize_keys else [k]):
            if cand in cols and cand != v:
                out[cand] = v
                break
    return df.withColumnsRenamed(out) if out else df


def resolve_occupation_column(df: DataFrame, target: str = "cbo_ocupacao") -> DataFrame:
    """First column (file order) whose ASCII name starts with 'cbo'/'cdo' or
    holds 'cbo' and 'ocup' becomes `target`, unless `target` exists."""
    if target in df.columns:
        return df
    for c in df.columns:
        a = ascii_name(c).lower()
        if a.startswith("cbo") or a.startswith("cdo") or ("cbo" in a and "ocup" in a):
            return df.withColumnRenamed(c, target)
    return df


def pick(df: DataFrame, candidates) -> str | None:
    """First candidate column present."""
    return next((c for c in candidates if c in df.columns), None)


def ensure_columns(df: DataFrame, required: dict) -> tuple[DataFrame, list[str]]:
    """P5: add missing required columns as typed nulls; return the missing list."""
    missing = [c for c in required if c not in df.columns]
    for c in missing:
        df = df.withColumn(c, F.lit(None).cast(required[c]))
    return df, missing


def dedupe_names(names) -> list[str]:
    """Duplicate headers get _1, _2 ... in order of appearance."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen.get(n, 0)
        out.append(n if k == 0 else f"{n}_{k}")
        seen[n] = k + 1
    return out


def drop_present(df: DataFrame, *cols: str) -> DataFrame:
    """Drop derived columns if present."""
    return df.drop(*[c for c in cols if c in df.columns])


def non_empty_columns(df: DataFrame, candidates) -> list[str]:
    """Candidates with at least one non-null value (one aggregate pass)."""
    cands = [c for c in candidates if c in df.columns]
    if not cands:
        return []
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cands]).first()
    return [c for c in cands if row[c] > 0]


def feature_projection(df: DataFrame, numeric, categorical, exclude=()) -> tuple[list, list]:
    """P10: feature lists intersected with the schema, minus target/leakage names."""
    ex = set(exclude)
    num = [c for c in numeric if c in df.columns and c not in ex]
    cat = [c for c in categorical if c in df.columns and c not in ex]
    return num, cat


def coerce_income_columns(df: DataFrame) -> DataFrame:
    """Every column whose name holds 'rendimento' / 'renda' becomes numeric."""
    cols = [c for c in df.columns if "rendimento" in c or "renda" in c]
    return df.withColumns({c: X.to_number(c) for c in cols}) if cols else df


def repair_projection(df: DataFrame) -> DataFrame:
    """Record repair columns (raw CBO text, repaired CBO, merged course,
    parsed weight, normalised signed card, derived employed)."""
    cbo_raw = X.coalesce_text(*[c for c in ("cbo_raw", "cbo_ocupacao", "cbo_familia")
                                if c in df.columns])
    return df.withColumns({
        "cbo_raw_str": cbo_raw,
        "cbo_norm": X.cbo_repair(cbo_raw),
        "v3009_merged": X.coalesce_text("curso_mais_elevado", "curso_mais_elevado_antes_2015"),
        "peso_parsed": X.parse_locale_number("peso_populacional"),
        "carteira_assinada_norm": X.carteira_norm("carteira_assinada"),
        "employed_derived": X.employed_derived("forca_trabalho", "ocupado"),
    })
