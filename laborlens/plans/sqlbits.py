"""Small builders of oracle SQL text (DuckDB dialect) mirroring the aggregate rules."""

from __future__ import annotations

from laborlens.plans.views import with_views

SURVEY_CTE = """
survey AS (SELECT * FROM micro WHERE idade BETWEEN 14 AND 80),
occ AS (SELECT * FROM survey WHERE ocupado = 1 OR rendimento_trabalho_principal > 0)"""


def survey_sql(body: str, extra: str = "") -> str:
    ctes = SURVEY_CTE + ("," + extra if extra else "")
    return with_views("micro", extra=ctes) + body


def wsum(w: str = "peso_populacional", cond: str | None = None) -> str:
    x = w if cond is None else f"CASE WHEN {cond} THEN {w} END"
    return f"COALESCE(SUM({x}), 0.0)"


def wmean(v: str, w: str = "peso_populacional", cond: str | None = None) -> str:
    ok = f"{v} IS NOT NULL AND {w} > 0" + (f" AND ({cond})" if cond else "")
    return f"(SUM(CASE WHEN {ok} THEN {v} * {w} END) / SUM(CASE WHEN {ok} THEN {w} END))"


def wshare(flag: str, w: str = "peso_populacional", cond: str | None = None) -> str:
    ok = f"{w} > 0" + (f" AND ({cond})" if cond else "")
    return (f"(SUM(CASE WHEN {ok} THEN COALESCE(CAST({flag} AS INT), 0) * {w} END) / "
            f"SUM(CASE WHEN {ok} THEN {w} END))")


def r(expr: str, places: int = 4) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {places})"


def pct(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN 100.0 * ({a}) / ({b}) ELSE 0.0 END)"


def ratio(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) END)"


def running_table(src: str, groups: list[str], v: str, w: str = "peso_populacional") -> str:
    """CTE bodies 'vt' and 'rt': distinct values with Σw, min w and running weight."""
    g = ", ".join(groups)
    gsel = (g + ", ") if groups else ""
    part = f"PARTITION BY {g} " if groups else ""
    return f"""
vt AS (SELECT {gsel}{v} AS v, SUM({w}) AS sw, MIN({w}) AS mw FROM {src}
       WHERE {v} IS NOT NULL AND {w} > 0 GROUP BY {gsel}{v}),
rt AS (SELECT *, SUM(sw) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
              SUM(sw) OVER ({part.strip()}) AS total FROM vt)"""


def pname(p: float) -> str:
    s = f"{p:.4f}".rstrip("0").rstrip(".").replace(".", "_")
    return f"p{s}"


def interp_percentiles(groups: list[str], ps: list[float]) -> str:
    """SELECT list over `rt` (grouped by `groups`) giving A4 percentiles as columns."""
    cols = []
    for p in ps:
        c = "cum / total"
        tv = f"MIN(v) FILTER (WHERE {c} >= {p})"
        tm = f"arg_min(mw, v) FILTER (WHERE {c} >= {p})"
        pv = f"MAX(v) FILTER (WHERE {c} < {p})"
        b = f"MAX(cum) FILTER (WHERE {c} < {p})"
        t = "MAX(total)"
        cols.append(
            f"CASE WHEN {tv} IS NULL THEN MAX(v) WHEN {pv} IS NULL THEN {tv} "
            f"WHEN {p} > ({b} + {tm}) / {t} THEN {tv} "
            f"ELSE {pv} + ({tv} - {pv}) * ({p} - {b} / {t}) / (({b} + {tm}) / {t} - {b} / {t}) END "
            f"AS {pname(p)}")
    return ", ".join(groups + cols)


def step_percentiles(groups: list[str], ps: list[float]) -> str:
    """SELECT list over `rt` giving A5 step quantiles as columns."""
    cols = [f"COALESCE(MAX(v) FILTER (WHERE (cum - sw + mw) / total <= {p}), MIN(v)) AS {pname(p)}"
            for p in ps]
    return ", ".join(groups + cols)
