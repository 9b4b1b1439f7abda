"""Source / sink round trips: files are written from the test tables to the
shared scratch folder (spark.checkpoint.dir), read back with the library's
scans, and the result is compared with SQL over the original tables.
Also the ingestion ledger (S14/S15) over the `ledger` view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laborlens import params as P
from laborlens.functions import scalars as X
from laborlens.operators import schema as SC
from laborlens.operators.aggregates import count_if
from laborlens.plans import registry_plans as RG
from laborlens.plans.registry import register
from laborlens.plans.views import micro, mov, vinculos, ledger, with_views, TEST_IT_CODES
from laborlens.session import materialise, scratch_path
from laborlens.sources import archives as AR
from laborlens.sources import files as FS
from laborlens.sources import incremental as IN
from laborlens.sources import sinks as K
from laborlens.sources.tables import table

# Fixture layout: a subset of the survey layout under the raw variable names.
RAW_NAMES = P.RAW_NAMES
RAW_LAYOUT = [(RAW_NAMES[n], s, e) for n, s, e in P.SURVEY_LAYOUT if n in RAW_NAMES]
RENAME = {v: k for k, v in RAW_NAMES.items()}
RANGED = ("idade", "ano", "trimestre", "sexo")       # columns whose range the layout report gives

_FIXTURES: dict = {}


def _fixture(spark, d, kind: str, build) -> str:
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _FIXTURES:
        _FIXTURES[key] = build()
    return _FIXTURES[key]


def _fwf_values(m: DataFrame) -> dict:
    return {"Ano": F.col("ano"), "Trimestre": F.col("trimestre"), "UF": F.col("uf"),
            "V1028": F.col("peso_populacional"), "V2007": F.col("sexo"), "V2009": F.col("idade"),
            "V4010": F.col("cbo_familia"), "VD4002": F.col("ocupado"),
            "VD4016": F.floor("rendimento_trabalho_principal").cast("long")}


def fwf_dir(spark, d) -> str:
    """Fixed-width fixture, one folder per PNADC_0QYYYY name; the lines are mostly blanks, so the files are compressed."""
    def build():
        m = micro(spark, d)
        lines = m.select(FS.fixed_width_line(RAW_LAYOUT, _fwf_values(m)).alias("value"),
                         F.concat(F.lit("PNADC_0"), F.col("trimestre").cast("string"),
                                  F.col("ano").cast("string")).alias("nome_arquivo"))
        return K.write_text(lines, "value", scratch_path(spark, "fwf"), partition_by=("nome_arquivo",),
                            compression="snappy")
    return _fixture(spark, d, "fwf", build)


def read_survey_fwf(spark, paths) -> DataFrame:
    """S1 + P1 + typing: the raw fixed-width survey as a typed DataFrame."""
    raw = FS.read_fixed_width(spark, paths, RAW_LAYOUT)
    df = SC.rename_present(raw, RENAME, normalize_keys=False)
    ints = [c for c in ("ano", "trimestre", "uf", "sexo", "idade", "ocupado") if c in df.columns]
    dbl = [c for c in ("peso_populacional", "rendimento_trabalho_principal") if c in df.columns]
    df = df.withColumns({c: X.to_number(c, to_int=True).cast("int") for c in ints})
    df = df.withColumns({c: X.to_number(c) for c in dbl})
    return df.withColumn("cbo_familia", X.cbo_family("cbo_ocupacao"))


def _m(body: str, extra: str = "") -> str:
    return with_views("micro", extra=extra) + body


@register("fixed_width_roundtrip", "S1 S2 P1 X1 X2", _m("""
SELECT ano, trimestre, uf, sexo, idade, cbo_familia, ocupado, peso_populacional,
       CAST(floor(rendimento_trabalho_principal) AS DOUBLE) AS rendimento_trabalho_principal FROM micro"""))
def fixed_width_roundtrip(spark, d):
    df = read_survey_fwf(spark, fwf_dir(spark, d))
    return df.select("ano", "trimestre", "uf", "sexo", "idade", "cbo_familia", "ocupado",
                     "peso_populacional", "rendimento_trabalho_principal")


@register("layout_verify", "Q4 S1", _m("""
SELECT CAST(ano AS STRING) AS valor, COUNT(*) AS n,
       MIN(CAST(ano AS STRING) || CAST(trimestre AS STRING) || lpad(CAST(uf AS STRING), 2, ' ')) AS contexto,
       MAX(CAST(ano AS STRING) || CAST(trimestre AS STRING) || lpad(CAST(uf AS STRING), 2, ' ')) AS contexto_max,
       COUNT(DISTINCT CAST(ano AS STRING) || CAST(trimestre AS STRING) || lpad(CAST(uf AS STRING), 2, ' ')) AS contextos
FROM micro GROUP BY 1"""))
def layout_verify(spark, d):
    lines = FS.read_lines(spark, fwf_dir(spark, d))
    around = F.substring("value", 1, 7)                              # the year and the fields after it
    return lines.groupBy(F.substring("value", 1, 4).alias("valor")).agg(
        F.count(F.lit(1)).alias("n"), F.min(around).alias("contexto"), F.max(around).alias("contexto_max"),
        F.countDistinct(around).alias("contextos"))


@register("layout_columns", "Q8 S1 S2", _m(" UNION ALL ".join(
    f"SELECT '{raw}' AS coluna, '{name}' AS nome, {s} AS inicio, {e} AS fim, COUNT({name}) AS nao_nulos, "
    + (f"CAST(MIN({name}) AS DOUBLE) AS minimo, CAST(MAX({name}) AS DOUBLE) AS maximo FROM micro" if name in RANGED else
       "CAST(NULL AS DOUBLE) AS minimo, CAST(NULL AS DOUBLE) AS maximo FROM micro")
    for raw, s, e in RAW_LAYOUT for name in [RENAME[raw]])))
def layout_columns(spark, d):
    # textual specs, as in a config: 'a-b', 'a,b', reversed; an invalid entry is left out
    forms = ("{s}-{e}", "{s},{e}", "{e}:{s}")
    spec = {raw: forms[k % 3].format(s=s, e=e) for k, (raw, s, e) in enumerate(RAW_LAYOUT)} | {"ruim": "x-9"}
    layout = FS.parse_layout(spec)
    raw = FS.read_fixed_width(spark, fwf_dir(spark, d), layout)
    number = {n: X.to_number(n) if RENAME[n] in RANGED else F.lit(None).cast("double") for n, _, _ in layout}
    row = raw.agg(*[a for n, _, _ in layout for a in (
        F.count(n).alias(n), F.min(number[n]).alias(f"{n}_min"), F.max(number[n]).alias(f"{n}_max"))])
    return row.select(F.inline(F.array(*[F.struct(
        F.lit(n).alias("coluna"), F.lit(RENAME[n]).alias("nome"), F.lit(s).alias("inicio"), F.lit(e).alias("fim"),
        F.col(n).alias("nao_nulos"), F.col(f"{n}_min").alias("minimo"), F.col(f"{n}_max").alias("maximo"))
        for n, s, e in layout])))


@register("year_pruned_scan", "S10 S9", _m("""
SELECT ano, COUNT(*) AS n FROM micro WHERE ano IN (1996, 1998) GROUP BY ano"""))
def year_pruned_scan(spark, d):
    df = read_survey_fwf(spark, fwf_dir(spark, d))
    kept = df.filter(FS.year_from_name("arquivo").isin(1996, 1998))
    return kept.groupBy("ano").agg(F.count(F.lit(1)).alias("n"))


@register("file_caps", "S11", _m("""
SELECT 'PNADC_0' || CAST(trimestre AS STRING) || CAST(ano AS STRING) AS nome_arquivo, COUNT(*) AS n,
       COUNT(*) AS validas, CAST(MIN(idade) AS INT) AS idade_min, CAST(MAX(idade) AS INT) AS idade_max
FROM micro GROUP BY 1"""))
def file_caps(spark, d):
    """Preview of every file from all its rows: line count, well-formed lines, age range."""
    lines = FS.read_lines(spark, fwf_dir(spark, d))
    return FS.file_preview(lines.withColumn("arquivo", F.regexp_extract("arquivo", r"nome_arquivo=([^/]+)", 1)),
                           RAW_LAYOUT, "V2009")


@register("raw_vs_processed", "L6 X3 X23", _m("""
SELECT COUNT(*) FILTER (WHERE r.n IS NOT NULL) AS chaves_brutas,
       CAST(COALESCE(SUM(r.n), 0) AS BIGINT) AS linhas_brutas,
       CAST(COALESCE(SUM(CASE WHEN p.n IS NOT NULL THEN r.n END), 0) AS BIGINT) AS linhas_casadas,
       CAST(COALESCE(SUM(CASE WHEN p.n IS NULL THEN r.n END), 0) AS BIGINT) AS so_brutas,
       CAST(COALESCE(SUM(CASE WHEN r.n IS NULL THEN p.n END), 0) AS BIGINT) AS so_processadas
FROM (SELECT ano, trimestre, uf, idade, sexo, cbo_familia, COUNT(*) AS n FROM micro GROUP BY ALL) r
FULL OUTER JOIN (SELECT ano, trimestre, uf, idade, sexo, cbo_familia, COUNT(*) AS n FROM micro
                 WHERE idade BETWEEN 14 AND 80 GROUP BY ALL) p
  ON r.ano = p.ano AND r.trimestre = p.trimestre AND r.uf = p.uf AND r.idade = p.idade
 AND r.sexo = p.sexo AND r.cbo_familia = p.cbo_familia"""))
def raw_vs_processed(spark, d):
    keys = ["ano", "trimestre", "uf", "idade", "sexo"]
    raw = FS.read_fixed_width(spark, fwf_dir(spark, d), RAW_LAYOUT)
    raw = SC.rename_present(raw, RENAME, normalize_keys=False)
    rk = raw.select(*[X.key_text(k).alias(k) for k in keys], X.cbo_repair("cbo_ocupacao").alias("cbo"))
    proc = micro(spark, d).filter(F.col("idade").between(14, 80))
    pk = proc.select(*[X.key_text(k).alias(k) for k in keys], F.col("cbo_familia").alias("cbo"))
    kk = keys + ["cbo"]
    r = rk.groupBy(*kk).agg(F.count(F.lit(1)).alias("rn"))
    p = pk.groupBy(*kk).agg(F.count(F.lit(1)).alias("pn"))
    j = r.join(p, kk, "full_outer")          # one row per key: no pair expansion
    return j.agg(count_if(F.col("rn").isNotNull()).alias("chaves_brutas"),
                 F.coalesce(F.sum("rn"), F.lit(0)).cast("long").alias("linhas_brutas"),
                 F.coalesce(F.sum(F.when(F.col("pn").isNotNull(), F.col("rn"))), F.lit(0)).cast("long")
                 .alias("linhas_casadas"),
                 F.coalesce(F.sum(F.when(F.col("pn").isNull(), F.col("rn"))), F.lit(0)).cast("long")
                 .alias("so_brutas"),
                 F.coalesce(F.sum(F.when(F.col("rn").isNull(), F.col("pn"))), F.lit(0)).cast("long")
                 .alias("so_processadas"))


@register("zip_roundtrip", "S13", _m("""
SELECT ano, 'PNADC_012001.txt' AS nome, COUNT(*) AS n, CAST(SUM(idade) AS BIGINT) AS soma_idade FROM micro GROUP BY ano"""))
def zip_roundtrip(spark, d):
    def build():
        m = micro(spark, d)
        lines = m.select(FS.fixed_width_line(RAW_LAYOUT, _fwf_values(m)).alias("value"))
        return K.write_zip_archives(lines, "value", scratch_path(spark, "zip"),
                                    member="PNADC_012001_20240101.txt")
    zdir = _fixture(spark, d, "zip", build)
    lines = FS.read_zip_lines(spark, zdir)
    df = FS.cut_fixed_width(lines.withColumn("nome", FS.canonical_archive_name()), RAW_LAYOUT, keep=("nome",))
    df = SC.rename_present(df, RENAME, normalize_keys=False)
    return df.groupBy(X.to_number("ano", to_int=True).cast("int").alias("ano"), "nome").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.to_number("idade", to_int=True)).cast("long").alias("soma_idade"))


def write_yearly_archive(lines: DataFrame, path: str) -> str:
    """Fixture: one archive a partition, with a member for each year of its lines (value, ano), written
    line by line in the order of the years."""
    from laborlens.sources.archives import opened
    store, root, _ = opened(path)
    store.create_dir(root, recursive=True)

    def write(batches):
        import zipfile
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, base, _ = opened(path)
        k, last, out = 0, None, None
        with fs.open_output_stream(f"{base}/lote-{part:05d}.zip") as raw, zipfile.ZipFile(raw, "w") as z:
            for pdf in batches:
                for year, own in pdf.groupby("ano", sort=False, dropna=False)["value"]:
                    year = int(year) if year == year else None         # a column with nulls comes as floats
                    if out is None or year != last:
                        if out is not None:
                            out.close()
                        member = zipfile.ZipInfo(f"dados/PNADC_{year}.txt")
                        member.compress_type = zipfile.ZIP_STORED if k % 2 else zipfile.ZIP_DEFLATED
                        k, last, out = k + 1, year, z.open(member, "w", force_zip64=True)
                    out.write("".join(f"{v}\n" for v in own).encode("ISO-8859-1"))
            if out is not None:
                out.close()
        import pandas as pd
        yield pd.DataFrame({"n": [k]})

    lines.sortWithinPartitions("ano").mapInPandas(write, "n long").collect()                   # a number for each partition
    return path


@register("archive_members", "S1 S13", _m("""
SELECT ano, 'dados/PNADC_' || CAST(ano AS STRING) || '.txt' AS membro, COUNT(*) AS n, CAST(SUM(idade) AS BIGINT) AS soma_idade
FROM micro WHERE ano IN (1996, 1998) GROUP BY ano"""))
def archive_members(spark, d):
    """Fixed-width lines of two years' members, of archives with a member a year; the others are not opened."""
    m = micro(spark, d)
    m = m.select("cbo_familia", *[c for c in RAW_NAMES if c != "cbo_ocupacao"]).sortWithinPartitions("ano")    # before lines are long
    lines = m.select(FS.fixed_width_line(RAW_LAYOUT, _fwf_values(m)).alias("value"), "ano")
    path = write_yearly_archive(lines, scratch_path(spark, "archives"))
    found = AR.read_archives(spark, path, range_bytes=1 << 20).filter(
        F.col("membro").isin("dados/PNADC_1996.txt", "dados/PNADC_1998.txt"))
    df = SC.rename_present(FS.cut_fixed_width(found, RAW_LAYOUT, keep=("membro",)), RENAME, normalize_keys=False)
    return df.groupBy(X.to_number("ano", to_int=True).cast("int").alias("ano"), "membro").agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.to_number("idade", to_int=True)).cast("long").alias("soma_idade"))


# ---------------------------------------------------------------------------
# delimited files: registry CSV (gzip), charset mix, separator sniffing, no header
# ---------------------------------------------------------------------------

@register("csv_roundtrip", "S3 K4 K6 P2 P3 P4 P6 X22 A27", RG._sql("""
SELECT ano, uf, eh_ti, n, ROUND(taxa_ativo, 6) AS taxa_ativo, ROUND(salario_mediana, 4) AS salario_mediana
FROM grp""", extra=RG._GROUPS_SQL))
def csv_roundtrip(spark, d):
    path = _fixture(spark, d, "csv", lambda: K.export_csv(
        vinculos(spark, d).drop("record_id"), scratch_path(spark, "csv"), ";", True, "gzip"))
    raw = FS.read_delimited(spark, path, ";", "UTF-8").drop("arquivo")
    g = RG.group_aggregate(RG.normalize_registry(raw, TEST_IT_CODES), RG.KEYS)
    return g.select(*RG.KEYS, "n", F.round("taxa_ativo", 6).alias("taxa_ativo"),
                    F.round("salario_mediana", 4).alias("salario_mediana"))


_FEED_RAW = {"competencia": "competênciamov", "uf": "uf", "cbo_ocupacao": "cbo2002ocupação",
             "idade": "idade", "tipomovimentacao": "tipomovimentação", "salario": "salário"}

_MOV_COUNTS_SQL = with_views("mov") + """
SELECT TRY_CAST(substr(competencia, 1, 4) AS INT) AS ano, COUNT(*) AS n,
       CAST(SUM(idade) AS BIGINT) AS soma_idade FROM mov GROUP BY 1"""


def _feed_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(X.period_year("competencia").alias("ano")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(X.to_number("idade", to_int=True)).cast("long").alias("soma_idade"))


@register("charset_roundtrip", "S4 P1 P2 X17", _MOV_COUNTS_SQL)
def charset_roundtrip(spark, d):
    def build():
        base = scratch_path(spark, "charset")
        m = mov(spark, d).select(*[F.col(k).cast("string").alias(v) for k, v in _FEED_RAW.items()],
                                 "user_id")
        K.export_csv(m.filter(F.col("user_id") % 2 == 0).drop("user_id"), f"{base}/latin1", ";", True,
                     encoding="ISO-8859-1")
        K.export_csv(m.filter(F.col("user_id") % 2 == 1).drop("user_id"), f"{base}/utf8", ";", True)
        return base
    base = _fixture(spark, d, "charset", build)
    raw = FS.read_delimited(spark, [f"{base}/latin1", f"{base}/utf8"], ";", encoding=None, glob="*.csv")
    return _feed_counts(SC.rename_present(SC.normalize_headers(raw.drop("arquivo")), P.FEED_RENAME))


@register("csv_headers", "S3 S4 P6", """
SELECT CAST(n_regionkey AS STRING) AS regiao, COUNT(*) AS n, CAST(SUM(length(n_name)) AS BIGINT) AS letras,
       COUNT(CASE WHEN n_nationkey % 2 = 0 THEN 1 END) AS com_segunda_nota,
       CAST(SUM(CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS com_quebra
FROM nation GROUP BY n_regionkey""")
def csv_headers(spark, d):
    """Files with different column orders, a duplicate header, blank and over-long lines,
    quoted separators and line breaks."""
    def build():
        base = scratch_path(spark, "headers")
        n = table(spark, d, "nation", "n_nationkey", "n_regionkey", "n_name")
        note = F.when(F.col("n_nationkey") % 3 == 0, F.lit('"uma; nota\nem ""duas"" linhas"')).otherwise(F.lit('"uma; nota"'))
        name, region = F.col("n_name"), F.col("n_regionkey").cast("string")
        for part, head, cols in ((0, "nome;regiao;nota;nota", [name, region, note, F.lit("segunda")]),
                                 (1, ' nota;"regiao";nome', [note, region, name])):
            lines = n.filter(F.col("n_nationkey") % 2 == part).select(F.lit(1).alias("k"), F.concat_ws(";", *cols).alias("value"))
            extra = spark.createDataFrame([(0, head), (2, "   "), (3, "a;b;c;d;e;f;longa")], "k int, value string")
            lines.union(extra).coalesce(1).sortWithinPartitions("k").select("value") \
                 .write.mode("overwrite").text(f"{base}/{part}")            # 25 rows: one file each
        return base
    base = _fixture(spark, d, "headers", build)
    df = FS.read_delimited(spark, [f"{base}/0", f"{base}/1"], ";", encoding=None)
    return df.groupBy("regiao").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("nome")).cast("long").alias("letras"),
        F.count("nota_1").alias("com_segunda_nota"),
        F.sum((F.col("nota") == 'uma; nota\nem "duas" linhas').cast("long")).alias("com_quebra"))


@register("export_rows", "K4 K6", with_views("mov") + "SELECT COUNT(*) AS linhas, COUNT(*) AS lidas FROM mov")
def export_rows(spark, d):
    """Rows of a table before an export, and lines of the exported files without headers."""
    path = scratch_path(spark, "export")
    n = K.export_with_count(mov(spark, d).select("competencia", "uf", "idade"), path, compression="gzip")
    read = FS.read_delimited(spark, path, ";", "UTF-8").agg(F.count(F.lit(1)).alias("lidas"))
    return read.select(F.lit(n).cast("long").alias("linhas"), "lidas")


@register("sep_sniff", "S5 S3 S8", _MOV_COUNTS_SQL)
def sep_sniff(spark, d):
    path = _fixture(spark, d, "comma", lambda: K.export_csv(
        mov(spark, d).select("event_id", "competencia", "uf", "tipomovimentacao", "cbo_ocupacao",
                             "idade", "sexo"), scratch_path(spark, "comma"), ",", True))
    sep = FS.sniff_separator(spark, path)
    return _feed_counts(FS.read_delimited(spark, path, sep or ";"))


@register("headerless_csv", "S6", _MOV_COUNTS_SQL)
def headerless_csv(spark, d):
    path = _fixture(spark, d, "nohead", lambda: K.export_csv(
        mov(spark, d).select("competencia", "idade", "tipomovimentacao"), scratch_path(spark, "nohead"),
        ";", False))
    df = FS.read_delimited(spark, path, ";", header=False, names=["competencia", "idade", "tipomovimentacao"])
    return _feed_counts(df)


# ---------------------------------------------------------------------------
# consolidation into a partitioned dataset
# ---------------------------------------------------------------------------

@register("consolidate", "K1 K2 K3 S7 S9 S16 U1 P5 P7", _m("""
SELECT ano, trimestre, eh_ti, 5 AS colunas, COUNT(*) AS n, COUNT(CASE WHEN trimestre <= 2 THEN idade END) AS n_idade,
       ROUND(COALESCE(SUM(peso_populacional), 0.0), 4) AS peso FROM micro GROUP BY ano, trimestre, eh_ti"""))
def consolidate(spark, d):
    def build():
        base = scratch_path(spark, "consol")
        m = micro(spark, d)
        K.write_dataset(m.filter(F.col("trimestre") <= 2).select("ano", "trimestre", "eh_ti", "idade", "peso_populacional",
                                                                 F.lit("x").alias("cbo_familia_antiga")),
                        f"{base}/parte1", partition_by=("ano", "eh_ti"))
        K.write_dataset(m.filter(F.col("trimestre") > 2).select("ano", "trimestre", "eh_ti", "sexo",
                                                                "peso_populacional"),
                        f"{base}/parte2", partition_by=("ano", "eh_ti"))
        return base
    base = _fixture(spark, d, "consol", build)
    f1 = FS.multi_scan(spark, f"{base}/parte1")
    f2 = FS.multi_scan(spark, f"{base}/parte2")
    con = K.consolidate([f1, f2], forced={"idade": "int"})
    con = con.withColumn("eh_ti", F.col("eh_ti").cast("boolean"))   # partition values are text
    con = SC.drop_present(con, "cbo_familia_antiga")
    return con.groupBy("ano", "trimestre", "eh_ti").agg(
        F.lit(len(con.columns)).alias("colunas"),
        F.count(F.lit(1)).alias("n"), F.count("idade").alias("n_idade"),
        F.round(F.coalesce(F.sum("peso_populacional"), F.lit(0.0)), 4).alias("peso"))


@register("consolidate_incremental", "K2 K3 S14", _m("""
SELECT r.rodada, ano, CAST(eh_ti AS STRING) AS eh_ti, COUNT(*) AS n, CAST(SUM(idade) AS BIGINT) AS soma_idade,
       BOOL_OR(chegada = r.rodada) AS reescrita
FROM lote, (VALUES (1), (2), (3)) r(rodada) WHERE chegada <= r.rodada GROUP BY 1, 2, 3""", extra="""
lote AS (SELECT ano, eh_ti, idade,
    CASE WHEN ano >= (SELECT MAX(ano) - 1 FROM micro) AND trimestre > 2 THEN 2 ELSE 1 END AS chegada FROM micro)"""))
def consolidate_incremental(spark, d):
    """Three runs: most files, then late quarters of the last two years, then nothing new.
    `reescrita`: whether the run changed the partition's files."""
    m = micro(spark, d).select("ano", "trimestre", "eh_ti", "idade", "sexo", "peso_populacional")
    late = (F.col("ano") >= m.agg(F.max("ano")).first()[0] - 1) & (F.col("trimestre") > 2)
    landing, target = scratch_path(spark, "chegada"), scratch_path(spark, "consolidado")
    runs, before = None, None
    for run, part in ((1, m.filter(~late)), (2, m.filter(late)), (3, None)):
        if part is not None:
            part.write.parquet(f"{landing}/lote{run}")
        IN.consolidate(spark, landing, target, ["ano", "eh_ti"])
        files = materialise(IN.data(spark, target).withColumn("_f", F.col("_metadata.file_path")).groupBy("ano", "eh_ti").agg(
            F.count(F.lit(1)).alias("n"), F.sum("idade").alias("soma_idade"),
            F.array_sort(F.collect_set("_f")).alias("arquivos")), "files")
        if before is None:
            now = files.withColumn("reescrita", F.lit(True))
        else:
            old = before.select("ano", "eh_ti", F.col("arquivos").alias("antes"))
            now = files.join(old, ["ano", "eh_ti"], "left").withColumn(
                "reescrita", ~F.col("arquivos").eqNullSafe(F.col("antes")))
        now = now.select(F.lit(run).alias("rodada"), "ano", "eh_ti", "n", "soma_idade", "reescrita")
        runs, before = now if runs is None else runs.unionByName(now), files
    return runs


# ---------------------------------------------------------------------------
# ingestion ledger
# ---------------------------------------------------------------------------

_INPUTS_SQL = """inputs AS (SELECT DISTINCT 'PNADC_0' || CAST(1 + event_id % 4 AS STRING)
                    || CAST(2012 + event_id % 14 AS STRING) || '.txt' AS nome FROM events)"""


def _inputs(spark, d) -> DataFrame:
    e = table(spark, d, "events", "event_id")
    return e.select(F.concat(F.lit("PNADC_0"), (1 + F.col("event_id") % 4).cast("string"),
                             (2012 + F.col("event_id") % 14).cast("string"), F.lit(".txt")).alias("nome")).distinct()


@register("ingest_pending", "S14", with_views("ledger", extra=_INPUTS_SQL) + """
SELECT i.nome FROM inputs i WHERE i.nome NOT IN (
  SELECT nome FROM (SELECT nome, arg_max(status, quando) AS st FROM ledger GROUP BY nome) WHERE st = 'success')""")
def ingest_pending(spark, d):
    return K.pending(_inputs(spark, d), ledger(spark, d))


@register("ingest_status", "S14", with_views("ledger") + """
SELECT nome, arg_max(status, quando) AS status, CAST(SUM(tentativas) AS BIGINT) AS tentativas,
       epoch_us(MAX(quando)) AS ultimo_us FROM ledger GROUP BY nome""")
def ingest_status(spark, d):
    s = K.latest_status(ledger(spark, d))
    return s.select("nome", "status", "tentativas",
                    F.unix_micros(F.col("ultimo").cast("timestamp")).alias("ultimo_us"))


@register("ingest_purge", "S14", with_views("ledger") + """
SELECT status, COUNT(*) AS n FROM ledger
WHERE quando >= (SELECT MAX(quando) FROM ledger) - INTERVAL 7 DAY AND status <> 'failed' GROUP BY status""")
def ingest_purge(spark, d):
    return K.drop_failures(K.purge_older_than(ledger(spark, d), 7)).groupBy("status") \
            .agg(F.count(F.lit(1)).alias("n"))


@register("ingest_failures", "S15", with_views("ledger") + """
SELECT origem, COUNT(*) AS falhas, COUNT(DISTINCT nome) AS arquivos, epoch_us(MAX(quando)) AS ultima_us
FROM ledger WHERE status = 'failed' GROUP BY origem""")
def ingest_failures(spark, d):
    f = K.failures_by_origin(ledger(spark, d))
    return f.select("origem", "falhas", "arquivos",
                    F.unix_micros(F.col("ultima").cast("timestamp")).alias("ultima_us"))


@register("ingest_collisions", "S15", with_views("ledger") + """
SELECT nome, COUNT(*) AS entradas, COUNT(DISTINCT origem) AS origens FROM ledger GROUP BY nome HAVING COUNT(*) > 1""")
def ingest_collisions(spark, d):
    return K.name_collisions(ledger(spark, d))
