"""Microdata views over the bundled test tables (Spark builders + oracle SQL).

The test tables hold no labour microdata, so each view re-reads them as one:

* ``micro``    household-survey records  = lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ part
* ``vinculos`` employer-registry rows, text-typed, same join
* ``mov``      hire/dismissal feed rows  = events
* ``ledger``   ingestion ledger entries  = events

Every builder is lazy; Catalyst prunes unused columns down to the parquet scans.
The nation dimension is broadcast: it is a fixed 25-row table at any scale.  All
other joins are left to AQE, which broadcasts only sides whose runtime size is
under ``spark.sql.autoBroadcastJoinThreshold`` and sort-merges the rest.

``*_SQL`` strings define the same views for DuckDB (the independent oracle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laborlens.functions import scalars as X
from laborlens.sources.tables import table

# Test parameters for the synthetic views (brands 'Brand#11' ... -> family '0011' ...).
TEST_IT_CODES = ("0011", "0012", "0013", "0021", "0022")
TEST_N_WAGES = 6
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGISTRY_SEX = ("1", "2", "masculino", "F")
FEED_TYPES = {"signup": 10, "purchase": 20, "click": 31, "view": 32, "error": 40}
FEED_CBO = ("212405", "214105", "317105", "411005", "521110", "782510")


def test_wage(ano) -> "F.Column":
    """Synthetic minimum wage of the test views: 10000 + 500 * (ano - 1995)."""
    return (F.lit(10000.0) + F.lit(500.0) * (F.col(ano) - 1995)).cast("double")


def _base_join(spark: SparkSession, d: str, it_codes=None) -> DataFrame:
    """The five-table join.  With `it_codes`, the occupation family and IT flag
    are derived on the part dimension *before* the join (once per part, not
    once per fact row)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
               "l_linestatus", "l_shipdate")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    n = F.broadcast(table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"))
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    if it_codes is not None:
        p = p.withColumn("cbo_familia", X.cbo_family("p_brand"))
        p = p.withColumn("eh_ti", X.is_it("cbo_familia", it_codes))
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    ocn = o.join(cn, o.o_custkey == cn.c_custkey)
    return (li.join(ocn, li.l_orderkey == ocn.o_orderkey)
              .join(p, li.l_partkey == p.p_partkey))


def micro(spark: SparkSession, d: str, it_codes=TEST_IT_CODES) -> DataFrame:
    j = _base_join(spark, d, it_codes)
    seg = X.map_literal({s: i + 1 for i, s in enumerate(SEGMENTS)})
    ano = F.year("l_shipdate").cast("int")
    income = F.when(F.col("l_tax") < 0.01, F.lit(None).cast("double")).otherwise(
        F.col("l_extendedprice") * (1 - F.col("l_discount")))
    df = j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        F.col("c_custkey").alias("custkey"),
        ano.alias("ano"),
        F.quarter("l_shipdate").cast("int").alias("trimestre"),
        (F.col("n_nationkey") + 11).cast("int").alias("uf"),
        F.col("n_name").alias("uf_nome"),
        F.col("n_regionkey").cast("int").alias("regiao"),
        (F.col("p_size") * 2).cast("int").alias("idade"),
        (1 + F.col("c_custkey") % 2).cast("int").alias("sexo"),
        (1 + F.col("l_suppkey") % 5).cast("int").alias("cor_raca"),
        F.col("p_brand").alias("cbo_ocupacao"),
        seg[F.col("c_mktsegment")].cast("int").alias("nivel_instrucao"),
        (F.col("l_partkey") % 18).cast("int").alias("anos_estudo"),
        (1 + F.col("l_suppkey") % 15).cast("int").alias("curso_mais_elevado"),
        (1 + F.col("l_suppkey") % 12).cast("int").alias("curso_mais_elevado_antes_2015"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
         .when(F.col("l_linenumber") == 6, F.lit(0.0))
         .otherwise(F.col("l_quantity")).alias("peso_populacional"),
        income.alias("rendimento_trabalho_principal"),
        F.col("l_extendedprice").alias("rendimento_bruto_mensal"),
        F.col("l_quantity").cast("int").alias("horas_trabalhadas_semana"),
        F.when(F.col("l_returnflag") == "R", 2).otherwise(1).cast("int").alias("ocupado"),
        F.when(F.col("l_returnflag") == "A", 2).otherwise(1).cast("int").alias("forca_trabalho"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(2).cast("int").alias("carteira_assinada"),
        (1 + F.col("l_suppkey") % 2).cast("string").alias("tipo_area"),
        (((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber"))
          % 1000).cast("double") / 1000).alias("y_proba"),
        "cbo_familia", "eh_ti",
    )
    df = df.withColumn("ano_nascimento", (F.col("ano") - F.col("idade")).cast("int"))
    df = df.withColumn("y_true", X.income_target("rendimento_trabalho_principal",
                                                  test_wage("ano"), TEST_N_WAGES).cast("int"))
    return df


def vinculos(spark: SparkSession, d: str) -> DataFrame:
    """Registry rows as raw text (header names as in the file, incl. 'vinculo_ativo_31/12').
    Text columns that depend on one dimension only are formatted on that
    dimension before the join (once per order / customer / part)."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
               "l_quantity", "l_linestatus", "l_shipdate")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice") \
        .withColumn("vl_remun_media_nom", F.col("o_totalprice").cast("string"))
    sex = F.array(*[F.lit(s) for s in REGISTRY_SEX])
    c = table(spark, d, "customer", "c_custkey", "c_nationkey") \
        .withColumn("sexo_trabalhador", F.element_at(sex, (F.col("c_custkey") % 4 + 1).cast("int")))
    n = F.broadcast(table(spark, d, "nation", "n_nationkey"))
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size").select(
        "p_partkey", F.col("p_brand").alias("cbo_ocupacao_2002"),
        (F.col("p_size") * 2).cast("string").alias("idade"),
        (1 + F.col("p_partkey") % 11).cast("string").alias("escolaridade_apos_2005"))
    cn = c.join(n, c.c_nationkey == n.n_nationkey)
    ocn = o.join(cn, o.o_custkey == cn.c_custkey)
    j = li.join(ocn, li.l_orderkey == ocn.o_orderkey).join(p, li.l_partkey == p.p_partkey)
    return j.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"),
        F.year("l_shipdate").cast("string").alias("ano"),
        "sexo_trabalhador",
        ((F.col("n_nationkey") + 11) * 10000 + F.col("l_suppkey") % 10000).cast("string")
        .alias("mun_trab"),
        "escolaridade_apos_2005", "cbo_ocupacao_2002", "idade",
        F.when(F.col("l_linestatus") == "O", "SIM").otherwise("NAO").alias("vinculo_ativo_31/12"),
        "vl_remun_media_nom",
        F.col("l_quantity").cast("int").cast("string").alias("qtd_hora_contr"),
    )


def mov(spark: SparkSession, d: str) -> DataFrame:
    """Feed rows (one per event), standard names after the header rename."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    types = X.map_literal(FEED_TYPES)
    cbo = F.array(*[F.lit(s) for s in FEED_CBO])
    return e.select(
        "event_id", "user_id", "ts",
        F.concat((2020 + F.col("user_id") % 5).cast("string"),
                 F.lpad((1 + F.col("event_id") % 12).cast("string"), 2, "0")).alias("competencia"),
        (11 + F.col("user_id") % 25).cast("int").alias("uf"),
        types[F.col("event_type")].cast("int").alias("tipomovimentacao"),
        F.when(F.col("event_type") == "signup", 1).otherwise(-1).cast("int")
        .alias("saldo_movimentacao"),
        F.element_at(cbo, (F.col("user_id") % 6 + 1).cast("int")).alias("cbo_ocupacao"),
        (14 + F.col("user_id") % 67).cast("int").alias("idade"),
        (1 + F.col("user_id") % 2).cast("string").alias("sexo"),
        F.replace(F.col("value").cast("string"), F.lit("."), F.lit(",")).alias("salario"),
        F.when(F.col("event_id") % 20 == 0, "1").otherwise("0").alias("indicador_aprendiz"),
    )


def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion ledger: one entry per event (key, origin, status, attempts, time, file name)."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    return e.select(
        F.col("event_id").alias("chave"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("origem"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        (1 + F.col("event_id") % 3).cast("int").alias("tentativas"),
        F.col("ts").alias("quando"),
        F.concat(F.lit("PNADC_0"), (1 + F.col("event_id") % 4).cast("string"),
                 (2012 + F.col("event_id") % 13).cast("string"), F.lit(".txt")).alias("nome"),
    )


# ---------------------------------------------------------------------------
# Oracle SQL (DuckDB dialect; tables pre-registered as views)
# ---------------------------------------------------------------------------

_IT_SQL = ", ".join(f"'{c}'" for c in TEST_IT_CODES)
_FAMILY_SQL = ("NULLIF(lpad(NULLIF(regexp_replace(regexp_replace(trim(p.p_brand), '\\.0+$', ''), "
               "'[^0-9]', '', 'g'), ''), 4, '0'), '0000')")

MICRO_SQL = f"""
micro AS (
  SELECT *, COALESCE(cbo_familia IN ({_IT_SQL}), false) AS eh_ti,
         CAST(ano - idade AS INT) AS ano_nascimento,
         CAST(CASE WHEN rendimento_trabalho_principal IS NOT NULL
                    AND rendimento_trabalho_principal >= {TEST_N_WAGES}.0 * (10000.0 + 500.0 * (ano - 1995))
                   THEN 1 ELSE 0 END AS INT) AS y_true
  FROM (
    SELECT l.l_orderkey * 10 + l.l_linenumber AS record_id,
           l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate,
           c.c_custkey AS custkey,
           CAST(year(l.l_shipdate) AS INT) AS ano,
           CAST(quarter(l.l_shipdate) AS INT) AS trimestre,
           CAST(n.n_nationkey + 11 AS INT) AS uf,
           n.n_name AS uf_nome,
           CAST(n.n_regionkey AS INT) AS regiao,
           CAST(p.p_size * 2 AS INT) AS idade,
           CAST(1 + c.c_custkey % 2 AS INT) AS sexo,
           CAST(1 + l.l_suppkey % 5 AS INT) AS cor_raca,
           p.p_brand AS cbo_ocupacao,
           CAST(CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
                WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS INT)
             AS nivel_instrucao,
           CAST(l.l_partkey % 18 AS INT) AS anos_estudo,
           CAST(1 + l.l_suppkey % 15 AS INT) AS curso_mais_elevado,
           CAST(1 + l.l_suppkey % 12 AS INT) AS curso_mais_elevado_antes_2015,
           CAST(CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_linenumber = 6 THEN 0.0
                ELSE l.l_quantity END AS DOUBLE) AS peso_populacional,
           CASE WHEN l.l_tax < 0.01 THEN NULL ELSE l.l_extendedprice * (1 - l.l_discount) END
             AS rendimento_trabalho_principal,
           l.l_extendedprice AS rendimento_bruto_mensal,
           CAST(l.l_quantity AS INT) AS horas_trabalhadas_semana,
           CAST(CASE l.l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS INT) AS ocupado,
           CAST(CASE l.l_returnflag WHEN 'A' THEN 2 ELSE 1 END AS INT) AS forca_trabalho,
           CAST(CASE l.l_linestatus WHEN 'O' THEN 1 ELSE 2 END AS INT) AS carteira_assinada,
           CAST(1 + l.l_suppkey % 2 AS STRING) AS tipo_area,
           CAST((l.l_partkey * 7919 + l.l_suppkey * 104729 + l.l_linenumber) % 1000 AS DOUBLE) / 1000
             AS y_proba,
           {_FAMILY_SQL} AS cbo_familia
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
  ) base
)"""

VINCULOS_SQL = """
vinculos AS (
  SELECT l.l_orderkey * 10 + l.l_linenumber AS record_id,
         CAST(year(l.l_shipdate) AS STRING) AS ano,
         CASE c.c_custkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'masculino' ELSE 'F' END
           AS sexo_trabalhador,
         CAST((n.n_nationkey + 11) * 10000 + l.l_suppkey % 10000 AS STRING) AS mun_trab,
         CAST(1 + l.l_partkey % 11 AS STRING) AS escolaridade_apos_2005,
         p.p_brand AS cbo_ocupacao_2002,
         CAST(p.p_size * 2 AS STRING) AS idade,
         CASE l.l_linestatus WHEN 'O' THEN 'SIM' ELSE 'NAO' END AS "vinculo_ativo_31/12",
         CAST(o.o_totalprice AS STRING) AS vl_remun_media_nom,
         CAST(CAST(l.l_quantity AS INT) AS STRING) AS qtd_hora_contr
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN part p ON l.l_partkey = p.p_partkey
)"""

MOV_SQL = """
mov AS (
  SELECT event_id, user_id, ts,
         CAST(2020 + user_id % 5 AS STRING) || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0')
           AS competencia,
         CAST(11 + user_id % 25 AS INT) AS uf,
         CAST(CASE event_type WHEN 'signup' THEN 10 WHEN 'purchase' THEN 20 WHEN 'click' THEN 31
              WHEN 'view' THEN 32 WHEN 'error' THEN 40 END AS INT) AS tipomovimentacao,
         CAST(CASE WHEN event_type = 'signup' THEN 1 ELSE -1 END AS INT) AS saldo_movimentacao,
         CASE user_id % 6 WHEN 0 THEN '212405' WHEN 1 THEN '214105' WHEN 2 THEN '317105'
              WHEN 3 THEN '411005' WHEN 4 THEN '521110' ELSE '782510' END AS cbo_ocupacao,
         CAST(14 + user_id % 67 AS INT) AS idade,
         CAST(1 + user_id % 2 AS STRING) AS sexo,
         replace(CAST(value AS STRING), '.', ',') AS salario,
         CASE WHEN event_id % 20 = 0 THEN '1' ELSE '0' END AS indicador_aprendiz
  FROM events
)"""

LEDGER_SQL = """
ledger AS (
  SELECT event_id AS chave, 'u' || CAST(user_id AS STRING) AS origem,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
         CAST(1 + event_id % 3 AS INT) AS tentativas, ts AS quando,
         'PNADC_0' || CAST(1 + event_id % 4 AS STRING) || CAST(2012 + event_id % 13 AS STRING)
           || '.txt' AS nome
  FROM events
)"""

_VIEW_SQL = {"micro": MICRO_SQL, "vinculos": VINCULOS_SQL, "mov": MOV_SQL, "ledger": LEDGER_SQL}


def with_views(*names: str, extra: str = "") -> str:
    """`WITH v1 AS (...), v2 AS (...)` prefix for an oracle query."""
    parts = [_VIEW_SQL[n].strip() for n in names]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n"
