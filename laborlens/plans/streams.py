"""Streaming queries (run to completion with availableNow, results read back)."""

from __future__ import annotations

from pyspark.sql import functions as F

from laborlens.plans import feed as FD
from laborlens.plans.registry import register
from laborlens.plans.views import ledger, with_views, mov
from laborlens.session import materialise, scratch_path
from laborlens.streaming import ingest as ST
from laborlens.streaming import ledger as LG

def _land(spark, d, path: str, months) -> str:
    """Land the feed rows of some months as Parquet files, as the feed's partitions lie."""
    month = F.substring("competencia", 5, 2).cast("int")
    mov(spark, d).filter(month.isin(list(months))).write.mode("append").parquet(path)
    return path


def _feed_transform(stream):
    s = stream.withColumns({"ts": F.col("ts").cast("timestamp"),   # event time must be TIMESTAMP
                            "ano": F.substring("competencia", 1, 4).try_cast("int"),
                            "eh_admissao": F.col("tipomovimentacao") == 10,
                            "eh_demissao": F.col("tipomovimentacao").isin(20, 31, 32, 40)})
    from laborlens.functions import scalars as X
    from laborlens import params as P
    return s.withColumn("eh_ti", X.is_it(X.cbo_family("cbo_ocupacao"), P.IT_CODES_REGISTRY))


@register("stream_ingest", "S14", with_views("mov") + """
SELECT rodada, TRY_CAST(substr(competencia, 1, 4) AS INT) AS ano, COUNT(*) AS n
FROM mov, (VALUES (1), (2)) r(rodada) WHERE rodada = 2 OR CAST(substr(competencia, 5, 2) AS INT) <= 6 GROUP BY 1, 2""")
def stream_ingest(spark, d):
    """Two runs: the first half of the year, then only what landed since."""
    landing, out, ckpt = (scratch_path(spark, n) for n in ("landing", "ingested", "ingest-ckpt"))
    year = F.substring("competencia", 1, 4).try_cast("int").alias("ano")
    rounds = None
    for k, months in ((1, range(1, 7)), (2, range(7, 13))):
        _land(spark, d, landing, months)
        schema = spark.read.parquet(landing).schema
        df = spark.read.schema(schema).parquet(ST.ingest_files(spark, landing, schema, out, ckpt))
        r = materialise(df.groupBy(F.lit(k).alias("rodada"), year).agg(F.count(F.lit(1)).alias("n")), "rodada")
        rounds = r if rounds is None else rounds.unionByName(r)
    return rounds


@register("stream_feed_windows", "X25 A23", with_views("mov", extra=FD.FEED_SQL.replace(
    "WHERE idade BETWEEN 14 AND 80", "")) + """
SELECT epoch_us(inicio) AS inicio_us, eh_ti, admissoes, demissoes FROM (
  SELECT time_bucket(INTERVAL 1 DAY, ts) AS inicio, eh_ti,
         COUNT(CASE WHEN eh_admissao THEN 1 END) AS admissoes,
         COUNT(CASE WHEN eh_demissao THEN 1 END) AS demissoes
  FROM feed GROUP BY 1, 2)
WHERE inicio + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM feed) - INTERVAL 2 DAY""")
def stream_feed_windows(spark, d):
    """Daily counts of the windows that the watermark (two days) has closed."""
    landing = _land(spark, d, scratch_path(spark, "landing"), range(1, 13))
    schema = spark.read.parquet(landing).schema
    out = ST.run_windowed(spark, landing, schema, scratch_path(spark, "windows"),
                          scratch_path(spark, "windows-ckpt"), _feed_transform)
    w = spark.read.schema("inicio timestamp, eh_ti boolean, admissoes long, demissoes long").parquet(out)
    return w.select(F.unix_micros(F.col("inicio").cast("timestamp")).alias("inicio_us"), "eh_ti",
                    "admissoes", "demissoes")


LEDGER_DAYS = 3

_REPLAY_SQL = f"""
tent AS (SELECT nome, chave, quando, origem, status, epoch_us(quando) AS us,
                ROW_NUMBER() OVER (PARTITION BY nome ORDER BY quando, chave) AS i FROM ledger),
passo AS (
  SELECT nome, i, chave, origem AS pedido, 'novo' AS decisao, status AS e_status, origem AS e_origem,
         CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS e_tent, us AS e_us, us FROM tent WHERE i = 1
  UNION ALL
  SELECT nome, i, chave, pedido, decisao, CASE WHEN decisao = 'pular' THEN e_status ELSE status END,
         CASE WHEN decisao = 'pular' THEN e_origem ELSE pedido END,
         CASE WHEN decisao = 'pular' THEN e_tent WHEN status = 'success' THEN 0
              WHEN decisao = 'novo' THEN 1 ELSE e_tent + 1 END,
         CASE WHEN decisao = 'pular' THEN e_us ELSE us END, us
  FROM (SELECT t.nome, t.i, t.chave, t.origem AS pedido, t.status, t.us, p.e_status, p.e_origem, p.e_tent, p.e_us,
               CASE WHEN t.us - p.e_us > {LEDGER_DAYS} * 86400000000 THEN 'novo'
                    WHEN p.e_status = 'success' AND p.e_origem = t.origem THEN 'pular'
                    WHEN p.e_origem <> t.origem THEN 'outra_origem' ELSE 'repetir' END AS decisao
        FROM passo p JOIN tent t ON t.nome = p.nome AND t.i = p.i + 1))"""


def _replay_views() -> str:
    return with_views("ledger", extra=_REPLAY_SQL).replace("WITH ", "WITH RECURSIVE ", 1)


def _attempts(spark, d):
    """Attempts by file and origin group, so that files come again from the same place."""
    return ledger(spark, d).select("nome", "chave", "quando", "status",
                                   F.concat(F.lit("o"), (F.floor(F.col("chave") / 520) % 3).cast("string")).alias("origem"))


@register("ledger_replay", "S14", _replay_views().replace("FROM ledger)", "FROM (SELECT * REPLACE ('o' || CAST(chave // 520 % 3 AS STRING) AS origem) FROM ledger))") + """
SELECT nome, chave, us AS quando_us, pedido AS origem, decisao, e_status AS status, CAST(e_tent AS INT) AS tentativas FROM passo""")
def ledger_replay(spark, d):
    """Every ingestion attempt decided by the ledger, which is kept as state over three runs."""
    rows = materialise(_attempts(spark, d), "attempts")
    cuts = rows.agg(F.percentile_approx(F.unix_micros(F.col("quando").cast("timestamp")), [0.4, 0.8])).first()[0]
    us = F.unix_micros(F.col("quando").cast("timestamp"))
    part = F.when(us <= cuts[0], 1).when(us <= cuts[1], 2).otherwise(3)
    landing, out, ckpt = (scratch_path(spark, n) for n in ("attempts", "decisions", "ledger-ckpt"))
    for run in (1, 2, 3):
        rows.filter(part == run).withColumn("quando", F.col("quando").cast("timestamp")).write.mode("append").parquet(landing)
        found = LG.run(spark, landing, out, ckpt, days=LEDGER_DAYS)
    return found.select("nome", "chave", F.unix_micros("quando").alias("quando_us"), "origem", "decisao", "status",
                        "tentativas")
