"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (good or not) are counted per host.  Beta-binomial priors
shrink them level by level: a suffix (last label of the host) towards the whole
corpus, a registered domain (last two labels) towards its suffix, a host towards its
domain.  Each level's prior strength k is estimated by moments: with shares p of n
outcomes around the parent's mean m,

    rho = (sum n (p - m)^2 / (m (1 - m)) - groups) / (outcomes - groups),  k = 1 / rho - 1,

kept between ``RHO`` (0.001, 0.5), and ``RHO_UNKNOWN`` if no group has two outcomes.  A
host passes if its posterior mean minus ``Z`` standard deviations reaches ``MIN_SHARE``.
Hosts without outcomes have their domain's mean with the prior's strength.

Explicit rules (host and path) come first; the longest that fits decides.

Hosts are counted before they are shuffled; the counts and each level's means are written once,
so that no level is computed again for the next.  For the look-up of the verdict, hosts
with over a thousandth of all pages (so fewer than 1000) are broadcast; the others are joined
by host, with the rows of broadcast hosts spread by page.

Defined cases: a null url, or one without ``://``, has the empty host and path, which
count as a host of their own; an outcome for a page that does not exist is ignored; a null
outcome is no outcome; repeated page rows each count and return; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from laborlens.llm.common import materialise

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
Z = 1.64
MIN_SHARE = 0.5
RHO = (0.001, 0.5)
RHO_UNKNOWN = 0.1
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``."""
    rest = F.expr(f"CASE WHEN instr(`{url}`, '://') > 0 "
                  f"THEN substring(`{url}`, instr(`{url}`, '://') + 3) ELSE '' END")
    return (pages.withColumn("_rest", rest)
            .withColumn("_host", F.regexp_extract("_rest", "^[^/?#]*", 0))
            .withColumn("host", F.translate("_host", UPPER, LOWER))
            .withColumn("_tail", F.expr("substring(_rest, length(_host) + 1)"))
            .withColumn("path", F.regexp_extract("_tail", "^[^?#]*", 0))
            .drop("_rest", "_host", "_tail"))


def _fits(rule: tuple) -> Column:
    host, path, _ = rule
    return (((F.col("host") == host) | F.col("host").endswith("." + host))
            & F.col("path").startswith(path))


def _first_rule(value) -> Column:
    """``value`` of the longest rule that fits, else null."""
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*[F.when(_fits(r), F.lit(value(r))) for r in ordered])


def _rho(child: DataFrame, mean: str) -> DataFrame:
    """One row: prior strength k of a level from its groups (n, good, parent mean)."""
    m = F.col(mean)
    spread = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("good") / F.col("n") - m, 2) / (m * (1 - m))))
    groups = F.sum(F.when(F.col("n") > 0, 1).otherwise(0))
    row = child.agg(spread.alias("s"), groups.alias("c"), F.sum("n").alias("t"))
    rho = F.when(F.col("t") > F.col("c"),
                 F.greatest(F.lit(RHO[0]), F.least(F.lit(RHO[1]), (F.col("s") - F.col("c")) / (F.col("t") - F.col("c")))))
    return row.select((1 / F.coalesce(rho, F.lit(RHO_UNKNOWN)) - 1).alias("k"))


def _shrunk(level: DataFrame, mean: str) -> DataFrame:
    """Posterior mean of each group of a level with that level's strength."""
    return level.crossJoin(F.broadcast(_rho(level, mean))).withColumn(     # one row
        "post", (F.col("good") + F.col("k") * F.col(mean)) / (F.col("n") + F.col("k")))


def reputation(hosts: DataFrame) -> DataFrame:
    """Posterior of every host from (host, n, good); adds ``mean``, ``bound`` and ``allow``."""
    parts = (hosts.withColumn("domain", F.substring_index("host", ".", -2))
             .withColumn("suffix", F.substring_index("host", ".", -1)))
    sums = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    suffixes = parts.groupBy("suffix").agg(*sums)
    domains = parts.groupBy("domain", "suffix").agg(*sums)
    whole = suffixes.agg(((F.sum("good") + 0.5) / (F.sum("n") + 1)).alias("all_mean"))
    suffixes = materialise(_shrunk(suffixes.crossJoin(F.broadcast(whole)), "all_mean"), "suffixes")
    domains = materialise(domains.join(suffixes.select("suffix", F.col("post").alias("suffix_mean")), "suffix"),
                          "domains")
    domains = materialise(_shrunk(domains, "suffix_mean"), "domains")
    parts = materialise(parts.join(domains.select("domain", F.col("post").alias("domain_mean")), "domain"), "hosts")
    parts = _shrunk(parts, "domain_mean")
    a = F.col("good") + F.col("k") * F.col("domain_mean")
    b = F.col("n") - F.col("good") + F.col("k") * (1 - F.col("domain_mean"))
    return (parts.withColumn("_a", a).withColumn("_b", b)
            .withColumn("mean", F.col("_a") / (F.col("_a") + F.col("_b")))
            .withColumn("bound", F.col("mean") - Z * F.sqrt(
                F.col("_a") * F.col("_b") / (F.pow(F.col("_a") + F.col("_b"), 2) * (F.col("_a") + F.col("_b") + 1))))
            .withColumn("allow", F.col("bound") >= MIN_SHARE)
            .drop("_a", "_b", "k", "post"))


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``outcomes``: (page_id, good) with good 0 or 1, at most one row counted per page id.
    """
    own = with_host_path(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))).drop("url")
    known = (outcomes.where(F.col("good").isNotNull()).groupBy("page_id")
             .agg(F.min("good").cast("long").alias("good")))
    counted = materialise((own.select("page_id", "host").join(known, "page_id", "left").groupBy("host")
               .agg(F.count(F.lit(1)).alias("pages"), F.count("good").alias("n"),
                    F.coalesce(F.sum("good"), F.lit(0)).alias("good"))), "counted")
    total = counted.agg(F.sum("pages").alias("all_pages"))
    rated = reputation(counted).select("host", "pages", "allow").crossJoin(F.broadcast(total))   # one row
    rated = materialise(rated.withColumn("hot", F.col("pages") * HOT_SHARE > F.col("all_pages")), "rated")
    hot = rated.where("hot").select("host", F.col("allow").alias("hot_allow"))      # under 1000 rows
    rest = rated.where("not hot").select(F.col("host").alias("key"), "allow")
    out = own.join(F.broadcast(hot), "host", "left")
    out = (out.withColumn("key", F.when(F.col("hot_allow").isNull(), F.col("host"))
                          .otherwise(F.concat(F.lit("//"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
           .join(rest, "key", "left"))
    allowed = F.coalesce("hot_allow", "allow")
    return out.select("page_id", "host", "path", _first_rule(lambda r: r[0] + r[1]).alias("rule"),
                      F.coalesce(_first_rule(lambda r: r[2]),
                                 F.when(allowed, "allow").otherwise("block")).alias("verdict"))


def outcomes_from_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, good): good if the page's document is labelled of quality and not toxic.

    The last number of a page's path is the id of the document that it carries.
    """
    doc = F.expr("try_cast(nullif(regexp_extract(path, '/([0-9]+)(/|[.]html)?$', 1), '') as bigint)")
    of_page = with_host_path(pages.select("page_id", "url")).select("page_id", doc.alias("doc_id"))
    good = F.when(F.col("quality").isNotNull(),
                  ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    return (of_page.join(labels.select("doc_id", good.alias("good")), "doc_id")
            .select("page_id", "good"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hp AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h FROM cut)),
docs AS (
  SELECT DISTINCT page_id, TRY_CAST(nullif(regexp_extract(path, '/([0-9]+)(/|[.]html)?$', 1), '') AS BIGINT) AS doc_id
  FROM hp),
known AS (
  SELECT page_id, min(CASE WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS good
  FROM docs JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY page_id),
hosts AS (
  SELECT host, list_extract(string_split(host, '.'), -1) AS suffix,
         array_to_string(string_split(host, '.')[-2:], '.') AS domain,
         count(good) AS n, coalesce(sum(good), 0) AS good
  FROM hp LEFT JOIN known USING (page_id) GROUP BY ALL),
whole AS (SELECT (sum(good) + 0.5e0) / (sum(n) + 1) AS m FROM hosts),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(m) AS m FROM hosts, whole GROUP BY suffix),
sk AS (SELECT 1e0 / coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0) THEN greatest(0.001e0, least(0.5e0,
         (sum(CASE WHEN n > 0 THEN n * pow(good * 1e0 / n - m, 2) / (m * (1 - m)) END) - count(*) FILTER (n > 0))
         / (sum(n) - count(*) FILTER (n > 0)))) END, 0.1e0) - 1 AS k FROM s0),
s1 AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM s0, sk),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good, any_value(s1.m) AS m
       FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix),
dk AS (SELECT 1e0 / coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0) THEN greatest(0.001e0, least(0.5e0,
         (sum(CASE WHEN n > 0 THEN n * pow(good * 1e0 / n - m, 2) / (m * (1 - m)) END) - count(*) FILTER (n > 0))
         / (sum(n) - count(*) FILTER (n > 0)))) END, 0.1e0) - 1 AS k FROM d0),
d1 AS (SELECT domain, (good + k * m) / (n + k) AS m FROM d0, dk),
h0 AS (SELECT host, n, good, m FROM hosts JOIN d1 USING (domain)),
hk AS (SELECT 1e0 / coalesce(CASE WHEN sum(n) > count(*) FILTER (n > 0) THEN greatest(0.001e0, least(0.5e0,
         (sum(CASE WHEN n > 0 THEN n * pow(good * 1e0 / n - m, 2) / (m * (1 - m)) END) - count(*) FILTER (n > 0))
         / (sum(n) - count(*) FILTER (n > 0)))) END, 0.1e0) - 1 AS k FROM h0),
ab AS (SELECT host, good + k * m AS a, n - good + k * (1 - m) AS b FROM h0, hk),
h1 AS (SELECT host, a / (a + b) - 1.64e0 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) >= 0.5e0 AS allow FROM ab),
ruled AS (
  SELECT page_id, host, path, allow,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM hp JOIN h1 USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN allow THEN 'allow' ELSE 'block' END AS verdict
FROM ruled
"""
