"""URL allow/block rules by host-suffix and path-prefix expressions.

A rule is (host, path, verdict). It fits a URL whose host is the rule's host or
a subdomain of it and whose path starts with the rule's path. Each distinct
(host, path) of the input is expanded once into its expressions, every suffix
of the host at a label boundary with every prefix of the path whose length some
rule has. Expressions meet rules in an equi-join on a short hash prefix (the
leading ``PREFIX_HEX`` hex digits of SHA-256); the full digest then confirms,
and the longest rule wins: by host length, then path length, then, for the
same expression, block before allow. A URL that no rule fits gets ``default``.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule, and gets ``default``; a host with leading, trailing or doubled
dots keeps them (labels may be empty); repeated URLs are judged once and every
row returns; empty tables give empty results; clashing column names are
replaced by the output columns. A rule with a null field never fits.

Scale: a host or URL that holds a large share of the rows costs nothing more,
since distinct (host, path) pairs are taken before the expansion with map-side
combining. The rule side is broadcast when its counted size is within
``BROADCAST_RULES``; a larger set is joined by a shuffle on (short hash, salt),
the rules being copied to the ``SALTS`` salts, so that an expression that every
URL has, such as a bare top-level domain, is spread over that many tasks. The
judged pairs are checkpointed, so the join back to the rows may split a hot
key.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qamill.llm.common import aside, table
from qamill.session import materialize

#: Hex digits of the short hash (32 bits).
PREFIX_HEX = 8
#: Rules of at most this count (under 40 MB as rows) are broadcast.
BROADCAST_RULES = 100_000
#: Copies of a larger rule set, and tasks that share one hot expression.
SALTS = 32

#: The production rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; a query that holds ``://`` has no say."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))


def rule_table(spark, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules],
                                 "host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    # a line feed cannot be confused with the border of host and path
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit("\n"), host, path), 256)


def judge(urls: DataFrame, rules: DataFrame, url: str = "url",
          default: str = "allow") -> DataFrame:
    """``urls`` with columns host, path, rule (null if none fits) and verdict."""
    out = ("host", "path", "rule", "verdict")
    urls, (url,), back = aside(urls, url)
    keep = [c for c in urls.columns if c not in out]
    source = urls.select(*keep, host_of(F.col(url)).alias("_h"), path_of(F.col(url)).alias("_p"))
    ruled = (rules.where("host is not null and path is not null and verdict is not null")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
             .select(_digest(F.col("host"), F.col("path")).alias("_full"), "verdict",
                     F.concat("host", "path").alias("rule"),
                     F.length("host").alias("_hl"), F.length("path").alias("_pl"))
             .withColumn("_short", F.substring("_full", 1, PREFIX_HEX)))
    # rule paths have few distinct lengths: no more than the longest path has characters
    lengths = sorted(r[0] for r in ruled.select("_pl").distinct().collect())
    pairs = source.select("_h", "_p").distinct().where(F.col("_h") != "")
    labels = F.split("_h", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    cuts = F.array(*[F.lit(int(n)) for n in lengths]) if lengths else F.array().cast("array<int>")
    pairs = (pairs.withColumn("_s", F.explode(suffixes))
             .withColumn("_n", F.explode(F.filter(cuts, lambda n: n <= F.length("_p"))))
             .withColumn("_full_u", _digest(F.col("_s"), F.col("_p").substr(F.lit(1), F.col("_n"))))
             .withColumn("_short", F.substring("_full_u", 1, PREFIX_HEX)))
    if ruled.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        met = pairs.join(F.broadcast(ruled), "_short")
    else:
        salted = ruled.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = (pairs.withColumn("_salt", F.pmod(F.xxhash64("_h", "_p"), F.lit(SALTS)).cast("int"))
               .join(salted, ["_short", "_salt"]))
    won = (met.where("_full = _full_u").groupBy("_h", "_p")
           .agg(F.max(F.struct("_hl", "_pl", "verdict", "rule")).alias("_w")))
    won = materialize(won.select(F.col("_h").alias("_wh"), F.col("_p").alias("_wp"),
                                 F.col("_w.rule").alias("rule"),
                                 F.col("_w.verdict").alias("verdict")))
    joined = source.join(won, (F.col("_h") == F.col("_wh")) & (F.col("_p") == F.col("_wp")), "left")
    return back(joined.select(*keep, F.col("_h").alias("host"), F.col("_p").alias("path"), "rule",
                              F.coalesce("verdict", F.lit(default)).alias("verdict")))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: verdict of every page's URL under the production rules."""
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    done = judge(pages, rule_table(spark, RULES))
    return done.select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id, strpos(url, '://') AS cut_at, url FROM pages),
cut AS (
  SELECT page_id, CASE WHEN cut_at > 0 THEN substr(url, cut_at + 3) ELSE '' END AS rest FROM parsed),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM cut),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                            ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, rh || rp AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rh) DESC, length(rp) DESC) AS k
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
"""
