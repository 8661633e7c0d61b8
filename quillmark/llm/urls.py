"""URL filters by a sort-merge range join, in DataFrame operations only.

A host's canonical key is its labels in reverse, each followed by a dot, so a
rule's host and all its subdomains form one interval of keys, and the
intervals of two rules are nested or disjoint. The rules become events: where
an interval opens, the stack of active rules is that host's and its
ancestors'; where it closes, the stack falls back to the parent's. URLs and
events are merged in key order, and a running window carries the stack of
active nested rules to each URL, where the longest rule whose path fits wins.

URLs are dealt over salted slices, each of which sweeps its own copy of the
events, so a host that holds most of the rows is spread like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Reversed labels, each followed by a dot, as bytes."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def rule_events(rules: DataFrame) -> DataFrame:
    """(key, stack) where the stack of active rules changes; rules: (host, path, verdict)."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").distinct()
    own = rules.groupBy("host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    labels = F.split("host", r"\.")
    above = own.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("up", "parent"))
    chain = above.join(own.select(F.col("host").alias("parent"), F.col("own").alias("theirs")), "parent")
    stacks = chain.groupBy("host").agg(F.flatten(F.collect_list("theirs")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("theirs")))).alias("outer"))
    opens = stacks.select(host_key(F.col("host")).alias("key"), "stack")
    closes = stacks.select(F.concat(host_key(F.col("host")), F.lit(b"\xff")).alias("key"), F.col("outer").alias("stack"))
    return opens.unionByName(closes)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", slices: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages`` (page_id, url; other columns are ignored).

    A rule fits its host and all subdomains if the URL's path starts with the rule's; of the rules that fit, the longest (host
    and path together) wins, of equal rules a block. Without a rule the verdict is ``default``. Null URLs and those without
    ``://`` have empty host and path. Without rules every page gets the default; an empty table gives an empty result.
    """
    slices = slices or 4 * common.shuffle_width(pages.sparkSession)
    url = F.col("url")
    points = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"))
    none = F.lit(None).cast("array<struct<host:string,path:string,verdict:string>>")
    points = points.select(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(slices)).cast("int").alias("slice"), host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), none.alias("stack"), "page_id", "host", "path")
    events = rule_events(rules).select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "key", F.lit(0).alias("kind"), "stack")
    swept = points.unionByName(events, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(Window.partitionBy("slice").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("n"), F.concat(r["host"], r["path"]).alias("rule"), r["verdict"].alias("verdict"))))
    return swept.where("kind = 1").withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


#: Rules of the registered query (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule list as a DataFrame, without a Python data source."""
    rows = ", ".join("(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS r(host, path, verdict)")


def op3_url_filter(spark, sf_dir):
    """Query: verdicts of all pages."""
    return judge(common.table(spark, sf_dir, "pages"), rules_table(spark, RULES))


ORACLE_SQL = {
    "op3_url_filter": r"""
WITH r(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u AS (SELECT page_id,
  CASE WHEN contains(url, '://') THEN translate(regexp_extract(url[strpos(url, '://') + 3:], '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url[strpos(url, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
m AS (SELECT page_id, max_by(rh || rp, length(rh) + length(rp)) AS rule, max_by(v, length(rh) + length(rp)) AS verdict
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
}
