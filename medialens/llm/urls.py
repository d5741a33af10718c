"""URL filters by expanded expressions and short hash prefixes (native).

A URL is expanded into host-suffix x path-prefix expressions. Expressions and rules meet in an
equi-join on a short prefix of their SHA-256 digests; a hit counts only if the full digests agree;
of a URL's fitting rules the longest decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialens.llm.runtime import BROADCAST_ROWS, col, within_rows, written

#: Hex digits of the digest that the join goes by: 32 bits.
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; '' if there is none."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rules_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """host, path, action of ("block" | "allow", "host/path") pairs; hosts in lower case."""
    parts = [(rule.partition("/")[0], "/" + rule.partition("/")[2], action) for action, rule in rules]
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in parts])
    return spark.range(1).select(F.inline(rows))


def _keyed(df: DataFrame) -> DataFrame:
    digest = F.sha2(F.concat_ws("\n", "e_host", "e_path"), 256)
    return df.withColumn("digest", digest).withColumn("short", F.conv(F.substring("digest", 1, PREFIX_HEX), 16, 10).cast("bigint"))


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of each row of pages.

    `rules` has host, path and action. A rule fits its host and all subdomains if the URL's path starts
    with the rule's path. The longest rule (host and path together, then host) decides; of equal
    rules block goes before allow; rules without host, path or action do not count. Null URLs and those without `://` have an empty host and path,
    which no rule fits. Repeated rows are judged alike; empty tables give empty results.

    Path prefixes end at slashes, as many as the rule with most of them has, and at those lengths that paths of other
    rules have. Host suffixes have as many labels as the host of some rule at most. So a URL of any number of labels or
    slashes makes no more expressions than the rules can use. Expressions are made for distinct (host, path)
    pairs only; a very common URL meets its verdict in a join that Spark can split. The rules are broadcast if they have at
    most BROADCAST_ROWS rows, else both sides are shuffled by the short prefix.
    """
    rules = rules.select(F.col("host").alias("e_host"), F.col("path").alias("e_path"), F.col("action")).filter("e_host <> '' AND e_path IS NOT NULL AND action IS NOT NULL")
    rules = rules.groupBy("e_host", "e_path").agg(F.max("action").alias("action"))
    at_slash = F.endswith("e_path", F.lit("/"))
    labels, slashes = rules.agg(F.max(F.size(F.split("e_host", r"\."))), F.max(F.when(at_slash, F.size(F.split("e_path", "/")) - 1))).first()
    lengths = sorted(r[0] for r in rules.filter(~at_slash).select(F.length("e_path")).distinct().collect())
    judged = pages.select(col(page_id).alias("page_id"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))

    distinct = judged.filter("host <> ''").select("host", "path").distinct()
    distinct = distinct.select("host", "path", F.explode(_suffixes(F.col("host"), labels or 1)).alias("e_host")).filter("e_host <> ''")
    expressions = distinct.select("host", "path", "e_host", F.explode(_prefixes(F.col("path"), slashes or 0, lengths)).alias("e_path"))
    expressions = _keyed(expressions).select("host", "path", "short", "digest")

    keyed = _keyed(rules).select(F.col("short").alias("r_short"), F.col("digest").alias("r_digest"), F.concat("e_host", "e_path").alias("rule"), F.length("e_host").alias("host_length"), "action")
    side = F.broadcast(keyed) if within_rows(keyed, BROADCAST_ROWS) else keyed
    # the digests are confirmed by two inequalities, as an equality would become a second key of the join
    hits = expressions.join(side, (F.col("short") == F.col("r_short")) & F.col("digest").between(F.col("r_digest"), F.col("r_digest")))
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), "host_length", F.col("action"), "rule")).alias("best"))
    # written, so that the join shuffles it anew: only then can Spark split the rows of one URL over tasks
    best = written(best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), F.col("best.rule").alias("rule"), F.col("best.action").alias("action")), "verdicts")
    # no broadcast: Parquet files of so like rows are far smaller than the rows
    both = judged.filter("host <> ''").join(best.hint("merge"), (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    rest = judged.filter("host = ''").withColumns({"rule": F.lit(None).cast("string"), "action": F.lit(None).cast("string")})
    rows = both.select("page_id", "host", "path", "rule", "action").unionByName(rest)
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def _suffixes(host: Column, most: int) -> Column:
    """The last 1 to `most` labels of a host."""
    last = F.substring_index(host, ".", -most)
    return F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(F.split(last, r"\.")))), lambda n: F.call_function("substring_index", last, F.lit("."), -n))


def _prefixes(path: Column, slashes: int, lengths: Sequence[int]) -> Column:
    """Prefixes of a path that end at one of its first so many slashes, or have one of the lengths."""
    first = F.substring_index(path, "/", slashes + 1)
    n = F.least(F.lit(slashes), F.size(F.split(first, "/")) - 1)
    at_slash = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.call_function("substring_index", first, F.lit("/"), k), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    if not lengths:
        return at_slash
    fits = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.array_union(at_slash, F.transform(fits, lambda n: F.substring(path, F.lit(1), n)))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """The page ids (with repeats) whose verdict is allow."""
    return judge_urls(pages, rules, page_id, url, default).filter("verdict = 'allow'").select("page_id")
