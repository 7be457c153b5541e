"""URL allow and block rules by hashed host-suffix and path-prefix expressions.

A rule is a host and a path; it fits the host itself and its subdomains, for urls
whose path starts with the rule's. Every url is expanded into the host suffixes and
path prefixes that some rule could have (as many labels and slashes as the rules hold,
and the exact lengths of rule paths that do not end in ``/``). Expressions and rules
meet in an equi-join on the first four bytes of their SHA-256; the full digests then
confirm, and the longest rule wins (then the longer host, then block).

Only DataFrame functions. The join key is salted, as one expression may hold a third
of all urls; Spark broadcasts the rule side by itself only below its size threshold.
Null urls and urls without ``://`` have an empty host and path. Equal rows each keep
their row. A rule listed twice counts once; listed as both, it blocks.

A url of any length has as many expressions as the rules' labels, slashes and lengths allow;
an empty table gives no rows, an empty rule table the default verdict; only the id and the
url are read, so other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def expressions(host: Column, path: Column, labels: int, slashes: int, lengths: list[int]) -> Column:
    """Host suffixes of at most ``labels`` labels, each with the path prefixes that end
    in one of the first ``slashes`` slashes or have one of ``lengths``."""
    parts, pieces = _labels(host), F.split(path, "/")
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)),
                        lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    count = F.least(F.size(pieces) - 1, F.lit(slashes))
    folders = F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                                            lambda k: F.concat(F.array_join(F.slice(pieces, 1, k), "/"), F.lit("/"))))
    folders = F.coalesce(folders, F.array().cast("array<string>"))
    exact = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>")
    prefixes = F.array_distinct(F.filter(F.concat(folders, exact), lambda p: p.isNotNull()))
    return F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
          default: str = "allow", salts: int = 8) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``. ``rules`` has host,
    path and verdict (allow or block); rows with a null in these are no rules."""
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    rules = rules.dropna().groupBy("h", "p").agg(F.max("v").alias("v"))
    shape = rules.agg(F.max(F.size(_labels(F.col("h")))).alias("labels"),
                      F.max(F.length("p") - F.length(F.replace(F.col("p"), F.lit("/"), F.lit("")))).alias("slashes"),
                      F.collect_set(F.when(~F.endswith(F.col("p"), F.lit("/")), F.length("p"))).alias("lengths")).first()
    rule = F.concat("h", "p")
    buckets = (rules.select(F.sha2(rule, 256).alias("digest"), F.length(rule).alias("n"), F.length("h").alias("nh"), F.col("v").alias("verdict"), rule.alias("rule"))
               .groupBy(F.substring("digest", 1, 8).alias("short"))
               .agg(F.collect_list(F.struct("digest", "n", "nh", "verdict", "rule")).alias("bucket"))
               .select("short", "bucket", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    listed = expressions(F.col("host"), F.col("path"), shape["labels"] or 1, shape["slashes"] or 0, sorted(shape["lengths"] or []))
    each = urls.withColumn("e", listed).withColumn("m", F.greatest(F.size("e"), F.lit(1)))
    each = each.select("page_id", "url", "host", "path", "m", F.posexplode_outer("e").alias("at", "one"))
    digest = F.sha2("one", 256)
    each = each.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 8))
    each = each.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "at"), F.lit(salts)).cast("int"))
    met = each.join(buckets, ["short", "salt"], "left")
    fit = F.filter("bucket", lambda b: b["digest"] == F.col("digest"))
    best = F.when(F.size(fit) > 0, F.struct(*[fit[0][c].alias(c) for c in ("n", "nh", "verdict", "rule")]))
    rows = met.groupBy("page_id", "url", "host", "path").agg(F.max(best).alias("best"), F.count("*").alias("c"), F.max("m").alias("m"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), (F.col("c") / F.col("m")).cast("int"))).alias("copy"))
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
