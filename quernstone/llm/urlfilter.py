"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

A rule has a host, a path and a verdict. It fits its host and every subdomain, for
URLs whose path starts with the rule's. Of all rules that fit, the one longest as
text (host and path) wins; of equally long ones the one with the longer host, then a
blocking one.

1. Each distinct host and path is expanded: every suffix of the host at a dot, with
   every prefix of the path that ends in a slash, and with none. Suffixes of more
   labels and prefixes of more slashes than any rule has are left out: no rule can
   match them.
2. A rule's own expression is its host and its path up to the last slash.
   Expressions and rules are joined on the first SHORT hexadecimal digits of their
   SHA-256 digests.
3. A pair counts if the full digests are equal and the rest of the rule's path
   follows in the URL's; the winner is a maximum for each host and path.

Places (host, path) are aggregated before and after the join, apart in SALTS parts by
a hash of the row, so that neither a frequent place nor a frequent host gathers in a
task; copies of one row are left to Spark's splitting of skewed joins. Rules are
broadcast up to RULE_LIMIT rows and RULE_BYTES bytes, both counted; beyond that they
are shuffled, and dealt to SALTS parts as well.

Defined cases: a null url, or one without ``://``, has an empty host and path; only
A-Z of a host are lower-cased, ports and user names are part of it; rules without a
host or verdict fit nothing, a null path is empty; repeated rules count once, and
contradicting ones block; repeated rows of pages are each judged; extra columns stay
in ``row``; no rows give no rows, and no rules leave every row to ``otherwise``. Urls
of any length are judged whole: an expansion's size is bounded by the rules' depth.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hexadecimal digits of a digest that the join looks at.
SHORT = 8
#: Most rules that are broadcast, and most bytes of their hosts and paths.
RULE_LIMIT = 50_000
RULE_BYTES = 4 << 20
#: Parts into which a frequent host and path, or a frequent expression, is dealt.
SALTS = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """A short list of (verdict, host, path) as rules."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def _folder(path: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(path, "(?s)^.*/", 0)


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat(host, folder), 256)


def _hashed(rules: DataFrame) -> DataFrame:
    """host, path, verdict and the digest of each rule that can fit something; contradicting ones block."""
    host = F.translate(F.col("host"), _UPPER, _LOWER)
    clean = rules.select(host.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict")).filter("rule_host <> '' AND verdict IS NOT NULL")
    once = clean.groupBy("rule_host", "rule_path").agg(F.max(F.struct((F.col("verdict") == "block").alias("blocks"), "verdict")).alias("best"))
    digest = _digest(F.col("rule_host"), _folder(F.col("rule_path")))
    return once.select("rule_host", "rule_path", "best.verdict", "best.blocks", digest.alias("rule_digest")).withColumn("short", F.substring("rule_digest", 1, SHORT))


def _expressions(labels: int, slashes: int) -> Column:
    """All expressions of the columns host and path, up to so many labels and slashes."""
    part, cut = F.split("host", "\\."), F.split("path", "/", slashes + 1)
    hosts = F.transform(F.sequence(F.lit(1), F.least(F.size(part), F.lit(labels))), lambda k: F.array_join(F.slice(part, -k, k), "."))
    whole = F.size(cut) - 1  # the last one is what follows the last slash looked at
    folders = F.transform(F.sequence(F.lit(0), whole), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(cut, F.lit(1), k), "/"), F.lit("/"))))
    return F.flatten(F.transform(hosts, lambda h: F.transform(folders, lambda f: _digest(h, f))))


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url") -> DataFrame:
    """row (all columns of pages), host, path, rule (text of the winning one, or null) and verdict of every row.

    rules has host, path and verdict (allow or block); otherwise is the verdict of
    what no rule fits.
    """
    hashed = _hashed(rules)
    size = hashed.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("rule_host") + F.octet_length("rule_path")).alias("bytes"),
        F.max(F.size(F.split("rule_host", "\\."))).alias("labels"), F.max(F.length(F.regexp_replace("rule_path", "[^/]", ""))).alias("slashes"),
    ).first()
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    if not size.n:
        return rows.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    place = ["host", "path", "salt"]
    expanded = rows.filter("host <> ''").select(*place).distinct().select(*place, F.explode(_expressions(size.labels, size.slashes)).alias("digest"))
    expanded = expanded.withColumn("short", F.substring("digest", 1, SHORT))
    if size.n <= RULE_LIMIT and size.bytes <= RULE_BYTES:
        met = expanded.join(F.broadcast(hashed), "short")
    else:
        dealt = hashed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("part", F.pmod(F.xxhash64(*place), F.lit(SALTS)).cast("int")).join(dealt, ["short", "part"])
    fits = met.filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(text).alias("n"), F.length("rule_host").alias("host_n"), "blocks", text.alias("rule"), "verdict"))
    won = fits.groupBy(*place).agg(best.alias("best")).select(*place, "best.rule", "best.verdict")
    return rows.join(won, place, "left").select("row", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
