"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes (built-in functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread_join

#: Rule tables up to this size are broadcast; larger ones go through a salted shuffle join. A rule counts RULE_BYTES
#: beyond its host and path, for digest, key and verdict.
MAX_BROADCAST_BYTES = 32 << 20
RULE_BYTES = 160
#: Copies of each rule in the shuffle join: a hot expression such as a top-level domain is split over so many keys.
SALTS = 64
#: Hexadecimal characters of the digest that make the join key (32 bits).
PREFIX = 8
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; '' without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; '' without ``://``."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every url by its longest fitting rule: ``pages`` plus host, path, rule and verdict.

    ``rules``: (host, path, verdict) strings. A rule fits its host and all subdomains if the path starts with the
    rule's path. The longest rule wins; at equal length the longer host, then ``block``. Urls that no rule fits get
    ``default`` and a null rule. Null urls and urls without ``://`` have empty host and path and fit no rule with a
    host. Repeated rows and repeated urls stay; columns of ``pages`` named like an output are replaced; empty tables
    give empty results; repeated rules count once.

    Distinct (host, path) pairs are expanded once, so copies of an url cost nothing. Only suffixes of as many labels and
    prefixes of as many characters as some rule has are made, so hosts and paths of any length stay linear. Pairs that
    many urls share, the empty one among them, are dealt in parts when the verdicts are joined back.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"),
                         F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    rules = rules.where("r_host IS NOT NULL AND r_path IS NOT NULL").withColumns({
        "r_digest": F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256)})
    rules = rules.withColumn("key", F.substring("r_digest", 1, PREFIX))
    # Distinct lengths are bounded by the longest rule, so these lists are small whatever the number of rules.
    found = rules.agg(F.collect_set(F.length("r_path")).alias("lengths"), F.collect_set(_labels("r_host")).alias("labels"),
                      F.coalesce(F.sum(F.octet_length("r_host") + F.octet_length("r_path") + RULE_BYTES), F.lit(0)).alias("bytes")).first()
    lengths, labels, size = sorted(found["lengths"]), sorted(found["labels"]), found["bytes"]

    judged = pages.drop("host", "path", "rule", "verdict")
    # The row goes as one column, so that none of its names meets one that is needed here.
    judged = judged.select(F.struct(*[F.col(f"`{c}`") for c in judged.columns]).alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return judged.select("row.*", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    pairs = judged.groupBy("host", "path").agg(F.count("*").alias("weight"))
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels)), lambda n: n <= F.col("n_labels")), lambda n: _last_labels("host", n))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path"))
    made = pairs.where("host <> ''").select("host", "path", _labels("host").alias("n_labels"))
    made = made.withColumn("suffix", F.explode(suffixes)).withColumn("cut", F.explode(cuts))
    made = made.withColumn("digest", F.sha2(F.concat("suffix", F.lit("\n"), F.expr("substring(path, 1, cut)")), 256))
    made = made.select("host", "path", "digest", F.substring("digest", 1, PREFIX).alias("key"))
    if size <= MAX_BROADCAST_BYTES:
        hits = made.join(F.broadcast(rules), "key")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hits = made.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
    hits = hits.where("digest = r_digest")
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("r_verdict") == "block")
    best = hits.groupBy("host", "path").agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), order).alias("best"))
    by = F.col("row.page_id" if "page_id" in pages.columns else "row.url")
    return spread_join(judged, pairs, ["host", "path"], by, found=best).select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def _labels(host: str) -> Column:
    """Number of labels: dots and one."""
    return F.length(host) - F.length(F.replace(F.col(host), F.lit("."))) + 1


def _last_labels(host: str, n: Column) -> Column:
    return F.call_function("substring_index", F.col(host), F.lit("."), -n)
