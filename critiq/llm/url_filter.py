"""URL filters by a sort-merge range join on reversed-host keys; DataFrame functions only.

``blog.example.net`` becomes the key ``net.example.blog.``, so a rule for a host and all its subdomains
is the interval of keys that begin with the rule's key: from ``net.example.`` to just before
``net.example/`` (``/`` follows ``.``). Such intervals nest or are apart. Their ends, sorted, cut the key
space into segments, and the rules open in a segment are a stack: the host's own rules on top of those of
its parents. A URL belongs to the segment of the last end at or before its key, which one sorted sweep
over ends and URLs together finds; of the open rules whose path begins the URL's path, the longest wins.

The sweep has no key to be hot: URLs are dealt evenly over salts, each salt sweeps its own copy of the ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# white space is part of a host or path like any other character
HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each closed by a point."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def ends(rules: DataFrame) -> DataFrame:
    """(key, turn, open_rules): the segments' first keys, with the stack of rules open from there.

    turn orders ends of one key: closing before opening, inner before outer. A stack holds the rules
    of a host and of its parents, found by an equal join on the parents' keys, as many as labels.
    """
    own = rules.groupBy("key").agg(F.collect_set(F.struct("rule", "path", "verdict")).alias("own"))
    labels = F.split(F.expr("left(key, length(key) - 1)"), r"\.")
    up = own.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("depth", "parent"))
    chain = up.join(own.select(F.col("key").alias("parent"), "own"), "parent")
    stack = chain.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("with_own"), F.flatten(F.collect_list(F.when(F.col("parent") != F.col("key"), F.col("own")))).alias("without"))
    size = F.length("key")
    begin = stack.select("key", F.lit(1 << 30).alias("turn"), F.col("with_own").alias("open_rules"))
    finish = stack.select(F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("key"), (-size).alias("turn"), F.col("without").alias("open_rules"))
    return begin.unionByName(finish)


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of pages, repeated and null ids included.

    rules: (host, path, verdict), host without and path with its leading ``/``; a rule fits its host and
    all subdomains if the URL's path starts with its path (null or empty path: any path). The longest
    rule (host and path together, then the longer host, then ``block`` before ``allow``) wins; without a
    rule the verdict is ``default`` and rule is null. Null URLs and URLs without ``://`` have an empty
    host and path and no rule. Rules without a host are ignored. Empty pages give an empty result, empty
    rules the default for all; other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    salts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    lower = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rules = rules.filter("host is not null and host != ''").select(lower.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.select(host_key(F.col("host")).alias("key"), F.concat("host", "path").alias("rule"), "path", "verdict")
    cut = ends(rules).select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "key", F.col("turn").alias("turn"), "open_rules", F.lit(False).alias("is_url"), F.lit(None).cast(pages.schema[id_col].dataType).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    url = F.col(url_col).cast("string")
    urls = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    salt = F.pmod(F.xxhash64("id", "host", "path", F.spark_partition_id()), F.lit(salts)).cast("int")
    urls = urls.select(salt.alias("salt"), host_key(F.col("host")).alias("key"), F.lit((1 << 30) + 1).alias("turn"), F.lit(None).cast(cut.schema["open_rules"].dataType).alias("open_rules"), F.lit(True).alias("is_url"), "id", "host", "path")
    sweep = Window.partitionBy("salt").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = cut.unionByName(urls).withColumn("open_rules", F.last("open_rules", ignorenulls=True).over(sweep)).filter("is_url")
    fits = F.filter(F.coalesce("open_rules", F.array().cast(cut.schema["open_rules"].dataType)), lambda r: (F.col("host") != "") & F.startswith(F.col("path"), r["path"]))
    rank = F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("a"), (-F.length(r["path"])).alias("b"), r["verdict"].alias("v"), r["rule"].alias("rule")))
    best = F.array_max(rank)
    return met.select(F.col("id").alias(id_col), "host", "path", best.alias("best")).select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
