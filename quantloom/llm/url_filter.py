"""URL rules by hash lookup.

Each URL is expanded into host suffixes and path prefixes; the expressions meet the rules in an equi-join on
the first bytes of their digests; the full digest and the rule's own path then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, durable, keyed_join

#: Hex digits of the digest that the join compares.
PREFIX = 8
#: Bytes of rules in memory, about, up to which all tasks get them whole.
RULES = 4 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def dots(host: Column) -> Column:
    return F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))


def host_suffixes(host: Column, counts: list[int]) -> Column:
    """The last ``n`` labels of a host, for those of ``counts`` that it has."""
    found = [F.when(dots(host) >= n - 1, F.substring_index(host, ".", -n)) for n in counts]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def slashes(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def path_prefixes(path: Column, depths: list[int]) -> Column:
    """Prefixes that end in the path's slash number ``d``, for the ``depths`` that it has; at depth 0 the empty one."""
    found = [F.when(slashes(path) >= d, F.concat(F.substring_index(path, "/", d), F.lit("/"))) if d else F.lit("") for d in depths]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (``host``, ``path``, ``verdict``) with the digest of host and last directory; repeated rules once, block before allow."""
    r = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("rule_verdict")).where("rule_host <> ''")
    r = r.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 1)
    r = r.withColumn("depth", slashes(folder)).withColumn("labels", dots(F.col("rule_host")) + 1).withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host", folder), 256))
    return r.withColumn("short", F.substring("digest", 1, PREFIX))


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Return ``page_id, host, path, rule, verdict`` for every row of ``pages``.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest rule wins; of
    equally long ones the one with the longer host, then block. No fit: ``rule`` null, verdict ``default``.

    * null url, or one without ``://``: host and path empty, no rule fits
    * repeated rows are judged each on its own; empty tables give empty results
    * other columns of ``pages`` are not read

    Hosts and paths are cut at the numbers of labels and the depths that rules have, and nowhere else, so a host or path costs its length for each of these. URLs are
    judged once for each distinct (host, path), so a hot page costs one row. What was found for it meets the rows by a
    broadcast if the page has a thousandth of all rows or more (at most a thousand such pages), else by a shuffle. Rules are
    broadcast up to 4 MB (``RULES``), beyond that shuffled; pages, and what was found for them, are never broadcast.
    """
    seen = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    urls = durable(seen.groupBy("host", "path").agg(F.count("*").alias("times")), "urls")
    own = rule_table(rules)
    kept = F.octet_length("rule_host") + F.octet_length("rule_path") + 300
    shapes = own.groupBy("labels", "depth").agg(F.sum(kept).alias("kept")).collect()  # as many as rules have shapes
    # left to the planner, pages would be broadcast by the size of their files
    own = F.broadcast(own) if sum(r.kept for r in shapes) <= RULES else own.hint("merge")
    counts, depths = sorted({r.labels for r in shapes}), sorted({r.depth for r in shapes})
    wide = urls.where("host <> ''").select("host", "path", F.explode(host_suffixes(F.col("host"), counts)).alias("suffix")).where("suffix <> ''")
    wide = wide.select("host", "path", "suffix", F.explode(path_prefixes(F.col("path"), depths)).alias("folder"))
    wide = wide.withColumn("digest_u", F.sha2(F.concat_ws("\n", "suffix", "folder"), 256)).withColumn("short", F.substring("digest_u", 1, PREFIX))
    hit = wide.join(own, "short").where((F.col("digest_u") == F.col("digest")) & (F.col("suffix") == F.col("rule_host")) & F.startswith(F.col("path"), F.col("rule_path")))
    rank = F.struct(F.char_length(F.concat("rule_host", "rule_path")).alias("n"), F.char_length("rule_host").alias("h"), F.col("rule_verdict").alias("v"), F.concat("rule_host", "rule_path").alias("rule"))
    best = hit.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = durable(urls.join(best, ["host", "path"], "left"), "judged")
    discard(urls)
    out = keyed_join(seen, judged, ["host", "path"], "times", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))
