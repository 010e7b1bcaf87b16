"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible
hits to an exact hash join that removes its false positives.

Everything is DataFrame work. The list is a table (host, path, verdict). Its
Bloom filter is a table too: one row per 512-bit block, eight 64-bit words
built with ``bit_or``; each listed URL sets one bit in each word of one block.
A URL can match a listed host only by its own host from its start or from behind
a dot, and a listed path only by a prefix of its own path. So its candidates are
these suffixes of its host, with the path lengths that are listed under the
suffix: few, however long the list is. Candidates that the filter passes meet the
list in a join on the strings themselves.

Candidates are made once per distinct (host, path), not per page, so a URL that
a third of all pages share is judged once; joins carry no broadcast hint, so
Spark broadcasts the list only below its own size threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

WORDS = 8
#: Listed URLs per block: 16 bits a URL.
KEYS_PER_BLOCK = 32


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path): the host is what follows the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, A-Z lower-cased; the path goes on up to ``?``,
    ``#`` or the end. Both are empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def _bloom_columns(key: Column, n_blocks: int) -> list[Column]:
    """The block of a key and its bit in each word of the block."""
    bits = F.xxhash64(F.lit(7), key)
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(63).cast("int"))
             for i in range(WORDS)]
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("long")).alias("block")
    return [block, *(w.alias(f"m{i}") for i, w in enumerate(words))]


def bloom_filter(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w7) of the listed (host, path)."""
    keys = listed.select(*_bloom_columns(F.concat("host", "path"), n_blocks))
    return keys.groupBy("block").agg(*(F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The columns of ``pages`` and (host, path, rule, verdict).

    A listed (host, path, verdict) fits its host and all subdomains if the
    page's path starts with the listed path; the longest fitting one wins (of
    equally long ones the first in text order). ``rule`` is its host and path
    joined, null if none fits; such pages get ``default``. Null urls and urls
    without ``://`` have an empty host and path. Rows of the list with a null
    field take no part, repeated ones count once (with two verdicts: ``block``).
    Repeated pages are judged one by one. Columns of ``pages`` named like an
    output column are replaced.
    """
    host, path = canonical(F.col(url))
    out = ("host", "path", "rule", "verdict")
    own = [c for c in pages.columns if c not in out]
    seen = pages.select(*own, host.alias("host"), path.alias("path"))

    listed = listed.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    n_listed, longest = listed.agg(F.count("*"), F.coalesce(F.max(F.length("host")), F.lit(0))).first()
    n_blocks = max(1, -(-n_listed // KEYS_PER_BLOCK))
    lengths = listed.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))

    # one character more than the longest listed host has shows every dot that matters
    labels = F.split(F.right("host", F.lit(longest + 1)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    distinct = seen.select("host", "path").distinct()
    candidates = (distinct.select("host", "path", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
                  .select("host", "path", "rule_host", F.explode("lengths").alias("size")).where(F.col("size") <= F.length("path"))
                  .select("host", "path", "rule_host", F.col("path").substr(F.lit(1), F.col("size")).alias("rule_path")))

    probes = candidates.select("*", *_bloom_columns(F.concat("rule_host", "rule_path"), n_blocks))
    possible = probes.join(bloom_filter(listed, n_blocks), "block")
    for i in range(WORDS):
        possible = possible.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))

    exact = possible.select("host", "path", "rule_host", "rule_path").join(
        listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")),
        ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = exact.groupBy("host", "path").agg(
        F.min(F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("_best"))

    return seen.join(best, ["host", "path"], "left").select(
        *own, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
