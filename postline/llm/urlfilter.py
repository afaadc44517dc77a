"""URL filters: a blocked Bloom filter in front of an exact hash join.

DataFrame functions only.  A list of canonical URLs (of any length) is turned
into a table of filter blocks: a URL's first hash names its block of eight
32-bit words, five bits of its second hash for each word set one bit there.  A
block is the bitwise OR of its URLs' masks, a partial aggregate.  Each page
meets its one block in a hash join; pages whose eight bits are set are possible
hits, and an exact hash join with the list removes the false ones.  There are no
false negatives, so the result equals the plain join, but only possible
hits (the true ones and about one in two hundred others at ``BITS`` bits a URL) are
shuffled with the list.

The blocks are broadcast while there are at most ``MAX_BLOCKS`` of them (known
before the join: the list is counted to size the filter); beyond that pages and
blocks meet in a shuffled join.

Rules are a short hand-written list of (action, host, path): a rule fits its
host and all subdomains if the path starts with the rule's; the longest
(host and path together) wins.

Edge cases: a URL that is null or has no ``://`` has empty host and path, fits
no rule and is never listed; repeated URLs are judged alike; an empty list
blocks nothing; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postline.llm import textops as X
from postline.session import written

BITS = 12                    # filter bits a listed URL
BLOCK_BITS = 256
WORDS = 8
MAX_BLOCKS = 1 << 18         # about 10 MB of blocks
#: Rules of op2 (fixed by its contract).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("allow", "com", "/fr/"),
         ("block", "example.org", "/en/1"), ("block", "com", "/de/")]
#: Query parameters that don't change a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return X.lower_ascii(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """Then up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without
    tracking parameters; null if there is no ``://``."""
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, f"(^|&)({TRACKING})=[^&]*", ""), "^&+|&+$", "")
    site = F.concat(F.regexp_replace(host(url), "^www\\.", ""), F.regexp_replace(path(url), "/+$", ""))
    return F.when(F.instr(url, "://") > 0, F.when(query == "", site).otherwise(F.concat(site, F.lit("?"), query)))


def fitting_rule(at_host: Column, at_path: Column, rules=None) -> Column:
    """Struct (action, rule) of the longest fitting rule, or null."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [F.when(((at_host == h) | at_host.endswith("." + h)) & at_path.startswith(p),
                   F.struct(F.lit(action).alias("action"), F.lit(h + p).alias("rule"))) for action, h, p in ordered]
    return F.coalesce(*fits, F.lit(None).cast("struct<action:string,rule:string>"))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    bits = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftright(bits, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(WORDS)]


def bloom(listed: DataFrame, blocks: int, key: str = "key") -> DataFrame:
    """One row per used block: block, w0 .. w7."""
    return (listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
            .groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]))


def possible(rows: DataFrame, listed: DataFrame, n_listed: int, key: str = "key") -> DataFrame:
    """``rows`` with ``maybe``: the filter lets the key pass."""
    blocks = 1 << max(0, math.ceil(math.log2(max(1, n_listed) * BITS / BLOCK_BITS)))
    filled = bloom(listed, blocks, "key")
    filled = F.broadcast(filled) if blocks <= MAX_BLOCKS else filled
    names = rows.columns
    rows = rows.withColumns({"_block": _block(F.col(key), blocks)} | {f"_m{i}": m for i, m in enumerate(_masks(F.col(key)))})
    passed = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}") for i in range(WORDS)])
    return rows.join(filled, F.col("_block") == F.col("block"), "left").select(
        *names, (F.col(key).isNotNull() & F.coalesce(passed, F.lit(False))).alias("maybe"))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=None) -> DataFrame:
    """page_id, host, path, rule, verdict and listed (the URL is in the list;
    judged only where no rule fits).  ``listed`` has one column of canonical URLs."""
    listed = written(listed.toDF("key").where("key is not null").distinct(), "url_list")
    url = F.col(url_col)
    rows = (pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_canonical"))
            .withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
            .withColumn("_key", F.when(F.col("_fit").isNull(), F.col("_canonical"))).drop("_canonical"))
    probed = possible(rows, listed, listed.count(), "_key")
    hits = (probed.where("maybe").join(listed.hint("shuffle_hash"), F.col("_key") == F.col("key"), "left")
            .withColumn("listed", F.col("key").isNotNull()).drop("key"))
    rest = probed.where("not maybe").withColumn("listed", F.lit(False))
    return hits.unionByName(rest).select(
        "page_id", "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.action"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")
