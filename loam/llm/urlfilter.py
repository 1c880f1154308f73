"""URL filter: a blocked Bloom filter in front of an exact join, and prefix rules that override the list.

DataFrame functions only. The filter has 2**block_bits blocks of eight 64-bit
lanes, one bit a key in each lane. Its size follows the list's length, up to 2**20
blocks of 72 bytes (some 33 million URLs); a longer list lets more false candidates
through to the exact join, never a wrong verdict.

Null or malformed URLs have empty host and path and are never listed; repeated
rows are judged each by itself; an empty list or table gives "allow" or no rows.
Other columns of the input, whatever their names, are dropped by judge_urls().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

MAX_BLOCK_BITS = 20
LANES = 8
KEYS_A_BLOCK = 32  # eight bits each fill some two fifths of a block

# Query parameters that don't change what a URL names.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, www., default port, fragment, tracking parameters or closing slash; parameters sorted. Null if there is no host."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def bloom_key(key: Column, block_bits: int) -> tuple[Column, list[Column]]:
    """The block of a key and its mask in each lane."""
    bits = F.xxhash64(key, F.lit(2))
    masks = []
    for lane in range(LANES):
        place = F.shiftrightunsigned(bits, 6 * lane).bitwiseAND(F.lit(63)).cast("int")
        masks.append(F.call_function("shiftleft", F.lit(1).cast("long"), place))
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << block_bits)).cast("int"), masks


def fitting_bits(listed: DataFrame) -> int:
    """block_bits for a list (with a column canonical): KEYS_A_BLOCK keys a block, as far as MAX_BLOCK_BITS go."""
    return min(MAX_BLOCK_BITS, max(1, (listed.count() // KEYS_A_BLOCK).bit_length()))


def bloom_filter(listed: DataFrame, block_bits: int) -> DataFrame:
    """One row a used block: bloom_block and lanes l0 to l7. listed has a column canonical."""
    if not 0 < block_bits <= MAX_BLOCK_BITS:
        raise ValueError(f"block_bits must be 1 to {MAX_BLOCK_BITS}, so that the filter can be broadcast")
    block, masks = bloom_key(F.col("canonical"), block_bits)
    keyed = listed.filter(F.col("canonical").isNotNull()).select(block.alias("bloom_block"), *[m.alias(f"l{i}") for i, m in enumerate(masks)])
    return keyed.groupBy("bloom_block").agg(*[F.bit_or(f"l{i}").alias(f"l{i}") for i in range(LANES)])


def in_list(urls: DataFrame, listed: DataFrame, block_bits: int | None = None) -> DataFrame:
    """urls (with a column canonical) and a column listed: is its canonical URL one of those of the other table?

    The filter is broadcast (bounded, see above). Rows that it rejects are done;
    the rest meet the list in a left join that Spark may split when a URL is hot.
    """
    block_bits = block_bits or fitting_bits(listed)
    block, masks = bloom_key(F.col("canonical"), block_bits)
    probed = urls.withColumn("bloom_block", F.coalesce(block, F.lit(-1))).join(F.broadcast(bloom_filter(listed, block_bits)), "bloom_block", "left")
    hit = F.lit(True)
    for i, mask in enumerate(masks):
        hit = hit & (F.col(f"l{i}").bitwiseAND(mask) == mask)
    possible = F.coalesce(hit, F.lit(False))
    probed = probed.withColumn("possible", possible).drop("bloom_block", *[f"l{i}" for i in range(LANES)])
    exact = listed.select("canonical").distinct().withColumn("listed", F.lit(True))
    sure = probed.filter(~F.col("possible")).withColumn("listed", F.lit(False))
    checked = probed.filter("possible").join(exact, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    return sure.unionByName(checked).drop("possible")


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest (action, host/path) rule that fits, and its action; null if none fits. Of equally long rules the one with the longer host wins."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        domain, _, below = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{below}")
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]], block_bits: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of each row of pages: the longest rule decides, else the list blocks."""
    url = F.col("url")
    rows = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))})
    rule, action = longest_rule(F.col("host"), F.col("path"), rules)
    judged = in_list(rows, listed, block_bits)
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")


# Site labels whose pages make up the query's list.
UNWANTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
# The rules of the query.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def listed_pages(pages: DataFrame, sites: tuple[str, ...] = UNWANTED_SITES) -> DataFrame:
    """canonical: the distinct canonical URLs of pages on unwanted sites, known by a label of their host."""
    labels = F.split(url_host(F.col("url")), r"\.")
    return pages.filter(F.arrays_overlap(labels, F.array(*map(F.lit, sites)))).select(canonical_url(F.col("url")).alias("canonical")).filter("canonical is not null").distinct()
