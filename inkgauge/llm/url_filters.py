"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join.

A list entry is a canonical URL without scheme: a host, and the beginning of a path. It fits
a URL whose host is the entry's or a subdomain of it, if the URL's path starts with the
entry's. So a URL has a few *keys* that entries could equal: its host's suffixes joined with
its path's beginnings, of the numbers of labels and the lengths that the list holds. Each key
is first tested in one 64-bit block of a Bloom filter, and only keys that pass are exploded
and joined with the list, which removes the false positives. Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Filter bits per listed entry, bits set per entry, and 64-bit blocks at most: a longer list
#: only lets more false positives through to the join.
BITS_PER_ENTRY, BITS_SET, MOST_BLOCKS = 16, 5, 1 << 18
#: Up to so many entries the list is broadcast for the join; beyond, both sides are shuffled by
#: key and salt.
BROADCAST_ENTRIES, SALTS = 200_000, 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path; both are empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def _bits(key: Column) -> Column:
    second = F.xxhash64(F.lit(1), key)
    places = [F.shiftright(second, 6 * j).bitwiseAND(63).cast("int") for j in range(BITS_SET)]
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bloom_filter(entries: DataFrame, blocks: int) -> DataFrame:
    """One row, one column: the filter's blocks as an array, of ``entries`` with a column key."""
    words = entries.groupBy(_block(F.col("key"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("key"))).alias("word"))
    whole = entries.sparkSession.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(0).cast("long").alias("word"))
    joined = whole.unionByName(words).groupBy("block").agg(F.bit_or("word").alias("word"))
    # At most MOST_BLOCKS words meet in one row.
    ordered = F.sort_array(F.collect_list(F.struct("block", "word")))
    return joined.agg(F.transform(ordered, lambda x: x["word"]).alias("filter"))


def judge_urls(
    pages: DataFrame,
    entries: DataFrame,
    key: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """key, host, path, rule, verdict: a row per input row.

    ``entries`` has host, path, verdict, is_rule. A fitting rule decides over fitting list
    entries, and among either the longest decides; equal ones are merged, ties going to the
    larger verdict. ``rule`` is the deciding rule, null where a list entry or the default
    decides. Null urls have empty host and path and fit nothing unless an entry is empty.
    Repeated rows stay repeated; null keys stay; other columns of ``pages`` are not read.
    An empty list judges everything by the default.
    """
    listed = (
        entries.select(
            F.coalesce("host", F.lit("")).alias("e_host"),
            F.coalesce("path", F.lit("")).alias("e_path"),
            F.coalesce("is_rule", F.lit(False)).alias("e_rule"),
            "verdict",
        )
        .withColumn("key", F.concat("e_host", "e_path"))
        .groupBy("key", "e_host", "e_path")
        .agg(F.max(F.struct(F.col("e_rule"), F.length("key").alias("size"), F.col("verdict"), F.col("key").alias("told"))).alias("entry"))
    )
    shape = listed.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("e_host", r"\."))), F.lit(0)).alias("labels"),
        F.sort_array(F.collect_set(F.length("e_path"))).alias("lengths"),
    ).first()  # lengths differ by no more than the longest path
    urls = with_host_and_path(pages.select(F.col(key).alias("__id"), F.col(url_col).alias("__url")), "__url")
    blocks = min(MOST_BLOCKS, 1 << max(0, (shape["n"] * BITS_PER_ENTRY // 64)).bit_length())
    # At most MOST_BLOCKS words; as one string they fold into a constant of the plan.
    words = bloom_filter(listed, blocks).select(F.array_join(F.col("filter").cast("array<string>"), ",")).first()[0]
    bloom = F.split(F.lit(words), ",").cast("array<long>")

    labels = F.least(F.size(F.split("host", r"\.")), F.lit(shape["labels"]))
    suffixes = F.transform(
        F.when(labels > 0, F.sequence(F.lit(1), labels)).otherwise(F.array().cast("array<int>")),
        lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k),
    )
    lengths = F.filter(F.array(*[F.lit(n) for n in shape["lengths"]]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(
        F.transform(
            suffixes,
            lambda s: F.transform(lengths, lambda n: F.struct(F.concat(s, F.substring("path", F.lit(1), n)).alias("key"), s.alias("e_host"))),
        )
    )

    def passes(k: Column) -> Column:
        mask = _bits(k["key"])
        return F.get(bloom, _block(k["key"], blocks)).bitwiseAND(mask) == mask

    tested = urls.select("__id", "__url", "host", "path", F.filter(keys, passes).alias("hits"))
    spread = tested.select("__id", "__url", "host", "path", F.size("hits").alias("n_hits"), F.explode_outer("hits").alias("hit"))
    spread = spread.select("__id", "__url", "host", "path", "n_hits", F.col("hit.key").alias("key"), F.col("hit.e_host").alias("e_host"))
    right = listed.select("key", "e_host", "entry")
    if shape["n"] <= BROADCAST_ENTRIES:
        found = spread.join(F.broadcast(right), ["key", "e_host"], "left")
    else:
        spread = spread.withColumn("salt", F.pmod(F.xxhash64("__id", "__url"), F.lit(SALTS)))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        found = spread.join(right.hint("shuffle_hash"), ["key", "e_host", "salt"], "left")
    judged = found.groupBy("__id", "__url", "host", "path", "n_hits").agg(F.max("entry").alias("entry"), F.count("*").alias("n"))
    times = (F.col("n") / F.greatest("n_hits", F.lit(1))).cast("int")  # how often the row is repeated
    return judged.withColumn("__copy", F.explode(F.sequence(F.lit(1), times))).select(
        F.col("__id").alias(key),
        "host",
        "path",
        F.when(F.col("entry.e_rule"), F.col("entry.told")).alias("rule"),
        F.coalesce("entry.verdict", F.lit(default)).alias("verdict"),
    )


#: The query's rules, and its list of canonical URLs that are blocked where no rule fits.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
LISTED = (
    ("adult-x.example.com", "/"),
    ("ads-track.example.com", "/"),
    ("casino-win.example.com", "/"),
    ("cheap-pills.example.com", "/"),
    ("free-bets.example.com", "/"),
    ("spam-farm.example.org", "/"),
)


def entry_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]], listed: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [(*r, True) for r in rules] + [(h, p, "block", False) for h, p in listed]
    one = spark.range(1).select(F.explode(F.array(*[F.struct(*map(F.lit, r)) for r in rows])).alias("x"))
    return one.select("x.*").toDF("host", "path", "verdict", "is_rule")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), entry_table(spark, RULES, LISTED))


_VALUES = ", ".join(
    [f"('{h}', '{p}', '{v}', TRUE)" for h, p, v in RULES] + [f"('{h}', '{p}', 'block', FALSE)" for h, p in LISTED]
)
OP9_SQL = f"""
WITH entries(e_host, e_path, verdict, is_rule) AS (VALUES {_VALUES}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, row_number() OVER () AS n,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT p.n, arg_max(struct_pack(r := is_rule, v := verdict, e := e_host || e_path),
                             struct_pack(r := is_rule, l := length(e_host || e_path))) AS x
  FROM parts p JOIN entries ON (host = e_host OR ends_with(host, '.' || e_host)) AND starts_with(path, e_path)
  GROUP BY p.n)
SELECT page_id, host, path, CASE WHEN x.r THEN x.e END AS rule, coalesce(x.v, 'allow') AS verdict
FROM parts LEFT JOIN best USING (n)
"""
