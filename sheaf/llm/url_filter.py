"""URL filters as a sort-merge range join.

A host's labels in reverse, each followed by ``/``, are its key, so a rule's host and
all its subdomains are one interval of keys, and two rules' intervals are nested or
apart. Pages and rule starts are sorted together and swept once; what the sweep carries
is the stack of rules open at the last start, the start's own rules and those it is
nested in. Of the stack a page keeps the rules whose key its own key begins with and
whose path its path begins with, and the longest decides.

Pages are swept in slices: by the last two labels of the host, and where such a cell
has many pages by a hash of the page as well; a cell's rules go to each of its slices.
So neither a host nor a domain with a third of all pages lands in one task.

Defined results: the host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
the end, A-Z lower-cased; the path follows it up to ``?``, ``#`` or the end. Without
``://``, and for null, both are empty. Of the rules that fit the one with the longest
key and path wins, then the longest host, then a block. A rule without host or
verdict is left out, and a null path is empty. Repeated pages are judged each. Columns
other than the key and the url play no part and are not returned. Empty tables give
empty results; without rules every page gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import HOT_SHARE, hot_keys, literal_rows, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url)))
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``a.b.c`` becomes ``c/b/a/``; no host holds a slash."""
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]")), "/"), F.lit("/"))


def _rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: key, labels, and the rules open from its start on."""
    clean = rules.where("host IS NOT NULL AND verdict IN ('allow', 'block')").select(
        F.translate("host", UPPER, LOWER).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    )
    clean = clean.withColumn("key", host_key(F.col("host"))).distinct()
    rule = F.struct(
        (F.length("key") + F.length("path")).alias("length"),
        F.length("key").alias("host_length"),
        (F.col("verdict") == "block").cast("int").alias("blocks"),
        F.concat("host", "path").alias("rule"),
        "path",
        "key",
        "verdict",
    )
    own = clean.groupBy("key").agg(F.collect_list(rule).alias("rules"))
    labels = F.split(F.rtrim(F.col("key"), F.lit("/")), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "/"), F.lit("/")),
    )
    starts = own.select(F.col("key").alias("start"), F.explode(prefixes).alias("key"))
    stacks = starts.join(own, "key").groupBy("start").agg(F.flatten(F.collect_list("rules")).alias("stack"))
    return stacks.select(
        F.col("start").alias("key"),
        "stack",
        F.size(F.split("start", "/")).alias("pieces"),
    )


def _cell(key: Column) -> Column:
    """The last two labels of the host."""
    return F.concat(F.substring_index(key, "/", 2), F.lit("/"))


def filter_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """key, host, path, rule, verdict per page; rules have host, path, verdict.

    A host's rules are one array in a row, and a page meets all rules of its own host
    and of the hosts above it.
    """
    read = pages.select(
        pages[key].alias("id"), url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path")
    )
    read = written(
        read.withColumn("key", host_key(F.col("host")))
        .withColumn("cell", _cell(F.col("key")))
        .withColumn("part", F.xxhash64("id", "path", F.monotonically_increasing_id())),
        "urls",
    )
    total = read.count()
    counts = read.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    hot = written(
        hot_keys(counts, total).select(
            "cell", F.ceil(F.col("n") / F.lit(max(1.0, HOT_SHARE * total))).cast("int").alias("slices")
        ),
        "hot-domains",
    )
    slices = F.coalesce("slices", F.lit(1))
    dealt = read.join(F.broadcast(hot), "cell", "left").withColumn("slice", F.pmod("part", slices).cast("int"))

    stacks = written(_rule_stacks(rules), "rule-stacks")
    narrow = (
        stacks.where("pieces > 2")
        .withColumn("cell", _cell(F.col("key")))
        .join(F.broadcast(hot), "cell", "left")
        .select("cell", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"), "key", "stack")
    )
    # A rule on a whole top-level domain starts in each of its cells.
    wide = stacks.where("pieces <= 2").select(F.col("key").alias("top"), "stack")
    cells = dealt.select("cell", "slice", F.concat(F.substring_index("cell", "/", 1), F.lit("/")).alias("top"))
    above = cells.distinct().join(wide, "top").select("cell", "slice", F.col("top").alias("key"), "stack")

    starts = narrow.unionByName(above).select(
        "cell", "slice", "key", F.lit(0).alias("is_page"), "stack",
        F.lit(None).cast(dict(read.dtypes)["id"]).alias("id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
    )
    points = dealt.select(
        "cell", "slice", "key", F.lit(1).alias("is_page"),
        F.lit(None).cast(dict(stacks.dtypes)["stack"]).alias("stack"), "id", "host", "path",
    )
    sweep = (
        Window.partitionBy("cell", "slice")
        .orderBy("key", "is_page")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = starts.unionByName(points).withColumn("open", F.last("stack", ignorenulls=True).over(sweep))
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]) & F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fits)
    judged = swept.where("is_page = 1").withColumn("best", best)
    return judged.select(
        F.col("id").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A verdict for every page."""
    rules = literal_rows(spark, RULES, "host string,path string,verdict string")
    return filter_urls(spark.read.parquet(f"{folder}/pages.parquet"), rules)


OP10_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rhost, rpath, rverdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT page_id, rhost || rpath AS rule, rverdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
  FROM split JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM split s LEFT JOIN fitting f ON f.page_id = s.page_id AND f.place = 1
"""
