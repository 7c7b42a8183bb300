"""URL filters (operator 8): dated list entries as validity intervals, and an as-of join for every capture; DataFrame functions only.

A list entry (pattern, since, action) holds from its date until the pattern's next entry. Patterns are a host, a parent
domain of it, or a host with a first path segment. A capture is evaluated against the entries active at its fetch time,
and is blocked if an active entry of any of its patterns says "block"; the longest active pattern is reported.

The as-of join has two levels, so that neither a host with a third of all captures nor a burst of captures is one task:
rows are cut by range of pattern, time and row into buckets of about BUCKET rows; within a (pattern, bucket) a window finds
the last entry, and what held at the bucket's start comes from a window over the pattern's buckets, one row each. Intervals
get their ends in the same way.

Defined results: of entries of one pattern and date "block" wins; entries with a null pattern or date are ignored;
captures without a fetch time or host have no active entry and pass, those without an id are evaluated like others; each
row is evaluated by itself, so repeated ids and repeated captures give a row each. The captures' own columns stay as they
are; where one is named like a column of the result (blocked, pattern, since), the result's name gets underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import private, table, written

BUCKET, RANGES = 5000, 100_000  # rows in a bucket, about; and the most buckets that are made


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)


def patterns_of(url: Column) -> Column:
    """The host, its parent domains of two labels or more, and the host with its first path segment."""
    host, first = host_of(url), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)
    labels = F.split(host, r"\.")
    domains = F.when(F.size(labels) >= 2, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, 99), "."))).otherwise(F.array(host))
    return F.filter(F.array_distinct(F.concat(domains, F.array(F.when(first != "", F.concat(host, F.lit("/"), first))))), lambda p: p.isNotNull() & (p != ""))


def _bucketed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their bucket: Spark's range partitions of pattern and ``order``, as many as give BUCKET rows each (or a
    RANGES-th of all rows, if that is more), so a burst is cut like any other stretch. Written, since cuts are sampled."""
    n = rows.count()
    size = max(BUCKET, n // RANGES)
    return written(rows.repartitionByRange(max(1, -(-n // size)), "pattern", *order).withColumn("bucket", F.spark_partition_id()), "buckets")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until (null: open): the validity intervals of dated entries (pattern, since, action)."""
    e = entries.where("pattern is not null and since is not null").groupBy("pattern", "since").agg(F.min("action").alias("action"))
    e = _bucketed(e, ["since"])
    first = e.groupBy("pattern", "bucket").agg(F.min("since").alias("first"))
    later = first.select("pattern", "bucket", F.lead("first").over(Window.partitionBy("pattern").orderBy("bucket")).alias("later"))
    nxt = F.lead("since").over(Window.partitionBy("pattern", "bucket").orderBy("since"))
    return e.withColumn("nxt", nxt).join(later, ["pattern", "bucket"]).select("pattern", "action", "since", F.coalesce("nxt", "later").alias("until"))


def active(captures: DataFrame, spans: DataFrame) -> DataFrame:
    """captures (row, pattern, at) and intervals -> row, pattern, action, since, until of the one active then, if any."""
    entry = F.struct("since", "action", "until")
    row = captures.schema["row"].dataType
    e = spans.select("pattern", F.col("since").alias("at"), F.lit(0).alias("kind"), entry.alias("entry"), F.lit(None).cast(row).alias("row"))
    c = captures.select("pattern", "at", F.lit(1).alias("kind"), F.lit(None).cast("struct<since:timestamp,action:string,until:timestamp>").alias("entry"), "row")
    both = _bucketed(c.unionByName(e.select(*c.columns)), ["at", "kind", "row"])
    ends = both.groupBy("pattern", "bucket").agg(F.max("entry").alias("ends"))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    held = ends.select("pattern", "bucket", F.last("ends", ignorenulls=True).over(before).alias("held"))
    within = Window.partitionBy("pattern", "bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("last", F.last("entry", ignorenulls=True).over(within)).where("kind = 1")
    return seen.join(held, ["pattern", "bucket"]).withColumn("e", F.coalesce("last", "held")).where("e is not null").select("row", "pattern", "e.*")


def filtered(captures: DataFrame, entries: DataFrame, url: str, at: str) -> DataFrame:
    """Every capture with blocked, pattern (longest active one that decides) and since."""
    own, as_of = F.struct(*(F.col(f"`{c}`") for c in captures.columns)), F.col(at).cast("timestamp")
    rows = captures.select(F.monotonically_increasing_id().alias("row"), own.alias("capture"), F.col(url).cast("string").alias("url"), as_of.alias("at"))
    rows = written(rows, "captures")  # the numbers must be the same in both places
    keyed = rows.where("at is not null").select("row", "at", F.explode(patterns_of(F.col("url"))).alias("pattern"))
    found = active(keyed, intervals(entries)).where("action = 'block'")
    top = found.groupBy("row").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "since")).alias("top"))
    names = [private(captures, n) for n in ("blocked", "pattern", "since")]
    found = [F.col("top").isNotNull(), F.col("top.pattern"), F.col("top.since")]
    return rows.join(top, "row", "left").select("capture.*", *(c.alias(n) for n, c in zip(names, found, strict=True)))


def fetched(pages: DataFrame) -> DataFrame:
    """The pages as a crawl of one page a minute, in the order of their ids."""
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60).alias("fetched_at"))


def dated_entries(captures: DataFrame) -> DataFrame:
    """A list history from the crawl itself: feed links block a host's section and anchors allow it again; .html pages
    block the host's parent domain and directory pages allow it again."""
    host = host_of(F.col("url"))
    section = F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1))
    parent = F.array_join(F.slice(F.split(host, r"\."), -2, 2), ".")
    kind = F.when(F.col("url").contains("utm_source="), F.struct(section.alias("pattern"), F.lit("block").alias("action"))).when(F.col("url").endswith("#top"), F.struct(section.alias("pattern"), F.lit("pass").alias("action")))
    kind = kind.when(F.col("url").endswith(".html"), F.struct(parent.alias("pattern"), F.lit("block").alias("action"))).when(F.col("url").endswith("/"), F.struct(parent.alias("pattern"), F.lit("pass").alias("action")))
    return captures.select(F.col("fetched_at").alias("since"), kind.alias("k")).where("k is not null").select("k.pattern", "since", "k.action")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = fetched(table(spark, sf_dir, "pages"))
    return filtered(caps, dated_entries(caps), "url", "fetched_at").select("page_id", "url", "blocked", "pattern", F.unix_seconds("since").alias("since_s"))


QUERIES = {"op8_url_filters": query}
ORACLES = {
    "op8_url_filters": r"""
WITH c AS (SELECT page_id, url, 1704067200 + page_id * 60 AS ts, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1) AS seg FROM pages),
d AS (SELECT *, split_part(host, '.', -2) || '.' || split_part(host, '.', -1) AS parent FROM c),
e AS (SELECT CASE WHEN url LIKE '%utm_source=%' OR url LIKE '%#top' THEN host || '/' || seg ELSE parent END AS pattern, ts AS since,
             CASE WHEN url LIKE '%utm_source=%' THEN 'block' WHEN url LIKE '%#top' THEN 'pass' WHEN url LIKE '%.html' THEN 'block' ELSE 'pass' END AS action
      FROM d WHERE url LIKE '%utm_source=%' OR url LIKE '%#top' OR url LIKE '%.html' OR url LIKE '%/'),
i AS (SELECT *, lead(since) OVER (PARTITION BY pattern ORDER BY since) AS until FROM (SELECT pattern, since, min(action) AS action FROM e GROUP BY ALL)),
k AS (SELECT page_id, ts, unnest(list_distinct([host, parent, host || '/' || seg, array_to_string(string_split(host, '.')[2:], '.')])) AS pattern FROM d WHERE host <> ''),
f AS (SELECT page_id, k.pattern, since FROM k JOIN i ON k.pattern = i.pattern AND ts >= since AND (until IS NULL OR ts < until) WHERE action = 'block'),
t AS (SELECT page_id, pattern, since, row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) AS r FROM f)
SELECT d.page_id, d.url, t.page_id IS NOT NULL AS blocked, t.pattern, t.since AS since_s FROM d LEFT JOIN t ON d.page_id = t.page_id AND r = 1""",
}
