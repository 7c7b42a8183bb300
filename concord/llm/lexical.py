"""Ranked lexical search (operator 11): hashed max-sketches of documents, batched upper bounds, exact rescoring.

Terms are maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z is lower-cased. A
document's score for an item sums, over the item's terms with repeats, weight(term) * impact(term, document), where the
impact rises with the term's count and falls with the document's length.

* Index: one row a document, made inside the row without a shuffle. Terms are hashed to 2^BITS coordinates and each
  coordinate keeps the largest count of a term that falls on it. Within a document the impact rises with the count, so
  this is the maximum of the impacts there. A sketch has 2^BITS entries at most, however long the text.
* Bounds: a batch of items is a table (coordinate, item, weight). Sketch entries meet it by a join on the coordinate, and
  the sums by document and item are upper bounds of the scores: a term's coordinate holds its own impact or a larger one.
  Sketches are dealt out by document once, so the sums need no shuffle of (document, item) pairs.
* Rescoring goes down the bounds: the FIRST best bounds of each item are scored exactly from the texts. An item is done
  when no bound that is left can reach its TOP-th exact score; for the others every document whose bound reaches that
  score is scored too. Results are exact; collisions only cost rescoring.

Weights need document frequencies of the batch's terms only, so the corpus vocabulary is never gathered.

Defined results: null and empty texts have no terms; they don't count as documents and are found for no item. Every row
of documents is a document, also where rows repeat; a null doc_id comes after all others among ties. Items that repeat
(same item_id and text) are one item; equal item_ids with different texts are ranked apart. Items without terms, or whose
terms no document holds, have no rows. Extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm.common import bounded, table, written

TOP, FIRST, BITS = 20, 100, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All ASCII characters between terms but the space.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum() and c != " ")
COUNT_BITS = 40


def terms(text: Column) -> Column:
    """The terms of a text in order, with repeats."""
    spaced = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN))
    return F.array_remove(F.split(spaced, " "), "")


def impact(count: str, length: str) -> Column:
    return F.expr(f"(1000000000L * {count}) div (1000L * {count} + 12L * {length})")


def coordinate(term: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(term), 64 - bits)


def index(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, digest of the text, n (its terms) and sketch of every document. A sketch entry is a long: coordinate * 2^40 +
    largest count, ascending. No filter on the terms stands here or below, since Spark would push it down and tokenize twice."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("digest"),
        terms(F.col("text")).alias("t"))
    d = d.withColumn("h", F.sort_array(F.transform("t", lambda x: F.xxhash64(x)))).withColumn("n", F.size("h"))
    last = F.filter(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))),
        lambda i: ~F.get("h", i).eqNullSafe(F.get("h", i + 1)))  # of equal hashes

    def entry(end: Column, k: Column) -> Column:
        count = end - F.coalesce(F.get("last", k - 1), F.lit(-1))
        return F.shiftleft(F.shiftrightunsigned(F.get("h", end), 64 - bits), COUNT_BITS) + count.cast("long")

    d = d.withColumn("last", last).withColumn("e", F.sort_array(F.transform("last", entry)))
    largest = F.filter("e", lambda x, i: F.coalesce(F.shiftright(F.get("e", i + 1), COUNT_BITS) != F.shiftright(x, COUNT_BITS), F.lit(True)))
    return d.select("doc_id", "digest", F.col("n").cast("long").alias("n"), largest.alias("sketch"))


def items_of(queries: DataFrame) -> DataFrame:
    """_item (names an item), item_id, term, repeats."""
    q = queries.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    q = q.select(F.xxhash64("item_id", "text").alias("_item"), "item_id", F.explode(terms(F.col("text"))).alias("term"))
    return q.groupBy("_item", "item_id", "term").agg(F.count(F.lit(1)).alias("repeats"))


def statistics(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, df of the terms of ``vocabulary`` that documents hold; the row of the empty term has as df the number of
    documents with terms, and as n the number of their terms."""
    d = docs.select(terms(F.col("text")).alias("t"))
    each = d.select(F.size("t").alias("n"), F.explode_outer(F.concat(F.array_distinct("t"), F.array(F.lit("")))).alias("term"))
    asked = vocabulary.select("term").unionByName(vocabulary.sparkSession.sql("select '' as term")).distinct()
    return each.join(bounded(asked), "term").groupBy("term").agg(F.count_if(F.col("n") > 0).alias("df"), F.sum("n").alias("n"))


def _weighted(asked: DataFrame, stats: DataFrame, n_docs: int, bits: int) -> DataFrame:
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    return asked.join(bounded(stats), "term").select("_item", "item_id", "term", coordinate(F.col("term"), bits).alias("b"),
        (F.col("repeats") * weight).cast("long").alias("weight"))


def bounds(sketches: DataFrame, coords: DataFrame, length: str) -> DataFrame:
    """_item, doc, doc_id, digest, bound of every document and item that share a coordinate."""
    dealt = sketches.repartition("doc")
    each = dealt.select("doc", "doc_id", "digest", F.expr(length).alias("m"), F.explode("sketch").alias("_e"))
    each = each.select("doc", "doc_id", "digest", "m", F.shiftright("_e", COUNT_BITS).alias("b"),
        F.col("_e").bitwiseAND((1 << COUNT_BITS) - 1).alias("tf"))
    met = each.join(bounded(coords), "b").select("_item", "doc", "doc_id", "digest", (F.col("weight") * impact("tf", "m")).alias("part"))
    return met.groupBy("_item", "doc", "doc_id", "digest").agg(F.sum("part").alias("bound"))


def rescored(docs: DataFrame, pairs: DataFrame, profile: DataFrame, length: str) -> DataFrame:
    """_item, item_id, doc_id, score above 0 of the ``pairs`` (_item, doc_id, digest), from the texts; documents that
    repeat in all (doc_id and text) are scored once and returned as often as they stand there."""
    own = ["_id", "digest"]
    pairs = pairs.select("_item", F.struct("doc_id").alias("_id"), "digest").distinct()
    d = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("_id"),
        F.xxhash64(F.col("text").cast("string")).alias("digest"), F.col("text").cast("string").alias("text"))
    d = d.join(bounded(pairs.select(*own).distinct()), own, "left_semi")
    d = d.groupBy(*own).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    d = d.select(*own, "copies", terms(F.col("text")).alias("t")).select(*own, "copies", F.size("t").cast("long").alias("n"),
        F.explode_outer("t").alias("term"))
    counts = d.join(bounded(profile.select("term").distinct()), "term", "left_semi").groupBy(*own, "copies", "n",
        "term").agg(F.count(F.lit(1)).alias("tf"))
    each = counts.withColumn("m", F.expr(length)).join(bounded(pairs), own).join(bounded(profile.drop("b")), ["_item", "term"])
    got = each.groupBy("_item", "item_id", *own, "copies").agg(F.sum(F.col("weight") * impact("tf", "m")).alias("score")).where("score > 0")
    return got.select("_item", "item_id", F.col("_id.doc_id").alias("doc_id"), "score",
        F.explode(F.sequence(F.lit(1), F.least(F.col("copies").cast("int"), F.lit(TOP)))).alias("_copy")).drop("_copy")


def _ranked(scores: DataFrame, top: int) -> DataFrame:
    best = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, first: int = FIRST, bits: int = BITS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with scores above 0, exactly."""
    asked = written(items_of(queries), "lexical")
    stats = written(statistics(docs, asked), "lexical")
    whole = stats.where("term = ''").first()
    n_docs, n_terms = (whole["df"], whole["n"] or 1) if whole else (0, 1)
    length = f"75L + ((25L * n * {n_docs}L) div {n_terms}L)"
    profile = written(_weighted(asked, stats, n_docs, bits), "lexical")
    coords = profile.groupBy("b", "_item").agg(F.sum("weight").alias("weight")).where("weight > 0")
    sketches = written(index(docs, bits).withColumn("doc", F.monotonically_increasing_id()), "lexical")

    down = Window.partitionBy("_item").orderBy(F.desc("bound"), F.asc_nulls_last("doc_id"), "doc")
    head = bounds(sketches, coords, length).withColumn("place", F.row_number().over(down)).where(F.col("place") <= first)
    head = written(head, "lexical")
    best = written(_ranked(rescored(docs, head, profile, length), top), "lexical")

    last = head.where(F.col("place") == first).select("_item", F.col("bound").alias("low"), F.col("doc_id").alias("low_id"))
    worst = best.where(F.col("rank") == top).select("_item", F.col("score").alias("reach"), F.col("doc_id").alias("reach_id"))
    both = last.join(worst, "_item", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    done = (F.col("low") < F.col("reach")) | (F.col("low") == F.col("reach")) & F.coalesce(F.col("low_id") >= F.col("reach_id"), F.lit(False))
    left = written(both.where(~done).select("_item", "reach"), "lexical")
    if not left.isEmpty():
        more = bounds(sketches, coords.join(left.select("_item"), "_item", "left_semi"), length)
        more = written(more.join(bounded(left), "_item").where("bound >= reach"), "lexical")
        best = best.join(left, "_item", "left_anti").unionByName(_ranked(rescored(docs, more, profile, length), top))
    return best.select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = rf"""WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
held AS (SELECT r, doc_id, len(t) AS n, t FROM d WHERE len(t) > 0),
whole AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(t) AS term FROM held) GROUP BY ALL),
item AS (
  SELECT item_id, text, term, count(*) AS repeats FROM (
    SELECT item_id, text, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weighed AS (
  SELECT item_id, text, term, repeats * CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM item JOIN df USING (term), whole),
scored AS (
  SELECT item_id, text, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN weighed USING (term), whole GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""

QUERIES = {"op11_lexical": query}
ORACLES = {"op11_lexical": SQL}
