"""Benchmark decontamination (operator 7): template windows, hash join and slot consistency, all in DataFrame functions.

Canonical form: a text's tokens are its runs of letters and its numbers. Numbers become one placeholder, unit words
behind a number (with or without a space) another, capitalised words a third, also where they begin a sentence, since a
name may stand there; the rest is lower-cased. Windows of WINDOW tokens of every
document are hash-joined with those of the benchmark items (an item with fewer tokens is one window of that length).
A window is joined by its placeholders only if most of its tokens are words (at most two placeholders of five tokens,
one of three or four, none of one or two); every window that holds a placeholder is joined by its literal tokens as well,
so "12 + 7 * 3" or "7 kg" is found where it stands as it is. For each item and alignment in a document, the values
behind the placeholders must map one to one (the item's "7" may be "12" throughout, but not "12" here and "15" there);
inconsistent alignments don't count. Windows that matched ones span together count too. A document is contaminated by
an item when its consistent windows cover at least COVER of the item's windows, of which none is left out, or when an
alignment has QUOTE tokens of the item in one run, however long the item is.

Defined results: null or empty texts match nothing. A document is a doc_id (which may be null) with a text: repeated rows
are one document, rows that share a doc_id but not a text are several, each with its own matches. Items without a token
or id are skipped; of several texts under one item id each is held against the documents, and the best match is reported.
Whether a text is contaminated depends on the text alone, so ``clean`` drops rows without a doc_id too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import bounded, let, salted_rows_bound, table, text_digest, without, written

WINDOW, COVER, QUOTE = 5, 0.5, 13
BROADCAST_ROWS = 500_000  # windows of the benchmark; beyond it the join shuffles both sides
#: Unit words that count as units after a number.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|mile|miles|ft|feet|inch|inches|meter|meters|metre|metres|kilometers|kilometres|grams|kilograms|pounds|l|ml|liter|liters|litre|litres|s|sec|seconds|min|minutes|h|hours|hour|days|day|weeks|months|years|year|usd|eur|gbp|dollars|euros|cents|percent|mph|kmh|hz|w|kw|v|a|k"
NUM, UNIT, NAME = "qqnumqq", "qqunitqq", "qqnameqq"
TOKEN = r"\p{L}[\p{L}\p{M}]*|\p{N}+(?:[.,]\p{N}+)*"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _template(text: Column) -> Column:
    """Same number of tokens as the text, with placeholders; lower case."""
    united = F.regexp_replace(text, rf"(?i)(?<=\p{{N}}\s{{0,2}})(?:{UNITS})(?![\p{{L}}\p{{M}}])", UNIT)
    named = F.regexp_replace(united, r"(?<![\p{L}\p{M}])\p{Lu}(?=[\p{L}\p{M}]*\p{Ll})[\p{L}\p{M}]+", NAME)
    return F.lower(F.regexp_replace(named, r"\p{N}+(?:[.,]\p{N}+)*", f" {NUM} "))


def _windows(text: Column, sizes: list[int], exact: bool) -> Column:
    """array<struct<h, at, slots, literal>>; ``exact``: only windows of the text's own length where that is below WINDOW.

    A window without placeholders comes once, one with few twice (by placeholders and literally), one with many literally."""
    kind = "array<struct<h:bigint,at:int,slots:array<string>,literal:boolean>>"

    def build(tokens: Column, values: Column, any_slot: Column) -> Column:
        literal = F.zip_with(tokens, values, lambda t, v: F.when(v != "", v).otherwise(t))

        def of(size: int) -> Column:
            n = F.size(tokens)
            fits = (n == size) if exact and size < WINDOW else (n >= size)
            starts = F.sequence(F.lit(1), n - (size - 1))

            def row(of_tokens: Column, at: Column, slots: Column, is_literal: bool) -> Column:
                return F.struct(F.xxhash64(F.lit(size), F.slice(of_tokens, at, size)).alias("h"), at.alias("at"), slots.alias("slots"), F.lit(is_literal).alias("literal"))

            def slotted(w: Column) -> Column:
                few = F.transform(F.filter(w, lambda x: F.size(x["slots"]) <= (size - 1) // 2), lambda x: row(tokens, x["at"], x["slots"], False))
                some = let(literal, lambda words: F.transform(F.filter(w, lambda x: F.size(x["slots"]) > 0), lambda x: row(words, x["at"], x["slots"], True)))
                return F.concat(few.cast(kind), some.cast(kind))

            plain = F.transform(starts, lambda i: row(tokens, i, F.lit(None).cast("array<string>"), False)).cast(kind)
            with_slots = let(F.transform(starts, lambda i: F.struct(i.alias("at"), F.filter(F.slice(values, i, size), lambda v: v != "").alias("slots"))), slotted)
            return F.when(fits, F.when(any_slot, with_slots).otherwise(plain)).otherwise(F.array().cast(kind))

        return F.concat(*(of(s) for s in sizes))

    def both(text_: Column) -> Column:
        def with_tokens(tokens: Column) -> Column:
            def with_raw(raw: Column) -> Column:
                return let(F.zip_with(tokens, raw, lambda t, r: F.when(t.isin(NUM, UNIT, NAME), F.lower(r)).otherwise("")), lambda values: let(F.exists(values, lambda v: v != ""), lambda any_slot: build(tokens, values, any_slot)))

            return let(_tokens(text_), with_raw)

        return let(_tokens(_template(text_)), with_tokens)

    return both(text)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, item_text (a digest), n_windows, h, at, slots, literal."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    items = items.withColumn("item_text", F.xxhash64("text"))
    rows = items.select("item_id", "item_text", F.explode(_windows(F.col("text"), list(range(1, WINDOW + 1)), True)).alias("w")).select("item_id", "item_text", "w.*")
    return rows.join(rows.groupBy("item_id", "item_text").agg(F.count_distinct("at").alias("n_windows")), ["item_id", "item_text"])


def _spanned(at: Column) -> Column:
    """Sorted positions of matched windows and of those whose tokens all lie in matched ones."""
    return let(F.array_sort(at), lambda a: F.flatten(F.transform(a, lambda p, k: let(F.coalesce(F.get(a, k + 1), p), lambda q: F.when((q > p) & (q <= p + WINDOW), F.sequence(p, q - 1)).otherwise(F.array(p))))))


def _quoted(at: Column) -> Column:
    """Do the sorted positions of matched windows hold a run of QUOTE tokens?"""
    more = QUOTE - WINDOW
    return F.exists(F.transform(at, lambda p, k: F.coalesce(F.get(at, k + more) == p + more, F.lit(False))), lambda x: x)


DOC, ITEM = ["doc_id", "doc_text"], ["item_id", "item_text"]
NUMBER, SOME = r"\p{N}+(?:[.,]\p{N}+)*", "0"
#: What stands between tokens once numbers are written as SOME.
GAP = r"[^\p{L}\p{M}0]+\p{M}*|^\p{M}+"


def _coarse(rows: DataFrame, keep: list[str], sizes: list[int], exact: bool) -> DataFrame:
    """``keep`` and h: a hash of each window of ``text`` in a coarser form than templates and literal windows, so windows
    that match in either way have a hash in common. Numbers are all alike; a window comes once in lower case and, where
    that differs, once with all unit words and capitalised words alike, whatever stands before them.

    Tokens are cut by one split, hashed once, and windows combine the hashes; no filter stands on top, since Spark would
    push it down and cut the tokens twice."""
    raw = F.array_remove(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), NUMBER, f" {SOME} "), GAP), "")
    rows = rows.select(*keep, raw.alias("raw"))
    rows = rows.select(*keep, "raw", F.transform("raw", F.lower).alias("low"))
    first = lambda r: F.substring(r, 1, 1)
    alike = lambda r, x: x.isin(UNITS.split("|")) | ((r != x) & (r != F.upper(r)) & (first(r) != F.lower(first(r))))
    typed = F.zip_with("raw", "low", lambda r, x: F.when(alike(r, x), F.lit(1).cast("long")).otherwise(F.xxhash64(x)))
    rows = rows.select(*keep, typed.alias("typed"), F.transform("low", lambda x: F.xxhash64(x)).alias("plain"))

    def of(hashes: str, size: int) -> Column:
        n = F.size(hashes)
        fits = (n == size) if exact and size < WINDOW else (n >= size)
        window = lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + k) for k in range(size)))
        return F.when(fits, F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>"))

    rows = rows.select(*keep, *(of(c, s).alias(f"{c}{s}") for c in ("typed", "plain") for s in sizes))
    both = [F.concat(f"plain{s}", F.array_compact(F.zip_with(f"plain{s}", f"typed{s}", lambda p, q: F.when(p != q, q)))) for s in sizes]
    return rows.select(*keep, F.explode_outer(F.concat(*both)).alias("h"))


def suspects(docs: DataFrame, benchmark: DataFrame, sizes: list[int]) -> DataFrame:
    """The documents (doc_id, doc_text) that share a coarse window with an item: all that can match, and few others."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("text").cast("string").alias("text")).distinct()
    asked = written(_coarse(items, [], sizes, True).where("h is not null").distinct(), "coarse")
    return _coarse(docs, DOC, sizes, False).join(bounded(asked, BROADCAST_ROWS), "h", "left_semi").select(*DOC).distinct()


def found(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, doc_text (see text_digest), item_id, matched (windows), n_windows, coverage, reparameterised (some slot differs).

    Documents are first reduced to those that share a coarse window with an item (see suspects). Their windows are
    hash-joined with the items' windows, which are broadcast only up to BROADCAST_ROWS; beyond that both sides shuffle, and
    Spark splits the partitions of common windows (a plain join, so its skew handling applies)."""
    items = written(item_windows(benchmark), "items")
    lengths = benchmark.select(F.size(_tokens(F.col("text").cast("string"))).alias("n")).where("n >= 1")
    sizes = sorted(r[0] for r in lengths.select(F.least("n", F.lit(WINDOW))).distinct().collect()) or [WINDOW]  # WINDOW values at most
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("doc_text"), F.col("text").cast("string").alias("text"))
    some = written(suspects(text, benchmark, sizes), "suspects").toDF("_id", "_text")
    text = text.join(bounded(some), text["doc_id"].eqNullSafe(some["_id"]) & (text["doc_text"] == some["_text"]), "left_semi")
    seen = text.select(*DOC, F.explode(_windows(F.col("text"), sizes, False)).alias("w"))
    seen = seen.select(*DOC, F.col("w.h").alias("h"), F.col("w.at").alias("doc_at"), F.col("w.slots").alias("doc_slots"))
    side = items.withColumnRenamed("slots", "item_slots")
    hits = seen.join(F.broadcast(side) if salted_rows_bound(side, BROADCAST_ROWS) else side, "h")
    # what matches literally maps each of the item's values to itself, whatever the document's context makes of the word
    none = F.array().cast("array<string>")
    at_item = F.coalesce("item_slots", none)
    at_doc = F.when(F.col("literal"), at_item).when(F.size(at_item) == 0, none).otherwise(F.coalesce("doc_slots", none))
    hits = hits.select(*DOC, *ITEM, (F.col("doc_at") - F.col("at")).alias("shift"), "at", "n_windows", F.arrays_zip(at_item.alias("i"), at_doc.alias("d")).alias("pairs"))
    # at most one row per window of the item and alignment; a set of pairs is bounded by the item's slots
    pairs = F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    lines = hits.groupBy(*DOC, *ITEM, "shift").agg(F.collect_set("at").alias("at"), F.max("n_windows").alias("n_windows"), pairs)
    one = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    two = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["d"])))
    good = lines.where(one & two).select(*DOC, *ITEM, "n_windows", _spanned(F.col("at")).alias("ats"), F.exists("pairs", lambda p: p["i"] != p["d"]).alias("differs"))
    good = good.select(*DOC, *ITEM, "n_windows", F.explode("ats").alias("at"), "differs", _quoted(F.col("ats")).alias("quoted"))
    good = good.groupBy(*DOC, *ITEM, "at").agg(F.max("n_windows").alias("n_windows"), F.min("differs").alias("differs"), F.max("quoted").alias("quoted"))
    each = good.groupBy(*DOC, *ITEM).agg(F.count(F.lit(1)).alias("matched"), F.max("n_windows").alias("n_windows"), F.max("differs").alias("reparameterised"), F.max("quoted").alias("quoted"))
    share = F.col("matched") / F.col("n_windows")
    each = each.where((share >= cover) | F.col("quoted")).withColumn("coverage", F.round(share, 6))
    best = F.max(F.struct("coverage", "matched", "n_windows", "reparameterised")).alias("b")
    return each.groupBy(*DOC, "item_id").agg(best).select(*DOC, "item_id", "b.matched", "b.n_windows", "b.coverage", "b.reparameterised")


def matches(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """doc_id, item_id, matched, n_windows, coverage, reparameterised of every contaminated document; see ``found``."""
    return found(docs, benchmark, cover).drop("doc_text")


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The rows of ``docs`` whose text no item contaminates, whatever their doc_id."""
    return without(docs, text_digest(docs["text"]), found(docs, benchmark, cover).select("doc_text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": query}
ORACLES: dict[str, str] = {}
