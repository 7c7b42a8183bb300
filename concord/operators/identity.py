"""Aliases, the ladder of evidence from feature rows to entities, and representatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.shared import kept

BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; otherwise the join shuffles."""
    return F.broadcast(df) if df.select(F.lit(1)).limit(limit + 1).count() <= limit else df


def resolve_alias(df: DataFrame, col: str, aliases: DataFrame, scope: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact lookup of (alias, scope) -> id. Returns rows with column ``id``, and the distinct misses."""
    on = [F.col(f"x.{col}") == F.col("a.alias")] + ([F.col(f"x.{scope}") == F.col("a.seen_in")] if scope else [])
    joined = df.alias("x").join(bounded(aliases).alias("a"), reduce(Column.__and__, on), "left").select("x.*", F.col("a.id").alias("id"))
    return joined.where("id is not null"), joined.where(F.col("id").isNull() & F.col(col).isNotNull()).select(*([scope] if scope else []),
        col).distinct()


def alias_seen(aliases: DataFrame, texts: DataFrame, text: str = "text", study: str | None = None) -> DataFrame:
    """Aliases that occur in none of the texts (of their own ``study``, a column of both sides), regardless of case.

    A text is cut into words and what stands between them. An alias from its first to its last word is a run of such
    parts and meets the runs of the same length by hash; its ends must agree with what stands around the run. A word is
    never matched in part; an alias without a word is looked for as it is."""
    word, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    by = [study] if study else []

    def parts(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(f"{word}|{gap}"), F.lit(0))

    a = F.lower("alias")
    known = aliases.select(*by, "alias", F.regexp_replace(a, rf"\A{gap}|{gap}\z", "").alias("core"),
        F.regexp_extract(a, rf"\A{gap}", 0).alias("head"), F.regexp_extract(a, rf"{gap}\z", 0)
            .alias("tail")).where("alias is not null").distinct().withColumn("n", F.size(parts(F.col("core"))))
    sizes = sorted(r["n"] for r in known.select("n").distinct().collect())  # numbers of parts in an alias
    ends = known.where("core <> '' and (head <> '' or tail <> '')").limit(1).count() > 0
    low = texts.select(*by, F.lower(text).alias("low"))

    def runs(c: Column) -> Column:
        def of(n: int) -> Column:
            at = F.when(F.size(c) >= n, F.filter(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.get(c, i - 1).rlike(rf"\A{word}")))
            around = lambda i: (F.get(c, i - 2), F.get(c, i + (n - 1))) if ends else (F.lit(""), F.lit(""))
            return F.coalesce(F.transform(at, lambda i: F.struct(F.array_join(F.slice(c, i, n), "").alias("run"),
                F.coalesce(around(i)[0], F.lit("")).alias("before"), F.coalesce(around(i)[1], F.lit("")).alias("after"))),
                    F.array().cast("array<struct<run:string,before:string,after:string>>"))

        return F.concat(*(of(n) for n in sizes if n > 0))

    seen = known.select(*by, "alias").limit(0)
    if any(n > 0 for n in sizes):
        cut = low.select(*by, parts(F.col("low")).alias("c")).select(*by, F.explode(runs(F.col("c"))).alias("r")).select(*by, "r.*").distinct()
        hit = known.where("core <> ''").join(cut.withColumnRenamed("run", "core"),
            [*by, "core"]).where(F.col("before").endswith(F.col("head")) & F.col("after").startswith(F.col("tail")))
        seen = seen.unionByName(hit.select(*by, "alias"))
    if 0 in sizes:
        k, x = known.where("core = ''").alias("k"), low.alias("x")
        same = reduce(Column.__and__, [F.col(f"k.{c}") == F.col(f"x.{c}") for c in by], F.contains("x.low", F.lower("k.alias")))
        seen = seen.unionByName(k.join(x, same, "left_semi").select(*by, "alias"))
    return aliases.join(seen.distinct(), [*by, "alias"], "left_anti").select(*aliases.columns)


def build_lookup(ref: DataFrame, key: str, entity: str, order: str, multi: bool = False, strip_version: bool = False,
        where: Column | None = None) -> DataFrame:
    """key -> id; several keys in one field are split at '|', a version suffix is cut; the later row wins a repeated key."""
    rows = ref.where(where) if where is not None else ref
    k = F.explode(F.split(key, r"\|")) if multi else F.col(key)
    rows = rows.select(k.alias("key"), F.col(entity).alias("id"), F.col(order).alias("pos"))
    if strip_version:
        rows = rows.withColumn("key", F.split_part("key", F.lit("."), F.lit(1)))
    return rows.where("key is not null and key <> ''").groupBy("key").agg(F.max_by("id", "pos").alias("id"))


def unambiguous_lookup(ref: DataFrame, keys: list[str], entity: str) -> DataFrame:
    """Only keys that point to exactly one entity."""
    g = ref.groupBy(*keys).agg(F.min(entity).alias("id"), F.max(entity).alias("_other"))
    return g.where(F.col("id") == F.col("_other")).drop("_other")


def classify(text: Column, special: dict[str, Column] | None = None) -> Column:
    """Status decided before any lookup: control probes, several entities in one field, text lost to '#'; else null."""
    c = F.when(F.trim(text).startswith("AFFX"), "control_probe").when(text.contains("///"),
        "multiple_genes").when(F.trim(text).rlike("^#+$"), "corrupt_annotation")
    for name, when in (special or {}).items():
        c = c.when(when, name)
    return c


def stacked_lookup(ladder: list[tuple[str, str, DataFrame]], scope: str | None = None) -> DataFrame:
    """_scope, _rung, _key, _id of all rungs. A lookup may have the column ``scope``; its rows then hold for that study only."""
    parts = []
    for i, (_, _, lookup) in enumerate(ladder):
        own = F.col(scope).cast("string") if scope and scope in lookup.columns else F.lit(None).cast("string")
        parts.append(lookup.select(own.alias("_scope"), F.lit(i).alias("_rung"), F.col("key").cast("string").alias("_key"), F.col("id").alias("_id")))
    return reduce(DataFrame.unionByName, parts).where("_key is not null and _id is not null")


def repeated_keys(ladder: list[tuple[str, str, DataFrame]], scope: str | None = None) -> DataFrame:
    """Keys of a rung that have more than one id: method, key, n_ids. map_entities leaves them out."""
    names = F.array(*(F.lit(m) for m, _, _ in ladder))
    n = stacked_lookup(ladder, scope).groupBy("_scope", "_rung", "_key").agg(F.count_distinct("_id").alias("n_ids")).where("n_ids > 1")
    return n.select(F.get(names, "_rung").alias("method"), F.col("_key").alias("key"), "n_ids")


def map_entities(features: DataFrame, ladder: list[tuple[str, str, DataFrame]], status: Column | None = None, study: str | None = None,
        forbidden: dict[str, list[str]] | None = None) -> DataFrame:
    """First rung that knows the feature wins. ladder: (method, feature column, lookup key -> id). Adds id, method, status.

    A row with a ``status`` (see classify) is not looked up, and the rungs that ``forbidden`` names for its study aren't
    asked. The lookups are stacked into one keyed by study, rung and key; a feature's keys are put into an array and
    exploded once, and the lowest rung that answers is taken, so there is one join whatever the number of rungs. A key
    with more than one id tells nothing and is left out (see repeated_keys), so no feature is doubled; what a lookup says
    of the study itself goes before what it says of all. Equal rows are put together first and dealt out again, so the
    features are shuffled once and nothing depends on row numbers."""
    methods = F.array(*(F.lit(m) for m, _, _ in ladder))
    own = F.struct(*features.columns)
    barred = F.create_map(*(x for k, v in forbidden.items() for x in (F.lit(k),
        F.array(*map(F.lit, v)).cast("array<string>")))) if forbidden and study else None

    def candidate(i: int, method: str, col: str) -> Column:
        asked = F.col(col).isNotNull()
        if barred is not None:
            asked = asked & ~F.coalesce(F.array_contains(F.try_element_at(barred, F.col(study).cast("string")), method), F.lit(False))
        return F.when(asked, F.struct(F.lit(i).alias("rung"), F.col(col).cast("string").alias("key")))

    df = features.select(own.alias("_f"), (status if status is not None else F.lit(None).cast("string")).alias("_s"),
        F.array_compact(F.array(*(candidate(i, m, c) for i, (m, c, _) in enumerate(ladder)))).alias("_c"))
    df = df.groupBy("_f", "_s", "_c").agg(F.count(F.lit(1)).alias("_copies"))  # equal rows are looked up once
    side = stacked_lookup(ladder, study).groupBy("_scope", "_rung", "_key").agg(F.min("_id").alias("_id"), F.max("_id").alias("_other"))
    side = kept(side.where(F.col("_id") == F.col("_other")).drop("_other"), "ladder")
    each = df.select("*", F.explode_outer(F.when(F.col("_s").isNull(), F.col("_c"))).alias("_x"))
    on = (F.col("_x.rung") == F.col("_rung")) & (F.col("_x.key") == F.col("_key"))
    if study:
        on = on & (F.col("_scope").isNull() | (F.col("_scope") == F.col(f"_f.{study}").cast("string")))
    lowest = F.min_by(F.struct("_rung", "_id"), F.when(F.col("_id").isNotNull(), F.struct(F.col("_rung"), F.col("_scope").isNull())))
    found = each.join(bounded(side), on, "left").groupBy("_f", "_s", "_c", "_copies").agg(lowest.alias("_m"))
    found = found.select("_f", "_s", "_m", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy"))
    state = F.coalesce("_s", F.when(F.col("_m").isNull(), "unmapped").otherwise("mapped"))
    return found.select("_f.*", F.col("_m._id").alias("id"), F.get(methods, "_m._rung").alias("method"), state.alias("status"))


def symbol_from_text(text: Column) -> Column:
    """The last token in parentheses."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), F.lit(-1))


def choose_representative(fm: DataFrame, by: list[str], score: str = "mean", tie: str = "feature_id") -> DataFrame:
    """Flags one row of each group: highest score, null scores last, ties to the smaller id."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), F.asc(tie))
    return fm.withColumn("chosen", F.row_number().over(w) == 1)


def entities_in_all(fm: DataFrame, entity: str, study: str, n: int) -> DataFrame:
    return fm.groupBy(entity).agg(F.count_distinct(study).alias("n")).where(F.col("n") == n).select(entity)


def find_entity(ref: DataFrame, names: DataFrame, entity: str, current: str, others: Column) -> DataFrame:
    """Batch lookup of names as a current name or as one of an array of others; names: one column ``name``."""
    long = ref.select(F.col(entity).alias("entity_id"), F.col(current).alias("name"),
        F.lit("current").alias("how")).unionByName(ref.select(F.col(entity).alias("entity_id"), F.explode(others).alias("name"),
            F.lit("other").alias("how")))
    return long.join(names, "name").groupBy("name", "entity_id").agg(F.min("how").alias("how"))


def outdated_names(fm: DataFrame, ref: DataFrame, by: str, written: str, current: str, key: str) -> DataFrame:
    """Per source: rows whose name as written differs from the current one; date-like names aside."""
    j = fm.join(ref, key).where((F.col(written) != F.col(current)) & ~F.col(written).rlike(r"^\d{1,2}-[A-Z][a-z]{2}$"))
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n_outdated"), F.count_distinct(written).alias("n_names"))


def extra_rows_per_entity(fm: DataFrame, by: str, entity: str) -> DataFrame:
    return fm.where(F.col(entity).isNotNull()).groupBy(by).agg((F.count(F.lit(1)) - F.count_distinct(entity))
        .alias("extra_rows")).where("extra_rows > 0")


def hierarchy_parent(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Adds ``top``: the node's parent where there is one, else itself (one level)."""
    return df.withColumn("top", F.coalesce(parent, node))
