"""Data-quality checks. Each returns rows that ``as_issues`` turns into the issue table."""

from __future__ import annotations

import calendar
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.functions.patterns import MOLAR
from concord.operators.cohort import same
from concord.operators.identity import bounded
from concord.shared import kept

REACH = 40  # characters behind a quantity in which a name makes it a dose


def as_issues(df: DataFrame, check: str, study: Column, record: Column, observed: Column, expected: Column, resolution: str = "flagged",
        inventory: DataFrame | None = None) -> DataFrame:
    """check, study_id, record_id, observed and expected (500 characters at most), resolution, impact and inventory_id
    ('minor' and null unless the inventory of (check, impact, id) says otherwise)."""
    text = {"study_id": study, "record_id": record, "observed": F.substring(observed.cast("string"), 1, 500),
        "expected": F.substring(expected.cast("string"), 1, 500)}
    out = df.select(F.lit(check).alias("check"), *(c.cast("string").alias(n) for n, c in text.items()), F.lit(resolution).alias("resolution"))
    if inventory is None:
        return out.withColumn("impact", F.lit("minor")).withColumn("inventory_id", F.lit(None).cast("string"))
    known = inventory.where(F.col("check") == check).groupBy("check").agg(F.min("impact").alias("_i"), F.min("id").alias("inventory_id"))
    out = out.join(F.broadcast(known), "check", "left")  # known: one row
    return out.withColumn("impact", F.coalesce("_i", F.lit("minor"))).select(*(c for c in out.columns if c not in ("_i", "inventory_id")),
        "impact", "inventory_id")


def spelled_pattern(name: Column) -> Column:
    """A pattern for the spelling as a whole word; spellings of three letters or more are found in any case."""
    text = F.regexp_replace(name, r"([^\p{L}\p{N}\s_])", r"\\$1")
    return F.concat(F.when(F.length(name) >= 3, F.lit("(?iu:")).otherwise(F.lit("(?:")), F.lit(r"(?<![\w-])"), text, F.lit(r"(?![\w-]))"))


def dose_above_limit(df: DataFrame, by: list[str], text: str, limit: float, names: DataFrame, study: str | None = None,
        reach: int = REACH) -> DataFrame:
    """Every quantity above the limit (in nM) that one of the study's names follows within ``reach`` characters, over line
    breaks too: ``by``, amount, unit, value, and the first such name; once for each text field (``by``), number and unit.

    names: name, and ``study`` where names hold for one study only. Quantities are found with the text behind them and
    reduced to those above the limit first; only they meet the names, by study."""
    after = rf"(?=(?s:(.{{0,{reach}}})))"
    units = "|".join(sorted(map(re.escape, MOLAR), key=len, reverse=True))
    quantity = F.lit(rf"(?<![\p{{L}}\p{{N}}.])(\d+(?:\.\d+)?)\s*({units})(?![\p{{L}}\p{{N}}]){after}")
    scale = F.create_map(*(F.lit(x) for kv in MOLAR.items() for x in kv))
    parts = [F.regexp_extract_all(text, quantity, F.lit(i)) for i in (1, 2, 3)]
    found = F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("n", "unit", "after"), strict=True))),
        lambda q: F.struct(q["n"].cast("double").alias("amount"), q["unit"].alias("unit"),
            (q["n"].cast("double") * F.element_at(scale, q["unit"])).alias("value"), q["after"].alias("after")))
    scope = [study] if study else []
    hit = df.select(*dict.fromkeys([*by, *scope]), F.explode(F.filter(found, lambda q: q["value"] > limit)).alias("q"))
    known = names.where("name is not null and name <> ''").select(*(F.col(c).alias("_study") for c in scope), "name",
        spelled_pattern(F.col("name")).alias("_p")).distinct()
    known = known.groupBy(*(["_study"] if study else [])).agg(F.sort_array(F.collect_list(F.struct("name", "_p")))
        .alias("_names"))  # the spellings of a study
    met = hit.join(bounded(known), F.col(study) == F.col("_study")) if study else hit.crossJoin(F.broadcast(known))  # one row
    first = F.try_element_at(F.filter("_names", lambda x: F.regexp_like(F.col("q.after"), x["_p"])), F.lit(1))["name"]
    got = met.select(*by, "q.amount", "q.unit", "q.value", first.alias("name")).where("name is not null")
    return got.groupBy(*by, "amount", "unit").agg(F.first("value").alias("value"), F.min("name").alias("name"))


def stored_above_limit(treatments: DataFrame, keys: list[str], dose: str, limit: float) -> DataFrame:
    """Stored doses above the limit."""
    return treatments.where(F.col(dose) > limit).select(*keys, dose)


def fields_contradict(views: DataFrame, study: str, record: str, field: str, value: str, view: str | None = None) -> DataFrame:
    """Records that their own fields describe differently.

    views: study, record, field, value (a row for each value that a field names; null for none) and optionally the view
    that a field belongs to (fields of one view are taken together). Only fields that vary between the records of a study
    are compared, a field that a record lacks names nothing, and a study with fewer than two such fields is left out.
    Returns n_views, n_sets and odd_ones: where there are more than two views, those whose set no other view has. The
    views are read once: what each record says is one row, written, of which the rest is made without dealing it again.
    """
    told = views.groupBy(study, record).agg(F.collect_set(F.struct(F.col(field).alias("f"), F.col(value).alias("v"))).alias("_told"))

    def named(f: Column) -> Column:
        return F.array_sort(F.transform(F.filter("_told", lambda x: x["f"].eqNullSafe(f) & x["v"].isNotNull()), lambda x: x["v"]))

    each = F.transform(F.array_distinct(F.transform("_told", lambda x: x["f"])), lambda f: F.struct(f.alias("f"), named(f).alias("s")))
    told = kept(told.select(study, record, each.alias("_told")), "told")  # compared by study, then by record
    sets = told.select(study, F.explode("_told").alias("x")).select(study, F.col("x.f").alias(field), F.col("x.s").alias("set"))
    size = told.groupBy(study).agg(F.count(record).alias("_records"))
    spread = sets.groupBy(study, field).agg(F.count_distinct("set").alias("_sets"), F.count(F.lit(1)).alias("_n"),
        F.max(F.size("set")).alias("_most"))
    varies = (F.col("_sets") > 1) | (F.col("_n") < F.col("_records")) & (F.col("_most") > 0)
    used = spread.join(size, study).where(varies).select(study, field)
    used = used.withColumn("_used", F.count(F.lit(1)).over(Window.partitionBy(study))).where("_used > 1").drop("_used")
    view_of = views.select(field, F.col(view).alias("_view")).distinct() if view else used.select(field, F.col(field).alias("_view")).distinct()
    asked = used.join(view_of, field).groupBy(study, F.col("_view").alias("view")).agg(F.collect_list(field).alias("fields"))
    asked = asked.groupBy(study).agg(F.array_sort(F.collect_list(F.struct("view", "fields"))).alias("_asked"))

    def seen(v: Column) -> Column:
        of = F.transform(F.filter("_told", lambda x: F.array_contains(v["fields"], x["f"])), lambda x: x["s"].cast("array<string>"))
        return F.struct(v["view"].alias("view"), F.array_sort(F.array_distinct(F.flatten(of))).alias("set"))

    g = told.where(F.col(record).isNotNull()).join(bounded(asked), study).select(study, record, F.transform("_asked", seen).alias("views"))
    g = g.withColumn("n_views", F.size("views")).withColumn("n_sets",
        F.size(F.array_distinct(F.transform("views", lambda x: x["set"])))).where("n_sets > 1")
    alone = F.filter("views", lambda x: F.size(F.filter("views", lambda y: y["set"] == x["set"])) == 1)
    odd = F.when((F.col("n_views") > 2) & (F.size(alone) > 0), F.array_join(F.transform(alone, lambda x: x["view"]), ","))
    return g.select(study, record, "n_views", "n_sets", odd.alias("odd_ones"))


def duplicate_titles(df: DataFrame, study: str, record: str, title: str, batch: str, code: str) -> DataFrame:
    """Titles that several records of a study share once the lab's own code (a pattern) is cut off: within one batch a
    repeated label, across batches to be looked at."""
    core = F.trim(F.regexp_replace(title, code, "")).alias("core")
    g = df.select(study, core, record, F.struct(batch).alias("_b")).groupBy(study, "core")
    g = g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_b").alias("n_batches"), F.min(record).alias("first_record"))
    return g.where("n > 1").withColumn("kind", F.when(F.col("n_batches") > 1, "across batches").otherwise("within batch"))


def duplicate_title_records(df: DataFrame, study: str, record: str, title: str, batch: str, code: str, named: int = 10) -> DataFrame:
    """One row for each record of a repeated title: study, record, title, kind ('within batch' or 'across batches'),
    n_others, and others: the first ``named`` of the other records, in order. The records of a title meet only as counts
    and as the few that are named, however many share it."""
    rows = df.withColumn("_core", F.trim(F.regexp_replace(title, code, "")))
    repeated = duplicate_titles(df, study, record, title, batch, code).select(F.col(study).alias("_st"), F.col("core").alias("_c"), "n", "kind")
    hit = rows.join(repeated, F.col(study).eqNullSafe(F.col("_st")) & (F.col("_core") == F.col("_c")))
    place = F.row_number().over(Window.partitionBy("_st", "_core").orderBy(record))
    few = hit.withColumn("_k", place).where(F.col("_k") <= named + 1).groupBy(F.col("_st").alias("_s2"),
        F.col("_core").alias("_c2")).agg(F.array_sort(F.collect_list(record)).alias("_first"))
    met = hit.join(few, F.col("_st").eqNullSafe(F.col("_s2")) & (F.col("_core") == F.col("_c2")))
    others = F.slice(F.filter("_first", lambda x: x != F.col(record)), 1, named)
    return met.select(study, record, title, "kind", (F.col("n") - 1).alias("n_others"), others.alias("others"))


def no_control_in_batch(samples: DataFrame, keys: list[str], treated: Column, control: Column, line: str, parent: str | None = None) -> DataFrame:
    """Treated records without a control that has the same keys (nulls equal) and the same line or its parent."""
    s, c = samples.where(treated).alias("s"), samples.where(control).select(*keys, line).distinct().alias("c")
    fits = F.col(f"s.{line}").eqNullSafe(F.col(f"c.{line}"))
    if parent:
        fits = fits | (F.col(f"s.{parent}") == F.col(f"c.{line}"))
    return s.join(c, same("s", "c", keys) & fits, "left_anti")


def value_scale_mismatch(values: DataFrame, by: str, value: str, notes: DataFrame, note: str) -> DataFrame:
    """Values that contradict the stated processing: 'counts' that aren't whole or are negative, 'log2' beyond 40."""
    g = values.groupBy(by).agg(F.min(value).alias("least"), F.max(value).alias("most"),
        F.count_if(F.col(value) != F.round(value)).alias("n_fraction")).join(notes, by)
    why = F.when(F.col(note).rlike("(?i)count") & ((F.col("n_fraction") > 0) | (F.col("least") < 0)),
        "not counts").when(F.col(note).rlike("(?i)log2") & (F.col("most") > 40), "not log2")
    return g.select(by, "least", "most", "n_fraction", why.alias("problem")).where("problem is not null")


def date_like(name: Column) -> Column:
    """Names that a spreadsheet has turned into a day and month."""
    return name.rlike(rf"^\d{{1,2}}-({'|'.join(calendar.month_abbr[1:])})$")


def recovered_names(features: DataFrame, keys: list[str], name: str, mapping: DataFrame, symbol: str) -> DataFrame:
    """Date-like names with the symbol that the mapping (keys, symbol) gives them back; null where it has none."""
    hit = features.where(date_like(F.col(name))).select(*keys, name)
    return hit.join(mapping.select(*keys, F.col(symbol).alias("recovered")), keys, "left")


def duplicate_record_id(df: DataFrame, record: str, source: str) -> DataFrame:
    """Ids that arrive more than once: arrivals and distinct sources."""
    return df.groupBy(record).agg(F.count(F.lit(1)).alias("n_arrivals"), F.count_distinct(source).alias("n_sources")).where("n_arrivals > 1")


def nested_series(df: DataFrame, study: str, relation: str, prefix: str) -> DataFrame:
    """Sources whose relation text names another source: what follows the last colon."""
    return df.where(F.startswith(F.col(relation), F.lit(prefix))).select(study,
        F.trim(F.element_at(F.split(F.col(relation), ":"), -1)).alias("part_of")).distinct()


def out_of_scope(df: DataFrame, by: str, foreign: Column) -> DataFrame:
    return df.where(foreign).groupBy(by).agg(F.count(F.lit(1)).alias("n_foreign"))


def required_blank(df: DataFrame, record: str, cols: list[str]) -> DataFrame:
    """record, column for every required value that is null or empty, in one scan."""
    blank = [F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), c) for c in cols]
    return df.select(record, F.explode(F.filter(F.array(*blank), lambda x: x.isNotNull())).alias("column"))


def unknown_values(df: DataFrame, record: str, conditions: dict[str, Column]) -> DataFrame:
    """record, problem for each condition that holds, in one scan."""
    hits = [F.when(c, name) for name, c in conditions.items()]
    return df.select(record, F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("problem"))


def basis_flags(df: DataFrame, study: str, inferred: Column, assigned: Column, title: str, unexplained: str) -> DataFrame:
    """study, problem, n: batches that were inferred, replicate numbers that were assigned, titles with a label (a
    pattern) that nothing explains; in one scan, problems without a row left out."""
    conditions = {"batch_inferred": inferred, "replicate_assigned": assigned, "unexplained_label": F.col(title).rlike(unexplained)}
    return unknown_values(df, study, conditions).groupBy(study, "problem").agg(F.count(F.lit(1)).alias("n"))


def entity_rows_by_status(mapped: DataFrame, study: str, feature: str) -> DataFrame:
    """Rows without an entity by study and status; rows whose annotation is corrupt one by one, with their feature."""
    one = F.when(F.col("status") == "corrupt_annotation", F.col(feature)).alias(feature)
    return mapped.where("status <> 'mapped'").groupBy(study, "status", one).agg(F.count(F.lit(1)).alias("n"))


def compound_spellings(df: DataFrame, study: str, entity: str, alias: str) -> DataFrame:
    g = df.groupBy(study, entity).agg(F.array_sort(F.collect_set(alias)).alias("s"))
    return g.where(F.size("s") > 1).select(study, entity, F.array_join("s", ", ").alias("spellings"))


def column_order(df: DataFrame, by: str, stated: str, order: list[str]) -> DataFrame:
    """Rows whose stated position isn't their rank in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(stated) != F.col("rank"))


def empty_reference(df: DataFrame, record: str, text: str, phrases: list[str]) -> DataFrame:
    """Fields that only point elsewhere ("see above")."""
    return df.where(F.lower(F.trim(text)).isin([p.lower() for p in phrases])).select(record, text).distinct()


def free_text_conflict(df: DataFrame, by: str, text: str, pattern: str) -> DataFrame:
    """Groups whose texts state more than one value of the same parameter."""
    v = df.select(by, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("v"))
    return v.groupBy(by).agg(F.count_distinct("v").alias("n_values")).where("n_values > 1")


def fewer_replicates(samples: DataFrame, study: str, conditions: list[str]) -> DataFrame:
    """Conditions smaller than the study's usual size: the most frequent size, of equally frequent ones the largest."""
    sizes = samples.groupBy(study, *conditions).agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.groupBy(study, "n").agg(F.count(F.lit(1)).alias("c"))
    usual = counts.groupBy(study).agg(F.max_by("n", F.struct("c", "n")).alias("usual"))
    return sizes.join(usual, study).where("n < usual")


def design_gap(df: DataFrame, study: str, a: str, b: str) -> DataFrame:
    """Pairs missing from the study's full grid; the grid is built within each study."""
    used = df.select(study, a, b).distinct()
    grid = used.select(study, a).distinct().join(bounded(used.select(study, b).distinct()), study)
    return grid.join(used, [study, a, b], "left_anti")


def issue_summary(issues: DataFrame) -> DataFrame:
    def listed(c):
        return F.array_join(F.array_sort(F.collect_set(c)), ", ")

    return issues.groupBy("check", "resolution").agg(F.count(F.lit(1)).alias("n"), listed("study_id").alias("studies"),
        listed("inventory_id").alias("inventory"))


def coverage(inventory: DataFrame, issues: DataFrame, tags: DataFrame, built_in: DataFrame) -> DataFrame:
    """Each inventory row: flagged by a check, else fixed by a rule or by construction, else not covered.

    inventory: id, check. issues: check, resolution. tags and built_in: id.
    """
    flagged = issues.where("resolution = 'flagged'").groupBy("check").agg(F.count(F.lit(1)).alias("n_issues"))
    fixed = tags.select("id").unionByName(built_in.select("id")).distinct().withColumn("_fixed", F.lit(True))
    j = inventory.join(flagged, "check", "left").join(fixed, "id", "left")
    state = F.when(F.col("n_issues") > 0, "flagged").when(F.col("_fixed"), "fixed").otherwise("not covered")
    return j.select("id", "check", state.alias("state"), F.coalesce("n_issues", F.lit(0).cast("bigint")).alias("n_issues"))


def program_tags(spark: SparkSession, programs: dict[str, dict]) -> DataFrame:
    """id, fixed_by: the inventory rows that rules and named records of rule programs name ('program: rule'; programs are
    small, hand-written mappings)."""
    rows = [(b["inventory"], f"{name}: {b.get('name')}") for name, p in programs
        .items() for b in [*p.get("rules", []), *p.get("records", {}).values()] if isinstance(b, dict) and b.get("inventory")]
    return spark.createDataFrame(rows, "id string, fixed_by string")


def require_covered(covered: DataFrame) -> DataFrame:
    """The gate: raises if any inventory row is not covered."""
    lost = [r["id"] for r in covered.where("state = 'not covered'").limit(20).collect()]
    if lost:
        raise ValueError(f"inventory rows not covered: {lost}")
    return covered


def load_summary(samples: DataFrame, treatments: DataFrame, meas: DataFrame, features: DataFrame) -> DataFrame:
    """Per study its samples, treatments, values, entities and mapped features; one aggregate for each fact, then joined."""
    s = samples.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_samples"))
    tr = treatments.join(samples.select("sample_id", "study_id"), "sample_id").groupBy("study_id").agg(F.count(F.lit(1)).alias("n_treatments"))
    m = meas.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_values"))
    f = features.groupBy("study_id").agg(F.count_distinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_features"),
        F.count("entity").alias("n_mapped"))
    return s.join(tr, "study_id", "left").join(m, "study_id", "left").join(f, "study_id", "left")


def issues_by_study(issues: DataFrame) -> DataFrame:
    g = issues.groupBy("study_id")
    return g.agg(F.count_if(F.col("impact") == "major").alias("major"), F.count_if(F.col("impact") == "minor").alias("minor"),
        F.count_if(F.col("resolution") == "flagged").alias("flagged"), F.count_if(F.col("resolution") == "fixed").alias("fixed"))


def issues_for_record(issues: DataFrame, record: str, study: str) -> DataFrame:
    """A record's own issues, and those of its study as a whole."""
    return issues.where(F.col("record_id") == record).unionByName(issues.where(F.col("record_id").isNull() & (F.col("study_id") == study)))
