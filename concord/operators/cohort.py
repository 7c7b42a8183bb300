"""Treated-versus-control effects and the cohort questions asked of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.identity import bounded


def same(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of keys; Spark hashes it like an ordinary equi-join."""
    return reduce(Column.__and__, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


CONTROLS = ("vehicle_control", "untreated_control")
SIGNATURE = ["compounds", "exposure_h", "exposure_type"]


def signatures(treatments: DataFrame, solvents: list[str], sample: str = "sample_id") -> DataFrame:
    """sample, compounds ("A+B"), exposure_h, exposure_type: what each sample received, solvents left out."""
    real = treatments.where(~F.col("compound_id").isin(solvents))
    names = F.array_join(F.array_sort(F.collect_list("compound_id")), "+").alias("compounds")
    return real.groupBy(sample).agg(names, F.max("exposure_h").alias("exposure_h"), F.max("exposure_type").alias("exposure_type"))


def _roles(treated: Column | None, control: Column | None) -> tuple[Column, Column]:
    is_t = treated if treated is not None else F.col("role") == "treated"
    return is_t, control if control is not None else F.col("role").isin(*CONTROLS)


def matched_effect(meas: DataFrame, samples: DataFrame, sig: DataFrame, keys: list[str], entity: str = "entity", value: str = "value",
                   sample: str = "sample_id", treated: Column | None = None, control: Column | None = None) -> DataFrame:
    """For every treated group (keys and signature) and entity: mean, n, mean and n of the controls with the same keys
    (nulls equal), effect.

    Treated samples count by what they received (``sig``, see ``signatures``; those without a signature are left out),
    controls by the keys alone. The context is put together on the samples, so the fact (sample, entity, value) is joined
    once; all entities are one aggregation, and control means reach the treated groups of their keys by a window over the
    aggregated rows. Groups without a control have a null effect. Samples to leave out are left out of ``samples``.
    """
    is_t, is_c = _roles(treated, control)
    told = samples.select("*", F.coalesce(is_t, F.lit(False)).alias("_t"), F.coalesce(is_c, F.lit(False)).alias("_c")).join(sig, sample, "left")
    context = told.where(F.col("_t") & F.col("compounds").isNotNull() | ~F.col("_t") & F.col("_c"))
    context = context.select(sample, *keys, "_t", *(F.when(F.col("_t"), F.col(c)).alias(c) for c in SIGNATURE))
    rows = meas.select(sample, entity, value).join(context, sample)
    g = rows.groupBy(*keys, *SIGNATURE, "_t", entity).agg(F.avg(value).alias("treated_mean"), F.count(value).alias("n_treated"))
    w = Window.partitionBy(*keys, entity)
    g = g.withColumn("control_mean", F.max(F.when(~F.col("_t"), F.col("treated_mean"))).over(w))
    g = g.withColumn("n_control", F.coalesce(F.max(F.when(~F.col("_t"), F.col("n_treated"))).over(w), F.lit(0).cast("bigint")))
    return g.where("_t").drop("_t").withColumn("effect", F.col("treated_mean") - F.col("control_mean"))


def effect_ids(samples: DataFrame, sig: DataFrame, keys: list[str], sample: str = "sample_id", treated: Column | None = None,
        control: Column | None = None) -> DataFrame:
    """The sorted sample ids behind every treated group (keys and signature) and its controls."""
    is_t, is_c = _roles(treated, control)
    ids = F.array_sort(F.collect_list(sample))
    t = samples.where(is_t).join(sig, sample).groupBy(*keys, *SIGNATURE).agg(ids.alias("treated_ids")).alias("t")
    c = samples.where(is_c).groupBy(*keys).agg(ids.alias("control_ids")).alias("c")
    got = t.join(c, same("t", "c", keys), "left")
    none = F.array().cast(samples.select(F.array(sample)).schema[0].dataType)
    return got.select("t.*", F.coalesce("c.control_ids", none).alias("control_ids"))


def effect_by_entity(effects: DataFrame, entity: str, comparison: str, names: list[str]) -> DataFrame:
    """Entity x comparison table of mean effects; the comparisons are named, so the pivot needs no extra pass."""
    return effects.groupBy(entity).pivot(comparison, names).agg(F.round(F.avg("effect"), 4))


def compared_sets(values: DataFrame, members: DataFrame, sample: str, entity: str, value: str, names: list[str]) -> DataFrame:
    """Entity x comparison table: mean of the treated samples less mean of the control samples of named comparisons.

    members: comparison, side ('treated' or 'control'), sample; a sample may stand in any number of comparisons and on both
    sides. Values meet their memberships once and all comparisons come out of one aggregation; an entity without values on
    both sides of a comparison has null there."""
    own = members.select("comparison", "side", F.col(sample).alias("_s")).distinct()
    met = values.join(bounded(own), F.col(sample) == F.col("_s"))
    each = met.groupBy(entity)

    def mean(name: str, side: str) -> Column:
        return F.avg(F.when((F.col("comparison") == name) & (F.col("side") == side), F.col(value)))

    return each.agg(*(F.round(mean(n, "treated") - mean(n, "control"), 4).alias(n) for n in names))


def comparison_members(members: DataFrame, sample: str) -> DataFrame:
    """What stands behind each comparison: the numbers and sorted ids of its two sides, either of which may be empty."""

    def ids(side: str) -> Column:
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col(sample))))

    g = members.groupBy("comparison").agg(ids("treated").alias("treated_ids"), ids("control").alias("control_ids"))
    return g.select("comparison", F.size("treated_ids").cast("long").alias("n_treated"),
        F.size("control_ids").cast("long").alias("n_control"), "treated_ids", "control_ids")


def filter_population(effects: DataFrame, population: DataFrame, keys: list[str]) -> DataFrame:
    return effects.alias("e").join(population.select(*keys).distinct().alias("p"), same("e", "p", keys), "left_semi")


def consistent_direction(effects: DataFrame, entity: str, by: str) -> DataFrame:
    """Entities whose mean effect has one sign in every source."""
    m = effects.groupBy(entity, by).agg(F.avg("effect").alias("m"))
    return m.groupBy(entity).agg(F.bool_and(F.col("m") > 0).alias("all_up"), F.bool_and(F.col("m") < 0).alias("all_down"),
        F.count(F.lit(1)).alias("n_sources"))


def up_in_every(effects: DataFrame, treatment: list[str], line: str, universe: DataFrame) -> DataFrame:
    """Treatments (and entities) whose effect is positive in every line of the universe; a line without a control disqualifies."""
    n = universe.select(line).distinct().agg(F.count(F.lit(1)).alias("n_lines"))
    m = effects.groupBy(*treatment, line).agg(F.bool_and(F.coalesce(F.col("effect") > 0, F.lit(False))).alias("up"))
    up = m.groupBy(*treatment).agg(F.count_if("up").alias("n_up"))
    return up.crossJoin(F.broadcast(n)).where("n_up = n_lines").select(*treatment)  # n: one row


def eligible_sources(effects: DataFrame, by: list[str], kind: str = "acute", hours: float | None = None) -> DataFrame:
    """Sources with a treated group of that kind of exposure, of stated (or the given) hours, and with a matched control."""
    stated = F.col("exposure_h").isNotNull() if hours is None else F.col("exposure_h") == hours
    return effects.where((F.col("exposure_type") == kind) & stated & (F.col("n_control") > 0)).select(*by).distinct()


def count_by_source(samples: DataFrame, study: str, distinct: dict[str, str]) -> DataFrame:
    """Per study and in total: n_samples, and the distinct values of columns (result name -> column)."""
    counts = [F.count_distinct(c).alias(name) for name, c in distinct.items()]
    g = samples.rollup(study).agg(F.count(F.lit(1)).alias("n_samples"), *counts, F.grouping(study).alias("_all"))
    return g.withColumn(study, F.when(F.col("_all") == 1, "total").otherwise(F.col(study))).drop("_all")


def count_by_line(samples: DataFrame, line: str) -> DataFrame:
    return samples.groupBy(line).agg(F.count(F.lit(1)).alias("n"))


def count_by_compound(treatments: DataFrame, compound: str = "compound_id", sample: str = "sample_id") -> DataFrame:
    return treatments.groupBy(compound).agg(F.count_distinct(sample).alias("n"))


def list_derived(lines: DataFrame, used: DataFrame, key: str, doubles: list) -> DataFrame:
    """Lines that some row of ``used`` has, without those that are another line under a second name."""
    kept = lines.where(~F.col(key).isin(doubles)) if doubles else lines
    return kept.join(used.select(key), key, "left_semi")


def partition_by_flag(samples: DataFrame, study: str, flag: Column) -> DataFrame:
    """flagged (true where any of a study's rows is), studies (sorted, as text): the sources split in two."""
    g = samples.groupBy(study).agg(F.bool_or(F.coalesce(flag, F.lit(False))).alias("flagged"))
    return g.groupBy("flagged").agg(F.array_join(F.array_sort(F.collect_list(study)), ", ").alias("studies"), F.count(F.lit(1)).alias("n"))


def issue_lookup(issues: DataFrame, check: str, by: list[str], record: str, resolution: str | None = None) -> DataFrame:
    """What the issue table says of one check: per ``by`` the number of issues, of records, and the first record."""
    i = issues.where(F.col("check_name") == check)
    i = i.where(F.col("resolution") == resolution) if resolution else i
    return i.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(record).alias("n_records"), F.min(record).alias("first_record"))


def pooled_effect(effects: DataFrame, entity: str, by: str) -> DataFrame:
    """Mean of per-source means, each source weighing the same, and the sources spelled out."""
    m = effects.where("effect is not null").groupBy(entity, by).agg(F.avg("effect").alias("m"))
    text = F.concat_ws("=", by, F.format_string("%.2f", F.round("m", 2)))
    return m.groupBy(entity).agg(F.avg("m").alias("pooled"), F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("by_source"),
        F.count(F.lit(1)).alias("n_sources"))


def paired_difference(df: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """Each derived node's value minus its parent's, with the rank of the difference (largest first, ties by name)."""
    c, p = df.alias("c"), df.alias("p")
    j = c.join(p, F.col(f"c.{parent}") == F.col(f"p.{node}")).select(F.col(f"c.{node}").alias(node), F.col(f"c.{parent}").alias(parent),
        (F.col(f"c.{value}") - F.col(f"p.{value}")).alias("difference"))
    return j.withColumn("rank", F.row_number().over(Window.partitionBy(parent).orderBy(F.desc("difference"), node)))


def group_contrast(df: DataFrame, a: Column, b: Column, by: list[str], value: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.avg(F.when(a, F.col(value))).alias("mean_a"), F.avg(F.when(b, F.col(value))).alias("mean_b"))
    return g.withColumn("contrast", F.col("mean_a") - F.col("mean_b"))


def pooling_blockers(df: DataFrame, study: str, reasons: dict[str, Column]) -> DataFrame:
    """study, reason: a row for each condition that any of the study's rows meets."""
    g = df.groupBy(study).agg(*(F.bool_or(c).alias(f"_{i}") for i, c in enumerate(reasons.values())))
    listed = F.filter(F.array(*(F.when(F.col(f"_{i}"), name) for i, name in enumerate(reasons))), lambda x: x.isNotNull())
    return g.select(study, F.explode(listed).alias("reason"))


def controls_for(samples: DataFrame, target: Column, control: Column, keys: list[str], sample: str = "sample_id") -> DataFrame:
    """Controls that share study and batch with a record that meets ``target``."""
    hit = samples.where(target).select(*keys).distinct()
    return samples.where(control).alias("s").join(hit.alias("h"), same("s", "h", keys), "left_semi").select(sample, *keys)


def never_treated(samples: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return samples.join(children.select(key), key, "left_anti")


def dose_by_source(df: DataFrame, study: str, dose: str) -> DataFrame:
    """Per study its doses in numeric order as text; 'not stated' where all are null."""
    g = df.groupBy(study).agg(F.array_sort(F.collect_set(dose)).alias("d"), F.count_if(F.col(dose).isNull()).alias("n_unstated"))
    return g.select(study, F.when(F.size("d") == 0, "not stated").otherwise(F
        .array_join(F.transform("d", lambda x: x.cast("bigint").cast("string")), ", ")).alias("doses"), "n_unstated")


def exposure_by_source(df: DataFrame, study: str, hours: str, chronic: Column) -> DataFrame:
    g = df.groupBy(study).agg(F.bool_and(chronic).alias("c"), F.count(hours).alias("n"), F.array_sort(F.collect_set(hours)).alias("h"))
    return g.select(study, F.when(F.col("c"), "chronic").when(F.col("n") == 0, "not stated")
        .otherwise(F.array_join(F.col("h").cast("array<string>"), ", ")).alias("exposure"))


def fold_label(effect: Column, little: float = 0.15) -> Column:
    """log2 effect in words."""
    fold = F.format_string("%.1f", F.round(F.pow(F.lit(2.0), F.abs(effect)), 1))
    return F.when(effect.isNull(), None).when(F.abs(effect) < little, "little change").when(effect > 0,
        F.concat(fold, F.lit("x higher"))).otherwise(F.concat(fold, F.lit("x lower")))


def sample_view(samples: DataFrame, treatments: DataFrame, issues: DataFrame) -> DataFrame:
    """Samples with their treatments spelled out and their issues counted; both sides are aggregated before the join."""
    text = F.concat_ws(" ", "compound_id", F.col("dose").cast("bigint").cast("string"))
    spelled = treatments.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list(text)), " + ").alias("treatment"))
    counts = issues.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_issues"), F.count_if(F.col("resolution") == "flagged").alias("n_open"))
    zero = F.lit(0).cast("bigint")
    return samples.join(spelled, "sample_id", "left").join(counts, "sample_id", "left").withColumn("n_issues",
        F.coalesce("n_issues", zero)).withColumn("n_open", F.coalesce("n_open", zero))


def expression_view(meas: DataFrame, samples: DataFrame, excluded: Column) -> DataFrame:
    """The fact with its samples' context; excluded samples are left out before the join."""
    return meas.join(samples.where(~F.coalesce(excluded, F.lit(False))), ["sample_id", "study_id"])


def treated_listing(samples: DataFrame, treatments: DataFrame, compound: str, sample: str = "sample_id") -> DataFrame:
    """Treated samples that got the compound, with dose and time."""
    got = treatments.where(F.col("compound_id") == compound).select(sample, "dose", "exposure_h", "exposure_type")
    return samples.where(F.col("role") == "treated").join(got, sample)


def _listed(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ", ")


def study_dashboard(samples: DataFrame, study: str, line: str) -> DataFrame:
    role = F.col("role")
    return samples.groupBy(study).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(role == "treated").alias("n_treated"),
        F.count_if(role.isin(*CONTROLS)).alias("n_control"), F.count_if(role == "parental").alias("n_parental"), _listed(line).alias("lines"),
    )


def line_dashboard(samples: DataFrame, line: str, study: str) -> DataFrame:
    return samples.groupBy(line).agg(F.count_distinct(study).alias("n_studies"), F.count(F.lit(1)).alias("n"), _listed(study).alias("studies"))


def treatment_dashboard(treatments: DataFrame, samples: DataFrame, study: str, sample: str = "sample_id") -> DataFrame:
    """Per compound and time ("chronic", "not stated" or hours): samples, mean dose, and the studies that used it."""
    time = F.when(F.col("exposure_type") == "chronic", "chronic").when(F.col("exposure_h").isNull(),
        "not stated").otherwise(F.col("exposure_h").cast("bigint").cast("string"))
    rows = treatments.join(samples.select(sample, study), sample).withColumn("time", time)
    return rows.groupBy("compound_id", "time").agg(F.count_distinct(sample).alias("n"), F.avg("dose").alias("mean_dose"),
        _listed(study).alias("studies"))


def issue_dashboard(issues: DataFrame, study: str) -> DataFrame:
    return issues.groupBy(study, "check_name", "resolution", "impact").agg(F.count(F.lit(1)).alias("n"))


def totals(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table, by name."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out
