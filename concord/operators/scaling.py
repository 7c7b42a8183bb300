"""Values on one scale, and checks of the scaled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.operators.cohort import same
from concord.operators.identity import bounded
from concord.shared import kept


def library_size(values: DataFrame, sample: str = "sample_id", value: str = "raw_value") -> DataFrame:
    """Total of each sample over all its rows, mapped or not."""
    return values.groupBy(sample).agg(F.sum(value).alias("lib"))


def log_cpm(values: DataFrame, lib: DataFrame, sample: str = "sample_id", value: str = "raw_value") -> DataFrame:
    """Adds log2(1e6 * value / total + 1); a sample whose total is 0 gets null."""
    share = F.when(F.col("lib") != 0, F.col(value) / F.col("lib"))
    return values.join(lib, sample).withColumn("value", F.log2(share * 1e6 + 1)).drop("lib")


def log_signal(value: Column, scale: Column) -> Column:
    """Linear signal becomes log2(x + 1); log2 signal stays."""
    return F.when(scale == "linear", F.log2(value + 1)).otherwise(value)


def build_measurement(values: DataFrame, feature_map: DataFrame, scale_spec: DataFrame) -> DataFrame:
    """Chosen features only, each study on its own scale; raw value and its scale are kept.

    feature_map: study_id, feature_id, entity, chosen. scale_spec: study_id, scale ('linear', 'log2').
    """
    chosen = kept(feature_map.where("chosen").select("study_id", "feature_id", "entity"), "chosen")  # a row for each entity of a study
    return values.join(bounded(chosen), ["study_id", "feature_id"]).join(bounded(scale_spec), "study_id").select("study_id", "sample_id", "entity",
        "feature_id", log_signal(F.col("raw_value"), F.col("scale")).alias("value"), "raw_value", "scale")


def expect_dense(meas: DataFrame, entity: str = "entity") -> DataFrame:
    """Per study: rows, samples, entities, and whether rows = samples x entities."""
    n = meas.groupBy("study_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"),
        F.count_distinct(entity).alias("n_entities"))
    return n.withColumn("dense", F.col("n_rows") == F.col("n_samples") * F.col("n_entities"))


#: The parts of a double: 52 bits of fraction, exponents from -1022 on.
FRACTION, LEAST = 1 << 52, -1022


def ordered_bits(x: Column) -> Column:
    """A long for each double, in the same order: exponent and fraction as they are stored, with the sign. Divisions by
    powers of two lose nothing, so double_of gives the double back. -0 is 0, NaN comes after infinity."""
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("int")  # off by one next to a power of two
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.greatest(guess - (power(guess) > size).cast("int") + (power(guess + 1) <= size).cast("int"), F.lit(LEAST))
    normal = (exponent.cast("long") - LEAST + 1) * FRACTION + ((size / power(exponent) - 1) * float(FRACTION)).cast("long")
    small = (size * 2.0**537 * 2.0**537).cast("long")
    infinite = F.lit(2047 * FRACTION)
    bits = F.when(F.isnan(x), infinite + 1).when(size == float("inf"), infinite).when(size < 2.0**LEAST, small).otherwise(normal)
    return F.when((x < 0) & ~F.isnan(x), -bits).otherwise(bits)


def double_of(bits: Column) -> Column:
    size = F.abs(bits)
    exponent, fraction = F.shiftright(size, 52), size.bitwiseAND(FRACTION - 1).cast("double")
    value = F.when(exponent == 0, fraction * 2.0**-537 * 2.0**-537).otherwise((1 + fraction / float(FRACTION)) * F
        .pow(F.lit(2.0), exponent + (LEAST - 1)))
    value = F.when(size > 2047 * FRACTION, float("nan")).when(size == 2047 * FRACTION, float("inf")).otherwise(value)
    return F.when(bits < 0, -value).otherwise(value)


def group_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: exact, for all groups at once, whatever their sizes and however often a value repeats.

    Values are longs in order (ordered_bits), written once, and the middle ranks are found by digits of 16 bits from the
    top: a round counts the values of each digit among those that share the digits found so far and takes the digit in
    which the rank falls. After four rounds the value is known. A task never holds the values of a group, only 65,536
    counts for each of its two middles at most."""
    own = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    v = kept(rows.where(F.col(value).isNotNull()).select(*own, ordered_bits(F.col(value).cast("double")).alias("_v")), "median")
    n = v.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("_n") - 1) / 2).alias("rank")),
        F.struct(F.lit(1).alias("which"), F.floor(F.col("_n") / 2).alias("rank")))).alias("x")
    found = n.select(*own, ranks).select(*own, F.col("x.which").alias("_which"), F.col("x.rank").alias("_rank"),
        F.lit(0).cast("long").alias("_prefix"))
    for shift in (48, 32, 16, 0):
        found = kept(found, "middle")
        prefixes = found.select(*own, "_prefix").distinct()
        known = F.shiftright("_v", shift + 16) if shift < 48 else F.lit(0).cast("long")
        digits = v.withColumn("_prefix", known).alias("v").join(bounded(prefixes).alias("p"), same("v", "p", [*own, "_prefix"]), "left_semi")
        counts = digits.groupBy(*own, "_prefix", F.shiftright("_v", shift).alias("_digit")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*own, "_prefix").orderBy("_digit"))
        ranges = counts.withColumn("_upto", upto)
        met = found.alias("f").join(ranges.alias("r"), same("f", "r", [*own, "_prefix"])).where("_rank < _upto and _rank >= _upto - _c")
        found = met.select(*(f"f.{c}" for c in own), "_which", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank"),
            F.col("_digit").alias("_prefix"))
    middle = [F.max(F.when(F.col("_which") == k, double_of(F.col("_prefix")))) for k in (0, 1)]
    return found.groupBy(*own).agg(((middle[0] + middle[1]) / 2).alias("median")).select(*by, "median")


def value_summary(df: DataFrame, by: list[str], value: str, exact: bool = True) -> DataFrame:
    """Min, median, max, zeros, blanks and count; ``exact=False`` takes an approximate median, which needs one pass only."""
    v = F.col(value)
    more = [] if exact else [F.percentile_approx(value, 0.5).alias("v_median")]
    g = df.groupBy(*by).agg(F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.count_if(v == 0).alias("zeros"),
        F.count_if(v.isNull()).alias("blanks"), F.count(F.lit(1)).alias("n"), *more)
    if not exact:
        return g
    m = group_median(df, by, value).withColumnRenamed("median", "v_median").alias("m")
    return g.alias("g").join(m, same("g", "m", by), "left").select("g.*", "m.v_median")


def non_finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value)
    return df.agg(F.count_if(v.isNull()).alias("nulls"), F.count_if(F.isnan(v)).alias("nans"), F.count_if(F.abs(v) == float("inf")).alias("infinite"))


def cpm_closure(meas: DataFrame, sample: str = "sample_id", value: str = "value") -> DataFrame:
    """Each sample's CPM add up to a million: the smallest and largest total."""
    back = meas.groupBy(sample).agg(F.sum(F.pow(F.lit(2.0), F.col(value)) - 1).alias("total"))
    return back.agg(F.min("total").alias("least"), F.max("total").alias("most"))


def target_check(meas: DataFrame, entity: str, treated: Column, control: Column) -> DataFrame:
    """A known responder's mean in treated and control samples of each study, and whether it goes up."""
    m = meas.where(F.col("entity") == entity).groupBy("study_id").agg(F.avg(F.when(treated, F.col("value"))).alias("treated_mean"),
        F.avg(F.when(control, F.col("value"))).alias("control_mean"), F.bool_or(treated).alias("has_treated"))
    return m.withColumn("up", F.col("treated_mean") > F.col("control_mean"))
