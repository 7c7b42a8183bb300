"""Constraints as violation tables, content fingerprints and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType

from concord.operators.identity import bounded
from concord.shared import kept

RANGE_ROWS = 1_000_000  # rows in a range of surrogate ids, about


def check_not_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """column, n_null for each listed column, in one scan."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_null")) for c in cols))).alias("x")).select("x.*")


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_foreign_key(child: DataFrame, col: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values of ``col`` that the parent lacks, and their rows."""
    lost = child.where(F.col(col).isNotNull()).join(parent.select(F.col(key).alias("_key")), F.col(col) == F.col("_key"), "left_anti")
    return lost.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def check_vocabulary(df: DataFrame, col: str, vocabulary: list[str]) -> DataFrame:
    return df.where(F.col(col).isNotNull() & ~F.col(col).isin(vocabulary)).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def vocabulary_drift(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Values that only one of two lists has."""
    j = a.select(F.col(col).alias("a")).distinct().join(b.select(F.col(col).alias("b")).distinct(), F.col("a") == F.col("b"), "full_outer")
    return j.where("a is null or b is null").select(F.coalesce("a", "b").alias("value"),
        F.when(F.col("a").isNull(), "second").otherwise("first").alias("only_in"))


def check_predicate(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is false; null passes, as in an SQL CHECK."""
    return df.where(~F.coalesce(condition, F.lit(True)))


def constraint_report(checks: dict[str, DataFrame]) -> DataFrame:
    """constraint, n_violations: the rows of each violation table."""
    parts = [v.agg(F.count(F.lit(1)).alias("n_violations")).select(F.lit(k).alias("constraint"), "n_violations") for k, v in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: A row digest is cut into LANES parts of LANE_HEX hex digits. Sums of 16 bits stay below 2^63 up to 10^14 rows.
LANES, LANE_HEX, LANE_MODULUS = 8, 4, 1 << 32


def row_digest(df: DataFrame, cols: list[str]) -> Column:
    """MD5 of an encoding that no other row has: the columns' names, then for each value its length in bytes, ':' and the
    value, or '-' for null. Nested values are written as JSON, binary ones as hex."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType
        if isinstance(kind, BinaryType):
            return F.hex(c)
        return F.when(F.col(c).isNotNull(), F.to_json(F.struct(c))) if isinstance(kind, (ArrayType, MapType, StructType)) else F.col(c).cast("string")

    values = [F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in cols]
    return F.md5(F.concat(F.lit("".join(f"{len(c.encode())}:{c}" for c in cols) + ";"), *values))


def content_lanes(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """lanes (array of long) and n_rows: a hash of the table as a multiset of rows. Digests are cut into lanes and each
    lane is added, so every task returns one row, order and partitions don't matter, and lanes of parts can be added and
    taken away (see combined_lanes)."""
    cols = [c for c in sorted(df.columns) if c not in exclude]
    h = df.select(row_digest(df, cols).alias("h"))
    lanes = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + LANE_HEX * k, LANE_HEX), 16, 10).cast("long")), F.lit(0)) for k in range(LANES)]
    one = h.agg(*(x.alias(f"_l{k}") for k, x in enumerate(lanes)), F.count(F.lit(1)).alias("n_rows"))
    return one.select(F.array(*(F.pmod(f"_l{k}", F.lit(LANE_MODULUS)) for k in range(LANES))).alias("lanes"), "n_rows")


def combined_lanes(parts: DataFrame, by: list[str] = (), sign: str | None = None) -> DataFrame:
    """Lanes and n_rows of tables put together, for each ``by``; parts whose ``sign`` is -1 are taken away."""
    times = F.col(sign) if sign else F.lit(1)
    total = [F.sum(F.get("lanes", k) * times).alias(f"_l{k}") for k in range(LANES)]
    g = parts.groupBy(*by).agg(*total, F.sum(F.col("n_rows") * times).alias("n_rows"))
    return g.select(*by, F.array(*(F.pmod(f"_l{k}", F.lit(LANE_MODULUS)) for k in range(LANES))).alias("lanes"), "n_rows")


def lanes_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprint(df: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """fingerprint and n_rows of the table's content, whatever its order and partitions."""
    return content_lanes(df, exclude).select(lanes_text(F.col("lanes")).alias("fingerprint"), "n_rows")


def fingerprint_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per table name: both fingerprints and whether they are equal; a missing side is a difference."""
    j = a.select("table", F.col("fingerprint").alias("before")).join(b.select("table", F.col("fingerprint").alias("after")), "table", "full_outer")
    return j.withColumn("same", F.col("before").eqNullSafe(F.col("after")))


def surrogate_id(df: DataFrame, order: list[str], name: str = "id", rows: int = RANGE_ROWS) -> DataFrame:
    """1, 2, 3 ... in the order of ``order`` (any ordered types; nulls come first), without a global window.

    Spark sorts the rows into ranges, as many as keep a range at about ``rows`` rows, and they are written with their
    place in the range; each range then gets the number of rows before it, from counts added in two levels. Rows that tie
    in all order columns are numbered by a hash of all columns, so equal numbers of the same rows come out whatever the
    partitions; rows that are equal in all columns are dealt among ranges by their place in the input, so no range grows
    with a repeated row."""
    n = df.count()
    all_columns = F.xxhash64(*(F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F
        .col(c) for c in df.columns))
    tied = df.withColumn("_tie", all_columns).withColumn("_same", F.xxhash64(F.monotonically_increasing_id()))
    by = [*(F.asc_nulls_first(c) for c in order), "_tie", "_same"]
    placed = tied.repartitionByRange(max(1, -(-n // rows)), *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id()
    placed = kept(placed.select(*df.columns, F.shiftright(at, 33).cast("int").alias("_range"), at.bitwiseAND((1 << 33) - 1).alias("_k")), "ids")
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_block", F.shiftright("_range", 10))
    blocks = sizes.groupBy("_block").agg(F.sum("_n").alias("_b"))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("_block", earlier("_b", Window.orderBy("_block")).alias("_before_block"))  # a row for 1,024 ranges
    offsets = sizes.withColumn("_before", earlier("_n", Window.partitionBy("_block").orderBy("_range"))).join(blocks, "_block")
    offsets = offsets.select("_range", (F.col("_before") + F.col("_before_block")).alias("_before"))
    out = placed.join(bounded(offsets), "_range")
    return out.select(*df.columns, (F.col("_k") + F.col("_before") + 1).cast("bigint").alias(name))


def explain_value(prov: DataFrame, entity: str) -> DataFrame:
    """The provenance of an entity and of its child keys (id|child)."""
    return prov.where(F.split_part(F.col("entity").cast("string"), F.lit("|"), F.lit(1)) == entity)


def resolve_citations(ids: DataFrame, key: str, records: DataFrame, treatments: DataFrame | None = None, provenance: DataFrame | None = None,
                      fields: list[str] = (), files: DataFrame | None = None, file_key: str = "source_file_id", issues: DataFrame | None = None,
                      inventory: DataFrame | None = None) -> dict[str, DataFrame]:
    """What stands behind cited ids (``ids``: one column ``key``; blanks and repeats don't count).

    records: the rows of the ids that exist, with their treatments (key, treatment) as one text. not_found: the other ids.
    provenance: rows (entity, field, value, rule, source, location, raw ...) of those records or their child keys
    (id|child), of ``fields`` only if given.
    files: the files that the records name in ``file_key``. issues: of the cited ``inventory`` ids (inventory_id) the
    number of records, and the first record with its impact, resolution and message.
    """
    cited = ids.select(key).where(F.trim(F.col(key).cast("string")) != "").distinct()
    found = records.join(cited, key, "left_semi")
    out = {"not_found": cited.join(records.select(key), key, "left_anti"), "records": found}
    if treatments is not None:
        spelled = treatments.join(cited, key, "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("treatment")), ", ")
            .alias("treatment"))
        out["records"] = found.join(spelled, key, "left")
    if provenance is not None:
        own = provenance.withColumn("_k", F.split_part(F.col("entity").cast("string"), F.lit("|"), F.lit(1)))
        own = own.where(F.col("field").isin(list(fields))) if fields else own
        out["provenance"] = own.join(cited.select(F.col(key).cast("string").alias("_k")), "_k", "left_semi").drop("_k")
    if files is not None:
        out["files"] = files.join(found.select(file_key).distinct(), file_key, "left_semi")
    if issues is not None and inventory is not None:
        told = issues.join(inventory.select(F.upper(F.trim("inventory_id")).alias("inventory_id")).distinct(), "inventory_id", "left_semi")
        first = F.min(F.struct("record_id", *(c for c in ("impact", "resolution", "message") if c in told.columns))).alias("f")
        out["issues"] = told.groupBy("inventory_id").agg(F.count(F.lit(1)).alias("n_records"), first).select("inventory_id", "n_records", "f.*")
    return out
