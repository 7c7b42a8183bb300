"""Sources and sinks: sectioned text, bundles, multi-header tables, manifests, reports and run records.

Text is read as lines by Spark's reader, whatever the size of a file and wherever it is kept; a plain file is split among
tasks, a gz file is streamed by one. The members of a bundle are listed first and decoded apart, each from its own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.operators.identity import bounded
from concord.shared import kept
from concord.sources.bundles import BundleMembers, decoded, range_taken_up, ranges_hashed

MAX_FILE = 1 << 30
BEGIN, END = "_table_begin", "_table_end"
#: One cell behind a separator: quoted, with doubled quotes inside, or plain.
CELL = r'{0}("[^"]*+(?:""[^"]*+)*+"(?={0}|$)|[^{0}]*+)'
HEADER_LINES = 32  # lines that one record of a header may have


def contents(spark: SparkSession, glob: str, limit: int = MAX_FILE) -> DataFrame:
    """path, content of files (a file is one cell); one of more than ``limit`` bytes is an error, its content isn't read."""
    files = spark.read.format("binaryFile").load(glob)
    large = files.where(F.col("length") > limit).select("path", F.raise_error(F.concat(F.lit(f"more than {limit} bytes: "), "path"))
        .cast("binary").alias("content"))
    return files.where(F.col("length") <= limit).select("path", "content").unionByName(large)


def numbered_lines(spark: SparkSession, glob: str) -> DataFrame:
    """path, line (1, 2, ... in each file), value (without its line end) of text files of any size.

    Spark reads blocks of a file in different tasks; a line's number is its number in the block plus the lines of the
    file's earlier blocks, which are counted first (a row for each block)."""
    text = spark.read.option("lineSep", "\n").text(glob)
    at = {"path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_id": F.monotonically_increasing_id()}
    lines = text.select("value", *(c.alias(n) for n, c in at.items()))
    blocks = lines.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("path").alias("_p"), F.col("_block").alias("_b"), (before - F.col("_first")).alias("_shift"))
    joined = lines.join(bounded(blocks), (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b")))
    return joined.select("path", (F.col("_id") + F.col("_shift") + 1).alias("line"), F.regexp_replace("value", r"\r$", "").alias("value"))


def cells(line: Column, sep: str = "\t") -> Column:
    """The cells of a separated line; quotes around a cell are taken off."""
    each = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(CELL.replace("{0}", sep)), F.lit(1))
    quoted = lambda x: x.startswith('"') & x.endswith('"') & (F.length(x) > 1)
    return F.transform(each, lambda x: F.when(quoted(x), F.replace(F.substr(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_sectioned(spark: SparkSession, glob: str) -> DataFrame:
    """Sectioned text files -> path, section ('series', 'sample', 'header', 'table'), line, field, column, value.

    Lines that begin with '!' are fields of the series or of samples, or mark where a table begins and ends; blank lines
    count for nothing. The first other line in a table is its header. Which lines stand in a table is a matter of line
    numbers, so it takes a small join with the marks and not one task for a file."""
    lines = numbered_lines(spark, glob).where(F.trim("value") != "")
    bang = F.col("value").startswith("!")
    name = F.substr(F.element_at(cells(F.col("value")), 1), F.lit(2))
    marks = lines.where(bang & F.col("value").rlike(rf'^"?![^\t]*({BEGIN}|{END})"?(\t|$)')).select("path", "line",
        name.endswith(BEGIN).alias("begins"))
    marks = marks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "begins"))).alias("marks")).select(F.col("path")
        .alias("_p"), "marks")  # some a file
    last = F.element_at(F.filter("marks", lambda m: m["line"] < F.col("line")), -1)
    plain = lines.where(~bang).join(bounded(marks), F.col("path") == F.col("_p")).withColumn("_m",
        F.when(F.size(F.filter("marks", lambda m: m["line"] < F.col("line"))) > 0, last)).where("_m.begins")
    plain = plain.select("path", "line", "value", F.col("_m.line").alias("_table"))
    heads = plain.groupBy("path", "_table").agg(F.min("line").alias("_head"))
    table = plain.join(bounded(heads.select(F.col("path").alias("_p"), F.col("_table").alias("_t"), "_head")),
        (F.col("path") == F.col("_p")) & (F.col("_table") == F.col("_t")))
    table = table.select("path", F.when(F.col("line") == F.col("_head"), "header").otherwise("table").alias("section"), "line",
        cells(F.col("value")).alias("c"))
    table = table.select("path", "section", "line", F.element_at("c", 1).alias("field"), F.slice("c", 2, 1 << 30).alias("c"))
    told = lines.where(bang).select("path", "line", name.alias("_name"),
        F.slice(cells(F.col("value")), 2, 1 << 30).alias("c")).where(~F.col("_name").endswith(BEGIN) & ~F.col("_name").endswith(END))
    kind = F.when(F.col("_name").startswith("Sample_"), "sample").otherwise("series")
    told = told.select("path", kind.alias("section"), "line", F.when(F.locate("_", "_name") > 0,
        F.substr("_name", F.locate("_", F.col("_name")) + 1)).otherwise("").alias("field"), "c")
    return told.unionByName(table).select("path", "section", "line", "field", F.posexplode("c").alias("column", "value"))


def bind_samples(rows: DataFrame, id_field: str = "geo_accession") -> tuple[DataFrame, DataFrame]:
    """Rows of sectioned text bound to their samples: path, section, line, field, sample_id, value of sample lines and table
    cells. A sample line binds by the id line's columns, a table cell by the header's ids, never by one for the other.

    Second, the files whose table doesn't have exactly the samples of the id line (path, n_listed, n_columns)."""
    listed = rows.where((F.col("section") == "sample") & (F.col("field") == id_field)).select("path", F.lit("sample").alias("section"),
        "column", F.col("value").alias("sample_id"))
    header = rows.where("section = 'header'").select("path", F.lit("table").alias("section"), "column", F.col("value").alias("sample_id"))
    ids = listed.unionByName(header)
    bound = rows.join(ids, ["path", "section", "column"]).select("path", "section", "line", "field", "sample_id", "value")
    each = ids.groupBy("path", "sample_id").agg(F.count_if(F.col("section") == "sample").alias("a"),
        F.count_if(F.col("section") == "table").alias("b"))
    files = each.groupBy("path").agg(F.sum("a").alias("n_listed"), F.sum("b").alias("n_columns"),
        F.bool_and((F.col("a") == 1) & (F.col("b") == 1)).alias("_fits"))
    return bound, files.where("n_columns > 0 and not _fits").drop("_fits")


def number_repeated(df: DataFrame, keys: list[str], name: str, order: list[str], style: str = "suffix") -> DataFrame:
    """Repeated names get '#1', '#2' ... from the second occurrence on ('suffix'), or every one its ordinal n ('ordinal')."""
    n = F.row_number().over(Window.partitionBy(*keys, name).orderBy(*order))
    if style == "ordinal":
        return df.withColumn("n", n)
    return df.withColumn("_n", n).withColumn(name, F.when(F.col("_n") == 1, F.col(name))
        .otherwise(F.concat(name, F.lit("#"), (F.col("_n") - 1).cast("string")))).drop("_n")


def read_bundle(spark: SparkSession, path: str, keep: DataFrame) -> dict[str, DataFrame]:
    """Tar files (a file, a folder or a pattern) of per-sample tables, of any size; see bundles.

    rows: path, member, sample_id, row (from 1), row_key, field, value of the members whose sample_id (the name up to '_'
    or '.') is in ``keep`` (sample_id). skipped: other members; they are listed and never decoded. missing: kept samples
    without a member. empty: members without rows. odd: members whose columns, or row keys in their order, differ from the
    most common ones of their bundle (path, member, what)."""
    spark.dataSource.register(BundleMembers)
    members = spark.read.format("bundle_members").load(path).withColumn("sample_id", F.regexp_extract("member", r"([^/_.]+)[^/]*$", 1))
    wanted = bounded(keep.select("sample_id").distinct())
    kept = members.join(wanted, "sample_id", "left_semi")
    own = ["path", "member", "sample_id"]
    rows = kept.repartition("path", "member").mapInArrow(decoded,
        "path string, member string, sample_id string, row long, row_key string, field string, value string")
    order = F.sum(F.xxhash64("row", "row_key").cast("decimal(38,0)"))
    each = rows.groupBy("path", "member", "row").agg(F.first("row_key").alias("row_key"), F.array_sort(F.collect_list("field")).alias("fields"))
    keys = each.groupBy("path", "member").agg(F.count(F.lit(1)).alias("n"), order.alias("h"), F.sort_array(F.collect_set("fields")).alias("columns"))
    usual = keys.groupBy("path", "n", "h").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F
        .max_by(F.struct("n", "h"), F.struct("c", "n", "h")).alias("u"))
    heads = keys.groupBy("path", "columns").agg(F.count(F.lit(1)).alias("c")).groupBy("path").agg(F
        .max_by("columns", F.struct("c", "columns")).alias("uc"))
    unlike = F.array_compact(F.array(F.when((F.col("n") != F.col("u.n")) | (F.col("h") != F.col("u.h")), "row keys"),
        F.when(F.col("columns") != F.col("uc"), "columns")))
    odd = keys.join(usual, "path").join(heads, "path").select("path", "member", F.explode(unlike).alias("what"))
    return {"rows": rows, "skipped": members.join(wanted, "sample_id", "left_anti").select("path", "member"),
        "missing": keep.select("sample_id").distinct().join(members, "sample_id", "left_anti"),
            "empty": kept.select(*own).join(rows.select("path", "member").distinct(), ["path", "member"], "left_anti"), "odd": odd}


def _header(lines: Column, n: int) -> Column:
    """struct<records, open, last>: the first ``n`` records of a file's first lines (line, value) and the line where they
    end. A record goes on over line breaks until its quotes are closed."""
    def step(a: Column, x: Column) -> Column:
        text = F.when(a["open"].isNull(), x["value"]).otherwise(F.concat(a["open"], F.lit("\n"), x["value"]))
        odd = F.pmod(F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit(""))), F.lit(2)) == 1
        more = F.struct(a["records"].alias("records"), text.alias("open"), x["line"].alias("last"))
        whole = F.struct(F.concat(a["records"], F.array(text)).alias("records"), F.lit(None).cast("string").alias("open"), x["line"].alias("last"))
        return F.when(F.size(a["records"]) >= n, a).when(odd, more).otherwise(whole)

    start = F.struct(F.array().cast("array<string>").alias("records"), F.lit(None).cast("string").alias("open"), F.lit(0).cast("long").alias("last"))
    return F.aggregate(lines, start, step)


def read_multi_header(spark: SparkSession, glob: str, n_labels: int, n_annotation: int, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """Tables with ``n_labels`` label rows above a header row, each file with its own: labels (path, sample_id, label,
    value) and the long body (path, line, the annotation columns as the first file names them, sample_id, value).

    A file is split among tasks by lines: its header records (which may hold quoted line breaks) are put together from its
    first lines, and a body line meets the header of its file by the path and binds its values to samples by the header's
    ids. Body rows are what stands below the header, also where they repeat it; they are one line each. Sample ids that
    repeat in a header, and a header that isn't there, are refused."""
    lines = numbered_lines(spark, glob)
    top = lines.where(F.col("line") <= (n_labels + 1) * HEADER_LINES).groupBy("path").agg(F
        .array_sort(F.collect_list(F.struct("line", "value"))).alias("top"))
    heads = top.select("path", _header(F.col("top"), n_labels + 1).alias("h")).select("path", F.col("h.last").alias("_last"),
        F.transform("h.records", lambda x: cells(x, sep)).alias("_rows"))
    heads = kept(heads.withColumn("_ids", F.slice(F.element_at("_rows", n_labels + 1), n_annotation + 1, 1 << 30)), "heads")
    if not heads.where((F.size("_rows") <= n_labels) | (F.size(F.array_distinct("_ids")) < F.size("_ids"))).isEmpty():
        raise ValueError("sample ids repeat in a header, or a header is missing")
    first = heads.orderBy("path").select(F.slice(F.element_at("_rows", n_labels + 1), 1, n_annotation)).first()
    names = first[0] if first else []
    told = F.array(*(F.struct(F.lit(f"label_{i + 1}").alias("label"),
        F.slice(F.get("_rows", F.lit(i)), n_annotation + 1, 1 << 30)
            .alias("values")) for i in range(n_labels))) if n_labels else F.array().cast("array<struct<label:string,values:array<string>>>")
    labels = heads.select("path", "_ids", F.explode(told).alias("x")).select("path", "x.label",
        F.explode(F.arrays_zip(F.col("_ids").alias("sample_id"), F.col("x.values").alias("value"))).alias("y"))
    labels = labels.select("path", "y.sample_id", "label", "y.value").where("sample_id is not null")
    side = bounded(heads.select(F.col("path").alias("_p"), "_last", "_ids"))
    body = lines.join(side, (F.col("path") == F.col("_p")) & (F.col("line") > F.col("_last"))).where(F.trim("value") != "").select("path",
        "line", "_ids", cells(F.col("value"), sep).alias("_c"))
    values = F.arrays_zip(F.col("_ids").alias("sample_id"), F.slice("_c", n_annotation + 1, 1 << 30).alias("value"))
    long = body.select("path", "line", *(F.get("_c", F.lit(k)).alias(c) for k, c in enumerate(names)), F.explode(values).alias("v"))
    return labels, long.select("path", "line", *names, "v.sample_id",
        F.col("v.value").try_cast("double").alias("value")).where("sample_id is not null")


def unpivot_matrix(df: DataFrame, ids: list[str], values: list[str], keep_nulls: bool = False) -> DataFrame:
    """Wide matrix -> long (ids, column, value as double)."""
    out = df.select(*ids, *(F.col(v).cast("double").alias(v) for v in values)).unpivot(ids, values, "column", "value")
    return out if keep_nulls else out.where("value is not null")


CHUNK = 64 << 20


def listed(spark: SparkSession, glob: str) -> DataFrame:
    """path, length of every file that the pattern names. Spark's readers leave out empty files, so these come from the
    listing (the driver sees names and lengths, as with any read)."""
    files = spark.read.format("binaryFile").load(glob).select("path", "length")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    empty = [(f.getPath().toString(), 0) for f in found if f.isFile() and not f.getLen() and f.getPath().getName()[:1] not in "_."]
    return files.unionByName(spark.createDataFrame(empty, "path string, length long"))


def chunk_digests(spark: SparkSession, glob: str, chunk: int = CHUNK) -> DataFrame:
    """path, chunk (from 0), size_bytes, sha256 of consecutive parts of ``chunk`` bytes of every file, an empty file having
    one part. Each part is read by a task of its own, so one large file is hashed by many."""
    files = listed(spark, glob)
    last = F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0)).cast("long")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    parts = parts.select("path", "chunk", (F.col("chunk") * chunk).alias("offset"),
        F.least(F.lit(chunk), F.col("length") - F.col("chunk") * chunk).alias("size_bytes"))
    return parts.repartition("path", "chunk").mapInArrow(ranges_hashed, "path string, chunk long, size_bytes long, sha256 string")


def tree_digests(chunks: DataFrame) -> DataFrame:
    """path, size_bytes, n_chunks, tree_sha256: the digest of each file's chunk digests in order (64 bytes a chunk)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: x["sha256"])
    g = chunks.groupBy("path").agg(F.sum("size_bytes").alias("size_bytes"), F.count(F.lit(1)).alias("n_chunks"),
        F.array_join(ordered, "").alias("_all"))
    return g.select("path", "size_bytes", "n_chunks", F.sha2("_all", 256).alias("tree_sha256"))


RANGE, ROUNDS = 256 << 20, 16  # bytes of a file that one task hashes; ranges between two tables of digests


def file_digests(files: DataFrame, size: int = RANGE) -> DataFrame:
    """path, size_bytes, sha256 of files (path, length). SHA-256 goes through a file in order, so a task hashes ``size``
    bytes of a file and hands the digest's state (112 bytes) to the task of its next range, one stage a range."""
    most = files.agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("n")).first()
    got = files.select("path", F.col("length").alias("size_bytes"), F.lit(None).cast("binary").alias("state"), F.lit(None).cast("string").alias("sha256"))
    for k in range(max(1, -(-(most["length"] or 0) // size))):
        if k and k % ROUNDS == 0:
            got = kept(got, "digests")
        got = got.repartition(max(1, 2 * most["n"]), "path").mapInArrow(range_taken_up(k, size), got.schema)
    return got.drop("state")


def source_manifest(spark: SparkSession, glob: str, limit: int = RANGE, size: int = RANGE) -> DataFrame:
    """path, kind, sha256, size_bytes of each file. Files up to ``limit`` bytes are hashed as cells by Spark's reader, larger
    ones in ranges of ``size`` bytes, each by a task of its own, that follow each other (see chunk_digests for a digest whose
    parts are hashed at once). The driver reads nothing."""
    files = spark.read.format("binaryFile").load(glob)
    small = files.where(F.col("length") <= limit).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
    large = file_digests(listed(spark, glob).where((F.col("length") > limit) | (F.col("length") == 0)), size)
    return small.unionByName(large).withColumn("kind", F.regexp_extract("path", r"\.([^./]+)$", 1))


def chunk_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, chunk, change of the parts of files that differ (see chunk_digests, of the same chunk size)."""
    a, b = (m.select("path", "chunk", F.col("sha256").alias(n)) for m, n in ((before, "a"), (after, "b")))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, ["path", "chunk"], "full_outer").select("path", "chunk", change.alias("change")).where("change is not null")


def manifest_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change ('added', 'removed', 'changed') of files that differ; 'unknown' where sizes are equal or missing and a digest is missing."""
    a, b = (m.select("path", F.col("sha256").alias(n), F.col("size_bytes").alias(f"size_{n}"), F.lit(1).alias(f"in_{n}")) for m,
        n in ((before, "a"), (after, "b")))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(),
        "removed").when((F.col("a") != F.col("b")) | (F.col("size_a") != F.col("size_b")),
            "changed").when(F.col("a").isNull() | F.col("b").isNull(), "unknown")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def read_reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, nullValue="", enforceSchema=False, mode="FAILFAST")


def to_json_report(df: DataFrame) -> DataFrame:
    """One JSON object for each row; write it with ``.write.text``."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def land_summary(values: DataFrame, features: DataFrame, expected: DataFrame) -> DataFrame:
    """Per study: samples, features, values, blanks (counted before nulls go), values whose feature is unknown, and
    whether the sample count is as expected (study_id, n_expected)."""
    known = features.select("study_id", "feature_id").distinct().withColumn("_known", F.lit(True))
    g = values.join(known, ["study_id", "feature_id"], "left").groupBy("study_id").agg(
        F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("feature_id").alias("n_features"), F.count(F.lit(1)).alias("n_values"),
        F.count_if(F.col("raw_value").isNull()).alias("n_blank"), F.count_if(F.col("_known").isNull()).alias("n_unknown_feature"),
    )
    return g.join(expected, "study_id", "left").withColumn("as_expected", F.col("n_samples").eqNullSafe(F.col("n_expected")))


RUN_RECORD = "model string, condition string, run int, question string, answer string, seconds double, cost double, correct boolean, usage struct<input: bigint, output: bigint>, steps array<struct<name: string, ok: boolean>>, grade_parts array<struct<field: string, ok: boolean, got: string>>"


def read_run_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved answer records with their number of steps and tool failures; the schema is fixed, nothing is inferred."""
    r = spark.read.schema(RUN_RECORD).option("multiLine", multi_line).json(path)
    return r.withColumn("n_steps", F.size("steps")).withColumn("n_failed", F.size(F.filter("steps", lambda s: ~s["ok"])))

