"""Queries F (quality checks) and G (profiling)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators import checks as C
from concord.operators import profile as P
from concord.plans.base import FX_FEATURE_MAP, FX_MEASUREMENT, FX_SAMPLE, FX_TREATMENT, fx_feature_map, fx_measurement, fx_sample, fx_treatment, query, r4, t
from concord.plans.q_cohort import REGIONS
from concord.plans.q_rules_constraints import PROGRAM
from concord.plans.q_values_identity import rows
from concord.shared import dealt, partitions

NAMES = "bolt|ring|anvil|widget|gear|nut"


def dose(spark, d):
    """Two doses of a part in one text over several lines, with the part's name far behind the second; names hold for
    one study each: even parts know no rings, odd ones no bolts."""
    far = F.lit(" and, much later in the same protocol, another dose of ")
    p = t(spark, d, "part").select("p_partkey", "p_name", "p_size", (F.col("p_partkey") % 2).alias("study"))
    size, more = F.col("p_size").cast("string"), (F.col("p_size") + 5).cast("string")
    text = F.concat(size, F.lit(" uM\n of "), "p_name", far, F.lit("\n"), more, F.lit("uM "), F.upper("p_name"), F.lit("; "), more,
        F.lit(" mM, as usual, of nothing but water and salts "), "p_name")
    names = [(s, n) for s in (0, 1) for n in NAMES.split("|") if n != ("ring", "bolt")[s]]
    return C.dose_above_limit(p.withColumn("text", text), ["p_partkey"], "text", 40000, rows(spark, names, "study long, name string"), "study")


@query("F01_dose_above_limit", f"""SELECT p_partkey, CAST(n AS DOUBLE) AS amount, 'uM' AS unit, n * 1000.0::DOUBLE AS value,
    regexp_extract(p_name, '\\b({NAMES})\\b', 1) AS name
 FROM (SELECT p_partkey, p_name, unnest([p_size, p_size + 5]) AS n FROM part) WHERE n > 40 AND regexp_matches(p_name, '\\b({NAMES})\\b')
 AND regexp_extract(p_name, '\\b({NAMES})\\b', 1) <> CASE p_partkey % 2 WHEN 0 THEN 'ring' ELSE 'bolt' END""")
def _(spark, d):
    return dose(spark, d)


@query("F01b_stored_dose", f"WITH {FX_TREATMENT} SELECT sample_id, compound_id, round(dose, 4) AS dose FROM fx_treatment WHERE dose > 45")
def _(spark, d):
    return C.stored_above_limit(fx_treatment(spark, d), ["sample_id", "compound_id"], "dose", 45).withColumn("dose", r4("dose"))


@query("F02_fields_contradict", f"""WITH {FX_SAMPLE}, v AS (SELECT study_id, o_orderkey AS k, [o_orderstatus] AS a,
  coalesce((SELECT list_sort(list_distinct(list(l_linestatus))) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS b,
  coalesce((SELECT list_sort(list_distinct(list(CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END))) FROM lineitem
    WHERE l_orderkey = o_orderkey), []) AS c
  FROM orders JOIN fx_sample ON o_orderkey = sample_id)
SELECT study_id, k, CAST(3 AS INTEGER) AS n_views, CAST(len(list_distinct([a, b, c])) AS INTEGER) AS n_sets,
 concat_ws(',', CASE WHEN b <> c AND b <> a THEN 'flags' END, CASE WHEN c <> a AND c <> b THEN 'lines' END, CASE WHEN a <> b
    AND a <> c THEN 'order' END) AS odd_ones
FROM (SELECT study_id, k, a, c AS b, b AS c FROM v) WHERE NOT (a = b AND b = c)""")
def _(spark, d):
    study = fx_sample(spark, d).select(F.col("sample_id").alias("k"), "study_id")
    flag = F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    parts = {"orders": ("o_orderkey", {"order": F.col("o_orderstatus"), "shop": F.lit("same")}),
        "lineitem": ("l_orderkey", {"lines": F.col("l_linestatus"), "flags": flag})}
    each = [t(spark, d, table).select(F.col(k).alias("k"), F.explode(F.array(*(F.struct(F.lit(name).alias("field"), v.alias("value"))
        for name, v in fields.items()))).alias("x")).select("k", "x.*") for table, (k, fields) in parts.items()]
    views = dealt(reduce(DataFrame.unionByName, each), partitions(t(spark, d, "lineitem")), "k")
    return C.fields_contradict(views.join(study, "k"), "study_id", "k", "field", "value")


@query("F03_duplicate_titles", """SELECT lang, md5(text) AS core, CAST(count(*) AS BIGINT) AS n, count(DISTINCT source) AS n_batches,
    min(doc_id) AS first_record,
 CASE WHEN count(DISTINCT source) > 1 THEN 'across batches' ELSE 'within batch' END AS kind FROM documents GROUP BY lang, text
    HAVING count(*) > 1""")
def _(spark, d):
    title = F.concat(F.md5(F.encode("text", "utf-8")), F.lit("  [run "), F.col("doc_id").cast("string"), F.lit("] "))
    return C.duplicate_titles(t(spark, d, "documents").withColumn("title", title), "lang", "doc_id", "title", "source", r"\s*\[run \d+\]\s*$")


@query("F03b_records_of_titles", """WITH d AS (SELECT *, count(*) OVER w AS n, row_number() OVER (w
    ORDER BY doc_id) AS k, count(DISTINCT source) OVER w AS b FROM documents WINDOW w AS (PARTITION BY lang, text)),
 f AS (SELECT lang, text, list(doc_id ORDER BY doc_id) AS ids FROM d WHERE k <= 4 GROUP BY ALL)
 SELECT lang, doc_id, CASE WHEN b > 1 THEN 'across batches' ELSE 'within batch' END AS kind, CAST(n - 1 AS BIGINT) AS n_others,
 array_to_string(CASE WHEN k <= 4 THEN list_filter(ids, lambda x: x <> doc_id) ELSE ids[1:3] END, ',') AS others FROM d
    JOIN f USING (lang, text) WHERE n > 1""")
def _(spark, d):
    title = F.concat(F.md5(F.encode("text", "utf-8")), F.lit(" [run "), F.col("doc_id").cast("string"), F.lit("]"))
    got = C.duplicate_title_records(t(spark, d, "documents").withColumn("title", title), "lang", "doc_id", "title", "source", r"\s*\[run \d+\]$", 3)
    return got.select("lang", "doc_id", "kind", "n_others", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("F04_no_control_in_batch", f"""WITH {FX_SAMPLE} SELECT sample_id, study_id, batch, line FROM fx_sample s
    WHERE role = 'treated' AND NOT EXISTS (SELECT 1 FROM fx_sample c WHERE c.role = 'vehicle_control' AND c.study_id IS NOT DISTINCT
    FROM s.study_id AND c.batch IS NOT DISTINCT FROM s.batch AND (c.line = s.line OR (s.line = 'FURNITURE' AND c.line = 'MACHINERY')))""")
def _(spark, d):
    s = fx_sample(spark, d).withColumn("parent", F.when(F.col("line") == "FURNITURE", "MACHINERY"))
    return C.no_control_in_batch(s, ["study_id", "batch"], F.col("role") == "treated", F.col("role") == "vehicle_control", "line",
        "parent").select("sample_id", "study_id", "batch", "line")


METRICS = [("l_quantity", "raw counts"), ("l_extendedprice", "log2 signal"), ("l_discount", "read counts"), ("l_tax", "log2 signal")]


@query("F05_value_scale_mismatch", """SELECT m AS \"column\", min(v) AS least, max(v) AS most, CAST(count(*) FILTER (WHERE v <> round(v)) AS
    BIGINT) AS n_fraction, CASE WHEN m = 'l_discount' THEN 'not counts' ELSE 'not log2' END AS problem
    FROM (SELECT unnest(['l_extendedprice', 'l_discount']) AS m, unnest([l_extendedprice, l_discount]) AS v FROM lineitem) GROUP BY m""")
def _(spark, d):
    v = t(spark, d, "lineitem").unpivot(["l_orderkey"], [m for m, _ in METRICS], "column", "value")
    return C.value_scale_mismatch(v, "column", "value", rows(spark, METRICS, "column string, note string"), "note")


@query("F06_date_like_name", """SELECT feature_id, name, p_name AS recovered
    FROM (SELECT o_orderkey AS feature_id, CAST(day(o_orderdate) AS VARCHAR) || '-' || strftime(o_orderdate, '%b') AS name
 FROM orders UNION ALL SELECT p_partkey, p_name FROM part) LEFT JOIN part ON feature_id = p_partkey
    WHERE regexp_matches(name, '^\\d{1,2}-[A-Z]')""")
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("feature_id"), F.col("p_name").alias("name"))
    n = t(spark, d, "orders").select(F.col("o_orderkey").alias("feature_id"), F.date_format("o_orderdate", "d-MMM").alias("name")).unionByName(p)
    return C.recovered_names(n, ["feature_id"], "name", p, "name")


@query("F07_duplicate_record_id", """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_arrivals, count(DISTINCT l_suppkey) AS n_sources
    FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def _(spark, d):
    return C.duplicate_record_id(t(spark, d, "lineitem"), "l_orderkey", "l_suppkey")


@query("F08_nested_series", "SELECT DISTINCT page_id, trim(split_part(url, ':', -1)) AS part_of FROM pages WHERE url LIKE 'https%'")
def _(spark, d):
    return C.nested_series(t(spark, d, "pages"), "page_id", "url", "https")


@query("F09_out_of_scope", """SELECT regexp_extract(url, '//([^/]+)', 1) AS host, CAST(count(*) AS BIGINT) AS n_foreign FROM pages
    WHERE url NOT LIKE '%/en/%' GROUP BY 1""")
def _(spark, d):
    p = t(spark, d, "pages").withColumn("host", F.regexp_extract("url", "//([^/]+)", 1))
    return C.out_of_scope(p, "host", ~F.col("url").like("%/en/%"))


@query("F10_required_blank", """SELECT doc_id, unnest(['quality', 'toxic']) AS \"column\" FROM documents LEFT JOIN labels USING (doc_id)
    WHERE quality IS NULL""")
def _(spark, d):
    return C.required_blank(t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left"), "doc_id",
        ["quality", "toxic", "source"])


@query("F11_unknown_values", f"""WITH {FX_TREATMENT} SELECT sample_id, problem, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT sample_id, 'long' AS problem FROM fx_treatment WHERE exposure_h > 6 UNION ALL SELECT sample_id, 'low dose'
    FROM fx_treatment WHERE dose < 10) GROUP BY ALL""")
def _(spark, d):
    u = C.unknown_values(fx_treatment(spark, d), "sample_id", {"long": F.col("exposure_h") > 6, "low dose": F.col("dose") < 10,
        "unstated": F.col("dose").isNull()})
    return u.groupBy("sample_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("F12_basis_flags", f"""WITH {FX_SAMPLE} SELECT study_id, problem, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT study_id, unnest(['batch_inferred', 'replicate_assigned', 'unexplained_label']) AS problem,
 unnest([count(*) FILTER (WHERE prio LIKE '1%'), count(*) FILTER (WHERE regexp_matches(batch, '-0[1-3]$')), count(*) FILTER (WHERE prio LIKE
    '2%' AND sample_id % 10 < 9)]) AS n FROM fx_sample GROUP BY 1) WHERE n > 0 GROUP BY ALL""")
def _(spark, d):
    title = F.concat(F.lit("replicate"), (F.col("sample_id") % 10 + 1).cast("string"), F.when(F.col("prio").like("2%"), " b").otherwise(""))
    return C.basis_flags(fx_sample(spark, d).withColumn("title", title), "study_id", F.col("prio").like("1%"),
        F.col("batch").rlike("-0[1-3]$"), "title", r"replicate\d b$")


@query("F13_entity_rows_by_status", """SELECT p_brand, 'unmapped' AS status, CAST(NULL AS BIGINT) AS p_partkey, CAST(count(*) AS BIGINT) AS
    n FROM part WHERE p_type = 'PROMO' AND p_size <> 7 GROUP BY 1
 UNION ALL SELECT p_brand, 'corrupt_annotation', p_partkey, 1::BIGINT FROM part WHERE p_size = 7""")
def _(spark, d):
    s = F.when(F.col("p_size") == 7, "corrupt_annotation").when(F.col("p_type") == "PROMO", "unmapped").otherwise("mapped")
    return C.entity_rows_by_status(t(spark, d, "part").withColumn("status", s), "p_brand", "p_partkey")


@query("F14_compound_spellings", """SELECT p_brand, p_type, string_agg(DISTINCT p_name, ', ' ORDER BY p_name) AS spellings FROM part
    GROUP BY ALL HAVING count(DISTINCT p_name) > 1""")
def _(spark, d):
    return C.compound_spellings(t(spark, d, "part"), "p_brand", "p_type", "p_name")


@query("F15_column_order", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(r AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS r
    FROM lineitem) WHERE r <> l_linenumber""")
def _(spark, d):
    return C.column_order(t(spark, d, "lineitem"), "l_orderkey", "l_linenumber",
        ["l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "rank")


@query("F16_empty_reference", "SELECT DISTINCT p_partkey, p_name FROM part WHERE p_name IN ('red widget', 'small ring')")
def _(spark, d):
    return C.empty_reference(t(spark, d, "part"), "p_partkey", "p_name", ["Red Widget", "small ring"])


@query("F17_free_text_conflict", """SELECT user_id, count(DISTINCT json_extract_string(props, '$.k')) AS n_values FROM events GROUP BY 1
    HAVING count(DISTINCT json_extract_string(props, '$.k')) > 1""")
def _(spark, d):
    return C.free_text_conflict(t(spark, d, "events"), "user_id", "props", r'"k":\s*(\d+)')


@query("F18_fewer_replicates", f"""WITH {FX_SAMPLE}, s AS (SELECT study_id, yr, line, role, count(*) AS n FROM fx_sample
    GROUP BY ALL), u AS (SELECT study_id, n AS usual FROM (SELECT study_id, n, row_number() OVER (PARTITION BY study_id
    ORDER BY count(*) DESC, n DESC) AS r FROM s GROUP BY study_id, n) WHERE r = 1)
    SELECT study_id, yr, line, role, CAST(n AS BIGINT) AS n, CAST(usual AS BIGINT) AS usual FROM s JOIN u USING (study_id) WHERE n < usual""")
def _(spark, d):
    return C.fewer_replicates(fx_sample(spark, d), "study_id", ["yr", "line", "role"])


@query("F19_design_gap", """WITH u AS (SELECT DISTINCT c_nationkey AS study, c_custkey AS line, l_returnflag AS compound FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) SELECT a.study, a.line, b.compound
    FROM (SELECT DISTINCT study, line FROM u) a JOIN (SELECT DISTINCT study, compound FROM u) b USING (study) WHERE NOT EXISTS (SELECT 1
    FROM u WHERE u.study = a.study AND u.line = a.line AND u.compound = b.compound)""")
def _(spark, d):
    u = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t(spark, d, "customer"),
        F.col("o_custkey") == F.col("c_custkey"))
    return C.design_gap(u.select(F.col("c_nationkey").alias("study"), F.col("c_custkey").alias("line"),
        F.col("l_returnflag").alias("compound")), "study", "line", "compound")


def issues(spark, d):
    inv = rows(spark, [("no_control", "major", "M50")], "check string, impact string, id string")
    s = fx_sample(spark, d).withColumn("parent", F.when(F.col("line") == "FURNITURE", "MACHINERY"))
    lost = C.no_control_in_batch(s, ["study_id", "batch"], F.col("role") == "treated", F.col("role") == "vehicle_control", "line", "parent")
    a = C.as_issues(lost, "no_control", F.col("study_id"), F.col("sample_id"), F.col("batch"), F.lit("a control"), "flagged", inv)
    few = C.fewer_replicates(fx_sample(spark, d), "study_id", ["yr", "line", "role"])
    b = C.as_issues(few, "fewer_replicates", F.col("study_id"), F.lit(None), F.col("n"), F.col("usual"), "fixed", inv)
    return a.unionByName(b)


ISS = f"""WITH {FX_SAMPLE}, z AS (SELECT study_id, yr, line, role, count(*) AS n FROM fx_sample
    GROUP BY ALL), u AS (SELECT study_id, n AS usual FROM (SELECT study_id, n, row_number() OVER (PARTITION BY study_id
    ORDER BY count(*) DESC, n DESC) AS r FROM z GROUP BY study_id, n) WHERE r = 1),
iss AS (SELECT 'no_control' AS "check", study_id, CAST(sample_id AS VARCHAR) AS record_id, batch AS observed, 'a control' AS expected,
    'flagged' AS resolution, 'major' AS impact, 'M50' AS inventory_id FROM fx_sample s WHERE role = 'treated' AND NOT EXISTS (SELECT 1
    FROM fx_sample c WHERE c.role = 'vehicle_control' AND c.study_id = s.study_id AND c.batch = s.batch
    AND (c.line = s.line OR (s.line = 'FURNITURE' AND c.line = 'MACHINERY')))
 UNION ALL SELECT 'fewer_replicates', study_id, NULL, CAST(n AS VARCHAR), CAST(usual AS VARCHAR), 'fixed', 'minor', NULL FROM z
    JOIN u USING (study_id) WHERE n < usual)"""


@query("F00_issue_rows", ISS + " SELECT * FROM iss")
def _(spark, d):
    return issues(spark, d)


@query("F20_issue_summary", ISS + """ SELECT \"check\", resolution, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT study_id, ', '
    ORDER BY study_id) AS studies, coalesce(string_agg(DISTINCT inventory_id, ', '), '') AS inventory FROM iss GROUP BY ALL""")
def _(spark, d):
    return C.issue_summary(issues(spark, d))


@query("F21_coverage", ISS + """, i(id, \"check\") AS (VALUES ('I1', 'no_control'), ('I2', 'fewer_replicates'), ('I3', 'other'), ('I4',
    'none')), f AS (SELECT \"check\", count(*) AS n FROM iss WHERE resolution = 'flagged' GROUP BY 1)
    SELECT id, i.\"check\", CASE WHEN n > 0 THEN 'flagged' WHEN id IN ('I1', 'I2', 'I3') THEN 'fixed'
    ELSE 'not covered' END AS state, CAST(coalesce(n, 0) AS BIGINT) AS n_issues FROM i LEFT JOIN f ON f.\"check\" = i.\"check\"""")
def _(spark, d):
    inv = rows(spark, [("I1", "no_control"), ("I2", "fewer_replicates"), ("I3", "other"), ("I4", "none")], "id string, check string")
    return C.coverage(inv, issues(spark, d), C.program_tags(spark, {"orders": PROGRAM}), rows(spark, [("I3",)], "id string"))


@query("F22_load_summary", f"""WITH {FX_FEATURE_MAP}, {FX_TREATMENT}
    SELECT s.study_id, CAST(count(*) AS BIGINT) AS n_samples, CAST((SELECT count(*) FROM fx_treatment JOIN fx_sample x USING (sample_id)
    WHERE x.study_id = s.study_id) AS BIGINT) AS n_treatments, CAST((SELECT count(*) FROM fx_measurement m
    WHERE m.study_id = s.study_id) AS BIGINT) AS n_values, (SELECT count(DISTINCT entity) FROM fx_feature_map f
    WHERE f.study_id = s.study_id) AS n_entities, CAST((SELECT count(*) FROM fx_feature_map f
    WHERE f.study_id = s.study_id) AS BIGINT) AS n_features, CAST((SELECT count(entity) FROM fx_feature_map f
    WHERE f.study_id = s.study_id) AS BIGINT) AS n_mapped FROM fx_sample s GROUP BY s.study_id""")
def _(spark, d):
    return C.load_summary(fx_sample(spark, d), fx_treatment(spark, d), fx_measurement(spark, d), fx_feature_map(spark, d))


@query("F22b_issues_by_study", ISS + """ SELECT study_id, CAST(count(*) FILTER (WHERE impact = 'major') AS BIGINT) AS major, CAST(count(*)
    FILTER (WHERE impact = 'minor') AS BIGINT) AS minor, CAST(count(*) FILTER (WHERE resolution = 'flagged') AS BIGINT) AS flagged,
    CAST(count(*) FILTER (WHERE resolution = 'fixed') AS BIGINT) AS fixed FROM iss GROUP BY 1""")
def _(spark, d):
    return C.issues_by_study(issues(spark, d))


@query("F23_issues_for_record", ISS + """, one AS (SELECT min(CAST(record_id AS BIGINT)) AS r FROM iss WHERE study_id = 'ASIA') SELECT iss.*
    FROM iss, one WHERE record_id = CAST(r AS VARCHAR) OR (record_id IS NULL AND study_id = 'ASIA')""")
def _(spark, d):
    i = issues(spark, d)
    first = i.where("study_id = 'ASIA'").agg(F.min(F.col("record_id").cast("bigint")).alias("r")).first()["r"]
    return C.issues_for_record(i, str(first), "ASIA")


@query("G01_distinct_counts", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def _(spark, d):
    return P.distinct_counts(t(spark, d, "events"), "event_type")


@query("G02_crosstab", """SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS \"F\", CAST(count(*) FILTER
    (WHERE l_linestatus = 'O') AS BIGINT) AS \"O\", 0::BIGINT AS \"X\" FROM lineitem GROUP BY 1""")
def _(spark, d):
    return P.crosstab(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O", "X"])


@query("G03_disagreement", """SELECT l_orderkey, l_partkey, o_orderstatus, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE (CASE o_orderstatus WHEN 'P' THEN 'O' ELSE o_orderstatus END) IS DISTINCT FROM l_linestatus""")
def _(spark, d):
    j = t(spark, d, "lineitem").join(t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey",
        "o_orderstatus", "l_linestatus")
    return P.disagreement(j, "o_orderstatus", "l_linestatus", {"P": "O"})


@query("G04_sample_correlation", """WITH m AS (SELECT s_nationkey AS nation, l_suppkey AS supp, p_type, avg(l_extendedprice) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING avg(l_extendedprice) > 1000)
    SELECT nation, x.supp AS a, y.supp AS b, round(corr(x.v, y.v), 4) AS r, CAST(count(*) AS BIGINT) AS n_features FROM m x
    JOIN m y USING (nation, p_type) WHERE x.supp < y.supp GROUP BY ALL HAVING count(*) > 2""")
def _(spark, d):
    m = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(t(spark, d, "supplier"),
        F.col("l_suppkey") == F.col("s_suppkey"))
    m = m.groupBy(F.col("s_nationkey").alias("nation"), F.col("l_suppkey").alias("supp"), "p_type").agg(F.avg("l_extendedprice").alias("v"))
    return P.sample_correlation(m, "supp", "p_type", "v", 1000.0, ["nation"]).where("n_features > 2").withColumn("r", r4("r"))


@query("G04b_correlation_of_groups", """WITH m AS (SELECT s_suppkey AS supp, s_acctbal AS bal, p_name, avg(l_extendedprice) AS v
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
    HAVING avg(l_extendedprice) > 1000),
 c AS (SELECT x.supp AS a, y.supp AS b, x.bal AS ba, y.bal AS bb, corr(x.v, y.v) AS r, count(*) AS n FROM m x JOIN m y USING (p_name)
    WHERE x.supp < y.supp GROUP BY ALL), g(id) AS (VALUES ('all'), ('rich')),
 p AS (SELECT least(g.id, h.id) AS group_a, greatest(g.id, h.id) AS group_b, r FROM c, g, g h
    WHERE n > 2 AND isfinite(r) AND (g.id = 'all' OR ba > 5000) AND (h.id = 'all' OR bb > 5000))
 SELECT group_a, group_b, round(avg(r), 4) AS mean_r, CAST(count(*) AS BIGINT) AS n_pairs FROM p GROUP BY ALL""")
def _(spark, d):
    """Suppliers over part names, the rich ones being a group beside all."""
    m = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey")
        .alias("supp"), "p_name").agg(F.avg("l_extendedprice").alias("v"))
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("supp"),
        F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("s_acctbal") > 5000, "rich")))).alias("group"))
    return P.group_correlation(m, s, "supp", "p_name", "v", 1000.0, least=3).withColumn("mean_r", r4("mean_r"))


@query("G05_label_crosscheck", "SELECT lang, quality, toxic, CAST(count(*) AS BIGINT) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def _(spark, d):
    return P.label_crosscheck(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "labels"), "doc_id", ["lang", "quality", "toxic"])


@query("G06_duplicate_names", """SELECT CAST(coalesce(sum(n) FILTER (WHERE p_name = ''), 0) AS BIGINT) AS blank, CAST(count(*) FILTER (WHERE
    n > 1) AS BIGINT) AS repeated_names, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS repeated_rows
    FROM (SELECT p_name, count(*) AS n FROM part GROUP BY 1)""")
def _(spark, d):
    return P.duplicate_names(t(spark, d, "part"), "p_name")


@query("G07_library_depth", """SELECT user_id, round(sum(value), 4) AS depth, CAST(count(*) AS BIGINT) AS n, min(event_type) AS label
    FROM events GROUP BY 1""")
def _(spark, d):
    e = t(spark, d, "events")
    return P.library_depth(e, "user_id", "value", e.groupBy("user_id").agg(F.min("event_type").alias("label"))).withColumn("depth", r4("depth"))


PRES = f"WITH {FX_MEASUREMENT}, e AS (SELECT DISTINCT p_name, study_id FROM fx_measurement JOIN part ON feature_id = p_partkey)"


def names(spark, d):
    return fx_measurement(spark, d).join(t(spark, d, "part"), F.col("feature_id") == F.col("p_partkey")).select("p_name", "study_id")


@query("G08_presence_matrix", PRES + " SELECT p_name, " + ", "
    .join(f"bool_or(study_id = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM e WHERE p_name IN ('red widget', 'blue bolt', 'small ring') GROUP BY 1")
def _(spark, d):
    return P.presence_matrix(names(spark, d), "p_name", "study_id", ["red widget", "blue bolt", "small ring"], REGIONS)


@query("G09_names_in_all", PRES + " SELECT p_name FROM e GROUP BY 1 HAVING count(*) = 5")
def _(spark, d):
    return P.names_in_all(names(spark, d), "p_name", "study_id", REGIONS)
