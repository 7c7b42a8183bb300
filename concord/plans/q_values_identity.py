"""Queries C (identity) and E (scaling)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.operators import identity as I
from concord.operators import scaling as S
from concord.plans.base import FX_FEATURE_MAP, FX_MEASUREMENT, FX_SAMPLE, fx_feature_map, fx_measurement, fx_sample, query, r4, t
from concord.shared import kept


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


ALIAS = [("click", "tap"), ("view", "look"), ("purchase", "buy")]


@query("C01_resolve_alias", """SELECT event_type, CASE event_type WHEN 'click' THEN 'tap' WHEN 'view' THEN 'look'
    WHEN 'purchase' THEN 'buy' END AS id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL""")
def _(spark, d):
    good, miss = I.resolve_alias(t(spark, d, "events"), "event_type", rows(spark, ALIAS, "alias string, id string"))
    n = good.groupBy("event_type", "id").agg(F.count(F.lit(1)).alias("n"))
    lost = t(spark, d, "events").join(miss, "event_type", "left_semi").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(lost.withColumn("id", F.lit(None).cast("string")))


WORDS = [("the",), ("der",), ("zzunseen",), ("que",), ("xyzzy",)]


@query("C02_alias_seen", """WITH a(alias) AS (VALUES ('the'), ('der'), ('zzunseen'), ('que'), ('xyzzy')) SELECT alias FROM a
    WHERE NOT EXISTS (SELECT 1 FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || alias || '($|[^\\p{L}\\p{N}])'))""")
def _(spark, d):
    return I.alias_seen(rows(spark, WORDS, "alias string"), t(spark, d, "documents"))


@query("C03_build_lookup", """SELECT p_brand AS key, max(p_partkey) AS id FROM part WHERE p_type <> 'PROMO' GROUP BY p_brand UNION ALL
    SELECT k, max(p_partkey) FROM (SELECT unnest(string_split(p_name || '|' || p_type || '.' || p_size, '|')) AS k0, split_part(k0, '.', 1)
    AS k, p_partkey FROM part) GROUP BY k""")
def _(spark, d):
    p = t(spark, d, "part")
    multi = p.withColumn("keys", F.concat(F.col("p_name"), F.lit("|"), F.col("p_type"), F.lit("."), F.col("p_size").cast("string")))
    return I.build_lookup(p, "p_brand", "p_partkey", "p_partkey", where=F.col("p_type") != "PROMO").unionByName(I
        .build_lookup(multi, "keys", "p_partkey", "p_partkey", multi=True, strip_version=True))


@query("C04_unambiguous_lookup", "SELECT p_name, p_type, min(p_brand) AS id FROM part GROUP BY p_name, p_type HAVING count(DISTINCT p_brand) = 1")
def _(spark, d):
    return I.unambiguous_lookup(t(spark, d, "part"), ["p_name", "p_type"], "p_brand")


LADDER_SQL = """WITH f AS (SELECT DISTINCT l_partkey AS part, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT part, name, CASE WHEN part % 2 = 0 THEN 'id' || part WHEN name LIKE 'red%' OR name LIKE 'blue%' THEN 'n' || name END AS id,
 CASE WHEN part % 2 = 0 THEN 'by_id' WHEN name LIKE 'red%' OR name LIKE 'blue%' THEN 'by_name' END AS method,
 CASE WHEN part % 2 = 0 OR name LIKE 'red%' OR name LIKE 'blue%' THEN 'mapped' ELSE 'unmapped' END AS status FROM f"""


@query("C05_map_entities", LADDER_SQL)
def _(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    f = t(spark, d, "lineitem").select(F.col("l_partkey").alias("part")).distinct().join(p, "part")
    by_id = p.where("part % 2 = 0").select(F.col("part").alias("key"), F.concat(F.lit("id"), F.col("part").cast("string")).alias("id"))
    by_name = p.where("name like 'red%' or name like 'blue%'").select(F.col("name").alias("key"), F.concat(F.lit("n"), "name").alias("id")).distinct()
    return I.map_entities(f, [("by_id", "part", by_id), ("by_name", "name", by_name)])


@query("C05b_ladder_by_study", """WITH f AS (SELECT DISTINCT l_returnflag AS study, l_partkey AS part
    FROM lineitem), x AS (SELECT study, part, p_name AS name, part % 2 = 0 AND study <> 'R' AS a, p_name LIKE 'red%' OR p_name LIKE 'blue%'
    AND study = 'N' AS b FROM f JOIN part ON part = p_partkey)
 SELECT study, part, CASE WHEN a THEN 'id' || part WHEN b THEN 'n' || name END AS id, CASE WHEN a THEN 'by_id'
    WHEN b THEN 'by_name' END AS method, CASE WHEN a OR b THEN 'mapped' ELSE 'unmapped' END AS status FROM x""")
def _(spark, d):
    """Study R may not use ids, blue names hold for study N only, and odd parts have two ids each."""
    p = t(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    f = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("study"), F.col("l_partkey").alias("part")).distinct().join(p, "part")
    by_id = p.where("part % 2 = 0").select(F.col("part").alias("key"), F.concat(F.lit("id"), F.col("part").cast("string")).alias("id"))
    twice = p.where("part % 2 = 1").select(F.col("part").alias("key"), F.explode(F.array(F.lit("one"), F.lit("two"))).alias("id"))  # tells nothing
    named = p.select(F.col("name").alias("key"), F.concat(F.lit("n"), "name").alias("id")).distinct()
    by_name = named.where("key like 'red%'").withColumn("study", F.lit(None).cast("string")).unionByName(named.where("key like 'blue%'")
        .withColumn("study", F.lit("N")))
    got = I.map_entities(f, [("by_id", "part", by_id.unionByName(twice)), ("by_name", "name", by_name)], study="study", forbidden={"R": ["by_id"]})
    return got.select("study", "part", "id", "method", "status")


CLASS_SQL = """SELECT coalesce(status, 'open') AS status, CAST(count(*) AS BIGINT) AS n
    FROM (SELECT CASE WHEN p_type = 'PROMO' THEN 'control_probe' WHEN p_type = 'SMALL' THEN 'multiple_genes'
 WHEN p_size = 7 THEN 'corrupt_annotation' WHEN p_brand = 'Brand#3' THEN 'retired' END AS status FROM part) GROUP BY ALL"""


@query("C06_classify_features", CLASS_SQL)
def _(spark, d):
    text = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("AFFX-"), "p_name")).when(F.col("p_type") == "SMALL",
        F.concat("p_name", F.lit(" /// "), "p_brand")).when(F.col("p_size") == 7, F.lit(" ### ")).otherwise(F.col("p_name"))
    s = I.classify(text, {"retired": F.col("p_brand") == "Brand#3"})
    return t(spark, d, "part").groupBy(F.coalesce(s, F.lit("open")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("C07_symbol_from_text", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS symbol FROM part")
def _(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_name")).otherwise(F
        .concat("p_name", F.lit(" ("), "p_brand", F.lit(") of kind ("), "p_type", F.lit(")")))
    return t(spark, d, "part").select("p_partkey", I.symbol_from_text(text).alias("symbol"))


@query("C08_choose_representative", f"""WITH {FX_FEATURE_MAP} SELECT study_id, entity, feature_id
    FROM (SELECT *, row_number() OVER (PARTITION BY study_id, entity ORDER BY mean DESC NULLS LAST, feature_id) AS r FROM fx_feature_map)
    WHERE r = 1""")
def _(spark, d):
    return I.choose_representative(fx_feature_map(spark, d), ["study_id", "entity"]).where("chosen").select("study_id", "entity", "feature_id")


@query("C09_entities_in_all", f"WITH {FX_MEASUREMENT} SELECT feature_id FROM fx_measurement GROUP BY feature_id HAVING count(DISTINCT study_id) = 5")
def _(spark, d):
    return I.entities_in_all(fx_measurement(spark, d), "feature_id", "study_id", 5)


@query("C10_find_entity", """WITH n(name) AS (VALUES ('red'), ('widget'), ('blue bolt'), ('nothing')), l AS (SELECT p_partkey AS entity_id,
    p_name AS name, 'current' AS how FROM part UNION ALL SELECT p_partkey, unnest(string_split(p_name, ' ')), 'other' FROM part)
    SELECT name, entity_id, min(how) AS how FROM l JOIN n USING (name) GROUP BY ALL""")
def _(spark, d):
    return I.find_entity(t(spark, d, "part"), rows(spark, [("red",), ("widget",), ("blue bolt",), ("nothing",)], "name string"),
        "p_partkey", "p_name", F.split("p_name", " "))


@query("C11_outdated_names", """SELECT p_type, CAST(count(*) AS BIGINT) AS n_outdated, count(DISTINCT written) AS n_names
    FROM (SELECT p_type, p_partkey, CASE WHEN p_size % 5 = 0 THEN 'old ' || p_name WHEN p_size % 7 = 0 THEN '1-Mar'
    ELSE p_name END AS written, p_name FROM part) WHERE written <> p_name AND NOT regexp_matches(written, '^\\d{1,2}-[A-Z][a-z]{2}$')
    GROUP BY p_type""")
def _(spark, d):
    p = t(spark, d, "part")
    w = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("old "), "p_name")).when(F.col("p_size") % 7 == 0, "1-Mar").otherwise(F.col("p_name"))
    return I.outdated_names(p.select("p_partkey", "p_type", w.alias("written")), p.select("p_partkey", "p_name"), "p_type", "written",
        "p_name", "p_partkey")


@query("C12_extra_rows_per_entity", f"""WITH {FX_FEATURE_MAP}
    SELECT study_id, CAST(count(*) - count(DISTINCT entity) AS BIGINT) AS extra_rows FROM fx_feature_map GROUP BY study_id
    HAVING count(*) > count(DISTINCT entity)""")
def _(spark, d):
    return I.extra_rows_per_entity(fx_feature_map(spark, d), "study_id", "entity")


@query("C13_hierarchy_parent", """SELECT coalesce(r_name, n_name) AS top, CAST(count(*) AS BIGINT) AS n FROM customer
    JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA' GROUP BY 1""")
def _(spark, d):
    n = t(spark, d, "nation").join(t(spark, d, "region").where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    c = t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return I.hierarchy_parent(c, "n_name", "r_name").groupBy("top").agg(F.count(F.lit(1)).alias("n"))


EV = "SELECT user_id AS sample_id, event_type AS feature_id, value AS raw_value FROM events"


def ev(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("sample_id"), F.col("event_type").alias("feature_id"),
        F.col("value").alias("raw_value"))


@query("E01_library_size", "SELECT user_id AS sample_id, round(sum(value), 4) AS lib FROM events GROUP BY 1")
def _(spark, d):
    return S.library_size(ev(spark, d)).withColumn("lib", r4("lib"))


@query("E02_log_cpm", "SELECT event_id, round(log2(value / sum(value) OVER (PARTITION BY user_id) * 1e6 + 1), 4) AS value FROM events")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", F.col("user_id").alias("sample_id"), F.col("value").alias("raw_value"))
    return S.log_cpm(e, S.library_size(e)).select("event_id", r4("value").alias("value"))


@query("E03_log_signal", """SELECT l_orderkey, l_partkey, l_linenumber, round(CASE WHEN l_linestatus = 'O' THEN log2(l_extendedprice + 1)
    ELSE l_extendedprice END, 4) AS value FROM lineitem""")
def _(spark, d):
    scale = F.when(F.col("l_linestatus") == "O", "linear").otherwise("log2")
    return t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", r4(S.log_signal(F.col("l_extendedprice"), scale)).alias("value"))


SCALES = [("AFRICA", "linear"), ("AMERICA", "log2"), ("ASIA", "linear"), ("EUROPE", "log2"), ("MIDDLE EAST", "linear")]
MEAS_SQL = f"""WITH {FX_FEATURE_MAP}, chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id, entity
    ORDER BY mean DESC, feature_id) AS r FROM fx_feature_map) WHERE r = 1),
meas AS (SELECT m.study_id, m.sample_id, c.entity, m.feature_id, CASE
    WHEN m.study_id IN ('AFRICA', 'ASIA', 'MIDDLE EAST') THEN log2(raw_value + 1) ELSE raw_value END AS value, raw_value,
 CASE WHEN m.study_id IN ('AFRICA', 'ASIA', 'MIDDLE EAST') THEN 'linear' ELSE 'log2' END AS scale FROM fx_measurement m
    JOIN chosen c USING (study_id, feature_id))"""


def fx_meas(spark, d):
    """The fact is written once; the map is made from it and the values are taken from it."""
    m = kept(fx_measurement(spark, d), "measurement")
    fm = I.choose_representative(fx_feature_map(spark, d, m), ["study_id", "entity"])
    return S.build_measurement(m, fm, rows(spark, SCALES, "study_id string, scale string"))


@query("E04_build_measurement", f"""{MEAS_SQL}
    SELECT study_id, sample_id, entity, feature_id, round(value, 4) AS value, round(raw_value, 4) AS raw_value, scale FROM meas""")
def _(spark, d):
    return fx_meas(spark, d).withColumn("value", r4("value")).withColumn("raw_value", r4("raw_value"))


@query("E05_expect_dense", f"""{MEAS_SQL}
    SELECT study_id, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(DISTINCT entity) AS n_entities,
    count(*) = count(DISTINCT sample_id) * count(DISTINCT entity) AS dense FROM meas GROUP BY study_id""")
def _(spark, d):
    return S.expect_dense(fx_meas(spark, d))


@query("E06_value_summary", """SELECT l_returnflag, min(l_extendedprice) AS v_min, round(median(l_extendedprice), 4) AS v_median,
    max(l_extendedprice) AS v_max, CAST(count(*) FILTER (WHERE l_extendedprice = 0) AS BIGINT) AS zeros, CAST(count(*) FILTER (WHERE
    l_extendedprice IS NULL) AS BIGINT) AS blanks, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def _(spark, d):
    return S.value_summary(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice").withColumn("v_median", r4("v_median"))


@query("E07_non_finite", """SELECT CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS nulls, CAST(count(*) FILTER (WHERE isnan(v)) AS
    BIGINT) AS nans, CAST(count(*) FILTER (WHERE isinf(v)) AS BIGINT) AS infinite
    FROM (SELECT CASE WHEN l_quantity = 7 THEN NULL WHEN l_quantity = 8 THEN CAST('nan' AS DOUBLE)
    WHEN l_quantity = 9 THEN CAST('-inf' AS DOUBLE) ELSE l_quantity END AS v FROM lineitem)""")
def _(spark, d):
    v = F.when(F.col("l_quantity") == 7, None).when(F.col("l_quantity") == 8, float("nan")).when(F.col("l_quantity") == 9,
        float("-inf")).otherwise(F.col("l_quantity"))
    return S.non_finite(t(spark, d, "lineitem").select(v.alias("v")), "v")


@query("E08_cpm_closure", """SELECT round(min(s), 2) AS least, round(max(s), 2) AS most FROM (SELECT sum(pow(2, v) - 1) AS s
    FROM (SELECT user_id, log2(value / sum(value) OVER (PARTITION BY user_id) * 1e6 + 1) AS v FROM events) GROUP BY user_id)""")
def _(spark, d):
    e = ev(spark, d)
    c = S.cpm_closure(S.log_cpm(e, S.library_size(e)))
    return c.select(F.round("least", 2).alias("least"), F.round("most", 2).alias("most"))


@query("E09_target_check", f"""WITH {FX_MEASUREMENT}
    SELECT study_id, round(avg(log2(raw_value + 1)) FILTER (WHERE role = 'treated'), 4) AS treated_mean, round(avg(log2(raw_value + 1))
    FILTER (WHERE role = 'vehicle_control'), 4) AS control_mean, bool_or(role = 'treated') AS has_treated, avg(log2(raw_value + 1)) FILTER
    (WHERE role = 'treated') > avg(log2(raw_value + 1)) FILTER (WHERE role = 'vehicle_control') AS up FROM fx_measurement
    JOIN fx_sample USING (study_id, sample_id) JOIN part ON feature_id = p_partkey WHERE p_name = 'red widget' GROUP BY study_id""")
def _(spark, d):
    m = fx_measurement(spark, d).join(fx_sample(spark, d).select("sample_id", "role"), "sample_id").join(t(spark, d, "part"),
        F.col("feature_id") == F.col("p_partkey"))
    m = m.select("study_id", "role", F.col("p_name").alias("entity"), F.log2(F.col("raw_value") + 1).alias("value"))
    return S.target_check(m, "red widget", F.col("role") == "treated", F.col("role") == "vehicle_control").withColumn("treated_mean",
        r4("treated_mean")).withColumn("control_mean", r4("control_mean"))
