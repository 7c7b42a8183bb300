"""Queries B (rules) and D (constraints, lineage)."""

from __future__ import annotations

from pyspark.sql import functions as F

from concord.functions.patterns import parse_quantity
from concord.operators import constraints as D
from concord.operators import rules as B
from concord.plans.base import FX_SAMPLE, FX_TREATMENT, fx_sample, fx_treatment, query, r4, t

PROGRAM = {
    "defaults": {"role": {"value": "unknown", "source": "default", "raw": ""}, "form": {"value": "none", "source": "default", "raw": ""}},
    "rules": [
        {"name": "treated", "when": {"status": "^F$"}, "set": {"role": "treated"}, "note": "status is final", "source": "orders",
            "inventory": "I1", "children": [{"key": "OHT", "dose": "1000"}]},
        {"name": "open", "when": {"status": "O|P", "missing": "^$"}, "set": {"role": "control", "form": "open"}, "source": "orders",
            "inventory": "I2", "children": [{"key": "DMSO", "dose": "0"}]},
        {"name": "level", "when": {"priority": r"^(?P<level_no>\d)-(?P<word>\w+)"}, "set": {"form": "{word} at {level_no}"},
            "note": "level read", "source": "priority", "children": [{"key": "E2", "dose": "{level_no}0"}]},
        {"name": "urgent", "when": {"priority": "URGENT"}, "set": {"role": "urgent"}, "clear_children": True, "source": "priority",
            "inventory": "I3", "children": [{"key": "ICI", "dose": "5"}]},
        {"name": "again", "when": {"priority": "LOW", "status": "F"}, "set": {}, "note": "low", "children": [{"key": "OHT", "dose": "7"}]},
    ],
    "records": {"7": {"role": "fixed by hand"}, "10": {"role": "fixed by hand", "form": "none"}},
}


def labelled(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority").alias("labels"))


@query("B01_fields_to_map", """SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS who, json_extract_string(props, '$.k') AS k
    FROM events""")
def _(spark, d):
    e = t(spark, d, "events").select("event_id", F.explode(F.create_map(F.lit("type"), "event_type", F.lit("who"),
        F.col("user_id").cast("string"), F.lit("k"), F.get_json_object("props", "$.k"))).alias("field", "value"))
    m = B.fields_to_map(e, ["event_id"])
    return m.select("event_id", *(B.label("labels", f).alias(f) for f in ("type", "who", "k")))


@query("B02_rule_fires", """SELECT p_partkey, regexp_matches(p_name, 'ring$')
    AND regexp_matches(p_type, 'SMALL|PROMO') AS a, true AS b, true AS c FROM part""")
def _(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.create_map(F.lit("name"), "p_name", F.lit("type"), "p_type").alias("labels"))
    return p.select("p_partkey", B.rule_fires({"when": {"name": "ring$", "type": "SMALL|PROMO"}}).alias("a"), B.rule_fires({}).alias("b"),
        B.rule_fires({"when": {"absent": "^$"}}).alias("c"))


@query("B03_capture", """SELECT c_custkey, regexp_extract(c_name, '#0*(\\d+)$', 1) || ' is a ' || regexp_extract(c_name, '^(\\w+)#', 1) AS
    text FROM customer""")
def _(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.create_map(F.lit("name"), "c_name").alias("labels"))
    return c.select("c_custkey", B.capture({"name": "x", "when": {"name": r"^(?P<kind_of>\w+)#0*(?P<no>\d+)$"}}, "{no} is a {kind_of}").alias("text"))


ROLE = "CASE WHEN o_orderkey IN (7, 10) THEN 'fixed by hand' WHEN o_orderpriority LIKE '%URGENT%' THEN 'urgent' WHEN o_orderstatus IN ('O', 'P') THEN 'control' WHEN o_orderstatus = 'F' THEN 'treated' ELSE 'unknown' END"
FORM = "CASE WHEN o_orderkey = 10 THEN 'none' ELSE regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 2) || ' at ' || left(o_orderpriority, 1) END"


@query("B04_apply_rules", f"SELECT o_orderkey, {ROLE} AS role, {FORM} AS form FROM orders")
def _(spark, d):
    return B.apply_rules(labelled(spark, d), PROGRAM, "o_orderkey").select("o_orderkey", "role", "form")


@query("B05_record_overrides", f"""SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN 'vip' ELSE {ROLE} END AS role FROM orders LEFT
    JOIN customer ON o_custkey = c_custkey AND c_acctbal > 9000""")
def _(spark, d):
    fixes = t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 9000"),
        F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.lit("vip").alias("role"))
    return B.override_records(B.apply_rules(labelled(spark, d), PROGRAM, "o_orderkey"), fixes, "o_orderkey", ["role"]).select("o_orderkey", "role")


@query("B06_notes", """SELECT o_orderkey, nullif(concat_ws(' ', CASE WHEN o_orderstatus = 'F' THEN 'status is final' END, 'level read', CASE
    WHEN o_orderpriority LIKE '%LOW%' AND o_orderstatus = 'F' THEN 'low' END), '') AS note FROM orders""")
def _(spark, d):
    return B.apply_rules(labelled(spark, d), PROGRAM, "o_orderkey").select("o_orderkey", "note")


CHILDREN = """WITH c AS (SELECT o_orderkey, 0 AS pos, 'OHT' AS child, '1000' AS dose FROM orders WHERE o_orderstatus = 'F' UNION ALL
    SELECT o_orderkey, 1, 'DMSO', '0' FROM orders WHERE o_orderstatus <> 'F'
 UNION ALL SELECT o_orderkey, 2, 'E2', left(o_orderpriority, 1) || '0' FROM orders UNION ALL SELECT o_orderkey, 3, 'ICI', '5' FROM orders
    WHERE o_orderpriority LIKE '%URGENT%' UNION ALL SELECT o_orderkey, 4, 'OHT', '7' FROM orders
    WHERE o_orderpriority LIKE '%LOW%' AND o_orderstatus = 'F')"""


@query("B07_emit_children", CHILDREN + """ SELECT o_orderkey, child, CAST(max(pos) AS INTEGER) AS pos, max_by(dose, pos) AS dose FROM c
    GROUP BY o_orderkey, child""")
def _(spark, d):
    free = PROGRAM | {"rules": [{k: v for k, v in r.items() if k != "clear_children"} for r in PROGRAM["rules"]]}
    return B.emit_children(labelled(spark, d), free, "o_orderkey")


@query("B08_clear_children", CHILDREN + """ SELECT o_orderkey, child, CAST(max(pos) AS INTEGER) AS pos, max_by(dose, pos) AS dose FROM c
    JOIN orders USING (o_orderkey) WHERE o_orderpriority NOT LIKE '%URGENT%' OR pos >= 3 GROUP BY o_orderkey, child""")
def _(spark, d):
    return B.emit_children(labelled(spark, d), PROGRAM, "o_orderkey")


NAMES = {
    "names": {"child": {"oht": "OHT", "4-OHT": "OHT", "vehicle": "DMSO"}, "role": {"T": "treated", "C": "control"}},
    "rules": [
        {"name": "final", "when": {"status": "^(?P<s>F)$"}, "set": {"role": "T"},
            "children": [{"key": "oht", "dose": "1"}, {"key": "vehicle", "dose": "2"}]},
        {"name": "urgent", "when": {"priority": "URGENT"}, "set": {"role": "C"}, "children": [{"key": "4-OHT", "dose": "3"}]},
        {"name": "low", "when": {"priority": r"-(?P<word>LOW)"}, "set": {"role": "{word}"}, "children": [{"key": "{word}", "dose": "4"}]},
    ],
}


@query("B07b_children_by_name", """SELECT o_orderkey, 'OHT' AS child, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 1 ELSE 0 END AS pos,
    CASE WHEN o_orderpriority LIKE '%URGENT%' THEN '3' ELSE '1' END AS dose
 FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '%URGENT%' UNION ALL SELECT o_orderkey, 'DMSO', 0, '2' FROM orders
    WHERE o_orderstatus = 'F'""")
def _(spark, d):
    return B.emit_children(labelled(spark, d), NAMES, "o_orderkey")


@query("B07c_unresolved_names", """SELECT o_orderkey, unnest(['role', 'child']) AS field, 'LOW' AS spelling, 'low' AS rule FROM orders
    WHERE o_orderpriority LIKE '%LOW%'""")
def _(spark, d):
    return B.unresolved_names(labelled(spark, d), NAMES, "o_orderkey")


@query("B09_cast_numeric", """SELECT event_id, TRY_CAST(x AS INTEGER) AS x, CASE WHEN x <> ''
    AND TRY_CAST(x AS INTEGER) IS NULL THEN x END AS bad FROM (SELECT event_id, CASE event_type WHEN 'error' THEN 'n/a' WHEN 'view' THEN ''
    ELSE json_extract_string(props, '$.k') END AS x FROM events)""")
def _(spark, d):
    x = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "").otherwise(F.get_json_object("props", "$.k"))
    e = t(spark, d, "events").select("event_id", x.alias("x"), x.alias("text"))
    good, _ = B.cast_numeric(e, {"x": "int"})
    return good.select("event_id", "x", F.when((F.col("text") != "") & F.col("x").isNull(), F.col("text")).alias("bad"))


@query("B09b_cast_violations", "SELECT 'x' AS \"column\", 'n/a' AS value, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error'")
def _(spark, d):
    e = t(spark, d, "events").select(F.when(F.col("event_type") == "error", "n/a").otherwise("4").alias("x"))
    return B.cast_numeric(e, {"x": "int"})[1].groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def docs_labels(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "left")


@query("B10_require", """SELECT quality IS NOT NULL AND toxic IS NOT NULL AS ok, CAST(count(*) AS BIGINT) AS n FROM documents LEFT
    JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, d):
    good, bad = B.require(docs_labels(spark, d), ["quality", "toxic"])
    n = F.count(F.lit(1)).alias("n")
    return good.agg(n).withColumn("ok", F.lit(True)).unionByName(bad.agg(n).withColumn("ok", F.lit(False)))


@query("B11_assign_replicates", f"""WITH {FX_SAMPLE} SELECT sample_id, CASE WHEN prio = '1-URGENT' THEN 9
    ELSE CAST(row_number() OVER (PARTITION BY study_id, yr, line, role, prio = '1-URGENT'
    ORDER BY sample_id) AS INTEGER) END AS replicate, CASE WHEN prio = '1-URGENT' THEN 'stated' ELSE 'assigned' END AS replicate_basis
    FROM fx_sample""")
def _(spark, d):
    s = fx_sample(spark, d).withColumn("replicate", F.when(F.col("prio") == "1-URGENT", 9))
    return B.assign_replicates(s, ["study_id", "yr", "line", "role"], "sample_id").select("sample_id", "replicate", "replicate_basis")


@query("B12_treatment_signature", f"""WITH {FX_TREATMENT}, p AS (SELECT sample_id, compound_id || '@' || CAST(floor(dose) AS BIGINT) || '@'
    || exposure_h AS x FROM fx_treatment) SELECT sample_id, string_agg(x, '+' ORDER BY x) AS signature FROM p GROUP BY 1""")
def _(spark, d):
    return B.treatment_signature(fx_treatment(spark, d).withColumn("dose", F.floor("dose")), "sample_id", ["compound_id", "dose", "exposure_h"])


PROV = """WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) AS k, o_orderstatus AS s, o_orderpriority AS p, o_orderpriority LIKE '%URGENT%' AS
    urgent, o_orderkey IN (7, 10) AS fixed FROM orders),
w AS (SELECT k AS entity, 'record' AS kind, 'role' AS field, 'unknown' AS value, 'default' AS rule, true AS superseded FROM o
 UNION ALL SELECT k, 'record', 'form', 'none', 'default', true FROM o
 UNION ALL SELECT k, 'record', 'role', 'treated', 'treated', urgent OR fixed FROM o WHERE s = 'F'
 UNION ALL SELECT k, 'record', 'role', 'control', 'open', urgent OR fixed FROM o WHERE s <> 'F'
 UNION ALL SELECT k, 'record', 'form', 'open', 'open', true FROM o WHERE s <> 'F'
 UNION ALL SELECT k, 'record', 'form', regexp_extract(p, '^(\\d)-(\\w+)', 2) || ' at ' || left(p, 1), 'level', k = '10' FROM o
 UNION ALL SELECT k, 'record', 'role', 'urgent', 'urgent', fixed FROM o WHERE urgent
 UNION ALL SELECT k, 'record', 'role', 'fixed by hand', 'record ' || k, false FROM o WHERE fixed
 UNION ALL SELECT k, 'record', 'form', 'none', 'record 10', false FROM o WHERE k = '10'
 UNION ALL SELECT k || '|OHT', 'child', 'dose', '1000', 'treated', urgent OR p LIKE '%LOW%' FROM o WHERE s = 'F'
 UNION ALL SELECT k || '|DMSO', 'child', 'dose', '0', 'open', urgent FROM o WHERE s <> 'F'
 UNION ALL SELECT k || '|E2', 'child', 'dose', left(p, 1) || '0', 'level', urgent FROM o
 UNION ALL SELECT k || '|ICI', 'child', 'dose', '5', 'urgent', false FROM o WHERE urgent
 UNION ALL SELECT k || '|OHT', 'child', 'dose', '7', 'again', false FROM o WHERE p LIKE '%LOW%' AND s = 'F')"""
WRITES = ("entity", "kind", "field", "value", "rule", "superseded")


def write_log(spark, d):
    return B.provenance(labelled(spark, d), PROGRAM, "o_orderkey", "o_orderkey")


@query("B13_provenance", PROV + " SELECT * FROM w")
def _(spark, d):
    return write_log(spark, d).select(*WRITES)


@query("B13b_table_from_log", f"SELECT CAST(o_orderkey AS VARCHAR) AS entity, {ROLE} AS role, {FORM} AS form FROM orders")
def _(spark, d):
    return B.current_values(write_log(spark, d), ["role", "form"])


NUMBERED = {"defaults": {"replicate": {}}, "rules": [{"name": "urgent", "when": {"priority": "URGENT"}, "set": {"replicate": "9"},
    "source": "orders", "location": "o_orderpriority"}]}


@query("B13c_replicate_writes", """WITH a AS (SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus
    ORDER BY o_orderkey) AS VARCHAR) AS value FROM orders WHERE o_orderpriority NOT LIKE '%URGENT%')
 SELECT CAST(o_orderkey AS VARCHAR) AS entity, NULL AS value, 'default' AS rule, NULL AS location, true AS superseded FROM orders
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '9', 'urgent', 'o_orderpriority', false FROM orders WHERE o_orderpriority LIKE '%URGENT%'
 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), value, 'assigned', NULL, false FROM a""")
def _(spark, d):
    rows = labelled(spark, d)
    numbers = B.apply_rules(rows, NUMBERED, "o_orderkey").withColumns({"replicate": F.col("replicate").cast("int"),
        "status": F.col("labels")["status"]})
    numbers = B.assign_replicates(numbers, ["status"], "o_orderkey")
    return B.provenance(rows, NUMBERED, "o_orderkey", "o_orderkey", numbers).select("entity", "value", "rule", "location", "superseded")


@query("B14_parse_quantity", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS amount, CASE p_size % 3 WHEN 0 THEN 'nM' WHEN 1 THEN 'uM'
    ELSE 'mM' END AS unit, CAST(p_size * (CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END) AS DOUBLE) AS value FROM part""")
def _(spark, d):
    text = F.concat(F.lit("given "), F.col("p_size").cast("string"),
        F.when(F.col("p_size") % 3 == 0, " nM").when(F.col("p_size") % 3 == 1, "uM").otherwise(" mM"), F.lit(" of it, 5 mMol"))
    return t(spark, d, "part").select("p_partkey", F.explode(parse_quantity(text)).alias("q")).select("p_partkey", "q.*")


@query("D01_check_not_null", """SELECT 'quality' AS \"column\", CAST(count(*) - count(quality) AS BIGINT) AS n_null FROM documents LEFT
    JOIN labels USING (doc_id) UNION ALL SELECT 'lang', CAST(count(*) - count(lang) AS BIGINT) FROM documents""")
def _(spark, d):
    return D.check_not_null(docs_labels(spark, d), ["quality", "lang"])


@query("D02_check_unique", "SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, d):
    return D.check_unique(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("D03_check_foreign_key", """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey
    FROM orders WHERE o_orderstatus = 'F') GROUP BY 1""")
def _(spark, d):
    return D.check_foreign_key(t(spark, d, "lineitem"), "l_orderkey", t(spark, d, "orders").where("o_orderstatus = 'F'"), "o_orderkey")


@query("D04_check_vocabulary", """SELECT 'status' AS what, o_orderstatus AS value, CAST(count(*) AS BIGINT) AS n FROM orders
    WHERE o_orderstatus NOT IN ('F', 'O') GROUP BY ALL UNION ALL SELECT 'event', event_type, CAST(count(*) AS BIGINT) FROM events
    WHERE event_type NOT IN ('click', 'view') GROUP BY ALL""")
def _(spark, d):
    a = D.check_vocabulary(t(spark, d, "orders"), "o_orderstatus", ["F", "O"]).withColumn("what", F.lit("status"))
    return a.unionByName(D.check_vocabulary(t(spark, d, "events"), "event_type", ["click", "view"]).withColumn("what", F.lit("event")))


@query("D04b_vocabulary_drift", """SELECT coalesce(a, b) AS value, CASE WHEN a IS NULL THEN 'second' ELSE 'first' END AS only_in
    FROM (SELECT DISTINCT p_name AS a FROM part WHERE p_type = 'PROMO') FULL JOIN (SELECT DISTINCT p_name AS b FROM part
    WHERE p_size < 9) ON a = b WHERE a IS NULL OR b IS NULL""")
def _(spark, d):
    p = t(spark, d, "part")
    return D.vocabulary_drift(p.where("p_type = 'PROMO'"), p.where("p_size < 9"), "p_name")


@query("D05_check_predicate", """SELECT l_orderkey, l_partkey, l_linenumber, l_discount, l_tax FROM lineitem
    WHERE NOT (l_discount <= 0.09 AND (l_returnflag <> 'R' OR l_tax < 0.08))""")
def _(spark, d):
    ok = (F.col("l_discount") <= 0.09) & ((F.col("l_returnflag") != "R") | (F.col("l_tax") < 0.08))
    return D.check_predicate(t(spark, d, "lineitem"), ok).select("l_orderkey", "l_partkey", "l_linenumber", "l_discount", "l_tax")


@query("D06_constraint_report", """SELECT 'unique line' AS \"constraint\", CAST((SELECT count(*) FROM (SELECT 1 FROM lineitem
    GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS BIGINT) AS n_violations UNION ALL
    SELECT 'nation has region', CAST((SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS BIGINT)
    UNION ALL SELECT 'quantity below 50', CAST((SELECT count(*) FROM lineitem WHERE l_quantity >= 50) AS BIGINT)""")
def _(spark, d):
    li = t(spark, d, "lineitem")
    return D.constraint_report({"unique line": D.check_unique(li, ["l_orderkey", "l_linenumber"]),
        "nation has region": D.check_foreign_key(t(spark, d, "nation"), "n_regionkey", t(spark, d, "region"), "r_regionkey"),
            "quantity below 50": D.check_predicate(li, F.col("l_quantity") < 50)})


def _fp(table: str, cols: list[str]) -> str:
    """Each lane of four hex digits of the row digests, added."""
    names = "".join(f"{len(c)}:{c}" for c in sorted(cols)) + ";"
    values = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in sorted(cols))
    lanes = " || ".join(f"printf('%08x', CAST(sum(('0x' || substr(h, {1 + 4 * k}, 4))::BIGINT) % 4294967296 AS BIGINT))" for k in range(8))
    return f"(SELECT {lanes} FROM (SELECT md5('{names}' || {values}) AS h FROM {table}))"


FP = {"nation": ["n_nationkey", "n_name", "n_regionkey"], "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]}


def fingerprints(spark, d, change=None):
    out = None
    for name, cols in FP.items():
        df = t(spark, d, name).select(*cols)
        f = D.fingerprint(df.where(change[name]) if change and name in change else df).withColumn("table", F.lit(name))
        out = f if out is None else out.unionByName(f)
    return out


@query("D07_fingerprint", " UNION ALL ".join(f"""SELECT '{n}' AS \"table\", {_fp(n, c)} AS fingerprint, CAST((SELECT count(*)
    FROM {n}) AS BIGINT) AS n_rows""" for n, c in FP.items()))
def _(spark, d):
    return fingerprints(spark, d)


@query("D08_fingerprint_diff", " UNION ALL ".join(f"""SELECT '{n}' AS \"table\", {_fp(n, c)} AS before,
    {_fp(n if n != 'part' else '(SELECT * FROM part WHERE p_size < 50)', c)} AS after, {'true' if n != 'part' else 'false'} AS same""" for n, c in FP.items()))
def _(spark, d):
    return D.fingerprint_diff(fingerprints(spark, d), fingerprints(spark, d, {"part": "p_size < 50"}))


PARTS = [("p_size >= 50", 1), ("p_size < 10", 1), ("p_size < 20", -1)]  # what is added to the parts below 50, and taken away


@query("D08b_fingerprint_update", f"""SELECT {_fp('(SELECT * FROM part WHERE p_size >= 10 AND p_size NOT BETWEEN 10 AND 19)', FP['part'])}
    AS fingerprint, CAST(count(*) AS BIGINT) AS n_rows FROM part WHERE p_size >= 20""")
def _(spark, d):
    part = t(spark, d, "part").select(*FP["part"])
    parts = D.content_lanes(part.where("p_size between 10 and 49")).withColumn("sign", F.lit(1))
    for where, sign in PARTS:
        parts = parts.unionByName(D.content_lanes(part.where(where)).withColumn("sign", F.lit(sign)))
    return D.combined_lanes(parts, sign="sign").select(D.lanes_text(F.col("lanes")).alias("fingerprint"), "n_rows")


@query("D09_surrogate_id", """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS id,
    CAST(row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS BIGINT) AS by_text FROM orders""")
def _(spark, d):
    o = D.surrogate_id(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), ["o_totalprice", "o_orderkey"])
    return D.surrogate_id(o, ["o_orderpriority", "o_orderkey"], "by_text").select("o_orderkey", "id", "by_text")


@query("D10_explain_value", PROV + " SELECT * FROM w WHERE split_part(entity, '|', 1) IN ('7', '10')")
def _(spark, d):
    log = write_log(spark, d)
    return D.explain_value(log, "7").unionByName(D.explain_value(log, "10")).select(*WRITES)


CITED = """WITH c AS (SELECT DISTINCT l_orderkey + (CASE WHEN l_quantity = 50 THEN 100000000 ELSE 0 END) AS o_orderkey FROM lineitem
    WHERE l_quantity >= 49)"""


def cited(spark, d):
    """Orders of large lines, some of which don't exist; what they got, who ordered (as the files), and issues by priority."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    ids = li.where("l_quantity >= 49").select((F.col("l_orderkey") + F.when(F.col("l_quantity") == 50, 100000000).otherwise(0)).alias("o_orderkey"))
    got = li.select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws(" ", "l_returnflag", F.col("l_linenumber").cast("string"))
        .alias("treatment"))
    files = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    issues = t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.substring("o_orderpriority", 1, 1).alias("inventory_id"),
        F.col("o_orderkey").alias("record_id"), F.lit("minor").alias("impact"), F.lit("flagged").alias("resolution"),
            F.concat(F.lit("order of "), F.col("o_custkey").cast("string"), F.lit(" is open")).alias("message"))
    prov = write_log(spark, d)
    wanted = spark.createDataFrame([(" 1",), ("3",), ("9",)], "inventory_id string")
    return D.resolve_citations(ids, "o_orderkey", o, got, prov, [], files, "o_custkey", issues, wanted)


@query("D11_resolve_citations", CITED + """ SELECT o_orderkey, o_custkey, o_orderstatus, (SELECT string_agg(DISTINCT l_returnflag || ' ' ||
    l_linenumber, ', ' ORDER BY l_returnflag || ' ' || l_linenumber)
 FROM lineitem WHERE l_orderkey = o_orderkey) AS treatment FROM orders JOIN c USING (o_orderkey)""")
def _(spark, d):
    return cited(spark, d)["records"]


@query("D11b_not_found", CITED + " SELECT o_orderkey FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, d):
    return cited(spark, d)["not_found"]


@query("D11c_files", CITED + """ SELECT DISTINCT c_custkey AS o_custkey, c_name FROM customer JOIN orders ON o_custkey = c_custkey
    JOIN c USING (o_orderkey)""")
def _(spark, d):
    return cited(spark, d)["files"]


@query("D11d_issues", """SELECT substr(o_orderpriority, 1, 1) AS inventory_id, CAST(count(*) AS BIGINT) AS n_records, min(o_orderkey) AS
    record_id, 'minor' AS impact, 'flagged' AS resolution, 'order of ' || min_by(o_custkey, o_orderkey) || ' is open' AS message FROM orders
    WHERE o_orderstatus = 'P' AND o_orderpriority[1] IN ('1', '3') GROUP BY 1""")
def _(spark, d):
    return cited(spark, d)["issues"]


@query("D11e_provenance", PROV + ", " + CITED.removeprefix("WITH ") + """ SELECT w.*, CASE rule WHEN 'level' THEN (SELECT p FROM o
    WHERE k = split_part(entity, '|', 1)) END AS raw FROM w WHERE CAST(split_part(entity, '|', 1) AS BIGINT) IN (SELECT o_orderkey FROM c)""")
def _(spark, d):
    return cited(spark, d)["provenance"].select(*WRITES, F.when(F.col("rule") == "level", F.col("raw")).alias("raw"))
