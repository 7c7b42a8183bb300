"""Quirks of the operators on hand-written rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from concord.functions.patterns import java_pattern, parse_quantity
from concord.operators import checks, cohort, constraints, grading, identity, profile, rules, scaling
from concord.plans.catalog import QUERIES
from concord.sources import bundles, files


def test_last_writer_wins_and_default_stays(spark):
    p = {"defaults": {"a": {"value": "d"}}, "rules": [{"name": "1", "when": {"x": "q"}, "set": {"a": "one"}},
        {"name": "2", "when": {"x": "qq"}, "set": {"a": "two"}}]}
    df = spark.createDataFrame([(1, {"x": "q"}), (2, {"x": "qq"}), (3, {"y": "q"}), (4, None)], "id int, labels map<string,string>")
    assert {r.id: r.a for r in rules.apply_rules(df, p).collect()} == {1: "one", 2: "two", 3: "d", 4: "d"}


def test_unknown_group_is_refused_when_compiled():
    with pytest.raises(ValueError):
        rules.capture({"name": "r", "when": {"x": "(?P<a>.)"}}, "{b}")


def test_pattern_dialect():
    assert java_pattern(r"(?P<a_b>\w+)-(\d)") == (r"(?U)(\w+)-(\d)", {"a_b": 1})


def test_both_micro_signs(spark):
    got = spark.createDataFrame([("2 µM then 3 μM",)], "t string").select(parse_quantity(F.col("t")).alias("q")).first().q
    assert [x.value for x in got] == [2000.0, 3000.0]


def test_replicates_start_at_one_or_after_the_stated(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), (None, None, 3), (None, None, 4)], "c string, replicate int, id int")
    assert [r.replicate for r in rules.assign_replicates(df, ["c"], "id").orderBy("id").collect()] == [1, 5, 1, 2]
    assert [r.replicate for r in rules.assign_replicates(df, ["c"], "id", avoid_stated=True).orderBy("id").collect()] == [6, 5, 1, 2]


def cohort_of(spark, rows):
    """(sample, batch, role, value, {compound: hours}) -> measurements, samples, signatures."""
    samples = spark.createDataFrame([r[:3] for r in rows], "sample_id int, batch string, role string")
    meas = spark.createDataFrame([(r[0], "g", r[3]) for r in rows], "sample_id int, entity string, value double")
    got = [(r[0], c, h, "acute") for r in rows for c, h in r[4].items()]
    return meas, samples, cohort.signatures(spark.createDataFrame(got,
        "sample_id int, compound_id string, exposure_h int, exposure_type string"), ["DMSO"])


def test_matched_effect_takes_nulls_as_equal_and_ignores_shifts(spark):
    rows = [(1, None, "treated", 3.0, {"A": 24}), (2, None, "vehicle_control", 1.0, {"DMSO": 24}), (3, "b", "treated", 2.0, {"A": 24})]
    meas, samples, sig = cohort_of(spark, rows)
    got = {r.batch: r.effect for r in cohort.matched_effect(meas, samples, sig, ["batch"]).collect()}
    assert got == {None: 2.0, "b": None}
    moved = {r.batch: r.effect for r in cohort.matched_effect(meas.withColumn("value", F.col("value") + 7), samples, sig, ["batch"]).collect()}
    assert moved == got


def test_matched_effect_keeps_compounds_hours_and_mixtures_apart(spark):
    rows = [
        (1, "b", "treated", 3.0, {"A": 24, "DMSO": 24}), (2, "b", "treated", 9.0, {"B": 24}), (3, "b", "treated", 5.0, {"A": 6}),
            (4, "b", "treated", 7.0, {"B": 24, "A": 12}),
        (5, "b", "treated", 99.0, {"DMSO": 24}), (6, "b", "vehicle_control", 1.0, {"DMSO": 24}), (7, "b", "untreated_control", 2.0, {}),
            (8, "b", "parental", 50.0, {}), (9, "b", "treated", 4.0, {"A": 24}),
    ]
    meas, samples, sig = cohort_of(spark, rows)
    got = {(r.compounds, r.exposure_h): (r.treated_mean, r.n_treated, r.control_mean, r.n_control, r.effect) for r in cohort
        .matched_effect(meas, samples, sig, ["batch"]).collect()}
    assert got == {("A", 24): (3.5, 2, 1.5, 2, 2.0), ("B", 24): (9.0, 1, 1.5, 2, 7.5), ("A", 6): (5.0, 1, 1.5, 2, 3.5),
        ("A+B", 24): (7.0, 1, 1.5, 2, 5.5)}
    ids = {(r.compounds, r.exposure_h): (r.treated_ids, r.control_ids) for r in cohort.effect_ids(samples, sig, ["batch"]).collect()}
    assert ids[("A", 24)] == ([1, 9], [6, 7]) and len(ids) == 4


def test_fields_that_do_not_vary_are_not_compared(spark):
    rows = [("s", r, f, v) for r, by in {1: "aab", 2: "bbb", 3: "aaa"}.items() for f, v in zip(("title", "source", "label"), by, strict=True)]
    rows += [("s", r, "lab", "zz") for r in (1, 2, 3)] + [("t", 9, "title", "a"), ("t", 9, "source", "b"), ("t", 8, "title", "a"),
        ("t", 8, "source", "b"), ("u", 7, "title", "a"), ("u", 7, "source", "a"), ("u", 6, "title", "b")]
    df = spark.createDataFrame(rows, "study string, record int, field string, value string")
    got = {(r.study, r.record): (r.n_views, r.odd_ones) for r in checks.fields_contradict(df, "study", "record", "field", "value").collect()}
    assert got == {("s", 1): (3, "label"), ("u", 6): (2, None)}


def test_partitions_of_the_fact_grow_with_it(spark, monkeypatch):
    from concord import shared
    from concord.plans import base, q_cohort

    d, names = "/root/testdata/sf0.001", ("H02b_compared_sets", "C08_choose_representative", "E09_target_check")
    few = base.fx_values(spark, d).rdd.getNumPartitions()
    want = {n: {tuple(r) for r in QUERIES[n](spark, d).collect()} for n in names}
    monkeypatch.setattr(shared, "TASK_ROWS", 150)  # of 6,000 rows
    monkeypatch.setattr(q_cohort, "BROADCAST_ROWS", 1)
    assert few <= 4 and {f(spark, d).rdd.getNumPartitions() for f in (base.fx_values, base.fx_treatment, q_cohort.fx_entity)} == {40}
    assert {n: {tuple(r) for r in QUERIES[n](spark, d).collect()} for n in names} == want


def test_contradicting_fields_are_read_once(spark, tmp_path):
    rows = [("s", 1, "a", "x"), ("s", 1, "b", "y"), ("s", 1, "b", "y"), ("s", 2, "a", "y"), ("s", 2, "b", "y"), ("s", 3, "a", None),
        ("s", 3, "b", "x"), ("s", None, "a", "z"), (None, 4, "a", "z"), ("one", 5, "a", "x"), ("one", 6, "a", "y")]
    spark.createDataFrame(rows, "study string, record int, field string, value string").write.parquet(f"{tmp_path}/views")
    got = checks.fields_contradict(spark.read.parquet(f"{tmp_path}/views"), "study", "record", "field", "value")
    assert {tuple(r) for r in got.collect()} == {("s", 1, 2, 2, None), ("s", 3, 2, 2, None)}
    assert not any(str(tmp_path) in f for f in got.inputFiles())


def test_sectioned_files_hold_many_samples(spark):
    got = QUERIES["A01_read_sectioned"](spark, "/root/testdata/sf0.01")  # 100 suppliers of 25 nations
    assert got.count() == 300 and len(got.inputFiles()) <= 25


def test_every_quantity_above_the_limit(spark):
    df = spark.createDataFrame([("f",
        "1 M tamoxifen, then 2 mM tamoxifen or 1 M of tamoxifen; 5 M sodium chloride is something else altogether, as are 3 nM tamoxifen")],
            "field string, text string")
    names = spark.createDataFrame([("tamoxifen",)], "name string")
    got = {(r.amount, r.unit) for r in checks.dose_above_limit(df, ["field"], "text", 1e5, names).collect()}
    assert got == {(1.0, "M"), (2.0, "mM")}


def test_doses_over_line_breaks_and_by_study(spark):
    texts = [("s1", "50 mM\nof tamoxifen"), ("s1", "60 mM of E2"), ("s2", "70 mM of tamoxifen"), ("s2", "80 mM of E2"),
        ("s2", "90 mM of e2"), ("s1", "3 M " + "x" * 37 + " tamoxifen"), ("s1", "4 M Tamoxifen (x"), ("s1", "5 M 4-OHT+ later"),
            ("s1", "6 M pre-tamoxifen"), ("s1", None)]
    df = spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(texts)], "study string, i int, text string")
    names = spark.createDataFrame([("s1", "tamoxifen"), ("s2", "E2"), ("s1", "4-OHT+"), (None, "of"), ("s1", None)], "study string, name string")
    got = {(r.i, r.amount, r.name) for r in checks.dose_above_limit(df, ["i"], "text", 1e5, names, "study").collect()}
    assert got == {(0, 50.0, "tamoxifen"), (3, 80.0, "E2"), (6, 4.0, "tamoxifen"), (7, 5.0, "4-OHT+")}


def test_representative_ties_and_nulls(spark):
    df = spark.createDataFrame([("s", "e", 2, 1.0), ("s", "e", 1, 1.0), ("s", "f", 3, None), ("s", "f", 4, 0.1)],
        "study_id string, entity string, feature_id int, mean double")
    assert {r.feature_id for r in identity.choose_representative(df, ["study_id", "entity"]).where("chosen").collect()} == {1, 4}


def test_modal_size_takes_the_largest_of_a_tie(spark):
    df = spark.createDataFrame([("s", c) for c in "aabbccd" + "e"], "study string, c string").where("c <> 'z'")
    few = checks.fewer_replicates(df, "study", ["c"]).collect()
    assert {(r.c, r.n, r.usual) for r in few} == {("d", 1, 2), ("e", 1, 2)}


def test_fingerprint_ignores_row_order_and_partitions(spark):
    df = spark.range(1000).selectExpr("id", "nullif(id % 7, 0) as v")
    one = constraints.fingerprint(df).first()
    assert constraints.fingerprint(df.orderBy(F.desc("id")).repartition(13)).first() == one
    assert constraints.fingerprint(df.where("id <> 5")).first() != one


def test_fingerprints_tell_separators_and_nulls_apart(spark):
    schema = "a string, b string"
    tables = [[("x\x1fy", "z")], [("x", "y\x1fz")], [(None, "z")], [("\x00", "z")], [("-", "z")], [("", "z")], [("xz", "")], [("x", "z")],
        [("z", "x")], [("x", "z")] * 2, []]
    got = [constraints.fingerprint(spark.createDataFrame(t, schema)).first().fingerprint for t in tables]
    assert len(set(got)) == len(tables)
    assert constraints.fingerprint(spark.createDataFrame([("x", "z")], "a string, c string")).first().fingerprint not in got
    nested = [constraints.fingerprint(spark.createDataFrame([(x,)], "a array<string>")).first()
        .fingerprint for x in (["a, b"], ["a", "b"], [None], ["null"], None)]
    assert len(set(nested)) == 5


def test_fingerprints_of_parts_add_up(spark):
    df = spark.range(500).selectExpr("id % 40 as a", "cast(id % 7 as string) as b")
    lanes = lambda where, sign: constraints.content_lanes(df.where(where)).withColumn("sign", F.lit(sign))
    parts = lanes("a < 30", 1).unionByName(lanes("a >= 20", 1)).unionByName(lanes("a between 20 and 29", -1)).unionByName(lanes("a < 0", 1))
    assert constraints.combined_lanes(parts, sign="sign").first() == constraints.content_lanes(df).first()


def test_write_log_of_records_children_and_replicates(spark):
    program = {
        "defaults": {"role": {"value": "unknown", "location": "methods"}, "replicate": {}},
        "names": {"child": {"oht": "OHT", "4-OHT": "OHT"}, "line": {"mcf7": "MCF-7"}},
        "rules": [
            {"name": "treated", "when": {"title": "OHT"}, "set": {"role": "treated", "line": "mcf7"}, "location": "title",
                "children": [{"key": "oht", "dose": "1"}]},
            {"name": "again", "when": {"title": "twice"}, "set": {"line": "mcf8"}, "children": [{"key": "4-OHT", "dose": "2"}]},
            {"name": "none", "when": {"title": "washed"}, "set": {"role": None}, "clear_children": True, "children": [{"key": "lost", "dose": "3"}]},
        ],
        "records": {"2": {"role": "fixed"}, "3": {"name": "by hand", "location": "letter", "set": {"replicate": "7"},
            "clear_children": True, "children": [{"key": "oht", "dose": "9"}], "note": "asked"}},
    }
    rows = [(1, "OHT"), (2, "OHT twice"), (3, "OHT"), (4, "OHT washed"), (5, "plain")]
    df = spark.createDataFrame([(i, {"title": t}) for i, t in rows], "id int, labels map<string,string>")
    table = rules.apply_rules(df, program, "id")
    assert {r.id: (r.role, r.line, r.replicate, r.note) for r in table.collect()} == {1: ("treated", "MCF-7", None, None),
        2: ("fixed", None, None, None), 3: ("treated", "MCF-7", "7", "asked"), 4: (None, "MCF-7", None, None), 5: ("unknown", None, None, None)}
    assert {(r.id, r.child, r.pos, r.dose) for r in rules.emit_children(df, program, "id", "id").collect()} == {(1, "OHT", 0, "1"),
        (2, "OHT", 1, "2"), (3, "OHT", 4, "9")}
    assert {(r.id, r.field, r.spelling, r.rule) for r in rules.unresolved_names(df, program, "id", "id")
        .collect()} == {(2, "line", "mcf8", "again"), (4, "child", "lost", "none")}
    numbered = rules.assign_replicates(table.withColumn("replicate", F.col("replicate").cast("int")), ["role"], "id")
    log = rules.provenance(df, program, "id", "id", numbered).collect()
    stands = {(r.entity, r.field): (r.value, r.rule, r.location) for r in log if not r.superseded}
    assert len(stands) == sum(not r.superseded for r in log)
    assert stands[("2", "role")] == ("fixed", "record 2", None) and stands[("4", "role")] == (None, "none",
        None) and stands[("1", "replicate")] == ("1", "assigned", None) and stands[("3", "replicate")] == ("7", "by hand", "letter")
    assert stands[("2|OHT", "dose")] == ("2", "again", None) and stands[("3|OHT", "dose")] == ("9", "by hand", "letter") and ("4|OHT",
        "dose") not in stands and stands[("5", "role")] == ("unknown", "default", "methods")
    assert {(r.entity, r.rule, r.spelling) for r in log if r.superseded and r.kind == "child"} == {("2|OHT", "treated", "oht"),
        ("3|OHT", "treated", "oht"), ("4|OHT", "treated", "oht")}
    again = rules.current_values(spark.createDataFrame(log, rules.provenance(df, program, "id", "id", numbered).schema),
        ["role", "line", "replicate"])
    assert {r.entity: (r.role, r.line) for r in again.collect()} == {str(r.id): (r.role, r.line) for r in table.collect()}
    assert {r.rule for r in constraints.explain_value(rules.provenance(df, program, "id", "id"), "3").collect()} == {"default", "treated", "by hand"}


def test_programs_without_rules_or_children(spark):
    df = spark.createDataFrame([(1, {"t": "x"})], "id int, labels map<string,string>")
    for program in ({"rules": []}, {"rules": [{"name": "a", "when": {"t": "x"}, "set": {"f": "1"}}]}, {}):
        assert rules.emit_children(df, program, "id").count() == 0 and rules.unresolved_names(df, program, "id").count() == 0
        assert rules.provenance(df, program, "id").count() == len(program.get("rules", [])) and rules.apply_rules(df, program).count() == 1


def test_surrogate_ids_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id % 50 as a", "id as b")
    want = [(r.a, r.b) for r in df.orderBy("a", "b").collect()]
    for n in (1, 13):
        got = constraints.surrogate_id(df.repartition(n), ["a", "b"], rows=60).orderBy("id").collect()
        assert [(r.a, r.b) for r in got] == want and [r.id for r in got] == list(range(1, 501))


def test_items_are_normalized(spark):
    want = {"growth": "growth", " 24 h": "24", "gsm12": "GSM12", "3.0": "3", "1,000": "1000", "1,234.56789 nM": "1234.5679",
        "0.00012": "0.0001", "-2.50": "-2.5", "5 %": "5 %", "MCF7": "mcf7", "10 uM": "10 um",
            "17beta-estradiol (E2)": "estradiol", "E2 (anything)": "estradiol", "Name (code)": "name (code)", "e2": "estradiol",
                "1e3": "1000"}
    aliases = spark.createDataFrame([("E2", "estradiol"), ("estradiol", "estradiol")], "alias string, name string")
    df = spark.createDataFrame([(x, "kept") for x in [*want, None]], "x string, item string")
    got = {r.x: r.new for r in grading.normalized(df, "x", aliases, "new").collect()}
    assert got == want | {None: None}


def test_answers_become_items(spark):
    answer = '{"a": {"x": ["u", "v"], "none": 0}, "b": ["GSE1: 1,000", "plain"], "c": 5, "d": {"GSE1": "2.0 h"}, "e": null}'
    df = spark.createDataFrame([(1, "q", answer), (2, "q", "not json"), (3, "q", None)], "id int, question string, answer string")
    none = spark.createDataFrame([], "alias string, name string")
    got = {(r.part, r.item) for r in grading.answer_items(df, ["id"], none).collect()}
    assert got == {("a", "x: u"), ("a", "x: v"), ("a", "none: 0"), ("b", "GSE1: 1000"), ("b", "plain"), ("c", "5"), ("d", "GSE1: 2")}
    parts = spark.createDataFrame([("q", "d.GSE1"), ("q", "a.x"), ("q", "a.gone")], "question string, part string")
    assert {(r.part, r.item) for r in grading.answer_items(df, ["id"], none, parts=parts).collect()} == {("d.GSE1", "2"), ("a.x", "u"), ("a.x", "v")}


KEY = "question string, part string, kind string, expected array<string>, tolerance double"


def grades(spark, key, answers, **more):
    """id -> (correct, n_passed) of the answers to question q."""
    none = spark.createDataFrame([], "alias string, name string")
    ans = spark.createDataFrame([(i, "q", a) for i, a in answers.items()], "id int, question string, answer string")
    return {r.id: (r.correct, r.n_passed) for r in grading.grade(ans, spark.createDataFrame([("q", *k) for k in key], KEY), ["id"], none,
        **more).collect()}


def test_zeros_count_only_if_expected(spark):
    key = [("p", "exact_list", ["a: 1", "b: 0"], 0.0)]
    got = grades(spark, key, {1: '{"p": ["a: 1", "b: 0", "c: 0"]}', 2: '{"p": ["a: 1"]}', 3: '{"p": {"a": 1, "b": 0, "c": 2}}'})
    assert got == {1: (True, 1), 2: (False, 0), 3: (False, 0)}


def test_a_missing_part_fails(spark):
    key = [("p", "exact_number", ["1"], 0.0), ("r", "exact_list", ["a", "b"], 0.0)]
    assert grades(spark, key, {1: '{"p": "1.0", "r": ["b", "a"]}', 2: '{"p": 1}'}) == {1: (True, 2), 2: (False, 1)}


def test_answers_that_say_nothing_fail(spark):
    key = [("v", "exact_list", ["a"], 0.0), ("n.x", "exact_number", ["5"], 0.0)]
    bad = {1: None, 2: "", 3: "not json", 4: "{}", 5: "[]", 6: '"a"', 7: '{"v": []}', 8: '{"v": "[odd"}',
        9: '{"v": null, "n": {"x": null}}', 10: '{"n": 5}', 11: "null", 12: '{"v": {}}'}
    assert grades(spark, key, bad) == {i: (False, 0) for i in bad}
    assert grades(spark, [("v", "exact_list", [], 0.0)], {1: '{"v": []}', 2: "{}", 3: '{"v": ["x: 0"]}'}) == {1: (True, 1), 2: (False, 0),
        3: (True, 1)}
    assert grades(spark, [("v", "exact_list", ["[odd"], 0.0)], {1: '{"v": "[odd"}', 2: '{"v": ["[odd"]}'}) == {1: (True, 1), 2: (True, 1)}


def test_numbers_are_compared_as_they_are(spark):
    exact = [("v", "exact_number", ["12"], 0.0)]
    forms = {'"12 h"': False, '"12"': True, "12": True, "12.0": True, "1.2e1": True, '" 12 "': True, '"1,2"': True, '"twelve"': False,
        "true": False, "[12]": False, '{"a": 12}': False, "12.00001": False, '""': False}
    assert grades(spark, exact, {i: f'{{"v": {x}}}' for i, x in enumerate(forms)}) == {i: (ok, int(ok)) for i, ok in enumerate(forms.values())}
    assert grades(spark, [("v", "tolerance", ["0.00003"], 0.00002)], {1: '{"v": 0.00004}', 2: '{"v": 0.00006}'}) == {1: (True, 1), 2: (False, 0)}
    assert grades(spark, [("v", "exact_number", ["1.2346"], 0.0)], {1: '{"v": 1.23456}', 2: '{"v": "1.2346"}'}) == {1: (False, 0), 2: (True, 1)}


def test_texts_with_a_given_beginning_are_no_pairs(spark):
    key = [("v", "exact_list", ["not stated:x"], 0.0)]
    answer = {1: '{"v": ["Not stated:x"]}'}
    assert grades(spark, key, answer, whole=["not stated:"]) == {1: (True, 1)} and grades(spark, key, answer) == {1: (False, 0)}


def test_questions_without_a_key_have_no_grade(spark):
    none = spark.createDataFrame([], "alias string, name string")
    ans = spark.createDataFrame([(1, "other", "{}")], "id int, question string, answer string")
    assert grading.grade(ans, spark.createDataFrame([("q", "v", "exact_number", ["1"], 0.0)], KEY), ["id"], none).count() == 0


def test_cpm_adds_up_and_empty_samples_are_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("z", 0.0)], "sample_id string, raw_value double")
    m = scaling.log_cpm(df, scaling.library_size(df))
    assert m.where("sample_id = 'z'").first().value is None
    assert abs(scaling.cpm_closure(m.where("value is not null")).first().least - 1e6) < 1e-3


def test_sections_keep_odd_separators_and_bind_samples(spark, tmp_path):
    text = '!Series_title\t"a\x0bb\u2028c\x85d"\r\n!Sample_geo_accession\t"S2"\t"S1"\n!Sample_note\t"two"\t"one"\n!series_matrix_table_begin\nID_REF\tS1\tS2\nf\t1\t2\n!series_matrix_table_end\n'
    odd = text.replace("ID_REF\tS1\tS2", "ID_REF\tS1\tS3")
    for name, x in (("a", text), ("b", odd)):
        (tmp_path / name).write_text(x, newline="")
    rows = files.read_sectioned(spark, str(tmp_path)).withColumn("path", F.substring("path", -1, 1))
    assert [r.value for r in rows.where("path = 'a' and section = 'series'").collect()] == ["a\x0bb\u2028c\x85d"]
    bound, misfits = files.bind_samples(rows)
    assert {(r.field, r.sample_id, r.value) for r in bound.where("path = 'a' and field <> 'geo_accession'")
        .collect()} == {("note", "S1", "one"), ("note", "S2", "two"), ("f", "S1", "1"), ("f", "S2", "2")}
    assert [(r.path, r.n_listed, r.n_columns) for r in misfits.collect()] == [("b", 2, 2)]


def test_chunks_of_large_files(spark, tmp_path):
    data = {"a.bin": b"x" * 95 + b"y", "b.bin": b"", "c.bin": b"z" * 40}
    for name, x in data.items():
        (tmp_path / name).write_bytes(x)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("path")
    got = files.chunk_digests(spark, f"{tmp_path}/*.bin", 40).withColumn("path", name)
    want = {(n, k, hashlib.sha256(x[40 * k : 40 * k + 40]).hexdigest()) for n, x in data.items() for k in range(max(1, -(-len(x) // 40)))}
    assert {(r.path, r.chunk, r.sha256) for r in got.collect()} == want
    assert {r.sha256 for r in files.source_manifest(spark, f"{tmp_path}/*.bin").collect()} == {hashlib.sha256(x).hexdigest() for x in data.values()}
    tree = {r.path: (r.n_chunks, r.size_bytes, r.tree_sha256) for r in files.tree_digests(got).collect()}
    assert tree["a.bin"] == (3, 96, hashlib.sha256("".join(h for n, _, h in sorted(want) if n == "a.bin").encode()).hexdigest())
    kept = spark.createDataFrame(got.collect(), got.schema)
    (tmp_path / "a.bin").write_bytes(b"x" * 50 + b"!" + b"x" * 80)
    (tmp_path / "c.bin").unlink()
    after = files.chunk_digests(spark, f"{tmp_path}/*.bin", 40).withColumn("path", name)
    assert {(r.path, r.chunk, r.change) for r in files.chunk_diff(kept, after).collect()} == {("a.bin", 1, "changed"),
        ("a.bin", 2, "changed"), ("a.bin", 3, "added"), ("c.bin", 0, "removed")}


def test_surrogate_ids_of_texts_nulls_and_ties(spark):
    rows = [(None if i % 11 == 0 else "same" if i % 3 else f"t{i % 7}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b int")
    want = [(r.a, r.b) for r in df.orderBy("a", "b").collect()]
    got = constraints.surrogate_id(df.repartition(5), ["a", "b"], rows=40).orderBy("id").collect()
    assert [(r.a, r.b) for r in got] == want and [r.id for r in got] == list(range(1, 301))
    assert constraints.surrogate_id(df.limit(0), ["a", "b"]).count() == 0


def test_surrogate_ids_of_repeated_rows(spark):
    """A row that makes up most of the table is dealt among ranges; ties go by the other columns, alike for any partitions."""
    df = spark.range(4000).selectExpr("if(id % 4 = 0, id div 40, 7) as a", "if(id % 4 = 0, id, 1) as b", "if(id % 9 = 0, array(id % 3), null) as c")
    one, two = (constraints.surrogate_id(df.repartition(n), ["a"], rows=100) for n in (1, 9))
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, two.collect())) and sorted(r.id for r in one.collect()) == list(range(1, 4001))
    assert one.groupBy("a").agg(F.max("id").alias("last"), F.min("id").alias("first"),
        F.count(F.lit(1)).alias("n")).where("last - first + 1 <> n").count() == 0


def test_medians_are_exact(spark):
    df = spark.range(40_000).selectExpr("nullif(id % 4, 0) as k",
        "case when id % 4 = 1 then 7 when id % 4 = 2 then pmod(hash(id), 1000) / 8 when id % 4 = 3 and id < 8 then id when id % 4 = 0 then hash(id) end as v")
    want = {r.k: r.m for r in df.groupBy("k").agg(F.median("v").alias("m")).collect()}
    assert {r.k: r.v_median for r in scaling.value_summary(df, ["k"], "v").collect()} == want


def test_ordered_bits_keep_order_and_value(spark):
    import struct

    from pyspark.sql import types as T

    rng, values = __import__("random").Random(3), [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308,
        1.7976931348623157e308, float("inf"), -float("inf"), float("nan"), 1.0, 0.1, 1 / 3, -7.25]
    values += [2.0**e * k for e in range(-1074, 1024, 7) for k in (1, -1)] + [x for e in (-1022, -3, 0, 52, 1023) for x in (2.0**e,
        2.0**e * (1 + 2**-52), 2.0**e * (2 - 2**-52))]
    values += [x for _ in range(2000) for x in struct.unpack("d", rng.randbytes(8)) if x == x]
    df = spark.createDataFrame([(x,) for x in values], T.StructType([T.StructField("x", T.DoubleType())]))
    bits = scaling.ordered_bits(F.col("x"))
    got = df.select("x", bits.alias("b"), scaling.double_of(bits).alias("y")).collect()
    assert all(repr(r.x) == repr(r.y) or r.x == r.y == 0 for r in got)
    assert all(r.b == (n if n >= 0 else -(n & (1 << 63) - 1)) for r in got if r.x == r.x for n in struct.unpack("q", struct.pack("d", r.x)))


def test_medians_of_odd_groups(spark):
    df = spark.createDataFrame([("one", 5.0), ("two", 1.0), ("two", 2.0), ("null", None), (None, -3.0), (None, -1.0), (None, 7.0),
        ("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)] + [("hot", 4.5)] * 500 + [("hot", 9.0)] * 499, "k string, v double")
    assert {r.k: r["median"] for r in scaling.group_median(df, ["k"], "v").collect()} == {"one": 5.0, "two": 1.5, None: -1.0, "inf": 2.0, "hot": 4.5}
    assert scaling.group_median(df.where("k = 'two'"), [], "v").first()["median"] == 1.5 and scaling.group_median(df.limit(0), ["k"],
        "v").count() == 0


def test_correlation_in_tiles_equals_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (9, 60)) + np.linspace(0, 3, 60) * rng.normal(size=(9, 1))
    x[8] = 1e6 + 1  # no spread
    has = rng.random(x.shape) < 0.7
    rows = [("g", f"s{i}", f"f{j}", float(x[i, j]) if has[i, j] else None) for i in range(9) for j in range(60)] + [("h", "s1", "f1", 2e6),
        (None, "s1", "f1", 2e6), (None, "s2", "f1", 2e6), ("g", None, "f1", 2e6)]
    df = spark.createDataFrame(rows, "k string, s string, f string, v double")
    pairs = profile.sample_correlation(df, "s", "f", "v", 0.0, ["k"], tile=2, block=7)
    got = {(r.k, r.a, r.b): (r.r, r.n_features) for r in pairs.collect()}
    want = {}
    for i in range(9):
        for j in range(i + 1, 9):
            both = has[i] & has[j]
            want[("g", f"s{i}", f"s{j}")] = (None if j == 8 else float(np.corrcoef(x[i, both], x[j, both])[0, 1]), int(both.sum()))
    want[(None, "s1", "s2")] = (None, 1)
    assert got.keys() == want.keys()
    assert all(got[k][1] == n and (r is None and got[k][0] is None or abs(got[k][0] - r) < 1e-6) for k, (r, n) in want.items())
    groups = spark.createDataFrame([("p", "s0"), ("p", "s1"), ("q", "s2"), ("q", "s1"), ("r", "s8")], "group string, s string")
    mean = {(r.group_a, r.group_b): r.n_pairs for r in profile.correlation_of_groups(pairs.where("k = 'g'"), groups, "s").collect()}
    assert mean == {("p", "p"): 1, ("p", "q"): 3, ("q", "q"): 1}


def test_correlation_of_groups_without_pairs_equals_that_of_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x, has = rng.normal(size=(40, 6)) + 5, rng.random((40, 6)) < 0.9
    x[7], has[7], x[8, :4], has[8] = 3.1, True, 0.1 + 3, [True] * 4 + [False] * 2  # without spread, whole and in part
    df = spark.createDataFrame([("g" if i < 30 else None, f"s{i}", j, float(x[i, j])) for i in range(40) for j in range(6) if has[i, j]],
        "k string, s string, f int, v double")
    groups = spark.createDataFrame([(g, f"s{i}") for i in range(38) for g in ("p", "q", "all") if g == "all" or (i % 3 == 0) == (g == "p") or i == 4],
        "group string, s string")
    for tile in (2, 7, 1000):  # many tiles, some, one
        pairs = profile.sample_correlation(df, "s", "f", "v", 0.0, ["k"], tile=tile, block=6)
        want = {r[:3]: (round(r.mean_r, 9), r.n_pairs) for r in profile.correlation_of_groups(pairs.where("n_features > 2"), groups, "s", ["k"]).collect()}
        made = profile.group_correlation(df, groups, "s", "f", "v", 0.0, ["k"], 3, tile, 6)
        assert {r[:3]: (round(r.mean_r, 9), r.n_pairs) for r in made.collect()} == want and len(want) == 12
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # tiles are sent, pairs aren't


def test_headers_of_several_lines_and_bodies_like_them(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,,"l\n1",l2\nid,name,S1,S2\nid,name,S1,S2\nr1,"a,b",1,\n\nx,,l2,3\nr2,c,4\n')
    (tmp_path / "b.csv").write_text("x,,m1\nid,name,S1\nr9,z,8,9\n")
    labels, long = files.read_multi_header(spark, str(tmp_path), 1, 2)
    assert {(r.path[-5:], r.sample_id, r.label, r.value) for r in labels.collect()} == {("a.csv", "S1", "label_1", "l\n1"),
        ("a.csv", "S2", "label_1", "l2"), ("b.csv", "S1", "label_1", "m1")}
    got = {(r.path[-5:], r.line, r.id, r.name, r.sample_id, r.value) for r in long.collect()}
    a = [(4, "id", "name", "S1", None), (4, "id", "name", "S2", None), (5, "r1", "a,b", "S1", 1.0), (5, "r1", "a,b", "S2", None),
        (7, "x", "", "S1", None), (7, "x", "", "S2", 3.0), (8, "r2", "c", "S1", 4.0), (8, "r2", "c", "S2", None)]
    assert got == {("a.csv", *r) for r in a} | {("b.csv", 3, "r9", "z", "S1", 8.0)}
    (tmp_path / "c.csv").write_text("x,,m1,m2\nid,name,S1,S1\n")
    with pytest.raises(ValueError, match="repeat"):
        files.read_multi_header(spark, str(tmp_path), 1, 2)


def test_every_record_of_a_repeated_title_names_others(spark):
    rows = [("s", i, f"same (run {i})", "b1" if i < 9 else "b2") for i in range(12)] + [("s", 50, "pair", "b1"),
        ("s", 51, "pair (run 3)", "b1"), ("s", 52, "alone", "b1"), (None, 60, "same", "b1"), (None, 61, "same", "b1"),
            ("s", 70, None, "b1"), ("s", 71, None, "b1")]
    got = {r.i: (r.kind, r.n_others, r.others) for r in checks.duplicate_title_records(spark
        .createDataFrame(rows, "s string, i int, t string, b string"), "s", "i", "t", "b", r"\s*\(run \d+\)$", 3).collect()}
    assert got[0] == ("across batches", 11, [1, 2, 3]) and got[2] == ("across batches", 11, [0, 1, 3]) and got[11] == ("across batches",
        11, [0, 1, 2])
    assert got[50] == ("within batch", 1, [51]) and got[61] == ("within batch", 1, [60]) and 52 not in got and 70 not in got


def test_inventory_tags_come_from_programs(spark):
    programs = {"p": {"rules": [{"name": "a", "inventory": "M1"}, {"name": "b"}],
        "records": {"1": {"name": "c", "inventory": "M2", "set": {}}, "2": {"role": "x"}}}, "q": {"rules": [{"name": "d", "inventory": "M1"}]}}
    assert {(r.id, r.fixed_by) for r in checks.program_tags(spark, programs).collect()} == {("M1", "p: a"), ("M2", "p: c"), ("M1", "q: d")}
    assert checks.program_tags(spark, {}).count() == 0


def test_ladders_by_study(spark):
    f = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "x", None), ("a", 3, "y", None), ("a", 4, "z", "probe"), ("a", 5, None, None),
        ("a", 6, "w", None), ("a", 6, "w", None)], "study string, n int, name string, s string")
    by_n = spark.createDataFrame([(1, "n1"), (2, "n2"), (4, "n4"), (6, "n6"), (6, "other")], "key int, id string")
    by_name = spark.createDataFrame([("x", "named", None), ("y", "only b", "b"), ("w", "w1", "a"), ("w", "w1", "a")],
        "key string, id string, study string")
    ladder = [("number", "n", by_n), ("name", "name", by_name)]
    got = {r.n: (r.id, r.method, r.status) for r in identity.map_entities(f, ladder, F.col("s"), "study", {"b": ["number"]}).collect()}
    assert got == {1: ("n1", "number", "mapped"), 2: ("named", "name", "mapped"), 3: (None, None, "unmapped"), 4: (None, None, "probe"),
        5: (None, None, "unmapped"), 6: ("w1", "name", "mapped")}
    assert [(r.method, r.key, r.n_ids) for r in identity.repeated_keys(ladder, "study").collect()] == [("number", "6", 2)]


def test_compared_sets_share_samples(spark):
    v = spark.createDataFrame([(1, "g", 4.0), (2, "g", 1.0), (3, "g", 2.0), (1, "h", 1.0)], "s int, e string, v double")
    m = spark.createDataFrame([("c1", "treated", 1), ("c1", "treated", 1), ("c1", "control", 2), ("c1", "control", 3), ("c2", "treated", 3),
        ("c2", "control", 2), ("c3", "treated", 1)], "comparison string, side string, s int")
    got = {r.e: (r.c1, r.c2, r.c3) for r in cohort.compared_sets(v, m, "s", "e", "v", ["c1", "c2", "c3"]).collect()}
    assert got == {"g": (2.5, 1.0, None), "h": (None, None, None)}
    assert {(r.comparison, r.n_treated, r.n_control) for r in cohort.comparison_members(m, "s").collect()} == {("c1", 1, 2), ("c2", 1, 1),
        ("c3", 1, 0)}


def test_unpivot_drops_or_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert files.unpivot_matrix(df, ["id"], ["a", "b"]).count() == 1
    assert files.unpivot_matrix(df, ["id"], ["a", "b"], keep_nulls=True).count() == 2


def test_sections_of_a_file_that_many_tasks_read(spark, tmp_path):
    """Split into blocks of a few lines or gzipped in one piece, a file reads alike."""
    import gzip

    head = '!Series_title\t"a ""b"" c"\n\n!Sample_geo_accession\t"S1"\t"S2"\n!Sample_note\t"x\ty"\t\n!Sample_note\t"p"\t"q"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n'
    text = head + "".join(f"f{i}\t{i}\t{-i}\n\n" for i in range(3000)) + "!series_matrix_table_end\nnot in a table\n!Series_note\tlast\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "x.txt").write_text(text)
    (tmp_path / "x.txt.gz").write_bytes(gzip.compress(text.encode()))
    want = [("series", 1, "title", 0, 'a "b" c'), ("sample", 3, "geo_accession", 0, "S1"), ("sample", 3, "geo_accession", 1, "S2"),
        ("sample", 4, "note", 0, "x\ty"), ("sample", 4, "note", 1, ""), ("sample", 5, "note", 0, "p"), ("sample", 5, "note", 1, "q")]
    want += [("header", 7, "ID_REF", 0, "S1"), ("header", 7, "ID_REF", 1, "S2"),
        *(("table", 8 + 2 * i, f"f{i}", k, str(i * (1 - 2 * k))) for i in range(3000) for k in (0, 1)), ("series", 6010, "note", 0, "last")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        assert spark.read.text(f"{tmp_path}/plain").rdd.getNumPartitions() > 5
        for at in ("plain", "x.txt.gz"):
            got = sorted((r.section, r.line, r.field, r.column, r.value) for r in files.read_sectioned(spark, f"{tmp_path}/{at}").collect())
            assert got == sorted(want)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bundles_skip_foreign_members_and_report_gaps(spark, tmp_path, monkeypatch):
    import gzip
    import io
    import tarfile

    members = {"S1_x.txt": "id\tn\tm\nk1\t1\t\nk2\t2\t\n", "S2_x.txt": "id\tn\tm\nk1\t1\t\nk2\t3\t\n",
        "S3_x.txt": "id\tn\tm\nk2\t1\t\nk1\t9\t\n", "S4_x.txt": b"\x1f\x8bbroken",
            "d/S5_x.txt.gz": gzip.compress(b'id\tn\nk1\t"a\nb"\nk2\t1\t2\t3\n'), "S6.txt": "", "S7.txt": "id\tn\tm\n"}
    with tarfile.open(tmp_path / "b.tar", mode="w") as tar:
        for name, text in members.items():
            body = text if isinstance(text, bytes) else text.encode()
            info = tarfile.TarInfo(name)
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
        tar.addfile(tarfile.TarInfo("S9_dir"))
    with tarfile.open(tmp_path / "none.tar", mode="w"):
        pass
    (tmp_path / "other.txt").write_text("x")
    keep = spark.createDataFrame([(f"S{i}",) for i in (1, 2, 3, 5, 6, 7, 8)], "sample_id string")
    got = files.read_bundle(spark, str(tmp_path), keep)
    assert {(r.sample_id, r.row, r.row_key, r.field, r.value) for r in got["rows"].where("sample_id in ('S1', 'S5')").collect()} == {
        ("S1", 1, "k1", "n", "1"), ("S1", 1, "k1", "m", ""), ("S1", 2, "k2", "n", "2"), ("S1", 2, "k2", "m", ""),
            ("S5", 1, "k1", "n", "a\nb"), ("S5", 2, "k2", "n", "1"), ("S5", 2, "k2", "#2", "2"), ("S5", 2, "k2", "#3", "3")}
    assert {r.member for r in got["skipped"].collect()} == {"S4_x.txt", "S9_dir"} and [r.sample_id for r in got["missing"].collect()] == ["S8"]
    assert {r.member for r in got["empty"].collect()} == {"S6.txt", "S7.txt"}
    assert {(r.member, r.what) for r in got["odd"].collect()} == {("S3_x.txt", "row keys"), ("d/S5_x.txt.gz", "columns")}
    assert files.read_bundle(spark, str(tmp_path / "none.tar"), keep)["missing"].count() == 7


def test_manifest_of_large_files(spark, tmp_path):
    for name, data in (("a.bin", b"x" * 50), ("b.bin", b"y" * 50), ("c.bin", b"z")):
        (tmp_path / name).write_bytes(data)
    before = files.source_manifest(spark, f"{tmp_path}/*.bin", 10)
    got = {r.path.rsplit("/", 1)[1]: (r.sha256, r.size_bytes, r.kind) for r in before.collect()}
    assert got == {n: (hashlib.sha256((tmp_path / n).read_bytes()).hexdigest(), (tmp_path / n).stat().st_size, "bin") for n in ("a.bin",
        "b.bin", "c.bin")}
    kept = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "b.bin").write_bytes(b"Y" * 50)
    after = files.source_manifest(spark, f"{tmp_path}/*.bin", 10)
    assert [(r.path.rsplit("/", 1)[1], r.change) for r in files.manifest_diff(kept, after).collect()] == [("b.bin", "changed")]
    blind = kept.withColumn("sha256", F.lit(None).cast("string"))
    assert {r.change for r in files.manifest_diff(kept, blind).collect()} == {"unknown"}
    assert {r.change for r in files.manifest_diff(blind, blind.withColumn("size_bytes", F.col("size_bytes") + 1)).collect()} == {"changed"}
    with pytest.raises(Exception, match="more than 10 bytes"):
        files.contents(spark, f"{tmp_path}/*.bin", 10).collect()
    assert files.contents(spark, f"{tmp_path}/*.bin", 50).count() == 3


def test_large_files_are_hashed_range_by_range(spark, tmp_path, monkeypatch):
    sizes = (0, 1, 63, 64, 65, 130, 1000)
    for n in sizes:
        (tmp_path / f"{n}.bin").write_bytes(bytes(k % 251 for k in range(n)))
    want = {(f"{n}.bin", n, hashlib.sha256(bytes(k % 251 for k in range(n))).hexdigest()) for n in sizes}
    for size in (50, 64, 2000):  # 20 ranges: some digests are kept between
        got = files.source_manifest(spark, f"{tmp_path}/*.bin", 0, size).collect()
        assert {(r.path.rsplit("/", 1)[1], r.size_bytes, r.sha256) for r in got} == want and len(got) == len(want)

    fed, feed = [], bundles._fed
    monkeypatch.setattr(bundles, "_fed", lambda digest, path, at, size: fed.append((at, size)) or feed(digest, path, at, size))
    for found, reads in ((bundles.openssl(), [(0, 64), (64, 64), (128, 2)]), (None, [(0, 130)])):
        monkeypatch.setattr(bundles, "openssl", lambda found=found: found)
        batch = bundles.pa.RecordBatch.from_pylist([{"path": str(tmp_path / "130.bin"), "size_bytes": 130}], schema=bundles.HASHED)
        for k in range(3):
            (batch,) = bundles.range_taken_up(k, 64)([batch])
        assert {("130.bin", 130, batch["sha256"][0].as_py())} <= want and fed == reads
        fed.clear()


def test_manifest_has_every_table(spark):
    got = {r.path for r in QUERIES["A06_source_manifest"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {f"{t}.parquet" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()}


def test_alias_seen_as_a_whole_and_in_its_study(spark):
    texts = spark.createDataFrame([("S1", "with 4-OH tamoxifen, MCF7+E2 and OH-Tam."), ("S2", "tamoxifen 4 OH; the E2 dose (ICI 182,780)"),
        ("S3", None), ("S3", "")], "study string, text string")
    rows = [("S1", "4-OH tamoxifen"), ("S1", "OH-Tam"), ("S2", "OH-Tam"), ("S1", "+E2"), ("S2", "+E2"), ("S2", "ICI 182,780"),
        ("S2", "(ICI 182,780)"), ("S2", "4-OH"), ("S2", "ICI 182"), ("S1", "amoxifen"), ("S1", "e2"), ("S3", "e2"), ("S1", "+"), ("S2", "+")]
    aliases = spark.createDataFrame(rows, "study string, alias string")
    got = {(r.study, r.alias) for r in identity.alias_seen(aliases, texts, study="study").collect()}
    assert got == {("S2", "OH-Tam"), ("S2", "+E2"), ("S2", "4-OH"), ("S1", "amoxifen"), ("S3", "e2"), ("S2", "+")}
    assert {r.alias for r in identity.alias_seen(aliases.select("alias"), texts).collect()} == {"amoxifen"}
