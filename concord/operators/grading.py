"""Grading of answers against a key, reconciliation of two routes, and summaries of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.operators.identity import bounded

#: Units that an answer may carry behind its number, and the prefixes of record ids.
UNIT = r"(?i)(?<=\d)\s*(?:nm|nanomolar|h|hr|hrs|hours)\s*$"
IDS = r"(?i)^(?:gsm|gse)\d+$"
NUMBER = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?$"
#: Fixed value: a name with a code in brackets behind it.
HALVES = r"^(.+?)\s*\((.+)\)$"


def _trimmed(item: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(item), UNIT, ""), r"\.0+$", "")


def normalize_item(item: Column) -> Column:
    """Trimmed, without a unit after a digit or a trailing .0; record ids in capitals; numbers without thousands
    separators, whole or rounded to four places; other text in lower case."""
    x = _trimmed(item)
    bare = F.replace(x, F.lit(","), F.lit(""))
    number = F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    whole = number.try_cast("decimal(38,0)").cast("string")
    part = F.regexp_replace(F.regexp_replace(F.round(number, 4).try_cast("decimal(38,4)").cast("string"), r"(?<=\.\d{0,4}?)0+$", ""), r"\.$", "")
    text = F.when(number == F.floor(number), whole).when(number.isNotNull(), part)
    return F.when(x.rlike(IDS), F.upper(x)).otherwise(F.coalesce(text, F.lower(x)))


def normalized(df: DataFrame, col: str, aliases: DataFrame, name: str = "item") -> DataFrame:
    """Column ``name``: what an alias table (alias, name) says of the item or, for 'name (code)', of either half; else
    normalize_item. The alias side is broadcast only if it is small."""
    low = F.lower(_trimmed(F.col(col)))
    a = bounded(aliases.groupBy(F.lower(F.trim("alias")).alias("_a")).agg(F.min("name").alias("_name")))
    out = df.withColumns({"_0": low, "_1": F.trim(F.regexp_extract(low, HALVES, 1)), "_2": F.trim(F.regexp_extract(low, HALVES, 2))})
    for k in range(3):
        out = out.join(a.select(F.col("_a").alias(f"_a{k}"), F.col("_name").alias(f"_n{k}")), F.col(f"_{k}") == F.col(f"_a{k}"), "left")
    return out.select(*df.columns, F.coalesce("_n0", "_n1", "_n2", normalize_item(F.col(col))).alias(name))


#: A value of an answer and the name it is said of, if any.
ENTRY = "array<struct<label:string,value:string>>"


def _text(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("none"))


def _is(v: Column, *kinds: str) -> Column:
    kind = F.schema_of_variant(v)
    return F.coalesce(reduce(Column.__or__, [kind.startswith(k) for k in kinds]), F.lit(False))


def value_at(answer: Column, path: Column) -> Column:
    """What stands at "a.b" of a parsed answer (a VARIANT): the value of b in the object a. JSON null counts as missing."""
    found = F.aggregate(F.split(path, r"\."), answer, lambda at, k: F.try_element_at(F.try_variant_get(at, "$", "map<string,variant>"), k))
    return F.when(~F.is_variant_null(found), found)


def entries_of(v: Column, whole: list[str] = ()) -> Column:
    """A value as entries. An object gives one for each value, also within its lists; a list one for each item, and its
    texts of the form 'name: value' are split unless they begin with one of ``whole``. A text that only begins with a
    bracket stays a text: types are those of the parsed JSON."""
    def each(label: Column, x: Column) -> Column:
        many = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: F.struct(label.alias("label"), _text(y).alias("value")))
        return F.when(_is(x, "ARRAY"), many).otherwise(F.array(F.struct(label.alias("label"), _text(x).alias("value"))))

    def told(x: Column) -> Column:
        t = _text(x)
        kept = reduce(Column.__or__, [F.lower(t).startswith(w.lower()) for w in whole], F.lit(False))
        pair = F.struct(F.trim(F.substring_index(t, ":", 1)).alias("label"), F.trim(F.substr(t, F.locate(":", t) + 1)).alias("value"))
        return F.when(_is(x, "STRING") & (F.locate(":", t) > 0) & ~kept,
            pair).otherwise(F.struct(F.lit(None).cast("string").alias("label"), t.alias("value")))

    fields = F.flatten(F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")), lambda e: each(e["key"], e["value"])))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), told)
    one = F.array(F.struct(F.lit(None).cast("string").alias("label"), _text(v).alias("value")))
    return F.when(_is(v, "OBJECT"), fields.cast(ENTRY)).when(_is(v, "ARRAY"), items.cast(ENTRY)).when(v.isNotNull(), one.cast(ENTRY))


def _with_items(df: DataFrame, entries: str, aliases: DataFrame) -> DataFrame:
    """A row for each entry with its normalized ``item``; one with a null item where there is none."""
    kept = [c for c in df.columns if c != entries]
    rows = df.select(*kept, F.explode_outer(entries).alias("_x")).select(*kept, F.col("_x.label").alias("_label"), F.col("_x.value").alias("_value"))
    rows = normalized(normalized(rows, "_label", aliases, "_l"), "_value", aliases, "_v")
    return rows.select(*kept, F.when(F.col("_value").isNotNull(), F.concat_ws(": ", "_l", "_v")).alias("item"))


def answer_items(answers: DataFrame, keys: list[str], aliases: DataFrame, col: str = "answer", parts: DataFrame | None = None,
        whole: list[str] = ()) -> DataFrame:
    """JSON object answers -> rows (keys, part, item), items normalized and distinct, see entries_of.

    ``parts`` (question, part): the fields to read, "a.b" being the value of b in the object a; by default all fields of the
    answer. Answers that aren't JSON objects, and empty lists and objects, have no items; grade_parts has a row for them."""
    v = answers.withColumn("_v", F.try_parse_json(F.col(col).cast("string")))
    if parts is None:
        each = F.explode(F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))).alias("e")
        got = v.select(*keys, each).select(*keys, F.col("e.key").alias("part"), F.col("e.value").alias("_v")).where(~F.is_variant_null("_v"))
    else:
        got = v.join(bounded(parts.select("question", "part").distinct()), "question").select(*keys, "part",
            value_at(F.col("_v"), F.col("part")).alias("_v"))
    return _with_items(got.select(*keys, "part", entries_of(F.col("_v"), whole).alias("_e")), "_e", aliases).where("item is not null").distinct()


def number_of(v: Column) -> Column:
    """A JSON number, or a text that is one but for commas and spaces around, in full precision; null for all else, so a
    text with a unit is no number."""
    text = F.trim(F.replace(F.try_variant_get(v, "$", "string"), F.lit(","), F.lit("")))
    return F.when(~_is(v, "ARRAY", "OBJECT", "BOOLEAN") & text.rlike(NUMBER), text.try_cast("double"))


def normalized_key(key: DataFrame, aliases: DataFrame) -> DataFrame:
    """question, part, kind, want (number), tolerance and expected (set of items) of a key as it is written: question, part,
    kind, expected (array<string>, 'name: value' being a pair), tolerance."""
    pair = lambda x: F.when(F.locate(": ", x) > 0, F.struct(F.substring_index(x, ": ", 1).alias("label"),
        F.substr(x, F.locate(": ", x) + 2).alias("value"))).otherwise(F
            .struct(F.lit(None).cast("string").alias("label"), x.alias("value")))
    want = F.replace(F.try_element_at("expected", F.lit(1)), F.lit(","), F.lit("")).try_cast("double")
    own = key.select("question", "part", "kind", want.alias("want"), F.col("tolerance").cast("double").alias("tolerance"),
        F.transform("expected", pair).alias("_e"))
    items = _with_items(own, "_e", aliases)
    return items.groupBy("question", "part", "kind", "want", "tolerance").agg(F.collect_set("item").alias("expected"))


def grade_parts(records: DataFrame, key: DataFrame, keys: list[str], aliases: DataFrame, col: str = "answer", whole: list[str] = ()) -> DataFrame:
    """keys, question, part, ok and got (JSON text; null if missing): a row for each record and each part of its question.

    records: keys (which name a record), question and the answer as JSON text. key: see normalized_key. exact_number and
    tolerance compare numbers, see number_of. exact_list compares sets of items, in which 'name: 0' of an answer counts only
    if it is expected. What is missing or no JSON fails in every part, and so does a record without an answer."""
    own = [*keys, "question"]
    asked = records.select(*own, F.try_parse_json(F.col(col).cast("string")).alias("_v")).join(bounded(normalized_key(key, aliases)), "question")
    asked = asked.withColumn("_v", value_at(F.col("_v"), F.col("part")))
    number = number_of(F.col("_v"))
    right = F.when(F.col("kind") == "exact_number", number == F.col("want")).when(F.col("kind") == "tolerance",
        F.abs(number - F.col("want")) <= F.col("tolerance"))
    entries = F.when(F.col("kind") == "exact_list", entries_of(F.col("_v"), whole))
    rows = asked.select(*own, "part", "kind", "expected", F.coalesce(right, F.lit(False)).alias("_right"),
        F.col("_v").cast("string").alias("got"), entries.alias("_e"))
    items = _with_items(rows, "_e", aliases).groupBy(*own, "part").agg(*(F.first(c)
        .alias(c) for c in ("kind", "expected", "_right", "got")), F.collect_set("item").alias("_items"))
    extra = F.filter(F.array_except("_items", "expected"), lambda x: ~x.endswith(": 0"))
    same = F.col("got").isNotNull() & (F.size(extra) == 0) & (F.size(F.array_except("expected", "_items")) == 0)
    return items.select(*own, "part", F.when(F.col("kind") == "exact_list", same).otherwise(F.col("_right")).alias("ok"), "got")


def grade(records: DataFrame, key: DataFrame, keys: list[str], aliases: DataFrame, col: str = "answer", whole: list[str] = ()) -> DataFrame:
    """Per record whether all parts of its question pass, see grade_parts."""
    parts = grade_parts(records, key, keys, aliases, col, whole)
    return parts.groupBy(*keys, "question").agg(F.bool_and("ok").alias("correct"), F.count_if("ok").alias("n_passed"),
        F.count(F.lit(1)).alias("n_parts"))


def grader_selftest(grades: DataFrame, expected: str) -> DataFrame:
    """All right answers must pass and all traps fail: counts by what was expected."""
    return grades.groupBy(expected).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("correct") == F.col(expected)).alias("n_as_expected"))


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, absolute: float = 0.02, relative: float = 0.0) -> DataFrame:
    """Two routes to the same answers; a missing side is a mismatch."""
    j = a.select(key, F.col(value).alias("first")).join(b.select(key, F.col(value).alias("second")), key, "full_outer")
    near = F.abs(F.col("first") - F.col("second")) <= F.greatest(F.lit(absolute), relative * F.abs("second"))
    return j.withColumn("agree", F.coalesce(near, F.col("first").isNull() & F.col("second").isNull()))


def run_summary(records: DataFrame, excluded: list[str], conditions: tuple[str, str] = ("before", "after")) -> DataFrame:
    """Per model and condition accuracy, mean cost and seconds; change in points and cost ratio between two conditions."""
    before, after = conditions
    r = records.where(~F.col("question").isin(excluded)) if excluded else records

    def mean(what: Column, c: str) -> Column:
        return F.avg(F.when(F.col("condition") == c, what))

    right = F.col("correct").cast("int")
    out = r.groupBy("model").agg(*(f.alias(f"{n}_{c}") for c in conditions for n,
        f in (("accuracy", 100 * mean(right, c)), ("cost", mean(F.col("cost"), c)), ("seconds", mean(F.col("seconds"), c)))))
    return out.withColumn("points", F.col(f"accuracy_{after}") - F.col(f"accuracy_{before}")).withColumn("cost_ratio",
        F.try_divide(f"cost_{before}", f"cost_{after}"))


def question_grid(records: DataFrame, columns: list[str]) -> DataFrame:
    """Right answers of each question by condition and model; '-' where there is no record. right_everywhere: every one of
    these columns has a record and all of its records are right."""
    r = records.withColumn("_c", F.concat_ws("/", "condition", "model"))
    counts = [F.count_if(F.col("_c") == c).alias(f"_n{i}") for i, c in enumerate(columns)]
    right = [F.count_if((F.col("_c") == c) & F.col("correct")).alias(f"_r{i}") for i, c in enumerate(columns)]
    g = r.groupBy("question").agg(*counts, *right)
    cells = [F.when(F.col(f"_n{i}") > 0, F.col(f"_r{i}").cast("string")).otherwise("-").alias(c) for i, c in enumerate(columns)]
    everywhere = reduce(Column.__and__, [(F.col(f"_n{i}") > 0) & (F.col(f"_n{i}") == F.col(f"_r{i}")) for i in range(len(columns))])
    return g.select("question", *cells, everywhere.alias("right_everywhere"))


def regrade_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Grades that change under a new key."""
    j = old.select(*keys, F.col("correct").alias("was")).join(new.select(*keys, F.col("correct").alias("now")), keys, "full_outer")
    return j.where(~F.col("was").eqNullSafe(F.col("now")))


def run_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens times price per million; prices: model, input_price, output_price."""
    return records.join(bounded(prices), "model").withColumn("cost",
        (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6)
