"""Ordered rule programs that standardize free-text labels, compiled to one projection.

A program is a plain mapping (for instance read from YAML):

    defaults: {field: {value, source, location, raw}}
    rules:    [{name, when: {field: pattern}, set: {field: value or template}, note, source, location, inventory,
                children: [{key, ...}], clear_children: bool}]
    records:  {record id: {field: value}, or a block like a rule without ``when``}
    names:    {field: {spelling: name}}; children's keys have theirs under "child"

Rules fire on a map column of labels; a missing label reads as ''. Blocks are defaults, rules in order, then the record's
own block. A later write overrides an earlier one, also with null; notes are appended in order; a block's children go in
after it has cleared those of earlier blocks, and a child replaces an earlier one of the same name as a whole. Spellings
are resolved before that, so two spellings of one name are one child; a spelling without a name becomes null and is
listed by unresolved_names. Tables and the write log come from the same blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.patterns import all_of, java_pattern


def fields_to_map(df: DataFrame, keys: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """Entity-attribute-value rows -> one map of labels for each entity; a repeated field keeps its largest value."""
    once = df.groupBy(*keys, field).agg(F.max(value).alias(value))
    return once.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(field, value))).alias("labels"))


def label(labels: str, field: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(field)), F.lit(""))


def rule_fires(rule: dict, labels: str = "labels") -> Column:
    """Every pattern of ``when`` is found in its field; an empty ``when`` always fires."""
    return all_of([F.coalesce(label(labels, f).rlike(java_pattern(p)[0]), F.lit(False)) for f, p in rule.get("when", {}).items()])


def capture(rule: dict, template: object, labels: str = "labels") -> Column:
    """A literal, or a template in which {group} is what the rule's patterns captured. Unknown groups are refused here."""
    if not isinstance(template, str) or "{" not in template:
        return F.lit(template)
    groups = {g: (f, *x) for f, p in rule.get("when", {}).items() for x in [java_pattern(p)] for g in x[1]}
    parts = []
    for k, part in enumerate(re.split(r"\{(\w+)\}", template)):
        if k % 2:
            if part not in groups:
                raise ValueError(f"rule {rule.get('name')}: no group {part}")
            field, pattern, index = groups[part]
            parts.append(F.regexp_extract(label(labels, field), pattern, index[part]))
        elif part:
            parts.append(F.lit(part))
    return F.concat(*parts)


@dataclass(frozen=True)
class Block:
    """One writer of a program: what it is called, when it fires, what it writes."""

    fired: Column
    body: dict
    rule: str | None
    raw: Column


#: Keys that make an entry of ``records`` a block; other entries are plain {field: value}.
BLOCK = {"name", "set", "note", "source", "location", "inventory", "children", "clear_children"}


def _record_block(entry: dict) -> dict:
    return entry if BLOCK & entry.keys() else {"set": entry}


def _fired(df: DataFrame, program: dict) -> DataFrame:
    """Adds _f0, _f1 ...: each rule's condition is computed once and shared by fields, notes, children and the write log."""
    return df.withColumns({f"_f{i}": rule_fires(r) for i, r in enumerate(program.get("rules", []))})


def _blocks(program: dict, ids: str | None) -> list[Block]:
    """Rules in order, then records (only with ``ids``, the column that names a record). Block i has position i."""
    out = []
    for i, r in enumerate(program.get("rules", [])):
        out.append(Block(F.col(f"_f{i}"), r, r.get("name"), F.concat_ws(" ; ", *(label("labels", f) for f in r.get("when", {})))))
    for k, entry in program.get("records", {}).items() if ids else ():
        body = _record_block(entry)
        out.append(Block(F.coalesce(F.col(ids).cast("string") == k, F.lit(False)), body, body.get("name") or f"record {k}",
            F.lit(None).cast("string")))
    return out


def _named(value: Column, names: dict[str, str] | None) -> Column:
    """What the spelling stands for; null where it is unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), value) if names else value


def _written(program: dict, body: dict, field: str) -> Column:
    return _named(capture(body, body["set"][field]).cast("string"), program.get("names", {}).get(field))


def _default(program: dict, field: str) -> Column:
    return _named(F.lit(program.get("defaults", {}).get(field, {}).get("value")).cast("string"), program.get("names", {}).get(field))


def _field(program: dict, blocks: list[Block], field: str) -> Column:
    """The last write: conditions in reverse order."""
    default, chain = _default(program, field), None
    for b in reversed([b for b in blocks if field in b.body.get("set", {})]):
        value = _written(program, b.body, field)
        chain = F.when(b.fired, value) if chain is None else chain.when(b.fired, value)
    return default if chain is None else chain.otherwise(default)


def fields_of(program: dict) -> list[str]:
    seen = dict.fromkeys(program.get("defaults", {}))
    for part in [*program.get("rules", []), *map(_record_block, program.get("records", {}).values())]:
        seen |= dict.fromkeys(part.get("set", {}))
    return list(seen)


def apply_rules(df: DataFrame, program: dict, ids: str | None = None) -> DataFrame:
    """Adds every field the program writes, and ``note``. One projection over ``df`` (with column labels), no shuffle.

    The few records that the program names are conditions; many corrections come as a table, see override_records."""
    fired, blocks = _fired(df, program), _blocks(program, ids)
    notes = F.concat_ws(" ", *(F.when(b.fired, capture(b.body, b.body["note"])) for b in blocks if b.body.get("note")), F.lit(None).cast("string"))
    out = {f: _field(program, blocks, f) for f in fields_of(program)} | {"note": F.nullif(notes, F.lit(""))}
    return fired.withColumns(out).drop(*(f"_f{i}" for i in range(len(program.get("rules", [])))))


def override_records(df: DataFrame, fixes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Named records fixed after the rules: a table (key, fields...) whose non-null values win."""
    f = fixes.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields))
    return df.join(f, F.col(key) == F.col("_key"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields}).drop("_key",
        *(f"_{c}" for c in fields))


@dataclass(frozen=True)
class Child:
    """A child that block ``pos`` emits if it fires; gone where a later block clears or emits the same name again."""

    pos: int
    block: Block
    spelled: Column
    name: Column
    attributes: dict[str, object]


def _children(program: dict, blocks: list[Block]) -> list[Child]:
    names, out = program.get("names", {}).get("child"), []
    for pos, b in enumerate(blocks):
        for c in b.body.get("children", []):
            spelled = capture(b.body, c["key"]).cast("string")
            out.append(Child(pos, b, spelled, _named(spelled, names), {k: v for k, v in c.items() if k != "key"}))
    return out


def _gone(children: list[Child], blocks: list[Block], k: int) -> Column:
    """Is the k-th child cleared or replaced later?"""
    own = children[k]
    cleared = [b.fired for pos, b in enumerate(blocks) if pos > own.pos and b.body.get("clear_children")]
    replaced = [c.block.fired & c.name.eqNullSafe(own.name) for c in children[k + 1 :]]
    return reduce(Column.__or__, [*cleared, *replaced], F.lit(False))


def emit_children(df: DataFrame, program: dict, key: str, ids: str | None = None) -> DataFrame:
    """Child rows (key column, pos, child, attributes) that stand at the end of the program. Children without a name (an
    unknown spelling) are left out, see unresolved_names. One projection, no shuffle."""
    blocks = _blocks(program, ids)
    children = _children(program, blocks)
    names = list(dict.fromkeys(a for c in children for a in c.attributes))
    rows = []
    for k, c in enumerate(children):
        attrs = [capture(c.block.body, c.attributes.get(a)).cast("string").alias(a) for a in names]
        rows.append(F.when(c.block.fired & c.name.isNotNull() & ~_gone(children, blocks, k),
            F.struct(F.lit(c.pos).alias("pos"), c.name.alias("child"), *attrs)))
    if not rows:
        return df.where(F.lit(False)).select(key, F.lit(0).alias("pos"), F.lit("").alias("child"))
    return _fired(df, program).select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_c")).select(key, "_c.*")


def unresolved_names(df: DataFrame, program: dict, key: str, ids: str | None = None) -> DataFrame:
    """Spellings that the program's names lack: key column, field ("child" for children), spelling, rule."""
    blocks, rows = _blocks(program, ids), []

    def lost(fired: Column, field: str, spelled: Column, name: Column, rule: str | None) -> None:
        rows.append(F.when(fired & spelled.isNotNull() & name.isNull(),
            F.struct(F.lit(field).alias("field"), spelled.alias("spelling"), F.lit(rule).cast("string").alias("rule"))))

    for field in program.get("names", {}).keys() - {"child"}:
        if field in program.get("defaults", {}):
            lost(F.lit(True), field, F.lit(program["defaults"][field].get("value")).cast("string"), _default(program, field), "default")
        for b in blocks:
            if field in b.body.get("set", {}):
                lost(b.fired, field, capture(b.body, b.body["set"][field]).cast("string"), _written(program, b.body, field), b.rule)
    for c in _children(program, blocks):
        lost(c.block.fired, "child", c.spelled, c.name, c.block.rule)
    if not rows:
        return df.where(F.lit(False)).select(key, *(F.lit("").alias(x) for x in ("field", "spelling", "rule")))
    return _fired(df, program).select(key, F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("_u")).select(key, "_u.*")


def cast_numeric(df: DataFrame, cols: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Casts listed text columns; blanks become null. Returns the rows, and violations (column, value) that don't parse."""
    def blank(c):
        return F.nullif(F.trim(c), F.lit(""))

    bad = [F.when(blank(c).isNotNull() & blank(c).try_cast(kind).isNull(),
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, kind in cols.items()]
    violations = df.select(F.explode(F.filter(F.array(*bad), lambda x: x.isNotNull())).alias("v")).select("v.*")
    return df.withColumns({c: blank(c).try_cast(kind) for c, kind in cols.items()}), violations


def require(df: DataFrame, cols: list[str], policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns, and the others; policy 'fail' raises if there are others."""
    ok = all_of([F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in cols])
    good, bad = df.where(ok), df.where(~ok)
    if policy == "fail" and not bad.isEmpty():
        raise ValueError(f"required columns are empty: {cols}")
    return good, bad


def assign_replicates(df: DataFrame, conditions: list[str], order: str, replicate: str = "replicate", avoid_stated: bool = False) -> DataFrame:
    """Numbers rows without a replicate 1, 2, 3 ... inside equal conditions (nulls equal); adds replicate_basis.

    Numbers start at 1 even where the condition has stated ones, unless ``avoid_stated``: then they follow the largest."""
    open_ = F.col(replicate).isNull()
    number = F.row_number().over(Window.partitionBy(*conditions, open_).orderBy(order))
    if avoid_stated:
        number = number + F.coalesce(F.max(replicate).over(Window.partitionBy(*conditions)), F.lit(0))
    return df.withColumn("replicate_basis", F.when(open_, "assigned").otherwise("stated")).withColumn(replicate, F.coalesce(replicate, number))


def treatment_signature(children: DataFrame, sample: str, parts: list[str]) -> DataFrame:
    """Sorted compound@dose@hours of each sample, joined by '+'."""
    text = F.concat_ws("@", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    return children.groupBy(sample).agg(F.array_join(F.array_sort(F.collect_list(text)), "+").alias("signature"))


def provenance(df: DataFrame, program: dict, key: str, ids: str | None = None, replicates: DataFrame | None = None) -> DataFrame:
    """The write log: a row for every write of a field by a default, a rule, a named record, a child or the numbering of
    replicates.

    entity is the record's key, or key|child for a child's attributes; pos is the writer's position (-1 for defaults),
    superseded whether a later write of the same field, a clearing block or a later child of the same name replaced it.
    The rows that aren't superseded are the tables, see current_values. ``replicates``: what assign_replicates returned
    (key, replicate, replicate_basis); assigned numbers are writes after all others. One scan and no shuffle."""
    blocks, rows = _blocks(program, ids), []
    numbered = replicates is not None
    entity = F.col(key).cast("string")

    def put(fired: Column, who: Column, kind: str, pos: int, field: str, value: Column, spelled: Column, rule: str | None, told: dict,
            raw: Column, later: Column) -> None:
        given = {"entity": who, "kind": F.lit(kind), "pos": F.lit(pos), "field": F.lit(field), "value": value, "spelling": spelled}
        given |= {"rule": F.lit(rule).cast("string")} | {k: F.lit(told.get(k)).cast("string") for k in ("source", "location", "inventory")}
        given |= {"raw": raw, "superseded": later}
        rows.append(F.when(fired, F.struct(*(c.alias(k) for k, c in given.items()))))

    def field_later(field: str, pos: int, value: Column) -> Column:
        again = [b.fired for j, b in enumerate(blocks) if j > pos and field in b.body.get("set", {})]
        return reduce(Column.__or__, again, (value.isNull() if numbered and field == "replicate" else F.lit(False)))

    for field, spec in program.get("defaults", {}).items():
        value = _default(program, field)
        put(F.lit(True), entity, "record", -1, field, value, F.lit(spec.get("value")).cast("string"), "default", spec,
            F.lit(spec.get("raw")).cast("string"), field_later(field, -1, value))
    for pos, b in enumerate(blocks):
        for field, template in b.body.get("set", {}).items():
            value = _written(program, b.body, field)
            put(b.fired, entity, "record", pos, field, value, capture(b.body, template).cast("string"), b.rule, b.body, b.raw,
                field_later(field, pos, value))
    children = _children(program, blocks)
    for k, c in enumerate(children):
        who, gone = F.concat_ws("|", entity, c.name), _gone(children, blocks, k)
        for field, template in c.attributes.items():
            put(c.block.fired & c.name.isNotNull(), who, "child", c.pos, field, capture(c.block.body, template).cast("string"), c.spelled,
                c.block.rule, c.block.body, c.block.raw, gone)
    if not rows:
        put(F.lit(False), entity, "record", 0, "", F.lit(""), F.lit(""), None, {}, F.lit(""), F.lit(False))
    out = _fired(df, program).select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("w")).select("w.*")
    if not numbered:
        return out
    write = {"entity": F.col(key).cast("string"), "kind": F.lit("record"), "pos": F.lit(len(blocks)), "field": F.lit("replicate")}
    write |= {"value": F.col("replicate").cast("string"), "rule": F.lit("assigned"), "superseded": F.lit(False)}
    number = replicates.where("replicate_basis = 'assigned'").select(*(c.alias(n) for n, c in write.items()))
    return out.unionByName(number, allowMissingColumns=True)


def current_values(log: DataFrame, fields: list[str], kind: str = "record") -> DataFrame:
    """The table again from its write log: entity and the value of each field that stands."""
    held = log.where((F.col("kind") == kind) & ~F.col("superseded"))
    return held.groupBy("entity").agg(*(F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields))
