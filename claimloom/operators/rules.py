"""Rules stored as text rows: parsing, evaluation and matching.

A rule is a conjunction of atoms over one claim. Parsing turns every rule into condition
rows; evaluation comes in two forms that give the same outcome:

* compiled - one boolean Column per rule, a single pass over claim rows without joins;
  for rule sets small enough to be part of a plan;
* joined   - rules as rows that meet claims through equi-joins, for rule sets of any size.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from claimloom.operators.enrich import claim_codes
from claimloom.sizing import BROADCAST_ROWS, broadcast_small, is_small, reuse

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Atom names of the rule language and the fact kind each one reads.
KINDS = {
    "has_diagnosis": "diagnosis",
    "has_procedure": "procedure",
    "patient_age": "age",
    "charge_amount": "charge",
    "provider_type": "provider",
    "place_of_service": "place",
}
# Fixed value: outcomes carry this type whatever the origin of the rule.
OUTCOME_TYPE = "DATALOG"
NUMERIC = ["age", "charge"]
CODED = ["diagnosis", "procedure"]

HEAD = r"^\s*rule_applies\(\s*\w+\s*\)\s*<=\s*"
ATOM = (
    r"(\w++)\(\s*+\w++\s*+,\s*+(?:'([^']*+)'|\"([^\"]*+)\"|(\w++))\s*+\)"      # name(X, 'literal') or name(X, Var)
    r"|(\w++)\(\s*+(\w++)\s*+\)"                                               # name(Var)
    r"|\(?\s*+(\w++)\s*+(<=|>=|==|!=|<|>|=)\s*+(-?\d++(?:\.\d++)?+)\s*+\)?"    # (Var op number)
    r"|True"
)
# What stands for an atom while a rule is read: its fields, with BAR before and behind each. Where a text has that character, ESCAPED stands for it.
BAR, ESCAPE = "\x02", "\x03"
ESCAPED = {ESCAPE: ESCAPE + "\x04", BAR: ESCAPE + "\x05"}
FIELDS = ["name", "literal", "var", "member", "compared", "op", "number"]
READ = BAR + BAR.join(["$1$5", "$2$3", "$4", "$6", "$7", "$8", "$9"]) + BAR
ONE = f"(?:#|{BAR}(?:[^{BAR}]*+{BAR}){{{len(FIELDS)}}})"
# Leads every claim to the rules that name neither a code nor an interval, by one of SALTS keys.
ANY = "any"
SALTS = 64
# Columns of the numbers that rules compare, and the levels of their dyadic intervals.
NUMBERS = {"age": "patient_age", "charge": "total_charge_amount"}
LEVELS = {"age": 9, "charge": 44}
# Whole units that numbers are counted in, and the comparisons that leave an interval open.
UNITS = {"age": 1, "charge": 100}
BETWEEN = ["<", "<=", ">", ">=", "=="]
# Where ages end: the position of a claim without age.
AGELESS = 1 << LEVELS["age"]
# Claims and rule ends that one task counts at once, and sampled ones that tell where such a chunk ends.
CHUNK_ROWS, SAMPLES_PER_CHUNK = 500_000, 64
COMPILED_RULES = 256
COMPILED_CODES = 5_000


def parsed_atoms(filters: DataFrame) -> DataFrame:
    """Rules with the FIELDS of all their atoms as one array, ``_atoms`` with where each atom's begin in it, and an ``error`` for text that is
    not a conjunction of known atoms. A text is searched once: every atom is replaced by its fields."""
    body = F.regexp_replace("rule_definition", HEAD, "")
    for plain, escaped in ESCAPED.items():
        body = F.replace(body, F.lit(plain), F.lit(escaped))
    n = len(FIELDS) + 1
    return (
        filters.withColumn("_body", F.regexp_replace(body, ATOM, READ))
        .select(
            *filters.columns, F.split("_body", BAR).alias("_fields"),
            F.when(~F.coalesce(F.col("_body").rlike(rf"^\s*\(?\s*{ONE}\s*\)?(?:\s*&\s*\(?\s*{ONE}\s*\)?)*\s*$"), F.lit(False)), "rule text is not a conjunction of known atoms").alias("error"))
        .withColumn("_atoms", F.when(F.size("_fields") > n, F.sequence(F.lit(1), F.size("_fields") - n, F.lit(n))).otherwise(F.array().cast("array<int>")))
    )


def _literal_sql(text: str) -> str:
    """A quoted value as it stood in the rule; one of several lines counts as empty."""
    for plain, escaped in reversed(ESCAPED.items()):
        text = f"replace({text}, '{escaped}', '{plain}')"
    return f"CASE WHEN {text} RLIKE '[\n\r\u0085\u2028\u2029]' THEN '' ELSE {text} END"


def _condition_sql(op: str, value_str="NULL", value_num="NULL", set_names="NULL", error="NULL", kind="''") -> str:
    return (
        f"named_struct('kind', CAST({kind} AS STRING), 'op', {op}, 'value_str', CAST({value_str} AS STRING), "
        f"'value_num', try_cast({value_num} AS DOUBLE), 'set_names', CAST({set_names} AS ARRAY<STRING>), 'error', CAST({error} AS STRING))"
    )


def read_rules(filters: DataFrame) -> tuple[DataFrame, Column]:
    """Rules with what their conditions are made of, and the conditions as an array: empty for a rule without conditions, one error
    for a rule that cannot be read."""
    a, o = ({f: f"_fields[{x} + {i}]" for i, f in enumerate(FIELDS)} for x in "ao")
    kind = f"CASE {a['name']} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
    numeric = "(" + " OR ".join(f"{a['name']} = '{k}'" for k, v in KINDS.items() if v in NUMERIC) + ")"
    compared, member = (f"exists(_atoms, o -> {o[f]} = {a['var']})" for f in ("compared", "member"))
    condition = lambda op, **values: _condition_sql(op, kind=kind, **values)
    conditions = f"""flatten(transform(filter(_atoms, a -> {a['member']} = '' AND {a['name']} <> ''), a -> CASE
        WHEN {a['var']} = '' AND {numeric} THEN array({condition("'=='", value_num=_literal_sql(a['literal']))})
        WHEN {a['var']} = '' THEN array({condition("'='", value_str=_literal_sql(a['literal']))})
        WHEN {numeric} AND {member} THEN array({condition("'error'", error="'a number cannot be in a code set'")})
        WHEN {numeric} AND {compared} THEN transform(filter(_atoms, o -> {o['compared']} = {a['var']}),
            o -> {condition(f"CASE WHEN {o['op']} = '=' THEN '==' ELSE {o['op']} END", value_num=o['number'])})
        WHEN {compared} THEN array({condition("'error'", error="'a code cannot be compared with a number'")})
        WHEN {member} THEN array({condition("'in'", set_names=f"array_sort(array_distinct(transform(filter(_atoms, o -> {o['member']} = {a['var']}), o -> {o['name']})))")})
        ELSE array({condition("'exists'")}) END))"""
    unknown = f"{a['member']} = '' AND {a['name']} <> ''" + "".join(f" AND {a['name']} <> '{k}'" for k in KINDS)
    bound = f"array_remove(transform(_atoms, a -> {a['var']}), '')"
    unbound = f"array_except(array_remove(transform(_atoms, a -> concat({a['compared']}, {a['member']})), ''), {bound})"
    error = f"""CASE WHEN error IS NOT NULL THEN error
        WHEN exists(_atoms, a -> {unknown}) THEN concat('unknown predicate: ', array_join(transform(filter(_atoms, a -> {unknown}), a -> {a['name']}), ', '))
        WHEN size({unbound}) > 0 THEN concat('unbound variable: ', array_join({unbound}, ', '))
        WHEN size({bound}) > size(array_distinct({bound})) THEN 'a variable is bound twice' END"""
    unreadable = f"array({_condition_sql(chr(39) + 'error' + chr(39), error='_error', kind='NULL')})"
    read = parsed_atoms(filters).select(*filters.columns, "_fields", "_atoms", F.expr(error).alias("_error"))
    return read, F.expr(f"CASE WHEN _error IS NOT NULL THEN {unreadable} ELSE {conditions} END")


def rule_conditions(filters: DataFrame) -> DataFrame:
    """(filter_id, cond_no, kind, op, value_str, value_num, set_names, error) of every rule.

    ``op`` is ``=`` for a literal, a comparison for age and charge, ``in`` for a code that
    must be in all of ``set_names``, ``exists`` for a variable nothing else uses. A rule
    without conditions (``True``) has no rows; a rule that cannot be read has one error row.

    Rules are dealt out before they are read: their texts are short, so few tasks hold very many, and reading them is the work.
    """
    read, conditions = read_rules(filters.select("filter_id", "rule_definition").repartition("filter_id"))
    return read.select("filter_id", F.posexplode(conditions).alias("cond_no", "c")).select("filter_id", "cond_no", "c.*")


def active_filters(filters: DataFrame) -> DataFrame:
    return filters.filter("active").select(
        "filter_id", "filter_name", "rule_definition", "description", "rule_type"
    ).orderBy("filter_id")


def rule_errors(conditions: DataFrame, code_sets: DataFrame) -> DataFrame:
    """(filter_id, error) of the rules that cannot be evaluated: unreadable text, or a code
    set that does not exist."""
    known = code_sets.select(F.col("set_name")).distinct()
    missing = (
        conditions.filter(F.col("op") == "in")
        .select("filter_id", F.explode("set_names").alias("set_name"))
        .join(known, "set_name", "left_anti")
        .select("filter_id", F.concat(F.lit("unknown code set: "), F.col("set_name")).alias("error"))
    )
    return (
        conditions.filter(F.col("error").isNotNull()).select("filter_id", "error")
        .unionByName(missing)
        .groupBy("filter_id").agg(F.min("error").alias("error"))
    )


def rule_header(filters: DataFrame, conditions: DataFrame, code_sets: DataFrame) -> DataFrame:
    """One row per active rule: names and error text if any."""
    return (
        filters.filter("active")
        .select("filter_id", "filter_name", F.lit(OUTCOME_TYPE).alias("rule_type"),
                F.coalesce("description", F.lit("")).alias("details"))
        .join(rule_errors(conditions, code_sets), "filter_id", "left")
        .withColumn("error", F.coalesce("error", F.lit("")))
    )


def code_conditions(conditions: DataFrame, code_sets: DataFrame) -> DataFrame:
    """(kind, value, filter_id, cond_no): every fact value that alone meets a condition. A code
    counts for an ``in`` condition when it belongs to all its sets."""
    equal = conditions.filter(F.col("op") == "=").select("kind", F.col("value_str").alias("value"), "filter_id", "cond_no")
    members = (
        conditions.filter(F.col("op") == "in")
        .select("kind", "filter_id", "cond_no", F.size("set_names").alias("n_sets"), F.explode("set_names").alias("set_name"))
        .join(code_sets.select("set_name", F.col("code").alias("value")).distinct(), "set_name")
        .groupBy("kind", "value", "filter_id", "cond_no", "n_sets").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == F.col("n_sets"))
        .select("kind", "value", "filter_id", "cond_no")
    )
    return equal.unionByName(members)


def _compare(value: Column, op: Column, number: Column) -> Column:
    return (
        F.when(op == "<", value < number).when(op == "<=", value <= number)
        .when(op == ">", value > number).when(op == ">=", value >= number)
        .when(op == "==", value == number).when(op == "!=", value != number)
        .when(op == "exists", value.isNotNull())
    )


def rows_alone(filters: DataFrame) -> DataFrame:
    """One row per active rule, as in ``RuleTables``, each from its own text: right where ids do not repeat and no condition asks for a
    code set, which ``in_sets`` tells. A rule without id has no conditions."""
    read, conditions = read_rules(
        filters.filter("active")
        .select("filter_id", "filter_name", F.lit(OUTCOME_TYPE).alias("rule_type"), F.coalesce("description", F.lit("")).alias("details"), "rule_definition")
        .repartition("filter_id"))
    none = F.array().cast("array<string>")
    read = read.select("filter_id", "filter_name", "rule_type", "details", F.when(F.col("filter_id").isNotNull(), conditions).otherwise(F.slice(conditions, 1, 0)).alias("_read"))
    return read.select(
        "filter_id", "filter_name", "rule_type", "details",
        F.coalesce(F.array_min(F.col("_read")["error"]), F.lit("")).alias("error"),
        F.transform("_read", lambda c, i: F.struct(
            i.alias("cond_no"), c["kind"].alias("kind"), c["op"].alias("op"), c["value_num"].alias("number"),
            F.when(c["op"] == "=", F.array(c["value_str"])).otherwise(none).alias("codes"))).alias("conditions"),
        F.array_contains(F.col("_read")["op"], "in").alias("in_sets"))


def rows_grouped(filters: DataFrame, code_sets: DataFrame) -> DataFrame:
    """One row per active rule, as in ``RuleTables``; rules of one id share their conditions."""
    conditions = reuse(rule_conditions(filters.filter("active")))
    codes = reuse(code_conditions(conditions, code_sets))
    per_condition = codes.groupBy("filter_id", "cond_no").agg(F.sort_array(F.collect_set("value")).alias("codes"))
    arrays = (
        conditions.join(per_condition, ["filter_id", "cond_no"], "left")
        .groupBy("filter_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "cond_no", "kind", "op", F.col("value_num").alias("number"),
            F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
        ))).alias("conditions"))
    )
    none = F.array().cast(arrays.schema["conditions"].dataType)
    return rule_header(filters, conditions, code_sets).join(arrays, "filter_id", "left").withColumn("conditions", F.coalesce("conditions", none))


class RuleTables:
    """A rule set as one row per active rule: header fields and an array of its conditions, each
    with the codes that meet it. Materialised and measured once; joins broadcast it only while
    rules and codes stay within ``BROADCAST_ROWS``.

    Most rules are rows of their own. Conditions are taken apart and grouped for rules whose ids repeat or that ask for code sets, and
    for all of a rule set of at most ``COMPILED_RULES`` (``few``). Of the others, ``kept`` may turn rows into smaller ones before they are
    materialised.
    """

    def __init__(self, filters: DataFrame, code_sets: DataFrame, kept: Callable[[DataFrame], DataFrame] | None = None):
        kept = kept or (lambda rows: rows)
        alone = reuse(kept(rows_alone(filters)))
        self.few = is_small(alone, COMPILED_RULES)
        if self.few:
            self.rows = reuse(rows_grouped(filters, code_sets))
        else:
            ids = alone.filter("filter_id IS NOT NULL").groupBy("filter_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or("in_sets").alias("in_sets"))
            others = reuse(ids.filter("n > 1 OR in_sets").select("filter_id"))
            self.rows = alone.drop("in_sets")
            if not others.isEmpty():
                others = F.broadcast(others) if is_small(others) else others
                grouped = kept(rows_grouped(filters.join(others, "filter_id", "left_semi"), code_sets).withColumn("in_sets", F.lit(False)))
                self.rows = reuse(self.rows.join(others, "filter_id", "left_anti").unionByName(grouped.drop("in_sets")))
        n_codes = F.sum(F.aggregate("conditions", F.lit(0).cast("long"), lambda n, c: n + F.size(c["codes"])))
        self.small = is_small(self.rows) and (self.rows.agg(n_codes.alias("n")).first().n or 0) <= BROADCAST_ROWS

    def side(self, df: DataFrame) -> DataFrame:
        """``df`` is no larger than rules and codes together."""
        return F.broadcast(df) if self.small else df


def _holds(c: Column) -> Column:
    """Whether a claim row with ``diagnosis_codes`` and ``procedure_codes`` meets a condition."""
    number = F.when(c["kind"] == "age", F.col("patient_age").cast("double")).otherwise(F.col("total_charge_amount").cast("double"))
    held = F.when(c["kind"] == "diagnosis", F.col("diagnosis_codes")).otherwise(F.col("procedure_codes"))
    single = F.when(c["kind"] == "provider", F.col("provider_type")).otherwise(F.col("place_of_service"))
    met = (
        F.when(c["kind"].isin(NUMERIC), _compare(number, c["op"], c["number"]))
        .when(c["kind"].isin(CODED) & (c["op"] == "exists"), F.size(held) > 0)
        .when(c["kind"].isin(CODED), F.arrays_overlap(held, c["codes"]))
        .when(c["op"] == "exists", single.isNotNull())
        .otherwise(F.array_contains(c["codes"], single))
    )
    return F.coalesce(met, F.lit(False))


def _passed() -> Column:
    return (F.col("error") == "") & F.forall("conditions", _holds)


def coded_claims(claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame) -> DataFrame:
    """What rules read of a claim; the code arrays are bounded by the code vocabulary."""
    scalars = claims.select("claim_id", "patient_age", "total_charge_amount", "provider_type", "place_of_service")
    return claim_codes(scalars, diagnoses, procedures).withColumnsRenamed(
        {"diagnoses": "diagnosis_codes", "procedures": "procedure_codes"})


def evaluate_rules(
    claims: DataFrame,
    diagnoses: DataFrame,
    procedures: DataFrame,
    filters: DataFrame,
    code_sets: DataFrame,
    candidates: DataFrame,
) -> DataFrame:
    """One row per candidate (claim_id, filter_id) of an active rule: joined form.

    Only candidate pairs are formed. Inactive and unknown filter ids are skipped; a rule with an
    error never passes.
    """
    wanted = candidates.select("claim_id", "filter_id").distinct()
    return evaluate_coded(
        wanted.join(coded_claims(claims, diagnoses, procedures), "claim_id"), RuleTables(filters, code_sets))


def evaluate_coded(pairs: DataFrame, tables: RuleTables, *keep: str) -> DataFrame:
    """Outcome rows of (coded claim, filter_id) rows; the ``keep`` columns stay."""
    return pairs.join(tables.side(tables.rows), "filter_id").select(
        *keep, "claim_id", "filter_id", "filter_name", _passed().alias("passed"), "rule_type", "details", "error")


def position(value: Column, kind: str) -> Column:
    """Where a number lies on a whole-number line from 0 to 2^LEVELS[kind] - 1: ages by years, charges by cents. Larger numbers never lie
    before smaller ones, and what is beyond the line lies at its end."""
    unit, top = (1, 1 << LEVELS[kind]) if kind == "age" else (100, 1 << LEVELS[kind])
    at = F.floor(value.cast("double") * unit).cast("double") + (top >> 1)
    return F.least(F.greatest(at, F.lit(0.0)), F.lit(float(top - 1))).cast("long")


def interval(kind: str) -> Column:
    """struct(lo, hi): the positions a rule's conditions on an age or charge leave open; null if it has none but ``!=`` and ``exists``."""
    own = lambda *ops: F.transform(
        F.filter("conditions", lambda c: (c["kind"] == kind) & c["op"].isin(*ops)), lambda c: position(c["number"], kind))
    lo = F.coalesce(F.array_max(own(">", ">=", "==")), F.lit(0).cast("long"))
    hi = F.coalesce(F.array_min(own("<", "<=", "==")), F.lit((1 << LEVELS[kind]) - 1).cast("long"))
    return F.when(F.size(own("<", "<=", ">", ">=", "==")) > 0, F.struct(lo.alias("lo"), hi.alias("hi")))


def dyadic_pieces(lo: Column, hi: Column, levels: int) -> Column:
    """array<struct<level, prefix>>: the fewest dyadic intervals that make up lo..hi; that of (level, prefix) holds the positions whose
    bits above ``level`` are ``prefix``. No piece if lo > hi."""
    piece = lambda level, prefix: F.array(F.struct(level.cast("int").alias("level"), prefix.alias("prefix")))
    none = F.array().cast("array<struct<level: int, prefix: bigint>>")

    def step(s: Column, level: Column) -> Column:
        open_, odd, even = s["lo"] <= s["hi"], s["lo"] % 2 == 1, s["hi"] % 2 == 0
        # both ends stick out of the next level's intervals at once if they are the same position
        left = F.when(open_ & odd, piece(level, s["lo"])).otherwise(none)
        right = F.when(open_ & even & ~(odd & (s["lo"] == s["hi"])), piece(level, s["hi"])).otherwise(none)
        lo = F.when(odd, s["lo"] + 1).otherwise(s["lo"])
        hi = F.when(even, s["hi"] - 1).otherwise(s["hi"])
        closed = ~open_ | (lo > hi)
        return F.struct(
            F.when(closed, F.lit(1).cast("long")).otherwise(F.shiftright(lo, 1)).alias("lo"),
            F.when(closed, F.lit(0).cast("long")).otherwise(F.shiftright(hi, 1)).alias("hi"), F.concat(s["pieces"], left, right).alias("pieces"))

    start = F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), none.alias("pieces"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, step, lambda s: s["pieces"])


def _rule_keys(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Rules with the facts that lead to them, as (kind, value) rows: the codes of one condition that names some, preferably of a diagnosis
    or procedure and few; else the dyadic pieces of an age or charge interval, of the one with fewer claims if there are both; else ANY."""
    named = F.filter("conditions", lambda c: F.size(c["codes"]) > 0)
    ranked = F.transform(named, lambda c: F.struct(
        (~c["kind"].isin(CODED)).cast("int").alias("tier"), F.size(c["codes"]).alias("n"), c["cond_no"].alias("cond_no"),
        c["kind"].alias("kind"), c["codes"].alias("codes")))
    led = rows.withColumns({"lead": F.array_min(ranked), "age": interval("age"), "charge": interval("charge")})
    open_ = F.col("lead").isNull()
    kind = F.when(~open_, F.col("lead.kind")).when(F.col("age").isNull() & F.col("charge").isNull(), ANY).when(F.col("charge").isNull(), "age").when(F.col("age").isNull(), "charge")
    if led.filter(open_ & F.col("age").isNotNull() & F.col("charge").isNotNull()).isEmpty():
        led = led.withColumn("kind", kind)
    else:
        steps = [i / 50 for i in range(51)]
        spread = claims.agg(*[F.percentile_approx(position(F.col(c), k), steps).alias(k) for k, c in NUMBERS.items()]).first()
        within = lambda k: F.size(F.filter(F.array(*map(F.lit, spread[k] or [])), lambda x: x.between(F.col(f"{k}.lo"), F.col(f"{k}.hi"))))
        share = {k: within(k) for k in NUMBERS}
        led = led.withColumn("kind", F.coalesce(kind, F.when(share["charge"] <= share["age"], "charge").otherwise("age")))
    pieces = F.coalesce(*[F.when(F.col("kind") == k, dyadic_pieces(F.col(f"{k}.lo"), F.col(f"{k}.hi"), LEVELS[k])) for k in NUMBERS])
    lines = F.transform(pieces, lambda p: F.struct(F.concat(F.col("kind"), F.lit("/"), p["level"].cast("string")).alias("kind"), p["prefix"].cast("string").alias("value")))
    codes = F.transform("lead.codes", lambda v: F.struct(F.col("kind").alias("kind"), v.alias("value")))
    salts = F.transform(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.struct(F.lit(ANY).alias("kind"), i.cast("string").alias("value")))
    return led.withColumn("key_codes", F.col("lead.codes")).withColumn("key", F.explode(F.coalesce(codes, lines, salts))).select(
        *rows.columns, "key_codes", "key.kind", "key.value")


def _claim_facts(coded: DataFrame, levels: dict[str, list[int]]) -> DataFrame:
    """Claim rows with each fact that can lead to rules as (kind, value): codes, provider, place, the dyadic intervals of age and charge on
    those levels that rules use, and one of the ANY keys. Rules without codes only look at whether a claim has codes, so facts that lead to these
    carry one code of each kind."""
    whole = {c: F.col(c) for c in ("diagnosis_codes", "procedure_codes")}
    few = {c: F.slice(c, 1, 1) for c in whole}

    def fact(kind: Column, value: Column, codes: dict[str, Column]) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"), *[v.alias(c) for c, v in codes.items()])

    def line(kind: str, used: list[int]) -> Column:
        at = lambda level: F.floor(position(F.col(NUMBERS[kind]), kind) / F.pow(F.lit(2.0), level)).cast("long").cast("string")
        return F.transform(F.array(*map(F.lit, used)), lambda level: fact(F.concat(F.lit(f"{kind}/"), level.cast("string")), at(level), few))

    lines = [line(k, levels[k]) for k in NUMBERS if k in levels]
    any_key = [F.array(fact(F.lit(ANY), F.pmod(F.xxhash64("claim_id"), F.lit(SALTS)).cast("string"), few))] if ANY in levels else []
    known = F.concat(
        F.transform("diagnosis_codes", lambda v: fact(F.lit("diagnosis"), v, whole)),
        F.transform("procedure_codes", lambda v: fact(F.lit("procedure"), v, whole)),
        F.array(fact(F.lit("provider"), F.col("provider_type"), whole), fact(F.lit("place"), F.col("place_of_service"), whole)), *lines, *any_key,
    )
    rest = [c for c in coded.columns if c not in whole]
    return coded.withColumn("f", F.explode(known)).select(*rest, "f.*").filter("value IS NOT NULL")


def rule_hits(claims: DataFrame, coded: DataFrame, tables: RuleTables, rows: DataFrame | None = None) -> DataFrame:
    """Claim and rule rows that one fact brings together, before all conditions are decided; a claim meets a rule once by each of its
    codes that the rule's leading condition names, and once otherwise. ``rows`` are the rules to look at, all if not given."""
    sound = (tables.rows if rows is None else rows).filter(F.col("error") == "").select("filter_id", "conditions", "error")
    keys = reuse(_rule_keys(sound, claims))
    levels: dict[str, list[int]] = {}
    for r in keys.select("kind").distinct().collect():
        kind, _, level = r.kind.partition("/")
        levels.setdefault(kind, []).extend([int(level)] if level else [])
    return _claim_facts(coded, levels).join(F.broadcast(keys) if tables.small and is_small(keys) else keys, ["kind", "value"])


def _any_of(value: Column, values: list[str]) -> Column:
    """``isin`` that costs less where it is interpreted, as within conditions."""
    return reduce(lambda a, b: a | b, [value == x for x in values])


def _of(kind: str) -> Column:
    return F.filter("conditions", lambda c: c["kind"] == kind)


def countable(claims: DataFrame) -> Column:
    """Whether a rule is intervals of age or charge, with no more than one condition each that names providers and places, and all
    bounds within the lines of whole years and cents, where ``counted_passes`` is exact. None is if the claims' types are not whole
    years and decimals of cents."""
    age, charge = (claims.schema[c].dataType for c in NUMBERS.values())
    if not (isinstance(age, T.IntegralType) and isinstance(charge, T.DecimalType) and charge.scale <= 2 and charge.precision - charge.scale <= 10):
        return F.lit(False)
    inside = lambda c, kind: (c["kind"] == kind) & _any_of(c["op"], BETWEEN) & (F.abs(c["number"] * UNITS[kind]) < (1 << (LEVELS[kind] - 1)) - 1)
    fits = F.forall("conditions", lambda c: F.coalesce(
        inside(c, "charge") | inside(c, "age") | (_any_of(c["kind"], ["provider", "place"]) & _any_of(c["op"], ["=", "in"])), F.lit(False)))
    numbers = F.exists("conditions", lambda c: _any_of(c["kind"], NUMERIC))
    return (F.col("error") == "") & fits & numbers & (F.size(_of("provider")) < 2) & (F.size(_of("place")) < 2)


def _bounds(kind: str) -> Column:
    """struct(lo, hi): the first and last whole unit on the line that the conditions on an age or charge let through."""
    unit, half = F.lit(float(UNITS[kind])), 1 << (LEVELS[kind] - 1)

    def at_least(x: Column) -> Column:
        k = F.ceil(x * unit)
        return F.when((k - 1) / unit >= x, k - 1).when(k / unit >= x, k).otherwise(k + 1)

    def above(x: Column) -> Column:
        return at_least(x) + F.when(at_least(x) / unit == x, 1).otherwise(0)

    def ends(wide: str, narrow: str, of_wide: Callable[[Column], Column], of_narrow: Callable[[Column], Column]) -> Column:
        return F.transform("conditions", lambda c: F.when(c["kind"] == kind, F.when(c["op"] == narrow, of_narrow(c["number"])).when(_any_of(c["op"], [wide, "=="]), of_wide(c["number"])) + half))

    return F.struct(
        F.greatest(F.lit(0).cast("long"), F.array_max(ends(">=", ">", at_least, above))).alias("lo"),
        F.least(F.lit(2 * half - 1).cast("long"), F.array_min(ends("<=", "<", above, at_least)) - 1).alias("hi"))


def with_spans(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Rules with ``span`` in place of their conditions if they are ``countable``: the ages and charges they let through as positions, null
    ages being AGELESS and null charges -1, and the codes of their provider and place, null if they name none."""
    def open_to(kind: str, all_of_it: tuple[int, int]) -> Column:
        lo, hi = (F.lit(x).cast("long") for x in all_of_it)
        return F.when(F.exists("conditions", lambda c: c["kind"] == kind), _bounds(kind)).otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))

    named = lambda kind: F.get(F.transform(_of(kind), lambda c: c["codes"]), F.lit(0)).alias(kind)
    top = (1 << LEVELS["charge"]) - 1
    span = F.struct(open_to("age", (0, AGELESS)).alias("age"), open_to("charge", (-1, top)).alias("charge"), named("provider"), named("place"))
    return rows.withColumn("_counted", countable(claims)).withColumn("span", F.when(F.col("_counted"), span)) \
        .withColumn("conditions", F.when(F.col("_counted"), F.slice("conditions", 1, 0)).otherwise(F.col("conditions"))).drop("_counted")


def _points_below(ages: np.ndarray, start: np.ndarray, end: np.ndarray, age: np.ndarray) -> np.ndarray:
    """How many of ages[start:end] are below ``age``, for many (start, end, age) at once, bit by bit from the highest: what has a zero
    where ``age`` has a one is below; the others are parted by that bit, in their order, and searched for the bits left."""
    found = np.zeros(len(age), np.int64)
    for bit in reversed(range(AGELESS.bit_length())):
        ones = (ages >> bit & 1).astype(bool)
        zeros = np.concatenate(([0], np.cumsum(~ones)))
        s, e, up = zeros[start], zeros[end], (age >> bit & 1).astype(bool)
        found += np.where(up, e - s, 0)
        start, end = np.where(up, zeros[-1] + start - s, s), np.where(up, zeros[-1] + end - e, e)
        ages = np.concatenate((ages[~ones], ages[ones]))
    return found


def _chunk_counts(rows: pa.Table, starts: pa.Table) -> pa.Table:
    """(filter_id, n): for each rule end of a chunk, how many claims of its group and ages lie at or before it, times its sign. ``starts``
    are the claims by age that the chunk's first group has in chunks before."""
    group, at, sign, lo, hi = (rows[c].to_numpy() for c in ("group", "at", "sign", "lo", "hi"))
    order = np.lexsort((sign != 0, at, group))  # a claim comes before the rule ends at its place
    group, sign, lo, hi = (x[order] for x in (group, sign, lo, hi))
    ends = np.flatnonzero(sign)
    upto = np.concatenate(([0], np.cumsum(sign == 0)))
    start, end = upto[np.searchsorted(group, group[ends])], upto[ends]
    ages, lo, hi = lo[sign == 0].astype(np.int64), lo[ends].astype(np.int64), hi[ends].astype(np.int64) + 1
    n = _points_below(ages, start, end, hi) - _points_below(ages, start, end, lo)
    if len(starts):
        before = np.zeros(AGELESS + 2, np.int64)
        np.add.at(before, starts["age"].to_numpy() + 1, starts["n"].to_numpy())
        before = np.cumsum(before)
        n += np.where(group[ends] == starts["group"][0].as_py(), before[hi] - before[lo], 0)
    return pa.table({"filter_id": rows["filter_id"].take(pa.array(order[ends])), "n": n * sign[ends]})


def _place_among(bounds: list[tuple[int, ...]], keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds ``chunk``, the number of sorted bounds that a row's keys are not below, by halves; so many steps as the bounds have bits."""
    columns = [F.lit(list(c)) if c else F.array().cast("array<bigint>") for c in (zip(*bounds) if bounds else [()] * len(keys))]

    def reached(i: Column) -> Column:
        met = F.lit(True)
        for key, c in reversed([*zip(keys, columns)]):
            met = (F.get(c, i) < F.col(key)) | ((F.get(c, i) == F.col(key)) & met)
        return F.coalesce(met, F.lit(False))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("chunk", F.lit(0))
        for k in reversed(range(len(bounds).bit_length())):
            df = df.withColumn("chunk", F.col("chunk") + F.when(reached(F.col("chunk") + ((1 << k) - 1)), 1 << k).otherwise(0))
        return df

    return placed


def counted_passes(claims: DataFrame, rows: DataFrame) -> DataFrame:
    """(filter_id, n_passed) of rules ``with_spans``, without a claim and a rule ever meeting.

    Claims and the two ends of a rule's charges lie on one line, by group (the provider and place that a rule names) and charge. A rule
    counts the claims of its ages up to its last charge, less those before its first. The line is cut into chunks of about CHUNK_ROWS rows
    wherever they end, also among rows of one charge; a chunk counts within itself and knows by age what its first group has in chunks
    before. So the work grows with claims and rules, not with how many claims pass.
    """
    by = ["by", "provider", "place"]
    names = lambda *kinds: sum(F.when(has, w).otherwise(0) for w, has in zip((1, 2), kinds))
    whole = claims.select(
        F.xxhash64("claim_id").alias("salt"), "provider_type", "place_of_service",
        F.when(F.col("patient_age").isNull(), AGELESS).otherwise(
            F.least(F.greatest(F.col("patient_age").cast("long") + (1 << (LEVELS["age"] - 1)), F.lit(0)), F.lit(AGELESS - 1))).alias("age"),
        F.coalesce((F.col("total_charge_amount") * 100).cast("long") + (1 << (LEVELS["charge"] - 1)), F.lit(-1)).alias("at"))
    wanted = (
        rows.select("filter_id", "span.*").filter("filter_id IS NOT NULL AND age.lo <= age.hi AND charge.lo <= charge.hi")
        .withColumn("by", names(F.col("provider").isNotNull(), F.col("place").isNotNull()))
        .withColumn("provider", F.explode(F.coalesce("provider", F.array(F.lit(""))))).withColumn("place", F.explode(F.coalesce("place", F.array(F.lit(""))))))
    groups = broadcast_small(wanted.filter("by > 0").select(*by).distinct().withColumn("group", F.monotonically_increasing_id()))
    used = [r.by for r in wanted.select("by").distinct().collect()]
    if not used:
        return rows.select("filter_id", F.lit(0).cast("long").alias("n_passed")).limit(0)

    def grouped(df: DataFrame) -> DataFrame:
        alone, named = df.filter("by = 0").withColumn("group", F.lit(-1).cast("long")).drop(*by), df.filter("by > 0").join(groups, by).drop(*by)
        return named if 0 not in used else alone if used == [0] else alone.unionByName(named)

    def points(whole: DataFrame) -> DataFrame:
        kinds = {k: F.col(c) for k, c in (("provider", "provider_type"), ("place", "place_of_service"))}
        named = lambda k, w: F.when(F.col("by").bitwiseAND(w) > 0, kinds[k]).otherwise("").alias(k)
        some = whole.withColumn("by", F.explode(F.array(*map(F.lit, used)))).select("salt", "age", "at", "by", named("provider", 1), named("place", 2))
        return grouped(some.filter("provider IS NOT NULL AND place IS NOT NULL")).select(
            "group", "at", (-F.shiftrightunsigned("salt", 1) - 1).alias("salt"), F.lit(0).cast("byte").alias("sign"), F.col("age").cast("short").alias("lo"), F.col("age").cast("short").alias("hi"),
            F.lit(None).cast(rows.schema["filter_id"].dataType).alias("filter_id"))

    def ends(wanted: DataFrame) -> DataFrame:
        last, first = (F.struct(at.alias("at"), F.lit(sign).cast("byte").alias("sign")) for at, sign in ((F.col("charge.hi"), 1), (F.col("charge.lo") - 1, -1)))
        return grouped(wanted.withColumn("end", F.explode(F.when(F.col("charge.lo") < 0, F.array(last)).otherwise(F.array(last, first))))).select(
            "group", "end.at", F.shiftrightunsigned(F.xxhash64("filter_id"), 1).alias("salt"), "end.sign", F.col("age.lo").cast("short").alias("lo"), F.col("age.hi").cast("short").alias("hi"), "filter_id")

    keys = ["group", "at", "salt"]
    n = whole.count() * len(used) + 2 * rows.count()
    chunks = -(-n // CHUNK_ROWS)
    share = min(1.0, chunks * SAMPLES_PER_CHUNK / n)
    sample = sorted(tuple(r) for r in points(whole.sample(share, 1)).unionByName(ends(wanted.sample(share, 1))).select(*keys).collect())
    bounds = sorted({sample[i * len(sample) // chunks] for i in range(1, chunks)}) if sample else []
    placed = _place_among(bounds, keys)
    cut = F.lit([b[0] for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # claims of the group that goes on in the next chunk, and from them what every chunk's first group has before
    held = (
        placed(points(whole)).withColumn("group", F.when(F.get(cut, F.col("chunk")) == F.col("group"), F.col("group")))
        .groupBy("chunk", "group", F.col("lo").cast("int").alias("age")).agg(F.count("group").alias("n")).filter("n > 0"))
    every = claims.sparkSession.range(0, len(bounds), 1, 1).select(
        F.col("id").cast("int").alias("chunk"), F.get(cut, F.col("id").cast("int")).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(AGELESS))).alias("age"), F.lit(0).cast("long").alias("n"))
    starts = (
        held.unionByName(every).groupBy("group", "age", "chunk").agg(F.sum("n").alias("n"))
        .select("group", "age", F.sum("n").over(Window.partitionBy("group", "age").orderBy("chunk")).alias("n"), (F.col("chunk") + 1).alias("chunk"))
        .filter("n > 0"))
    line = placed(points(whole).unionByName(ends(wanted)))
    counted = line.groupBy("chunk").cogroup(starts.groupBy("chunk")).applyInArrow(
        _chunk_counts, T.StructType([T.StructField("filter_id", rows.schema["filter_id"].dataType), T.StructField("n", T.LongType())]))
    return counted.groupBy("filter_id").agg(F.sum("n").alias("n_passed"))


def named_lines(lines: DataFrame, code: str, kind: str, tables: RuleTables, rows: DataFrame) -> DataFrame:
    """Child lines whose code a sound rule of ``rows`` names, as no other can decide a condition; all of them if a condition asks whether
    there are any codes, or if rules and codes are too many to be broadcast."""
    asked = rows.filter(F.col("error") == "").select(F.explode("conditions").alias("c")).select("c.*").filter(F.col("kind") == kind)
    if not tables.small or not asked.filter(~F.col("op").isin("=", "in")).isEmpty():
        return lines
    return lines.join(F.broadcast(asked.select(F.explode("codes").alias(code)).distinct()), code, "left_semi")


def rule_coverage(
    claims: DataFrame, diagnoses: DataFrame, procedures: DataFrame, filters: DataFrame, code_sets: DataFrame
) -> DataFrame:
    """Pass count of every active rule over all claims, for rule sets of any size.

    A claim meets only the rules one of its facts leads to, and those are decided in the same row,
    so nothing but per-rule counts is shuffled after the claim's codes are together. Lines with codes that no rule names go before that. A rule that
    several codes of a claim lead to is counted for the first of them. Rules of numbers alone are found by dyadic intervals, so a claim
    meets those whose interval it lies in. Of more than ``COMPILED_RULES`` rules, those of intervals are counted by ``counted_passes`` instead.
    """
    tables = RuleTables(filters, code_sets, lambda rows: with_spans(rows, claims))
    rest, counted = tables.rows, None
    if not tables.few:
        rest, spans = (tables.rows.filter(x) for x in ("filter_id IS NOT NULL AND span IS NULL", "span IS NOT NULL"))
        if not spans.isEmpty():
            claims = reuse(claims.select("claim_id", *NUMBERS.values(), "provider_type", "place_of_service"))
            counted = counted_passes(claims, spans)
    own = (
        F.when(F.col("kind") == "diagnosis", F.col("diagnosis_codes"))
        .when(F.col("kind") == "procedure", F.col("procedure_codes"))
        .otherwise(F.array("value"))
    )
    first = F.col("key_codes").isNull() | (F.col("value") == F.array_min(F.array_intersect("key_codes", own)))
    if counted is not None and rest.isEmpty():
        passed = counted
    else:
        diagnoses = named_lines(diagnoses, "diagnosis_code", "diagnosis", tables, rest)
        procedures = named_lines(procedures, "procedure_code", "procedure", tables, rest)
        passed = (
            rule_hits(claims, coded_claims(claims, diagnoses, procedures), tables, rest)
            .filter(first & _passed())
            .groupBy("filter_id").agg(F.count(F.lit(1)).alias("n_passed"))
        )
        passed = passed if counted is None else passed.unionByName(counted)
    return tables.rows.join(passed, "filter_id", "left").select(
        "filter_id", "filter_name",
        claims.agg(F.count(F.lit(1))).scalar().alias("n_claims"),
        F.coalesce("n_passed", F.lit(0)).alias("n_passed"),
        "error",
    )


# ---------------------------------------------------------------------------
# Compiled form
# ---------------------------------------------------------------------------

class TooManyRules(ValueError):
    """The rule set is too large to be part of a plan; use the joined form."""


def compile_rules(filters: DataFrame, code_sets: DataFrame, most: int | None = None) -> list[dict]:
    """Active rules as plan-time metadata: header fields and a boolean Column over a claim row
    with ``diagnosis_codes`` and ``procedure_codes``. Raises ``TooManyRules`` beyond the limits,
    before anything larger than them is fetched."""
    most = COMPILED_RULES if most is None else most
    active = filters.filter("active")
    headers = active.select(
        "filter_id", "filter_name", F.lit(OUTCOME_TYPE).alias("rule_type"), F.coalesce("description", F.lit("")).alias("details")
    ).limit(most + 1).collect()
    if len(headers) > most:
        raise TooManyRules(f"more than {most} active rules")
    conditions: dict[int, list] = {h.filter_id: [] for h in headers}
    for c in rule_conditions(active).collect():
        conditions[c.filter_id].append(c)
    names = sorted({n for cs in conditions.values() for c in cs for n in c.set_names or []})
    members: dict[str, set[str]] = {}
    if names:
        rows = code_sets.filter(F.col("set_name").isin(names)).limit(COMPILED_CODES + 1).collect()
        if len(rows) > COMPILED_CODES:
            raise TooManyRules(f"more than {COMPILED_CODES} codes in the sets of the rules")
        for r in rows:
            members.setdefault(r.set_name, set()).add(r.code)
    return [
        {**h.asDict(), **_compiled(conditions[h.filter_id], members)}
        for h in sorted(headers, key=lambda h: h.filter_id)
    ]


def _compiled(conditions: list, members: dict[str, set[str]]) -> dict:
    errors = [c.error for c in conditions if c.error] + [
        f"unknown code set: {n}" for c in conditions for n in c.set_names or [] if n not in members
    ]
    if errors:
        return {"error": min(errors), "passes": F.lit(False)}
    tests = [_condition_column(c, members) for c in conditions]
    return {"error": "", "passes": F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))}


def _condition_column(c, members: dict[str, set[str]]) -> Column:
    if c.kind in NUMERIC:
        value = F.col("patient_age" if c.kind == "age" else "total_charge_amount").cast("double")
        return _compare(value, F.lit(c.op), F.lit(c.value_num))
    codes = sorted(set.intersection(*[members[n] for n in c.set_names])) if c.op == "in" else [c.value_str]
    if c.kind in CODED:
        held = F.col(f"{c.kind}_codes")
        if c.op == "exists":
            return F.size(held) > 0
        return F.arrays_overlap(held, F.array(*map(F.lit, codes))) if codes else F.lit(False)
    held = F.col("provider_type" if c.kind == "provider" else "place_of_service")
    if c.op == "exists":
        return held.isNotNull()
    return held.isin(codes) if codes else F.lit(False)


def rule_outcomes(compiled: list[dict], predicted: Column | None = None) -> Column:
    """Array of outcome structs for one claim row: all compiled rules in id order, or those of
    ``predicted`` in its order."""
    if not compiled:
        return F.array().cast("array<struct<filter_id:int,filter_name:string,passed:boolean,rule_type:string,details:string,error:string>>")
    outcomes = F.array(*[
        F.struct(
            F.lit(r["filter_id"]).cast("int").alias("filter_id"),
            F.lit(r["filter_name"]).alias("filter_name"),
            r["passes"].alias("passed"),
            F.lit(r["rule_type"]).alias("rule_type"),
            F.lit(r["details"]).alias("details"),
            F.lit(r["error"]).alias("error"),
        ) for r in compiled
    ])
    if predicted is None:
        return outcomes
    return F.flatten(F.transform(predicted, lambda i: F.filter(outcomes, lambda o: o["filter_id"] == i)))


def evaluate_all_active(coded: DataFrame, filters: DataFrame, code_sets: DataFrame) -> DataFrame:
    """One row per claim and active rule, from claim rows with code arrays: compiled form, or the
    joined one for more rules than a plan should hold."""
    try:
        outcomes = rule_outcomes(compile_rules(filters, code_sets))
    except TooManyRules:
        ids = filters.filter("active").agg(F.collect_list("filter_id")).scalar()
        return evaluate_coded(coded.withColumn("filter_id", F.explode(ids)), RuleTables(filters, code_sets))
    return coded.select("claim_id", F.explode(outcomes).alias("o")).select("claim_id", "o.*")
