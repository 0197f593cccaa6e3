"""Large sets of decision rules as tables.

``apply_rules`` puts every rule into the plan, which suits tens or hundreds. Here rules are rows, and the plan is the same for ten rules and for ten
thousand: it grows only with the fields that the rules name.

Each rule is a *program*, its condition in postfix order, that one expression can run over a row's facts (the named fields as conditions see
them). Running all programs on all rows would cost rows times rules, so each rule also gives *postings*: keys of which a row must have one if the rule is
to match. Of an ``all`` the most selective part gives them, of an ``any`` every part does. Equality gives the field's value, a part of a text its
rarest three letters among the rules, other operators only that the field is there, and what can match a missing field the one key of all rows.
Rows meet their candidates by a join on keys; a candidate counts once its program says so. The first match that decides stands, else the last.

``build`` compiles rules that the driver holds, ``build_table`` a table of rule documents by the tasks that read it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from logweir.functions.fields import Entry
from logweir.functions.regex import InvalidPattern, java_pattern
from logweir.functions.values import NAN_TEXT, NUMERIC_TEXT, literal_number, literal_text
from logweir.operators.conditions import ALIASES
from logweir.operators.model import Condition, Rule, RuleError, in_order
from logweir.operators.rules import KEEP, Options
from logweir.session import materialise, ship

COMPARISONS = ("eq", "ne", "gt", "lt", "ge", "le")
PARTS = ("contains", "starts_with", "ends_with")
GRAM = 3
TAGS = 1 << 16
SALTS = 16
# How many rows a posting of each class lets through: values, parts of texts, fields that are there, all rows.
VALUE, PART, PRESENT, EVERY = range(4)

STEP = "struct<op:string,n:int,field:int,kind:string,text:string,num:double,nil:boolean>"
PROGRAM = f"rank long, rule_id string, ends boolean, keep boolean, rate double, salt string, program array<{STEP}>"
POSTING = "rank long, class int, field int, text string, num double"
# A rule as its task compiles it: fields are numbered by each rule for itself.
COMPILED = (
    f"id string, ends boolean, keep boolean, rate double, salt string, program array<{STEP}>, "
    "keys array<struct<class:int,field:int,text:string,num:double>>, fields array<string>, texts array<string>, error string"
)
COLUMNS = ("id", "ends", "keep", "rate", "salt", "program", "keys", "fields", "texts", "error")
_STEPS = pa.list_(pa.struct({"op": pa.string(), "n": pa.int32(), "field": pa.int32(), "kind": pa.string(), "text": pa.string(), "num": pa.float64(), "nil": pa.bool_()}))
_KEYS = pa.list_(pa.struct({"class": pa.int32(), "field": pa.int32(), "text": pa.string(), "num": pa.float64()}))
ARROW = (pa.string(), pa.bool_(), pa.bool_(), pa.float64(), pa.string(), _STEPS, _KEYS, pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
FACT = "struct<present:boolean,nil:boolean,text:string,plain:string,num:double>"


@dataclass(frozen=True)
class RuleIndex:
    programs: DataFrame
    postings: DataFrame
    fields: dict[str, int]  # the fields that the rules name, by number
    parts: frozenset[int]  # fields of which some posting is a part of the text
    texts: frozenset[int]  # fields of which some step needs the full text
    tags: DataFrame  # what the keys of postings look like: a bounded table
    kinds: frozenset[str]  # those tags of which the driver knows all: classes and fields, not parts of texts
    rejected: DataFrame | None = None  # documents of a rule table that are no decision rule: scope, body, error


def kind_of(entry: Entry, field: str) -> str:
    """``Value.numeric`` of a field, told by the types alone."""
    place = entry.place(field)
    kind = entry.columns[place.column] if place.column and not entry.shadow else T.StringType()
    if isinstance(kind, (T.StringType, T.VariantType)):
        return "text"
    return "always" if isinstance(kind, T.NumericType) else "never"


class _Compiler:
    def __init__(self, entry: Entry, kinds: dict[str, str] | None = None) -> None:
        self.entry = entry
        self.fields: dict[str, int] = {}
        self.texts: set[int] = set()
        self.kinds = {} if kinds is None else kinds  # rules of one task share what they know of fields

    def kind(self, field: str) -> str:
        """Whether the field's values are numbers always, never, or where their text reads like one."""
        if field not in self.kinds:
            self.kinds[field] = kind_of(self.entry, field)
        return self.kinds[field]

    def number(self, field: str) -> int:
        return self.fields.setdefault(field, len(self.fields))

    def step(self, op: str, n: int = 0, field: str | None = None, text: str | None = None, num: float | None = None, nil: bool = False) -> tuple:
        kind = self.kind(field) if field is not None else None
        return (op, n, None if field is None else self.number(field), kind, text, num, nil)

    def program(self, cond: Condition) -> list[tuple]:
        """The condition in postfix order: leaves push a boolean (null: in error), ``all``, ``any`` and ``not`` take some and push one."""
        if cond.all or cond.any:
            parts = cond.all or cond.any
            return [s for c in parts for s in self.program(c)] + [self.step("all" if cond.all else "any", len(parts))]
        if cond.negated is not None:
            return [*self.program(cond.negated), self.step("not", 1)]
        op, value = ALIASES.get(cond.operator, cond.operator), cond.value
        if op in ("exists", "not_exists"):
            return [self.step(op, field=cond.field)]
        if op in ("in", "not_in") and isinstance(value, (list, tuple)):
            some = [s for x in value for s in self._compare("eq", cond.field, x)] + [self.step("any", len(value))]
            return some if op == "in" else [self.step("exists", field=cond.field), *some, self.step("not", 1), self.step("all", 2)]
        if op in COMPARISONS:
            return self._compare(op, cond.field, value)
        if op in PARTS or op == "matches" and isinstance(value, str):
            if not isinstance(value, str):
                return [self.step("any", 0)]  # no text: never
            if op == "matches":
                try:
                    value = java_pattern(value)
                except InvalidPattern:
                    return [self.step("fault", field=cond.field)]
            self.texts.add(self.number(cond.field))
            return [self.step(op, field=cond.field, text=value)]
        return [self.step("fault", field=cond.field)]

    def _compare(self, op: str, field: str, value) -> list[tuple]:
        wanted = literal_number(value)
        if value is not None and (wanted is not None and self.kind(field) == "never" or wanted is None and op not in ("eq", "ne")):
            self.texts.add(self.number(field))
        return [self.step(op, field=field, text=literal_text(value), num=wanted, nil=value is None)]

    def access(self, cond: Condition) -> tuple[int, list[tuple]]:
        """The class of the weakest key, and keys (class, field, text, number) of which a matching row has one; none: no row matches."""
        if cond.all:
            return min((self.access(c) for c in cond.all), key=lambda a: (a[0], len(a[1])))
        if cond.any:
            found = [self.access(c) for c in cond.any]
            return max(rank for rank, _ in found), [k for _, keys in found for k in keys]
        op, value = ALIASES.get(cond.operator, cond.operator), cond.value
        if cond.negated is not None or op == "not_exists":
            return EVERY, [(EVERY, None, "", None)]
        field = self.number(cond.field)
        present = (PRESENT, [(PRESENT, field, "", None)])
        if op == "in" and isinstance(value, (list, tuple)):
            found = [self.access(Condition(cond.field, "eq", x)) for x in value]
            return max((rank for rank, _ in found), default=VALUE), [k for _, keys in found for k in keys]
        if op == "eq" and value is not None:
            wanted = literal_number(value)
            if wanted is None or self.kind(cond.field) == "never":
                return VALUE, [(VALUE, field, literal_text(value), None)]
            # a value that is no number equals every number
            return present if math.isnan(wanted) else (VALUE, [(VALUE, field, None, wanted), (VALUE, field, None, math.nan)])
        if op in PARTS and isinstance(value, str) and len(value) >= GRAM:
            return PART, [(PART, field, value, None)]
        if op in PARTS and not isinstance(value, str) or op not in COMPARISONS and [s[0] for s in self.program(cond)] == ["fault"]:
            return VALUE, []
        return present


def _grams(text: str) -> list[str]:
    return [text[i : i + GRAM] for i in range(len(text) - GRAM + 1)]


def _decision(rule: Rule, seed: int, start: Callable[[], str] = str) -> tuple[bool, bool | None, float | None, str] | None:
    """Whether the rule ends the evaluation, its decision, and for a sample the rate and what its hash is salted with: the id, the start of a version, the seed."""
    keep, rate, salt = None, None, ""
    for j, action in enumerate(rule.actions):
        if action.type in ("keep", "drop"):
            return True, action.type == "keep", None, ""
        if action.type != "sample":
            raise ValueError(f"rule {rule.id}: {action.type} is no decision")
        rate = float(action.number("rate", 1.0))
        salt = f"{rule.id}{start()}:{seed}" if j == 0 else f"{rule.id}{start()}:{seed}:{j}"
    return None if rate is None else (False, keep, rate, salt)


def build(spark: SparkSession, rules: list[Rule], like: DataFrame, options: Options = Options()) -> RuleIndex:
    """Programs and postings of the enabled decision rules (keep, drop, sample), as tables of the shared folder.

    ``like``: a table with the columns of the rows that will be ruled.
    """
    if options.operators or options.handlers or options.compat:
        raise ValueError("an index holds the built-in operators and decisions only")
    compiler = _Compiler(Entry.of(like, options.fields, options.shadow))
    programs, keys = [], []
    for rank, rule in enumerate(in_order(rules)):
        decision = _decision(rule, options.seed)
        if decision is None:
            continue  # no action, no effect
        programs.append((rank, rule.id, *decision, compiler.program(rule.condition)))
        keys += [(rank, *k) for k in set(compiler.access(rule.condition)[1])]
    # a part of a text is looked for by those three of its letters that fewest other parts have
    shared = Counter(g for text in {k[3] for k in keys if k[1] == PART} for g in set(_grams(text)))
    postings = [(r, c, f, min(_grams(t), key=lambda g: (shared[g], g)) if c == PART else t, n) for r, c, f, t, n in keys]
    stored = materialise(_keyed(spark.createDataFrame(postings, POSTING)).select("key", "rank").distinct(), "rule-postings")
    return RuleIndex(
        materialise(spark.createDataFrame(programs, PROGRAM), "rule-programs"),
        stored,
        compiler.fields,
        frozenset(k[2] for k in keys if k[1] == PART),
        frozenset(compiler.texts),
        *tags(stored),
    )


def tags(postings: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    found = materialise(postings.select(_tag(F.col("key")).alias("tag")).distinct(), "rule-tags")
    return found, frozenset(r[0] for r in found.filter(F.contains("tag", F.lit(":"))).collect())


def _tag(key: Column) -> Column:
    """The class and field of a key, for parts of texts one of ``TAGS`` hashes: a row's key without a like tag meets no posting."""
    return F.when(key.startswith(f"{PART}:"), F.pmod(F.xxhash64(key), F.lit(TAGS)).cast("string")).otherwise(F.substring_index(key, ":", 2))


# what a document can have wrong
UNUSABLE = (RuleError, ValueError, AttributeError, TypeError)


def without_effect(entry: Entry, rule_id: str | None, error: str | None = None) -> tuple:
    """The ``COLUMNS`` of a rule that never holds."""
    return (rule_id, None, None, None, None, [_Compiler(entry).step("any", 0)], [], [], [], error)


def compiled(entry: Entry, rule: Rule, decision: tuple, kinds: dict[str, str]) -> tuple:
    """The ``COLUMNS`` of a rule."""
    compiler = _Compiler(entry, kinds)
    program, keys = compiler.program(rule.condition), compiler.access(rule.condition)[1]
    if len(keys) > 1:
        keys = sorted(set(keys), key=repr)
    names = list(compiler.fields)
    return (rule.id, *decision, program, keys, names, [names[i] for i in sorted(compiler.texts)], None)


def batch(beside: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    """``COLUMNS`` of one rule after the other, behind the columns of ``beside``."""
    columns = zip(*rows, strict=True) if rows else [()] * len(ARROW)
    return pa.RecordBatch.from_arrays([*beside.columns, *(pa.array(c, t) for c, t in zip(columns, ARROW, strict=True))], [*beside.schema.names, *COLUMNS])


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over all tasks by the columns, however few files hold them: compiling a document costs far more than moving it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _numbers(fields: dict[str, int]) -> Column:
    """The numbers of a compiled rule's ``fields``."""
    numbers = F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*map(F.lit, fields.values()))) if fields else F.create_map(F.lit(""), F.lit(0))
    return F.transform("fields", lambda f: F.element_at(numbers, f))


def numbered(fields: dict[str, int]) -> Column:
    """The ``program`` of a compiled rule with the numbers that all rules give the fields."""
    return F.transform("program", lambda s: s.withField("field", F.when(s["field"].isNotNull(), F.get(_numbers(fields), s["field"]))))


def posted(made: DataFrame, by: str) -> tuple[DataFrame, dict[str, int], frozenset[int], frozenset[int], DataFrame, frozenset[str]]:
    """What a ``RuleIndex`` of ``COLUMNS`` holds beside programs: one numbering of all fields, and postings by ``by``.

    Only the names of the fields that rules read come to the driver.
    """
    named = [r[0] for r in made.select(F.explode("fields").alias("f")).distinct().orderBy("f").collect()]
    number = {name: i for i, name in enumerate(named)}
    texts = frozenset(number[r[0]] for r in made.select(F.explode("texts").alias("f")).distinct().collect())
    keys = made.select(by, F.explode("keys").alias("k"), _numbers(number).alias("_fields")).select(
        by, F.col("k.class").alias("class"), F.when(F.col("k.field").isNotNull(), F.get("_fields", F.col("k.field"))).alias("field"), F.col("k.text").alias("text"), F.col("k.num").alias("num")
    )
    part = F.col("class") == PART
    # a part of a text is looked for by those three of its letters that fewest other parts have
    spots = F.sequence(F.lit(1), F.char_length("text") - GRAM + 1)
    grams = keys.filter(part).select("text").distinct().withColumn("gram", F.explode(F.array_distinct(F.transform(spots, lambda i: F.substr(F.col("text"), i, F.lit(GRAM))))))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(shared, "gram").groupBy("text").agg(F.min(F.struct("n", "gram")).alias("r")).select("text", F.col("r.gram").alias("gram"))
    whole = keys.filter(~part).unionByName(keys.filter(part).join(rarest, "text").select(by, "class", "field", F.col("gram").alias("text"), "num"))
    postings = materialise(_keyed(whole).select("key", by).distinct(), "rule-postings")
    parts = frozenset(r[0] for r in keys.filter(part).select("field").distinct().collect())
    return postings, number, parts, texts, *tags(postings)


def _compile(entry: Entry, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[str, str] = {}
        for rows in batches:
            out = []
            for scope, body in zip(rows["scope"].to_pylist(), rows["body"].to_pylist(), strict=True):
                try:
                    rule = Rule.parse(body, scope=scope or "")
                    rule.id.encode()  # rules are told apart and ordered by it
                except UNUSABLE as error:
                    out.append(without_effect(entry, None, str(error)))
                    continue
                try:
                    decision = _decision(rule, seed) if rule.enabled else None
                except UNUSABLE as error:
                    out.append(without_effect(entry, rule.id, str(error)))
                    continue
                out.append(without_effect(entry, rule.id) if decision is None else compiled(entry, rule, decision, kinds))
            yield batch(rows, out)

    return run


def build_table(store: DataFrame, like: DataFrame, options: Options = Options()) -> RuleIndex:
    """``build`` for a rule table (``schemas.RULE_STORE``) of any size: documents are compiled by the tasks that read them.

    Rules are ranked by scope and id; of two with one key the later row stands. Documents that can't be used have no effect, ``rejected`` lists them.
    """
    if options.operators or options.handlers or options.compat:
        raise ValueError("an index holds the built-in operators and decisions only")
    spark = store.sparkSession
    ship(spark)
    rows = store.select("scope", "body", F.monotonically_increasing_id().alias("_place"))
    made = spread(rows, "_place").mapInArrow(_compile(Entry.of(like, options.fields, options.shadow), options.seed), f"scope string, body string, _place long, {COMPILED}")
    made = materialise(made, "rules-compiled")
    rank = F.struct(F.coalesce("scope", F.lit("")).alias("scope"), "id").alias("rank")
    rules = made.filter("id is not null").select(rank, "_place", F.struct(*COLUMNS).alias("r"))
    last = rules.groupBy("rank").agg(F.max("_place").alias("_place"))
    # rules that are disabled, unusable or do nothing have no decision
    held = rules.join(last.hint("merge"), ["rank", "_place"], "left_semi").filter("r.ends is not null").select("rank", "r.*")
    rest = posted(held, "rank")
    programs = materialise(held.select("rank", F.col("id").alias("rule_id"), "ends", "keep", "rate", "salt", numbered(rest[1]).alias("program")), "rule-programs")
    return RuleIndex(programs, *rest, made.filter("error is not null").select("scope", "body", "error"))


def _key(kind: int, field: Column | int | None, text: Column, letter: str = "") -> Column:
    tag = F.lit(f"{kind}:") if field is None else F.concat(F.lit(f"{kind}:"), (field if isinstance(field, Column) else F.lit(field)).cast("string"), F.lit(f":{letter}"))
    return F.concat(tag, text)


def _number_key(num: Column) -> Column:
    return (num + F.lit(0.0)).cast("string")  # no zero is negative


def _keyed(postings: DataFrame) -> DataFrame:
    field = F.col("field")
    value = F.when(F.col("num").isNull(), _key(VALUE, field, F.col("text"), "t")).otherwise(_key(VALUE, field, _number_key(F.col("num")), "n"))
    every = F.when(F.col("class") == EVERY, _key(EVERY, None, F.lit("")))
    return postings.withColumn(
        "key", every.when(F.col("class") == VALUE, value).when(F.col("class") == PART, _key(PART, field, F.col("text"))).otherwise(_key(PRESENT, field, F.lit("")))
    )


def _facts(entry: Entry, index: RuleIndex) -> Column:
    out = []
    for name, number in index.fields.items():
        v = entry.value(name)
        num = F.lit(None).cast("double")
        if v.numeric == "always":
            num = v.raw.cast("double")
        elif v.numeric == "text":
            num = F.when(v.plain.rlike(NUMERIC_TEXT), v.plain.try_cast("double")).when(v.plain.rlike(NAN_TEXT), F.lit(math.nan))
        nil = F.lit(False) if v.null is None else F.coalesce(v.null, F.lit(False))
        # the full text costs more than the plain one, so only where a step needs it
        text = v.text if number in index.texts or number in index.parts else F.lit(None)
        out.append(F.struct(v.present.alias("present"), nil.alias("nil"), text.cast("string").alias("text"), v.plain.alias("plain"), num.alias("num")))
    return F.array(*out) if out else F.array().cast(f"array<{FACT}>")


def _part_keys(number: int, text: Column) -> Column:
    last = F.char_length(text) - GRAM + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), last))
    keys = F.transform(spots, lambda i: _key(PART, number, F.substr(text, i, F.lit(GRAM))))
    return F.coalesce(keys, F.array().cast("array<string>"))


def _row_keys(index: RuleIndex, facts: Column) -> Column:
    """The keys of a row: value, parts and presence of each field, and the key of all rows, each if some posting is of its kind."""
    found = [F.array(_key(EVERY, None, F.lit(""))) if f"{EVERY}:" in index.kinds else F.array().cast("array<string>")]
    for number in index.fields.values():
        f = F.get(facts, F.lit(number))
        if f"{PRESENT}:{number}" in index.kinds:
            found.append(F.array(F.when(f["present"], _key(PRESENT, number, F.lit("")))))
        if f"{VALUE}:{number}" in index.kinds:
            found.append(F.array(_key(VALUE, number, f["plain"], "t"), _key(VALUE, number, _number_key(f["num"]), "n")))
        if number in index.parts:
            found.append(_part_keys(number, f["text"]))
    return F.array_distinct(F.array_compact(F.concat(*found)))


def _applied(op: Column, left: Column, right: Column) -> Column:
    out = F.when(op == "eq", left == right).when(op == "ne", left != right).when(op == "gt", left > right)
    return out.when(op == "lt", left < right).when(op == "ge", left >= right).otherwise(left <= right)


def _leaf(f: Column, s: Column) -> Column:
    """What ``Value.compare`` and the text operators say, from data."""
    op, kind = s["op"], s["kind"]
    tie = op.isin("eq", "ge", "le")  # neither below nor above
    numbers = F.when(F.isnan(s["num"]) | F.isnan(f["num"]), tie).otherwise(_applied(op, f["num"], s["num"]))
    words = _applied(op, F.when(op.isin("eq", "ne") & s["num"].isNull(), f["plain"]).otherwise(f["text"]), s["text"])
    compared = (
        F.when(s["num"].isNull() | (kind == "never"), words)
        .when(kind == "always", numbers)
        .otherwise(F.when(f["num"].isNotNull(), numbers).otherwise(_applied(op, f["plain"], s["text"])))
    )
    compared = F.when(f["nil"], op.isin("ne", "lt", "le")).otherwise(compared)
    to_null = F.when(op.isin("eq", "le"), f["nil"]).when(op.isin("ne", "gt"), ~f["nil"]).otherwise(op == "ge")
    text = f["text"]
    found = (
        F.when(op == "exists", F.lit(True))
        .when(op == "contains", F.contains(text, s["text"]))
        .when(op == "starts_with", F.startswith(text, s["text"]))
        .when(op == "ends_with", F.endswith(text, s["text"]))
        .when(op == "matches", F.rlike(text, s["text"]))
        .when(s["nil"], to_null)
        .otherwise(compared)
    )
    sound = F.when(~f["present"], op == "not_exists").otherwise(F.coalesce((op != "not_exists") & found, F.lit(False)))
    return F.when((op == "fault") & f["present"], F.lit(None).cast("boolean")).when(op == "fault", F.lit(False)).otherwise(sound)


def run_program(program: Column, facts: Column) -> Column:
    """Whether the condition holds for the facts; false where it is in error."""

    def step(stack: Column, s: Column) -> Column:
        rest = F.slice(stack, F.lit(1), F.size(stack) - s["n"])
        taken = F.slice(stack, F.size(stack) - s["n"] + 1, s["n"])
        # left to right: the first part that is in error or settles it stands
        against = F.filter(taken, lambda x: x.isNull() | ~x)
        in_favour = F.filter(taken, lambda x: x.isNull() | x)
        made = (
            F.when(s["op"] == "all", F.when(F.size(against) == 0, F.lit(True)).otherwise(F.get(against, F.lit(0))))
            .when(s["op"] == "any", F.when(F.size(in_favour) == 0, F.lit(False)).otherwise(F.get(in_favour, F.lit(0))))
            .when(s["op"] == "not", ~F.get(taken, F.lit(0)))
            .otherwise(_leaf(F.get(facts, s["field"]), s))
        )
        return F.concat(rest, F.array(made))

    return F.coalesce(F.get(F.aggregate(program, F.array().cast("array<boolean>"), step), F.lit(0)), F.lit(False))


def _sealed(df: DataFrame, index: RuleIndex, options: Options) -> DataFrame:
    """Rows with their facts and two hashes of them and of the row's key: rows with like hashes are decided alike."""
    entry = Entry.of(df, options.fields, options.shadow)
    key = F.col(options.key) if options.key in df.columns else F.lit(0)
    out = df.withColumns({"_facts": _facts(entry, index), "_row": key.cast("string")})
    return out.withColumns({"_one": F.xxhash64(F.lit(1), "_row", "_facts"), "_two": F.xxhash64(F.lit(2), "_facts", "_row")})


def candidates(rows: DataFrame, index: RuleIndex, *keep: str) -> DataFrame:
    """``keep`` of sealed rows with every posting that one of their keys meets."""
    asked = rows.select(*keep, F.explode(_row_keys(index, F.col("_facts"))).alias("key"))
    asked = asked.withColumn("tag", _tag(F.col("key"))).join(F.broadcast(index.tags), "tag", "left_semi").drop("tag")
    # keys other than values are those of very many rows, so their postings are there once per salt
    value = F.col("key").startswith(f"{VALUE}:")
    asked = asked.withColumn("_salt", F.when(value, 0).otherwise(F.pmod("_one", F.lit(SALTS))).cast("int"))
    postings = index.postings.withColumn("_salt", F.explode(F.when(value, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    # small as files, but many times that in memory: rule tables are never broadcast
    return asked.join(postings.hint("merge"), ["key", "_salt"]).drop("key", "_salt").distinct()


def matches(df: DataFrame, index: RuleIndex, options: Options = Options()) -> DataFrame:
    """A row for each distinct row (``_one``, ``_two``) and rule that matches it: rank, rule_id, ends, keep."""
    rows = _sealed(df, index, options).select("_one", "_two", "_row", "_facts").dropDuplicates(["_one", "_two"])
    asked = candidates(rows, index, "_one", "_two")
    met = asked.join(rows, ["_one", "_two"]).join(index.programs.hint("merge"), "rank").filter(run_program(F.col("program"), F.col("_facts")))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "_row", "salt")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return met.select("_one", "_two", "rank", "rule_id", "ends", F.when(F.col("rate").isNull(), F.col("keep")).otherwise(drawn < F.col("rate")).alias("keep"))


def apply_index(df: DataFrame, index: RuleIndex, options: Options = Options(), *, drop: bool = True) -> DataFrame:
    """What ``apply_rules`` gives for the indexed rules: the kept rows, or with ``drop=False`` all rows and ``rule_keep``.

    Every leaf is compared as ``apply_rules`` compares it, numbers as doubles. Rows may repeat; a key column tells rows apart for sampling only.
    """
    columns = df.columns
    choice = F.struct("rank", "keep")
    decided = matches(df, index, options).groupBy("_one", "_two").agg(F.min(F.when(F.col("ends"), choice)).alias("_first"), F.max(F.when(~F.col("ends"), choice)).alias("_last"))
    keep = F.coalesce("_first.keep", "_last.keep", F.lit(True)).alias(KEEP)
    out = _sealed(df, index, options).join(decided, ["_one", "_two"], "left").select(*columns, keep)
    return out.filter(KEEP).drop(KEEP) if drop else out
