"""Detection by thousands of rules: an index of their literals finds candidates, data decides them.

A rule is a row: its selections as tests, its condition as the ways in which
selections can hold together.  Each way needs some literal in some field, so a
rule falls into parts, one for each such literal.  One automaton for each field,
over the literals of all rules, finds in one pass the parts that may hold for a
message.  Messages meet only these, each distinct one once however many rules
share it, by an equi-join, and one expression that reads the part's row decides.
Rules are counted from their parts.  The plan does not depend on the number of
rules.  A way that needs no literal is a candidate for every message.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import product

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from sluiceway.functions.expressions import safe_pattern
from sluiceway.operators.detect import ALIASES, Algebra, condition, runs_here, selections
from sluiceway.staging import written

_TEST = "struct<field:string,op:string,values:array<string>,every:boolean,fold:boolean>"
RULES = f"rule_ord long, title string, level string, selections array<array<array<{_TEST}>>>, ways array<array<struct<selection:int,negated:boolean>>>"
#: Characters of the literals of one pass over the messages; an automaton takes some 60 bytes for each.
PASS_CHARS = 4 << 20
#: Bytes of rules up to which they are sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: The key of rules that any message may fire.
ANY = 0


# --- rules as rows -----------------------------------------------------------------


def _property(name: str) -> str:
    """The property that a rule's field reads, or the structured field of that name behind `!`."""
    return next((p for p, names in ALIASES.items() if name.lower() in names), "!" + name)


def _test(key: str, values: object) -> tuple:
    name, *modifiers = key.split("|")
    fold = "i" in modifiers
    op = next((m for m in ("contains", "startswith", "endswith", "re") if m in modifiers), "eq")
    found = [str(v) for v in (values if isinstance(values, list) else [values]) if v is not None]
    if op == "re":
        patterns = [safe_pattern(v) for v in found]
        # A pattern that is none finds nothing: no text but the empty one is before its own start.
        found, fold = [("(?i)" if fold else "") + p if p else r"(?!)" for p in patterns], False
    elif fold:
        found = [v.lower() for v in found]
    return _property(name), op, found, "all" in modifiers, fold


def _alternatives(body: object) -> list[list[tuple]]:
    """A selection as alternatives, each of tests that must all hold."""
    if isinstance(body, dict):
        return [[_test(k, v) for k, v in body.items()]]
    return [a for x in (body if isinstance(body, list) else [body]) for a in (_alternatives(x) if isinstance(x, dict) else [[_test("msg|contains", str(x))]])]


def _joined(a: frozenset, b: frozenset) -> frozenset:
    both = (x | y for x, y in product(a, b))
    return frozenset(w for w in both if not any((s, not n) in w for s, n in w))


def _inverse(ways: frozenset) -> frozenset:
    return reduce(_joined, (frozenset(frozenset([(s, not n)]) for s, n in w) for w in ways), frozenset([frozenset()]))


#: Conditions as sets of ways, a way as a set of (selection, negated).
WAYS = Algebra(_joined, frozenset.union, _inverse, frozenset())


def rule_row(number: int, rule: dict) -> tuple:
    """A rule as a row of RULES."""
    named = selections(rule)
    places = {k: frozenset([frozenset([(n, False)])]) for n, k in enumerate(named)}
    ways = condition(rule, places, WAYS) if runs_here(rule) else frozenset()
    return number, str(rule["title"]), str(rule.get("level", "")), [_alternatives(v) for v in named.values()], sorted(sorted(w) for w in ways)


def rule_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    return spark.createDataFrame([rule_row(k, r) for k, r in enumerate(rules)], RULES)


def templated_rules(rows: DataFrame, number: str, template: dict) -> DataFrame:
    """A rule for each row: {column} in the template's title, level and values stands for the row's value.

    Values are taken as they are; with the modifier i their letters are lowered;
    patterns cannot hold columns.
    """
    _, title, level, chosen, ways = rule_row(0, template)

    def filled(text: str, fold: bool = False) -> Column:
        parts = re.split(r"\{(\w+)\}", text)
        c = F.concat(*(F.coalesce(F.col(p).cast("string"), F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)))
        return F.lower(c) if fold and len(parts) > 1 else c

    def test(t: tuple) -> Column:
        field, op, values, every, fold = t
        return F.struct(F.lit(field).alias("field"), F.lit(op).alias("op"), F.array(*(filled(v, fold) for v in values)).cast("array<string>").alias("values"), F.lit(every).alias("every"), F.lit(fold).alias("fold"))

    body = F.array(*(F.array(*(F.array(*map(test, tests)) for tests in alternatives)) for alternatives in chosen))
    over = F.array(*(F.array(*(F.struct(F.lit(s).alias("selection"), F.lit(n).alias("negated")) for s, n in w)) for w in ways))
    kinds = RULES.split("selections ")[1].split(", ways ")
    return rows.select(F.col(number).cast("long").alias("rule_ord"), filled(title).alias("title"), filled(level).alias("level"), body.cast(kinds[0]).alias("selections"), over.cast(kinds[1]).alias("ways"))


# --- the index -----------------------------------------------------------------------


#: A part of a rule: it fires where its literal is in its field and its row holds; without a literal, where its row holds.
_PART = f"field string, fold boolean, literal string, rule struct<selections:array<array<array<{_TEST}>>>,ways:array<array<struct<selection:int,negated:boolean>>>>"


def parts(chosen: list, ways: list) -> list[tuple]:
    """Field, case folded, literal, selections, ways of the parts of a rule, which fires where any of them does.

    For each way the selection whose shortest literal is longest counts: each of
    its literals makes a part, and only the rest of the way is left to decide, as
    a text that holds the literal needs no second look for it.  A way that needs
    no literal is a part with None.
    """

    def of_test(t: dict) -> list[str] | None:
        values = [v for v in t["values"] if v]
        if t["op"] == "re" or not values or not t["every"] and len(values) < len(t["values"]):
            return None
        return [max(values, key=len)] if t["every"] else values

    def shortest(alternative: list) -> tuple[int, int]:
        """The least length of the literals of the test that has the longest ones, 0 without any, and its place."""
        return max(((min(map(len, found)) if (found := of_test(t)) else 0, -k) for k, t in enumerate(alternative)), default=(0, 0))

    def left(t: dict, literal: str) -> list[dict]:
        """What is to be seen of a test where its literal is in the text."""
        if t["op"] != "contains":
            return [t if t["every"] else t | {"values": [literal]}]
        others = [v for v in t["values"] if v != literal] if t["every"] else []
        return [t | {"values": others}] if others else []

    out = []
    for way in ways:
        if any(not x["negated"] and not chosen[x["selection"]] for x in way):
            continue  # a selection without alternatives never holds
        best, at = max(((min(shortest(a)[0] for a in chosen[x["selection"]]), -k) for k, x in enumerate(way) if not x["negated"]), default=(0, 0))
        rest = [(chosen[x["selection"]], x["negated"]) for k, x in enumerate(way) if not best or k != -at]
        for alternative in chosen[way[-at]["selection"]] if best else [None]:
            place = -shortest(alternative)[1] if best else 0
            for literal in of_test(alternative[place]) if best else [None]:
                tests = [x for k, t in enumerate(alternative) for x in (left(t, literal) if k == place else [t])] if best else []
                own = ([([tests], False)] if tests else []) + rest
                key = (alternative[place]["field"], alternative[place]["fold"], literal) if best else (None, None, None)
                out.append((*key, [s for s, _ in own], [[{"selection": k, "negated": n} for k, (_, n) in enumerate(own)]]))
    return out


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("field", "fold", "literal")
    for b in batches:
        rows = [
            (number, json.dumps(dict(zip(names, found)) | {"rule": {"selections": found[3], "ways": found[4]}}))
            for number, chosen, ways in zip(*(c.to_pylist() for c in b.columns)) for found in parts(chosen, ways)
        ]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string()))], ["rule_ord", "content"])


_automata: dict[str, dict[tuple[str, bool], ahocorasick.Automaton]] = {}


def _automaton(one_pass: str, literals: Broadcast, scan: tuple[str, bool]) -> ahocorasick.Automaton:
    """This worker's automaton for a field, made once for a pass."""
    if one_pass not in _automata:
        _automata.clear()
        made: dict[tuple[str, bool], ahocorasick.Automaton] = {}
        for field, fold, key, literal in literals.value:
            made.setdefault((field, fold), ahocorasick.Automaton()).add_word(literal, key)
        for a in made.values():
            a.make_automaton()
        _automata[one_pass] = made
    return _automata[one_pass][scan]


def _hits(literals: Broadcast, scan: tuple[str, bool], text: Column) -> Column:
    """The keys of the literals that a text holds, each once."""
    one_pass = uuid.uuid4().hex

    def find(texts: pd.Series) -> pd.Series:
        automaton = _automaton(one_pass, literals, scan)
        return pd.Series([list({k for _, k in automaton.iter(t)}) if t else [] for t in texts], dtype=object)

    return F.pandas_udf(find, ArrayType(LongType()))(text)


def fields(messages: DataFrame) -> Column:
    """What rules can read of a message: properties by name, structured fields behind `!`."""
    msg = F.col("props.msg")
    own = {p: F.col(f"props.`{p}`") for p in ALIASES} | {"msg": F.when(F.length(msg) > 0, msg).otherwise(F.col("props.rawmsg"))}
    known = F.create_map(*(x for p, c in own.items() for x in (F.lit(p), c)))
    return F.map_concat(known, F.transform_keys(F.coalesce("structured", F.create_map().cast("map<string,string>")), lambda k, _: F.concat(F.lit("!"), k)))


def _lowered(field: Column) -> Column:
    """The key of a field in small letters."""
    return F.concat(F.lit("~"), field)


def holds(of: Column, rule: Column) -> Column:
    """Whether a rule's row fires on a message's fields, those that tests fold in small letters too."""

    def one(s: Column, op: Column, v: Column) -> Column:
        return F.when(op == "eq", s == v).when(op == "contains", F.contains(s, v)).when(op == "startswith", F.startswith(s, v)).when(op == "endswith", F.endswith(s, v)).otherwise(F.regexp_like(s, v))

    def test(t: Column) -> Column:
        s = F.try_element_at(of, F.when(t["fold"], _lowered(t["field"])).otherwise(t["field"]))
        each = lambda v: F.coalesce(one(s, t["op"], v), F.lit(False))
        return F.when(t["every"], F.forall(t["values"], each)).otherwise(F.exists(t["values"], each))

    chosen = F.transform(rule["selections"], lambda alternatives: F.exists(alternatives, lambda tests: F.forall(tests, test)))
    return F.exists(rule["ways"], lambda way: F.forall(way, lambda x: F.get(chosen, x["selection"]) != x["negated"]))


def _read(of: Column, names: list[tuple[str, bool]]) -> Column:
    """Of a message's fields only these (name, folded), so that each is lowered once."""
    return F.map_from_arrays(F.array(*(F.lit("~" + n if fold else n) for n, fold in names)).cast("array<string>"), F.array(*(F.lower(c) if fold else c for n, fold in names for c in [F.try_element_at(of, F.lit(n))])).cast("array<string>"))


def _held(messages: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """idx, part of the parts that hold for each message, each pair once; and rule_ord, part of every rule.

    Rules share parts, so a message meets each distinct part once, however many
    rules have it.  Long fields, those that literals are looked up in, go only to
    parts that read them again.
    """
    spark = messages.sparkSession
    pieces = written(rules.select("rule_ord", "selections", "ways").mapInArrow(_parted, "rule_ord long, content string").distinct())
    bodies = pieces.select("content").distinct().select("content", F.from_json("content", _PART).alias("b")).select("content", "b.*")
    tests = F.flatten(F.flatten(F.col("rule.selections")))
    numbered = written(bodies.select(F.monotonically_increasing_id().alias("part"), "content", "field", "fold", "literal", "rule", F.array_distinct(F.transform(tests, lambda t: F.struct(t["field"].alias("name"), t["fold"].alias("fold")))).alias("reads")))
    links = written(pieces.join(numbered.select("content", "part"), "content").select("rule_ord", "part"))
    literals = written(numbered.filter("literal IS NOT NULL").select("field", "fold", "literal").distinct().withColumn("key", F.monotonically_increasing_id() + ANY + 1))
    scanned = [r["field"] for r in literals.select("field").distinct().collect()]  # a handful of fields
    heavy = F.exists("reads", lambda t: t["name"].isin(scanned))
    keyed = written(numbered.join(literals, ["field", "fold", "literal"], "left").select(F.coalesce("key", F.lit(ANY)).alias("key"), "part", "rule", "reads", heavy.alias("heavy")))
    known = {h: sorted((r["name"], r["fold"]) for r in keyed.filter(F.col("heavy") == h).select(F.inline("reads")).distinct().collect()) for h in (False, True)}  # names of fields
    sizes = {r["heavy"]: r for r in keyed.groupBy("heavy").agg(F.sum(F.length(F.to_json("rule"))).alias("size"), F.count_if(F.col("key") == ANY).alias("free")).collect()}
    passes = -(-max(int(literals.agg(F.sum(F.length("literal"))).first()[0] or 0), 1) // PASS_CHARS)
    read, pairs = messages.select("idx", fields(messages).alias("of")), []
    for k in range(passes):
        mine = literals.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == k).select("field", "fold", "key", "literal").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in mine])
        hits = [F.array(F.lit(ANY).cast("long"))] if k == 0 and any(r["free"] for r in sizes.values()) else []
        for field, fold in sorted({(r["field"], r["fold"]) for r in mine}):
            text = F.try_element_at("of", F.lit(field))
            hits.append(_hits(sent, (field, fold), F.lower(text) if fold else text))
        for h in sizes if hits else ():
            body = keyed.filter(F.col("heavy") == h).select("key", "part", "rule")
            asked = read.select("idx", _read(F.col("of"), known[h]).alias("of"), F.explode(F.concat(*hits)).alias("key"))
            met = asked.join(F.broadcast(body) if sizes[h]["size"] <= BROADCAST_BYTES else body, "key")
            pairs.append(met.filter(holds(F.col("of"), F.col("rule"))).select("idx", "part"))
    if not pairs:
        return spark.createDataFrame([], "idx long, part long"), links
    return reduce(DataFrame.unionByName, pairs).distinct(), links


def _classes(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """class, part of the distinct sets of parts, and rule_ord, class of every rule that has any."""
    sets = links.groupBy("rule_ord").agg(F.array_sort(F.collect_set("part")).alias("parts"))  # the parts of one rule
    numbered = written(sets.select("parts").distinct().withColumn("class", F.monotonically_increasing_id()))
    return numbered.select("class", F.explode("parts").alias("part")), sets.join(numbered, "parts").select("rule_ord", "class")


def fired(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """idx, rule_ord of every rule that a message fires; messages have properties and idx, rules are rows of RULES.

    Rows that repeat an idx count as one, and so do rules of one rule_ord, any of
    which may fire.  Missing fields and null texts hold no literal.
    """
    held, links = _held(messages, rules)
    return held.join(links, "part").select("idx", "rule_ord").distinct()


def indexed_fires(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """rule_ord, title, level, n for every rule, those that never fire too.

    A class of rules counts what its most frequent part holds for, and of its
    other parts only the messages that this one does not hold for.
    """
    pairs, links = _held(messages, rules)
    held = written(pairs)
    members, of = _classes(links)
    counted = written(members.join(held.groupBy("part").agg(F.count("*").alias("n")), "part"))
    first = counted.groupBy("class").agg(F.max(F.struct("n", "part")).alias("first")).select("class", F.col("first.part").alias("first"), "first.n")
    others = held.join(counted.select("class", "part").join(first, "class").filter("part <> first"), "part").select("idx", "class", "first").distinct()
    seen = held.select(F.col("idx").alias("seen"), F.col("part").alias("first"))
    more = others.join(seen, (others["first"] == seen["first"]) & others["idx"].eqNullSafe(seen["seen"]), "left_anti").groupBy("class").agg(F.count("*").alias("more"))
    counts = of.join(first.join(more, "class", "left").select("class", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")), "class").select("rule_ord", "n")
    return rules.select("rule_ord", "title", "level").join(counts, "rule_ord", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def indexed_samples(messages: DataFrame, rules: DataFrame, k: int = 5) -> DataFrame:
    """rule_ord, idx of the first k messages that fire each rule: they are among the first k of its parts."""
    held, links = _held(messages, rules)
    first = lambda rows, key: rows.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("idx"))).filter(F.col("k") <= k).select(key, "idx")
    members, of = _classes(links)
    samples = first(members.join(first(held, "part"), "part").select("class", "idx").distinct(), "class")
    return of.join(samples, "class").select("rule_ord", "idx")
