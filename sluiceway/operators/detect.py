"""Detection rules as predicate columns: one pass over the messages for all rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import yaml
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.expressions import safe_pattern
from sluiceway.model import Config
from sluiceway.plans.routing import evaluate

# Names of fields that rules use, and the property each reads.
ALIASES = {
    "programname": ["programname", "image", "processname", "process_name", "imagepath"], "msg": ["msg", "message", "commandline", "command_line", "user", "username", "subjectusername"],
    "hostname": ["hostname", "computer", "computername", "host"], "syslogfacility": ["facility"], "syslogseverity": ["severity", "level"], "rawmsg": ["rawmsg"],
    "syslogtag": ["syslogtag"], "fromhost": ["fromhost"], "fromhost-ip": ["fromhost-ip", "fromhostip"],
}


def parse_rules(text: str) -> list[dict]:
    """Rules of a YAML text: one, several documents, or a list; without title or detection they are left out."""
    found = [r for doc in yaml.safe_load_all(text) for r in (doc if isinstance(doc, list) else [doc])]
    return [r for r in found if isinstance(r, dict) and r.get("title") and isinstance(r.get("detection"), dict)]


def _field(name: str) -> Column:
    for prop, names in ALIASES.items():
        if name.lower() in names:
            value = F.col(f"props.`{prop}`")
            return F.when(F.length(value) > 0, value).otherwise(F.col("props.rawmsg")) if prop == "msg" else value
    return F.try_element_at(F.col("structured"), F.lit(name))


def _test(key: str, values: object) -> Column:
    name, *modifiers = key.split("|")
    s, fold = _field(name), "i" in modifiers
    if fold and "re" not in modifiers:
        s = F.lower(s)

    def one(v: object) -> Column:
        text = str(v).lower() if fold else str(v)
        if "contains" in modifiers:
            return s.contains(text)
        if "startswith" in modifiers:
            return s.startswith(text)
        if "endswith" in modifiers:
            return s.endswith(text)
        if "re" in modifiers:
            p = safe_pattern(str(v))
            return s.rlike(("(?i)" if fold else "") + p) if p else F.lit(False)
        return s == text

    tests = [F.coalesce(one(v), F.lit(False)) for v in (values if isinstance(values, list) else [values]) if v is not None]
    return reduce(Column.__and__ if "all" in modifiers else Column.__or__, tests) if tests else F.lit("all" in modifiers)


def _selection(body: object) -> Column:
    """Fields of a map are joined by and; maps or words of a list by or; words are searched in the message."""
    if isinstance(body, dict):
        return reduce(Column.__and__, (_test(k, v) for k, v in body.items()), F.lit(True))
    items = body if isinstance(body, list) else [body]
    return reduce(Column.__or__, (_selection(x) if isinstance(x, dict) else _test("msg|contains", str(x)) for x in items), F.lit(False))


@dataclass(frozen=True)
class Algebra:
    """What and, or, not and `never` are for the values that a condition joins."""

    both: Callable
    either: Callable
    inverse: Callable
    never: object


def runs_here(rule: dict) -> bool:
    """Whether a rule's source is one that messages can come from."""
    product = (rule.get("logsource") or {}).get("product")
    return not product or str(product).lower() in ("linux", "unix")


def selections(rule: dict) -> dict[str, object]:
    return {k: v for k, v in rule["detection"].items() if k not in ("condition", "timeframe")}


def compile_rule(rule: dict) -> Column:
    """Whether a message fires a rule."""
    if not runs_here(rule):
        return F.lit(False)
    return condition(rule, {k: _selection(v) for k, v in selections(rule).items()}, Algebra(Column.__and__, Column.__or__, Column.__invert__, F.lit(False)))


def condition(rule: dict, named: dict, algebra: Algebra):
    """A rule's condition over the values of its selections: or, and, not, parentheses, names, `1 of`, `any of` and `all of`."""
    tokens = re.findall(r"[()]|[\w*-]+", str(rule["detection"].get("condition", "selection")))
    at = 0

    def peek() -> str:
        return tokens[at].lower() if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def chain(word: str, below, join):
        left = below()
        while peek() == word:
            take()
            left = join(left, below())
        return left

    def inverse():
        if peek() == "not":
            take()
            return algebra.inverse(inverse())
        return atom()

    def atom():
        if at >= len(tokens):
            return algebra.never
        word = take()
        if word == "(":
            inner = chain("or", conjunction, algebra.either)
            if peek() == ")":
                take()
            return inner
        if word.lower() in ("1", "any", "all") and peek() == "of":
            take()
            pattern = take()
            chosen = [c for k, c in named.items() if pattern == "them" or re.fullmatch(pattern.replace("*", ".*"), k)]
            return reduce(algebra.both if word.lower() == "all" else algebra.either, chosen) if chosen else algebra.never
        return named.get(word, algebra.never)

    def conjunction():
        return chain("and", inverse, algebra.both)

    return chain("or", conjunction, algebra.either)


def fires(messages: DataFrame, rules: list[dict]) -> DataFrame:
    """rule_ord, title, level, n for every rule, those that never fire too."""
    counts = messages.agg(*(F.count_if(compile_rule(r)).alias(f"r{k}") for k, r in enumerate(rules)))
    rows = F.array(*(F.struct(F.lit(k).alias("rule_ord"), F.lit(str(r["title"])).alias("title"), F.lit(str(r.get("level", ""))).alias("level"), F.col(f"r{k}").alias("n")) for k, r in enumerate(rules)))
    return counts.select(F.inline(rows))


def fired_samples(messages: DataFrame, rules: list[dict], k: int = 5) -> DataFrame:
    """rule_ord, idx of the first k messages that fire each rule; by a window that keeps no more than k rows of each rule before the shuffle."""
    hit = F.array_compact(F.array(*(F.when(compile_rule(r), n) for n, r in enumerate(rules))))
    rows = messages.select("idx", F.explode(hit).alias("rule_ord"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("rule_ord").orderBy("idx"))).filter(F.col("k") <= k).select("rule_ord", "idx")


def fires_delta(messages: DataFrame, before: list[dict], after: list[dict]) -> DataFrame:
    """rule_ord, title, baseline, overlay, delta, pct of two rule sets over the same messages, rules by their place."""
    return fire_deltas(fires(messages, before), fires(messages, after))


def fire_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """rule_ord, title, baseline, overlay, delta, pct of two results of fires over the same rules.

    pct is 0 or 100 where the baseline is 0.
    """
    rows = before.withColumnRenamed("n", "baseline").join(after.select("rule_ord", F.col("n").alias("overlay")), "rule_ord")
    return _with_change(rows)


def _with_change(rows: DataFrame) -> DataFrame:
    delta = F.col("overlay") - F.col("baseline")
    pct = F.when(F.col("baseline") == 0, F.when(F.col("overlay") == 0, 0.0).otherwise(100.0)).otherwise(F.floor(delta * 1000 / F.col("baseline") + 0.5) / 10)
    return rows.select("rule_ord", "title", "baseline", "overlay", delta.alias("delta"), pct.alias("pct"))


def _hits(messages: DataFrame, rules: list[dict], config: Config, tag: str) -> DataFrame:
    """messages with a column of each rule: whether it fires once the configuration has set the structured fields."""
    routed = evaluate(messages, config, "_")
    fed = routed.withColumns({"_before": F.col("structured"), "structured": F.col("fields_")})
    hit = fed.withColumns({f"_{tag}{k}": compile_rule(r) for k, r in enumerate(rules)}).withColumn("structured", F.col("_before"))
    return hit.select(*messages.columns, *(f"_{tag}{k}" for k in range(len(rules))))


def routed_fire_deltas(messages: DataFrame, rules: list[dict], baseline: Config, overlay: Config) -> DataFrame:
    """rule_ord, title, baseline, overlay, delta, pct, of the same rules over messages as each of two configurations leaves them, in one pass."""
    both = _hits(_hits(messages, rules, baseline, "a"), rules, overlay, "b")
    counts = both.agg(*(F.count_if(f"_{t}{k}").alias(f"{t}{k}") for t in "ab" for k in range(len(rules))))
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule_ord"), F.lit(str(r["title"])).alias("title"), F.col(f"a{k}").alias("baseline"), F.col(f"b{k}").alias("overlay")) for k, r in enumerate(rules)))))
    return _with_change(rows)


def regression_gate(deltas: DataFrame, most: int = 0) -> DataFrame:
    """regressions, passed: rules that fire less in the overlay, and whether there are no more than allowed."""
    return deltas.agg(F.count_if(F.col("delta") < 0).alias("regressions")).withColumn("passed", F.col("regressions") <= most)
