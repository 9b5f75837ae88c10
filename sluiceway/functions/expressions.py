"""Expressions of the routing language as Spark columns.

Each expression compiles to a kind (num, str, bool or list) and a column; the
language's coercions are inserted where kinds meet.  Missing names are empty.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import pandas as pd
import regex
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from sluiceway.model import Call, Config, Lit, Lookup, Op, Ref

# syslog's names.
FACILITIES = ("kern user mail daemon auth syslog lpr news uucp cron authpriv ftp ntp security console solaris-cron " "local0 local1 local2 local3 local4 local5 local6 local7").split()
SEVERITIES = "emerg alert crit err warning notice info debug".split()
SEVERITY_ALIASES = {"panic": "emerg", "error": "err", "warn": "warning"}

_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))"


@dataclass(frozen=True)
class Typed:
    kind: str
    column: Column
    literal: object = None


def number(s: Column) -> Column:
    """The number a string starts with, or null."""
    return F.nullif(F.regexp_extract(s, _NUMBER, 1), F.lit("")).try_cast("double")


def show_number(d: Column) -> Column:
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def as_str(x: Typed) -> Column:
    if x.kind == "num":
        return show_number(x.column)
    if x.kind == "bool":
        return F.when(x.column, "true").otherwise("false")
    return F.concat_ws(",", x.column) if x.kind == "list" else x.column


def as_num(x: Typed) -> Column:
    if x.kind == "num":
        return x.column
    return number(as_str(x))


def as_bool(x: Typed) -> Column:
    if x.kind == "bool":
        return x.column
    if x.kind == "num":
        return x.column != 0
    return F.size(x.column) > 0 if x.kind == "list" else (F.length(x.column) > 0) & (x.column != "0")


def safe_pattern(pattern: str) -> str | None:
    """The pattern for Spark's regular expressions, or None if it is none; $ ends the text only."""
    pattern = re.sub(r"(?<!\\)\$$", r"\\z", pattern)
    spark = SparkSession.getActiveSession()
    try:
        # The engine that will run it decides whether it is one.
        spark._jvm.java.util.regex.Pattern.compile(pattern) if spark else re.compile(pattern)
    except (re.error, IllegalArgumentException):
        return None
    return pattern


def groups(pattern: str) -> int:
    """The number of a valid pattern's groups."""
    return SparkSession.getActiveSession()._jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()


#: Seconds after which a pattern of a message is given up for it.
PATTERN_SECONDS = 2.0


@lru_cache(maxsize=4096)
def _compiled(pattern: str):
    """A pattern as one, or None; each worker compiles each distinct one once while it is in use."""
    try:
        return regex.compile(pattern)
    except (regex.error, OverflowError, RecursionError):
        return None


def _hit(text: str | None, pattern: str | None) -> bool | None:
    compiled = _compiled(pattern) if pattern else None
    try:
        return compiled is not None and compiled.search(text or "", timeout=PATTERN_SECONDS) is not None
    except TimeoutError:
        return None


def _group(text: str | None, pattern: str | None, group: str, miss: str) -> str | None:
    compiled = _compiled(pattern or "")
    try:
        found = compiled.search(text or "", timeout=PATTERN_SECONDS) if compiled is not None else None
    except TimeoutError:
        return None
    k = int(group) if group.isdigit() else 0
    return miss if found is None or k > compiled.groups or found[k] is None else found[k]


def dynamic_match(text: Column, pattern: Column) -> Column:
    """Whether a pattern that is no literal is found: false if it is none or empty, null if it takes too long."""
    udf = F.pandas_udf(lambda s, p: pd.Series([_hit(a, b) for a, b in zip(s, p)], dtype=object), BooleanType())
    return udf(text, pattern)


def dynamic_extract(text: Column, pattern: Column, group: Column, miss: Column) -> Column:
    """A group of the first match of a pattern that is no literal, or `miss`; null if it takes too long."""
    udf = F.pandas_udf(lambda s, p, g, m: pd.Series([_group(*x) for x in zip(s, p, g, m)], dtype=object), StringType())
    return udf(text, pattern, group, miss)


def prifilt(spec: str, facility: Column, severity: Column) -> Column:
    """Whether a priority is selected; without one, never.

    Clauses apply from left to right: one whose test holds selects, `none` takes
    back; names count in either case, and clauses with an unknown level do nothing.
    """
    hit: Column = F.lit(False)
    for clause in spec.split(";"):
        names, dot, level = clause.strip().rpartition(".")
        if not dot:
            continue
        wanted, level = [n.strip().lower() for n in names.split(",")], level.strip()
        here = F.lit(True) if "*" in wanted else facility.isin([FACILITIES.index(n) for n in wanted if n in FACILITIES])
        if level in ("none", "*"):
            hit = F.when(here, level == "*").otherwise(hit)
            continue
        form = re.match(r"(!?)(=?)(.*)", level)
        word = form[3].lower()
        word = SEVERITY_ALIASES.get(word, word)
        if word in SEVERITIES:
            k = SEVERITIES.index(word)
            test = severity == k if form[2] else severity <= k
            hit = F.when(here & (~test if form[1] else test), True).otherwise(hit)
    return F.coalesce(hit & facility.isNotNull() & severity.isNotNull(), F.lit(False))


def _slice(s: Column, start: Column, length: Column | None) -> Column:
    """0-based slice; a negative start counts from the end."""
    n = F.length(s)
    begin = F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(F.least(start, n)).cast("int")
    if length is None:
        return F.substr(s, begin + 1, n)
    stop = start + length
    stop = F.when(stop < 0, F.greatest(n + stop, F.lit(0))).otherwise(F.least(stop, n)).cast("int")
    return F.substr(s, begin + 1, F.greatest(stop - begin, F.lit(0)))


def modified(s: Column, modifiers: str) -> Column:
    """Property modifiers after the name: positions, a regular expression, or an option."""
    m = re.match(r"^R,ERE,(\d+),(\w+):(.*?)--end", modifiers)
    if m:
        miss = {"DFLT": F.lit("**NO MATCH**"), "ZERO": F.lit("0")}.get(m[2], F.lit(""))
        pattern = safe_pattern(m[3])
        if not pattern or int(m[1]) > groups(pattern):
            return miss
        return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, int(m[1]))).otherwise(miss)
    for part in modifiers.split(":"):
        low = part.lower()
        if low in ("lowercase", "uppercase"):
            s = F.lower(s) if low == "lowercase" else F.upper(s)
        elif low in ("json", "jsonf"):
            body = F.regexp_replace(F.to_json(F.struct(s.alias("v"))), r'^\{"v":|\}$', "")
            s = body if low == "jsonf" else F.regexp_replace(body, r'^"|"$', "")
        elif low == "space-cc":
            s = F.regexp_replace(s, r"[\x00-\x1f]", " ")
        elif low == "escape-cc":
            s = reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"#{k:x}")), range(32), s)
        elif low.startswith("date-") and low[5:] in ("unixtimestamp", "year", "month", "day", "hour"):
            t = F.try_to_timestamp(s)
            shown = F.unix_timestamp(t).cast("string") if low.endswith("timestamp") else F.date_format(t, {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}[low[5:]])
            s = F.coalesce(shown, s)
        elif m := re.fullmatch(r"(\d+)(?:,(\d+|\$))?", part):
            start = int(m[1])
            s = F.substr(s, F.lit(start), F.length(s) if m[2] in (None, "$") else F.lit(max(0, int(m[2]) - start + 1)))
    return s


class Compiler:
    """Compiles expressions; `read` gives the column of a name in the present state."""

    def __init__(self, config: Config, read: Callable[[str, str], Column], facility: Column, severity: Column, keep: Callable[[Column], Column], attach: Callable[[Lookup, Column], Column]) -> None:
        """keep: makes a value a column of its own; attach: the value of a key in a lookup table that is a frame."""
        self.config, self.read, self.facility, self.severity, self.keep, self.attach = config, read, facility, severity, keep, attach
        #: Values that are null where they could not be found.
        self.open: list[Column] = []

    def __call__(self, e: object) -> Typed:
        if isinstance(e, Lit):
            if isinstance(e.value, tuple):
                return Typed("list", F.array(*map(F.lit, e.value)), e.value)
            return Typed({str: "str", bool: "bool"}.get(type(e.value), "num"), F.lit(e.value), e.value)
        if isinstance(e, Ref):
            name, _, modifiers = e.name.partition(":")
            value = F.coalesce(self.read(e.space, name), F.lit(""))
            return Typed("str", modified(value, modifiers) if modifiers else value)
        if isinstance(e, Call):
            return self.call(e)
        return self.operation(e)

    def decided(self, value: Column, otherwise: Column) -> Column:
        """A value that may fail to be found for a message."""
        value = self.keep(value)
        self.open.append(value)
        return F.coalesce(value, otherwise)

    def matches(self, s: Column, pattern: Typed) -> Column:
        if isinstance(pattern.literal, str):
            p = safe_pattern(pattern.literal)
            return F.lit(False) if not p else s.rlike(p)
        return self.decided(dynamic_match(s, as_str(pattern)), F.lit(False))

    def operation(self, e: Op) -> Typed:
        args = [self(a) for a in e.args]
        if e.op == "not":
            return Typed("bool", ~as_bool(args[0]))
        a, b = args
        if e.op in ("and", "or"):
            return Typed("bool", as_bool(a) & as_bool(b) if e.op == "and" else as_bool(a) | as_bool(b))
        if e.op == "&":
            return Typed("str", F.concat(as_str(a), as_str(b)))
        if e.op in ("==", "!="):
            same = as_str(a) == as_str(b)
            return Typed("bool", same if e.op == "==" else ~same)
        if e.op in ("=~", "!~"):
            hit = self.matches(as_str(a), b)
            return Typed("bool", hit if e.op == "=~" else ~hit)
        if e.op in ("<", "<=", ">", ">="):
            compare = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}[e.op]
            x, y = as_num(a), as_num(b)
            return Typed("bool", F.when(x.isNotNull() & y.isNotNull(), compare(x, y)).otherwise(compare(as_str(a), as_str(b))))
        if e.op.split("_")[0] in ("contains", "startswith"):
            fold = F.lower if e.op.endswith("_i") else lambda c: c
            s = fold(as_str(a))
            needles = [F.lit(v) for v in b.literal] if b.kind == "list" else [as_str(b)]
            tests = [s.contains(fold(n)) if e.op.startswith("contains") else s.startswith(fold(n)) for n in needles]
            return Typed("bool", reduce(Column.__or__, tests, F.lit(False)))
        x, y = F.coalesce(as_num(a), F.lit(0.0)), F.coalesce(as_num(b), F.lit(0.0))
        if e.op in ("/", "%"):
            safe = F.nullif(y, F.lit(0.0))
            return Typed("num", F.coalesce(x / safe if e.op == "/" else x % safe, F.lit(0.0)))
        return Typed("num", {"+": x + y, "-": x - y, "*": x * y}[e.op])

    def call(self, e: Call) -> Typed:
        args = [self(a) for a in e.args]
        s = [as_str(a) for a in args]
        n = lambda k, other=0.0: F.coalesce(as_num(args[k]), F.lit(other))
        if e.name == "prifilt":
            return Typed("bool", prifilt(str(args[0].literal), self.facility, self.severity))
        if e.name == "lookup":
            table = self.config.lookups.get(str(args[0].literal))
            if table is None or not table.loaded:
                return Typed("str", F.lit(""))
            miss = F.lit(table.nomatch or "")
            if table.rows is not None:
                return Typed("str", F.coalesce(self.attach(table, s[1]), miss))
            if not table.entries:
                return Typed("str", miss)
            pairs = F.create_map(*(F.lit(x) for kv in table.entries.items() for x in kv))
            return Typed("str", F.coalesce(F.try_element_at(pairs, s[1]), miss))
        if e.name == "exec_template":
            text = self.config.templates.get(str(args[0].literal))
            return Typed("str", self.template(text) if text is not None else F.lit(""))
        if e.name == "getenv":
            return Typed("str", F.lit(os.environ.get(str(args[0].literal), "")))
        if e.name == "re_match":
            return Typed("bool", self.matches(s[0], args[1]))
        if e.name == "re_extract":
            s += [F.lit(""), F.lit(""), F.lit("0"), F.lit("0"), F.lit("")][len(s) :]
            literal = [args[k].literal if k < len(args) else 0.0 for k in (1, 3)]
            if not isinstance(literal[0], str) or literal[1] is None:
                group = F.coalesce(F.nullif(F.regexp_extract(s[3], r"^\s*(\d{1,9})", 1), F.lit("")), F.lit("0"))
                return Typed("str", self.decided(dynamic_extract(s[0], s[1], group, s[4]), s[4]))
            number_ = re.match(r"\s*\d+", str(literal[1]))
            pattern, group = safe_pattern(literal[0]), int(number_[0]) if number_ else 0
            if pattern is None or group > groups(pattern):
                return Typed("str", s[4])
            # A group that takes no part is null here and empty there; only a pattern with choices has such.
            return Typed("str", F.when(s[0].rlike(pattern), F.regexp_extract(s[0], pattern, group)).otherwise(s[4]))
        if e.name == "field":
            k = F.coalesce(F.nullif(n(2, 1.0).try_cast("int"), F.lit(0)), F.lit(1))
            part = F.when((F.length(s[1]) > 0) & (k > 0), F.split_part(s[0], F.nullif(s[1], F.lit("")), F.greatest(k, F.lit(1)))).when(F.length(s[1]) > 0, "").otherwise(s[0])
            return Typed("str", part)
        simple = {
            "tolower": lambda: ("str", F.lower(s[0])), "toupper": lambda: ("str", F.upper(s[0])), "strlen": lambda: ("num", F.length(s[0]).cast("double")),
            "cnum": lambda: ("num", n(0)), "cstr": lambda: ("str", s[0]), "replace": lambda: ("str", F.when(F.length(s[1]) > 0, F.replace(s[0], s[1], s[2])).otherwise(F.call_function("array_join", F.split(s[0], ""), s[2]))),
            "wrap": lambda: ("str", F.when(F.length(s[0]) > 0, F.concat(s[1], s[0], s[2] if len(s) > 2 else s[1])).otherwise("")),
            "substring": lambda: ("str", _slice(s[0], n(1), n(2) if len(s) > 2 else None)),
        }
        return Typed(*simple[e.name]()) if e.name in simple else Typed("str", F.lit(""))

    def template(self, text: str) -> Column:
        """A string template: %name:modifiers%, %% for a percent sign."""
        parts: list[Column] = []
        for m in re.finditer(r"%%|%([^%\n]+)%|([^%]+)|%", text):
            if m[1] is None:
                parts.append(F.lit("%" if m[0] == "%%" else m[0]))
            else:
                space = "$." if m[1].startswith("$.") else "$!" if m[1].startswith(("$!", "!")) else "$"
                name = m[1].removeprefix("$.").removeprefix("$!").removeprefix("!")
                name, _, modifiers = name.partition(":")
                parts.append(self(Ref(space, (name.lower() if space == "$" else name) + (":" + modifiers if modifiers else ""))).column)
        return F.concat(*parts) if parts else F.lit("")
