"""Compiles a configuration to a chain of projections over messages.

Statements become guarded values.  Each assignment, stop and test is a column of
its own, that later ones refer to, so the plan grows with the number of
statements; those that do not depend on one another share a projection.  Spark
computes the chain in one pass inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.expressions import Compiler, as_bool, as_str
from sluiceway.functions.jsontext import json_object, repeated_keys, shown_members
from sluiceway.model import Action, CallRuleset, Config, If, Input, Lookup, Set, Stop
from sluiceway.operators.enrich import attach
from sluiceway.plans.levels import Levels

MAX_DEPTH = 16
_TYPES = {"udp": ("imudp",), "tcp": ("imtcp", "imptcp")}


def _match(inputs: list[Input]) -> tuple[Column, Column]:
    """Position of the input that takes a message, and the ruleset it names."""
    order = [(i, x) for ported in (True, False) for i, x in enumerate(inputs) if (x.port is not None) == ported]
    where, ruleset = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, x in reversed(order):
        kinds = [t for t, names in _TYPES.items() if x.type in names]
        if not kinds:
            continue
        test = F.col("transport") == kinds[0]
        if x.port is not None:
            test &= F.col("port") == x.port
        where, ruleset = F.when(test, i).otherwise(where), F.when(test, F.lit(x.ruleset)).otherwise(ruleset)
    return where, ruleset


class _Walk:
    """A walk over the statements that a message may meet; `levels` carries the state in columns."""

    def __init__(self, rows: DataFrame, config: Config, tag: str, trace: bool) -> None:
        self.levels, self.config, self.trace, self.strict = Levels(rows, tag), config, trace, False
        self.local: dict[str, Column] = {}
        self.props: dict[str, Column] = {}
        self.fields = F.col("structured")
        self.parsed = F.lit("")
        self.stopped: Column | None = None
        self.outputs: list[Column] = []
        self.missing: list[Column] = []
        self.events: list[Column] = []
        self.faults: list[Column] = []
        self.compile = Compiler(config, self.read, F.col("facility"), F.col("severity"), self.keep, self.attach)

    def keep(self, value: Column) -> Column:
        """The value as a column of its own."""
        return F.col(self.levels.keep(value))

    def lay_out(self, wanted: set[str] | None = None) -> DataFrame:
        if not self.strict:
            return self.levels.lay_out(wanted)
        with repeated_keys(self.levels.rows.sparkSession):
            return self.levels.lay_out(wanted)

    def attach(self, table: Lookup, key: Column) -> Column:
        """The value of a key in a table that is a frame: a join in the chain of projections."""
        on, into = self.levels.keep(key), self.levels.new_name()
        self.levels.rows = attach(self.lay_out(), table.rows, on, into)
        return F.col(into)

    def value(self, e: object, now: Column):
        """A compiled expression; what it could not find for a message that comes here is that message's fault."""
        out = self.compile(e)
        self.faults += [F.when(now & v.isNull(), F.lit("a pattern took too long")) for v in self.compile.open]
        self.compile.open.clear()
        return out

    def note(self, now: Column, kind: str, message: Callable[[], Column] | str) -> None:
        """An event of the messages that come here; nothing is made unless there is a trace."""
        if self.trace:
            text = F.lit(message) if isinstance(message, str) else F.coalesce(message(), F.lit(""))
            self.events.append(F.when(now, F.struct(F.lit(kind).alias("type"), text.alias("message"))))

    def read(self, space: str, name: str) -> Column:
        if space == "$":
            if name not in self.props:
                self.props[name] = F.col(f"props.`{name}`") if name in PROPERTIES else F.lit("")
            return self.parsed if name == "parsesuccess" else self.props[name]
        if space == "$!":
            return F.try_element_at(self.fields, F.lit(name))
        return self.local.get(name, F.lit(None).cast("string"))

    def run(self, statements: tuple, guard: Column, depth: int = 0) -> None:
        for s in statements:
            now = guard if self.stopped is None else guard & ~self.stopped
            if isinstance(s, If):
                test = self.keep(now & F.coalesce(as_bool(self.value(s.test, now)), F.lit(False)))
                self.note(now, "condition_eval", lambda: test.cast("string"))
                self.run(s.then, test, depth)
                if s.other:
                    self.run(s.other, self.keep(now & ~test), depth)
            elif isinstance(s, Stop):
                self.note(now, "stop", "")
                self.stopped = self.keep(now if self.stopped is None else self.stopped | now)
            elif isinstance(s, Set):
                self.assign(s, now)
                self.note(now, "unset" if s.value is None else "set", s.space + s.name if s.value is None else lambda: F.concat_ws("=", F.lit(s.space + s.name), self.read(s.space, s.name)))
            elif isinstance(s, CallRuleset) and depth < MAX_DEPTH and s.name in self.config.rulesets:
                self.note(now, "call", s.name)
                self.run(self.config.rulesets[s.name], now, depth + 1)
            elif isinstance(s, Action) and s.kind == "mmjsonparse":
                self.parse(s, now)
                self.note(now, "action", lambda: F.concat(F.lit("mmjsonparse "), self.parsed))
            elif isinstance(s, Action):
                self.outputs.append(F.when(now, self.output(s)))
                self.note(now, "action", lambda: F.concat_ws(" ", F.lit(s.kind), self.outputs[-1]["label"]))
                for name in (s.param("dynafile"),):
                    if s.kind == "omfile" and name and name not in self.config.templates:
                        self.missing.append(F.when(now, F.lit("W_TEMPLATE_MISSING")))

    def assign(self, s: Set, now: Column) -> None:
        value = F.lit(None).cast("string") if s.value is None else as_str(self.value(s.value, now))
        if s.space == "$!":
            others = F.map_filter(self.fields, lambda k, _: k != s.name)
            new = others if s.value is None else F.map_concat(others, F.create_map(F.lit(s.name), value))
            self.fields = self.keep(F.when(now, new).otherwise(self.fields))
        else:
            self.local[s.name] = self.keep(F.when(now, value).otherwise(self.read(s.space, s.name)))

    def parse(self, a: Action, now: Column) -> None:
        """The members of a JSON object in a field become structured fields; other texts change nothing."""
        container, cookie = a.param("container") or "msg", a.param("cookie") or "@cee:"
        raw = F.coalesce(self.read("$!", container[2:]) if container.startswith("$!") else self.read("$", container.removeprefix("$").lower()), F.lit(""))
        body = F.regexp_replace(F.when(raw.startswith(cookie), F.substr(raw, F.lit(len(cookie) + 1))).otherwise(raw), r"^\s+", "")
        self.strict = True
        members = self.keep(F.when(now & body.startswith("{"), shown_members(json_object(body))))
        new = F.map_concat(F.map_filter(self.fields, lambda k, _: ~F.map_contains_key(members, k)), members)
        self.fields = self.keep(F.when(members.isNotNull(), new).otherwise(self.fields))
        self.parsed = self.keep(F.when(now, F.when(members.isNotNull(), "OK").otherwise("FAIL")).otherwise(self.parsed))

    def output(self, a: Action) -> Column:
        text = lambda v: F.lit(v).cast("string")
        path = text(a.param("path"))
        if a.kind == "omfile":
            name = a.param("dynafile")
            source = self.config.templates.get(name, "") if name else a.param("file") or ""
            path = self.compile.template(source)
        target, port, protocol = a.param("target"), a.param("port"), a.param("protocol")
        if a.kind == "omfwd":
            label = text(f"{target or '?'}:{port or '?'}/{protocol or '?'}")
        else:
            label = F.coalesce(path, text(target), text(a.param("template")), text(a.kind)) if a.kind != "omfile" else path
        fields = {"kind": text(a.kind), "label": label, "path": path, "target": text(target), "port": F.lit(int(port) if port and port.isdigit() else None).cast("int"), "protocol": text(protocol)}
        return F.struct(*(c.alias(k) for k, c in fields.items()))


PROPERTIES = ("syslogpriority", "syslogpriority-text", "$second", "$now", "$now_utc", "$bom", "msg", "rawmsg", "hostname", "fromhost", "fromhost-ip", "programname", "syslogtag", "inputname", "pri", "syslogfacility", "syslogseverity", "syslogfacility-text", "syslogseverity-text", "pri-text", "timereported", "timegenerated", "timestamp", "$year", "$month", "$day", "$hour", "$minute", "$myhostname")
_OUTPUT = "array<struct<kind:string,label:string,path:string,target:string,port:int,protocol:string>>"


def evaluate(messages: DataFrame, config: Config, suffix: str = "", force: str | None = None, trace: bool = False) -> DataFrame:
    """messages (with properties) and, per message: ruleset, stopped, dropped, outputs, vars, fields, notes, error.

    ruleset is the selected one: that of the input that matches, else the default
    one, or `force` for all; null if there is none.  A selected ruleset that is
    not defined runs nothing.  vars and fields are the local variables and
    structured fields at the end, notes the codes of what was missing.  error says
    why a message failed: by the column fault of messages, if there is one, or by a
    statement; such a message has no ruleset and no output and is not dropped.
    With trace, also the events of each message in their order.
    """
    where, named = _match(config.inputs)
    chosen = F.coalesce(F.when(where.isNotNull(), named), F.lit(config.default)) if force is None else F.lit(force)
    walk = _Walk(messages, config, f"s{suffix}_", trace)
    given = F.col("fault") if "fault" in messages.columns else F.lit(None).cast("string")
    chosen = walk.keep(F.when(given.isNull(), chosen.cast("string")))
    entries = {force} if force is not None else {config.default, *(x.ruleset for x in config.inputs)}
    walk.note(chosen.isNotNull(), "input_selected", lambda: chosen)
    for name in sorted(x for x in entries if x in config.rulesets):
        here = walk.keep(F.coalesce(chosen == name, F.lit(False)))
        walk.note(here, "ruleset_entered", name)
        walk.run(config.rulesets[name], here)
    outputs = F.array_compact(F.array(*walk.outputs)) if walk.outputs else F.array().cast(_OUTPUT)
    error = walk.keep(F.coalesce(given, *walk.faults)) if walk.faults else given
    outputs = F.when(error.isNull(), outputs).otherwise(F.array().cast(_OUTPUT))
    undefined = F.when(chosen.isNotNull() & ~chosen.isin(list(config.rulesets)), F.lit("W_RULESET_MISSING"))
    pairs = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in walk.local.items()]
    variables = F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.create_map().cast("map<string,string>")
    found = {
        "ruleset": F.when(error.isNull(), chosen), "stopped": F.lit(False) if walk.stopped is None else walk.stopped, "dropped": chosen.isNull() & error.isNull(), "outputs": outputs, "vars": variables, "fields": walk.fields,
        "notes": F.array_distinct(F.array_compact(F.array(undefined, *walk.missing))), "error": error,
    }
    if trace:
        found["trace"] = F.transform(F.array_compact(F.array(*walk.events)), lambda e, k: F.struct((k + 1).alias("step"), e["type"].alias("type"), e["message"].alias("message")))
    rows = walk.lay_out(set().union(*map(walk.levels.reads, found.values())))
    return rows.select(*(f"`{c}`" for c in messages.columns), *(c.alias(k + suffix) for k, c in found.items()))
