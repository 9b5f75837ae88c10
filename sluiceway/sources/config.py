"""Reads the primary routing language into the catalog.

One pattern cuts a text into tokens; a recursive descent builds statements.  A
line that starts with a selector or a property filter is a statement of its own.
"""

from __future__ import annotations

import json
import re

from sluiceway.model import Action, Call, CallRuleset, Config, If, Input, Lit, Lookup, Op, Ref, Selector, Set, Stop, Unknown

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<num>\d+(?:\.\d+)?)"""
    r"""|(?P<ref>\$[.!]?[A-Za-z_][\w.!-]*(?::[\w,:$-]*[\w$])?|\$!)|(?P<op>==|!=|<=|>=|=~|!~|[<>&+*/%(){}\[\];,=-])|(?P<name>[A-Za-z_][\w.-]*)""",
    re.S,
)
_SELECTOR = re.compile(r"[ \t]*([a-z*][\w*,]*\.(?:[!=]{0,2}[\w*]+)(?:;[\w*,]+\.[!=]{0,2}[\w*]+)*)[ \t]+([^\s{(].*)$", re.M)
_PROPERTY = re.compile(r"""[ \t]*:(\w[\w-]*),[ \t]*(!?)(\w+),[ \t]*"((?:\\.|[^"\\])*)"[ \t]+(.+)$""", re.M)
_WORD_OPS = {"eq": "==", "ne": "!="}
_COMPARE = {"==", "!=", "<", "<=", ">", ">=", "=~", "!~", "contains", "contains_i", "startswith", "startswith_i", "eq", "ne"}


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.config = text, 0, Config()
        self.wrong = self.config.problems
        self.legacy: list = []
        self.bare: list = []
        self.other: list = []

    def peek(self) -> tuple[str, str]:
        while True:
            m = _TOKEN.match(self.text, self.at)
            if not m:
                return ("end", "") if self.at >= len(self.text) else ("bad", self.text[self.at])
            if m.lastgroup != "skip":
                return m.lastgroup, m[0]
            self.at = m.end()

    def take(self, want: str | None = None) -> str:
        kind, text = self.peek()
        if kind == "end" or want is not None and text != want:
            raise SyntaxError(f"expected {want or 'more'}, found {text or 'the end'}")
        self.at += len(text)
        return text

    def maybe(self, text: str) -> bool:
        if self.peek()[1].lower() == text:
            self.take()
            return True
        return False

    # --- statements ---

    def file(self) -> Config:
        while self.peek()[0] != "end":
            for s in self.attempt(True):
                if isinstance(s, Action):
                    self.bare.append(s)
                elif isinstance(s, Selector):
                    self.legacy.append(s)
                else:
                    self.other.append(s)
        rest = (*self.legacy, *self.bare, *self.other)
        if rest:
            self.config.rulesets["_default_legacy"] = rest
            self.config.default = self.config.default or "_default_legacy"
        return self.config

    def block(self) -> tuple:
        if not self.maybe("{"):
            return tuple(self.statement(False))
        out: list = []
        while not self.maybe("}"):
            if self.peek()[0] == "end":
                self.note("a block is not closed")
                break
            out += self.attempt(False)
        return tuple(out)

    def note(self, message: str) -> None:
        self.wrong.append((self.text.count("\n", 0, self.at) + 1, message))

    def attempt(self, top: bool) -> list:
        """A statement; one that cannot be read is noted, and reading goes on behind it: after its semicolon, or on the next line."""
        began = self.at
        try:
            return self.statement(top)
        except SyntaxError as e:
            self.note(str(e))
            if self.at < len(self.text) and self.text[self.at] != ";":
                line = self.text.find("\n", max(self.at, began + 1))
                self.at = len(self.text) if line < 0 else line
            else:
                self.at += 1
            return []

    def statement(self, top: bool) -> list:
        kind, word = self.peek()
        if (m := _SELECTOR.match(self.text, self.at)) and re.match(r"action\s*\(", m[2]):
            self.at = m.start(2)
            return [If(Call("prifilt", (Lit(m[1]),)), tuple(self.statement(False)))]
        for pattern, make in ((_SELECTOR, self._selector), (_PROPERTY, self._property)):
            if m := pattern.match(self.text, self.at):
                self.at = m.end()
                return [make(m)]
        low = word.lower()
        if kind == "ref" and word.startswith("$") and top:
            return self._directive()
        if kind != "name":
            return [self._unknown()]
        if low == "if":
            self.take()
            test = self.expression()
            self.take("then")
            then = self.block()
            return [If(test, then, self.block() if self.maybe("else") else ())]
        if low in ("set", "reset", "unset"):
            self.take()
            space, name = self._name(self.take())
            value = None
            if low != "unset":
                self.take("=")
                value = self.expression()
            self.take(";")
            return [Set(space, name, value)]
        if low in ("stop", "continue"):
            self.take()
            return [Stop()] if low == "stop" else []
        if low in ("call", "reload_lookup_table"):
            self.take()
            if low == "call":
                return [CallRuleset(self.take())]
            self.params()
            return []
        if low in ("include", "action", "input", "module", "template", "ruleset", "lookup_table", "global", "main_queue"):
            self.take()
            params = self.params()
            return self._object(low, params)
        return [self._unknown()]

    def _unknown(self) -> Unknown:
        end = self.text.find("\n", self.at)
        end = len(self.text) if end < 0 else end
        text, self.at = self.text[self.at : end], end
        return Unknown(text)

    def _directive(self) -> list:
        line = self._unknown().text.split(None, 1)
        if line[0].lower() == "$template" and len(line) > 1:
            name, _, text = line[1].partition(",")
            self.config.templates[name.strip()] = _string(text.strip())
        elif line[0].lower() == "$defaultruleset" and len(line) > 1:
            self.config.default = line[1].strip()
        elif line[0].lower() == "$includeconfig" and len(line) > 1:
            self.config.includes.append(line[1].partition("#")[0].strip())
        elif line[0].lower() == "$modload" and len(line) > 1:
            self.config.modules.append(line[1].strip())
        return []

    def _object(self, kind: str, p: dict[str, str]) -> list:
        c = self.config
        if kind == "action":
            kinds = ("omfile", "omfwd", "omelasticsearch", "omkafka", "omhttp", "mmjsonparse")
            return [Action(p.get("type", "") if p.get("type") in kinds else "unknown", tuple(sorted(p.items())))]
        if kind == "input":
            c.inputs.append(Input(p.get("type", ""), int(p["port"]) if p.get("port", "").isdigit() else None, p.get("ruleset")))
        elif kind == "include" and p.get("file"):
            c.includes.append(p["file"])
        elif kind == "module":
            c.modules.append(p.get("load", ""))
        elif kind == "lookup_table":
            c.lookup_files[p.get("name", "")] = p.get("file", "")
        elif kind == "global" and "defaultruleset" in p:
            c.default = p["defaultruleset"]
        elif kind == "template":
            text = p.get("string", "")
            if self.maybe("{"):
                while not self.maybe("}"):
                    part, q = self.take().lower(), self.params()
                    text += q.get("value", "").replace("%", "%%") if part == "constant" else f"%{q.get('name', '')}%"
            c.templates[p.get("name", "")] = text
        elif kind == "ruleset":
            c.rulesets[p.get("name", "")] = self.block()
        return []

    def params(self) -> dict[str, str]:
        out: dict[str, str] = {}
        self.take("(")
        while not self.maybe(")"):
            name = self.take().lower()
            self.take("=")
            if self.maybe("["):
                values = []
                while not self.maybe("]"):
                    values.append(_string(self.take()))
                    self.maybe(",")
                out[name] = ",".join(values)
            else:
                out[name] = _string(self.take())
            self.maybe(",")
        return out

    def _selector(self, m: re.Match) -> Selector:
        return Selector(Call("prifilt", (Lit(m[1]),)), _target(m[2].strip()))

    def _property(self, m: re.Match) -> If:
        """A property filter needs a priority to fire, as any selector."""
        ops = {"isequal": "==", "startswith": "startswith", "contains": "contains", "regex": "=~", "ereregex": "=~"}
        test: object = Op(ops.get(m[3].lower(), "=="), (Ref("$", m[1]), Lit(_string(f'"{m[4]}"'))))
        if m[2]:
            test = Op("not", (test,))
        return If(test, (If(Call("prifilt", (Lit("*.*"),)), _target(m[5].strip())),))

    # --- expressions, by falling precedence ---

    def expression(self) -> object:
        return self._left(("or",), lambda: self._left(("and",), self._not))

    def _left(self, ops: tuple[str, ...], below) -> object:
        left = below()
        while self.peek()[1].lower() in ops:
            left = Op(self.take().lower(), (left, below()))
        return left

    def _not(self) -> object:
        return Op("not", (self._not(),)) if self.maybe("not") else self._comparison()

    def _comparison(self) -> object:
        left = self._concat()
        op = self.peek()[1].lower()
        if op in _COMPARE:
            self.take()
            return Op(_WORD_OPS.get(op, op), (left, self._concat()))
        return left

    def _concat(self) -> object:
        return self._left(("&",), lambda: self._left(("+", "-"), lambda: self._left(("*", "/", "%"), self._primary)))

    def _primary(self) -> object:
        kind, text = self.peek()
        self.take()
        if kind == "str":
            return Lit(_string(text))
        if kind == "num":
            return Lit(float(text))
        if kind == "ref":
            return Ref(*self._name(text))
        if text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if text == "-":
            return Op("-", (Lit(0.0), self._primary()))
        if text == "[":
            values = []
            while not self.maybe("]"):
                values.append(_string(self.take()))
                self.maybe(",")
            return Lit(tuple(values))
        if kind == "name" and self.maybe("("):
            args = []
            while not self.maybe(")"):
                args.append(self.expression())
                self.maybe(",")
            return Call(text.lower(), tuple(args))
        self.at -= len(text)
        raise SyntaxError(f"no expression: {text}")

    @staticmethod
    def _name(text: str) -> tuple[str, str]:
        return (text[:2], text[2:]) if text[:2] in ("$.", "$!") else ("$", text[1:].lower())


def _string(text: str) -> str:
    if text[:1] not in ("'", '"'):
        return text
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])


def _target(text: str) -> tuple:
    """What a selector's target stands for."""
    if text == "~" or text.lower() == "stop":
        return (Stop(),)
    m = re.match(r"(@@?)(?:\([^)]*\))?([^:;]+)(?::(\d+))?", text)
    if m:
        params = {"target": m[2], "protocol": "tcp" if m[1] == "@@" else "udp"} | ({"port": m[3]} if m[3] else {})
        return (Action("omfwd", tuple(sorted(params.items()))),)
    if text[0] == "?":
        return (Action("omfile", (("dynafile", text[1:].split(";")[0]),)),)
    if text.lstrip("-").startswith("/"):
        return (Action("omfile", (("file", text.lstrip("-").split(";")[0]),)),)
    return (Action("unknown", (("path", text[1:]),) if text[0] == "|" else ()),)


def parse_config(text: str, lookups: dict[str, str] | None = None) -> Config:
    """The catalog of a configuration; lookups: the content of lookup files by path."""
    config = _Parser(text).file()
    for name, path in config.lookup_files.items():
        content = (lookups or {}).get(path)
        config.lookups[name] = parse_lookup(content) if content is not None else Lookup(loaded=False)
    return config


def parse_lookup(text: str) -> Lookup:
    """A lookup table from one of its three JSON shapes."""
    data = json.loads(text, parse_constant=lambda _: None)
    show = lambda v: str(v).lower() if isinstance(v, bool) else f"{v:g}" if isinstance(v, float) else str(v)
    if isinstance(data, dict) and isinstance(data.get("table"), list):
        rows = [r for r in data["table"] if isinstance(r, dict) and isinstance(r.get("index"), str) and isinstance(r.get("value"), str)]
        return Lookup({r["index"]: r["value"] for r in rows}, data.get("nomatch"))
    if isinstance(data, dict):
        return Lookup({k: show(v) for k, v in data.items() if isinstance(v, (str, int, float, bool))})
    rows = [r for r in data if isinstance(r, dict)]
    key = next((k for r in rows for k in ("key", "index", "k", "name") if k in r), "key")
    value = next((k for r in rows for k in ("value", "val", "v") if k in r), "value")
    return Lookup({show(r[key]): show(r[value]) for r in rows if key in r and value in r})
