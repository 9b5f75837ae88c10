"""The catalog of a routing configuration: expressions, statements and definitions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lit:
    value: str | float | bool | tuple[str, ...]


@dataclass(frozen=True)
class Ref:
    """A property ($name), local variable ($.name) or structured field ($!name)."""

    space: str
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Op:
    """A unary or binary operation, by its operator."""

    op: str
    args: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple = ()


@dataclass(frozen=True)
class Selector(If):
    """The test that a selector line stands for."""


@dataclass(frozen=True)
class Action:
    kind: str
    params: tuple[tuple[str, str], ...] = ()

    def param(self, name: str) -> str | None:
        return dict(self.params).get(name)


@dataclass(frozen=True)
class Set:
    """Assigns an expression, or clears the name if it is None."""

    space: str
    name: str
    value: object


@dataclass(frozen=True)
class Stop:
    pass


@dataclass(frozen=True)
class CallRuleset:
    name: str


@dataclass(frozen=True)
class Unknown:
    text: str


@dataclass
class Input:
    type: str
    port: int | None = None
    ruleset: str | None = None


@dataclass
class Lookup:
    """A loaded lookup table: entries by key, or rows, a table of its own (see operators.enrich.Table)."""

    entries: dict[str, str] = field(default_factory=dict)
    nomatch: str | None = None
    loaded: bool = True
    rows: object = None


@dataclass
class Config:
    inputs: list[Input] = field(default_factory=list)
    rulesets: dict[str, tuple] = field(default_factory=dict)
    templates: dict[str, str] = field(default_factory=dict)
    lookups: dict[str, Lookup] = field(default_factory=dict)
    lookup_files: dict[str, str] = field(default_factory=dict)
    modules: list[str] = field(default_factory=list)
    default: str | None = None
    #: Files to include, in the order of reading; line and message of what could not be read.
    includes: list[str] = field(default_factory=list)
    problems: list[tuple[int, str]] = field(default_factory=list)
