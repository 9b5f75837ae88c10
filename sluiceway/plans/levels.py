"""Columns that refer to one another, laid out as few projections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Levels:
    """Columns over a frame, each of which may read those before it.

    They are laid out when they are asked for: a column stands in the projection
    before the first that reads it and goes after the last, so the projections are
    as many as the longest chain of columns that read one another, and independent
    ones share them.
    """

    def __init__(self, rows: DataFrame, tag: str) -> None:
        self.rows, self.tag, self.number = rows, tag, 0
        self._name = re.compile(rf"(?<!\w)_{re.escape(tag)}\d+(?!\w)")
        self._columns: dict[str, Column] = {}
        self._reads: dict[str, set[str]] = {}

    def new_name(self) -> str:
        self.number += 1
        return f"_{self.tag}{self.number}"

    def keep(self, value: Column) -> str:
        """The name that the value will have."""
        reads, name = self.reads(value), self.new_name()
        self._columns[name], self._reads[name] = value, reads
        return name

    def reads(self, value: Column) -> set[str]:
        """Columns not laid out yet whose names are in the text of a column; one more, from a literal, does no harm."""
        return {x for x in self._name.findall(str(value)) if x in self._columns}

    def lay_out(self, wanted: set[str] | None = None) -> DataFrame:
        """The frame with the wanted columns, or with all; later columns build on it."""
        first, last = {}, {}
        for name in reversed(self._columns):
            if wanted is None or name in wanted:
                first.setdefault(name, 0)
                last[name] = 0
            if name in first:
                level = first[name] = first[name] + 1
                for x in self._reads[name]:
                    first[x], last[x] = max(first.get(x, 0), level), min(last.get(x, level), level)
        base = [f"`{c}`" for c in self.rows.columns]
        here: list[str] = []
        for level in range(max(first.values(), default=0), 0, -1):
            new = [x for x in self._columns if first.get(x) == level]
            here = [x for x in here if last[x] < level]
            self.rows = self.rows.select(*base, *here, *(self._columns[x].alias(x) for x in new))
            here += new
        self._columns, self._reads = {}, {}
        return self.rows
