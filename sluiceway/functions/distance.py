"""Edit distance with swaps of neighbours, and candidates for it by deletions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at the start of a name whose deletions are compared.
START = 7


def alignment_distance(a: Column, b: Column) -> Column:
    """Insertions, deletions, substitutions and swaps of two neighbours that turn a into b; no part is edited twice.

    The table of the dynamic programme is built row by row: the state is the row
    before last and the last row.
    """
    n, m = F.length(a), F.length(b)
    at = lambda s, k: F.substr(s, k, F.lit(1))
    first = F.transform(F.sequence(F.lit(0), m), lambda j: j.cast("int"))

    def row(state: Column, i: Column) -> Column:
        older, old = state["older"], state["old"]

        def cell(done: Column, j: Column) -> Column:
            same = at(a, i) == at(b, j)
            cost = F.least(F.get(old, j) + 1, F.get(done, j - 1) + 1, F.get(old, j - 1) + F.when(same, 0).otherwise(1))
            swap = (i > 1) & (j > 1) & (at(a, i) == at(b, j - 1)) & (at(a, i - 1) == at(b, j))
            return F.concat(done, F.array(F.when(swap, F.least(cost, F.get(older, j - 2) + 1)).otherwise(cost)))

        return F.struct(old.alias("older"), F.aggregate(F.slice(F.sequence(F.lit(0), m), F.lit(2), m), F.array(i.cast("int")), cell).alias("old"))

    start = F.struct(first.alias("older"), first.alias("old"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), n), F.lit(2), n), start, row, lambda s: F.element_at(s["old"], -1))


def edit_distance(a: Column, b: Column) -> Column:
    """The same distance; the dynamic programme runs only where two neighbours of one text stand in the other's the other way round, else no swap can help."""
    pairs = lambda s, back: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.reverse(F.substr(s, i, F.lit(2))) if back else F.substr(s, i, F.lit(2)))
    return F.when(F.arrays_overlap(pairs(a, False), pairs(b, True)), alignment_distance(a, b)).otherwise(F.levenshtein(a, b))


def deletions(s: Column, most: int) -> Column:
    """Structs of v and k: what is left of the first START characters without any k of them, k from 0 to most.

    Names within d edits of each other share a v with k of at most d on both sides.
    """
    less = lambda x: F.transform(F.slice(F.sequence(F.lit(0), F.length(x)), F.lit(2), F.length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.length(x))))
    counted = lambda k: lambda v: F.struct(v.alias("v"), F.lit(k).alias("k"))
    now, out = F.array(F.substring(s, 1, START)), []
    for k in range(most + 1):
        out.append(F.transform(now, counted(k)))
        if k < most:
            now = F.array_distinct(F.flatten(F.transform(now, less)))
    return F.flatten(F.array(*out))
